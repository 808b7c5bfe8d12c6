"""Shingle sets of texts and their fast similarity sketches, over whole batches of texts with numpy.

Words are maximal runs of bytes other than ASCII white space, A-Z lower-cased; a text's set holds its distinct runs of
``k`` words, or its whole word sequence if it has fewer, or nothing without words. Shingles are 64-bit hashes.

The sketch of a set has ``size`` coordinates. In round r every element falls into one bin by its own hash for that round and
bids a hash there; a bin takes the least bid of the first round that reaches it. After ``size`` such rounds, round
``size`` + i sends every element to bin i, so that each coordinate is filled however small the set is. Coordinates of
two sets agree with a probability equal to their Jaccard similarity, and the agreeing share is concentrated as if the
coordinates were independent; the expected work is of the order size * log(size) + elements.
"""

from __future__ import annotations

from functools import cache

import numpy as np

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
EMPTY = U(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective mix of 64-bit words, for each salt another one."""
    with np.errstate(over="ignore"):
        x = x + U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


@cache
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each byte: its hash after lower-casing, and whether it is white space."""
    low = np.arange(256, dtype=np.uint64)
    low[65:91] += U(32)
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return mixed(low, 7), space


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, U(base))
        out[0] = U(1)
        return np.cumprod(out, dtype=np.uint64)


def shingles(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text after text, and where each text's begin (one more entry than texts)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    ends = np.cumsum(sizes)
    table, is_space = _byte_tables()
    space = is_space[data]
    edge = np.diff(np.concatenate(([1], space.view(np.int8), [1])))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    with np.errstate(over="ignore"):
        # words: differences of a running polynomial hash, brought to a common power
        run = np.concatenate(([U(0)], np.cumsum(table[data] * _powers(_BASE, len(data)), dtype=np.uint64)))
        words = (run[last] - run[first]) * _powers(_INVERSE, len(data))[first]
    words = mixed(words ^ (last - first).astype(np.uint64) * _ODD, 1)
    owner = np.searchsorted(ends, first, side="right")
    counts = np.bincount(owner, minlength=len(raw))
    starts = np.concatenate(([0], np.cumsum(counts)))
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(raw) + 1, np.int64)
    grams, length = words.copy(), np.minimum(k, counts)
    with np.errstate(over="ignore"):
        for i in range(1, k):
            inside = np.arange(n) + i < starts[owner + 1]
            nxt = np.zeros(n, np.uint64)
            nxt[: n - i] = words[i:]
            grams = np.where(inside, mixed(grams * U(3) + nxt, 2), grams)
    keep = (np.arange(n) - starts[owner]) <= (counts - length)[owner]
    grams, owner = grams[keep], owner[keep]
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(raw)))))


def set_digests(grams: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set that don't depend on the order."""
    n = len(starts) - 1
    out = []
    for salt in (11, 12):
        with np.errstate(over="ignore"):
            total = np.concatenate(([U(0)], np.cumsum(mixed(grams, salt), dtype=np.uint64)))
            out.append(mixed(total[starts[1:]] - total[starts[:-1]], salt) if n else np.zeros(0, np.uint64))
    return out[0], out[1]


def sketches(grams: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """One row of ``size`` coordinates per set; an empty set's are all EMPTY."""
    n = len(starts) - 1
    out = np.full((n, size), EMPTY)
    counts = np.diff(starts)
    todo = np.flatnonzero(counts)
    flat = out.reshape(-1)
    round_ = 0
    while len(todo):
        spans = counts[todo]
        where = np.repeat(starts[todo] - np.concatenate(([0], np.cumsum(spans)[:-1])), spans) + np.arange(spans.sum())
        row = np.repeat(todo, spans)
        value = mixed(grams[where], 100 + round_)
        value[value == EMPTY] = U(0)
        if round_ < size:
            bin_ = (((value >> U(32)) * U(size)) >> U(32)).astype(np.int64)
            bid = mixed(value, 5)
            bid[bid == EMPTY] = U(0)
        else:
            bin_, bid = np.full(len(row), round_ - size), value
        at = row * size + bin_
        free = flat[at] == EMPTY
        np.minimum.at(flat, at[free], bid[free])
        round_ += 1
        todo = todo[(out[todo] == EMPTY).any(axis=1)]
    return out


def bands(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates; the band's number is part of the key."""
    n, size = coordinates.shape
    parts = coordinates.reshape(n, size // rows, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mixed(np.arange(size // rows, dtype=np.uint64), 21), parts.shape[:2])
        for i in range(rows):
            key = mixed(key * U(3) + parts[:, :, i], 22)
    return key
