"""Encoding whole texts with a public tokenizer, in pieces that the tokenizer itself can't see across.

A text is cut where the tokenizer's own pre-tokenizer always cuts, each distinct piece is encoded by the library once per
worker, and its ids are remembered in a table of bounded size. The ids are those of encoding the whole text at once:
texts with white space for which that isn't certain are given to the library whole. Strings of special tokens inside a
text are ordinary text.

Where white space belongs to what follows, many texts are cut at once, in arrays over their bytes, and a text's ids are taken from
those of its pieces: no piece is an object of Python.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers at most, and the longest one; when the table is full it is emptied ("spaced": but for pieces of the texts at hand).
MEMO_PIECES, MEMO_CHARS = 500_000, 48
#: Texts that are cut and looked up together, and characters that the library gets as one string when it encodes their new pieces.
GROUP, RUN_CHARS = 256, 1 << 14
#: Texts, and bytes beyond which a group ends early, that are cut in arrays together.
SPACED_GROUP, SPACED_BYTES = 1000, 8 << 20

#: How a vocabulary file's texts are cut. "words": white space is dropped by the tokenizer; "spaced": it belongs to what follows.
WORDS, SPACED = "words", "spaced"
_ENDS = r"(?=[.,!?;:*$%&#| \n]|\Z)"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORDS = re.compile(rf"[{_LETTERS}]+{_ENDS}|[^ \n]+")
_WORD = re.compile(rf"[{_LETTERS}]+")
_OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f]")
#: Bytes with which those characters begin.
_OTHER_FIRST = b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3"

#: Kinds of bytes in texts that ``spaced_cuts`` cuts; a text has the last one behind it, and nowhere in it.
_SPACE, _LETTER, _END, _LATIN, _STOP = range(1, 6)
BEHIND = b"\x1c"
_KINDS = bytearray(256)
for _kind, _bytes in ((_SPACE, b" \n"), (_LETTER, bytes([*range(65, 91), *range(97, 123)])), (_END, b".,!?;:*$%&#|"), (_LATIN, b"\xc3"), (_STOP, BEHIND)):
    for _byte in _bytes:
        _KINDS[_byte] = _kind
#: What follows 0xC3 in the signs for times and divided by; what else does makes a letter.
_TIMES, _DIVIDED = 0x97, 0xB7


def spaced_cuts(data: bytes) -> np.ndarray:
    """Where pieces of texts begin, and where the last one ends: before white space, and between a word after white space and a sign that ends words.

    Each text has ``BEHIND`` behind it, which is a piece of its own.
    """
    kind = np.frombuffer(data.translate(_KINDS), np.uint8)
    space, letter = kind == _SPACE, kind == _LETTER
    latin = np.flatnonzero(kind == _LATIN)
    follows = np.frombuffer(data, np.uint8)[latin + 1]
    latin = latin[(follows != _TIMES) & (follows != _DIVIDED)]
    letter[latin] = letter[latin + 1] = True
    cut = np.zeros(len(data) + 1, bool)
    cut[[0, -1]] = True
    cut[1:-1] = space[1:] & ~space[:-1]
    stops = np.flatnonzero(kind == _STOP)
    cut[stops] = cut[stops + 1] = True
    edges = np.flatnonzero(np.diff(letter, prepend=False))
    first, end = edges[::2], edges[1::2]  # of runs of letters, of which none reaches the last byte
    before = kind[first - 1]  # for a run at 0 that is the last byte's, a stop
    end = end[(before == _SPACE) | (before == _STOP)]
    cut[end[kind[end] == _END]] = True
    return np.flatnonzero(cut).astype(np.int32)


class Encoder:
    """Ids of texts as little-endian unsigned 16-bit (or 32-bit) bytes."""

    def __init__(self, path: str, cut: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.cut = cut
        self.memo: dict[str, bytes] = {}
        #: "spaced": the pieces remembered, of which the first is what stands behind a text, and their ids.
        self.units, self.ids = pa.array([BEHIND.decode()]), pa.array([b""], pa.binary())
        vocabulary = self.tokenizer.get_vocab()
        #: Of each id: the bytes of text it stands for (byte-level: a character of an entry is a byte), and whether it ends a word.
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.ends_word = np.zeros(len(self.n_bytes), bool)
        for entry, k in vocabulary.items():
            self.n_bytes[k] = len(entry)
            self.ends_word[k] = entry.endswith("</w>")

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _WORDS.findall(text)
        return _WORDS.findall(text.lower())

    def fresh(self, units: list[str]) -> dict[str, bytes]:
        """New pieces, encoded in runs: one call for many pieces, whose ids are then told apart."""
        runs: list[list[str]] = [[]]
        alone, size = [], 0
        for u in units:
            if not _WORD.fullmatch(u):  # its ids can't be told from its neighbours' in a run
                alone.append(u)
                continue
            runs[-1].append(u)
            size += len(u)
            if size > RUN_CHARS:
                runs.append([])
                size = 0
        out = dict(zip(alone, self.whole(alone), strict=True))
        step = self.dtype.itemsize
        for run, found in zip(runs, self.whole([" ".join(run) for run in runs]), strict=True):
            ids = np.frombuffer(found, self.dtype)
            ends = ((np.flatnonzero(self.ends_word[ids]) + 1) * step).tolist()
            for u, first, last in zip(run, [0, *ends], ends):
                out[u] = found[first:last]
        return out

    def fresh_spaced(self, units: pa.StringArray) -> pa.BinaryArray:
        """The ids of new pieces. Those that begin with white space and don't end with it are encoded in runs: their ids are told apart by the bytes they stand for."""
        starts, data = laid_out(units)
        space = np.frombuffer(data.translate(_KINDS), np.uint8) == _SPACE
        joins = space[starts[:-1]] & ~space[starts[1:] - 1] & (np.diff(starts) <= MEMO_CHARS)
        ends, data = laid_out(units.filter(pa.array(joins)))
        runs = np.unique(ends[np.searchsorted(ends, [*range(0, len(data), RUN_CHARS), len(data)])]).tolist()
        ids = np.frombuffer(b"".join(self.whole([data[a:b].decode() for a, b in zip(runs, runs[1:])])), self.dtype)
        upto = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends[1:]) + 1
        told = pa.Array.from_buffers(pa.binary(), len(upto), [None, pa.py_buffer((np.append(0, upto) * self.dtype.itemsize).astype(np.int32)), pa.py_buffer(ids)])
        alone = pa.array(self.whole(units.filter(pa.array(~joins)).to_pylist()), pa.binary())
        place = np.empty(len(units), np.int64)
        place[np.flatnonzero(joins)], place[np.flatnonzero(~joins)] = np.arange(len(told)), len(told) + np.arange(len(alone))
        return pa.concat_arrays([told, alone]).take(pa.array(place))

    def spaced(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts that ``spaced_cuts`` can cut."""
        data = b"".join([t + BEHIND for t in texts])
        cuts = spaced_cuts(data)
        pieces = pa.Array.from_buffers(pa.string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        before = len(self.units)
        found = pa.concat_arrays([self.units, pieces]).dictionary_encode()  # the remembered ones keep their places, new ones follow
        where = found.indices.slice(before)
        units, ids = found.dictionary, self.ids
        if len(units) > before:
            ids = pa.concat_arrays([ids, self.fresh_spaced(units.slice(before))])
        starts, joined = laid_out(ids.cast(pa.large_binary()).take(where))
        ends = starts[np.flatnonzero(where.to_numpy() == 0) + 1].tolist()
        stay = pc.less_equal(pc.binary_length(units), MEMO_CHARS).to_numpy(zero_copy_only=False)
        if np.count_nonzero(stay) > MEMO_PIECES:
            stay &= np.bincount(where.to_numpy(), minlength=len(units)) > 0
            stay[np.flatnonzero(stay)[MEMO_PIECES:]] = False
        self.units, self.ids = (units, ids) if stay.all() else (x.filter(pa.array(stay)) for x in (units, ids))
        return [joined[a:b] for a, b in zip([0, *ends], ends)]

    def encode_spaced(self, texts: list[str | None]) -> list[bytes]:
        raw = [t.encode() if t else b"" for t in texts]
        odd = [i for i, t in enumerate(raw) if len(t.translate(None, _OTHER_FIRST)) < len(t) and _OTHER_SPACE.search(texts[i])]
        alone = dict(zip(odd, self.whole([texts[i] for i in odd]), strict=True))
        out: list[bytes] = []
        group, size = [], 0
        for i, t in enumerate(raw):
            if group and (len(group) == SPACED_GROUP or size + len(t) > SPACED_BYTES):
                out += self.spaced(group)
                group, size = [], 0
            group.append(b"" if i in alone else t)
            size += len(group[-1])
        if group:
            out += self.spaced(group)
        return [alone.get(i, ids) for i, ids in enumerate(out)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if self.cut == SPACED:
            return self.encode_spaced(texts)
        out: list[bytes] = []
        for at in range(0, len(texts), GROUP):
            cuts = [self.pieces(t) if t else [] for t in texts[at : at + GROUP]]
            new = list(set().union(*cuts).difference(self.memo))
            if len(self.memo) + len(new) > MEMO_PIECES:
                self.memo.clear()
                new = list(set().union(*cuts))
            known = self.fresh(new)
            short = {k: v for k, v in known.items() if len(k) <= MEMO_CHARS}
            self.memo.update(short)
            if len(short) == len(known):
                out += [b"".join(map(self.memo.__getitem__, cut)) for cut in cuts]
            else:
                out += [b"".join([self.memo[p] if p in self.memo else known[p] for p in cut]) for cut in cuts]
        return out


def laid_out(values: pa.Array) -> tuple[np.ndarray, bytes]:
    """Where strings or binary values start in their bytes, and where the last one ends, and these bytes."""
    wide = pa.types.is_large_binary(values.type)
    _, starts, data = values.buffers()
    starts = np.frombuffer(starts, np.int64 if wide else np.int32, len(values) + 1, (8 if wide else 4) * values.offset) if len(values) else np.zeros(1, np.int64)
    first, last = int(starts[0]), int(starts[-1])
    return starts - first, bytes(memoryview(data)[first:last]) if last > first else b""


@cache
def encoder(path: str, cut: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return Encoder(path, cut)


def ids_of(data: bytes, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(data, dtype)


def wide(data: bytes, dtype: np.dtype, end_id: int) -> bytes:
    """The ids and then ``end_id`` as little-endian unsigned 32-bit integers."""
    return ids_of(data, dtype).astype("<u4").tobytes() + end_id.to_bytes(4, "little")
