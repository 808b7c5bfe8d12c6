"""SentencePiece encoding and decoding of whole texts by a streaming Viterbi search.

The search walks along a text and keeps, for each position, the last piece of the path that survives there. Only a window as
long as the longest piece can still be extended; whenever all paths of that window lead back to one boundary, the ids before it
are committed and forgotten, so memory doesn't grow with the text.

Which path survives depends on the vocabulary's kind. ``unigram``: the one with the greatest sum of scores. ``bpe``: merges
are local, so a segmentation is the merges' result exactly if each two neighbouring pieces are the merges' result for their
own text; of the pieces ending at a position the one that suits its predecessor in this sense survives. Both give the ids that
the library gives. Between two characters that no piece holds side by side all paths converge by themselves: texts are cut there,
and the ids of short parts are remembered in a table of bounded size.

Texts become pieces as the public model wants it: a leading space is added, spaces become U+2581, nothing else is normalised,
characters without a piece become the pieces of their UTF-8 bytes. Decoding undoes this; a U+2581 of the source comes back as a
space, as with the library.

Defined results: a null or empty text has no ids and decodes to an empty text; a null list of ids decodes to null. Strings that
look like control or byte pieces are ordinary text. Repeated rows give repeated results; an empty table gives none. All input columns are
kept; the column to add is named by the caller, with underscores behind it while the input has such a column (``common.unused``).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import in_small_batches, unused

BPE, UNIGRAM = "bpe", "unigram"
SPACE = "▁"
#: Parts of texts, and pairs of pieces, that a worker remembers at most, and the longest such part; a full table is emptied.
MEMO_PARTS, MEMO_PAIRS, MEMO_CHARS = 500_000, 1_000_000, 40
#: What the library takes off the least score for an unknown character.
UNKNOWN_PENALTY = 10.0
#: Positions after which the window is looked through for a common boundary, in lengths of the longest piece.
LOOK_EVERY = 4
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_UNKNOWN = -1


class Pieces:
    """A vocabulary, and the search over it."""

    def __init__(self, entries: list[tuple[str, float, str]], kind: str):
        """entries: by id, (piece, score, type), of which the types normal, byte and other matter."""
        self.kind = kind
        self.entries = entries
        self.ids = {p: i for i, (p, _, t) in enumerate(entries) if t == "normal"}
        self.scores = [s for _, s, _ in entries]
        self.bytes_ = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(entries) if t == "byte"}
        self.unknown = next((i for i, e in enumerate(entries) if e[2] == "unknown"), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.tails = {p[k:] for p in self.ids for k in range(len(p))}
        self.unknown_score = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.suits: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.parts = re.compile(self._cuts())

    def _cuts(self) -> str:
        """A pattern whose matches are parts that no piece reaches across."""
        pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        if any(a != SPACE and b == SPACE for a, b in pairs):
            return r"(?s:.+)"
        joined = set("".join(pairs))
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
        letter = re.compile(f"[{_LETTERS}]")
        after = {b for a, b in pairs if letter.match(a)}
        ends = "".join(re.escape(chr(c)) for c in range(33, 128) if chr(c) not in after and not letter.match(chr(c))) + alone + SPACE
        alone = alone or r"\x00"
        return rf"{SPACE}*[{_LETTERS}]+(?=[{ends}]|\Z)|[{alone}]+|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+"

    def merged(self, text: str) -> list[str]:
        """The merges themselves, for the text of a few pieces: the best-scoring pair first, the leftmost of equal ones."""
        parts = list(text)
        while True:
            best = None
            for k in range(len(parts) - 1):
                found = self.ids.get(parts[k] + parts[k + 1])
                if found is not None and (best is None or self.scores[found] > best[0]):
                    best = self.scores[found], k
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def follows(self, first: int, second: int) -> bool:
        """Whether the merges leave these two pieces as they are, side by side. ``first`` may be unknown."""
        key = (first + 1) * len(self.entries) + second
        known = self.suits.get(key)
        if known is None:
            if len(self.suits) >= MEMO_PAIRS:
                self.suits.clear()
            a, b = "" if first < 0 else self.entries[first][0], self.entries[second][0]
            known = self.suits[key] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def search(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, id) of each piece in order, as soon as it is certain; an unknown character's id is -1."""
        base, starts, last, total = 0, [0], [_UNKNOWN], [0.0]  # by position - base: what ends there
        look = LOOK_EVERY * self.longest
        id_of, tails, suits, n, unigram = self.ids.get, self.tails, self.suits.get, len(self.entries), self.kind == UNIGRAM
        for end in range(1, len(text) + 1):
            start, best, value = end - 1, None, None
            while start >= base and (piece := text[start:end]) in tails:
                found = id_of(piece)
                if found is not None:
                    before = start - base
                    if unigram:
                        if value is None or total[before] + self.scores[found] > value:
                            best, value = (start, found), total[before] + self.scores[found]
                    else:
                        fits = suits((last[before] + 1) * n + found)
                        if fits or fits is None and self.follows(last[before], found):
                            best = start, found
                start -= 1
            if best is None:
                best, value = (end - 1, _UNKNOWN), total[end - 1 - base] + self.unknown_score
            starts.append(best[0])
            last.append(best[1])
            total.append(value or 0.0)
            if end == len(text) or (end - base) % look == 0:
                ends = {end} if end == len(text) else set(range(max(base, end - self.longest + 1), end + 1))
                while len(ends) > 1:
                    top = max(ends)
                    ends.remove(top)
                    ends.add(starts[top - base])
                meet = ends.pop()
                path, at = [], meet
                while at > base:
                    path.append((starts[at - base], at, last[at - base]))
                    at = starts[at - base]
                yield from reversed(path)
                if meet > base:
                    cut = meet - base
                    starts, last = starts[cut:], last[cut:]
                    total = [x - total[cut] for x in total[cut:]]
                    base = meet

    def part_ids(self, part: str) -> bytes:
        out = array("I")
        for start, end, found in self.search(part):
            if found >= 0:
                out.append(found)
            elif self.bytes_:
                out.extend(self.bytes_[b] for b in part[start:end].encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unknown)
        return out.tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids as unsigned 32-bit integers."""
        if not text:
            return b""
        parts, memo = self.parts.findall(SPACE + text.replace(" ", SPACE)), self.memo
        try:
            return b"".join([memo[p] for p in parts])
        except KeyError:  # some parts are new, or too long to be remembered
            pass
        if len(memo) >= MEMO_PARTS:
            memo.clear()
        found = {p: self.part_ids(p) for p in set(parts).difference(memo)}
        memo.update((p, ids) for p, ids in found.items() if len(p) <= MEMO_CHARS)
        return b"".join([memo[p] if p in memo else found[p] for p in parts])

    @property
    def shown(self) -> list[bytes]:
        """By id: the bytes of text it stands for."""
        if not hasattr(self, "_shown"):
            texts = {"normal": lambda p: p.replace(SPACE, " ").encode(), "byte": lambda p: bytes([int(p[3:5], 16)]), "unknown": lambda p: " ⁇ ".encode()}
            self._shown = [texts.get(t, lambda p: b"")(p) for p, _, t in self.entries]
        return self._shown

    def decode(self, ids: bytes | None) -> str | None:
        if ids is None:
            return None
        raw = b"".join(map(self.shown.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@cache
def pieces_of(path: str, kind: str) -> Pieces:
    """The worker's vocabulary from a model file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)

    def kind_of(i: int) -> str:
        return "byte" if model.is_byte(i) else "unknown" if model.is_unknown(i) else "control" if model.is_control(i) or model.is_unused(i) else "normal"

    return Pieces([(model.id_to_piece(i), model.get_score(i), kind_of(i)) for i in range(model.get_piece_size())], kind)


def with_ids(df: DataFrame, model: str, kind: str = BPE, text_col: str = "text", to: str = "ids") -> DataFrame:
    """Adds each text's ids, as little-endian unsigned 32-bit integers in a binary column."""

    @F.pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = pieces_of(model, kind)
        for texts in batches:
            yield pd.Series([vocabulary.encode(t) for t in texts], dtype=object)

    return in_small_batches(df).withColumn(unused(df, to), encoded(F.col(f"`{text_col}`")))


def with_text(df: DataFrame, model: str, kind: str = BPE, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text that a column of ids stands for."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = pieces_of(model, kind)
        for column in batches:
            yield pd.Series([vocabulary.decode(x) for x in column], dtype=object)

    return in_small_batches(df).withColumn(unused(df, to), decoded(F.col(f"`{ids_col}`")))
