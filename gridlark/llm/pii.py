"""Personal data: plain patterns plus offset-preserving deobfuscation.

Two readings of every text:

* *base*: e-mail addresses, IPv4 addresses, card numbers and phone numbers as they stand, by four fixed patterns. Each
  is found by a scan that is linear in the text, also where the pattern itself would backtrack.
* *deobfuscated*: a cascade of transducers rewrites homoglyphs, spelled-out digits and disguised at and dot signs;
  the same finders read the result, and every span is mapped back through the cascade to the source's code points.
  A span that the base reading has, or that lies inside one of the same kind, isn't repeated.

A bare `` at `` counts as a disguise only in ``name at host dot tld``. The cascade rewrites spelled digits in runs of seven or more
only; shorter ones, and those mixed with groups of digits, spoken dots and brackets, are candidates on their own (``mixed_spans``): a span
is added only where the finder of cards, phones or addresses accepts what such a run says, so prose stays as it is.

Every pattern and scan takes time in proportion to the text, whatever runs of blanks, dots, digits or signs it holds.

Defined results: null text is empty, without spans. Repeated rows give repeated results; an empty table gives none. All input columns
are kept; findings come in one struct under the caller's name, behind which underscores come while the input has such a column
(``common.unused``). ``with_redaction`` replaces a column that exists, if the caller names it.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import in_small_batches, unused

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        host = DOMAIN.match(text, at + 1)
        if host:
            start = at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield "email", start, host.end()
                free = host.end()
        at = text.find("@", max(at + 1, free))


def ips(text: str) -> Iterator[Span]:
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 3 or len(p) == 3 and p <= "255" for part in m[0].split(".")):
            yield "ip", *m.span()


def luhn(digits: str) -> bool:
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            yield "card", *m.span()


def phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        if 8 <= len(DIGIT.findall(m[0])) <= 15:
            yield "phone", *m.span()


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by kind and start."""
    out = list(emails(text)) if "@" in text else []
    if DIGIT.search(text):
        out += [*ips(text), *cards(text)]
        if "+" in text:
            out += phones(text)
    return out


# Case is that of ASCII letters in all patterns below: others that fold to them aren't letters of a digit's name.
# Transducers: each rewrites some spans of its input and knows where every output position came from.


class Rewrite:
    """A text with spans replaced, and the way back from positions in the result."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, at, shift = [], 0, 0
        self.outs: list[tuple[int, int]] = []
        self.ins: list[tuple[int, int]] = []
        for start, end, put in edits:
            parts += [text[at:start], put]
            self.ins.append((start, end))
            self.outs.append((start + shift, start + shift + len(put)))
            shift += len(put) - (end - start)
            at = end
        self.text = "".join([*parts, text[at:]])
        self.starts = [a for a, _ in self.outs]

    def back(self, start: int, end: int) -> tuple[int, int]:
        return self._back(start, False), self._back(end, True)

    def _back(self, at: int, is_end: bool) -> int:
        k = bisect_right(self.starts, at - 1 if is_end else at) - 1
        if k < 0:
            return at
        (out_a, out_b), (in_a, in_b) = self.outs[k], self.ins[k]
        if at < out_b or is_end and at == out_b:
            return in_b if is_end else in_a
        return at - out_b + in_b


#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-",
}
#: Characters without width, which are left out.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Full-width forms, letter-like and mathematical ones and other digits, which are replaced by what NFKC makes of them.
COMPATIBLE = "！-～①-⑨⁰-₉\U0001d400-\U0001d7ff"
ODD = re.compile(f"[{''.join(HOMOGLYPHS)}{INVISIBLE}{COMPATIBLE}]")

DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
SPELLED_LEAST = 7
_WORD = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|[0-9])"
SPELLED = re.compile(rf"(?:\bplus[ -])?\b{_WORD}(?:[ ,.-]{{1,2}}{_WORD}){{{SPELLED_LEAST - 1},}}\b", re.I | re.A)
SPELLED_PART = re.compile(r"plus[ -]|[a-z]+|[ ,.-]+", re.I | re.A)

#: A digit word or a group of digits; runs of them with separators, brackets and spoken dots; what an address can be among them.
_TOKEN = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|[0-9]++)(?![A-Za-z0-9_])"
MIXED = re.compile(rf"(?:(?<![0-9][ ])\bplus[ -]\(?|\+)?(?<![A-Za-z0-9_]){_TOKEN}(?:(?:[ ,.()-]{{1,3}}|[ \t]++dot[ \t]++){_TOKEN})*+", re.I | re.A)
MIXED_PART = re.compile(r"[ \t]+dot[ \t]+|plus[ -]|[a-z]+|[ ,.()-]+", re.I | re.A)
_OCTET = rf"{_TOKEN}(?:[ -]{_TOKEN}){{0,2}}"
MIXED_IP = re.compile(rf"(?<![A-Za-z0-9_]){_OCTET}(?:(?:[ \t]{{1,9}}dot[ \t]{{1,9}}|\.){_OCTET}){{3}}", re.I | re.A)
IP_PART = re.compile(r"dot|\.|[a-z]+|[0-9]+", re.I | re.A)
LETTER = re.compile("[A-Za-z]")

#: What every run with a spelled digit, a spoken dot between digits or a spoken plus has in lower case. Each begins with few characters, so that most
#: texts are passed over quickly.
_SAID = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_BETWEEN = r"(?:[ ,.()-]{1,3}|[ \t]+dot[ \t]+)"
SPOKEN_DIGITS = tuple(re.compile(p) for p in (rf"[^A-Za-z0-9_]{_SAID}{_BETWEEN}(?:{_SAID}|[0-9])", rf"[0-9](?:{_BETWEEN}{_SAID}|[ \t]+dot[ \t]+[0-9])", rf"plus[ -]\(?(?:{_SAID}|[0-9])"))

_HOST = r"[A-Za-z0-9-]+"
WRAPPED = re.compile(r"[(\[{<][ \t]*+(at|@|dot|\.)[ \t]*+[)\]}>][ \t]*+", re.I | re.A)
SPOKEN = re.compile(rf"(?<=[A-Za-z0-9._%+-])([ \t]+at[ \t]+){_HOST}(?:(?:[ \t]+dot[ \t]+|\.){_HOST})*[ \t]+dot[ \t]+{_HOST}", re.I | re.A)
DOTS = re.compile(r"[ \t]+dot[ \t]+", re.I | re.A)
DOT_AFTER = re.compile(rf"(?<=@)({_HOST})((?:[ \t]+dot[ \t]+{_HOST})+)", re.I | re.A)
DOT_DIGITS = re.compile(r"(?<=[0-9])[ \t]+dot[ \t]+(?=[0-9])", re.I | re.A)


def says_digits(text: str) -> bool:
    """Whether the text may have a run that ``SPELLED`` or ``MIXED`` makes something of."""
    plain = " " + text.lower()
    return any(p.search(plain) for p in SPOKEN_DIGITS)


def homoglyphs(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in ODD.finditer(text):
        put = HOMOGLYPHS.get(m[0])
        if put is None:
            put = "" if m[0] in INVISIBLE else unicodedata.normalize("NFKC", m[0])
        if put.isascii():
            out.append((*m.span(), put))
    return out


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for run in SPELLED.finditer(text):
        if not any(c.isalpha() for c in run[0]):
            continue
        for m in SPELLED_PART.finditer(text, *run.span()):
            word = m[0].lower()
            put = "+" if word[0] == "p" else DIGIT_WORDS.get(word) if word[0].isalpha() else "-" if word[0] not in " ." or len(word) > 1 else word
            if put is not None and put != m[0]:
                out.append((*m.span(), put))
    return out


def signs(text: str) -> list[tuple[int, int, str]]:
    found: list[tuple[int, int, str]] = []
    for m in WRAPPED.finditer(text):
        start, least = m.start(), found[-1][1] if found else 0
        while start > least and text[start - 1] in " \t":  # blanks before the bracket; from the bracket back, so that each is met once
            start -= 1
        found.append((start, m.end(), "@" if m[1].lower() in ("at", "@") else "."))
    for m in SPOKEN.finditer(text):
        found.append((*m.span(1), "@"))
        found += [(*d.span(), ".") for d in DOTS.finditer(text, m.end(1), m.end())]
    found += [(*d.span(), ".") for m in DOT_AFTER.finditer(text) for d in DOTS.finditer(text, *m.span(2))]
    found += [(*m.span(), ".") for m in DOT_DIGITS.finditer(text)]
    out: list[tuple[int, int, str]] = []
    for edit in sorted(found):
        if not out or edit[0] >= out[-1][1]:
            out.append(edit)
    return out


def later_dots(text: str) -> list[tuple[int, int, str]]:
    """Spoken dots behind an at sign that an earlier transducer made."""
    return [(*d.span(), ".") for m in DOT_AFTER.finditer(text) for d in DOTS.finditer(text, *m.span(2))]


CASCADE = (homoglyphs, spelled_digits, signs, later_dots)


def mixed_ip(text: str, start: int, end: int) -> Iterator[Span]:
    """The address that text[start:end], a match of MIXED_IP, says. Digits too many at its ends aren't part of it."""
    parts: list[list[tuple[int, int, str]]] = [[]]
    for m in IP_PART.finditer(text, start, end):
        if m[0].lower() in ("dot", "."):
            parts.append([])
        else:
            parts[-1].append((*m.span(), DIGIT_WORDS.get(m[0].lower(), m[0])))

    def said(part: list[tuple[int, int, str]]) -> str:
        return "".join(d for _, _, d in part)

    for part, at in ((parts[0], 0), (parts[-1], -1)):
        while len(part) > 1 and len(list(ips(f"0.0.0.{said(part)}"))) == 0:
            del part[at]
    if any(ips(".".join(map(said, parts)))):
        yield "ip", parts[0][0][0], parts[-1][-1][1]


def mixed_spans(text: str) -> Iterator[Span]:
    """Cards, phones and addresses with some digits or dots spelled out."""
    for run in MIXED.finditer(text):
        if len(run[0]) < 8 or not LETTER.search(run[0]):
            continue
        edits = []
        for m in MIXED_PART.finditer(run[0]):
            word = m[0].lower()
            put = "." if "dot" in word else "+" if word[0] == "p" else DIGIT_WORDS[word] if word[0].isalpha() else m[0] if m[0] in " .-" or "(" in word or ")" in word else "-"
            if put != m[0]:
                edits.append((*m.span(), put))
        step = Rewrite(run[0], edits)
        for kind, start, end in (*cards(step.text), *phones(step.text)):
            a, b = step.back(start, end)
            if LETTER.search(run[0], a, b):
                yield kind, run.start() + a, run.start() + b
        for m in MIXED_IP.finditer(text, *run.span()):
            for kind, a, b in mixed_ip(text, *m.span()):
                if LETTER.search(text, a, b):
                    yield kind, a, b


def hidden_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the deobfuscated reading finds, in the source's code points."""
    seen, steps, found = text, [], []

    def add(spans: Iterator[Span] | list[Span]) -> None:
        for kind, start, end in spans:
            for step in reversed(steps):
                start, end = step.back(start, end)
            found.append((kind, start, end))

    spoken = False
    for transducer in CASCADE:
        if (transducer is not spelled_digits or spoken) and (edits := transducer(seen)):
            steps.append(Rewrite(seen, edits))
            seen = steps[-1].text
        if transducer is homoglyphs and (spoken := says_digits(seen)):
            add(mixed_spans(seen))
    if steps:
        add(base_spans(seen))
    out: list[Span] = []
    ends: dict[str, int] = {}
    known = set(base)
    for span in sorted({*base, *found}, key=lambda s: (s[1], -s[2])):  # what lies inside an earlier one of its kind isn't repeated
        if span[2] > ends.get(span[0], -1):
            ends[span[0]] = span[2]
            if span not in known:
                out.append(span)
    return out


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each by kind as in KINDS, then by start."""
    base = base_spans(text or "")
    more = hidden_spans(text, base) if text else []
    return base, sorted({*base, *more}, key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if more else base


def shown(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span, or union of overlapping spans, replaced by its kind in angle brackets."""
    if not text or not spans:
        return text
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def with_findings(df: DataFrame, text_col: str = "text", to: str = "pii") -> DataFrame:
    """Adds a struct (named as ``unused`` says): base counts by kind, digest of the base spans, and all spans as ``kind:start:end`` joined by commas."""

    @F.arrow_udf(FOUND)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for text in texts.to_pylist():
                base, spans = find(text)
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans)))
            types = [pa.int64()] * len(KINDS) + [pa.string()] * 2
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])

    return in_small_batches(df).withColumn(unused(df, to), found(F.col(f"`{text_col}`")))


def with_redaction(df: DataFrame, text_col: str = "text", to: str = "text") -> DataFrame:
    """Replaces (or adds) a column holding the text with all findings masked."""

    @F.arrow_udf("string")
    def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([redacted(t, find(t)[1]) for t in texts.to_pylist()], pa.string())

    return in_small_batches(df).withColumn(to, masked(F.col(f"`{text_col}`")))
