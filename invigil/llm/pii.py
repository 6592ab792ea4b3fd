"""Personal data behind disguises, with spans in the original text.

Four kinds of identifier have a base pattern each.  Three transducers in a row then rewrite a
text: look-alike characters become the ones they imitate, runs of spelled digits become digits,
and disguised at and dot signs become signs.  Each keeps, for every piece it rewrites, where that
piece came from; what the patterns find in the rewritten text is mapped back through them to
code points of the source.  Spans found without rewriting always stay; a span found behind a
disguise is added where it overlaps none of its kind.

Every pattern is linear in the length of a text: runs are matched possessively, and an address is
looked for from its sign outwards.

Defined cases: a null or empty text has no spans; texts of any length are searched whole; a match
that fails its check (parts over 255, number of digits, Luhn) is dropped and not tried again.
Repeated rows have the same spans.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from invigil.llm.common import back, beside, slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]  # start, kind by its place, end: sorts as spans are listed

# -- base patterns -----------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            floor = domain.end()
            yield start, floor
        at = text.find("@", max(floor, at + 1))


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    doubled = (d * 2 - 9 if d > 4 else d * 2 for d in digits[-2::-2])
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def _is_ip(match: str) -> bool:
    return all(len(part := p.lstrip("0")) <= 3 and int(part or 0) <= 255 for p in match.split("."))


def _is_card(match: str) -> bool:
    digits = _digits(match)
    return 14 <= len(digits) <= 19 and luhn(digits)


def _is_phone(match: str) -> bool:
    return 10 <= len(_digits(match)) <= 15


_CHECKED: list[tuple[str, re.Pattern, Callable[[str], bool]]] = [
    ("ip", _IP, _is_ip),
    ("card", _CARD, _is_card),
    ("phone", _PHONE, _is_phone),
]


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start, then kind as listed."""
    found = [("email", *span) for span in emails(text)] if "@" in text else []
    for kind, pattern, valid in _CHECKED:
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(m.group())]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# -- transducers -------------------------------------------------------------------------

# Letters of other scripts that look like Latin ones.
_LOOK_ALIKE = dict(
    zip(
        "АВЕКМНОРСТУХаеорсухіјѕԁԛԝһⅼɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρυ",
        "ABEKMHOPCTYXaeopcyxijsdqwhlgABEZHIKMNOPTYXovpu",
    )
)
_INVISIBLE = dict.fromkeys("­​‌‍⁠﻿", "")

# The digits in words, in four languages.
_SPELLED = {
    word: str(digit)
    for language in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for digit, word in enumerate(language.split())
}
_NUMBER = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
_GAP = r"(?:\s(?:dot|punto|punkt|point)\s|[ ,\-]{1,2})"
_RUN_HINT = re.compile(rf"[\s(,:;.+\-]{_NUMBER}{_GAP}{_NUMBER}{_GAP}{_NUMBER}\b", re.I)
_RUN = re.compile(rf"\b{_NUMBER}(?:{_GAP}{_NUMBER})+\b", re.I)
_RUN_WORD = re.compile(rf"({_NUMBER})\b({_GAP})?", re.I)
_PLUS = re.compile(r"\bplus[ \-]?(?=[0-9])", re.I)

_AT, _DOT = "(?:at|arroba|arobase|@)", r"(?:dot|punto|punkt|point|\.)"
_BRACKETED = re.compile(rf"\s?[(\[{{<]\s?(?:({_AT})|{_DOT})\s?[)\]}}>]\s?", re.I)
_PART, _DOT_WORD = r"[A-Za-z0-9_%+-]++", r"\s{1,3}(?:dot|punto|punkt|point)\s{1,3}"
_SPACED_HINT = re.compile(rf"\s{_AT}\s+[A-Za-z0-9-]+(?:{_DOT_WORD}|\s?\.)", re.I)
_SPACED = re.compile(
    rf"(?<![A-Za-z0-9_%+-]){_PART}(?:(?:{_DOT_WORD}|\.){_PART})*+(\s{{1,3}}{_AT}\s{{1,3}})[A-Za-z0-9-]++((?:(?:{_DOT_WORD}|\s\.\s|\.)[A-Za-z0-9-]++)++)",
    re.I,
)
_SIGN = re.compile(rf"{_DOT_WORD}|\s\.\s", re.I)
_SPELLED_SIGN = re.compile(_DOT_WORD, re.I)

# Spelled dots behind an at sign of any style, and between the parts of an address in numbers.
_ANY_AT = rf"(?:@|\s?[(\[{{{{<]\s?{_AT}\s?[)\]}}}}>]\s?|(?<=[A-Za-z0-9])\s{{1,3}}@\s{{1,3}})"
_HOST_DOTS = re.compile(rf"{_ANY_AT}[A-Za-z0-9-]++((?:{_DOT_WORD}[A-Za-z0-9-]++)+)", re.I)
_NUMBER_DOTS = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:{_DOT_WORD}|\.)[0-9]{{1,3}}){{3}}(?![0-9.])", re.I)
_DOT_HINT = re.compile(rf"[A-Za-z0-9]{_DOT_WORD}[A-Za-z0-9]", re.I)
# Spelled digits between digits, however few.
_BETWEEN = re.compile(rf"(?<=[0-9])[ \-]{{1,2}}({_NUMBER}\b(?:{_GAP}{_NUMBER}\b)*)(?=[ \-]{{1,2}}[0-9])", re.I)

Edit = tuple[int, int, str]


@lru_cache(maxsize=4096)
def _imitated(char: str) -> str | None:
    """What a character outside ASCII stands for, or None."""
    if char in _LOOK_ALIKE:
        return _LOOK_ALIKE[char]
    if char in _INVISIBLE:
        return ""
    digit = unicodedata.decimal(char, None)
    if digit is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", char)
    return plain if len(plain) == 1 and plain.isascii() else None


def look_alikes(text: str) -> list[Edit]:
    if text.isascii():
        return []
    chars = "".join(c for c in set(text) if c > "\x7f" and _imitated(c) is not None)
    return [(m.start(), m.end(), _imitated(m.group())) for m in re.finditer(f"[{re.escape(chars)}]", text)] if chars else []


def spelled_digits(text: str) -> list[Edit]:
    """Digits for runs of three words or more, and for shorter ones between digits; the gaps inside a run go (a
    spelled dot becomes one), and ``plus`` before digits is a sign."""
    edits: list[Edit] = []
    taken: set[int] = set()
    if _RUN_HINT.search(text) or _RUN_HINT.search(" " + text[:64]):
        for run in _RUN.finditer(text):
            parts = list(_RUN_WORD.finditer(text, run.start(), run.end()))
            if len(parts) < 3:
                continue
            lead = re.search(r"\bplus[ \-]$", text[max(0, run.start() - 6) : run.start()], re.I)
            if lead:
                edits.append((run.start() - len(lead.group()), run.start(), "+"))
            taken.add(run.start())
            for m in parts:
                edits.append(_digit(m))
    if "+" in text or "lus" in text or "LUS" in text:
        for m in _BETWEEN.finditer(text):
            if m.start(1) not in taken:
                edits += [_digit(word) for word in _RUN_WORD.finditer(text, *m.span(1))]
        edits.sort()
    if "lus" in text or "LUS" in text:
        # These overlap no run's edits: digits follow the word here, spelled ones there.
        edits += [(m.start(), m.end(), "+") for m in _PLUS.finditer(text)]
        edits.sort()
    return edits


def _digit(word: re.Match) -> Edit:
    point = "." if len((word.group(2) or "").strip(" ,-")) > 1 else ""
    return word.start(), word.end(), _SPELLED[word.group(1).lower()] + point


def signs(text: str) -> list[Edit]:
    """Signs for bracketed words anywhere, for bare words where a whole address is spelled out, and for spelled dots
    behind an at sign of any style or between four numbers."""
    edits = [(m.start(), m.end(), "@" if m.group(1) else ".") for m in _BRACKETED.finditer(text)]
    if _SPACED_HINT.search(text):
        for m in _SPACED.finditer(text):
            # A bare word is a disguise only with a bare dot, too: "at example.com" is prose, and
            # so is a stop with spaces.
            sign = _SIGN if "@" in m.group(1) else _SPELLED_SIGN
            if "@" in m.group(1) or sign.search(m.group(2)):
                edits.append((m.start(1), m.end(1), "@"))
                for part in (m.span(2), (m.start(), m.start(1))):
                    edits += [(d.start(), d.end(), ".") for d in sign.finditer(text, *part)]
    if _DOT_HINT.search(text):
        for pattern, group in ((_HOST_DOTS, 1), (_NUMBER_DOTS, 0)):
            for m in pattern.finditer(text):
                edits += [(d.start(), d.end(), ".") for d in _SPELLED_SIGN.finditer(text, *m.span(group))]
    edits.sort()
    clear, end = [], 0
    for edit in edits:
        if edit[0] >= end:
            clear.append(edit)
            end = edit[1]
    return clear


class Rewritten:
    """A text after edits, and the way back."""

    def __init__(self, text: str, edits: list[Edit]):
        out, at, place = [], 0, 0
        self.starts, self.ends, self.sources = [], [], []
        for start, end, new in edits:
            out += [text[at:start], new]
            place += start - at
            if new:
                self.starts.append(place)
                self.ends.append(place + len(new))
                self.sources.append((start, end))
            place += len(new)
            at = end
            if not new:
                self.starts.append(place)
                self.ends.append(place)
                self.sources.append((start, end))
        out.append(text[at:])
        self.text = "".join(out)

    def _source(self, place: int) -> tuple[int, int]:
        """The source span of the character at ``place``."""
        i = bisect.bisect_right(self.starts, place) - 1
        if i < 0:
            return place, place + 1
        if place < self.ends[i]:
            return self.sources[i]
        at = self.sources[i][1] + place - self.ends[i]
        return at, at + 1

    def back(self, start: int, end: int) -> tuple[int, int]:
        return self._source(start)[0], self._source(end - 1)[1]


TRANSDUCERS = (look_alikes, spelled_digits, signs)


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base and added spans together, both in order."""
    if not text:
        return [], []
    base = detect(text)
    passes: list[Rewritten] = []
    current = text
    for transducer in TRANSDUCERS:
        edits = transducer(current)
        if edits:
            passes.append(Rewritten(current, edits))
            current = passes[-1].text
    if not passes:
        return base, base
    taken = {kind: sorted((s, e) for k, s, e in base if k == kind) for kind in KINDS}
    added = []
    for kind, start, end in detect(current):
        for rewritten in reversed(passes):
            start, end = rewritten.back(start, end)
        own = taken[kind]
        i = bisect.bisect_left(own, (start, end))
        if not any(s < end and start < e for s, e in own[max(0, i - 1) : i + 1]):
            own.insert(i, (start, end))
            added.append((kind, start, end))
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def listed(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span replaced by its kind; of overlapping ones the first names all."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    out.append(text[at:])
    return "".join(out)


# -- tables ------------------------------------------------------------------------------


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans per kind, their digest, and all spans."""
    narrow = docs.select("doc_id", "text")
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    kinds = [T.LongType()] * 4 + [T.StringType()] * 2 + [T.LongType()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for text in part.column("text").to_pylist():
                base, both = find(text)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(both), len(both) - len(base)))
            columns = [pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", *names])

    schema = T.StructType([narrow.schema["doc_id"], *[T.StructField(n, k) for n, k in zip(names, kinds)]])
    return narrow.mapInArrow(run, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans in ``text`` replaced by their kinds; all other columns as they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [t and redact(t, find(t)[1]) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    inner = beside(docs, "text")
    return back(inner.mapInArrow(run, inner.schema), docs.columns, text="text")
