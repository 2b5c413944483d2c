"""Secrets in texts: patterns, and literals that are assigned to sensitive names.

Beside three base patterns a lexer reads assignments of source and configuration syntax: a name,
a sign (``=``, ``:``, ``:=`` or ``=>``) and a value of quoted literals, bare words and names joined by
``+``. Names of constants stand for their literals, also over several steps. A literal is scored
by the most sensitive name that it reaches, and by its own look.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstat.llm.batches import map_slices

# The base patterns, the least lengths, and the order of the kinds.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "literal")

#: One of these is in every text with a match of the first pattern.
_STEMS = ("password", "passwd", "secret", "token", "api")

#: Parts of names and how sensitive they are.
_PARTS = {
    "password": 4, "passwd": 4, "pwd": 4, "passphrase": 4, "secret": 4, "token": 4, "apikey": 4, "credential": 3,
    "credentials": 3, "auth": 2, "bearer": 3, "private": 2, "access": 1, "api": 2, "key": 2, "signature": 2, "salt": 2,
}
_NAMES = re.compile("|".join(_PARTS), re.IGNORECASE | re.ASCII)

#: Names whose literals may hold blanks.
_PHRASES = re.compile("password|passwd|pwd|passphrase", re.IGNORECASE | re.ASCII)

_SIGN = re.compile(r"[:=]+>?")
_NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-$")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>+]+(?:\+[^\s\"'`,;(){}\[\]<>+]+)*")
_QUOTED = {quote: re.compile(rf"{quote}((?:[^{quote}\\\n]|\\.)*){quote}") for quote in "\"'`"}
_JOIN = re.compile(r"[ \t]*\+[ \t]*")
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: What stands in place of a secret: anywhere in a literal, and as the whole of it or its beginning.
_PLACEHOLDER_WORD = re.compile("example|changeme|placeholder|dummy", re.IGNORECASE)
_PLACEHOLDER_WHOLE = re.compile(r"(?:x+|\*+|\.+|-+|_+|null|none|nil|true|false|undefined|string|todo)$|your|my_|<|\$|%", re.IGNORECASE)

SPANS = "id BIGINT, spans ARRAY<STRUCT<kind: STRING, start: BIGINT, end: BIGINT, name: STRING, score: DOUBLE>>"


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each base pattern that are long enough."""
    low = text.lower()
    if any(stem in low for stem in _STEMS):
        for match in _ASSIGN.finditer(text):
            if match.end(2) - match.start(2) >= _ASSIGN_LEAST:
                yield "assign", match.start(), match.end()
    if "AKIA" in text:
        for match in _ACCESS.finditer(text):
            yield "access", match.start(), match.end()
    for match in _HEX.finditer(text):
        yield "hex", match.start(), match.end()


def _name_before(text: str, at: int) -> str:
    """The name that ends before ``at``, quotes and blanks left out; empty if there is none."""
    while at > 0 and text[at - 1] in " \t":
        at -= 1
    if at > 0 and text[at - 1] in "\"'":
        at -= 1
    end = at
    while at > 0 and text[at - 1] in _NAME_CHARS:
        at -= 1
    name = text[at:end].strip(".-$")
    return name if name and not name[0].isdigit() else ""


class Values:
    """The values in a text as chains of parts; a part is read once, whatever number of signs stand before it.

    ``parts`` holds ``kind, start, end, next``: ``quoted`` or ``bare``, what is inside, and the number of the part joined to it
    by ``+``, or None. A value that begins inside a bare run ends with the run, as one that begins before it.
    """

    def __init__(self, text: str):
        self.text = text
        self.parts: list[tuple[str, int, int, int | None]] = []
        self._at: dict[int, int] = {}
        self._run = (0, 0)
        self._joined: dict[int, int] = {}

    def _part(self, at: int) -> tuple[str, int, int, int] | None:
        """Kind, start and end of the part at a place, and where it ends with its quotes."""
        quote = _QUOTED.get(self.text[at])
        if quote:
            match = quote.match(self.text, at)
            return ("quoted", match.start(1), match.end(1), match.end()) if match else None
        if not self._run[0] <= at < self._run[1]:
            match = _BARE.match(self.text, at)
            if not match:
                return None
            self._run = match.span()
        elif self.text[at] == "+":
            return None
        return "bare", at, self._run[1], self._run[1]

    def _after_join(self, end: int) -> int:
        """The place after a ``+`` that follows ``end``, or 0."""
        if end not in self._joined:
            joined = _JOIN.match(self.text, end)
            self._joined[end] = joined.end() if joined else 0
        return self._joined[end]

    def first(self, at: int) -> int | None:
        """The number of the first part of the value at a place."""
        while at < len(self.text) and self.text[at] in " \t":
            at += 1
        chain, rest = [], None
        while at < len(self.text):
            if at in self._at:
                rest = self._at[at]
                break
            part = self._part(at)
            if part is None:
                break
            chain.append((at, part))
            at = self._after_join(part[3])
            if not at:
                break
        for at, (kind, start, end, _) in reversed(chain):
            self.parts.append((kind, start, end, rest))
            rest = self._at[at] = len(self.parts) - 1
        return rest


def assignments(text: str, values: Values) -> Iterator[tuple[str, int]]:
    """Names with the number of the first part of the value assigned to them, in the order of the text."""
    for sign in _SIGN.finditer(text):
        if sign[0] not in ("=", ":", ":=", "=>") or (sign.start() and text[sign.start() - 1] in "!<>"):
            continue
        name = _name_before(text, sign.start())
        if name:
            first = values.first(sign.end())
            if first is not None:
                yield name, first


def name_score(name: str) -> int:
    """How sensitive a name is: the sum over its parts, whether in snake or in camel case."""
    parts = {part.lower() for part in _PIECE.findall(name)}
    joined = name.lower().replace("_", "").replace("-", "")
    return max(sum(_PARTS.get(part, 0) for part in parts), 4 if joined.endswith(("apikey", "password", "secret", "token")) else 0)


def _blank(literal: str) -> bool:
    return any(char.isspace() for char in literal)


def literal_score(literal: str, phrase: bool = False) -> float:
    """How much a literal looks like a secret: length, entropy, mixture; placeholders far below zero.

    So are literals with blanks, unless they may be a ``phrase``: then the blanks do not count.
    """
    placeholder = _PLACEHOLDER_WHOLE.match(literal) or _PLACEHOLDER_WORD.search(literal)
    if phrase:
        literal = "".join(literal.split())
    if placeholder or len(literal) < 6 or _blank(literal):
        return -10.0
    spread = sum(n * math.log2(n) for n in Counter(literal).values())
    digits, letters = any(char.isdigit() for char in literal), any(char.isalpha() for char in literal)
    return _look(len(literal), spread, digits, letters, literal.isalpha() and literal.islower())


def _look(size: int, spread: float, digits: bool, letters: bool, plain: bool) -> float:
    """The score of a literal's size, the sum of ``n * log2(n)`` over its characters' counts, and what it is made of."""
    entropy = math.log2(size) - spread / size
    return min(entropy, 4.0) / 2 + (size >= 8) + (size >= 16) + (digits and letters) - plain


def _ending_scores(text: str, starts: list[int], end: int) -> dict[int, float]:
    """:func:`literal_score` of ``text[start:end]`` for all ``starts``, in one sweep; for literals without blanks."""
    low = min(starts)
    word = max((match.start() for match in _PLACEHOLDER_WORD.finditer(text, low, end)), default=-1)
    counts: Counter[str] = Counter()
    spread, digits, letters, other, cased, upper = 0.0, False, False, False, False, False
    wanted, found = set(starts), {}
    for at in range(end - 1, low - 1, -1):
        char = text[at]
        n = counts[char]
        counts[char] = n + 1
        spread += (n + 1) * math.log2(n + 1) - (n * math.log2(n) if n else 0.0)
        digits, letters, other = digits or char.isdigit(), letters or char.isalpha(), other or not char.isalpha()
        cased, upper = cased or char.islower(), upper or char.isupper() or char.istitle()
        if at in wanted:
            if word >= at or _PLACEHOLDER_WHOLE.match(text, at, end) or end - at < 6:
                found[at] = -10.0
            else:
                found[at] = _look(end - at, spread, digits, letters, not other and cased and not upper)
    return found


def literal_spans(text: str, least: float) -> Iterator[tuple[str, int, int, str, float]]:
    """Literals that reach a sensitive name with a score of at least ``least``; each once, for its best name.

    Takes time in proportion to the text: parts, tails of joined parts and runs that several signs share are read once. A part that
    names a constant stands for what it was when the part was first read.
    """
    if ("=" not in text and ":" not in text) or not _NAMES.search(text):
        return
    values = Values(text)
    # Each assignment makes a version of its name.
    latest: dict[str, int] = {}
    versions: list[tuple[str, int]] = []
    stands_for: dict[int, int | None] = {}
    longest = 0
    for name, first in assignments(text, values):
        part: int | None = first
        while part is not None and part not in stands_for:
            kind, start, end, after = values.parts[part]
            known = kind == "bare" and end - start <= longest
            stands_for[part] = latest.get(text[start:end]) if known else None
            part = after
        longest = max(longest, len(name))
        latest[name] = len(versions)
        versions.append((name, first))
    endings: dict[int, list[int]] = {}
    for kind, start, end, _ in values.parts:
        if kind == "bare":
            endings.setdefault(end, []).append(start)
    swept: dict[int, dict[int, float]] = {}

    def look(kind: str, start: int, end: int, phrase: bool) -> float | None:
        if kind == "bare" and len(endings[end]) > 1:
            if phrase:  # no blanks in a bare run
                return None
            if end not in swept:
                swept[end] = _ending_scores(text, endings[end], end)
            return swept[end][start]
        literal = text[start:end]
        return literal_score(literal, phrase) if _blank(literal) == phrase else None

    sensitive = [(name_score(name), -i) for i, (name, _) in enumerate(versions)]
    sensitive = sorted((pair for pair in sensitive if pair[0] > 0), reverse=True)
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for phrase in (False, True):
        seen: set[int] = set()
        # From the most sensitive names on, so that each part is looked at once; phrases by names for them only.
        for weight, at in sensitive:
            if phrase and not _PHRASES.search(versions[-at][0]):
                continue
            ahead = [versions[-at][1]]
            while ahead:
                part = ahead.pop()
                if part in seen:
                    continue
                seen.add(part)
                kind, start, end, after = values.parts[part]
                if after is not None:
                    ahead.append(after)
                if stands_for[part] is not None:
                    ahead.append(versions[stands_for[part]][1])
                    continue
                own = look(kind, start, end, phrase)
                if own is not None and weight + own >= least:
                    best.setdefault((start, end), (weight + own, versions[-at][0]))
    for (start, end), (score, name) in best.items():
        yield "literal", start, end, name, score


def secret_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = 6.0) -> DataFrame:
    """``id`` and ``spans`` of each row: kind, start and end (code points, end exclusive), name and score.

    Spans are in the order of start, then kind as in ``KINDS``; base patterns have no name and a score of 0.
    Kinds may overlap each other. A null or empty text has no spans. A name that is assigned twice stands for its latest
    literal. Repeated rows come back as often as they are, a null id stays null. Very long
    texts are read whole. An empty table gives an empty result; other columns are ignored.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for whole in batch.column(1).to_pylist():
            spans = []
            if whole:
                spans = [(*span, None, 0.0) for span in base_spans(whole)]
                spans += literal_spans(whole, least)
                spans.sort(key=lambda span: (span[1], KINDS.index(span[0]), span[2]))
            found.append([dict(zip(("kind", "start", "end", "name", "score"), span, strict=True)) for span in spans])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["id", "spans"])

    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return map_slices(rows, work, SPANS, ["text"]).withColumnRenamed("id", id)


def spelled(spans: str | Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
