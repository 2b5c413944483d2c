"""Benchmark passages in documents, by the q-gram lemma.

Texts are compared as letters and digits in lower case with single blanks between words.
An item of m characters with at most e edits in a text shares at least m - q + 1 - e*q of its
q-grams with it, and those lie on at most e + 1 neighbouring diagonals (place in the text
less place in the item). So q-grams shared on each diagonal band are counted, bands overlap
by e, and only bands that reach the bound are aligned, by a banded edit distance. Nothing is
lost: the bound is necessary.

Items too short for their edits have shorter grams, and items of fewer than ``Q`` characters are looked for as whole words, their
length being that of the gram. Grams that an item repeats often are not counted where the others suffice, the bound being lower by
their number. Where they don't, as in rows of one sign, the places of the text whose gram the item has are counted in sliding windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstat.llm.batches import free_names, map_slices
from rillstat.session import new_folder

#: Characters of a gram.
Q = 12

#: Edits allowed per character of an item.
RATE = 0.05

#: Benchmark characters that are searched for in one pass over the documents.
BLOCK_CHARS = 4_000_000

#: A gram counts on diagonals if its item has it at most so often.
REPEATS = 8

#: Pairs of a place in a text and an entry of the index that are listed at a time.
LISTED = 4_000_000

MATCH = "doc_id BIGINT, item_id BIGINT, start BIGINT, end BIGINT, edits BIGINT"


def _alphabet() -> np.ndarray:
    """For each code point of the basic plane its lower-case letter or digit, or a blank."""
    table = np.full(0x10000, 32, dtype=np.uint32)
    for i in range(0x10000):
        char = chr(i)
        if char.isalnum():
            low = char.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


class Normaliser:
    """Texts to code points of letters, digits and single blanks, with each one's place in its text."""

    def __init__(self):
        self.alphabet = _alphabet()

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All characters, their places, and the rows' ``n + 1`` offsets; each row begins with a blank."""
        joined = "".join(" " + (text or "") for text in texts)
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        length = np.array([len(text or "") + 1 for text in texts], dtype=np.int64)
        edges = np.concatenate([[0], np.cumsum(length)])
        out = raw.copy()
        plane = raw < 0x10000
        out[plane] = self.alphabet[raw[plane]]
        keep = np.ones(len(out), dtype=bool)
        blank = out == 32
        keep[1:] = ~(blank[1:] & blank[:-1])
        keep[edges[:-1]] = True
        at = np.flatnonzero(keep)
        return out[at], at - np.repeat(edges[:-1] + 1, np.diff(np.searchsorted(at, edges))), np.searchsorted(at, edges)


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit polynomial hash of the ``q`` characters from each place on, put together from halves."""
    if len(chars) < q:
        return np.zeros(0, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15
    power, size = chars.astype(np.uint64), 1
    out, made = None, 0
    while True:
        if q & size:
            out = power if out is None else out[:len(power) - made] * np.uint64(pow(base, size, 1 << 64)) + power[made:][:len(out)]
            made += size
        if made == q:
            return out[:len(chars) - q + 1]
        power = power[:-size] * np.uint64(pow(base, size, 1 << 64)) + power[size:]
        size *= 2


def gram_size(length: int, q: int, rate: float) -> int:
    """The length of the grams of an item: ``q``, or less where all ``int(rate * length)`` edits could spoil every gram."""
    return min(q, length // (int(rate * length) + 1))


def edit_distance(pattern: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """Fewest edits that turn ``pattern`` into a part of ``text``, and that part's start and end; None above ``most``.

    The cells of a row are within a band: the text is as long as the band is wide beside the
    pattern, so place j - i runs over the band only.
    """
    m, n = len(pattern), len(text)
    width = n - m + 2 * most + 1  # places j = i + k - most, k in 0..width-1
    if width <= 0:
        return None
    far = m + n + 1
    shift = np.arange(width)
    column = shift - most
    cost = np.where((column >= 0) & (column <= n), 0, far)
    start = np.clip(column, 0, n)
    for i in range(1, m + 1):
        j = column + i
        inside = (j >= 0) & (j <= n)
        char = text[np.clip(j - 1, 0, max(n - 1, 0))] if n else np.zeros(width)
        differs = np.where((j >= 1) & (char == pattern[i - 1]), 0, 1)
        down = np.append(cost[1:], far) + 1
        diagonal = np.where(j >= 1, cost + differs, far)
        best = np.where(diagonal <= down, diagonal, down)
        begin = np.where(diagonal <= down, start, np.append(start[1:], 0))
        best = np.where(inside, best, far)
        # Gaps in the pattern: the least of best[k'] + k - k' for k' <= k.
        level = np.minimum.accumulate((best - shift) * np.int64(width) + shift[::-1])
        source = width - 1 - level % width
        cost = best[source] + shift - source
        begin = begin[source]
        cost = np.where(inside, cost, far)
        start = begin
        if cost.min() > most:
            return None
    end = int(np.argmin(cost))
    if cost[end] > most:
        return None
    return int(cost[end]), int(start[end]), int(column[end] + m)


def occurrence(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int, int] | None:
    """The first place where ``pattern`` stands unchanged in ``text``, as :func:`edit_distance` gives it."""
    whole, part, at = text.tobytes(), pattern.tobytes(), -1
    while (at := whole.find(part, at + 1)) >= 0:
        if at % text.itemsize == 0:
            return 0, at // text.itemsize, at // text.itemsize + len(pattern)
    return None


@dataclass
class Index:
    """Items with grams of one length: sorted hashes with item and place, and the items themselves.

    ``needed`` is the number of counted grams that a match shares. ``often`` has the grams of the items that are not counted on
    diagonals: their sorted hashes, and ``needed_often`` of their places.
    """

    q: int
    ids: list[int]
    chars: list[np.ndarray]
    padded: bool
    edits: np.ndarray
    needed: np.ndarray
    hashes: np.ndarray
    items: np.ndarray
    places: np.ndarray
    often: dict[int, np.ndarray]
    needed_often: dict[int, int]


def index_items(items: list[tuple[int, str]], q: int, rate: float) -> list[Index]:
    """The searchable form of ``(id, text)`` items, by the length of their grams; items without letters and digits are left out."""
    normal = Normaliser()
    sizes: dict[tuple[int, bool], list[tuple[int, np.ndarray]]] = {}
    for number, text in items:
        chars, _, _ = normal([text])
        chars = chars[1:]
        if len(chars) and chars[-1] == 32:
            chars = chars[:-1]
        if not len(chars):
            continue
        short = len(chars) < q
        if short:  # with the blanks of its borders, as one gram
            chars = np.concatenate([[32], chars, [32]]).astype(chars.dtype)
        sizes.setdefault((len(chars) if short else gram_size(len(chars), q, rate), short), []).append((number, chars))
    return [_index(kept, size, 0.0 if short else rate, short) for (size, short), kept in sorted(sizes.items())]


def _index(kept: list[tuple[int, np.ndarray]], q: int, rate: float, padded: bool) -> Index:
    hashes, owner, places = [], [], []
    edits = np.array([int(rate * len(chars)) for _, chars in kept], dtype=np.int64)
    needed = np.array([len(chars) for _, chars in kept], dtype=np.int64) - q + 1 - edits * q
    often: dict[int, np.ndarray] = {}
    needed_often: dict[int, int] = {}
    for number, (_, chars) in enumerate(kept):
        own = grams(chars, q)
        _, which, count = np.unique(own, return_inverse=True, return_counts=True)
        rare = np.flatnonzero(count[which] <= REPEATS)
        if needed[number] - (len(own) - len(rare)) < 1:
            often[number], needed_often[number] = np.unique(own), int(needed[number])
            continue
        needed[number] -= len(own) - len(rare)
        hashes.append(own[rare])
        owner.append(np.full(len(rare), number))
        places.append(rare)
    joined = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    order = np.argsort(joined, kind="stable")
    flat = [np.concatenate(x)[order] if x else np.zeros(0, dtype=np.int64) for x in (owner, places)]
    return Index(q, [number for number, _ in kept], [chars for _, chars in kept], padded, edits, needed, joined[order], *flat, often, needed_often)


class Searcher:
    """Finds items in batches of texts; made once per worker."""

    def __init__(self, indexes: list[Index]):
        self.indexes = indexes
        self.normal = Normaliser()
        self.some = []
        for index in indexes:
            some = np.zeros(1 << 22, dtype=bool)
            some[index.hashes >> np.uint64(42)] = True
            self.some.append(some)

    def _hits(self, index: Index, some: np.ndarray, found: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places whose gram is in the index, with their row and first and last entry, in rows with enough of them."""
        at = np.flatnonzero(some[found >> np.uint64(42)])
        low = np.searchsorted(index.hashes, found[at], side="left")
        high = np.searchsorted(index.hashes, found[at], side="right")
        row = np.searchsorted(bounds, at, side="right") - 1
        good = (high > low) & (at + index.q <= bounds[row + 1])
        at, low, high, row = at[good], low[good], high[good], row[good]
        plain = np.delete(index.needed, list(index.often))
        enough = np.bincount(row, minlength=len(bounds) - 1) >= (plain.min() if len(plain) else 1)
        return tuple(x[enough[row]] for x in (at, low, high, row))

    @staticmethod
    def _listed(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and entries pair by pair, so many at a time."""
        ends = np.cumsum(high - low)
        first = 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + LISTED, side="right")))
            count = (high - low)[first:last]
            start = np.repeat(low[first:last] - np.cumsum(count) + count, count)
            yield np.repeat(at[first:last], count), np.arange(count.sum()) + start
            first = last

    def _pairs(self, index: Index, at: np.ndarray, low: np.ndarray, high: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a place and an entry, of those items only that a row has enough places for if there are very many."""
        if (high - low).sum() <= LISTED:
            pieces = list(self._listed(at, low, high))
            return pieces[0] if pieces else (at, at)
        row_of = np.zeros(int(at.max()) + 1, dtype=np.int64)
        row_of[at] = row
        counts: dict[int, int] = {}
        for place, entry in self._listed(at, low, high):
            # An item may have a gram several times, which only makes the count too high.
            key, count = np.unique(index.items[entry] * rows + row_of[place], return_counts=True)
            for k, n in zip(key.tolist(), count.tolist()):
                counts[k] = counts.get(k, 0) + n
        kept = np.array(sorted(k for k, n in counts.items() if n >= index.needed[k // rows]), dtype=np.int64)
        places, entries = [at[:0]], [at[:0]]
        for place, entry in self._listed(at, low, high):
            good = np.isin(index.items[entry] * rows + row_of[place], kept)
            places.append(place[good])
            entries.append(entry[good])
        return np.concatenate(places), np.concatenate(entries)

    def _bands(self, index: Index, some: np.ndarray, found: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """``row, item, low, high`` of the regions that share enough grams with an item on neighbouring diagonals."""
        hits = self._hits(index, some, found, bounds)
        at, entry = self._pairs(index, *hits, len(bounds) - 1)
        if not len(at):
            return
        item = index.items[entry]
        # Bands of 2e + 2 diagonals that start every e + 1: any e + 1 neighbours are within one.
        stride = index.edits[item] + 1
        diagonal = at - index.places[entry] + (1 << 40) // stride * stride
        band = np.concatenate([diagonal // stride, diagonal // stride - 1])
        key = np.column_stack([np.tile(item, 2), band, np.tile(index.places[entry], 2)])
        row = np.searchsorted(bounds, np.tile(at, 2), side="right") - 1
        key = np.unique(np.column_stack([row, key]), axis=0)
        group, count = np.unique(key[:, :3], axis=0, return_counts=True)
        for row_number, item_number, band_number in group[count >= index.needed[group[:, 1]]].tolist():
            most = int(index.edits[item_number])
            first = band_number * (most + 1) - (1 << 40) // (most + 1) * (most + 1)
            yield row_number, item_number, first - most, first + 2 * most + 2 + len(index.chars[item_number]) + most

    def _windows(self, index: Index, found: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """The same for items of repeated grams: windows of the text with enough places whose gram the item has."""
        for item_number, own in index.often.items():
            size, most = len(index.chars[item_number]), int(index.edits[item_number])
            has = own[np.minimum(np.searchsorted(own, found), len(own) - 1)] == found
            sums = np.concatenate([[0], np.cumsum(has)])
            reach, step = size + 2 * most + 1, most + 1
            for row_number in np.flatnonzero(sums[np.minimum(bounds[1:], len(found))] - sums[np.minimum(bounds[:-1], len(found))] >= index.needed_often[item_number]):
                low, high = int(bounds[row_number]), int(bounds[row_number + 1])
                # Any match of at most size + most characters lies inside a window.
                starts = np.arange(low, max(low + 1, high), step)
                ends = np.minimum(starts + reach, high)
                inside = sums[np.clip(ends - index.q + 1, 0, len(found))] - sums[np.clip(starts, 0, len(found))]
                for i in np.flatnonzero(inside >= index.needed_often[item_number]).tolist():
                    yield int(row_number), item_number, int(starts[i]), int(ends[i])

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """``row, item, start, end, edits`` of each match, start and end as places in the text."""
        # A blank at the end, as a border of the last word.
        chars, origin, bounds = self.normal([f"{text or ''} " for text in texts])
        for index, some in zip(self.indexes, self.some, strict=True):
            found = grams(chars, index.q)
            done: dict[tuple[int, int], int] = {}
            for regions, steps in ((self._bands(index, some, found, bounds), False), (self._windows(index, found, bounds), True)):
                for row_number, item_number, low, high in regions:
                    pattern, most = index.chars[item_number], int(index.edits[item_number])
                    ended = done.get((row_number, item_number), -1)
                    if steps and low + most < ended:
                        continue  # what begins after the last match is in a later window, too
                    low, high = max(int(bounds[row_number]), low, ended), min(int(bounds[row_number + 1]), high)
                    region = chars[low:high]
                    match = occurrence(pattern, region) or (edit_distance(pattern, region, most) if most else None)
                    if match is None:
                        continue
                    edits, start, end = match
                    # Items that share a border may follow each other.
                    done[row_number, item_number] = low + end - index.padded
                    start, end = low + start + index.padded, low + end - index.padded
                    begin = int(origin[start])
                    last = int(origin[end - 1]) + 1 if end > start else begin
                    yield row_number, int(index.ids[item_number]), max(begin, 0), last, edits


def _blocks(benchmark: DataFrame, id: str, text: str, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items, ``limit`` characters at a time; equal texts once, under their least id."""
    items = benchmark.filter(F.col(text).isNotNull()).groupBy(F.col(text).alias("_text")).agg(F.min(id).alias("_id"))
    block, size = [], 0
    for row in items.orderBy("_id", "_text").toLocalIterator():
        block.append((-1 if row["_id"] is None else row["_id"], row["_text"]))
        size += len(row["_text"])
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


@lru_cache(maxsize=1)
def _searcher(block: tuple[tuple[int, str], ...], q: int, rate: float) -> Searcher:
    """The searcher of a block, which a worker makes once for all of its tasks."""
    return Searcher(index_items(list(block), q, rate))


def _found(rows: DataFrame, block: list[tuple[int, str]], q: int, rate: float) -> DataFrame:
    """``MATCH`` for ``doc_id, text``; the indexes are made where they are used, the driver has the items of one block."""
    items = tuple(block)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = list(_searcher(items, q, rate).search(batch.column(1).to_pylist()))
        if not found:
            return None
        row, *rest = zip(*found, strict=True)
        ids = pc.take(batch.column(0), pa.array(row))
        return pa.RecordBatch.from_arrays(
            [ids, *(pa.array(values, pa.int64()) for values in rest)], names=["doc_id", "item_id", "start", "end", "edits"]
        )

    return map_slices(rows, work, MATCH, ["text"], 512 << 10)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    q: int = Q,
    rate: float = RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``doc_id, item_id, start, end, edits`` for each place where a document holds a whole benchmark item.

    Whole texts are searched for whole items, with at most ``rate`` edits per character.
    ``start`` and ``end`` (exclusive) are code points of the text. Items are searched in blocks of
    ``block_chars`` characters with a pass over the documents each, whose matches are written before the next, so neither a task nor the
    driver holds more than one block. Equal items count as that with the least id (-1 for none). Null and
    empty texts hold nothing; items of fewer than ``q`` letters, digits and blanks match whole words only, items of none nothing.
    Repeated documents each come with their matches; a null id stays null. Overlapping matches of one item
    in one document come once, by the first band that aligns. An empty table on either side gives an empty result.
    """
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    spark, path, number = rows.sparkSession, new_folder(docs.sparkSession, "contaminated"), 0
    for block in _blocks(benchmark, item_id, item_text, block_chars):
        _found(rows, block, q, rate).write.parquet(f"{path}/block={number}")
        number += 1
    if not number:
        return spark.createDataFrame([], MATCH)
    return spark.read.schema(MATCH).parquet(*(f"{path}/block={i}" for i in range(number)))


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    q: int = Q,
    rate: float = RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, as :func:`contaminated` finds them.

    Of the rows that hold one, two 64-bit hashes of the text are kept, which the rows are then joined without.
    """
    prints = [F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.xxhash64(F.lit(1), F.coalesce(F.col(text), F.lit("")))]
    rows = docs.select(F.col(text).alias("text"), *(x.alias(n) for x, n in zip(prints, ("a", "b"), strict=True)))
    path, number = new_folder(docs.sparkSession, "decontaminated"), 0
    for block in _blocks(benchmark, item_id, item_text, block_chars):
        items = tuple(block)

        def work(batch: pa.RecordBatch, items: tuple = items) -> pa.RecordBatch | None:
            found = sorted({match[0] for match in _searcher(items, q, rate).search(batch.column(0).to_pylist())})
            return batch.select([1, 2]).take(pa.array(found, pa.int64())) if found else None

        map_slices(rows, work, "a BIGINT, b BIGINT", ["text"], 512 << 10).distinct().write.parquet(f"{path}/block={number}")
        number += 1
    if not number:
        return docs
    found = docs.sparkSession.read.schema("a BIGINT, b BIGINT").parquet(*(f"{path}/block={i}" for i in range(number)))
    names = free_names(docs.columns, 2)
    found = found.toDF(*names).distinct()
    return docs.join(found, (prints[0] == F.col(names[0])) & (prints[1] == F.col(names[1])), "left_anti")
