"""I-Match fingerprints: hashes of a document's terms of middling document frequency.

The lexicon holds the terms whose share of the documents is within a band. A fingerprint has
one hash of the document's sorted distinct lexicon terms and one for each of several random
subsets of the lexicon, of one half, one quarter and so on of the terms. Documents of any length
have a few terms in some of the subsets, so the share of equal hashes tells how alike two
documents are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstat.llm.batches import map_slices, slices
from rillstat.llm.hashing import LOWER, SPACE, distinct_by_row, mixed, span_hashes, utf8, words
from rillstat.llm.ranges import PER_RANGE, quantiles, range_of, sample
from rillstat.sinks.tables import stored

#: Random orders of the lexicon, and sizes of subsets in each: 1/2, 1/4, ... of the terms.
ORDERS = 12
LEVELS = 8
PARTS = 1 + ORDERS * LEVELS

#: Terms that are counted in one pass over the documents.
BLOCK_TERMS = 1 << 20

#: Documents whose frequent terms are looked for together, and different terms that end such a chunk sooner.
CHUNK_DOCS = 20_000
CHUNK_TERMS = 4 << 20

#: Bytes of text per range of ids, about.
RANGE_BYTES = 4 << 20

_BREAK = SPACE.copy()
_BREAK[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct terms of each text, ascending, and their ``n + 1`` offsets.

    Terms are runs of bytes other than white space and ASCII punctuation, A-Z in lower case.
    """
    data, offsets = utf8(column)
    starts, ends, bounds = words(data, offsets, _BREAK)
    return distinct_by_row(span_hashes(LOWER[data], starts, ends), bounds[:-1], bounds[1:])


class Lexicon:
    """A sorted array of term hashes, with a bitmap that tells most other terms quickly."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.some = np.zeros(1 << 22, dtype=bool)
        self.some[self.hashes >> np.uint64(42)] = True

    def places(self, values: np.ndarray) -> np.ndarray:
        """The place of each value in the lexicon, or -1."""
        out = np.full(len(values), -1, dtype=np.int64)
        at = np.flatnonzero(self.some[values >> np.uint64(42)])
        if len(at):
            place = np.minimum(np.searchsorted(self.hashes, values[at]), len(self.hashes) - 1)
            out[at] = np.where(self.hashes[place] == values[at], place, -1)
        return out


def fingerprints(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row of ``PARTS`` hashes per text; 0 for a subset that the text has no term of.

    A text without lexicon terms is fingerprinted by all its terms.
    """
    values, bounds = terms(column)
    n = len(bounds) - 1
    count = np.diff(bounds)
    rows = np.repeat(np.arange(n), count)
    known = lexicon.places(values) >= 0
    none = np.bincount(rows, known, minlength=n) == 0
    known |= none[rows]
    values, rows = values[known], rows[known]
    out = np.zeros((n, PARTS), dtype=np.uint16)
    full = np.unique(rows)
    if not len(full):
        return out
    starts = np.searchsorted(rows, full)
    spread = mixed(values ^ np.uint64(0x94D049BB133111EB))

    def put(part: int, inside: np.ndarray | None) -> None:
        kept = spread if inside is None else np.where(inside, spread, np.uint64(0))
        summed = mixed(np.add.reduceat(kept, starts)) >> np.uint64(48)
        some = np.ones(len(full), dtype=bool) if inside is None else np.logical_or.reduceat(inside, starts)
        out[full, part] = np.where(some, np.maximum(summed, 1), 0).astype(np.uint16)

    put(0, None)
    for order in range(ORDERS):
        draw = mixed(values + np.uint64(0x9E3779B97F4A7C15 * (order + 1) % (1 << 64)))
        for level in range(LEVELS):
            put(1 + order * LEVELS + level, draw < np.uint64(1 << (63 - level)))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal hashes among the subsets that either has terms of; 1 if neither has any."""
    either = ((a != 0) | (b != 0)).sum(axis=1)
    equal = ((a == b) & (a != 0)).sum(axis=1)
    return np.where(either > 0, equal / np.maximum(either, 1), 1.0)


def _frequent(share: float):
    """The terms that are in at least ``share`` of some chunk of a partition's documents.

    A chunk is so many documents that a term has to be in two of them at least, and ends with ``CHUNK_TERMS`` different terms.
    What is held is merged when as much has come in, so a document costs its own terms and not all that are held.
    """
    least = -(-2 // share) if share > 0 else CHUNK_DOCS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        held, fresh, waiting, docs = nothing, [], 0, 0

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held[0][held[1] >= share * docs].view(np.int64))], names=["term"])

        for batch in batches:
            for piece in slices(batch, ["text"]):
                fresh.append(terms(piece.column(0))[0])
                waiting, docs = waiting + len(fresh[-1]), docs + piece.num_rows
                full = docs >= CHUNK_DOCS
                if full or waiting >= max(len(held[0]), CHUNK_TERMS // 4):
                    held, fresh, waiting = _merged(held, np.concatenate(fresh)), [], 0
                if full or (docs >= least and len(held[0]) >= CHUNK_TERMS):
                    if fresh:
                        held, fresh, waiting = _merged(held, np.concatenate(fresh)), [], 0
                    yield emit()
                    held, docs = nothing, 0
        if docs:
            if fresh:
                held = _merged(held, np.concatenate(fresh))
            yield emit()

    return run


def _merged(held: tuple[np.ndarray, np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    fresh, count = np.unique(values, return_counts=True)
    both = np.concatenate([held[0], fresh])
    order = np.argsort(both, kind="stable")
    both, number = both[order], np.concatenate([held[1], count])[order]
    first = np.ones(len(both), dtype=bool)
    first[1:] = both[1:] != both[:-1]
    at = np.flatnonzero(first)
    return both[at], np.add.reduceat(number, at) if len(at) else number


def _counted(block: Lexicon):
    """Documents of the partition with each of the block's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(block.hashes), dtype=np.int64)
        for batch in batches:
            for piece in slices(batch, ["text"]):
                places = block.places(terms(piece.column(0))[0])
                count += np.bincount(places[places >= 0], minlength=len(count))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(block.hashes[some].view(np.int64)), pa.array(count[some])], names=["term", "docs"])

    return run


def lexicon_of(rows: DataFrame, low: float, high: float) -> np.ndarray:
    """Hashes of all terms whose share of the rows of ``text`` is from ``low`` to ``high``.

    A term with that share of all rows has it in some chunk, so the terms that are frequent in a
    chunk are the only candidates; these are counted exactly, a block of ``BLOCK_TERMS`` in each pass. The lexicon
    has at most (mean distinct terms per text) / ``low`` terms, whatever the number of rows.
    """
    number = rows.count()
    if not number:
        return np.zeros(0, dtype=np.uint64)
    candidates = stored(rows.mapInArrow(_frequent(low), "term BIGINT").distinct(), "terms")
    blocks = max(1, -(-candidates.count() // BLOCK_TERMS))
    found = []
    for block in range(blocks):
        # Even hashes: about BLOCK_TERMS of them at a time.
        some = candidates.filter(F.pmod(F.col("term"), F.lit(blocks)) == block).toArrow().column(0).to_numpy()
        if not len(some):
            continue
        counts = rows.mapInArrow(_counted(Lexicon(some.astype(np.int64).view(np.uint64))), "term BIGINT, docs BIGINT")
        counts = counts.groupBy("term").agg(F.sum("docs").alias("docs"))
        kept = counts.filter(F.col("docs").between(low * number, high * number)).select("term").toArrow()
        found.append(kept.column(0).to_numpy().astype(np.int64).view(np.uint64))
    return np.sort(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


def _prepare(lexicon: np.ndarray):
    cache: dict = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not cache:
            cache["lexicon"], cache["zstd"] = Lexicon(lexicon), zstandard.ZstdCompressor(level=3)
        marks = fingerprints(batch.column(1), cache["lexicon"]).astype(">u2")
        texts = batch.column(1).fill_null("").to_pylist()
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(text) for text in texts], pa.int64()),
                pa.array([row.tobytes() for row in marks], pa.binary()),
                pa.array([cache["zstd"].compress(text.encode()) for text in texts], pa.binary()),
                pa.array([int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), signed=True) for text in texts], pa.int64()),
            ],
            names=["id", "n_chars", "mark", "packed", "tie"],
        )

    return work


def _compare(lexicon: np.ndarray):
    cache: dict = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not cache:
            cache["lexicon"], cache["zstd"] = Lexicon(lexicon), zstandard.ZstdDecompressor()
        unpack = cache["zstd"].decompress
        edited = []
        following: list[str] = [unpack(packed).decode() for packed in batch.column(4).to_pylist()]
        for packed, after in zip(batch.column(3).to_pylist(), following, strict=True):
            text = unpack(packed).decode()
            half = len(text) // 2
            edited.append(text[:len(text) - half] + after[:half])
        own, beyond = (
            np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=">u2").reshape(-1, PARTS).astype(np.uint16) for i in (2, 5)
        )
        other = fingerprints(pa.array(edited, pa.large_string()), cache["lexicon"])
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([hashlib.sha256(text.encode()).hexdigest() for text in edited]),
                pa.array([row.tobytes().hex() for row in own.astype(">u2")]),
                pa.array([row.tobytes().hex() for row in other.astype(">u2")]),
                pa.array(likeness(own, other)),
                pa.array(likeness(own, beyond)),
            ],
            names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return work


def with_next(rows: DataFrame, sizes: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` (``id``, ``tie`` and others) with ``next_<column>`` of the row with the next ``id``, the first one's after the last.

    ``sizes`` has the ``id`` and ``weight`` of the same rows, for the cuts.
    Ids are cut to ranges at sampled ids. A range needs one row more than its own, the
    first of the next range, which is the row that the cut was taken from: rows with the id of a cut go to both.
    Null ids come first; ties follow ``tie``.
    """
    key = F.coalesce("id", F.lit(-(1 << 63)))
    keyed = sizes.select(key.alias("_key"), "weight")
    total, least, count = keyed.agg(F.sum("weight"), F.min("_key"), F.count("*")).first()
    if not count:
        return rows.select("*", *(F.col(name).alias(f"next_{name}") for name in columns))
    ranges = int(min(max(total // RANGE_BYTES, min(count // 100, 128), 1), 65_536))
    cuts = quantiles(sample(keyed, ["_key"], "weight", ranges * PER_RANGE, total), ranges)
    cuts = [cut for cut in cuts if cut[0] != least]
    first, last = range_of([(least,), *cuts], ["_key"]) - 1, len(cuts)
    firsts = np.array([least, *(cut[0] for cut in cuts)], dtype=np.int64).tolist()
    placed = rows.withColumn("_key", key).withColumn("_range", first)
    # Is the row's id the first of its range? Looked up in the sorted cuts like the range itself.
    before = range_of([(min(cut + 1, (1 << 63) - 1),) for cut in firsts], ["_key"])
    placed = placed.withColumn("_border", before == F.col("_range"))
    home = F.struct(F.col("_range").alias("range"), F.lit(0).alias("guest"))
    ahead = F.struct(F.when(F.col("_range") == 0, F.lit(last)).otherwise(F.col("_range") - 1).alias("range"), F.lit(1).alias("guest"))
    both = placed.withColumn("_to", F.explode(F.when(F.col("_border"), F.array(home, ahead)).otherwise(F.array(home))))
    order = Window.partitionBy("_to.range").orderBy("_to.guest", "_key", "tie")
    led = both.withColumns({f"next_{name}": F.lead(name).over(order) for name in columns}).filter("_to.guest = 0")
    return led.select(*rows.columns, *(f"next_{name}" for name in columns))


def compared(
    docs: DataFrame, id: str = "doc_id", text: str = "text", low: float = 0.002, high: float = 0.2
) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how alike they and the next document's are.

    The edited text has the last ``floor(n / 2)`` of the text's ``n`` code points replaced by as many
    of the next document's first ones (all, if it has fewer); the next document has the next higher id, the
    first one after the last. ``near_edited`` and ``near_next`` are :func:`likeness` from 0 to 1.

    A null text counts as an empty one; texts without any term have fingerprints of zeros, which are alike.
    Null ids come before all others; rows with one id follow each other by a hash of the text, so
    equal rows are next to each other. Very long texts are read whole. An empty table gives an empty result; other
    columns are ignored.
    """
    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    lexicon = lexicon_of(rows.select("text"), low, high)
    made = map_slices(rows, _prepare(lexicon), "id BIGINT, n_chars BIGINT, mark BINARY, packed BINARY, tie BIGINT", ["text"])
    sizes = rows.select("id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("weight"))
    led = with_next(made, sizes, ["packed", "mark"])
    led = led.select("id", "n_chars", "mark", "packed", "next_packed", "next_mark")
    schema = (
        "id BIGINT, n_chars BIGINT, edited_sha256 STRING, fingerprint STRING, edited_fingerprint STRING, "
        "near_edited DOUBLE, near_next DOUBLE"
    )
    return map_slices(led, _compare(lexicon), schema, ["packed"], 512 << 10).withColumnRenamed("id", id)
