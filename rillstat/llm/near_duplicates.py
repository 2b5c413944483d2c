"""Near-duplicate documents: circulant MinHash, bands, and exact Jaccard on full shingle sets.

The steps, each a job over tables:

1. One pass over the texts gives every row the size and a 128-bit hash of its
   shingle set and its band keys. Rows with equal sets form a class, which its
   least id stands for from there on.
2. Representatives that share a band key are candidates. Each is compared with the
   least one of the bucket only, so a bucket costs as many pairs as it has members.
   Links are confirmed on the full sets and joined to components.
3. Buckets that still hold several components may hide links between members that
   were not compared. Their members go through an exact prefix join: with shingles
   ordered from rare to frequent, two sets of the wanted similarity share a shingle
   before the point from which too few are left. Shingles that one component has
   alone cannot link two, so they do not count. Pairs inside a component are never
   made. No bucket, partner or candidate is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstat.llm.batches import free_names, map_slices
from rillstat.llm.graphs import components
from rillstat.llm.hashing import mixed, shingles, word_hashes
from rillstat.sinks.tables import stored

_SKETCH = "id BIGINT, n_shingles BIGINT, hi BIGINT, lo BIGINT, bands ARRAY<BIGINT>"


def signature(values: np.ndarray, offsets: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: ``coordinates`` numbers for each non-empty row of shingle hashes.

    The first permutation scatters the shingles over a ring of 2**32 places. The
    second one orders the places; coordinate k is the least place under that order
    turned by k, so two permutations make all coordinates.
    """
    ring = (mixed(values ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offsets) - 1, coordinates), dtype=np.uint32)
    order, high = np.empty_like(ring), np.empty_like(ring)
    for k in range(coordinates):
        np.subtract(ring, np.uint32(k), out=order)
        np.multiply(order, np.uint32(0x85EBCA6B), out=order)
        np.right_shift(order, np.uint32(13), out=high)
        np.bitwise_xor(order, high, out=order)
        np.multiply(order, np.uint32(0xC2B2AE35), out=order)
        np.right_shift(order, np.uint32(16), out=high)
        np.bitwise_xor(order, high, out=order)
        out[:, k] = np.minimum.reduceat(order, offsets[:-1])
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key per band of ``rows`` coordinates; bands have different keys for equal coordinates."""
    bands = signatures.shape[1] // rows
    keys = np.empty((len(signatures), bands), dtype=np.uint64)
    for band in range(bands):
        key = np.full(len(signatures), band + 1, dtype=np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + signatures[:, k])
        keys[:, band] = key
    return keys


def _sketch(size: int, bands: int, rows: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, offsets = shingles(*word_hashes(batch.column(1)), size)
        counts = np.diff(offsets)
        full = np.flatnonzero(counts)
        hi, lo = np.zeros((2, batch.num_rows), dtype=np.uint64)
        keys = np.zeros((0, bands), dtype=np.uint64)
        if len(full):
            starts = offsets[:-1][full]
            hi[full] = np.add.reduceat(mixed(values), starts)
            lo[full] = np.add.reduceat(mixed(values ^ np.uint64(0xD1B54A32D192ED03)), starts)
            keys = band_keys(signature(values, np.append(starts, len(values)), bands * rows), rows)
        ends = np.concatenate([[0], np.cumsum(np.where(counts > 0, bands, 0))]).astype(np.int32)
        arrays = [
            batch.column(0),
            pa.array(counts.astype(np.int64)),
            pa.array(hi.view(np.int64)),
            pa.array(lo.view(np.int64)),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64))),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "n_shingles", "hi", "lo", "bands"])

    return work


def sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """For each row of ``id, text``: size and hash of its shingle set, and its band keys (none for an empty set)."""
    return map_slices(docs, _sketch(size, bands, rows), _SKETCH, ["text"])


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, text`` of the given ids, rows that repeat once."""
    wanted = docs.join(ids, "id", "left_semi").withColumn("print", F.xxhash64("text"))
    return wanted.dropDuplicates(["id", "print"]).drop("print")


def _compare(size: int, numerator: int, denominator: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, at = shingles(*word_hashes(batch.column(2)), size)
        right, bt = shingles(*word_hashes(batch.column(3)), size)
        similar = np.zeros(batch.num_rows, dtype=bool)
        for i in range(batch.num_rows):
            a, b = left[at[i]:at[i + 1]], right[bt[i]:bt[i + 1]]
            if not len(a) or not len(b) or denominator * min(len(a), len(b)) < numerator * max(len(a), len(b)):
                continue
            shared = int(np.isin(a, b, assume_unique=True, kind="sort").sum())
            similar[i] = denominator * shared >= numerator * (len(a) + len(b) - shared)
        return batch.select([0, 1]).filter(pa.array(similar))

    return work


def linked(pairs: DataFrame, texts: DataFrame, size: int, numerator: int, denominator: int) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets have ``denominator * shared >= numerator * union``."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.select("a", "b", "text_a", "text_b")
    found = map_slices(both, _compare(size, numerator, denominator), "a BIGINT, b BIGINT", ["text_a", "text_b"])
    return found.distinct()


def _explode_shingles(size: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, offsets = shingles(*word_hashes(batch.column(0)), size)
        rows = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        rest = batch.select([1, 2, 3]).take(pa.array(rows))
        return pa.RecordBatch.from_arrays(
            [*rest.columns, pa.array(np.diff(offsets)[rows]), pa.array(values.view(np.int64))],
            names=["id", "version", "comp", "n", "shingle"],
        )

    return work


def rest_pairs(open_docs: DataFrame, texts: DataFrame, size: int, numerator: int, denominator: int) -> DataFrame:
    """All candidate pairs ``a, b, comp_a, comp_b`` of different components among ``id, comp``.

    Complete: a pair that is left out cannot reach the similarity.
    """
    total = numerator + denominator
    rows = texts.join(open_docs, "id").select("text", "id", F.xxhash64("text").alias("version"), "comp")
    tokens = stored(
        map_slices(rows, _explode_shingles(size), "id BIGINT, version BIGINT, comp BIGINT, n BIGINT, shingle BIGINT", ["text"]),
        "shingles",
    )
    known = tokens.groupBy("shingle").agg(
        F.count("*").alias("df"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least")
    )
    useful = tokens.join(known.filter("low < high").select("shingle", "df", "least"), "shingle")
    doc = Window.partitionBy("id", "version")
    left = F.count("*").over(doc) - F.row_number().over(doc.orderBy("df", "shingle")) + 1
    partner = F.greatest("least", F.ceil(F.col("n") * numerator / denominator))
    entries = useful.withColumn("left", left).filter(total * F.col("left") >= numerator * (F.col("n") + partner))
    entries = stored(entries.select("shingle", "id", "comp", "n", "left"), "prefixes")
    sizes = entries.groupBy("shingle", "comp").count()
    main = sizes.groupBy("shingle").agg(
        F.max(F.struct("count", "comp"))["comp"].alias("main"), F.count("*").alias("comps")
    ).filter("comps > 1")
    # Stored, so that the join below reads both sides by an exchange that can be split where a shingle is hot.
    contested = stored(entries.join(main, "shingle").select(*entries.columns, "main"), "contested")
    minor = contested.filter("comp <> main").select(
        "shingle", F.col("id").alias("a"), F.col("comp").alias("comp_a"), F.col("n").alias("n_a"), F.col("left").alias("left_a")
    )
    others = contested.select(
        "shingle", F.col("id").alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("n_b"), F.col("left").alias("left_b")
    )
    possible = (F.col("comp_a") != F.col("comp_b")) & (
        total * F.least("left_a", "left_b") >= numerator * (F.col("n_a") + F.col("n_b"))
    )
    pairs = minor.join(others, "shingle").filter(possible)
    swapped = F.col("a") > F.col("b")
    return pairs.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        F.when(swapped, F.col("comp_b")).otherwise(F.col("comp_a")).alias("comp_a"),
        F.when(swapped, F.col("comp_a")).otherwise(F.col("comp_b")).alias("comp_b"),
    ).distinct()


def _own_links(slim: DataFrame, copies: DataFrame) -> DataFrame:
    """``a, b``: links between the nodes of an id's rows where its texts are unlike; of most tables none."""
    prints = slim.filter("id IS NOT NULL").groupBy("id").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("hi", "lo") for f in (F.min, F.max)))
    several = prints.filter("min_hi < max_hi OR min_lo < max_lo").select("id")
    own = slim.join(several, "id", "left_semi").join(copies, ["hi", "lo", "n_shingles"], "left")
    own = own.select("id", F.coalesce("first", "id").alias("node")).distinct()
    return own.join(own.groupBy("id").agg(F.min("node").alias("a")), "id").filter("a < node").select("a", F.col("node").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    size: int = 5,
    numerator: int = 75,
    denominator: int = 100,
    bands: int = 32,
    rows: int = 4,
) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every row of ``docs``.

    Words are runs of characters other than blank and 0x09 to 0x0D, A-Z in lower
    case. A row's set holds its distinct shingles of ``size`` words; with fewer
    words the whole sequence is the only one. Documents are linked if
    ``denominator * shared >= numerator * union``; ``component_id`` is the least id
    reachable and ``kept`` marks the rows that have it. With 32 bands of 4
    coordinates a pair at exactly 0.75 misses all bands once in 200,000 times, a
    closer one less often.

    A null or empty text, or one of blanks, has no shingles and is linked with
    nothing: its component is its own id. Rows with one id and different texts are
    one document with all the links of its texts. A row without an id belongs to
    the component of an exact copy that has one, otherwise it has none
    (null) and is kept. Ties do not arise, ids decide. Other columns are ignored. An
    empty table gives an empty result.
    """
    source = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    slim = stored(sketches(source, size, bands, rows), "sketches")
    copies = slim.filter("n_shingles > 0").groupBy("hi", "lo", "n_shingles")
    copies = copies.agg(F.min("id").alias("first"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    known = slim.join(copies, ["hi", "lo", "n_shingles"], "left").withColumn("node", F.coalesce("first", "id"))

    buckets = known.filter("id = node").select("node", F.explode("bands").alias("bucket"))
    leaders = buckets.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last"))
    shared = stored(buckets.join(leaders.filter("leader < last").drop("last"), "bucket"), "buckets")
    texts = stored(_texts(source, shared.select(F.col("node").alias("id")).distinct()), "texts")

    stars = shared.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    pairs = linked(stars, texts, size, numerator, denominator).select("a", "b").union(_own_links(slim, copies))
    first = components(stored(pairs, "pairs"))

    member = shared.join(first, "node", "left").withColumn("comp", F.coalesce("root", "node"))
    mixed_up = member.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    opened = member.join(mixed_up.select("bucket"), "bucket", "left_semi").select(F.col("node").alias("id"), "comp").distinct()
    pairs = stored(rest_pairs(opened, texts, size, numerator, denominator), "rest")
    found = linked(pairs.select("a", "b"), texts, size, numerator, denominator)
    joined = components(stored(pairs.join(found, ["a", "b"]).select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")), "pairs"))

    ended = first.join(joined.select(F.col("node").alias("root"), F.col("root").alias("beyond")), "root", "left")
    ended = ended.select("node", F.coalesce("beyond", "root").alias("end"))
    alone = joined.join(first.select("node"), "node", "left_anti").select("node", F.col("root").alias("end"))
    component = F.coalesce("end", "node")
    return known.join(ended.union(alone), "node", "left").select(
        F.col("id").alias(id),
        "n_shingles",
        component.alias("component_id"),
        (F.col("id").eqNullSafe(component)).alias("kept"),
    )


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: one that has the component's id.

    Rows with one id and different texts are documents of their own here, in the order of the text's hash, so
    no text is lost for another one's links. Rows without an id stay, as nothing names them.
    """
    key, print_, low, high = free_names(docs.columns, 4)
    named = docs.filter(F.col(id).isNotNull()).withColumn(print_, F.xxhash64(text))
    prints = named.groupBy(F.col(id).alias(key)).agg(F.min(print_).alias(low), F.max(print_).alias(high))
    if not prints.filter(F.col(low) < F.col(high)).isEmpty():
        # Keys in the order of the ids, one for each text of an id; written once, as later passes must find them unchanged.
        keyed = named.dropDuplicates([id, print_]).orderBy(id, print_).withColumn(key, F.monotonically_increasing_id())
        kept = _once(stored(keyed, "keyed"), key, text, **options).select(*docs.columns)
        return kept.unionByName(docs.filter(F.col(id).isNull()))
    return _once(docs, id, text, **options)


def _once(docs: DataFrame, id: str, text: str, **options: int) -> DataFrame:
    marked, kept, times = free_names(docs.columns, 3)
    found = near_duplicates(docs, id, text, **options).groupBy(F.col(id).alias(marked))
    marks = found.agg(F.max("kept").alias(kept), F.count("*").alias(times))
    marks = stored(marks.filter(F.col(marked).isNotNull() & (~F.col(kept) | (F.col(times) > 1))), "marks")
    same = F.col(id).cast("bigint") == F.col(marked)
    once = docs.join(marks, same, "left_anti")
    repeated = docs.join(marks.filter(F.col(kept)), same, "left_semi").dropDuplicates([id])
    return once.unionByName(repeated)
