"""Shards of equal size by sampled splitters.

Records are ordered by the hash of their text, so equal texts are neighbours and the order
has nothing to do with source or age. Keys are drawn by size, quantiles of the draw cut the
records into many ranges, ranges that turn out overfull are drawn from again and cut, and
each record's place follows from the exact sizes of the ranges before and a running sum
inside its own. The shard is the sixteenth, say, of all bytes that the place is in.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstat.llm.batches import free_names
from rillstat.llm.ranges import PER_RANGE, quantiles, range_of, sample
from rillstat.sinks.tables import stored

_KEYS = ["_hash", "_id", "_row"]

#: Records per range that are aimed at; ranges per shard at least; ranges at most.
RANGE_ROWS = 20_000
RANGES_PER_SHARD = 8
MOST_RANGES = 65_536

#: A group of equal texts stays in one shard up to this share of a shard's size.
WHOLE_GROUP = 0.05

_LEAST = -(1 << 63)


def _aligned(cuts: list[tuple]) -> list[tuple]:
    """Cuts moved to the first record of their text, except where one text has several."""
    count: dict[int, int] = {}
    for cut in cuts:
        count[cut[0]] = count.get(cut[0], 0) + 1
    return sorted({cut if count[cut[0]] > 1 else (cut[0], _LEAST, _LEAST) for cut in cuts})


def _sizes(rows: DataFrame, cuts: list[tuple]) -> dict[int, tuple[int, int]]:
    """Bytes and records of each range that has any: as many rows as there are ranges."""
    found = rows.select(range_of(cuts, _KEYS).alias("_range"), "_size").groupBy("_range")
    return {row[0]: (row[1], row[2]) for row in found.agg(F.sum("_size"), F.count("*")).collect()}


def _cut(rows: DataFrame, total: int, count: int, shards: int) -> tuple[list[tuple], dict[int, tuple[int, int]]]:
    """Cuts and range sizes; overfull ranges are cut again by a draw of their own."""
    ranges = int(min(max(count // RANGE_ROWS, shards * RANGES_PER_SHARD), MOST_RANGES))
    cuts = _aligned(quantiles(sample(rows, _KEYS, "_size", ranges * PER_RANGE, total), ranges))
    sizes = _sizes(rows, cuts)
    for _ in range(3):
        full = {r: size for r, (size, number) in sizes.items() if size > 3 * total / ranges and number > 1}
        if not full or len(cuts) > 2 * MOST_RANGES:
            break
        inside = rows.withColumn("_range", range_of(cuts, _KEYS)).filter(F.col("_range").isin(list(full)))
        held = sum(full.values())
        parts = sample(inside, ["_range", *_KEYS], "_size", max(1, held * ranges // total) * PER_RANGE, held)
        parts = [column[np.argsort(parts[0], kind="stable")] for column in parts]
        more = []
        for r, size in full.items():
            own = slice(*np.searchsorted(parts[0], [r, r + 1]))
            more += quantiles([column[own] for column in parts[1:]], int(-(-size * ranges // total)))
        cuts, before = sorted({*cuts, *more}), len(cuts)
        if len(cuts) == before:
            break
        sizes = _sizes(rows, cuts)
    return cuts, sizes


def _offsets(spark: SparkSession, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """For each range the bytes and records before it."""
    order = sorted(sizes)
    bytes_before = np.concatenate([[0], np.cumsum([sizes[r][0] for r in order])])
    rows_before = np.concatenate([[0], np.cumsum([sizes[r][1] for r in order])])
    rows = [(r, int(b), int(n)) for r, b, n in zip(order, bytes_before, rows_before, strict=False)]
    return spark.createDataFrame(rows, "_range INT, _bytes BIGINT, _records BIGINT")


def _with_groups(placed: DataFrame, cuts: list[tuple]) -> DataFrame:
    """``placed`` with ``_first`` and ``_all``: where a record's group of equal texts begins, and its size."""
    group = Window.partitionBy("_range", "_hash")
    placed = placed.withColumn("_first", F.min("_start").over(group)).withColumn("_all", F.sum("_size").over(group))
    # A group lies in several ranges only if a cut falls inside its text: at most as many groups as there are ranges.
    cut_up = sorted({cut[0] for cut in cuts if cut[1:] != (_LEAST, _LEAST)})
    if not cut_up:
        return placed
    placed = stored(placed, "starts")
    wide = placed.sparkSession.createDataFrame([(hash,) for hash in cut_up], "_hash BIGINT")
    whole = placed.join(F.broadcast(wide), "_hash").groupBy("_hash")
    whole = whole.agg(F.min("_start").alias("_from"), F.sum("_size").alias("_sum"))
    both = placed.join(F.broadcast(whole), "_hash", "left")
    return both.withColumns({"_first": F.coalesce("_from", "_first"), "_all": F.coalesce("_sum", "_all")}).drop("_from", "_sum")


def sharded(docs: DataFrame, shards: int = 16, id: str = "doc_id", text: str = "text", carry: bool = True) -> DataFrame:
    """``docs`` with ``size, text_crc32, law, shard, slot, grown_shard``; without ``carry`` only the id beside them.

    ``size`` is the UTF-8 bytes of the text plus 1, the law ``bytes``: the shards' sizes differ by
    about one record, or by ``WHOLE_GROUP`` of a shard where a group of equal texts is kept together. Larger groups are divided
    between neighbouring shards. ``slot`` numbers the records of a shard from 0 in the order of text hash, id and row.
    Adding a shard moves records everywhere, so ``grown_shard`` is null.

    A null text counts as an empty one, a null id comes first in its group. Repeated rows are records of
    their own, told apart by their row number. Columns of ``docs`` with the names of the new ones are replaced. An empty
    table gives an empty result.
    """
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = [name for name in docs.columns if name not in made] if carry else [id]
    whole = F.coalesce(F.col(text), F.lit(""))
    size, crc, hash, key, row = free_names([*docs.columns, *made], 5)
    rows = docs.select(
        *kept,
        (F.octet_length(whole) + 1).cast("bigint").alias(size),
        F.crc32(whole.cast("binary")).alias(crc),
        F.xxhash64(whole).alias(hash),
        F.coalesce(F.col(id).cast("bigint"), F.lit(_LEAST)).alias(key),
    )
    # Written once with its row numbers, which later passes must find unchanged.
    rows = stored(rows.withColumn(row, F.monotonically_increasing_id()), "records")
    total, count = rows.agg(F.sum(size), F.count("*")).first()
    slim = rows.select(*(F.col(name).alias(own) for name, own in zip((hash, key, row), _KEYS, strict=True)), F.col(size).alias("_size"))
    cuts, sizes = _cut(slim, total or 0, count, shards)
    placed = slim.withColumn("_range", range_of(cuts, _KEYS))
    # One row per range: MOST_RANGES times three at most.
    placed = placed.join(F.broadcast(_offsets(docs.sparkSession, sizes)), "_range")
    order = Window.partitionBy("_range").orderBy(*_KEYS)
    start = F.col("_bytes") + F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    placed = placed.withColumn("_start", start).withColumn("_place", F.col("_records") + F.row_number().over(order) - 1)
    placed = _with_groups(placed, cuts)
    together = F.col("_all") <= WHOLE_GROUP * (total or 0) / shards
    middle = F.when(together, 2 * F.col("_first") + F.col("_all")).otherwise(2 * F.col("_start") + F.col("_size"))
    shard = F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / (2 * (total or 1))))
    placed = stored(placed.select("_row", shard.cast("int").alias("shard"), "_place"), "places")
    begins = placed.groupBy("shard").agg(F.min("_place").alias("_begin"))
    # One row per shard.
    found = placed.join(F.broadcast(begins), "shard").select("_row", "shard", (F.col("_place") - F.col("_begin")).alias("slot"))
    return rows.join(found.withColumnRenamed("_row", row), row).select(
        *kept,
        F.col(size).alias("size"),
        F.col(crc).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
