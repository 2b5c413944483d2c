"""Windows that close at their own key's time, with late rows put aside.

Spark's watermark is one for all keys and drops late rows without a word. Here each key has a clock, the latest time
seen in its rows. A window closes once the clock has passed its end by the lateness; rows for closed
windows go to a sink of their own. A batch is judged by the clocks of the batch before it, so the order of the rows in a
batch does not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstat.functions.exact import digit_names, digit_sums, exact_total
from rillstat.functions.numbers import ieee_ratio
from rillstat.functions.times import millis, with_instant
from rillstat.sinks.tables import Sink, run_of

_SUMS = [*digit_names("numerator"), *digit_names("denominator")]


def _types(rows: DataFrame, key: str) -> tuple[str, str]:
    """The schemas of the held windows and of the clocks."""
    kind = rows.schema[key].dataType.simpleString()
    sums = ", ".join(f"{name} {'DOUBLE' if name.endswith('_rest') else 'BIGINT'}" for name in _SUMS)
    return f"{key} {kind}, start_time BIGINT, count BIGINT, {sums}", f"{key} {kind}, clock BIGINT"


def _ratios(windows: DataFrame, key: str, scale: float) -> DataFrame:
    whole = exact_total(exact_total(windows, "numerator"), "denominator")
    utput = ieee_ratio("numerator", "denominator", scale)
    return whole.select(key, "start_time", "count", "numerator", "denominator", utput.alias("utput"))


def _slot(folder: str, checkpoint: str, batch_id: int) -> str:
    return f"{folder}/run={run_of(checkpoint)}/slot={batch_id % 2}"


def close_by_key(
    folder: str, closed: Sink, late: Sink, checkpoint: str, *, key: str = "market", every: str = "1 second",
    lateness: str = "500 milliseconds", scale: float = 1.0, ts: str = "ts",
) -> Sink:
    """Take batches of parsed rows (``key, ts, num, den, counted`` and others); send each window on when it closes, and late rows as they come.

    ``closed`` gets ``key, start_time, count, numerator, denominator, utput`` of the windows that close in a batch, one row for each window.
    ``late`` gets the rows, as they came, whose window had closed before the batch. Rows without key or time are
    not counted and not late. Sums are exact. What stays open lies under ``folder`` in two slots, written in turn, as tables of one row per key and per open
    window: see :func:`open_windows`. A hot key is combined before any shuffle.
    """
    size, wait = millis(every), millis(lateness)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before, after = _slot(folder, checkpoint, batch_id - 1), _slot(folder, checkpoint, batch_id)
        windows_type, clocks_type = _types(batch, key)
        # Read three times, so written once.
        staged = f"{folder}/run={run_of(checkpoint)}/rows={batch_id % 2}"
        batch.write.mode("overwrite").parquet(staged)
        rows = spark.read.schema(batch.schema).parquet(staged)
        if batch_id > 0:
            held = spark.read.schema(windows_type).parquet(f"{before}/windows")
            clocks = spark.read.schema(clocks_type).parquet(f"{before}/clocks")
        else:
            held, clocks = spark.createDataFrame([], windows_type), spark.createDataFrame([], clocks_type)
        columns = rows.columns
        at = F.unix_millis(ts)
        timed = with_instant(rows, ts).where(F.col(key).isNotNull() & F.col(ts).isNotNull())
        timed = timed.withColumn("_at", at).withColumn("_start", at - F.pmod(at, F.lit(size)))
        timed = timed.join(clocks.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key"), "left").drop("_key")
        is_late = F.coalesce(F.col("_start") + size + wait <= F.col("clock"), F.lit(False))
        late(timed.where(is_late).select(*columns), batch_id)
        ticks = timed.groupBy(key).agg(F.max("_at").alias("clock"))
        ticks.unionByName(clocks).groupBy(key).agg(F.max("clock").alias("clock")).write.mode("overwrite").parquet(f"{after}/clocks")
        clocks = spark.read.schema(clocks_type).parquet(f"{after}/clocks")
        new = timed.where(~is_late).groupBy(key, F.col("_start").alias("start_time")).agg(
            F.count_if("counted").alias("count"), *digit_sums("num", "numerator"), *digit_sums("den", "denominator")
        )
        both = held.unionByName(new).groupBy(key, "start_time").agg(*(F.sum(name).alias(name) for name in ["count", *_SUMS]))
        ended = both.join(clocks, key).withColumn("_closed", F.col("start_time") + size + wait <= F.col("clock")).drop("clock")
        ended.write.mode("overwrite").partitionBy("_closed").parquet(f"{after}/all")
        ended = spark.read.schema(f"{windows_type}, _closed BOOLEAN").parquet(f"{after}/all")
        ended.where("NOT _closed").drop("_closed").write.mode("overwrite").parquet(f"{after}/windows")
        closed(_ratios(ended.where("_closed"), key, scale), batch_id)

    return write


def open_windows(spark: SparkSession, folder: str, checkpoint: str, batch_id: int, key: str = "market", kind: str = "string", scale: float = 1.0) -> DataFrame:
    """The windows that were open after a batch, as :func:`close_by_key` left them."""
    sums = ", ".join(f"{name} {'DOUBLE' if name.endswith('_rest') else 'BIGINT'}" for name in _SUMS)
    schema = f"{key} {kind}, start_time BIGINT, count BIGINT, {sums}"
    return _ratios(spark.read.schema(schema).parquet(f"{_slot(folder, checkpoint, batch_id)}/windows"), key, scale)

