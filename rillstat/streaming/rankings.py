"""Sinks that rank the counts of a batch of windows.

Ranking inside ``foreachBatch`` uses the batch operator, which cuts each group
before it is shuffled. A chained streaming aggregation would have to collect all
pages of an industry into one state row instead, and allows no early results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstat.operators.ranking import top_pages
from rillstat.sinks.tables import Sink, arrival, run_of

TOP = "page STRING, industry STRING, start_time BIGINT, count BIGINT, rank INT"

_KEYS = ["page", "industry", "start_time"]
_GROUP = ["industry", "start_time"]


def rank_closed(sink: Sink, n: int = 100) -> Sink:
    """Rank the counts of an append stream.

    All counts of a window come out in the one batch in which it closes, so each
    batch is ranked by itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        sink(top_pages(batch, n), batch_id)

    return write


def rank_updates(folder: str, sink: Sink, checkpoint: str, n: int, closed_after: int) -> Sink:
    """Rank the counts of an update stream; pass on the rankings that changed.

    Counts only rise. A page that has dropped out of the first ``n`` can come back
    only by an update of its own, which brings its whole count, so the first ``n``
    of each group are all that has to be kept from one batch to the next. They lie
    under ``folder`` in two slots, written in turn: a repeat of a batch finds what
    the batch before it left.

    A window is dropped when no more updates can come: when the newest one starts
    ``closed_after`` ms (window length plus lateness) or more behind its start. A
    batch takes rows by the watermark of the batch before it, so it is the newest
    window one batch back that counts.
    """
    schema = f"{TOP}, changed BOOLEAN, newest_before BIGINT"

    def slot(batch_id: int) -> str:
        return f"{folder}/run={run_of(checkpoint)}/slot={batch_id % 2}"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counts = batch.select(*_KEYS, "count", F.lit(True).alias("changed"))
        newest = None
        if batch_id > 0:
            held = spark.read.schema(schema).parquet(slot(batch_id - 1))
            newest, newest_before = held.agg(F.max("start_time"), F.max("newest_before")).first()
            if newest_before is not None:
                held = held.where(F.col("start_time") > newest_before - closed_after)
            counts = counts.union(held.select(*_KEYS, "count", F.lit(False)))
        counts = counts.groupBy(*_KEYS).agg(F.max("count").alias("count"), F.max("changed").alias("changed"))
        changed = F.max("changed").over(Window.partitionBy(*_GROUP))
        top = top_pages(counts, n).withColumn("changed", changed)
        top = top.withColumn("newest_before", F.lit(newest).cast("bigint"))
        top.select(*_KEYS, "count", "rank", "changed", "newest_before").write.mode("overwrite").parquet(slot(batch_id))
        written = spark.read.schema(schema).parquet(slot(batch_id))
        sink(written.where("changed").select(*_KEYS, "count", "rank"), batch_id)

    return write


def latest_rankings(rankings: DataFrame) -> DataFrame:
    """The last ranking of each industry and window, from a log with ``run`` and ``batch_id``."""
    newest = F.rank().over(Window.partitionBy(*_GROUP).orderBy(arrival().desc()))
    return rankings.withColumn("_age", newest).where(F.col("_age") == 1).drop("_age")
