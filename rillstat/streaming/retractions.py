"""Counts as a stream of retractions: for each count that changes, the old one with -1 and the new one with +1.

Whatever is made of the counts, such as the pages of an industry and hour, or their sums, follows by adding what
is signed +1 and taking away what is signed -1, in any number of further streams.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rillstat.functions.times import millis, with_instant

# As in :mod:`rillstat.streaming.publishing`, workers get the code by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHANGE = "page STRING, industry STRING, start_time BIGINT, count BIGINT, sign INT"

_KEYS = ["page", "industry", "start_time"]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each key in an Arrow batch, so that a hot key comes to its state as few rows."""
    for batch in batches:
        counts = pa.Table.from_batches([batch]).group_by(["page", "industry", "start_time"]).aggregate([([], "count_all")])
        counts = counts.rename_columns(["page", "industry", "start_time", "views"])
        yield from counts.to_batches()


class CountChanges(StatefulProcessor):
    """Holds the count of each key; gives its old and its new value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "count BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        views = sum(int(part["views"].sum()) for part in rows)
        old = self.count.get()[0] if self.count.exists() else None
        new = (old or 0) + views
        self.count.update((new,))
        changes = [(*key, new, 1)] if old is None else [(*key, old, -1), (*key, new, 1)]
        frame = pd.DataFrame(changes, columns=["page", "industry", "start_time", "count", "sign"])
        yield frame.astype({"start_time": "int64", "count": "int64", "sign": "int32"})

    def close(self) -> None:
        pass


def count_changes(views: DataFrame, every: str = "1 hour", ts: str = "ts") -> DataFrame:
    """``CHANGE`` rows for a stream of views: how the number of views per page, industry and window changes with each batch."""
    at = F.unix_millis(ts)
    rows = with_instant(views, ts).where(F.col(ts).isNotNull())
    rows = rows.select("page", "industry", (at - F.pmod(at, F.lit(millis(every)))).alias("start_time"))
    parts = rows.mapInArrow(_counted, "page STRING, industry STRING, start_time BIGINT, views BIGINT")
    return parts.groupBy(*_KEYS).transformWithStateInPandas(CountChanges(), CHANGE, outputMode="Update", timeMode="None")


def folded(changes: DataFrame) -> DataFrame:
    """``page, industry, start_time, count``: what is left of a log of changes."""
    kept = changes.groupBy(*_KEYS, "count").agg(F.sum("sign").alias("_kept"))
    return kept.where(F.col("_kept") > 0).drop("_kept")


def industry_totals(changes: DataFrame) -> DataFrame:
    """``industry, start_time, pages, views``: the second stage, kept up by signed sums; of a table or a stream of changes."""
    return changes.groupBy("industry", "start_time").agg(
        F.sum("sign").cast("bigint").alias("pages"), F.sum(F.col("sign") * F.col("count")).alias("views")
    )
