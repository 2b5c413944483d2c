"""The last points of each series, kept on a stream."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rillstat.streaming.publishing import UPDATE

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The points of a series that has changed; ``place`` counts from 1, the latest.
POINTS = f"{UPDATE}, place INT"

_COLUMNS = ["market", "start_time", "count", "utput", "seq"]


def _newest(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """Of each series the ``n`` latest starts, each with its last update."""
    rows = rows.sort_values("seq", kind="stable").drop_duplicates(["market", "start_time"], keep="last")
    rows = rows.sort_values("start_time", ascending=False, kind="stable")
    return rows[rows.groupby("market").cumcount() < n]


def _cut(n: int):
    """What an Arrow batch may add to any series, at most ``n`` rows of each."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield _newest(rows, n)

    return cut


class LastPoints(StatefulProcessor):
    """Holds the ``n`` latest points of a series; a later update of one replaces it, an older start goes where it belongs."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getListState("points", "start_time BIGINT, count BIGINT, utput DOUBLE, seq BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = list(self.points.get())
        columns = ["market", "start_time", "count", "utput", "seq"]
        held = pd.DataFrame([(key[0], *point) for point in before], columns=columns)
        for updates in rows:
            held = _newest(updates[columns] if held.empty else pd.concat([held, updates[columns]]), self.n)
        held = held.astype({"start_time": "int64", "count": "int64", "utput": "float64", "seq": "int64"})
        after = list(held[columns[1:]].itertuples(index=False, name=None))
        if [tuple(point) for point in before] == after:
            return
        self.points.put(after)
        yield held.assign(place=pd.Series(range(1, len(held) + 1), held.index, "int32"))

    def close(self) -> None:
        pass


def last_points(updates: DataFrame, n: int = 20) -> DataFrame:
    """``POINTS`` for a stream of ``UPDATE`` rows: all points of each series that changes, anew with each change.

    Folded by market and place, the last rows are those of :func:`rillstat.operators.ranking.last_points` over the latest values. A series
    comes to its state as at most ``n`` rows per Arrow batch, so a hot one is no burden.
    """
    rows = updates.select(*_COLUMNS).where(F.col("market").isNotNull() & F.col("start_time").isNotNull())
    return (
        rows.mapInPandas(_cut(n), UPDATE)
        .groupBy("market")
        .transformWithStateInPandas(LastPoints(n), POINTS, outputMode="Update", timeMode="None")
    )
