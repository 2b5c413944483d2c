"""Publication of windows once later windows of the same key have come."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rillstat.operators.finalize import latest
from rillstat.sinks.tables import Sink

# What runs in the Python workers goes there by value: the package need not be
# installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Updates in, published windows out. ``seq`` rises from one update of a window to the next.
UPDATE = "market STRING, start_time BIGINT, count BIGINT, utput DOUBLE, seq BIGINT"

#: The part of a key that holds its latest windows.
HELD = -1

_COLUMNS = ["market", "start_time", "count", "utput", "seq"]


def arrive(held: dict[int, tuple], start: int, value: tuple, lag: int) -> tuple[int, tuple] | None:
    """Put one update among the held windows of a key; the window to publish, if any.

    The last item of a value is its ``seq``; an older one does not replace a newer.
    """
    if start not in held or value[-1] >= held[start][-1]:
        held[start] = value
    if len(held) <= lag:
        return None
    oldest = min(held)
    return oldest, held.pop(oldest)


def _mark(lag: int, parts: int):
    """Give each update the ``holder`` it goes to, its market, or no holder and a part from 0."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            # Of the updates of a window in one batch the last one stands for all.
            rows = rows.sort_values("seq", kind="stable").drop_duplicates(["market", "start_time"], keep="last")
            age = rows.groupby("market")["start_time"].rank(method="dense", ascending=False)
            part = pd.Series(pd.util.hash_array(rows["start_time"].to_numpy()) % parts, rows.index, "int64")
            yield rows.assign(holder=rows["market"].where(age <= lag, ""), part=part.where(age > lag, HELD))

    return mark


class HeldWindows(StatefulProcessor):
    """Holds the ``lag`` latest windows of each key, so the state is a few rows per key.

    Updates are taken as they come in, one Arrow batch at a time; a key is never
    gathered as a whole. Updates in other parts than ``HELD`` are final and pass.
    """

    def __init__(self, lag: int):
        self.lag = lag

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("held", "start_time BIGINT, count BIGINT, utput DOUBLE, seq BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        holder, part = key
        if part != HELD:
            for updates in rows:
                yield updates[_COLUMNS]
            return
        held = {row[0]: tuple(row[1:]) for row in self.state.get()}
        for updates in rows:
            published = []
            ordered = updates.sort_values(["seq", "start_time"], kind="stable")
            for start, count, utput, seq in zip(*(ordered[name].tolist() for name in _COLUMNS[1:])):
                window = arrive(held, start, (count, utput, seq), self.lag)
                if window is not None:
                    published.append((holder, window[0], *window[1]))
            yield pd.DataFrame(published, columns=_COLUMNS).astype(
                {"start_time": "int64", "count": "int64", "utput": "float64", "seq": "int64"}
            )
        self.state.put([(start, *value) for start, value in held.items()])

    def close(self) -> None:
        pass


def publish(updates: DataFrame, lag: int = 2, parts: int | None = None) -> DataFrame:
    """Stream of the windows to publish, given a stream of ``UPDATE`` rows.

    An update behind ``lag`` later windows of its key in its own Arrow batch can no
    longer be held by anyone, so it goes to one of ``parts`` parts, by default as many as
    there are shuffle partitions. What reaches the state of a hot key is thus at most ``lag`` rows per
    Arrow batch, whatever the backlog: of a window's updates in a batch only the last one counts.

    A window can come more than once in a micro-batch; the row with the greatest
    ``seq`` counts (:func:`once_per_batch`). What it publishes comes, last value per
    window, to what :func:`rillstat.operators.finalize.final_windows` gives on the
    latest values.
    """
    parts = parts or int(updates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        updates.select(*_COLUMNS)
        .where(F.col("market").isNotNull())
        .mapInPandas(_mark(lag, parts), f"{UPDATE}, holder STRING, part BIGINT")
        .groupBy("holder", "part")
        .transformWithStateInPandas(HeldWindows(lag), UPDATE, outputMode="Update", timeMode="None")
    )


def once_per_batch(sink: Sink) -> Sink:
    """Keep the last value of each window of a batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = latest(batch, ["market", "start_time"], "seq", ["count", "utput", "seq"])
        sink(newest, batch_id)

    return write
