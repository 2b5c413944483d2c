"""Which windows of a key are final, and what their latest values are.

A consumer of window updates holds the windows of each key and publishes the
oldest one whenever it holds more than ``lag``. After every update it therefore
holds exactly the ``lag`` latest windows of the key seen so far: an update to a
held window replaces its value, an update to an older one is published at once.
So whatever the order of the updates, all windows of a key but its ``lag``
latest are published in the end, each with its latest value last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstat.operators.ranking import ranked


def latest(updates: DataFrame, keys: Sequence[str], sequence: str, values: Sequence[str]) -> DataFrame:
    """The values of the update with the greatest ``sequence`` of each key.

    ``sequence`` must differ between the updates of a key. With fixed-width values
    this is one hash aggregation, combined before the shuffle.
    """
    newest = [(F.max(name) if name == sequence else F.max_by(name, sequence)).alias(name) for name in values]
    return updates.groupBy(*keys).agg(*newest)


def final_windows(windows: DataFrame, key: str = "market", start: str = "start_time", lag: int = 2) -> DataFrame:
    """All windows of each key but the ``lag`` latest; one row per key and start.

    Finds the ``lag``-th latest start of each key, for which only ``lag`` rows per
    key and task are shuffled, and keeps what is older. No key is sorted or ranked
    as a whole. The join has no hint: few keys are broadcast if Spark finds them
    small enough, and a hot key of a sort-merge join is split.

    The windows are read twice, the first time only key and start. Give a stored
    table, not a costly aggregation (:func:`rillstat.sinks.tables.stored`).
    """
    newest = ranked(windows.select(key, start), [key], [F.col(start).desc()], lag)
    bounds = newest.where(F.col("rank") == lag).select(F.col(key).alias("_key"), F.col(start).alias("_bound"))
    older = F.col(key).eqNullSafe(F.col("_key")) & (F.col(start) < F.col("_bound"))
    return windows.join(bounds, older).drop("_key", "_bound")
