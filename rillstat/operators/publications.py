"""The log of all publications of windows, by arrival, from a table of updates.

A consumer holds windows by key. An update replaces its window's value or is held anew; when more than ``lag``
windows are held, the oldest one is published and dropped. So after each update it holds the ``lag`` latest starts so
far, and an update publishes the start that falls out of them: its own one, if that lies before them all, also
if it has been published before.

The starts that fall out are found by a cascade: the greatest start so far keeps the greater of itself and
the next start, and hands the lesser one on to the second greatest so far, and so on. What the last one hands on is published.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstat.operators.ranking import ranked
from rillstat.operators.running import RANGE, earlier, in_ranges, inside
from rillstat.sinks.tables import stored


def _fallen(rows: DataFrame, start: str, greatest, lag: int) -> DataFrame:
    """``rows`` with ``_out``, the start that falls out of the ``lag`` latest, and ``_most0`` and so on, these before the row.

    ``greatest`` gives the greatest value of a column before each row, from its name and the stage.
    """
    rows = rows.withColumn("_out", F.col(start))
    for stage in range(lag):
        rows = rows.withColumn(f"_most{stage}", greatest("_out", stage))
        most = F.col(f"_most{stage}")
        lesser = F.when(most.isNotNull() & (F.col("_out") != most), F.least("_out", most))
        rows = rows.withColumn("_out", lesser)
    return rows


def publication_log(
    updates: DataFrame, key: str = "market", start: str = "start_time", sequence: str = "seq",
    values: Sequence[str] = ("count", "utput"), lag: int = 2,
) -> DataFrame:
    """``key, start, values, sequence``: every publication, with the ``sequence`` of the update that it came with.

    ``sequence`` is the order of arrival and differs between the updates of a key. The value published is the last one of the
    window up to then. A late update of a published window publishes it again. ``lag`` is 1 or more. Updates without a key or a
    start do not count.

    Ranges of arrival are worked on side by side, so a hot key or a hot window is in no single task.
    """
    if lag < 1:
        raise ValueError(f"lag must be 1 or more, not {lag}")
    arrivals = updates.where(F.col(key).isNotNull() & F.col(start).isNotNull()).select(key, start, sequence, *values)
    placed = in_ranges(arrivals, [key], [sequence])
    # The latest starts of each range, and from them those of all ranges before it.
    newest = ranked(placed.select(key, RANGE, start).distinct(), [key, RANGE], [F.col(start).desc()], lag)
    ranges = Window.partitionBy(key).orderBy(RANGE)
    by_row = Window.partitionBy(key).orderBy(RANGE, start).rowsBetween(Window.unboundedPreceding, -1)
    latest = _fallen(newest, start, lambda name, stage: F.max(name).over(by_row), lag)
    # A stage has seen what the one before handed on; the first one the starts themselves.
    handed = [F.col(start)]
    for stage in range(lag - 1):
        most, before = F.col(f"_most{stage}"), handed[-1]
        handed.append(F.when(most.isNotNull() & (before != most), F.least(before, most)))
    until = ranges.rangeBetween(Window.unboundedPreceding, -1)
    carried = latest.select(key, RANGE, *(F.max(column).over(until).alias(f"_carried{stage}") for stage, column in enumerate(handed))).distinct()
    carried = stored(carried, "carried")

    both = placed.join(carried, [key, RANGE])
    before = Window.partitionBy(key, RANGE).orderBy(sequence).rowsBetween(Window.unboundedPreceding, -1)
    fallen = _fallen(both, start, lambda name, stage: F.greatest(f"_carried{stage}", F.max(name).over(before)), lag)
    out = fallen.where("_out IS NOT NULL").select(key, F.col("_out").alias(start), sequence, F.lit(True).alias("_asked"))
    return _with_values(arrivals, out, [key, start], sequence, values)


def _with_values(arrivals: DataFrame, asked: DataFrame, keys: Sequence[str], sequence: str, values: Sequence[str]) -> DataFrame:
    """``asked`` with the last values of its keys up to its ``sequence``; a window may have any number of updates."""
    told = arrivals.select(*keys, sequence, F.lit(False).alias("_asked"), F.struct(sequence, *values).alias("_told"))
    rows = told.unionByName(asked.withColumn("_told", F.lit(None).cast(told.schema["_told"].dataType)))
    # An update comes before the question that it raises.
    placed = in_ranges(rows, keys, [sequence, "_asked"])
    ends = placed.groupBy(*keys, RANGE).agg(F.max("_told").alias("_last"))
    before = stored(ends.select(*keys, RANGE, F.max("_last").over(earlier(keys)).alias("_before")), "carried")
    here = placed.withColumn("_last", F.max("_told").over(inside(keys, [sequence, "_asked"])))
    found = here.where("_asked").join(before, [*keys, RANGE])
    found = found.withColumn("_value", F.coalesce("_last", "_before"))
    return found.select(*keys, *(F.col(f"_value.{name}").alias(name) for name in values), sequence)
