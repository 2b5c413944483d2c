"""Values over all rows of a key up to each row, where a key may have a large part of all rows.

A window over a key puts all of its rows in one task. Here the rows are cut into ranges of key and
order, by a sample, so that a hot key has many ranges. What comes before a range is carried to it in a table of
one row per key and range, and a window runs inside each range only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstat.functions.exact import digit_names, digit_sums, exact_total
from rillstat.sinks.tables import stored

#: The number of a row's range; ranges are in the order of the keys.
RANGE = "_range"


def in_ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` written in ranges of ``keys`` and ``order``, whose number is in ``_range``."""
    columns = [*keys, *order]
    # The range is written with the row, as another run of the plan could cut elsewhere.
    placed = rows.repartitionByRange(*columns).withColumn(RANGE, F.spark_partition_id())
    return stored(placed, "ranges")


def inside(keys: Sequence[str], order: Sequence[str]):
    """The window over the rows of a range up to and with the current one."""
    return Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def earlier(keys: Sequence[str]):
    """The window over a key's ranges before the current one, in a table of one row per key and range."""
    return Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def running_ratios(rows: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """``keys, order, carry, count, numerator, denominator``: how each record changes the sums of its key.

    ``rows`` have ``num`` and ``den``. One row comes out per record. The sums are exact (:mod:`rillstat.functions.exact`), so they
    depend on the order of the records only by which ones come before. ``order`` must tell the records of a key apart.
    """
    placed = in_ranges(rows.select(*keys, *order, *carry, "num", "den"), keys, order)
    sums = [*digit_sums("num", "numerator"), *digit_sums("den", "denominator"), F.count(F.lit(1)).alias("_count")]
    names = [*digit_names("numerator"), *digit_names("denominator"), "_count"]
    totals = placed.groupBy(*keys, RANGE).agg(*sums)
    before = stored(totals.select(*keys, RANGE, *(F.sum(name).over(earlier(keys)).alias(f"{name}_before") for name in names)), "carried")
    own = inside(keys, order)
    count = F.count(F.lit(1)).over(own).alias("_count")
    here = placed.select(*placed.columns, *digit_sums("num", "numerator", own), *digit_sums("den", "denominator", own), count)
    same = [F.col(f"_l.{key}").eqNullSafe(F.col(f"_r.{key}")) for key in keys]
    both = here.alias("_l").join(before.alias("_r"), [*same, F.col(f"_l.{RANGE}") == F.col(f"_r.{RANGE}")])
    added = [
        F.when(F.col(name).isNull(), F.col(f"{name}_before")).otherwise(F.col(name) + F.coalesce(f"{name}_before", F.lit(0))).alias(name)
        for name in names
    ]
    whole = both.select(*(F.col(f"_l.{name}") for name in [*keys, *order, *carry]), *added)
    whole = exact_total(exact_total(whole, "numerator"), "denominator")
    return whole.withColumnRenamed("_count", "count").select(*keys, *order, *carry, "count", "numerator", "denominator")

