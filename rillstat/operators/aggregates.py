"""Ratios and counts per key, over all time or per tumbling window.

Sums and counts combine before the shuffle, so a hot key reaches the reducer as
one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstat.functions.exact import digit_sums, exact_total
from rillstat.functions.numbers import ieee_ratio
from rillstat.functions.times import millis, window_millis, with_instant


def _group(rows: DataFrame, keys: Sequence[str], every: str | None, lateness: str | None, ts: str):
    """The grouped rows, and the column ``start_time`` to select if there is a window.

    Only a stream needs the window struct, for the watermark to close it. A table
    is grouped by the start as a number, which hashes and shuffles cheaper.
    """
    if every is None:
        return rows.groupBy(*keys), []
    rows = with_instant(rows, ts)
    if rows.isStreaming:
        if lateness is not None:
            rows = rows.withWatermark(ts, lateness)
        return rows.groupBy(F.window(ts, every), *keys), [window_millis().alias("start_time")]
    at = F.unix_millis(F.col(ts))
    start = at - F.pmod(at, F.lit(millis(every)))
    return rows.where(F.col(ts).isNotNull()).groupBy(start.alias("start_time"), *keys), ["start_time"]


def ratio_by(
    rows: DataFrame,
    keys: Sequence[str],
    *,
    every: str | None = None,
    lateness: str | None = None,
    scale: float = 1.0,
    count_blank: bool | None = None,
    ts: str = "ts",
    exact: bool = False,
) -> DataFrame:
    """``count, numerator, denominator, utput`` per key, with ``start_time`` per window.

    ``every`` is the window length, ``lateness`` the watermark delay of a stream.
    ``utput`` is ``sum(num) / sum(den) / scale``. Lines whose rest is commas alone
    are counted without windows and not counted with them, unless ``count_blank``
    says otherwise. Sums of doubles depend on the order of the rows in their last digits, which ``exact`` sums
    (:mod:`rillstat.functions.exact`) do not, on a table or a stream.
    """
    if count_blank is None:
        count_blank = every is None
    count = F.count(F.lit(1)) if count_blank else F.count_if("counted")
    groups, start = _group(rows, keys, every, lateness, ts)
    if exact:
        sums = groups.agg(count.alias("count"), *digit_sums("num", "numerator"), *digit_sums("den", "denominator"))
        sums = exact_total(exact_total(sums, "numerator"), "denominator")
    else:
        sums = groups.agg(
            count.alias("count"), F.sum("num").alias("numerator"), F.sum("den").alias("denominator")
        )
    utput = ieee_ratio("numerator", "denominator", scale)
    return sums.select(*keys, *start, "count", "numerator", "denominator", utput.alias("utput"))


def count_by(
    rows: DataFrame,
    keys: Sequence[str],
    *,
    every: str | None = None,
    lateness: str | None = None,
    ts: str = "ts",
) -> DataFrame:
    """``count`` per key, with ``start_time`` per window of length ``every``."""
    groups, start = _group(rows, keys, every, lateness, ts)
    return groups.agg(F.count(F.lit(1)).alias("count")).select(*keys, *start, "count")
