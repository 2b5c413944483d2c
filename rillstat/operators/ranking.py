"""Top rows per group, and their text form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, group: Sequence[str | Column], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group by ``order``, numbered from 1 in ``rank``.

    Spark keeps ``n`` rows per group and task before the shuffle, so a hot group is cut
    down where it lies; :func:`rillstat.session.build_session` lifts the limit on ``n`` for that.
    """
    number = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn(rank, number).where(F.col(rank) <= n)


def top_pages(counts: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` most viewed pages per industry and window; equal counts go by page."""
    return ranked(counts, ["industry", "start_time"], [F.col("count").desc(), F.col("page")], n)


def last_points(points: DataFrame, key: str = "market", start: str = "start_time", n: int = 20) -> DataFrame:
    """The ``n`` latest points of each series."""
    return ranked(points, [key], [F.col(start).desc()], n)


def pages_text(top: DataFrame) -> DataFrame:
    """One text per industry and window: the pages by rank, each with a newline.

    ``top`` comes from :func:`top_pages`, so a list holds at most its ``n`` pages.
    """
    pages = F.transform(F.array_sort(F.collect_list(F.struct("rank", "page"))), lambda x: x["page"])
    text = F.concat(F.array_join(pages, "\n"), F.lit("\n"))
    return top.groupBy("industry", "start_time").agg(text.alias("value"))
