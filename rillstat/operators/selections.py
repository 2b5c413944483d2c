"""Filters and projections over page views, feed items and chart points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstat.functions import text


def article_views(views: DataFrame, user: str | None = "user") -> DataFrame:
    """Views whose flags contain ``ARTICLE``, reduced to user, page, industry and ts.

    All views carry the same ``user``, so that page and industry alone tell them
    apart; None leaves the column out.
    """
    articles = views.where(F.col("flags").contains("ARTICLE"))
    constant = [] if user is None else [F.lit(user).alias("user")]
    return articles.select(*constant, "page", "industry", "ts")


def new_items(feed: DataFrame) -> DataFrame:
    """Feed items that are new."""
    return feed.where(F.col("is_new"))


def only_series(points: DataFrame, series: Sequence[str] | DataFrame, key: str = "market") -> DataFrame:
    """Points of the given series: a list of names, or a table with the key column.

    A table is reduced to its distinct keys and joined without a hint: Spark
    broadcasts it if its size allows, and otherwise splits the hot keys of a
    sort-merge join.
    """
    if isinstance(series, DataFrame):
        return points.join(series.select(key).distinct(), key, "left_semi")
    return points.where(F.col(key).isin(list(series)))


def with_level(points: DataFrame, value: str = "utput", threshold: float = 1.5) -> DataFrame:
    """Add ``level``: ``low`` below the threshold, else ``ok``."""
    return points.withColumn("level", text.level(F.col(value), threshold))
