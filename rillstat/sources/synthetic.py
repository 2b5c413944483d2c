"""Synthetic page views and feed items, drawn on the executors from a seed.

Rows come from an id column, one possible item per id, so that any number of runs
is spread over any number of partitions without a shuffle. Draws are three steps
of the minimal standard generator (multiplier 48271, modulus 2^31 - 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The users, industries and pages of the generated records.
USERS = ["erica", "bob", "joe", "damian", "tania", "phil", "sam", "lauren", "joseph"]
INDUSTRIES = ["engineering", "telco", "finance", "health", "science"]
PAGES = ["index.html", "news.html", "contact.html", "about.html", "stuff.html"]

MAX_VIEWS = 9  # per user and run
MAX_ITEMS = 99  # per run

VIEWS_PER_RUN = len(USERS) * MAX_VIEWS

_MULTIPLIER, _MODULUS = 48271, 2**31 - 1


def draw(identity: Column, seed: int, stream: int, sides: int) -> Column:
    """A number from 0 below ``sides``, fixed by the identity, the seed and the stream."""
    state = F.pmod(identity, F.lit(_MODULUS)) + F.lit((seed * 1009 + stream * 7919) % _MODULUS)
    for _ in range(3):
        state = F.pmod(state * F.lit(_MULTIPLIER) + F.lit(11), F.lit(_MODULUS))
    return F.pmod(state, F.lit(sides))


def _choice(values: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), number.cast("int"))


def page_views(ids: DataFrame, id: str = "id", seed: int = 0) -> DataFrame:
    """``user, page, industry, flags`` from ids numbered from 0, 81 to a run.

    In each run a user has one industry and 0 to 9 views; flags are ``ARTICLE``.
    The other columns of ``ids`` are kept.
    """
    kept = [name for name in ids.columns if name != id]
    user_run = F.expr(f"`{id}` div {MAX_VIEWS}")
    slots = ids.withColumns({"_user_run": user_run, "_number": F.pmod(F.col(id), F.lit(MAX_VIEWS))})
    viewed = slots.where(F.col("_number") < draw(F.col("_user_run"), seed, 1, MAX_VIEWS + 1))
    return viewed.select(
        *kept,
        _choice(USERS, F.pmod(F.col("_user_run"), F.lit(len(USERS)))).alias("user"),
        _choice(PAGES, draw(F.col(id), seed, 2, len(PAGES))).alias("page"),
        _choice(INDUSTRIES, draw(F.col("_user_run"), seed, 3, len(INDUSTRIES))).alias("industry"),
        F.lit("ARTICLE").alias("flags"),
    )


def feed_items(ids: DataFrame, id: str = "id", seed: int = 0) -> DataFrame:
    """``user, is_new, content`` from ids numbered from 0, 99 to a run of 0 to 99 items.

    The other columns of ``ids`` are kept.
    """
    kept = [name for name in ids.columns if name != id]
    run = F.expr(f"`{id}` div {MAX_ITEMS}")
    slots = ids.withColumns({"_run": run, "_number": F.pmod(F.col(id), F.lit(MAX_ITEMS))})
    sent = slots.where(F.col("_number") < draw(F.col("_run"), seed, 4, MAX_ITEMS + 1))
    return sent.select(
        *kept,
        _choice(USERS, draw(F.col(id), seed, 5, len(USERS))).alias("user"),
        F.lit(True).alias("is_new"),
        F.lit("content").alias("content"),
    )


def generate_views(spark: SparkSession, runs: int = 1, seed: int = 0) -> DataFrame:
    """The page views of some runs."""
    return page_views(spark.range(runs * VIEWS_PER_RUN), seed=seed)


def generate_items(spark: SparkSession, runs: int = 1, seed: int = 0) -> DataFrame:
    """The feed items of some runs."""
    return feed_items(spark.range(runs * MAX_ITEMS), seed=seed)
