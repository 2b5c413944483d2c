"""Mixing a corpus to target weights by iterative proportional fitting, with DataFrame functions only.

Token counts are summed per cell (source, language, topic) and raked: each dimension in turn
is scaled to its target marginal until all of them fit. The raked weight of a cell over its
tokens is the rate at which its documents are wanted; documents are drawn by a hash of their
id with a probability in proportion to it. Where documents are wanted more than once, either a
weight says how often or they are repeated.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstat.llm.batches import free_names
from rillstat.sinks.tables import stored

#: A dimension's target: shares by value, or the power that the shares of the corpus are raised to
#: (1 leaves them, 0 makes them equal).
Target = Mapping[str, float] | float

#: Scales that are tried in one job when the sampling rate is searched for.
_TRIED = 64

#: Sweeps that run in one job, between two tables that cut the lineage.
_SWEEPS_A_JOB = 4


def token_count(text: str) -> Column:
    """Words of a text: runs of characters other than blank and 0x09 to 0x0D."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("bigint")


def layout_topic(text: str) -> Column:
    """A topic by what a text is made of; for corpora without a topic of their own."""
    whole = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(whole, F.lit(" | ")), "table")
        .when(F.contains(whole, F.lit('= "')), "code")
        .when(F.contains(whole, F.lit("icense")), "notice")
        .when(F.contains(whole, F.lit("@")) | F.contains(whole, F.lit("+1 (")), "contact")
        .when(F.length(whole) < 1000, "short prose")
        .otherwise("prose")
    )


def _label(value: str) -> Column:
    """The value of a dimension as text; a null is a value of its own."""
    column = F.col(value).cast("string")
    return F.when(column.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), column))


def _wanted(dimension: str, target: Target, total: Column) -> Column:
    """The target weight of the row's value, from its weight in the corpus and the whole."""
    if isinstance(target, Mapping):
        if not target:
            raise ValueError(f"no target shares for {dimension}")
        shares = F.create_map(*(x for value, share in target.items() for x in (F.lit(f"={value}"), F.lit(float(share)))))
        return F.coalesce(shares[F.col(dimension)], F.lit(0.0)) * total
    return F.pow(F.col("_own"), F.lit(float(target))) * F.pow(total, F.lit(1 - float(target)))


def rake(cells: DataFrame, targets: Mapping[str, Target], tolerance: float = 1e-5, sweeps: int = 60) -> DataFrame:
    """``cells`` (dimensions and ``base``) with ``fitted``: weights near ``base`` whose marginals have the target shares.

    The sum stays that of ``base``. Targets are scaled to the values that occur with a positive
    base, so a target for a value without cells goes to the others. Stops when no cell moved by
    more than ``tolerance`` of its weight in a sweep, or after ``sweeps``, with a warning that tells by how much cells still move:
    targets that contradict each other or the empty cells are never met.
    """
    total = cells.agg(F.sum("base")).first()[0]
    if not total:
        return cells.withColumn("fitted", F.col("base").cast("double"))
    whole = F.lit(float(total))
    fitted = cells.withColumn("fitted", F.col("base").cast("double"))
    for dimension, target in targets.items():
        own = cells.groupBy(dimension).agg(F.sum("base").cast("double").alias("_own")).filter("_own > 0")
        wanted = own.select(dimension, _wanted(dimension, target, whole).alias("_wanted"))
        scale = float(total) / (wanted.agg(F.sum("_wanted")).first()[0] or float("inf"))
        if not scale:
            raise ValueError(f"none of the target values of {dimension} occurs")
        wanted = wanted.select(dimension, (F.col("_wanted") * scale).alias(f"_to_{dimension}"))
        fitted = fitted.join(wanted, dimension, "left")
    fitted = stored(fitted, "raking")
    for _ in range(-(-sweeps // _SWEEPS_A_JOB)):
        for _ in range(_SWEEPS_A_JOB):
            fitted = fitted.withColumn("_before", F.col("fitted"))
            for dimension in targets:
                reached = F.sum("fitted").over(Window.partitionBy(dimension))
                ratio = F.when(reached > 0, F.coalesce(f"_to_{dimension}", F.lit(0.0)) / reached).otherwise(0.0)
                fitted = fitted.withColumn("fitted", F.col("fitted") * ratio)
        fitted = stored(fitted, "raking")
        moved = fitted.agg(F.max(F.abs(F.col("fitted") - F.col("_before")) / F.greatest("_before", F.lit(1e-300)))).first()[0]
        if moved is None or moved <= tolerance:
            break
    else:
        warnings.warn(f"raking stopped after {sweeps} sweeps with cells still moving by {moved:.1e} of their weight", RuntimeWarning, stacklevel=2)
    return fitted.select(*cells.columns, "fitted")


def sampling_scale(cells: DataFrame, tokens: float) -> float:
    """The number that makes the expected tokens, ``base * least(1, number * fitted / base)`` in all, equal to ``tokens``."""
    rate = F.col("fitted") / F.col("base")
    some = cells.filter("base > 0 AND fitted > 0")
    low, high, most = some.agg(F.min(1 / rate), F.max(1 / rate), F.sum("base")).first()
    if low is None or tokens >= most:
        return high or 0.0
    low = min(low, high) * min(1.0, tokens / most) / 2
    for _ in range(6):
        step = (high / low) ** (1 / (_TRIED - 1))
        tried = [low * step**i for i in range(_TRIED)]
        reached = some.agg(*(F.sum(F.col("base") * F.least(F.lit(1.0), rate * x)).alias(f"s{i}") for i, x in enumerate(tried))).first()
        above = next((i for i, value in enumerate(reached) if value >= tokens), _TRIED - 1)
        if above == 0:
            return tried[0]
        low, high = tried[above - 1], tried[above]
        if high / low < 1 + 1e-12:
            break
    return high


def mixed(
    docs: DataFrame,
    targets: Mapping[str, Target],
    budget: float = 0.7,
    id: str = "doc_id",
    text: str = "text",
    topic: Column | None = None,
    seed: int = 17,
    repeats: bool = False,
) -> DataFrame:
    """The sampled rows of ``docs`` with ``mix_topic, mix_tokens, mix_probability, mix_weight``.

    ``targets`` names columns of ``docs`` (or ``topic``, for the given expression, :func:`layout_topic`
    by default) and their target marginals of tokens. ``budget`` is the share of all tokens to expect
    in the sample. A document is kept with probability ``least(1, scale * fitted / tokens)`` of its cell;
    where that is 1, ``mix_weight`` tells how often it is wanted, elsewhere it is 1, so weighted tokens
    have the target marginals.

    With ``repeats`` the rows themselves have the target marginals, without weights: a document that is
    wanted 2.3 times comes twice and with a probability of 0.3 once more, ``mix_weight`` is 1, and
    ``budget`` counts the tokens of the repeated rows too. No rate is capped.

    Nulls in a dimension are a value of their own (with shares by value: not wanted). Null and empty
    texts have no tokens: a cell of nothing else keeps them all. The draw hashes the id, so rows with one
    id are kept or dropped together, as are rows without one. Columns of ``docs`` with the names of the
    new ones are replaced. An empty table gives an empty result.
    """
    made = ("mix_topic", "mix_tokens", "mix_probability", "mix_weight")
    kept = [name for name in docs.columns if name not in made]
    *own, wanted_name, copy = free_names([*docs.columns, *made], len(targets) + 2)
    dimensions = dict(zip(targets, own, strict=True))
    rows = docs.select(
        *kept,
        (layout_topic(text) if topic is None else topic).alias("mix_topic"),
        token_count(text).alias("mix_tokens"),
    )
    labels = {name: _label("mix_topic" if name == "topic" and name not in kept else name) for name in targets}
    rows = rows.withColumns({dimensions[name]: label for name, label in labels.items()})
    cells = stored(rows.groupBy(*dimensions.values()).agg(F.sum("mix_tokens").alias("base")), "cells")
    fitted = rake(cells, {dimensions[name]: target for name, target in targets.items()})
    tokens = budget * (cells.agg(F.sum("base")).first()[0] or 0)
    if repeats:
        scale = tokens / (fitted.agg(F.sum("fitted")).first()[0] or float("inf"))
    else:
        scale = sampling_scale(fitted, tokens)
    wanted = F.when(F.col("base") > 0, F.col("fitted") / F.col("base") * scale).otherwise(1.0)
    rates = stored(fitted.select(*dimensions.values(), wanted.alias(wanted_name)), "rates")
    draw = F.xxhash64(F.col(id), F.lit(seed)).cast("double") / F.lit(2.0**64) + 0.5
    probability = F.least(F.lit(1.0), F.col(wanted_name))
    drawn = rows.join(rates, list(dimensions.values()))
    if repeats:
        times = F.floor(wanted_name)
        times = (times + (draw < F.col(wanted_name) - times).cast("int")).cast("int")
        drawn = drawn.withColumn(copy, F.explode(F.array_repeat(F.lit(0), times)))
        weight = F.lit(1.0)
    else:
        drawn = drawn.filter((draw < probability) | (probability >= 1))
        weight = F.greatest(F.lit(1.0), F.col(wanted_name))
    return drawn.select(*kept, "mix_topic", "mix_tokens", probability.alias("mix_probability"), weight.alias("mix_weight"))
