"""Sums that do not depend on order, against exact sums."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rillstat.functions.exact import digit_sums, exact_total
from rillstat.operators.aggregates import ratio_by


def total(spark, values, partitions=3):
    rows = spark.createDataFrame([(v,) for v in values], "x DOUBLE").repartition(partitions)
    return exact_total(rows.groupBy().agg(*digit_sums("x", "total")), "total").first()["total"]


def numbers(seed, count, low, high):
    random_ = random.Random(seed)
    return [random_.choice((-1, 1)) * math.ldexp(random_.random(), random_.randrange(low, high)) for _ in range(count)]


@pytest.mark.parametrize("seed", range(8))
def test_the_sum_is_rounded_once(spark, seed):
    low, high = [(-3, 10), (-60, 80), (-20, 20), (30, 34), (-67, -60), (0, 1), (-40, 88), (50, 54)][seed]
    values = numbers(seed, 400, low, high)
    assert total(spark, values) == math.fsum(values)
    assert total(spark, [abs(v) for v in values]) == math.fsum(map(abs, values))


@pytest.mark.parametrize("values", [
    [0.1] * 10, [1e16, 1.0, -1e16], [2.0**53, 1.0], [2.0**53, 1.0, 2.0**-60], [2.0**53 + 2, 1.0], [2.0**53 + 2, 1.0, -(2.0**-60)], [-(2.0**53), -1.0, -(2.0**-60)],
    [1e-20, -1e-20], [0.0, -0.0], [3.5], [-1.0, 0.75], [2.0**88, -(2.0**88), 0.3], [5e-21],
])
def test_hard_cases(spark, values):
    assert total(spark, values) == math.fsum(values)


def test_nulls_and_what_does_not_fit(spark):
    assert total(spark, [None, None]) is None
    assert total(spark, [None, 0.5]) == 0.5
    assert total(spark, [1e300, 0.5]) == 1e300
    assert total(spark, [1e-300]) == 1e-300
    assert total(spark, [math.inf, 1.0]) == math.inf
    assert math.isnan(total(spark, [math.inf, -math.inf]))
    assert math.isnan(total(spark, [math.nan, 1.0]))
    assert total(spark, []) is None


def test_any_partitioning_gives_the_same_ratios(spark):
    values = numbers(1, 3000, -10, 30)
    rows = spark.createDataFrame([(f"k{i % 3}", v, abs(v) / 3, True) for i, v in enumerate(values)], "k STRING, num DOUBLE, den DOUBLE, counted BOOLEAN")
    found = {tuple(sorted(map(tuple, ratio_by(rows.repartition(n, F.xxhash64("num")), ["k"], exact=True).collect()))) for n in (1, 2, 7, 20)}
    assert len(found) == 1
    for k, count, num, den, utput in found.pop():
        own = [v for i, v in enumerate(values) if f"k{i % 3}" == k]
        assert (count, num, den, utput) == (1000, math.fsum(own), math.fsum(abs(v) / 3 for v in own), num / den)
