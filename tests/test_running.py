"""Changelogs and publication logs against a plain loop, with a key that has most rows and lies in several ranges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rillstat.operators import publications, running
from rillstat.operators.publications import publication_log
from rillstat.operators.running import RANGE, in_ranges, running_ratios
from rillstat.session import settings

MANY = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def hot(random_):
    return "hot" if random_.random() < 0.7 else f"k{random_.randrange(4)}"


def test_a_hot_key_has_several_ranges(spark):
    with settings(spark, MANY):
        rows = spark.range(2000).selectExpr("IF(id % 10 < 8, 'hot', concat('k', id % 3)) AS k", "id AS seq")
        placed = in_ranges(rows, ["k"], ["seq"])
        assert placed.where("k = 'hot'").select(RANGE).distinct().count() > 3
        ends = placed.groupBy("k", RANGE).agg(F.min("seq").alias("low"), F.max("seq").alias("high")).collect()
        for a in ends:
            assert all(a[1] <= b[1] or a["low"] > b["high"] for b in ends if a["k"] == b["k"] and a[1] != b[1])


def test_running_ratios_are_those_of_a_loop(spark):
    random_ = random.Random(3)
    rows = [(hot(random_) if i % 50 else None, i, random_.uniform(-5, 1e6), random_.random(), f"c{i}") for i in range(1500)]
    state, want = {}, set()
    for k, seq, num, den, other in rows:
        held = state.setdefault(k, ([], []))
        held[0].append(num)
        held[1].append(den)
        want.add((k, seq, other, len(held[0]), math.fsum(held[0]), math.fsum(held[1])))
    random_.shuffle(rows)
    with settings(spark, MANY):
        table = spark.createDataFrame(rows, "k STRING, seq BIGINT, num DOUBLE, den DOUBLE, other STRING")
        found = running_ratios(table, ["k"], ["seq"], ["other"])
        assert found.columns == ["k", "seq", "other", "count", "numerator", "denominator"]
        assert {tuple(r) for r in found.collect()} == want


def test_two_keys_and_an_empty_table(spark):
    table = spark.createDataFrame([("a", 1, 1, 1.0, 2.0), ("a", 2, 1, 3.0, 4.0), ("a", 1, 2, 5.0, 6.0)], "a STRING, b INT, seq BIGINT, num DOUBLE, den DOUBLE")
    assert {tuple(r)[2:] for r in running_ratios(table, ["a", "b"], ["seq"]).collect()} == {(1, 1, 1.0, 2.0), (1, 1, 3.0, 4.0), (2, 2, 6.0, 8.0)}
    assert running_ratios(table.limit(0), ["a", "b"], ["seq"]).count() == 0


def published(rows, lag):
    """A consumer that holds windows by key, update by update."""
    held, log = {}, []
    for market, start, seq, count, utput in sorted(rows, key=lambda r: r[2]):
        if market is None or start is None:
            continue
        windows = held.setdefault(market, {})
        windows[start] = (count, utput)
        if len(windows) > lag:
            oldest = min(windows)
            log.append((market, oldest, *windows.pop(oldest), seq))
    return sorted(log)


def updates(seed, count=900, starts=40):
    random_ = random.Random(seed)
    rows = []
    for i in range(count):
        start = i * starts // count + random_.choice((0, 0, 0, 1, -1, -5, -20))
        rows.append((hot(random_), start, 3 * i + random_.randrange(3), i, random_.random()))
    random_.shuffle(rows)
    return rows


TYPES = "market STRING, start_time BIGINT, seq BIGINT, count BIGINT, utput DOUBLE"


@pytest.mark.parametrize("lag", [1, 2, 3, 5])
def test_the_log_is_that_of_a_consumer(spark, lag):
    rows = updates(lag) + [(None, 5, 10_000, 1, 0.5), ("hot", None, 10_001, 1, 0.5)]
    with settings(spark, MANY):
        log = publication_log(spark.createDataFrame(rows, TYPES), lag=lag)
        assert log.columns == ["market", "start_time", "count", "utput", "seq"]
        found = sorted(map(tuple, log.collect()))
    assert found == published(rows, lag)
    assert len(found) > len({r[:2] for r in found}) > 0  # some windows more than once


def test_one_window_with_most_updates(spark):
    """The value asked for may lie several ranges back."""
    rows = [("m", 7, i, i, i / 2) for i in range(600)] + [("m", 8, 700, 1, 1.0), ("m", 9, 800, 2, 2.0), ("m", 7, 900, 3, 3.0), ("m", 7, 901, 4, 4.0)]
    with settings(spark, MANY):
        found = sorted(map(tuple, publication_log(spark.createDataFrame(rows, TYPES)).collect()))
    assert found == published(rows, 2) == [("m", 7, 3, 3.0, 900), ("m", 7, 4, 4.0, 901), ("m", 7, 599, 299.5, 800)]


def test_null_values_are_published_too(spark):
    rows = [("m", 1, 1, None, 0.5), ("m", 2, 2, 1, None), ("m", 1, 3, None, None), ("m", 3, 4, 1, 1.0)]
    assert [tuple(r) for r in publication_log(spark.createDataFrame(rows, TYPES)).collect()] == [("m", 1, None, None, 4)]


def test_no_updates_and_no_lag(spark):
    empty = spark.createDataFrame([], TYPES)
    assert publication_log(empty).count() == 0
    with pytest.raises(ValueError, match="lag"):
        publication_log(empty, lag=0)


@pytest.mark.parametrize("work", [running_ratios, publication_log])
def test_no_window_spans_a_whole_key(spark, work, monkeypatch):
    """Windows over rows are cut by range; only the tables of one row per key and range are not."""
    seen = []
    for module in (running, publications):
        plain = module.Window.partitionBy
        monkeypatch.setattr(module.Window, "partitionBy", staticmethod(lambda *c, plain=plain: seen.append(c) or plain(*c)))
    rows = spark.createDataFrame([("m", 1, 1, 1, 0.5, 1.0, 1.0)], f"{TYPES}, num DOUBLE, den DOUBLE")
    made = work(rows, ["market"], ["seq"]) if work is running_ratios else work(rows)
    text = made._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in text.splitlines() if " Window " in line]
    assert seen and windows and all(RANGE in line for line in windows)
