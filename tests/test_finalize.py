import random
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from rillstat.operators import finalize
from rillstat.streaming.publishing import arrive


def consume(updates, lag=2):
    """All publications of a consumer that takes ``(key, start, value)`` in order."""
    held, published = defaultdict(dict), []
    for seq, (key, start, value) in enumerate(updates):
        window = arrive(held[key], start, (value, seq), lag)
        if window:
            published.append((key, window[0], window[1][0]))
    return published


def test_published_when_two_later_ones_came():
    assert consume([("m", 1, "a"), ("m", 2, "b")]) == []
    assert consume([("m", 1, "a"), ("m", 2, "b"), ("m", 3, "c")]) == [("m", 1, "a")]


def test_published_again_on_a_late_update():
    updates = [("m", 1, "a"), ("m", 2, "b"), ("m", 3, "c"), ("m", 1, "A")]
    assert consume(updates) == [("m", 1, "a"), ("m", 1, "A")]


def test_held_window_takes_the_later_value():
    assert consume([("m", 1, "a"), ("m", 2, "b"), ("m", 1, "A"), ("m", 3, "c")]) == [("m", 1, "A")]


def test_keys_do_not_mix():
    assert consume([("m", 1, "a"), ("n", 2, "b"), ("m", 3, "c"), ("n", 4, "d")]) == []


@given(st.lists(st.tuples(st.sampled_from("mn"), st.integers(0, 8), st.integers(0, 99)), max_size=60), st.integers(1, 3))
def test_in_the_end_all_but_the_latest_are_published(updates, lag):
    last = {(key, start): value for key, start, value in updates}
    expected = {}
    for key in "mn":
        starts = sorted(start for k, start in last if k == key)
        expected |= {(key, start): last[key, start] for start in starts[:-lag]}
    assert {(key, start): value for key, start, value in consume(updates, lag)} == expected


@pytest.mark.parametrize("lag", [1, 2, 5])
def test_table_form_against_the_consumer(spark, lag):
    rng = random.Random(lag)
    updates = [(rng.choice(["hot"] * 8 + ["a", "b", "c"]), rng.randrange(400), rng.random()) for _ in range(3000)]
    rows = [(key, start, value, seq) for seq, (key, start, value) in enumerate(updates)]
    df = spark.createDataFrame(rows, "market STRING, start_time BIGINT, utput DOUBLE, seq BIGINT")
    newest = finalize.latest(df, ["market", "start_time"], "seq", ["utput"])
    got = {(r.market, r.start_time): r.utput for r in finalize.final_windows(newest, lag=lag).collect()}
    assert got == {(key, start): value for key, start, value in consume(updates, lag)}


def test_latest_is_a_hash_aggregation(spark):
    df = spark.createDataFrame([("m", 1, 0.5, 0)], "market STRING, start_time BIGINT, utput DOUBLE, seq BIGINT")
    plan = finalize.latest(df, ["market", "start_time"], "seq", ["utput"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == 2


def test_keys_of_null_and_of_few_windows(spark):
    rows = [(None, 1), (None, 2), (None, 3), ("a", 1), ("a", 2), ("b", 1)]
    df = spark.createDataFrame(rows, "market STRING, start_time BIGINT")
    assert [tuple(r) for r in finalize.final_windows(df).collect()] == [(None, 1)]


def test_without_broadcast(spark):
    rows = [("hot", i) for i in range(5000)] + [(f"k{i % 100}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "market STRING, start_time BIGINT")
    before = {n: spark.conf.get(n, None) for n in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for name in before:
        spark.conf.set(name, "-1")
    try:
        final = finalize.final_windows(df)
        assert "SortMergeJoin" in final._jdf.queryExecution().executedPlan().toString()
        assert final.where("market = 'hot'").count() == 4998
        assert final.count() == 4998 + 300
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
