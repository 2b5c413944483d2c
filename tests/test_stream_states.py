"""Retractions, last points, late rows and state read back, against plain loops and the batch forms."""

import subprocess
import sys
from collections import Counter

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from rillstat.operators.finalize import latest
from rillstat.operators.ranking import last_points as last_points_of
from rillstat.plans import inputs, jobs
from rillstat.sinks.latest import latest_table
from rillstat.sinks.tables import append_batches, read_batches
from rillstat.sources.files import read_table
from rillstat.sources.topics import Topic, read_topic
from rillstat.streaming import lateness, retractions, runs, series, states

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ordered(spark, tmp_path_factory):
    return inputs.in_order(spark, FOLDER, str(tmp_path_factory.mktemp("ordered")))


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_every_change_takes_the_old_count_away(spark, ordered, tmp_path):
    views = inputs.page_views(spark, ordered, stream=True)
    path, checkpoint = str(tmp_path / "changes"), str(tmp_path / "c")
    runs.drain(jobs.start_count_changes(views, path, checkpoint, window="1 day", every=None, state_partitions=3), timeout=300)
    log = read_batches(spark, path, retractions.CHANGE)
    held = {}
    found = sorted(log.collect(), key=lambda r: (r.batch_id, r.sign))
    assert {r.batch_id for r in found} >= {0, 1, 2, 3} and any(r.sign < 0 for r in found)
    for r in found:
        key = (r.page, r.industry, r.start_time)
        if r.sign < 0:
            assert held.pop(key) == r["count"]
        else:
            assert key not in held
            held[key] = r["count"]
    batch = jobs.article_counts(inputs.page_views(spark, FOLDER), "1 day")
    assert held == {(r.page, r.industry, r.start_time): r["count"] for r in batch.collect()}
    assert rows(retractions.folded(log)) == rows(batch)
    totals = batch.groupBy("industry", "start_time").agg(F.count("*").alias("pages"), F.sum("count").alias("views"))
    assert rows(retractions.industry_totals(log)) == rows(totals)
    state = states.state_table(spark, checkpoint, variable="count")
    assert rows(state) == rows(batch)


def test_a_hot_page_comes_as_one_row_per_arrow_batch():
    import pyarrow as pa

    batch = pa.record_batch({"page": ["p"] * 500 + [None], "industry": ["i"] * 501, "start_time": [1] * 501})
    (counted,) = retractions._counted(iter([batch]))
    assert sorted(counted.to_pylist(), key=str) == [
        {"page": "p", "industry": "i", "start_time": 1, "views": 500}, {"page": None, "industry": "i", "start_time": 1, "views": 1}]


def test_last_points_follow_updates_in_any_order(spark, tmp_path):
    """Late starts, late updates and a series of one point; four files."""
    path, table, checkpoint = (str(tmp_path / name) for name in ("in", "table", "c"))
    for part in range(4):
        df = spark.range(part * 60, part * 60 + 60).select(
            F.expr("CASE WHEN id = 7 THEN 'once' WHEN id % 10 < 7 THEN 'hot' ELSE concat('m', id % 3) END").alias("market"),
            F.expr("1000 * CASE WHEN id % 9 = 0 THEN id div 4 ELSE id div 2 END").alias("start_time"),
            F.col("id").alias("count"), (F.col("id") / 7).alias("utput"), F.expr("id * 7 % 240 + 1000 * (id div 60)").alias("seq"),
        )
        df.coalesce(1).write.mode("append").parquet(path)
    updates = spark.read.parquet(path)
    stream = spark.readStream.schema(updates.schema).option("maxFilesPerTrigger", 1).parquet(path)

    def run(source):
        from rillstat.sinks.latest import upsert_batches

        sink = upsert_batches(table, checkpoint, ["market", "place"], ["start_time", "count", "utput"])
        runs.drain(runs.start(series.last_points(source, 5), sink, checkpoint=checkpoint, output_mode="update", state_partitions=2), timeout=300)

    run(stream)
    schema = "market STRING, place INT, start_time BIGINT, count BIGINT, utput DOUBLE"
    newest = latest(updates, ["market", "start_time"], "seq", ["count", "utput"])
    want = last_points_of(newest, n=5).withColumnRenamed("rank", "place")
    assert rows(latest_table(spark, table, schema)) == rows(want)
    held = states.state_table(spark, checkpoint, variable="points", lists=True)
    assert held.count() == want.count()
    # A restart goes on from the state.
    more = spark.createDataFrame([("once", 5, 1, 0.5, 9000), ("hot", 10**6, 2, 0.25, 9001)], updates.schema)
    more.coalesce(1).write.mode("append").parquet(path)
    run(spark.readStream.schema(updates.schema).option("maxFilesPerTrigger", 1).parquet(path))
    newest = latest(spark.read.parquet(path), ["market", "start_time"], "seq", ["count", "utput"])
    assert rows(latest_table(spark, table, schema)) == rows(last_points_of(newest, n=5).withColumnRenamed("rank", "place"))


def test_an_unchanged_series_is_not_sent():
    class State(list):
        def get(self):
            return iter(self)

        def put(self, rows):
            self[:] = rows

    processor = series.LastPoints(2)
    processor.points = State()
    update = pd.DataFrame({"market": "m", "start_time": [3, 2], "count": 1, "utput": 0.5, "seq": [1, 2]})
    (sent,) = processor.handleInputRows(("m",), iter([update]), None)
    assert sent["place"].tolist() == [1, 2] and sent["start_time"].tolist() == [3, 2]
    old = pd.DataFrame({"market": "m", "start_time": [1], "count": 1, "utput": 0.5, "seq": [9]})
    assert list(processor.handleInputRows(("m",), iter([old]), None)) == []


def test_late_rows_go_aside_by_their_own_market(spark, tmp_path):
    path, closed, late, held, checkpoint = (str(tmp_path / name) for name in ("in", "closed", "late", "held", "c"))
    head = "c,s,d,a,v,R,{},k,e,1,2,3,{},2"
    batches = [
        [("fast", 0.2), ("fast", 0.4), ("slow", 0.1), (None, 0.1)], [("fast", 9.0), ("slow", 0.7)],
        [("fast", 0.3), ("slow", 0.9), ("fast", 8.2), ("fast", 7.1)], [("fast", 8.4), ("slow", 2.4)], [("slow", 2.6)], [("slow", 0.95), ("new", 0.5)],
    ]
    clocks, counts, put_aside = {}, Counter(), Counter()
    for batch in batches:
        values = ", ".join(f"(timestamp_millis({int(at * 1000)}), '{head.format(m or '', 1)}')" for m, at in batch)
        spark.sql(f"SELECT * FROM VALUES {values} t(ts, line)").coalesce(1).write.mode("append").parquet(path)
        for market, at in batch:
            key, start = market or "", int(at) * 1000
            is_late = start + 1500 <= clocks.get(key, -1)
            (put_aside if is_late else counts)[key, start] += 1
        for market, at in batch:
            clocks[market or ""] = max(clocks.get(market or "", -1), int(at * 1000))
    source = read_table(spark, path, stream=True, files_per_trigger=1)
    query = jobs.start_closed_by_market(source, closed, late, held, checkpoint, every=None)
    runs.drain(query, timeout=300)
    names = "market STRING, start_time BIGINT, count BIGINT, numerator DOUBLE, denominator DOUBLE, utput DOUBLE"
    ended = read_batches(spark, closed, names).drop("run", "batch_id")
    still = lateness.open_windows(spark, held, checkpoint, query.lastProgress["batchId"], scale=1000.0)
    assert Counter({(r.market, r.start_time): r["count"] for r in ended.unionByName(still).collect()}) == counts
    assert ended.groupBy("market", "start_time").count().where("count > 1").count() == 0
    assert {(r.market, r.start_time) for r in ended.collect()} == {k for k in counts if k[1] + 1500 <= clocks[k[0]]}
    aside = read_batches(spark, late, "market STRING, region STRING, ts TIMESTAMP, num DOUBLE").collect()
    assert Counter((r.market, r.ts.second * 1000) for r in aside) == put_aside and all(r.region == "R" for r in aside)
    assert put_aside.total() + counts.total() == sum(map(len, batches))


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    held, checkpoint = str(tmp_path / "held"), "c"
    sink = lateness.close_by_key(held, append_batches(str(tmp_path / "closed"), "c"), append_batches(str(tmp_path / "late"), "c"), checkpoint)
    batch = [
        spark.sql(f"SELECT 'm' AS market, timestamp_millis({at}) AS ts, 1D AS num, 2D AS den, true AS counted") for at in (100, 1900, 200, 2600)
    ]
    for number in (0, 0, 1, 1, 2, 2, 3):
        sink(batch[number], number)
    closed = spark.read.parquet(str(tmp_path / "closed"))
    assert sorted((r.start_time, r["count"]) for r in closed.collect()) == [(0, 1), (1000, 1)]
    assert spark.read.parquet(str(tmp_path / "late")).count() == 1
    assert [r["count"] for r in lateness.open_windows(spark, held, checkpoint, 3).collect()] == [1]


def test_state_of_each_batch(spark, ordered, tmp_path):
    checkpoint = str(tmp_path / "c")
    feed = inputs.feed(spark, ordered, stream=True)
    runs.drain(jobs.start_feed_counts(feed, Topic(str(tmp_path / "t")), checkpoint, every=None, state_partitions=3), timeout=300)
    (operator,) = states.state_operators(spark, checkpoint).collect()
    assert operator.operator == 0 and operator.partitions == 3 and operator.last_batch >= 3
    log = read_topic(spark, Topic(str(tmp_path / "t")), stream=False)
    for batch in (0, 2):
        upto = log.where(F.col("seq") <= batch).select(F.col("key").alias("user"), F.col("value").cast("bigint").alias("count"), "seq")
        assert rows(states.state_table(spark, checkpoint, batch=batch)) == rows(latest(upto, ["user"], "seq", ["count"]))
    assert rows(states.state_table(spark, checkpoint)) == rows(jobs.feed_counts(inputs.feed(spark, FOLDER)))


def test_workers_do_not_need_the_package(tmp_path):
    parts = [retractions.CountChanges(), retractions._counted, series.LastPoints(2), series._cut(2)]
    (tmp_path / "parts").write_bytes(cloudpickle.dumps(parts))
    code = """
import pickle, sys
pickle.load(open("parts", "rb"))
assert not any(name.startswith("rillstat") for name in sys.modules)
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)

