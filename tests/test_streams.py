"""Streams over ordered files against the batch form of the same work."""

import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F

from rillstat.operators.aggregates import ratio_by
from rillstat.operators.finalize import final_windows, latest
from rillstat.operators.ranking import top_pages
from rillstat.operators.telemetry import parse_lines
from rillstat.plans import inputs, jobs
from rillstat.sinks.tables import append_batches, latest_rows, read_batches
from rillstat.sources.files import read_table
from rillstat.sources.topics import Topic, read_topic
from rillstat.streaming import publishing, rankings, runs

FOLDER = "/root/testdata/sf0.001"


def write_in_order(df, path, files=3):
    """The rows as files that a stream reads one after the other, in order of ts."""
    bounds = df.select(F.unix_micros("ts").alias("t")).approxQuantile("t", [i / files for i in range(files + 1)], 0.001)
    for i in range(files):
        low, high = bounds[i] if i else -1, bounds[i + 1] if i < files - 1 else 2**62
        part = df.where((F.unix_micros("ts") > low) & (F.unix_micros("ts") <= high))
        part.coalesce(1).write.mode("append").parquet(path)


def in_order(spark, df, path):
    write_in_order(df, path)
    return lambda: read_table(spark, path, stream=True, files_per_trigger=1)


def rows_of(df, places=9):
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    df = df.withColumns({name: F.round(name, places).cast("string") for name in doubles})
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_ratio_windows_are_appended_when_closed(spark, tmp_path):
    lines = inputs.telemetry(spark, FOLDER)
    source = in_order(spark, lines, str(tmp_path / "in"))
    out, checkpoint, closing = (str(tmp_path / name) for name in ("out", "checkpoint", "closing"))

    def build():
        rows = runs.closable(parse_lines(source()).drop("event_id"), closing)
        return ratio_by(rows, ["market"], every="1 hour", lateness="500 milliseconds"), append_batches(out, checkpoint)

    runs.drain(runs.start(*build(), checkpoint=checkpoint), timeout=200)
    names = "market STRING, start_time BIGINT, count BIGINT, numerator DOUBLE, denominator DOUBLE, utput DOUBLE"
    batch = ratio_by(parse_lines(lines), ["market"], every="1 hour")
    open_windows = batch.count() - read_batches(spark, out, names).count()
    assert open_windows > 0
    runs.run_to_close(spark, build, closing, checkpoint)
    stream = read_batches(spark, out, names).drop("run", "batch_id")
    assert rows_of(stream) == rows_of(batch)


def test_counts_are_updated_and_resumed(spark, tmp_path):
    feed = inputs.feed(spark, FOLDER)
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    topic = Topic(str(tmp_path / "topic"))
    thirds = feed.withColumn("third", F.ntile(3).over(Window.orderBy("ts")))
    for third in (1, 2, 3):
        thirds.where(F.col("third") == third).drop("third").coalesce(1).write.mode("append").parquet(path)
        if third == 1:
            continue
        source = read_table(spark, path, stream=True, files_per_trigger=1)
        runs.drain(jobs.start_feed_counts(source, topic, checkpoint, every=None), timeout=200)
    records = read_topic(spark, topic, stream=False)
    batches = spark.read.parquet(topic.name).select("batch_id").distinct().count()
    assert batches == 3
    updates = records.select(F.col("key").alias("user"), F.col("value").cast("bigint").alias("count"), "seq")
    assert updates.count() > updates.select("user").distinct().count()
    assert rows_of(latest(updates, ["user"], "seq", ["count"])) == rows_of(jobs.feed_counts(feed))


def test_fresh_checkpoint_starts_without_state(spark, tmp_path):
    folder = str(tmp_path / "checkpoints")
    assert runs.checkpoint_at(folder) == runs.checkpoint_at(folder)
    fresh = runs.checkpoint_at(folder, fresh=True)
    assert runs.checkpoint_at(folder) == fresh != runs.checkpoint_at(folder, fresh=True)
    source = in_order(spark, inputs.feed(spark, FOLDER), str(tmp_path / "in"))
    topic = Topic(str(tmp_path / "topic"))
    for fresh in (False, False, True):
        query = jobs.start_feed_counts(source(), topic, runs.checkpoint_at(folder, fresh), every=None)
        runs.drain(query, timeout=200)
    per_run = spark.read.parquet(topic.name).groupBy("run").count().collect()
    assert len(per_run) == 2 and len({r["count"] for r in per_run}) == 1


def test_late_rows_do_not_get_into_closed_windows(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    head = "c,s,d,a,v,R,M,k,e,1,2,3,"
    # A batch still takes what was late only by the batch right before it.
    for at in ("00:00:00.2", "00:00:09", "00:00:12", "00:00:00.3", "00:00:30"):
        row = spark.sql(f"SELECT TIMESTAMP'2024-01-01 {at}' AS ts, '{head}1,1' AS line")
        row.coalesce(1).write.mode("append").parquet(path)
    ratios = jobs.market_ratios(read_table(spark, path, stream=True, files_per_trigger=1))
    runs.drain(runs.start(ratios, append_batches(out, checkpoint), checkpoint=checkpoint), timeout=200)
    rows = spark.read.parquet(out).orderBy("start_time").collect()
    assert [(r.start_time - 1704067200000, r["count"]) for r in rows] == [(0, 1), (9000, 1), (12000, 1)]


def test_late_rows_within_the_lateness_are_kept(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    head = "c,s,d,a,v,R,M,k,e,1,2,3,"
    for at in ("00:00:00.2", "00:00:01.3", "00:00:00.9", "00:00:20"):
        row = spark.sql(f"SELECT TIMESTAMP'2024-01-01 {at}' AS ts, '{head}1,1' AS line")
        row.coalesce(1).write.mode("append").parquet(path)
    ratios = jobs.market_ratios(read_table(spark, path, stream=True, files_per_trigger=1))
    runs.drain(runs.start(ratios, append_batches(out, checkpoint), checkpoint=checkpoint), timeout=200)
    rows = spark.read.parquet(out).orderBy("start_time").collect()
    assert [(r.start_time - 1704067200000, r["count"]) for r in rows] == [(0, 2), (1000, 1)]


def test_publication_over_restarts(spark, tmp_path):
    lines = inputs.telemetry(spark, FOLDER)
    topic = Topic(str(tmp_path / "ratios"), options={"maxFilesPerTrigger": "4"})
    source = in_order(spark, lines, str(tmp_path / "in"))
    points, checkpoint = str(tmp_path / "points"), str(tmp_path / "checkpoint")
    ratios = jobs.start_market_ratios(
        source(), topic, str(tmp_path / "ratio-checkpoint"), window="1 hour", every=None, name=None
    )
    runs.drain(ratios, timeout=200)
    query = jobs.start_publication(read_topic(spark, topic), points, checkpoint, every=None)
    runs.drain(query, timeout=200)
    # An update of a window long published, and a new window that releases one more.
    last = lines.agg(F.unix_millis(F.max("ts"))).first()[0]
    late = spark.createDataFrame(
        [("M1", '{"market":"M1", "start_time":"1000", "count":"7", "UTput":"0.5"}'),
         ("M1", f'{{"market":"M1", "start_time":"{last + 3600000}", "count":"1", "UTput":"2.0"}}')],
        "key STRING, value STRING",
    ).withColumn("ts", F.current_timestamp())
    late.coalesce(1).write.parquet(f"{topic.name}/run=late/batch_id=0")
    runs.drain(jobs.start_publication(read_topic(spark, topic), points, checkpoint, every=None), timeout=200)
    table = latest_rows(spark, points, jobs.POINT, ["market", "start_time"], ["count", "utput"], "seq")
    updates = jobs.ratio_updates(read_topic(spark, topic, stream=False))
    newest = latest(updates, ["market", "start_time"], "seq", ["count", "utput"])
    assert rows_of(table) == rows_of(final_windows(newest))
    assert table.where("start_time = 1000").first()["count"] == 7
    assert jobs.published_points(updates).drop("message").count() == table.count()
    assert read_batches(spark, points, jobs.POINT).where("message = 'M1,0.5,1000'").count() == 1


def test_articles_are_ranked_when_closed(spark, tmp_path):
    views = inputs.page_views(spark, FOLDER)
    source = in_order(spark, views, str(tmp_path / "in"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    counts = jobs.article_counts(source(), every="1 day", lateness="1 hour")
    sink = rankings.rank_closed(append_batches(out, checkpoint), 3)
    runs.drain(runs.start(counts, sink, checkpoint=checkpoint), timeout=200)
    stream = read_batches(spark, out, rankings.TOP).drop("run", "batch_id")
    last = views.agg(F.unix_millis(F.max("ts"))).first()[0]
    closed = F.col("start_time") + 86_400_000 + 3_600_000 <= last
    batch = top_pages(jobs.article_counts(views, every="1 day"), 3).where(closed)
    assert batch.count() > 50
    assert rows_of(stream) == rows_of(batch)


@pytest.mark.parametrize("window, n", [("1 hour", 100), ("30 days", 3)])
def test_articles_are_ranked_early(spark, tmp_path, window, n):
    views = inputs.page_views(spark, FOLDER)
    source = in_order(spark, views, str(tmp_path / "in"))
    out, held, checkpoint = (str(tmp_path / name) for name in ("out", "held", "checkpoint"))
    counts = jobs.article_counts(source(), every=window, lateness="1 hour")
    closed_after = 3_600_000 + (3_600_000 if window == "1 hour" else 30 * 86_400_000)
    sink = rankings.rank_updates(held, append_batches(out, checkpoint), checkpoint, n, closed_after)
    runs.drain(runs.start(counts, sink, checkpoint=checkpoint, output_mode="update"), timeout=200)
    log = read_batches(spark, out, rankings.TOP)
    assert log.select("batch_id").distinct().count() == 3
    stream = rankings.latest_rankings(log).drop("run", "batch_id")
    assert rows_of(stream) == rows_of(top_pages(jobs.article_counts(views, every=window), n))


def test_early_ranking_with_a_row_late_by_one_batch(spark, tmp_path):
    """Such a row still counts, so its window must not have been dropped."""
    path, out, held, checkpoint = (str(tmp_path / name) for name in ("in", "out", "held", "checkpoint"))
    views = [("01:10", "a"), ("01:20", "a"), ("09:00", "b"), ("01:30", "c"), ("12:00", "d"), ("14:00", "e")]
    files = [views[:2], views[2:3], views[3:4], views[4:5], views[5:]]
    for rows in files:
        values = ", ".join(f"(TIMESTAMP'2024-01-01 {at}', '{page}', 'i', 'ARTICLE')" for at, page in rows)
        df = spark.sql(f"SELECT * FROM VALUES {values} t(ts, page, industry, flags)")
        df.coalesce(1).write.mode("append").parquet(path)
    source = read_table(spark, path, stream=True, files_per_trigger=1)
    counts = jobs.article_counts(source, lateness="1 hour")
    sink = rankings.rank_updates(held, append_batches(out, checkpoint), checkpoint, 100, 2 * 3_600_000)
    runs.drain(runs.start(counts, sink, checkpoint=checkpoint, output_mode="update"), timeout=200)
    stream = rankings.latest_rankings(read_batches(spark, out, rankings.TOP)).drop("run", "batch_id")
    assert rows_of(stream) == rows_of(jobs.top_articles(spark.read.parquet(path)))
    # Of the windows, only those that may still change are carried on.
    slots = spark.read.parquet(held).groupBy("slot").agg(F.countDistinct("start_time").alias("windows")).collect()
    assert max(r.windows for r in slots) < 4


def test_article_job_writes_texts(spark, tmp_path):
    views = inputs.page_views(spark, FOLDER)
    source = in_order(spark, views, str(tmp_path / "in"))
    topic = Topic(str(tmp_path / "topic"))
    query = jobs.start_top_articles(
        source(), topic, str(tmp_path / "checkpoint"), early=str(tmp_path / "held"), every=None
    )
    runs.drain(query, timeout=200)
    records = read_topic(spark, topic, stream=False)
    newest = {r.key: r.value for r in latest(records, ["key"], "seq", ["value"]).collect()}
    expected = {r.key: r.value for r in jobs.top_article_records(jobs.top_articles(views)).collect()}
    assert newest == expected


def test_interval_trigger_and_name(spark, tmp_path):
    source = in_order(spark, inputs.telemetry(spark, FOLDER), str(tmp_path / "in"))
    topic = Topic(str(tmp_path / "topic"))
    query = jobs.start_market_ratios(source(), topic, str(tmp_path / "checkpoint"), every="100 milliseconds")
    try:
        assert query.name == "market-ratios"
        query.processAllAvailable()
    finally:
        query.stop()
    assert read_topic(spark, topic, stream=False).count() > 0


def test_timeout_stops_the_stream(spark, tmp_path):
    source = spark.readStream.format("rate").load()
    query = runs.start(source, lambda batch, _: None, checkpoint=str(tmp_path / "c"), every="1 second")
    with pytest.raises(TimeoutError):
        runs.drain(query, timeout=0.5)
    assert not query.isActive


def test_settings_are_given_back(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    source = spark.readStream.format("rate").load()
    query = runs.start(
        source, lambda batch, _: None, checkpoint=str(tmp_path / "c"), every="1 second", state_partitions=3
    )
    query.stop()
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_workers_do_not_need_the_package(tmp_path):
    parts = [publishing.HeldWindows(2), publishing._mark(2, 8)]
    (tmp_path / "parts").write_bytes(cloudpickle.dumps(parts))
    code = """
import pickle, sys
import pandas as pd
processor, mark = pickle.load(open("parts", "rb"))
assert not any(name.startswith("rillstat") for name in sys.modules)
class State(list):
    get = lambda self: iter(self)
    put = lambda self, rows: self.__setitem__(slice(None), rows)
processor.state = State()
rows = pd.DataFrame({"market": "m", "start_time": [1, 2, 3], "count": 1, "utput": 0.5, "seq": [1, 2, 3]})
(marked,) = mark(iter([rows]))
assert (marked["part"] == -1).tolist() == [False, True, True]
(out,) = processor.handleInputRows(("m", -1), iter([rows]), None)
assert out.values.tolist() == [["m", 1, 1, 0.5, 1]] and len(processor.state) == 2
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_older_update_does_not_replace_a_held_one():
    held = {}
    publishing.arrive(held, 1, ("new", 5), 2)
    publishing.arrive(held, 1, ("old", 4), 2)
    assert held == {1: ("new", 5)}


def test_publication_of_a_backlog_with_a_hot_key(spark, tmp_path):
    """Two batches of many updates each, most of them of one key, in no order."""
    path, points, checkpoint = (str(tmp_path / name) for name in ("in", "points", "checkpoint"))
    for low, high in ((0, 2000), (1500, 4000)):
        df = spark.range(low * 10, high * 10).select(
            F.expr("CASE WHEN id % 10 < 8 THEN 'hot' ELSE concat('m', id % 3) END").alias("key"),
            F.expr("""concat('{"market":"', CASE WHEN id % 10 < 8 THEN 'hot' ELSE concat('m', id % 3) END,
                '", "start_time":"', 1000 * (id div 10), '", "count":"1", "UTput":"', id / 7, '"}')""").alias("value"),
            F.expr(f"timestamp_micros({low} + id % 10)").alias("ts"),
        )
        # Of each window the updates differ in time, so that one is the last.
        df.orderBy(F.xxhash64("value")).coalesce(2).write.mode("append").parquet(path)
    for _ in range(2):
        records = read_topic(spark, Topic(path, options={"maxFilesPerTrigger": "2"}))
        runs.drain(jobs.start_publication(records, points, checkpoint, every=None), timeout=200)
    log = read_batches(spark, points, jobs.POINT)
    assert log.groupBy("market", "start_time", "batch_id").count().where("count > 1").count() == 0
    table = latest_rows(spark, points, jobs.POINT, ["market", "start_time"], ["count", "utput"], "seq")
    updates = jobs.ratio_updates(read_topic(spark, Topic(path), stream=False))
    expected = jobs.published_points(updates).drop("message")
    assert expected.where("market = 'hot'").count() == 4000 - 2
    assert rows_of(table) == rows_of(expected)
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "held").load()
    assert state.count() == 4 * 2
