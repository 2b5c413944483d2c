"""Every line accounted for, and records that a topic got twice read once."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from rillstat.operators.telemetry import examined, parse_lines, rejects
from rillstat.plans import inputs
from rillstat.sinks.identified import identified, read_once, send_identified
from rillstat.sinks.tables import append_batches
from rillstat.sources.topics import Topic
from rillstat.streaming import parsing, runs

FOLDER = "/root/testdata/sf0.001"


def test_each_line_is_of_one_kind(spark):
    lines = inputs.faulty_telemetry(spark, FOLDER).unionByName(spark.sql("SELECT -1L AS event_id, current_timestamp() AS ts, CAST(NULL AS STRING) AS line"))
    kinds = Counter(r.kind for r in examined(lines).select("kind").collect())
    assert kinds["parsed"] == parse_lines(lines).count() and kinds["rejected"] == rejects(lines).count()
    assert kinds["empty"] == lines.where("line = '' OR line IS NULL").count() and kinds.total() == lines.count()


def test_a_repeated_batch_of_lines_is_left_alone(spark, tmp_path):
    path = str(tmp_path)
    sink, lines = parsing.parse_batches(path, "c"), inputs.faulty_telemetry(spark, FOLDER)
    sink(lines, 0)
    sink(lines.limit(3), 0)
    sink(lines.limit(5), 1)
    counts = {r.batch_id: r for r in parsing.line_counts(spark, path).collect()}
    assert [counts[b].lines for b in (0, 1)] == [lines.count(), 5]
    assert all(r.parsed + r.rejected + r.empty == r.lines for r in counts.values())
    rejected = parsing.lines_of(spark, path, "rejected", "event_id BIGINT, line STRING")
    assert rejected.count() == sum(r.rejected for r in counts.values())
    with pytest.raises(ValueError, match="kind"):
        parsing.lines_of(spark, path, "bad", "line STRING")


def test_ids_are_those_of_the_batch_and_differ_in_it(spark):
    batch = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", None), (None, "1"), (None, None)], "key STRING, value STRING")
    first = Counter(r.record_id for r in identified(batch, "c", 3).collect())
    again = Counter(r.record_id for r in identified(batch.repartition(3), "c", 3).collect())
    assert first == again and max(first.values()) == 1
    assert not set(first) & {r.record_id for r in identified(batch, "c", 4).collect()}
    assert not set(first) & {r.record_id for r in identified(batch, "d", 3).collect()}


def test_a_topic_with_doubled_batches_gives_the_single_result(spark, tmp_path):
    topic, out, checkpoint = Topic(str(tmp_path / "topic"), options={"maxFilesPerTrigger": "1"}), str(tmp_path / "out"), str(tmp_path / "c")
    send = send_identified(topic, "sender")
    for number, hour in enumerate((1, 1, 5, 9)):
        batch = spark.range(4).select(
            (F.col("id") % 2).cast("string").alias("key"), F.lit("v").alias("value"), F.timestamp_seconds(F.lit(hour * 3600)).alias("ts")
        ).coalesce(1)
        for _ in range(2):
            send(batch, number)
    query = runs.start(read_once(spark, topic, "1 hour"), append_batches(out, checkpoint), checkpoint=checkpoint, state_partitions=2)
    runs.drain(query, timeout=200)
    rows = spark.read.parquet(out)
    assert rows.count() == 16 == rows.select("record_id").distinct().count()
    # What the watermark has passed is forgotten.
    assert sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]) <= 8
