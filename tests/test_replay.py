"""Line files sent by the line, against plain loops over the files."""

import time
from collections import Counter

import pytest

from rillstat.__main__ import main
from rillstat.sinks.tables import read_batches
from rillstat.sources.topics import Topic, read_topic
from rillstat.streaming import replay as rp

SENT = "key STRING, value STRING, ts TIMESTAMP, lane STRING, number BIGINT"

#: Lines of each file; the files of a tag follow each other by name.
FILES = {"A_1.csv": 700, "A_2.csv": 55, "B_1.csv": 333, "C_1.csv": 1}


@pytest.fixture
def lanes(tmp_path):
    """The folder of the files, and the lines of each tag in order."""
    folder, expected = tmp_path / "csv", {}
    folder.mkdir()
    for name, count in FILES.items():
        lines = [f'{name},{i},"é{"x" * (i % 40)}' for i in range(count)]
        (folder / name).write_text("\n".join(["head,er,x", *lines, ""]))
        expected.setdefault(name[0], []).extend(lines)
    return str(folder), expected


@pytest.fixture
def numbered(spark, lanes, tmp_path, monkeypatch):
    """The folder of the numbered lines, read in many blocks and written in small slices."""
    monkeypatch.setattr(rp, "SLICE_LINES", 100)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        rp.number_lines(spark, lanes[0], str(tmp_path / "numbered"), header=True, tag=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return str(tmp_path / "numbered")


def _lanes(rows, line="line"):
    return {
        lane: [row[line] for row in sorted((r for r in rows if r["lane"] == lane), key=lambda r: r["number"])]
        for lane in {row["lane"] for row in rows}
    }


def test_lines_are_numbered_in_the_order_of_their_files(spark, lanes, numbered):
    rows = spark.read.parquet(numbered).collect()
    assert _lanes(rows) == lanes[1]
    assert all(row["slice"] == row["number"] // 100 and row["key"] == row["lane"] for row in rows)
    assert Counter((row["lane"], row["number"]) for row in rows) == Counter(
        (lane, i) for lane, lines in lanes[1].items() for i in range(len(lines))
    )
    assert rp.last_number(spark, numbered) == 754


def test_without_tags_each_file_is_a_lane(spark, lanes, tmp_path):
    rp.number_lines(spark, lanes[0], str(tmp_path / "n"), header=True)
    rows = spark.read.parquet(str(tmp_path / "n")).collect()
    assert sorted(len(lines) for lines in _lanes(rows).values()) == sorted(FILES.values())
    assert {row["key"] for row in rows} == {None}


def test_a_tick_reads_its_own_slices(spark, numbered):
    rows = rp.lines_between(spark, numbered, 295, 304)
    assert Counter(row["number"] for row in rows.collect()) == Counter({n: 2 for n in range(295, 304 + 1)})
    plan = rows._jdf.queryExecution().executedPlan().toString()
    partition = plan[plan.index("PartitionFilters"):]
    assert "slice" in partition[:partition.index("]")] and "GreaterThanOrEqual(number,295)" in plan


def test_a_run_that_broke_goes_on_with_the_next_line(spark, lanes, numbered, tmp_path, monkeypatch):
    topic, checkpoint, send = Topic(str(tmp_path / "sent")), str(tmp_path / "c"), rp.send_records

    def breaking(results, at):
        def sink(batch, batch_id):
            if batch_id == 2:
                raise RuntimeError("the broker is gone")
            send(results, at)(batch, batch_id)
        return sink

    monkeypatch.setattr(rp, "send_records", breaking)
    with pytest.raises(Exception, match="the broker is gone"):
        rp.replay(spark, numbered, topic, checkpoint, lines_per_tick=120, every=None)
    monkeypatch.setattr(rp, "send_records", send)
    rp.replay(spark, numbered, topic, checkpoint, lines_per_tick=120, every=None)
    rows = read_batches(spark, topic.name, SENT).collect()
    assert _lanes(rows, "value") == lanes[1]
    assert len(rows) == sum(FILES.values())
    assert all(row["batch_id"] == row["number"] // 120 for row in rows)
    # At the end there is nothing more to send.
    rp.replay(spark, numbered, topic, checkpoint, lines_per_tick=120, every=None)
    assert read_batches(spark, topic.name, SENT).count() == len(rows)


def test_lines_follow_the_clock(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    for tag, count in (("A", 20), ("B", 7)):
        (tmp_path / "csv" / f"{tag}_1.csv").write_text("".join(f"{tag}{i}\n" for i in range(count)))
    folder, topic = str(tmp_path / "n"), Topic(str(tmp_path / "sent"))
    rp.number_lines(spark, str(tmp_path / "csv"), folder, tag=True)
    began = time.monotonic()
    rp.replay(spark, folder, topic, str(tmp_path / "c"), lines_per_tick=5, every="2 seconds")
    assert time.monotonic() - began > 4
    rows = read_batches(spark, topic.name, SENT).collect()
    assert Counter((row["lane"], row["batch_id"]) for row in rows) == {
        **{("A", tick): 5 for tick in range(4)}, ("B", 0): 5, ("B", 1): 2,
    }
    at = [min(row["ts"] for row in rows if row["batch_id"] == tick) for tick in range(4)]
    # The first tick may come late in its interval, as it starts the clock; the others keep to theirs.
    assert all((b - a).total_seconds() > 1 for a, b in zip(at[1:], at[2:]))


def test_replay_from_the_command_line(spark, lanes, tmp_path):
    output = str(tmp_path / "sent")
    main(["replay", "--input", lanes[0], "--output", output, "--header", "--tag", "--once", "--lines-per-tick", "400",
          "--checkpoint", str(tmp_path / "c")])
    records = read_topic(spark, Topic(output), stream=False).collect()
    assert Counter((row["key"], row["value"]) for row in records) == Counter((tag, line) for tag, lines in lanes[1].items() for line in lines)
