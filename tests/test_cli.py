"""The jobs as started from the command line, on folders."""

import pytest
from pyspark.sql import functions as F

from rillstat import __main__ as cli
from rillstat.__main__ import main
from rillstat.functions.longs import long_bytes
from rillstat.operators.finalize import latest
from rillstat.plans import inputs, jobs
from rillstat.sources.topics import Topic, read_topic

FOLDER = "/root/testdata/sf0.001"


def test_ratios_from_line_files_then_publication(spark, tmp_path):
    files = tmp_path / "csv"
    files.mkdir()
    head = "c,s,d,a,v,R,{market},k,e,1,2,3,{num},2"
    for market in ("Oregon", "Colorado"):
        lines = "\n".join(head.format(market=market, num=i) for i in range(10))
        (files / f"{market}_20170708.csv").write_text(f"header\n{lines}\n")
    ratios, points = str(tmp_path / "ratios"), str(tmp_path / "points")
    main(["ratios", "--input", str(files), "--output", ratios, "--header", "--once",
          "--checkpoint", str(tmp_path / "c1"), "--files-per-trigger", "1"])
    updates = jobs.ratio_updates(read_topic(spark, Topic(ratios), stream=False)).collect()
    assert {(r.market, r["count"], r.utput) for r in updates} == {("Oregon", 10, 0.00225), ("Colorado", 10, 0.00225)}
    main(["publish", "--input", ratios, "--output", points, "--once", "--checkpoint", str(tmp_path / "c2")])
    main(["date-ratios", "--input", str(files), "--output", str(tmp_path / "dates"), "--header", "--tag", "--once",
          "--checkpoint", str(tmp_path / "c3")])
    records = {r.key: r.value for r in read_topic(spark, Topic(str(tmp_path / "dates")), stream=False).collect()}
    assert records["Date:Oregon_Region:R_Market:Oregon"] == '{"count":"10", "UTput":"2.25"}'


def test_synthetic_views_to_top_articles(spark, tmp_path):
    views, top = str(tmp_path / "views"), str(tmp_path / "top")
    main(["views", "--output", views, "--runs", "20", "--seed", "5"])
    main(["articles", "--input", views, "--output", top, "--once", "--checkpoint", str(tmp_path / "c"),
          "--early", str(tmp_path / "held")])
    newest = {r.key: r.value for r in latest(read_topic(spark, Topic(top), stream=False), ["key"], "seq", ["value"]).collect()}
    expected = {r.key: r.value for r in jobs.top_article_records(jobs.top_articles(spark.read.parquet(views))).collect()}
    assert newest == expected and len(expected) == 5


def test_synthetic_items_to_counts(spark, tmp_path):
    items, counts = str(tmp_path / "items"), str(tmp_path / "counts")
    main(["items", "--output", items, "--runs", "3"])
    main(["feed", "--input", items, "--output", counts, "--once", "--checkpoint", str(tmp_path / "c")])
    got = {r.key: int(r.value) for r in read_topic(spark, Topic(counts), stream=False).collect()}
    assert got == {r.user: r["count"] for r in jobs.feed_counts(spark.read.parquet(items)).collect()}


def test_articles_from_a_topic_need_a_schema(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "read_topic", lambda *args, **options: spark.range(1))
    with pytest.raises(SystemExit, match="--schema"):
        cli.main(["articles", "--servers", "h:9092", "--input", "v", "--output", "o", "--checkpoint", str(tmp_path / "c")])
    with pytest.raises(SystemExit, match="--schema-id"):
        cli.main(["views", "--servers", "h:9092", "--output", "v"])


def test_show_prints_records(spark, tmp_path, capfd):
    records = spark.sql("SELECT 'u@5' AS key, 'page' AS value, current_timestamp() AS ts")
    records.write.parquet(str(tmp_path / "top"))
    cli.main(["show", "--input", str(tmp_path / "top"), "--once"])
    assert "u@5=page" in capfd.readouterr().out
    longs = spark.range(3, 4).select(F.lit("u").cast("binary").alias("key"), long_bytes(F.col("id")).alias("value"))
    longs.withColumn("ts", F.current_timestamp()).write.parquet(str(tmp_path / "longs"))
    cli.main(["show", "--input", str(tmp_path / "longs"), "--once", "--longs"])
    assert "u=3" in capfd.readouterr().out


def test_options_of_other_jobs_are_refused(capsys):
    for arguments in (
        ["date-ratios", "--input", "a", "--output", "b", "--window", "1 hour"], ["publish", "--input", "a", "--output", "b", "--lateness", "1 hour"],
        ["ratios", "--input", "a", "--output", "b", "--early", "c"], ["feed", "--output", "b"], ["articles", "--input", "a"], ["views"], ["none"],
    ):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(arguments)
    capsys.readouterr()
    args = cli.parser().parse_args(["ratios", "--input", "a", "--output", "b", "--since", "2024-01-02T03:04:05", "--bytes-per-trigger", "9"])
    assert args.since.year == 2024 and args.bytes_per_trigger == 9


def test_two_feed_jobs_side_by_side_have_their_own_checkpoints(spark, tmp_path):
    for name, runs in (("a", 2), ("b", 3)):
        main(["items", "--output", str(tmp_path / f"items-{name}"), "--runs", str(runs), "--seed", str(runs)])
        main(["feed", "--input", str(tmp_path / f"items-{name}"), "--output", str(tmp_path / f"counts-{name}"), "--once"])
        got = {r.key: int(r.value) for r in read_topic(spark, Topic(str(tmp_path / f"counts-{name}")), stream=False).collect()}
        assert got == {r.user: r["count"] for r in jobs.feed_counts(spark.read.parquet(str(tmp_path / f"items-{name}"))).collect()}


def test_publish_to_servers_writes_to_the_topic(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(jobs, "start_publication", lambda records, points, checkpoint, **options: seen.append((points, options)))
    monkeypatch.setattr(cli, "read_topic", lambda *args, **options: None)
    monkeypatch.setattr(cli, "drain", lambda query: None)
    main(["publish", "--servers", "h:9092", "--input", "r", "--output", "p", "--checkpoint", str(tmp_path / "c"), "--lag", "3"])
    assert seen == [(Topic("p", "h:9092"), {"lag": 3})]
