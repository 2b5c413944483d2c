import random

from pyspark.sql import functions as F

from rillstat.functions.longs import long_bytes, long_value
from rillstat.operators import ranking
from rillstat.operators.selections import article_views, new_items, only_series
from rillstat.plans import jobs


def counts(spark, rows):
    return spark.createDataFrame(rows, "page STRING, industry STRING, start_time BIGINT, count BIGINT")


def test_ties_go_by_page(spark):
    df = counts(spark, [("c", "i", 0, 5), ("a", "i", 0, 5), ("b", "i", 0, 5)])
    assert [(r.page, r.rank) for r in ranking.top_pages(df, 2).orderBy("rank").collect()] == [("a", 1), ("b", 2)]


def test_counts_over_two_billion_are_ordered(spark):
    df = counts(spark, [("a", "i", 0, 1), ("b", "i", 0, 2**31 + 5), ("c", "i", 0, 2**33)])
    assert [r.page for r in ranking.top_pages(df).orderBy("rank").collect()] == ["c", "b", "a"]


def test_text_has_a_newline_after_each_page(spark):
    df = counts(spark, [("a", "i", 0, 1), ("b", "i", 0, 2), ("z", "j", 0, 1)])
    texts = {r.industry: r.value for r in ranking.pages_text(ranking.top_pages(df)).collect()}
    assert texts == {"i": "b\na\n", "j": "z\n"}


def test_record_key(spark):
    record = jobs.top_article_records(ranking.top_pages(counts(spark, [("a", "i", 3600000, 1)]))).first()
    assert (record.key, record.value) == ("i@3600000", "a\n")


def test_against_sorting(spark):
    rng = random.Random(7)
    rows = [(f"p{i}", rng.choice("aaab"), 0, rng.randrange(50)) for i in range(2000)]
    got = ranking.top_pages(counts(spark, rows), 100).orderBy("industry", "rank").collect()
    expected = []
    for industry in "ab":
        group = sorted((r for r in rows if r[1] == industry), key=lambda r: (-r[3], r[0]))[:100]
        expected += [(r[0], industry, 0, r[3], i + 1) for i, r in enumerate(group)]
    assert [tuple(r) for r in got] == expected


def test_groups_are_cut_before_the_shuffle(spark):
    for n in (100, 5000):
        plan = ranking.top_pages(counts(spark, [("a", "i", 0, 1)]), n)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange") == 1


def test_last_points(spark):
    df = spark.createDataFrame([("a", i) for i in range(30)] + [("b", 1)], "market STRING, start_time BIGINT")
    kept = {tuple(r) for r in ranking.last_points(df).drop("rank").collect()}
    assert kept == {("a", i) for i in range(10, 30)} | {("b", 1)}


def test_flags(spark):
    rows = [("ARTICLE",), ("LONG_ARTICLE",), ("article",), (None,)]
    df = spark.createDataFrame(rows, "flags STRING").select(
        F.lit("u").alias("user"), F.col("flags").alias("page"), F.lit("i").alias("industry"), "flags", F.current_timestamp().alias("ts")
    )
    kept = article_views(df)
    assert [r.page for r in kept.collect()] == ["ARTICLE", "LONG_ARTICLE"]
    assert {r.user for r in kept.collect()} == {"user"}
    assert article_views(df, user=None).columns == ["page", "industry", "ts"]


def test_new_items_and_series(spark):
    feed = spark.createDataFrame([("a", True), ("b", False), ("a", True)], "user STRING, is_new BOOLEAN")
    assert new_items(feed).count() == 2
    assert [tuple(r) for r in jobs.feed_counts(feed).collect()] == [("a", 2)]
    points = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "market STRING, x INT")
    assert [r.x for r in only_series(points, ["a", "z"]).collect()] == [1]
    table = spark.createDataFrame([("a",), ("a",)], "market STRING")
    assert [r.x for r in only_series(points, table).collect()] == [1]


def test_long_bytes(spark):
    values = [0, 1, 255, 2**40, 2**63 - 1, -1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "v BIGINT").select("v", long_bytes(F.col("v")).alias("b"))
    rows = df.withColumn("back", long_value(F.col("b"))).collect()
    assert [bytes(r.b) for r in rows] == [v.to_bytes(8, "big", signed=True) for v in values]
    assert [r.back for r in rows] == values


def test_count_records_as_bytes(spark):
    counts = spark.createDataFrame([("a", 3)], "user STRING, count BIGINT")
    assert jobs.feed_count_records(counts).first().value == "3"
    assert bytes(jobs.feed_count_records(counts, as_bytes=True).first().value) == b"\0" * 7 + b"\3"
