"""The registered batch queries. Each takes a session and a folder of tables.

Ratios are rounded, but for the exact ones, as sums of doubles depend on their order. The places are so
many that the quotients of the data, decimals by small numbers, do not end in a 5
right behind them, which engines round differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstat.functions import text
from rillstat.operators.finalize import final_windows, latest
from rillstat.operators.ranking import last_points, pages_text, top_pages
from rillstat.operators.selections import article_views, only_series, with_level
from rillstat.operators.telemetry import parse_lines, rejects
from rillstat.plans import inputs, jobs
from rillstat.session import new_folder
from rillstat.sinks.tables import stored, write_lines
from rillstat.sources import synthetic
from rillstat.sources.files import read_lines
from rillstat.sources.results import parse_message, parse_result_json

KBIT_PLACES, MBIT_PLACES = 8, 10

#: Markets of the chart in the registered queries.
CHART_MARKETS = ["M1", "M2", "M3", "M4", "M5"]


def rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, places) for name in names or ("utput",)})


def _ratios(spark: SparkSession, folder: str, every: str) -> DataFrame:
    return jobs.market_ratios(inputs.telemetry(spark, folder), every).drop("numerator", "denominator")


def telemetry_parse(spark, folder):
    return parse_lines(inputs.telemetry(spark, folder)).select("event_id", "region", "market", "num", "den")


def telemetry_parse_faulty(spark, folder):
    return parse_lines(inputs.faulty_telemetry(spark, folder)).select("event_id", "region", "market", "num", "den")


def telemetry_rejects(spark, folder):
    return rejects(inputs.faulty_telemetry(spark, folder)).select("event_id", "line")


def line_files(spark, folder):
    """The lines written to files with a header, and read back from there."""
    path = new_folder(spark, "lines")
    write_lines(inputs.telemetry(spark, folder), path)
    return parse_lines(read_lines(spark, path, header=True)).select("region", "market", "num", "den")


def ratio_by_date_region_market(spark, folder):
    ratios = jobs.date_market_ratios(inputs.dated_telemetry(spark, folder))
    return rounded(rounded(ratios, KBIT_PLACES), 2, "numerator", "denominator")


def ratio_by_market_1s(spark, folder):
    return rounded(_ratios(spark, folder, "1 second"), MBIT_PLACES)


def ratio_by_market_1h(spark, folder):
    return rounded(_ratios(spark, folder, "1 hour"), MBIT_PLACES)


def ratio_json_roundtrip(spark, folder):
    records = jobs.market_ratio_records(_ratios(spark, folder, "1 hour"))
    return rounded(parse_result_json(records.select("value")), MBIT_PLACES)


def ratio_json_roundtrip_unwindowed(spark, folder):
    records = jobs.date_market_records(jobs.date_market_ratios(inputs.dated_telemetry(spark, folder)))
    parsed = parse_result_json(records.select(F.col("key").alias("series"), "value"))
    return rounded(parsed.select("series", "count", "utput"), KBIT_PLACES)


def ratio_by_market_1h_exact(spark, folder):
    return jobs.market_ratios(inputs.telemetry(spark, folder), "1 hour", exact=True)


def ratio_by_date_region_market_exact(spark, folder):
    return jobs.date_market_ratios(inputs.dated_telemetry(spark, folder), exact=True)


def ratio_changelog(spark, folder):
    """The ratio of each date, region and market after each record."""
    return jobs.date_market_changelog(inputs.dated_telemetry(spark, folder), "event_id")


def publication_log(spark, folder):
    """Every publication of a market's hours, where every ninth update comes late, with the update that brings it about."""
    return jobs.published_log(inputs.late_window_updates(spark, folder)).drop("message")


def final_windows_lag2(spark, folder):
    ratios = stored(_ratios(spark, folder, "1 hour"), "ratios")
    return rounded(final_windows(ratios), MBIT_PLACES)


def latest_update_per_window(spark, folder):
    return latest(inputs.window_updates(spark, folder), ["market", "start_time"], "seq", ["utput"])


def last_20_points(spark, folder):
    return rounded(last_points(_ratios(spark, folder, "1 hour")).drop("rank"), MBIT_PLACES)


def low_ratio_points(spark, folder):
    points = with_level(only_series(_ratios(spark, folder, "1 hour"), CHART_MARKETS), threshold=0.03)
    return rounded(points, MBIT_PLACES)


def watched_series(spark, folder):
    points = only_series(_ratios(spark, folder, "1 hour"), inputs.watched_markets(spark, folder))
    return rounded(points, MBIT_PLACES)


def message_roundtrip(spark, folder):
    messages = jobs.with_message(_ratios(spark, folder, "1 hour")).select(F.col("message").alias("value"))
    return rounded(parse_message(messages), MBIT_PLACES)


def feed_count_by_user(spark, folder):
    return jobs.feed_counts(inputs.feed(spark, folder))


def article_views_query(spark, folder):
    return article_views(inputs.page_views(spark, folder))


def article_counts_1h(spark, folder):
    return jobs.article_counts(inputs.page_views(spark, folder))


def top_articles(spark, folder):
    return jobs.top_articles(inputs.page_views(spark, folder)).withColumn("rank", F.col("rank").cast("bigint"))


def top_3_articles(spark, folder):
    return jobs.top_articles(inputs.page_views(spark, folder), 3).withColumn("rank", F.col("rank").cast("bigint"))


def top_articles_text(spark, folder):
    return jobs.top_article_records(jobs.top_articles(inputs.page_views(spark, folder))).select("key", "value")


def console_lines(spark, folder):
    records = jobs.feed_count_records(jobs.feed_counts(inputs.feed(spark, folder)))
    return records.select(text.console_line(F.col("key"), F.col("value")).alias("line"))


def _event_ids(spark, folder):
    return inputs.events(spark, folder).select(F.col("event_id").alias("id"), "ts")


def synthetic_views(spark, folder):
    """Synthetic views at the times of the events, ranked like real ones."""
    views = synthetic.page_views(_event_ids(spark, folder), seed=1)
    return top_pages(jobs.article_counts(views)).withColumn("rank", F.col("rank").cast("bigint"))


def synthetic_feed(spark, folder):
    """Synthetic feed items, one draw per event, counted like real ones."""
    return jobs.feed_counts(synthetic.feed_items(_event_ids(spark, folder), seed=1))


QUERIES = {
    "telemetry_parse": telemetry_parse,
    "telemetry_parse_faulty": telemetry_parse_faulty,
    "telemetry_rejects": telemetry_rejects,
    "line_files": line_files,
    "ratio_by_date_region_market": ratio_by_date_region_market,
    "ratio_by_market_1s": ratio_by_market_1s,
    "ratio_by_market_1h": ratio_by_market_1h,
    "ratio_json_roundtrip": ratio_json_roundtrip,
    "ratio_json_roundtrip_unwindowed": ratio_json_roundtrip_unwindowed,
    "ratio_by_market_1h_exact": ratio_by_market_1h_exact,
    "ratio_by_date_region_market_exact": ratio_by_date_region_market_exact,
    "ratio_changelog": ratio_changelog,
    "publication_log": publication_log,
    "final_windows_lag2": final_windows_lag2,
    "latest_update_per_window": latest_update_per_window,
    "last_20_points": last_20_points,
    "low_ratio_points": low_ratio_points,
    "watched_series": watched_series,
    "message_roundtrip": message_roundtrip,
    "feed_count_by_user": feed_count_by_user,
    "article_views": article_views_query,
    "article_counts_1h": article_counts_1h,
    "top_articles": top_articles,
    "top_3_articles": top_3_articles,
    "top_articles_text": top_articles_text,
    "console_lines": console_lines,
    "synthetic_views": synthetic_views,
    "synthetic_feed": synthetic_feed,
}
