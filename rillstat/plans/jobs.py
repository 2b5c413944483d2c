"""The jobs: throughput ratios, their publication, feed counts and top articles.

The ``..._records`` functions give the result topic's records and work on batch and
stream alike. The ``start_...`` functions wire a topic or table to them as a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillstat.functions import text
from rillstat.functions.longs import long_bytes
from rillstat.functions.numbers import ieee_ratio
from rillstat.functions.times import millis
from rillstat.operators.aggregates import count_by, ratio_by
from rillstat.operators.finalize import final_windows, latest
from rillstat.operators.publications import publication_log
from rillstat.operators.ranking import pages_text, top_pages
from rillstat.operators.running import running_ratios
from rillstat.operators.selections import article_views, new_items
from rillstat.operators.telemetry import parse_lines
from rillstat.sinks.latest import upsert_batches
from rillstat.sinks.tables import Sink, append_batches, send_records, stored
from rillstat.sources.results import parse_result_json
from rillstat.sources.topics import Topic
from rillstat.streaming.lateness import close_by_key
from rillstat.streaming.publishing import once_per_batch, publish
from rillstat.streaming.rankings import rank_closed, rank_updates
from rillstat.streaming.retractions import count_changes
from rillstat.streaming.runs import start
from rillstat.streaming.series import last_points

KBIT_PER_MBIT = 1000.0

#: A window of one second and half a second more for late lines.
RATIO_WINDOW, RATIO_LATENESS, RATIO_TRIGGER = "1 second", "500 milliseconds", "1 second"
ARTICLE_WINDOW, TOP_ARTICLES = "1 hour", 100
COUNT_TRIGGER = "10 seconds"

POINT = "market STRING, start_time BIGINT, count BIGINT, utput DOUBLE, seq BIGINT, message STRING"


def market_ratios(
    lines: DataFrame, every: str = RATIO_WINDOW, lateness: str | None = RATIO_LATENESS, exact: bool = False
) -> DataFrame:
    """Throughput in Mbit/s per market and window of telemetry lines."""
    return ratio_by(parse_lines(lines), ["market"], every=every, lateness=lateness, scale=KBIT_PER_MBIT, exact=exact)


def market_ratio_records(ratios: DataFrame) -> DataFrame:
    """Records keyed by market with the JSON of a window's ratio."""
    value = text.window_ratio_json(F.col("market"), F.col("start_time"), F.col("count"), F.col("utput"))
    return ratios.select(F.col("market").alias("key"), value.alias("value"), F.current_timestamp().alias("ts"))


def _dated(lines: DataFrame, key: str, *others: str) -> DataFrame:
    rows = parse_lines(lines)
    composite = text.date_region_market_key(F.col(key), F.col("region"), F.col("market"))
    return rows.select(composite.alias("series"), *others, "num", "den", "counted")


def date_market_ratios(lines: DataFrame, key: str = "key", exact: bool = False) -> DataFrame:
    """Throughput in kbit/s per date (the record key), region and market over all time."""
    return ratio_by(_dated(lines, key), ["series"], exact=exact)


def date_market_changelog(lines: DataFrame, sequence: str, key: str = "key") -> DataFrame:
    """How each record changes the throughput of its date, region and market: one row per record, by ``sequence``."""
    sums = running_ratios(_dated(lines, key, sequence), ["series"], [sequence])
    return sums.withColumn("utput", ieee_ratio("numerator", "denominator"))


def date_market_records(ratios: DataFrame) -> DataFrame:
    """Records keyed by date, region and market with the JSON of a ratio."""
    value = text.ratio_json(F.col("count"), F.col("utput"))
    return ratios.select(F.col("series").alias("key"), value.alias("value"), F.current_timestamp().alias("ts"))


def ratio_updates(records: DataFrame) -> DataFrame:
    """Window ratios read back from their records; ``seq`` is the order of their arrival."""
    rows = parse_result_json(records.select("value", "seq"))
    return rows.where(F.col("market").isNotNull() & F.col("start_time").isNotNull())


def with_message(points: DataFrame) -> DataFrame:
    """Add the chart message of each point."""
    return points.withColumn("message", text.message(F.col("market"), F.col("utput"), F.col("start_time")))


def published_points(updates: DataFrame, lag: int = 2) -> DataFrame:
    """The points published in the end, from a table of ratio updates."""
    newest = latest(updates, ["market", "start_time"], "seq", ["count", "utput"])
    return with_message(final_windows(stored(newest, "latest-ratios"), "market", "start_time", lag))


def published_log(updates: DataFrame, lag: int = 2) -> DataFrame:
    """Every publication, with its chart message, in the order ``seq`` of arrival, from a table of ratio updates."""
    return with_message(publication_log(updates, "market", "start_time", "seq", ["count", "utput"], lag))


def feed_counts(feed: DataFrame) -> DataFrame:
    """Number of new feed items per user."""
    return count_by(new_items(feed), ["user"])


def feed_count_records(counts: DataFrame, as_bytes: bool = False) -> DataFrame:
    """Records keyed by user with the count as text, or as the bytes of a long."""
    value = long_bytes(F.col("count")) if as_bytes else F.col("count").cast("string")
    return counts.select(F.col("user").alias("key"), value.alias("value"), F.current_timestamp().alias("ts"))


def article_counts(views: DataFrame, every: str = ARTICLE_WINDOW, lateness: str | None = None) -> DataFrame:
    """Article views per page, industry and window."""
    return count_by(article_views(views, user=None), ["page", "industry"], every=every, lateness=lateness)


def top_article_records(top: DataFrame) -> DataFrame:
    """Records keyed ``industry@start`` with the ranked pages as text."""
    key = text.window_key(F.col("industry"), F.col("start_time"))
    return pages_text(top).select(key.alias("key"), "value", F.current_timestamp().alias("ts"))


def start_market_ratios(
    lines: DataFrame, results: Topic, checkpoint: str, *, window: str = RATIO_WINDOW,
    lateness: str = RATIO_LATENESS, every: str | None = RATIO_TRIGGER, **options,
) -> StreamingQuery:
    """Send every change of a market's window ratio to a topic."""
    records = market_ratio_records(market_ratios(lines, window, lateness))
    options = {"name": "market-ratios", "output_mode": "update"} | options
    return start(records, send_records(results, checkpoint), checkpoint=checkpoint, every=every, **options)


def start_date_market_ratios(
    lines: DataFrame, results: Topic, checkpoint: str, *, every: str | None = RATIO_TRIGGER, **options
) -> StreamingQuery:
    """Send every change of a date, region and market's ratio to a topic."""
    records = date_market_records(date_market_ratios(lines))
    options = {"output_mode": "update"} | options
    return start(records, send_records(results, checkpoint), checkpoint=checkpoint, every=every, **options)


def message_records(points: DataFrame) -> DataFrame:
    """Records keyed by market with the message of each point."""
    return points.select(F.col("market").alias("key"), F.col("message").alias("value"), F.current_timestamp().alias("ts"))


def start_publication(
    records: DataFrame, points: str | Topic | Sink, checkpoint: str, *, lag: int = 2, every: str | None = RATIO_TRIGGER, **options
) -> StreamingQuery:
    """Send each published window on: to the table at a path, as its message to a topic, or with its message to a sink."""
    if isinstance(points, Topic):
        send = send_records(points, checkpoint)
        target: Sink = lambda batch, batch_id: send(message_records(batch), batch_id)
    else:
        target = append_batches(points, checkpoint, by_size=True) if isinstance(points, str) else points
    sink = once_per_batch(lambda batch, batch_id: target(with_message(batch), batch_id))
    rows = publish(ratio_updates(records), lag, options.get("state_partitions"))
    options = {"output_mode": "update"} | options
    return start(rows, sink, checkpoint=checkpoint, every=every, **options)


def start_feed_table(
    feed: DataFrame, table: str, checkpoint: str, *, every: str | None = COUNT_TRIGGER, **options
) -> StreamingQuery:
    """Keep each user's count in the table at a path."""
    sink = upsert_batches(table, checkpoint, ["user"], ["count"])
    options = {"output_mode": "update"} | options
    return start(feed_counts(feed), sink, checkpoint=checkpoint, every=every, **options)


def start_ratio_table(
    lines: DataFrame, table: str, checkpoint: str, *, window: str = RATIO_WINDOW,
    lateness: str = RATIO_LATENESS, every: str | None = RATIO_TRIGGER, **options,
) -> StreamingQuery:
    """Keep the ratio of each market and window in the table at a path."""
    sink = upsert_batches(table, checkpoint, ["market", "start_time"], ["count", "utput"])
    options = {"output_mode": "update"} | options
    return start(market_ratios(lines, window, lateness), sink, checkpoint=checkpoint, every=every, **options)


def start_feed_counts(
    feed: DataFrame, results: Topic, checkpoint: str, *, every: str | None = COUNT_TRIGGER, **options
) -> StreamingQuery:
    """Send every change of a user's count to a topic; brokers get it as bytes of a long."""
    records = feed_count_records(feed_counts(feed), as_bytes=results.servers is not None)
    options = {"output_mode": "update"} | options
    return start(records, send_records(results, checkpoint), checkpoint=checkpoint, every=every, **options)


def start_count_changes(
    views: DataFrame, changes: str, checkpoint: str, *, window: str = ARTICLE_WINDOW, every: str | None = COUNT_TRIGGER, **options
) -> StreamingQuery:
    """Write each change of a page's count, the old value taken away and the new one added, to the table at a path."""
    rows = count_changes(article_views(views, user=None), window)
    options = {"output_mode": "update"} | options
    return start(rows, append_batches(changes, checkpoint, by_size=True), checkpoint=checkpoint, every=every, **options)


def start_last_points(
    records: DataFrame, table: str, checkpoint: str, *, n: int = 20, every: str | None = RATIO_TRIGGER, **options
) -> StreamingQuery:
    """Keep the ``n`` latest points of each market, numbered by ``place``, in the table at a path, from a topic of ratios."""
    sink = upsert_batches(table, checkpoint, ["market", "place"], ["start_time", "count", "utput"])
    options = {"output_mode": "update"} | options
    return start(last_points(ratio_updates(records), n), sink, checkpoint=checkpoint, every=every, **options)


def start_closed_by_market(
    lines: DataFrame, closed: str, late: str, held: str, checkpoint: str, *, window: str = RATIO_WINDOW,
    lateness: str = RATIO_LATENESS, every: str | None = RATIO_TRIGGER, **options,
) -> StreamingQuery:
    """Write each market's windows once they are closed by its own time, and late rows, to tables at paths.

    ``held`` is the folder of what is still open.
    """
    sink = close_by_key(
        held, append_batches(closed, checkpoint, by_size=True), append_batches(late, checkpoint, by_size=True), checkpoint,
        every=window, lateness=lateness, scale=KBIT_PER_MBIT,
    )
    return start(parse_lines(lines), sink, checkpoint=checkpoint, every=every, **options)


def _as_records(sink: Sink) -> Sink:
    return lambda batch, batch_id: sink(top_article_records(batch), batch_id)


def start_top_articles(
    views: DataFrame, results: Topic, checkpoint: str, *, window: str = ARTICLE_WINDOW, lateness: str = "1 hour",
    n: int = TOP_ARTICLES, early: str | None = None, every: str | None = COUNT_TRIGGER, **options,
) -> StreamingQuery:
    """Send the top pages of each industry and window to a topic.

    A window is sent once, when it closes ``lateness`` after its end. With
    ``early``, a folder for the running rankings, it is sent whenever it changes.
    """
    counts = article_counts(views, window, lateness)
    sink = _as_records(send_records(results, checkpoint))
    if early is None:
        ranked, mode = rank_closed(sink, n), "append"
    else:
        ranked, mode = rank_updates(early, sink, checkpoint, n, millis(window) + millis(lateness)), "update"
    return start(counts, ranked, checkpoint=checkpoint, every=every, output_mode=mode, **options)


def top_articles(views: DataFrame, n: int = TOP_ARTICLES) -> DataFrame:
    """The top pages per industry and hour of a table of views."""
    return top_pages(article_counts(views), n)
