"""The registered streaming queries.

Each runs a stream over the whole table to its end and returns the result table.
The stream's checkpoint and results lie under the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstat.functions.times import millis
from rillstat.operators.aggregates import count_by, ratio_by
from rillstat.operators.finalize import latest
from rillstat.operators.selections import article_views
from rillstat.operators.telemetry import parse_lines
from rillstat.plans import inputs, jobs
from rillstat.plans.queries import KBIT_PLACES, MBIT_PLACES, rounded
from rillstat.session import new_folder
from rillstat.sinks.identified import read_once, send_identified
from rillstat.sinks.latest import latest_table, upsert_batches
from rillstat.sinks.tables import (
    append_batches, file_system, latest_rows, line_batches, read_batches, send_records, write_lines,
)
from rillstat.sources.files import read_lines
from rillstat.sources.results import parse_message, parse_result_json
from rillstat.sources.topics import Topic, read_topic
from rillstat.streaming.lateness import open_windows
from rillstat.streaming.parsing import line_counts, lines_of, parse_batches
from rillstat.streaming.replay import last_number, number_lines, replay
from rillstat.streaming.rankings import TOP, latest_rankings, rank_closed, rank_updates
from rillstat.streaming.retractions import CHANGE, folded, industry_totals
from rillstat.streaming.runs import checkpoint_at, closable, drain, run_to_close, start
from rillstat.streaming.states import state_table

RATIO = "market STRING, start_time BIGINT, count BIGINT, numerator DOUBLE, denominator DOUBLE, utput DOUBLE"


def _partitions(spark: SparkSession) -> int:
    """One state partition per core."""
    return spark.sparkContext.defaultParallelism


def _parsed(lines: DataFrame) -> DataFrame:
    return parse_lines(lines).drop("event_id")


def _run(spark: SparkSession, folder: str, name: str, late: bool = False) -> str:
    """A new folder with the events in order, in several files."""
    return inputs.in_order(spark, folder, new_folder(spark, name), late=late)


def stream_feed_count(spark, folder):
    """The table of each user's count, kept up to date batch by batch."""
    run = _run(spark, folder, "feed-count")
    drain(jobs.start_feed_table(
        inputs.feed(spark, run, stream=True), f"{run}/counts", f"{run}/checkpoint",
        every=None, state_partitions=_partitions(spark),
    ))
    return latest_table(spark, f"{run}/counts", "user STRING, count BIGINT")


def _date_market_updates(spark: SparkSession, run: str, topic: Topic) -> DataFrame:
    drain(jobs.start_date_market_ratios(
        inputs.dated_telemetry(spark, run, stream=True), topic, f"{run}/checkpoint",
        every=None, state_partitions=_partitions(spark),
    ))
    return parse_result_json(
        read_topic(spark, topic, stream=False).select(F.col("key").alias("series"), "value", "seq", "ts")
    )


def stream_date_region_market(spark, folder):
    """Updates of the ratio of each date, region and market, folded to the last one."""
    run = _run(spark, folder, "date-market")
    updates = _date_market_updates(spark, run, Topic(f"{run}/ratios"))
    return rounded(latest(updates, ["series"], "seq", ["count", "utput"]), KBIT_PLACES)


def stream_latest_by_arrival(spark, folder):
    """The last update of each series where the records' times run against their arrival."""
    run = _run(spark, folder, "by-arrival")
    topic, turned = Topic(f"{run}/ratios"), Topic(f"{run}/turned")
    _date_market_updates(spark, run, topic)
    send = send_records(turned, "turned")
    records = read_topic(spark, topic, stream=False)
    for number, row in enumerate(records.select("seq").distinct().orderBy("seq").collect()):  # one per batch
        some = records.where(F.col("seq") == row["seq"])
        send(some.select("key", "value", F.timestamp_seconds(F.lit(1_000_000 - number)).alias("ts")), number)
    updates = read_topic(spark, turned, stream=False).select(F.col("key").alias("series"), "value", "seq")
    return rounded(latest(parse_result_json(updates), ["series"], "seq", ["count", "utput"]), KBIT_PLACES)


def _closed_ratios(spark: SparkSession, run: str, every: str) -> DataFrame:
    closing, checkpoint, results = f"{run}/closing", f"{run}/checkpoint", f"{run}/results"

    def build():
        rows = closable(_parsed(inputs.telemetry(spark, run, stream=True)), closing)
        ratios = ratio_by(rows, ["market"], every=every, lateness=jobs.RATIO_LATENESS, scale=jobs.KBIT_PER_MBIT)
        return ratios, append_batches(results, checkpoint, by_size=True)

    run_to_close(spark, build, closing, checkpoint, state_partitions=_partitions(spark))
    table = read_batches(spark, results, RATIO)
    return rounded(table.select("market", "start_time", "count", "utput"), MBIT_PLACES)


def stream_ratio_1h(spark, folder):
    """Windows appended once they are closed."""
    return _closed_ratios(spark, _run(spark, folder, "ratio"), "1 hour")


def stream_ratio_1s(spark, folder):
    """Windows of a second appended once they are closed."""
    return _closed_ratios(spark, _run(spark, folder, "ratio-1s"), "1 second")


def stream_late_rows(spark, folder):
    """Windows that rows which come days after them do not change."""
    return _closed_ratios(spark, _run(spark, folder, "late-rows", late=True), "1 hour")


def _ratio_topic(spark, run) -> Topic:
    topic = Topic(f"{run}/ratios")
    drain(jobs.start_market_ratios(
        inputs.telemetry(spark, run, stream=True), topic, f"{run}/ratio-checkpoint",
        window="1 hour", every=None, state_partitions=_partitions(spark), name=None,
    ))
    return topic


def stream_ratio_updates_1h(spark, folder):
    """The table of windows, kept up to date batch by batch."""
    run = _run(spark, folder, "ratio-updates")
    drain(jobs.start_ratio_table(
        inputs.telemetry(spark, run, stream=True), f"{run}/table", f"{run}/checkpoint",
        window="1 hour", every=None, state_partitions=_partitions(spark),
    ))
    schema = "market STRING, start_time BIGINT, count BIGINT, utput DOUBLE"
    return rounded(latest_table(spark, f"{run}/table", schema), MBIT_PLACES)


def stream_final_windows(spark, folder):
    """The ratio topic read by a second stream, which publishes windows behind two later ones."""
    run = _run(spark, folder, "final-windows")
    topic = _ratio_topic(spark, run)
    points = f"{run}/points"
    drain(jobs.start_publication(
        read_topic(spark, topic), points, f"{run}/checkpoint", every=None, state_partitions=_partitions(spark)
    ))
    table = latest_rows(spark, points, jobs.POINT, ["market", "start_time"], ["count", "utput"], "seq")
    return rounded(table, MBIT_PLACES)


def stream_messages(spark, folder):
    """The published windows as messages in a topic, folded to the last one of each window."""
    run = _run(spark, folder, "messages")
    topic, messages = _ratio_topic(spark, run), Topic(f"{run}/messages")
    drain(jobs.start_publication(
        read_topic(spark, topic), messages, f"{run}/checkpoint", every=None, state_partitions=_partitions(spark)
    ))
    points = parse_message(read_topic(spark, messages, stream=False).select("key", "value", "seq"))
    points = points.where(F.col("key") == F.col("market"))
    return rounded(latest(points, ["market", "start_time"], "seq", ["utput"]), MBIT_PLACES)


def _top_columns(top: DataFrame) -> DataFrame:
    return top.select("page", "industry", "start_time", "count", F.col("rank").cast("bigint").alias("rank"))


def stream_top_articles(spark, folder):
    """Counts appended once an hour is closed, and ranked then."""
    run = _run(spark, folder, "top-articles")
    closing, checkpoint, results = f"{run}/closing", f"{run}/checkpoint", f"{run}/results"

    def build():
        # The closing row has no flags; it joins the articles behind their filter.
        views = closable(article_views(inputs.page_views(spark, run, stream=True), user=None), closing)
        counts = count_by(views, ["page", "industry"], every=jobs.ARTICLE_WINDOW, lateness="1 hour")
        return counts, rank_closed(append_batches(results, checkpoint, by_size=True))

    run_to_close(spark, build, closing, checkpoint, state_partitions=_partitions(spark))
    return _top_columns(read_batches(spark, results, TOP))


def _ranked_updates(spark: SparkSession, run: str, window: str, lateness: str) -> DataFrame:
    checkpoint, results = f"{run}/checkpoint", f"{run}/results"
    counts = jobs.article_counts(inputs.page_views(spark, run, stream=True), window, lateness)
    log = append_batches(results, checkpoint, by_size=True)
    sink = rank_updates(f"{run}/held", log, checkpoint, jobs.TOP_ARTICLES, millis(window) + millis(lateness))
    drain(start(counts, sink, checkpoint=checkpoint, output_mode="update", state_partitions=_partitions(spark)))
    return _top_columns(latest_rankings(read_batches(spark, results, TOP)))


def stream_top_articles_updates(spark, folder):
    """Hours ranked anew with every change, folded to the last ranking."""
    return _ranked_updates(spark, _run(spark, folder, "top-article-updates"), "1 hour", "1 hour")


def stream_top_articles_updates_1d(spark, folder):
    """Days ranked anew with every change, with rows that come too late to count."""
    return _ranked_updates(spark, _run(spark, folder, "top-article-updates-1d", late=True), "1 day", "5 hours")


def stream_console_lines(spark, folder):
    """The views of a stream as lines in text files, all rows of each batch."""
    run = _run(spark, folder, "console-lines")
    views = inputs.page_views(spark, run, stream=True).select(F.col("user").alias("key"), F.col("page").alias("value"))
    drain(start(views, line_batches(f"{run}/lines", f"{run}/checkpoint"), checkpoint=f"{run}/checkpoint"))
    return spark.read.schema("value STRING, run STRING, batch_id BIGINT").text(f"{run}/lines").select(F.col("value").alias("line"))


def _tagged_files(spark: SparkSession, folder: str, run: str) -> str:
    """Telemetry lines in files with a header, several for each of three tags; their folder."""
    lines = inputs.telemetry(spark, folder).where("line <> ''")
    files, make = file_system(spark, run)
    files.mkdirs(make(f"{run}/lines"))
    for tag in (0, 1, 2):
        write_lines(lines.where(F.col("event_id") % 3 == tag), f"{run}/written/{tag}")
        for entry in files.listStatus(make(f"{run}/written/{tag}")):
            name = entry.getPath().getName()
            if name.endswith(".csv"):
                files.rename(entry.getPath(), make(f"{run}/lines/T{tag}_{name}"))
    return f"{run}/lines"


def stream_lines_tagged(spark, folder):
    """Lines per tag of their file's name, where files have a header and tags several files."""
    run = new_folder(spark, "lines-tagged")
    read = read_lines(spark, _tagged_files(spark, folder, run), header=True, tag=True, stream=True, files_per_trigger=1)
    drain(start(read, append_batches(f"{run}/results", f"{run}/checkpoint"), checkpoint=f"{run}/checkpoint"))
    table = read_batches(spark, f"{run}/results", "key STRING, ts TIMESTAMP, line STRING")
    return table.groupBy("key").agg(F.count("*").alias("count"))


def stream_paced_lines(spark, folder):
    """Lines of three tags sent side by side, a quarter of the longest at a tick, and how many came with each."""
    run = new_folder(spark, "paced-lines")
    numbered, topic = f"{run}/numbered", Topic(f"{run}/sent")
    number_lines(spark, _tagged_files(spark, folder, run), numbered, header=True, tag=True)
    quarter = max(1, -(-(last_number(spark, numbered) + 1) // 4))
    replay(spark, numbered, topic, f"{run}/checkpoint", lines_per_tick=quarter, every=None)
    sent = read_batches(spark, topic.name, "key STRING, value STRING, number BIGINT")
    return sent.groupBy("key", F.col("batch_id").alias("tick")).agg(
        F.count("*").alias("count"), F.count_distinct("number").alias("numbers"), F.min("number").alias("first"), F.max("number").alias("last")
    )


def stream_fresh_run(spark, folder):
    """A second run without the state of the first, which ends with the same counts."""
    run = _run(spark, folder, "fresh-run")
    for _ in range(2):
        drain(jobs.start_feed_counts(
            inputs.feed(spark, run, stream=True), Topic(f"{run}/stats"), checkpoint_at(f"{run}/checkpoints", fresh=True),
            every=None, state_partitions=_partitions(spark),
        ))
    records = read_topic(spark, Topic(f"{run}/stats"), stream=False)
    updates = records.select(F.col("key").alias("user"), F.col("value").cast("bigint").alias("count"), "seq")
    return latest(updates, ["user"], "seq", ["count"])


def _changes(spark: SparkSession, run: str) -> str:
    """The log of changes of the hourly counts; the folder that it is in."""
    drain(jobs.start_count_changes(
        inputs.page_views(spark, run, stream=True), f"{run}/changes", f"{run}/checkpoint", every=None, state_partitions=_partitions(spark)
    ))
    return f"{run}/changes"


def stream_count_retractions(spark, folder):
    """Old counts taken away and new ones added, folded to the counts that are left."""
    log = _changes(spark, _run(spark, folder, "retractions"))
    return folded(read_batches(spark, log, CHANGE))


def stream_industry_totals(spark, folder):
    """The changes read by a second stream, which keeps pages and views per industry and hour by adding and taking away."""
    run = _run(spark, folder, "industry-totals")
    changes = spark.readStream.schema(f"{CHANGE}, run STRING, batch_id BIGINT").option("maxFilesPerTrigger", 3).parquet(_changes(spark, run))
    sink = upsert_batches(f"{run}/totals", f"{run}/totals-checkpoint", ["industry", "start_time"], ["pages", "views"])
    drain(start(
        industry_totals(changes), sink, checkpoint=f"{run}/totals-checkpoint", output_mode="update", state_partitions=_partitions(spark)
    ))
    return latest_table(spark, f"{run}/totals", "industry STRING, start_time BIGINT, pages BIGINT, views BIGINT")


def stream_last_20_points(spark, folder):
    """The ratio topic read by a second stream, which keeps the last 20 points of each market."""
    run = _run(spark, folder, "last-points")
    topic = _ratio_topic(spark, run)
    drain(jobs.start_last_points(
        read_topic(spark, topic), f"{run}/points", f"{run}/checkpoint", every=None, state_partitions=_partitions(spark)
    ))
    points = latest_table(spark, f"{run}/points", "market STRING, place INT, start_time BIGINT, count BIGINT, utput DOUBLE")
    return rounded(points.drop("place"), MBIT_PLACES)


def stream_late_side(spark, folder):
    """Hours closed by the time of their own market, and how many rows came too late for them."""
    run = inputs.delayed(spark, folder, new_folder(spark, "late-side"))
    lines = inputs.telemetry(spark, run, stream=True)
    query = jobs.start_closed_by_market(
        lines, f"{run}/closed", f"{run}/late", f"{run}/held", f"{run}/checkpoint", window="1 hour", every=None
    )
    drain(query)
    closed = read_batches(spark, f"{run}/closed", RATIO).drop("run", "batch_id")
    windows = closed.unionByName(open_windows(
        spark, f"{run}/held", f"{run}/checkpoint", query.lastProgress["batchId"], scale=jobs.KBIT_PER_MBIT
    ))
    at = F.unix_millis("ts")
    late = read_batches(spark, f"{run}/late", "market STRING, ts TIMESTAMP")
    late = late.groupBy("market", (at - F.pmod(at, F.lit(3_600_000))).alias("start_time")).agg(F.count("*").alias("late"))
    both = windows.join(late, ["market", "start_time"], "full")
    return both.select("market", "start_time", "count", "numerator", "denominator", "utput", F.coalesce("late", F.lit(0)).alias("late"))


def stream_state_counts(spark, folder):
    """Each user's count, read from the state of the stream that counts."""
    run = _run(spark, folder, "state-counts")
    drain(jobs.start_feed_counts(
        inputs.feed(spark, run, stream=True), Topic(f"{run}/stats"), f"{run}/checkpoint", every=None, state_partitions=_partitions(spark)
    ))
    return state_table(spark, f"{run}/checkpoint").select("user", "count")


def stream_counted_rejects(spark, folder):
    """Lines, parsed ones, rejects and empty ones as they were counted batch by batch, and whether every batch adds up."""
    run = _run(spark, folder, "counted-rejects")
    checkpoint, path = f"{run}/checkpoint", f"{run}/parsed"
    lines = inputs.faulty_telemetry(spark, run, stream=True)
    drain(start(lines, parse_batches(path, checkpoint), checkpoint=checkpoint))
    counts = line_counts(spark, path)
    whole = F.col("parsed") + F.col("rejected") + F.col("empty") == F.col("lines")
    return counts.agg(*(F.sum(name).alias(name) for name in ("lines", "parsed", "rejected", "empty")), F.every(whole).alias("adds_up"))


def stream_rejects(spark, folder):
    """The rejects that were written beside the parsed lines."""
    run = _run(spark, folder, "rejects")
    lines = inputs.faulty_telemetry(spark, run, stream=True)
    drain(start(lines, parse_batches(f"{run}/parsed", f"{run}/checkpoint"), checkpoint=f"{run}/checkpoint"))
    return lines_of(spark, f"{run}/parsed", "rejected", "event_id BIGINT, line STRING")


def stream_doubled_records(spark, folder):
    """Feed items on a topic that got every batch twice, counted by a stream that reads each once."""
    run = _run(spark, folder, "doubled-records")
    topic = Topic(f"{run}/items", options={"maxFilesPerTrigger": "4"})
    send = send_identified(topic, f"{run}/sent")

    def twice(batch: DataFrame, batch_id: int) -> None:
        for _ in range(2):
            send(batch, batch_id)

    items = inputs.feed(spark, run, stream=True).select(F.col("user").alias("key"), F.col("is_new").cast("string").alias("value"), "ts")
    drain(start(items, twice, checkpoint=f"{run}/sent"))
    once = read_once(spark, topic, "60 days").select(F.col("key").alias("user"), F.col("value").cast("boolean").alias("is_new"))
    sink = append_batches(f"{run}/once", f"{run}/checkpoint", by_size=True)
    drain(start(once, sink, checkpoint=f"{run}/checkpoint", state_partitions=_partitions(spark)))
    return jobs.feed_counts(read_batches(spark, f"{run}/once", "user STRING, is_new BOOLEAN"))


STREAM_QUERIES = {
    query.__name__: query
    for query in (
        stream_feed_count, stream_date_region_market, stream_latest_by_arrival, stream_ratio_1h, stream_ratio_1s, stream_late_rows,
        stream_ratio_updates_1h, stream_final_windows, stream_messages, stream_top_articles, stream_top_articles_updates,
        stream_top_articles_updates_1d, stream_console_lines, stream_lines_tagged, stream_paced_lines, stream_fresh_run,
        stream_count_retractions, stream_industry_totals, stream_last_20_points, stream_late_side, stream_state_counts,
        stream_counted_rejects, stream_rejects, stream_doubled_records,
    )
}
