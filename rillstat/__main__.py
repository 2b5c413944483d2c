"""Run a job: ``python -m rillstat JOB --input ... --output ... --checkpoint ...``.

Input and output are topics of the given ``--servers``, or folders without them.
Submit to a cluster with ``spark-submit --packages ... rillstat/__main__.py``.
"""

from __future__ import annotations

import argparse
import hashlib
import sys
from datetime import datetime
from pathlib import Path

if __package__ in (None, ""):
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillstat.functions.longs import long_value
from rillstat.plans import jobs
from rillstat.session import build_session, new_folder, shared_folder
from rillstat.sinks.tables import print_lines, send_records
from rillstat.sources import avro, synthetic
from rillstat.sources.files import read_lines, read_table
from rillstat.sources.topics import Topic, read_topic
from rillstat.streaming.replay import LINES_PER_TICK, TICK, number_lines, replay
from rillstat.streaming.runs import checkpoint_at, drain, start

def parser() -> argparse.ArgumentParser:
    """One subparser per job, with the options that the job has."""
    parse = argparse.ArgumentParser(prog="rillstat", description=__doc__)
    jobs_ = parse.add_subparsers(dest="job", required=True)

    def job(name: str, about: str, *, reads: bool = True, writes: bool = True, streams: bool = True) -> argparse.ArgumentParser:
        own = jobs_.add_parser(name, help=about)
        own.add_argument("--servers", help="bootstrap servers of the topics; without them, input and output are folders")
        if reads:
            own.add_argument("--input", required=True, help="topic or folder to read")
            own.add_argument("--start", choices=["earliest", "latest"], default="earliest")
            own.add_argument("--once", action="store_true", help="take the input there is, and stop")
            own.add_argument("--every", help="trigger interval")
        if writes:
            own.add_argument("--output", required=True, help="topic or folder to write")
        if streams:
            own.add_argument("--checkpoint", help="folder of the job's checkpoints (default: by input and output, under spark.checkpoint.dir)")
            own.add_argument("--fresh", action="store_true", help="start without earlier state")
        return own

    def lines(own: argparse.ArgumentParser) -> None:
        own.add_argument("--lines", action="store_true", help="the input is a folder of line files, also with --servers")
        own.add_argument("--header", action="store_true", help="line files begin with a header")
        own.add_argument("--tag", action="store_true", help="line files are keyed by the start of their name")
        own.add_argument("--since", type=datetime.fromisoformat, help="leave out files last changed before this time")
        own.add_argument("--files-per-trigger", type=int, help="pace of line files")
        own.add_argument("--bytes-per-trigger", type=int, help="pace of line files in bytes")

    def window(own: argparse.ArgumentParser) -> None:
        own.add_argument("--window", help="window length")
        own.add_argument("--lateness", help="how long a window waits for late rows")

    def avro_(own: argparse.ArgumentParser, fixed: bool) -> None:
        given = " (default: the fixed one of feed items)" if fixed else ""
        own.add_argument("--schema", help=f"file with the Avro schema of the records on a topic{given}")
        own.add_argument("--schema-id", type=int, help="registered id of the schema; records of another one are left out")

    ratios = job("ratios", "throughput per market and window")
    lines(ratios)
    window(ratios)
    lines(job("date-ratios", "throughput per date, region and market"))
    job("publish", "windows behind two later ones, from a topic of ratios").add_argument("--lag", type=int, default=2)
    avro_(job("feed", "new feed items per user"), fixed=True)
    articles = job("articles", "top pages per industry and window")
    avro_(articles, fixed=False)
    window(articles)
    articles.add_argument("--early", help="send rankings as they change, keeping them in this folder")
    for name, fixed in (("views", False), ("items", True)):
        own = job(name, f"write synthetic {name}", reads=False, streams=False)
        avro_(own, fixed)
        own.add_argument("--runs", type=int, default=1, help="number of synthetic runs")
        own.add_argument("--seed", type=int, default=0)
    own = job("replay", "send the lines of files to a topic at a pace, those of all files or tags side by side")
    lines_per_tick = f"lines of each file or tag every trigger interval (default: {LINES_PER_TICK}, every {TICK})"
    own.add_argument("--lines-per-tick", type=int, default=LINES_PER_TICK, help=lines_per_tick)
    own.add_argument("--header", action="store_true", help="files begin with a header")
    own.add_argument("--tag", action="store_true", help="the start of a file's name is its key, and files with one key follow each other")
    job("show", "print the records of a topic", writes=False, streams=False).add_argument(
        "--longs", action="store_true", help="values are the bytes of a long"
    )
    return parse


def _lines(spark: SparkSession, args) -> DataFrame:
    if args.servers and not args.lines:
        return read_topic(spark, Topic(args.input, args.servers, args.start)).withColumnRenamed("value", "line")
    return read_lines(
        spark, args.input, header=args.header, tag=args.tag, stream=True, since=args.since,
        files_per_trigger=args.files_per_trigger, bytes_per_trigger=args.bytes_per_trigger,
    )


def _schema(args) -> str:
    if args.schema is not None:
        return Path(args.schema).read_text()
    if args.job in ("feed", "items"):
        return avro.FEED_SCHEMA
    raise SystemExit(f"{args.job} on a topic need --schema")


def _records(spark: SparkSession, args) -> DataFrame:
    if args.servers:
        topic = Topic(args.input, args.servers, args.start)
        return avro.decode(read_topic(spark, topic, binary=True), _schema(args), schema_id=args.schema_id)
    return read_table(spark, args.input, stream=True)


def _generate(spark: SparkSession, args) -> None:
    """Write synthetic records, as Avro to a topic or as a table."""
    if args.job == "views":
        rows = synthetic.generate_views(spark, args.runs, args.seed)
    else:
        rows = synthetic.generate_items(spark, args.runs, args.seed)
    if args.servers is None:
        rows.selectExpr("*", "current_timestamp() AS ts").write.mode("append").parquet(args.output)
        return
    if args.schema_id is None:
        raise SystemExit(f"{args.job} on a topic need --schema-id")
    records = avro.encode(rows, rows.columns, _schema(args), args.schema_id)
    send_records(Topic(args.output, args.servers), checkpoint="")(records, 0)


def _show(spark: SparkSession, args) -> StreamingQuery:
    """Print the records of a result topic as they come."""
    records = read_topic(spark, Topic(args.input, args.servers, args.start), binary=args.longs)
    if args.longs:
        records = records.select(F.col("key").cast("string").alias("key"), long_value(F.col("value")).alias("value"))
    checkpoint = new_folder(spark, "show")
    return start(records, print_lines(), checkpoint=checkpoint, every=None if args.once else args.every or "1 second")


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = build_session(f"rillstat-{args.job}")
    if args.job in ("views", "items"):
        _generate(spark, args)
        return
    if args.job == "show":
        drain(_show(spark, args))
        return
    named = hashlib.sha1(repr((args.servers, args.input, args.output)).encode()).hexdigest()[:12]
    base = args.checkpoint or f"{shared_folder(spark)}/rillstat/jobs/{args.job}-{named}"
    checkpoint = checkpoint_at(base, args.fresh)
    output = Topic(args.output, args.servers)
    options = {name: value for name in ("window", "lateness", "every", "lag", "early") if (value := getattr(args, name, None)) is not None}
    if args.once:
        options["every"] = None
    if args.job == "replay":
        numbered = f"{base}/lines-of-{Path(checkpoint).name}"
        number_lines(spark, args.input, numbered, header=args.header, tag=args.tag)
        replay(spark, numbered, output, checkpoint, lines_per_tick=args.lines_per_tick, every=options.get("every", TICK))
        return
    if args.job == "ratios":
        query = jobs.start_market_ratios(_lines(spark, args), output, checkpoint, **options)
    elif args.job == "date-ratios":
        query = jobs.start_date_market_ratios(_lines(spark, args), output, checkpoint, **options)
    elif args.job == "publish":
        records = read_topic(spark, Topic(args.input, args.servers, args.start))
        query = jobs.start_publication(records, output if args.servers else args.output, checkpoint, **options)
    elif args.job == "feed":
        query = jobs.start_feed_counts(_records(spark, args), output, checkpoint, **options)
    else:
        query = jobs.start_top_articles(_records(spark, args), output, checkpoint, **options)
    drain(query)


if __name__ == "__main__":
    main()
