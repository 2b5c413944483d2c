"""Replay of line files by the line: so many lines of each lane at a tick, into a topic.

A lane is what one producer sends: a file, or the files of a tag one after the other. Lines are numbered once within their
lane and written in slices of consecutive numbers. The clock is Spark's source of numbered micro-batches: a micro-batch is a
tick and stands for the next lines of every lane, so lanes go side by side. The clock's offsets are line numbers and are kept in
the checkpoint, so a restart goes on with the next line and repeats none. A tick reads the slices of its own numbers only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstat.sinks.tables import complete, send_records, stored
from rillstat.sources.files import read_lines
from rillstat.sources.topics import Topic
from rillstat.streaming.runs import start

#: Lines of a lane in a slice.
SLICE_LINES = 100_000

#: About the pace of a producer that rests 98 ms after each line.
LINES_PER_TICK, TICK = 10, "1 second"

NUMBERED = "lane STRING, key STRING, line STRING, number BIGINT, slice BIGINT"


def number_lines(spark: SparkSession, path: str, into: str, *, header: bool = False, tag: bool = False) -> None:
    """Write the lines of the files at ``path`` to the folder ``into``, numbered from 0 within their lane.

    With ``tag`` the lane is the file name before the first ``_``, and its files follow each other by path; else each file is a lane.
    A folder that is complete is left as it is. No task holds more than a block of a file: lines take
    their place in the block from the order of reading, and the block its place in the lane from a table of one row per block.
    """
    if complete(spark, into):
        return
    lines = read_lines(spark, path, header=header, tag=tag, place=True)
    lane = F.col("key" if tag else "file").alias("lane")
    # Written before they are counted, so that the ids stay what they are. One task reads a block, in its order.
    rows = stored(lines.select(lane, "key", "line", "file", "block", F.monotonically_increasing_id().alias("id")), "placed-lines")
    blocks = rows.groupBy("lane", "file", "block").agg(F.min("id").alias("first"), F.count("*").alias("lines"))
    up_to = Window.partitionBy("lane").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.withColumn("before", F.sum("lines").over(up_to) - F.col("lines"))
    number = F.col("id") - F.col("first") + F.col("before")
    numbered = rows.join(blocks, ["lane", "file", "block"]).select("lane", "key", "line", number.alias("number"))
    numbered = numbered.withColumn("slice", F.expr(f"number div {SLICE_LINES}")).hint("rebalance", "slice")
    numbered.sortWithinPartitions("slice", "number").write.partitionBy("slice").mode("overwrite").parquet(into)


def last_number(spark: SparkSession, folder: str) -> int:
    """The number of the last line of the longest lane, -1 without any."""
    last = spark.read.schema(NUMBERED).parquet(folder).agg(F.max("number")).first()[0]
    return -1 if last is None else last


def lines_between(spark: SparkSession, folder: str, low: int, high: int) -> DataFrame:
    """The lines numbered ``low`` to ``high`` of all lanes, each lane's in one task and in order."""
    rows = spark.read.schema(NUMBERED).parquet(folder)
    rows = rows.where(F.col("slice").between(low // SLICE_LINES, high // SLICE_LINES) & F.col("number").between(low, high))
    return rows.drop("slice").repartition("lane").sortWithinPartitions("lane", "number")


def replay(
    spark: SparkSession, folder: str, results: Topic, checkpoint: str, *,
    lines_per_tick: int = LINES_PER_TICK, every: str | None = TICK, name: str | None = None,
) -> None:
    """Send the lines that :func:`number_lines` wrote to ``folder``, and return behind the last one.

    Every ``every`` the next ``lines_per_tick`` lines of each lane go out as records ``key, value, ts``; without ``every``
    ticks follow each other at once. A tick that takes longer than that delays the ones after it, and none is made up
    for. A run that was stopped goes on from its checkpoint. A topic of files also has ``lane`` and ``number``.
    """
    last, send = last_number(spark, folder), send_records(results, checkpoint)
    sent = -1

    def tick(batch: DataFrame, batch_id: int) -> None:
        nonlocal sent
        low, high = batch.agg(F.min("value"), F.max("value")).first()
        if low is None:
            return
        if low <= last:
            rows = lines_between(batch.sparkSession, folder, low, high)
            send(rows.select("key", F.col("line").alias("value"), F.current_timestamp().alias("ts"), "lane", "number"), batch_id)
        sent = high

    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", lines_per_tick).option("numPartitions", 1).load()
    query = start(clock, tick, checkpoint=checkpoint, every=every or "0 seconds", name=name)
    try:
        while sent < last and not query.awaitTermination(0.1):
            pass
    finally:
        query.stop()
