"""Sinks for micro-batches: tables of files, topics and the console.

A sink is a function of a batch and its number, for ``foreachBatch``. Spark hands
a batch out again with the same number after a failure; file sinks write each
batch to a folder of its own and leave it alone once it is complete, so that a repeat
changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstat.functions.text import console_line
from rillstat.operators.finalize import latest
from rillstat.session import new_folder
from rillstat.sources.files import WHOLE_LINE
from rillstat.sources.topics import Topic, arrival

Sink = Callable[[DataFrame, int], None]


def run_of(checkpoint: str) -> str:
    """A short name for the run that owns a checkpoint."""
    return hashlib.sha1(checkpoint.encode()).hexdigest()[:12]


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and a function that makes its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """The names of the folders in ``path`` that begin with ``prefix``, in order."""
    files, make = file_system(spark, path)
    if not files.exists(make(path)):
        return []
    names = (entry.getPath().getName() for entry in files.listStatus(make(path)) if entry.isDirectory())
    return sorted(name for name in names if name.startswith(prefix))


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder has ended."""
    files, make = file_system(spark, path)
    return files.exists(make(f"{path}/_SUCCESS"))


def run_folder(spark: SparkSession, path: str, checkpoint: str) -> str:
    """The folder of a run: its number among the runs of ``path`` in the order of their first batches, and its name."""
    name = run_of(checkpoint)
    runs = folders(spark, path, "run=")
    for run in runs:
        if run.endswith(f"-{name}"):
            return run
    numbers = [int(number) for run in runs if (number := run[4:].split("-")[0]).isdigit()]
    return f"run={max(numbers, default=-1) + 1:06d}-{name}"


def append_batches(path: str, checkpoint: str, by_size: bool = False) -> Sink:
    """Write batches to ``path/run=<number>-<name>/batch_id=<n>``.

    Batch numbers start over with a new checkpoint, and so does the run. A batch that was
    written whole is left alone when it comes again, so that a reading stream sees each file once; what
    is left of a broken write is replaced. With ``by_size`` the rows are shuffled into files of about the size that adaptive
    execution aims at, one for a small batch and as many as it takes for a large one, whatever the number of state partitions.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = f"{path}/{run_folder(spark, path, checkpoint)}/batch_id={batch_id}"
        if complete(spark, folder):
            return
        rows = batch.hint("rebalance") if by_size else batch
        rows.write.mode("overwrite").parquet(folder)

    return write


def send_records(topic: Topic, checkpoint: str) -> Sink:
    """Write ``key, value`` to a topic; one of files also keeps ``ts``, in files by size.

    A broker may receive a batch twice after a failure.
    """
    if topic.servers is None:
        return append_batches(topic.name, checkpoint, by_size=True)

    def send(batch: DataFrame, batch_id: int) -> None:
        batch.select("key", "value").write.format("kafka").options(**topic.sink_options()).save()

    return send


def print_lines() -> Sink:
    """Print all rows of each batch as ``key=value``, one partition of them at a time."""

    def show(batch: DataFrame, batch_id: int) -> None:
        for row in batch.select(console_line(F.col("key"), F.col("value"))).toLocalIterator():
            print(row[0])

    return show


def line_batches(path: str, checkpoint: str) -> Sink:
    """Write all rows of each batch as lines ``key=value``, in text files of a folder per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = f"{path}/{run_folder(spark, path, checkpoint)}/batch_id={batch_id}"
        if not complete(spark, folder):
            batch.select(console_line(F.col("key"), F.col("value"))).write.mode("overwrite").text(folder)

    return write


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that :func:`append_batches` wrote, with ``run`` and ``batch_id``.

    ``schema`` names the columns, so that an empty folder reads as an empty table.
    """
    full = f"{schema}, run STRING, batch_id BIGINT"
    return spark.read.schema(full).parquet(path)


def latest_rows(
    spark: SparkSession, path: str, schema: str, keys: Sequence[str], values: Sequence[str], sequence: str | None = None
) -> DataFrame:
    """The table that a log of updates stands for: the last values of each key, in the order of arrival by default.

    Reads the whole log; :func:`rillstat.sinks.latest.upsert_batches` keeps a table instead.
    """
    log = read_batches(spark, path, schema)
    if sequence is None:
        log, sequence = log.withColumn("_arrival", arrival()), "_arrival"
    return latest(log, keys, sequence, values)


def write_lines(df: DataFrame, path: str, line: str = "line") -> None:
    """Write lines to files that begin with a header each, the column's name."""
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
    df.select(line).write.options(header=True, **WHOLE_LINE, **blanks).csv(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a table under the shared folder, and read from there.

    For what is read more than once. Unlike a cache, it outlives the executors.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
