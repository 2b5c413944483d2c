"""Line files and tables as batch or streaming sources."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Makes one field of a line: separator, quote and escape are the line end, which no
#: line can hold. What remains of the CSV format is that it knows headers.
WHOLE_LINE = {"sep": "\n", "quote": "\n", "escape": "\n"}


def _reader(spark: SparkSession, stream: bool, files_per_trigger: int | None, bytes_per_trigger: int | None):
    if not stream:
        return spark.read
    reader = spark.readStream
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger is not None:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader


def read_lines(
    spark: SparkSession,
    path: str,
    *,
    header: bool = False,
    stream: bool = False,
    tag: bool = False,
    since: datetime | None = None,
    files_per_trigger: int | None = None,
    bytes_per_trigger: int | None = None,
    place: bool = False,
) -> DataFrame:
    """The raw lines of the files at ``path`` as ``key, ts, line``.

    ``header=True`` skips the first line of each file, and empty lines with it.
    ``ts`` is the arrival time. ``key`` is NULL, or with ``tag=True`` the part of
    the file name before the first ``_``. ``since`` leaves out files last changed
    before it. The pace of a streaming read is set per trigger, in files or bytes; :mod:`rillstat.streaming.replay`
    goes by lines. ``place=True`` adds the ``file`` and the start of its ``block`` that the line is in.
    """
    reader = _reader(spark, stream, files_per_trigger, bytes_per_trigger)
    if header:
        lines = reader.options(header=True, **WHOLE_LINE).schema("line STRING").csv(path)
    else:
        lines = reader.text(path).withColumnRenamed("value", "line")
    if since is not None:
        lines = lines.where(F.col("_metadata.file_modification_time") >= F.lit(since))
    key = F.split_part("_metadata.file_name", F.lit("_"), F.lit(1)) if tag else F.lit(None).cast("string")
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")] if place else []
    return lines.select(key.alias("key"), F.current_timestamp().alias("ts"), "line", *at)


def read_table(
    spark: SparkSession,
    path: str,
    *,
    schema: str | None = None,
    stream: bool = False,
    files_per_trigger: int | None = None,
    bytes_per_trigger: int | None = None,
) -> DataFrame:
    """A parquet table, or a stream of its files; a stream may be of a single file."""
    if not stream:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    reader = _reader(spark, True, files_per_trigger, bytes_per_trigger)
    schema = schema or spark.read.parquet(path).schema
    # The file source takes a folder or a pattern, but no bare file name.
    pattern = path[:-1] + f"[{path[-1]}]" if path.endswith(".parquet") else path
    return reader.schema(schema).parquet(pattern)
