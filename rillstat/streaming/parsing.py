"""Parsing a stream of telemetry lines with every line accounted for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rillstat.operators.telemetry import examined
from rillstat.sinks.tables import Sink, complete, run_folder

#: What becomes of a line.
KINDS = ("parsed", "rejected", "empty")

COUNTS = "lines BIGINT, parsed BIGINT, rejected BIGINT, empty BIGINT, run STRING, batch_id BIGINT"


def parse_batches(path: str, checkpoint: str, line: str = "line") -> Sink:
    """Write each batch of lines once, cut into parsed ones, rejected ones and empty ones, and how many there were of each.

    The numbers are observed in the pass that writes, so they are those of the rows written. A batch whose numbers are there is
    complete and left alone when it comes again. See :func:`lines_of` and :func:`line_counts`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        place = f"{run_folder(spark, path + '/lines', checkpoint)}/batch_id={batch_id}"
        counts = f"{path}/counts/{place}"
        if complete(spark, counts):
            return
        seen = Observation(f"lines-{batch_id}")
        rows = examined(batch, line)
        rows = rows.observe(
            seen, F.count(F.lit(1)).alias("lines"), *(F.count_if(F.col("kind") == kind).alias(kind) for kind in KINDS)
        )
        rows.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/lines/{place}")
        found = seen.get
        row = tuple(int(found[name]) for name in ("lines", *KINDS))
        spark.createDataFrame([row], ", ".join(f"{name} BIGINT" for name in ("lines", *KINDS))).write.mode("overwrite").parquet(counts)

    return write


def lines_of(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """The rows of one kind that :func:`parse_batches` wrote: ``schema`` names those of their columns that are wanted."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}, not {kind!r}")
    rows = spark.read.schema(f"{schema}, run STRING, batch_id BIGINT, kind STRING").parquet(f"{path}/lines")
    return rows.where(F.col("kind") == kind).drop("kind", "run", "batch_id")


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """``lines, parsed, rejected, empty`` of each batch, with ``run`` and ``batch_id``."""
    return spark.read.schema(COUNTS).parquet(f"{path}/counts")
