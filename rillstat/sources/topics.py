"""Topics of key/value records, on brokers or as files.

A topic without servers is a folder of parquet files with the columns
``key, value, ts``, written by :func:`rillstat.sinks.tables.append_batches`. It
serves where no connector is installed, and every job can run on it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "key STRING, value STRING, ts TIMESTAMP"
PLACE = "run STRING, batch_id BIGINT"


def arrival(run: str = "run", batch: str = "batch_id") -> Column:
    """A number that rises with the run, which begins with its number, and with the batch in it."""
    number = F.split_part(F.col(run).cast("string"), F.lit("-"), F.lit(1)).try_cast("bigint")
    return F.coalesce(number, F.lit(0)) * F.lit(1 << 40) + F.coalesce(F.col(batch), F.lit(0))


@dataclass(frozen=True)
class Topic:
    """A topic name on ``servers``, or the path of a folder if there are none.

    ``start`` is ``earliest`` or ``latest``; it holds for the first run on a
    checkpoint. ``options`` go to the connector as they are (``kafka.``-prefixed
    client settings, ``maxOffsetsPerTrigger`` and the like).
    """

    name: str
    servers: str | None = None
    start: str = "earliest"
    options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.start not in ("earliest", "latest"):
            raise ValueError(f"start must be 'earliest' or 'latest', not {self.start!r}")
        if self.servers is None and self.start == "latest":
            raise ValueError("a topic of files has no latest offset; read it from 'earliest'")

    def source_options(self, stream: bool = True) -> dict[str, str]:
        """Options of a read. Only a stream can start at the latest offset."""
        given = {"kafka.bootstrap.servers": self.servers, "subscribe": self.name}
        if stream or self.start == "earliest":
            given["startingOffsets"] = self.start
        return given | self.options

    def sink_options(self) -> dict[str, str]:
        """Options of a write."""
        client = {name: value for name, value in self.options.items() if name.startswith("kafka.")}
        return {"kafka.bootstrap.servers": self.servers, "topic": self.name} | client


def read_topic(spark: SparkSession, topic: Topic, *, stream: bool = True, binary: bool = False) -> DataFrame:
    """The records of a topic as ``key, value, ts, seq``.

    Key and value are text, or bytes as they came with ``binary=True``. ``seq`` rises in the
    order in which the records of a key arrived: the offset, as a key has one partition, or run
    and batch of a folder. Files that no job put there have neither, and go by ``ts``.
    """
    if topic.servers is None:
        reader = spark.readStream if stream else spark.read
        schema = RECORD.replace("STRING", "BINARY") if binary else RECORD
        options = {name: value for name, value in topic.options.items() if not name.startswith("kafka.")}
        records = reader.schema(f"{schema}, {PLACE}").options(**options).parquet(topic.name)
        seq = F.when(F.col("batch_id").isNull(), F.unix_micros("ts")).otherwise(arrival())
        return records.select("key", "value", "ts", seq.alias("seq"))
    reader = spark.readStream if stream else spark.read
    records = reader.format("kafka").options(**topic.source_options(stream)).load()
    kind = "binary" if binary else "string"
    return records.select(
        F.col("key").cast(kind).alias("key"),
        F.col("value").cast(kind).alias("value"),
        F.col("timestamp").alias("ts"),
        F.col("offset").alias("seq"),
    )
