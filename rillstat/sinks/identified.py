"""Records that name themselves, so that what a broker got twice is read once.

A sink that is not transactional may send a batch again after a failure. Each record therefore carries an id made of
the run, the batch and what it holds, which a repeat gives it again, and the reader drops ids it has seen. It forgets an
id once the watermark has passed the record's time, so its state holds the ids of the lateness and no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstat.sinks.tables import Sink, run_of
from rillstat.sources.topics import RECORD, Topic

#: The name of the header that has the id on a broker.
HEADER = "record-id"


def identified(batch: DataFrame, checkpoint: str, batch_id: int) -> DataFrame:
    """``batch`` (``key, value`` and others) with ``record_id``; records of a batch with equal keys and values are numbered."""
    content = F.sha1(F.concat(*(F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("")) for name in ("key", "value"))))
    same = Window.partitionBy("key", "value").orderBy(F.lit(0))
    return batch.withColumn("record_id", F.concat_ws("-", F.lit(run_of(checkpoint)), F.lit(str(batch_id)), content, F.row_number().over(same)))


def header() -> Column:
    """The id as a header, as the connector takes it."""
    return F.array(F.struct(F.lit(HEADER).alias("key"), F.col("record_id").cast("binary").alias("value")))


def send_identified(topic: Topic, checkpoint: str) -> Sink:
    """Append records with their ids to a topic, each time they come: a repeat of a batch is a repeat in the topic."""

    def send(batch: DataFrame, batch_id: int) -> None:
        named = identified(batch, checkpoint, batch_id)
        if topic.servers is None:
            named.select("key", "value", "ts", "record_id").write.mode("append").parquet(topic.name)
            return
        records = named.select("key", "value", header().alias("headers"))
        records.write.format("kafka").options(**topic.sink_options()).save()

    return send


def read_once(spark: SparkSession, topic: Topic, lateness: str = "10 minutes") -> DataFrame:
    """A stream of the records ``key, value, ts, record_id`` of a topic, each id once.

    A repeat that comes more than ``lateness`` of event time after its first appearance may pass. Records without an id are
    records of their own kind and all pass.
    """
    if topic.servers is None:
        rows = spark.readStream.schema(f"{RECORD}, record_id STRING").options(**topic.options).parquet(topic.name)
    else:
        with_header = Topic(topic.name, topic.servers, topic.start, topic.options | {"includeHeaders": "true"})
        raw = spark.readStream.format("kafka").options(**with_header.source_options()).load()
        named = F.filter("headers", lambda one: one["key"] == HEADER)
        rows = raw.select(
            F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ts"),
            F.get(named, F.lit(0))["value"].cast("string").alias("record_id"),
        )
    # Without an id a record is known by nothing that a repeat would share.
    rows = rows.withColumn("_known", F.coalesce("record_id", F.uuid()))
    return rows.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["_known"]).drop("_known")

