"""Starting streams, running them to the end of their input, and closing windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillstat.session import STATE_SETTINGS, settings
from rillstat.sinks.tables import Sink, file_system, folders

#: Later than any event, yet far enough from the end of time to subtract a delay.
END_OF_TIME = "9000-01-01 00:00:00"


def checkpoint_at(folder: str, fresh: bool = False) -> str:
    """The newest checkpoint of a job under ``folder``; a fresh one is a new one, without state.

    Checkpoints are numbered, so that a fresh run that was stopped is the one that is taken up again.
    """
    spark = SparkSession.active()
    numbers = [int(name[4:]) for name in folders(spark, folder, "run-")]
    checkpoint = f"{folder}/run-{max(numbers, default=0) + bool(fresh and numbers):06d}"
    files, make = file_system(spark, checkpoint)
    files.mkdirs(make(checkpoint))
    return checkpoint


def start(
    rows: DataFrame,
    sink: Sink,
    *,
    checkpoint: str,
    output_mode: str = "append",
    every: str | None = None,
    name: str | None = None,
    state_partitions: int | None = None,
) -> StreamingQuery:
    """Start a stream into a sink, from the checkpoint if there is one.

    ``every`` is the trigger interval; without it the stream takes all input there
    is and stops. ``name`` names the query and its state in the progress reports.
    ``state_partitions`` is the number of shuffle and state partitions; it is fixed
    by the first run on a checkpoint.
    """
    values = dict(STATE_SETTINGS)
    if state_partitions is not None:
        values["spark.sql.shuffle.partitions"] = str(state_partitions)
    writer = rows.writeStream.outputMode(output_mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    with settings(rows.sparkSession, values):
        return writer.start()


def drain(query: StreamingQuery, timeout: float | None = None) -> None:
    """Wait until an ``availableNow`` stream has taken its input; stop it at the timeout."""
    if timeout is None:
        query.awaitTermination()
        return
    try:
        if not query.awaitTermination(timeout):
            raise TimeoutError(f"stream {query.name or query.id} not done in {timeout} s")
    finally:
        query.stop()


def closable(rows: DataFrame, folder: str, ts: str = "ts") -> DataFrame:
    """A stream that :func:`close_windows` on the same folder brings to its end.

    The closing row has only a time. It falls into a window of its own, which in
    append mode is never emitted.
    """
    spark = rows.sparkSession
    closing = spark.createDataFrame([], f"{ts} TIMESTAMP")
    closing.write.mode("append").parquet(folder)
    return rows.unionByName(spark.readStream.schema(closing.schema).parquet(folder), allowMissingColumns=True)


def close_windows(spark: SparkSession, folder: str, ts: str = "ts") -> None:
    """Let the watermark of a :func:`closable` stream pass all its windows."""
    spark.range(1).select(F.lit(END_OF_TIME).cast("timestamp").alias(ts)).write.mode("append").parquet(folder)


def run_to_close(
    spark: SparkSession, build: Callable[[], tuple[DataFrame, Sink]], folder: str, checkpoint: str, **options
) -> None:
    """Run an append stream over all its input, then once more with its windows closed.

    ``build`` gives the stream, made :func:`closable` on ``folder``, and its sink.
    The input must be read whole before the windows close, hence two runs on one
    checkpoint.
    """
    drain(start(*build(), checkpoint=checkpoint, **options))
    close_windows(spark, folder)
    drain(start(*build(), checkpoint=checkpoint, **options))
