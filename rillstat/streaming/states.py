"""The state of a stateful stream as a table, read from its checkpoint.

The state is what the stream knows after a batch, without its sink: the counts of every key, or the points that a series
holds. The stream may be running or stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def state_operators(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``operator, name, store, partitions, first_batch, last_batch`` of each state in a checkpoint."""
    found = spark.read.format("state-metadata").load(checkpoint)
    return found.select(
        F.col("operatorId").alias("operator"), F.col("operatorName").alias("name"), F.col("stateStoreName").alias("store"),
        F.col("numPartitions").alias("partitions"), F.col("minBatchId").alias("first_batch"), F.col("maxBatchId").alias("last_batch"),
    )


def state_table(
    spark: SparkSession, checkpoint: str, operator: int = 0, batch: int | None = None, variable: str | None = None, lists: bool = False
) -> DataFrame:
    """The keys and values of a state after a ``batch``, the last one by default, one column for each of their fields.

    ``operator`` counts the stateful steps of the stream from 0. ``variable`` names the state of a processor that has
    several; of a list state every element is a row with ``lists``.
    """
    options = {"operatorId": str(operator)}
    if batch is not None:
        options["batchId"] = str(batch)
    if variable is not None:
        options["stateVarName"] = variable
    if lists:
        options["flattenCollectionTypes"] = "true"
    state = spark.read.format("statestore").options(**options).load(checkpoint)
    return state.select("key.*", "list_element.*" if lists else "value.*")
