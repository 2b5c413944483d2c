"""Result texts read back into columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstat.functions.text import RESULT_FIELDS


def parse_result_json(records: DataFrame, value: str = "value") -> DataFrame:
    """Replace a JSON result by ``market, start_time, count, utput``.

    Takes the form without windows too, where market and start are NULL.
    """
    kept = [name for name in records.columns if name != value]
    parsed = records.select(*kept, F.from_json(value, RESULT_FIELDS).alias("_result"))
    return parsed.select(
        *kept,
        F.col("_result.market").alias("market"),
        F.col("_result.start_time").try_cast("bigint").alias("start_time"),
        F.col("_result.count").try_cast("bigint").alias("count"),
        F.col("_result.UTput").try_cast("double").alias("utput"),
    )


def parse_message(records: DataFrame, value: str = "value") -> DataFrame:
    """Replace a message ``series,value,start`` by ``market, utput, start_time``."""
    kept = [name for name in records.columns if name != value]
    part = lambda i: F.get(F.split(value, ","), F.lit(i))
    return records.select(
        *kept,
        part(0).alias("market"),
        part(1).try_cast("double").alias("utput"),
        part(2).try_cast("bigint").alias("start_time"),
    )
