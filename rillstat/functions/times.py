"""Event time as an instant and as epoch milliseconds."""

from __future__ import annotations

from py4j.java_gateway import get_field
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_instant(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Turn a ``timestamp_ntz`` column, read as UTC, into a ``timestamp``.

    Watermarks take only ``timestamp``. In a session that is not in UTC a bare
    cast would shift the value, so it is moved to the session's zone first.
    """
    if not isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return df
    value = F.col(ts)
    if df.sparkSession.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC"):
        value = F.convert_timezone(F.lit("UTC"), F.current_timezone(), value)
    return df.withColumn(ts, value.cast("timestamp"))


def window_millis(window: str = "window") -> Column:
    """Start of a window struct in epoch milliseconds."""
    return F.unix_millis(F.col(f"{window}.start"))


def millis(duration: str) -> int:
    """Milliseconds of a duration as Spark reads it, such as ``1 hour 30 minutes``; months have none."""
    jvm = SparkContext._active_spark_context._jvm
    text = jvm.org.apache.spark.unsafe.types.UTF8String.fromString(duration)
    interval = jvm.org.apache.spark.sql.catalyst.util.IntervalUtils.stringToInterval(text)
    months, days, micros = (get_field(interval, name) for name in ("months", "days", "microseconds"))
    if months:
        raise ValueError(f"months and years differ in length: {duration!r}")
    total = days * 86_400_000_000 + micros
    if total <= 0 or total % 1000:
        raise ValueError(f"not a positive number of milliseconds: {duration!r}")
    return total // 1000
