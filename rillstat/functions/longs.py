"""Long values as eight bytes, big end first, as long serializers write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def long_bytes(value: Column) -> Column:
    """A bigint as eight bytes."""
    return F.unhex(F.lpad(F.hex(value), 16, "0"))


def long_value(data: Column) -> Column:
    """Eight bytes as a bigint."""
    return F.conv(F.hex(data), 16, -10).cast("bigint")
