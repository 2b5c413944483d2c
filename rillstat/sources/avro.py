"""Records in Avro with the five-byte registry frame: a zero byte and a schema id.

Needs Spark's external Avro module on the class path.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAME = 5

#: Feed items. Fields and types, in order, of the records on the topic.
FEED_SCHEMA = json.dumps({
    "type": "record",
    "name": "feed_item",
    "fields": [
        {"name": "user", "type": "string"},
        {"name": "is_new", "type": "boolean"},
        {"name": "content", "type": ["string", "null"]},
    ],
})

def unframed(value: Column) -> Column:
    """The Avro bytes behind the frame."""
    return F.substring(value, FRAME + 1, 2**31 - 1 - FRAME)


def framed(value: Column, schema_id: int) -> Column:
    """Avro bytes with the frame of a registered schema in front."""
    return F.concat(F.unhex(F.lit(f"{0:02x}{schema_id:08x}")), value)


def is_framed(value: Column, schema_id: int | None = None) -> Column:
    """Whether the value begins with a frame, and one of the given schema if there is one; false for NULL."""
    known = (F.octet_length(value) >= FRAME) & (F.substring(value, 1, 1) == F.unhex(F.lit("00")))
    if schema_id is not None:
        known &= F.substring(value, 2, FRAME - 1) == F.unhex(F.lit(f"{schema_id:08x}"))
    return F.coalesce(known, F.lit(False))


def foreign(records: DataFrame, schema_id: int | None = None, value: str = "value") -> DataFrame:
    """The records that :func:`decode` leaves out: without a frame, or of another schema."""
    return records.where(~is_framed(F.col(value), schema_id))


def decode(records: DataFrame, schema: str, value: str = "value", schema_id: int | None = None) -> DataFrame:
    """Replace the framed Avro column by the fields of its record; :func:`foreign` records are left out."""
    from pyspark.sql.avro.functions import from_avro

    records = records.where(is_framed(F.col(value), schema_id))

    kept = [name for name in records.columns if name != value]
    decoded = from_avro(unframed(F.col(value)), schema).alias("_record")
    return records.select(*kept, decoded).select(*kept, "_record.*")


def encode(rows: DataFrame, fields: list[str], schema: str, schema_id: int, key: str | None = None) -> DataFrame:
    """``key, value`` with the fields as a framed Avro record."""
    from pyspark.sql.avro.functions import to_avro

    key_column = F.lit(None).cast("string") if key is None else F.col(key).cast("string")
    return rows.select(
        key_column.alias("key"), framed(to_avro(F.struct(*fields), schema), schema_id).alias("value")
    )
