"""Arrow batches in slices of bounded size, and tables kept between passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are worked on at a time; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, columns: list[str], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` with at most ``limit`` bytes in the string ``columns``, one row at least."""
    total = np.zeros(batch.num_rows, dtype=np.int64)
    for name in columns:
        column = batch.column(batch.schema.get_field_index(name))
        total += pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(total)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_slices(texts: list[str], limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive texts as Arrow arrays of at most ``limit`` characters, one text at least."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield pa.array(texts[start:i], pa.large_string())
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield pa.array(texts[start:], pa.large_string())


def map_slices(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, columns: list[str],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Apply ``work`` to slices of ``df``; rows in, any number of rows out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, columns, limit):
                made = work(piece)
                if made is not None and made.num_rows:
                    yield made

    return df.mapInArrow(run, schema)


def text_column(work: Callable[[pa.RecordBatch], pa.Array], type: str, columns: list[str], limit: int = SLICE_BYTES) -> Column:
    """A column computed from slices of ``columns``, of which the first is the text."""

    def whole(*arrays: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays(list(arrays), names=columns)
        return pa.concat_arrays([work(piece) for piece in slices(batch, columns[:1], limit)] or [work(batch)])

    if len(columns) == 1:
        def one(text: pa.Array) -> pa.Array:
            return whole(text)
        return F.arrow_udf(one, type)(*columns)

    def two(text: pa.Array, other: pa.Array) -> pa.Array:
        return whole(text, other)

    return F.arrow_udf(two, type)(*columns)


def free_names(taken: list[str], count: int) -> list[str]:
    """Names for ``count`` columns beside those ``taken``, which may have any names."""
    lowered = {name.lower() for name in taken}
    free = (f"own_{i}" for i in range(len(taken) + count))
    return [name for name in free if name not in lowered][:count]
