"""Hard negatives by exact scores, with the Method of Four Russians.

Vectors are rounded down to integers and kept as bit planes: for eight dimensions and one bit
a byte. For a tile of anchors and each group of eight dimensions a table holds the sums
of the anchors' components over all 256 subsets. A candidate's byte picks a row of the table, so
a plane costs a lookup for each group; the planes' sums are shifted and added, the top
plane negatively. The result is the inner product itself.

Anchors are taken a block at a time against all rows, which stay where they lie: a task holds
the best of its rows for each anchor, and only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstat.operators.ranking import ranked
from rillstat.session import new_folder
from rillstat.sinks.tables import stored

#: Anchors and candidates that are scored together, so that tables and scores stay in a core's cache.
TILE, SLAB = 256, 1024

_LOWEST = np.iinfo(np.int64).min
_FOUND = "query BIGINT, score BIGINT, id BIGINT"


def to_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """``rows x planes x groups`` bytes of ``rows x dimensions`` integers; a multiple of eight dimensions."""
    bits = (values[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def from_planes(planes: np.ndarray) -> np.ndarray:
    """The integers of :func:`to_planes`; the top plane counts negatively."""
    bits = np.unpackbits(planes, axis=2, bitorder="little").astype(np.int64)
    weights = 1 << np.arange(planes.shape[1], dtype=np.int64)
    weights[-1] *= -1
    return np.einsum("p,rpd->rd", weights, bits)


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """``groups x 256 x anchors``: the sum of an anchor's components over each subset of a group's eight."""
    groups = anchors.shape[1] // 8
    tables = np.zeros((groups, 256, len(anchors)), dtype=kind)
    for bit in range(8):
        tables[:, 1 << bit:2 << bit] = tables[:, :1 << bit] + anchors.T.reshape(groups, 8, 1, -1)[:, bit].astype(kind)
    return tables


def scores(tables: np.ndarray, planes: np.ndarray, kind: type) -> np.ndarray:
    """``candidates x anchors`` inner products, by lookups and shifts from the top plane down."""
    out = np.zeros((len(planes), tables.shape[2]), dtype=kind)
    piece, part = np.empty(out.shape, tables.dtype), np.empty(out.shape, tables.dtype)
    for plane in range(planes.shape[1] - 1, -1, -1):
        part[:] = 0
        for group, table in enumerate(tables):
            np.take(table, planes[:, plane, group], axis=0, out=piece, mode="clip")
            part += piece
        if plane == planes.shape[1] - 1:
            out -= part
        else:
            out += out
            out += part
    return out


class Best:
    """The ``k`` best ``(score, id)`` of each query so far: high scores, then low ids."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), _LOWEST)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, queries: np.ndarray, found: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Take the scores ``found`` (candidates x queries) that lie from ``low`` to ``high``."""
        worst = self.score[queries, -1]
        if len(ids) > 4 * self.k and (worst == _LOWEST).any():
            # A first look for a bound, so that few candidates are sorted.
            inside = np.where((found >= low) & (found <= high), found, _LOWEST)
            worst = np.maximum(worst, np.partition(inside, len(ids) - self.k, axis=0)[len(ids) - self.k])
        row, column = np.nonzero((found >= np.maximum(low, worst)) & (found <= high))
        query, score, id = queries[column], found[row, column].astype(np.int64), ids[row]
        better = (score > self.score[query, -1]) | (id < self.id[query, -1])
        query, score, id = query[better], score[better], id[better]
        if not len(query):
            return
        touched = np.unique(query)
        query = np.concatenate([query, np.repeat(touched, self.k)])
        score = np.concatenate([score, self.score[touched].ravel()])
        id = np.concatenate([id, self.id[touched].ravel()])
        # The complement turns the order round and unlike the negative cannot overflow.
        order = np.lexsort((id, ~score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        first = rank < self.k
        self.score[query[first], rank[first]] = score[order][first]
        self.id[query[first], rank[first]] = id[order][first]

    def batch(self) -> pa.RecordBatch:
        query, place = np.nonzero(self.score > _LOWEST)
        arrays = [pa.array(query), pa.array(self.score[query, place]), pa.array(self.id[query, place])]
        return pa.RecordBatch.from_arrays(arrays, names=["query", "score", "id"])


class Block:
    """Some of the anchors: ids, labels and components, sorted by label."""

    def __init__(self, table: pa.Table, planes: int, kinds: tuple[type, type]):
        table = table.sort_by([("label", "ascending"), ("id", "ascending")])
        self.id, self.label = table["id"].to_numpy(), table["label"].to_numpy()
        self.planes, self.kinds = planes, kinds
        self.values = from_planes(_matrix(table["planes"].combine_chunks(), planes))

    def tiles(self, within: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of some anchors and their tables."""
        numbers = np.arange(len(self.id)) if within is None else within
        for start in range(0, len(numbers), TILE):
            part = numbers[start:start + TILE]
            yield part, subset_sums(self.values[part], self.kinds[0])


def _matrix(column: pa.Array, planes: int) -> np.ndarray:
    rows = len(column)
    data = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8)
    return data.reshape(rows, planes, -1 if rows else 1)


def _scan(rows: DataFrame, block: Block, queries: int, k: int, work: Callable) -> DataFrame:
    """``query, score, id``: the ``k`` best of each query among all rows, as each task finds them in its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(queries, k)
        for batch in batches:
            id, label = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            work(best, id, label, _matrix(batch.column("planes"), block.planes))
        yield best.batch()

    return rows.select("id", "label", "planes").mapInArrow(run, _FOUND)


def _same_label(block: Block):
    """Each anchor against the other rows of its label."""
    kinds, everything = block.kinds, (np.int64(_LOWEST + 1), np.int64(2**63 - 1))

    def work(best: Best, ids: np.ndarray, labels: np.ndarray, planes: np.ndarray) -> None:
        for label in np.intersect1d(labels, block.label):
            rows = np.flatnonzero(labels == label)
            low, high = np.searchsorted(block.label, [label, label + 1])
            for anchors, tables in block.tiles(np.arange(low, high)):
                for start in range(0, len(rows), SLAB):
                    some = rows[start:start + SLAB]
                    found = scores(tables, planes[some], kinds[1]).astype(np.int64)
                    found[ids[some][:, None] == block.id[anchors]] = _LOWEST
                    best.offer(anchors, found, ids[some], *everything)

    return work


def _in_windows(block: Block, low: np.ndarray, high: np.ndarray):
    """Each anchor against the rows of other labels, with a window of scores for each of its positives."""
    kinds, width = block.kinds, low.shape[1]

    def work(best: Best, ids: np.ndarray, labels: np.ndarray, planes: np.ndarray) -> None:
        for anchors, tables in block.tiles():
            for start in range(0, len(ids), SLAB):
                some = slice(start, start + SLAB)
                found = scores(tables, planes[some], kinds[1]).astype(np.int64)
                found[labels[some][:, None] == block.label[anchors]] = _LOWEST
                for place in range(width):
                    best.offer(anchors * width + place, found, ids[some], low[anchors, place], high[anchors, place])

    return work


def _packed(rows: DataFrame, scale: int) -> tuple[DataFrame, int, tuple[type, type]]:
    """``id, label, planes`` of the valid rows, the number of planes, and types wide enough for table sums and scores."""
    shape = rows.agg(
        F.max(F.greatest(F.array_max(F.transform("vector", lambda x: F.abs(x))), F.lit(0.0))).alias("most"),
        F.max(F.size("vector")).alias("dimensions"),
    ).first()
    most, dimensions = int(scale * (shape["most"] or 0.0)) + 1, max(8, -(-(shape["dimensions"] or 0) // 8) * 8)
    if most >= 1 << 30 or dimensions * most * most >= 1 << 54:
        # Scores are multiplied by percentages, too.
        raise ValueError(f"scores of {dimensions} components up to {most} do not fit in 64 bits")
    planes = most.bit_length() + 1
    kinds = tuple(
        next(kind for kind in (np.int16, np.int32, np.int64) if reach < np.iinfo(kind).max)
        for reach in (dimensions * most, dimensions * most * most)
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values = np.zeros((batch.num_rows, dimensions), dtype=np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            values[row, place] = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
            whole = to_planes(values, planes).reshape(batch.num_rows, -1)
            binary = pa.array([line.tobytes() for line in whole], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), binary], names=["id", "label", "planes"])

    made = rows.mapInArrow(pack, "id BIGINT, label BIGINT, planes BINARY")
    # One row per id: of rows that repeat an id the first by label and then by planes.
    least = made.groupBy("id").agg(F.min(F.struct("label", "planes")).alias("row")).select("id", "row.*")
    return stored(least, "planes"), planes, kinds


def mined(
    rows: DataFrame, is_anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label", *,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, block: int = 16_384,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A component x counts as ``floor(scale * x)``, a score is the inner product with the anchor. Higher scores come
    first, ties by id. The positives of an anchor (the rows that ``is_anchor``, a condition on ``id``, holds for) are
    its first ``positives`` other rows of the same label. For each of them come the first ``negatives`` rows of another label with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``, numbered from 1 in ``rank``; a
    positive without any has no row.

    ``block`` is the number of anchors, about, that are sent to the tasks at a time; each block is one pass over all rows for the
    positives and one for the negatives. Nothing else is bounded and all scores are exact.

    Rows without id, label or vector, or with a null or non-finite component, take no part. Vectors shorter than the longest one go
    on with zeros, so an empty one scores 0. Of rows that repeat an id the first one by label and vector takes part.
    Other columns are ignored. An empty table, or one without anchors, has no rows. Components whose scores
    might not fit in 64 bits raise a ``ValueError``.
    """
    sane = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    source = rows.select(
        F.col(id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("vector"),
    )
    source = source.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(sane, F.lit(False)))
    packed, planes, kinds = _packed(source, scale)
    anchors = packed.withColumn(id, F.col("id")).filter(is_anchor).select("id", "label", "planes")
    blocks = max(1, -(-anchors.count() // block))
    path = new_folder(rows.sparkSession, "negatives")
    made = "anchor_id BIGINT, positive_id BIGINT, rank INT, negative_id BIGINT, positive_score BIGINT, negative_score BIGINT"
    best_first = [F.col("score").desc(), F.col("id")]
    for number in range(blocks):
        some = Block(anchors.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).toArrow(), planes, kinds)
        count = len(some.id)
        found = ranked(_scan(packed, some, count, positives, _same_label(some)), ["query"], best_first, positives)
        found = found.toArrow()  # as many rows as the block has positives
        query, place = found["query"].to_numpy(), found["rank"].to_numpy() - 1
        own = np.zeros((count, positives, 2), dtype=np.int64)
        own[query, place] = np.stack([found["id"].to_numpy(), found["score"].to_numpy()], axis=1)
        # Where an anchor has fewer positives, no score lies from 1 to 0.
        floor, ceiling = np.ones((count, positives), np.int64), np.zeros((count, positives), np.int64)
        floor[query, place] = -(-low * own[query, place, 1] // 100)
        ceiling[query, place] = high * own[query, place, 1] // 100
        chosen = ranked(_scan(packed, some, count * positives, negatives, _in_windows(some, floor, ceiling)), ["query"], best_first, negatives)
        names = pa.table({
            "query": np.arange(count * positives), "anchor_id": np.repeat(some.id, positives),
            "positive_id": own[:, :, 0].ravel(), "positive_score": own[:, :, 1].ravel(),
        })
        chosen = chosen.join(rows.sparkSession.createDataFrame(names), "query")
        chosen = chosen.select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )
        chosen.write.parquet(f"{path}/block={number}")
    return rows.sparkSession.read.schema(made).parquet(path).select(*(name.split()[0] for name in made.split(", ")))
