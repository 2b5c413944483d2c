"""Labelled rows to learn from, and calibration of scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id: str | Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    column = F.col(id) if isinstance(id, str) else id
    return F.crc32(column.cast("string").cast("binary")) % 4


def labelled_sample(
    docs: DataFrame, labels: DataFrame, target: str, id: str, text: str, per_label: int, longest: int, count: str | None = None
) -> tuple[list[tuple], float]:
    """At most ``per_label`` labels and texts of each label, and the share of label 1 among all rows to learn from.

    Learns from rows whose fold is not 2 only. An id that is labelled more than once has its
    greatest label; null ids and labels and labels other than 0 and 1 do not count. The
    sample is the rows with the least hash of the id, so it is the same each time. Texts of
    more than ``longest`` characters are not learned from, which bounds what the driver gets. With ``count`` that column
    (a whole number or null) follows each text. Of an id with several texts the greatest is taken, with the greatest of its counts.
    """
    known = labels.select(F.col(id).alias("_id"), F.col(target).cast("int").alias("_y"))
    known = known.filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (fold("_id") != 2))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    counts = {row["_y"]: row["count"] for row in known.groupBy("_y").count().collect()}
    if not counts:
        return [], 0.0
    drawn = None
    for y in sorted(counts):
        some = known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_label)
        drawn = some if drawn is None else drawn.union(some)
    # Two labels times per_label rows at most, whatever the tables hold.
    also = [] if count is None else [F.col(count).cast("bigint").alias("_count")]
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"), *also).join(F.broadcast(drawn), "_id")
    rows = rows.filter(F.length(F.coalesce("_text", F.lit(""))) <= longest)
    greatest = [F.max("_text").alias("_text")] if count is None else [
        F.max(F.struct("_text", "_count"))[name].alias(name) for name in ("_text", "_count")
    ]
    rows = rows.groupBy("_id", "_y").agg(*greatest).orderBy(F.xxhash64("_id"), "_id")
    sample = [(y, value or "", *others) for y, value, *others in rows.drop("_id").toLocalIterator()]
    return sample, counts.get(1, 0) / sum(counts.values())


def class_weights(y: np.ndarray, share: float) -> np.ndarray:
    """Weights that give the sample the labels' shares of the whole."""
    ones = max(y.mean(), 1e-9), max(1 - y.mean(), 1e-9)
    return np.where(y == 1, share / ones[0], (1 - share) / ones[1])


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients of a logistic regression, the last one for the constant, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weights * (p - y)) + penalty * beta
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
