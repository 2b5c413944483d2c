"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its distinct words, hashed to buckets, and one bin for each
statistic of its structure and for its character count. Beside a weight per feature the
model has a short vector per feature, and each pair of features counts with the product of
their vectors. The sum over all pairs is half of the squared sum less the sum of squares,
so scoring is linear in the number of features.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstat.llm.batches import text_column, text_slices
from rillstat.llm.hashing import LOWER, SPACE, distinct_by_row, span_hashes, utf8, words
from rillstat.llm.labels import class_weights, fold, labelled_sample, logistic, sigmoid

#: Buckets that words are hashed to, and bins per statistic; one more is for a value that is not known.
BUCKET_BITS = 16
BINS = 16
WIDTH = BINS + 1

_LINE_END = np.zeros(256, dtype=bool)
_LINE_END[10] = True


def _classes() -> np.ndarray:
    """Byte classes whose shares are statistics: A-Z, a-z, 0-9, line ends, bars, exclamation marks, signs, points, other letters."""
    table = np.zeros((9, 256), dtype=bool)
    for row, members in enumerate((range(65, 91), range(97, 123), range(48, 58), b"\n", b"|", b"!", b"#$%&*=<>{}[]\\^~@", b".,;:?", range(128, 256))):
        table[row, list(members)] = True
    return table


def statistics(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """One row of structure statistics for each text."""
    size = np.maximum(np.diff(offsets), 1)
    count = np.diff(bounds)
    some = np.maximum(count, 1)

    def share(flags: np.ndarray, edges: np.ndarray, whole: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (sums[edges[1:]] - sums[edges[:-1]]) / whole

    columns = [share(row[data], offsets, size) for row in _classes()]
    length = ends - starts
    letter = np.zeros(256, dtype=bool)
    letter[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    columns += [np.log1p(size), np.log1p(count), share(length, bounds, some), share(length == 1, bounds, some)]
    columns += [share(length > 15, bounds, some), distinct / some]
    columns.append(share(~letter[data[ends - 1]] if len(ends) else length == 0, bounds, some))
    columns.append(share(~letter[data[starts]] if len(starts) else length == 0, bounds, some))
    begin, stop, lines = words(data, offsets, _LINE_END)
    _, kinds = distinct_by_row(span_hashes(data, begin, stop), lines[:-1], lines[1:])
    number = np.maximum(np.diff(lines), 1)
    columns += [np.log1p(number), np.log1p(size / number), np.diff(kinds) / number]
    return np.column_stack(columns)


@dataclass
class Features:
    """Hashed words of each row (with the rows' offsets) and its statistics."""

    words: np.ndarray
    bounds: np.ndarray
    statistics: np.ndarray


def features(column: pa.Array, n_chars: pa.Array | None = None) -> Features:
    """Features of texts, and of their declared character counts; a count that is null or not given is not known."""
    data, offsets = utf8(column)
    starts, ends, bounds = words(data, offsets, SPACE)
    hashes = span_hashes(LOWER[data], starts, ends) >> np.uint64(64 - BUCKET_BITS)
    hashed, kinds = distinct_by_row(hashes, bounds[:-1], bounds[1:])
    shape = statistics(data, offsets, starts, ends, bounds, np.diff(kinds))
    declared = np.full(len(column), np.nan)
    if n_chars is not None:
        declared = pc.fill_null(pc.cast(n_chars, pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    return Features(hashed.astype(np.int64), kinds, np.column_stack([shape, np.log1p(np.maximum(declared, -0.5))]))


def bin_edges(statistics: np.ndarray) -> np.ndarray:
    """For each statistic the values that cut its known ones to ``BINS`` equal parts."""
    marks = np.linspace(0, 1, BINS + 1)[1:-1]
    known = [column[~np.isnan(column)] for column in statistics.T]
    return np.array([np.quantile(column, marks) if len(column) else np.zeros(len(marks)) for column in known])


@dataclass
class FactorisationMachine:
    """Weights and vectors of hashed words and of the statistics' bins."""

    edges: np.ndarray
    rank: int = 8
    seed: int = 7
    constant: float = 0.0
    weights: np.ndarray = field(init=False)
    vectors: np.ndarray = field(init=False)
    scale: tuple[float, float] = (1.0, 0.0)

    def __post_init__(self):
        size = (1 << BUCKET_BITS) + len(self.edges) * WIDTH
        self.weights = np.zeros(size, dtype=np.float32)
        self.vectors = np.random.default_rng(self.seed).normal(0, 0.05, (size, self.rank)).astype(np.float32)

    def rows(self, made: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers and values of all rows, and the rows' offsets; words have unit length together."""
        n, kinds = made.statistics.shape
        bins = np.column_stack([np.searchsorted(self.edges[j], made.statistics[:, j], side="right") for j in range(kinds)])
        bins[np.isnan(made.statistics)] = BINS
        bins += (1 << BUCKET_BITS) + np.arange(kinds) * WIDTH
        count = np.diff(made.bounds)
        bounds = made.bounds + np.arange(n + 1) * kinds
        index = np.empty(bounds[-1], dtype=np.int64)
        value = np.empty(bounds[-1], dtype=np.float32)
        at = np.arange(len(made.words)) + np.repeat(np.arange(n) * kinds, count)
        index[at], value[at] = made.words, np.repeat(1 / np.sqrt(np.maximum(count, 1)), count)
        at = (bounds[1:, None] - kinds + np.arange(kinds)).ravel()
        index[at], value[at] = bins.ravel(), 1 / np.sqrt(kinds)
        return index, value, bounds

    def raw(self, index: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The model's sum for each row, the rows' summed vectors, and the features' scaled vectors."""
        scaled = self.vectors[index] * value[:, None]
        total = np.add.reduceat(scaled, bounds[:-1], axis=0)
        squares = np.add.reduceat(scaled * scaled, bounds[:-1], axis=0)
        linear = np.add.reduceat(self.weights[index] * value, bounds[:-1])
        return self.constant + linear + 0.5 * (total * total - squares).sum(axis=1), total, scaled

    def fit(self, made: Features, y: np.ndarray, sample_weights: np.ndarray, epochs: int, step: float = 0.1, batch: int = 64) -> None:
        """Logistic loss, adaptive steps; rows in a fixed random order. Bins that no row has are left with nothing to say."""
        index, value, bounds = self.rows(made)
        random = np.random.default_rng(self.seed)
        grown = np.full((len(self.weights), self.rank + 1), 1e-6, dtype=np.float32)
        bias = 1e-6
        for _ in range(epochs):
            order = random.permutation(len(y))
            for start in range(0, len(order), batch):
                some = order[start:start + batch]
                count = bounds[some + 1] - bounds[some]
                ends = np.cumsum(count)
                at = np.arange(ends[-1]) + np.repeat(bounds[some] - ends + count, count)
                i, v = index[at], value[at]
                z, total, scaled = self.raw(i, v, np.concatenate([[0], ends]))
                error = ((sigmoid(z) - y[some]) * sample_weights[some]).astype(np.float32)
                each = np.repeat(error, count)
                slope = np.empty((len(i), self.rank + 1), dtype=np.float32)
                slope[:, 0] = each * v
                slope[:, 1:] = (each * v)[:, None] * (np.repeat(total, count, axis=0) - scaled)
                touched, place = np.unique(i, return_inverse=True)
                by = np.argsort(place, kind="stable")
                edge = np.searchsorted(place[by], np.arange(len(touched)))
                summed = np.add.reduceat(slope[by], edge, axis=0)
                summed[:, 0] += 1e-4 * self.weights[touched]
                summed[:, 1:] += 1e-3 * self.vectors[touched]
                grown[touched] += summed * summed
                move = step * summed / np.sqrt(grown[touched])
                self.weights[touched] -= move[:, 0]
                self.vectors[touched] -= move[:, 1:]
                bias += float(error.sum()) ** 2
                self.constant -= step * float(error.sum()) / bias ** 0.5
        unseen = np.setdiff1d(np.arange(1 << BUCKET_BITS, len(self.weights)), index)
        self.vectors[unseen] = 0

    def score(self, made: Features) -> np.ndarray:
        z, _, _ = self.raw(*self.rows(made))
        return sigmoid(self.scale[0] * z + self.scale[1])


def _joined(parts: list[Features]) -> Features:
    parts = parts or [features(pa.array([], pa.large_string()))]
    counts = np.concatenate([np.diff(part.bounds) for part in parts])
    return Features(
        np.concatenate([part.words for part in parts]),
        np.concatenate([[0], np.cumsum(counts)]),
        np.concatenate([part.statistics for part in parts]),
    )


def _part(made: Features, rows: np.ndarray) -> Features:
    count = np.diff(made.bounds)[rows]
    ends = np.cumsum(count)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(made.bounds[rows] - ends + count, count)
    return Features(made.words[at], np.concatenate([[0], ends]), made.statistics[rows])


def train(made: Features, y: np.ndarray, share: float, epochs: int = 12) -> FactorisationMachine | float:
    """A machine fitted on four fifths of the rows and calibrated on the rest; a constant where a label is missing."""
    if not 0 < y.sum() < len(y):
        return float(share)
    machine = FactorisationMachine(bin_edges(made.statistics))
    balance = class_weights(y, 0.5)
    spare = np.arange(len(y)) % 5 == 0
    if len(np.unique(y[spare])) < 2 or len(np.unique(y[~spare])) < 2:
        spare = np.ones(len(y), dtype=bool)
        machine.fit(made, y, balance, epochs)
    else:
        machine.fit(_part(made, np.flatnonzero(~spare)), y[~spare], balance[~spare], epochs)
    z, _, _ = machine.raw(*machine.rows(_part(made, np.flatnonzero(spare))))
    slope, constant = logistic(z[:, None], y[spare], class_weights(y[spare], share))
    machine.scale = (max(float(slope), 1e-3), float(constant))
    return machine


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    n_chars: str | None = "n_chars",
    target: str = "quality",
    threshold: float = 0.7,
    per_label: int = 3000,
    longest: int = 40_000,
) -> DataFrame:
    """``id, held_out, score, predicted`` for every row of ``docs``.

    Learns from at most ``per_label`` rows of each label with at most ``longest`` characters,
    none of fold 2. The text and ``n_chars`` as the row declares it go into the fit and the score (None: the text
    alone). A null count has a bin of its own; where no row to learn from has one, it adds nothing. Counts below
    zero are in the lowest bin. A null or empty text has no words and is scored by its statistics.
    A null id is not held out. Rows that repeat come back as often as they are, with equal scores.
    Without rows of both labels the score is the share of label 1 (0 without any). An empty table gives an
    empty result; other columns are ignored.
    """
    score = score_column(docs, labels, id, text, n_chars, target, per_label, longest)
    return docs.select(F.col(id).cast("bigint").alias(id), score.alias("score")).select(
        id,
        F.coalesce(fold(id) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def score_column(
    docs: DataFrame, labels: DataFrame, id: str, text: str, n_chars: str | None, target: str, per_label: int, longest: int
) -> Column:
    """The score of a row of ``docs``, by a model that is fitted now."""
    sample, share = labelled_sample(docs, labels, target, id, text, per_label, longest, n_chars)
    parts, start = [], 0
    for texts in text_slices([row[1] for row in sample]):
        declared = pa.array([row[2] for row in sample[start:start + len(texts)]], pa.int64()) if n_chars else None
        parts.append(features(texts, declared))
        start += len(texts)
    model = train(_joined(parts), np.array([row[0] for row in sample], dtype=float), share)

    def work(batch: pa.RecordBatch) -> pa.Array:
        if isinstance(model, float) or not batch.num_rows:
            return pa.array(np.full(batch.num_rows, model if isinstance(model, float) else 0.0))
        return pa.array(model.score(features(batch.column(0), batch.column(1) if n_chars else None)).astype(np.float64))

    return text_column(work, "double", [text, n_chars] if n_chars else [text])


def accepted(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    n_chars: str | None = "n_chars",
    target: str = "quality",
    threshold: float = 0.7,
    per_label: int = 3000,
    longest: int = 40_000,
) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, as :func:`quality` gives it."""
    score = score_column(docs, labels, id, text, n_chars, target, per_label, longest)
    return docs.filter(score >= threshold)
