import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstat.llm import hard_negatives
from rillstat.llm.hard_negatives import Best, from_planes, mined, scores, subset_sums, to_planes

ROWS = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def vectors(count, dimensions, seed, labels=4):
    random = np.random.default_rng(seed)
    values = random.normal(0.1, 0.2, (count, dimensions)).astype(np.float32)
    return [(i, values[i].tolist(), int(random.integers(labels))) for i in range(count)]


def plain(rows, every=10, positives=5, negatives=3):
    """The definition, pair by pair."""
    held = {}
    for id, vector, label in rows:
        if id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = tuple(math.floor(256 * x) for x in vector)
        held[id] = min(held.get(id, (label, whole)), (label, whole))
    found = set()
    for a, (label, vector) in held.items():
        if a % every:
            continue
        ranked = sorted((-sum(x * y for x, y in zip(vector, w)), i) for i, (_, w) in held.items() if i != a)
        for p_score, p in [x for x in ranked if held[x[1]][0] == label][:positives]:
            fits = [x for x in ranked if held[x[1]][0] != label and -50 * p_score <= -100 * x[0] <= -95 * p_score][:negatives]
            found |= {(a, p, rank, n, -p_score, -score) for rank, (score, n) in enumerate(fits, 1)}
    return found


def result(spark, rows, **options):
    made = mined(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 10 == 0, **options)
    assert made.columns == COLUMNS
    rows = [tuple(row) for row in made.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("planes, dimensions", [(2, 8), (9, 64), (31, 24)])
def test_lookups_give_inner_products(planes, dimensions):
    random = np.random.default_rng(planes)
    reach = 1 << (planes - 1)
    a, b = random.integers(-reach, reach, (2, 50, dimensions))
    a[0], b[0], b[1] = -reach, -reach, reach - 1
    assert (from_planes(to_planes(a, planes)) == a).all()
    found = scores(subset_sums(a, np.int64), to_planes(b, planes), np.int64)
    assert (found == b @ a.T).all()


def test_tables_hold_all_subset_sums():
    anchors = np.arange(16).reshape(1, 16) ** 2
    tables = subset_sums(anchors, np.int64)
    for group in range(2):
        for subset in range(256):
            assert tables[group, subset, 0] == sum(anchors[0, group * 8 + k] for k in range(8) if subset >> k & 1)


def test_the_best_are_kept_with_ties_by_id():
    random = np.random.default_rng(3)
    best, held = Best(6, 4), {q: [] for q in range(6)}
    for start in range(0, 500, 50):
        ids, queries = np.arange(start, start + 50)[::-1].copy(), np.array([1, 3, 4])
        found = random.integers(0, 9, (50, 3))
        best.offer(queries, found, ids, np.int64(2), np.int64(7))
        for column, q in enumerate(queries.tolist()):
            held[q] += [(-s, i) for s, i in zip(found[:, column].tolist(), ids.tolist()) if 2 <= s <= 7]
    for q, rows in held.items():
        want = sorted(rows)[:4]
        assert list(zip((-best.score[q]).tolist(), best.id[q].tolist()))[:len(want)] == want


@pytest.mark.parametrize("seed, dimensions", [(1, 16), (2, 20), (3, 3)])
def test_it_is_the_definition(spark, seed, dimensions):
    rows = vectors(300, dimensions, seed)
    assert result(spark, rows) == plain(rows) != set()


def test_blocks_of_anchors_and_many_labels_change_nothing(spark):
    rows = vectors(200, 16, 4, labels=40)
    assert result(spark, rows, block=6) == result(spark, rows) == plain(rows)


def test_equal_vectors_go_by_id(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SLAB", 16)
    rows = [(i, [0.5, 0.25] if i % 3 else [0.25, 0.5], i % 4) for i in range(200)]
    assert result(spark, rows) == plain(rows) != set()


def test_odd_rows(spark):
    rows = vectors(120, 9, 5)
    rows += rows[:30] + [(i, [0.9] * 9, 7) for i in (0, 10)] + [(None, [0.1] * 9, 1), (500, None, 1), (510, [0.1] * 9, None), (520, [], 1)]
    rows += [(530, [0.5, None], 1), (540, [float("nan")] * 9, 1), (550, [float("inf")] * 9, 1), (560, [0.7, 0.6], 2), (570, [-3.0] * 9, 3)]
    assert result(spark, rows) == plain(rows) != set()


def test_other_columns_do_not_matter(spark):
    rows = vectors(100, 8, 6)
    table = spark.createDataFrame(rows, ROWS)
    for name in ("id", "vector", "planes", "query", "score", "rank", "row"):
        table = table.withColumn(name, F.lit("x"))
    assert {tuple(row) for row in mined(table, F.col("vec_id") % 10 == 0).collect()} == plain(rows)


def test_empty_tables_and_no_anchors(spark):
    assert result(spark, []) == set()
    assert result(spark, [(1, [0.5], 1), (2, [0.5], 1), (3, [0.4], 2)]) == set()


def test_scores_that_do_not_fit_are_refused(spark):
    with pytest.raises(ValueError, match="64 bits"):
        result(spark, [(0, [1e30], 1), (1, [1.0], 1)])
