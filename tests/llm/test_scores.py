import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillstat.llm.quality import BINS, BUCKET_BITS, WIDTH, FactorisationMachine, accepted, bin_edges, features, quality
from rillstat.llm.toxicity import Scorer, compressor, spread, toxicity, train, windows
from tests.llm.frames import DOCS, documents, sentence

LABELS = "doc_id BIGINT, quality INT, toxic INT"
FOLDER = "/root/testdata/sf0.1"


@pytest.mark.parametrize(
    ("operator", "target", "least"), [(toxicity, "toxic", (0.975, 0.8)), (quality, "quality", (0.97, 0.97))]
)
def test_held_out_accuracy(spark, operator, target, least):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels"))
    rows = operator(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 500
    for y in (0, 1):
        own = [row for row in rows if row[target] == y]
        assert sum(row["predicted"] == y for row in own) / len(own) > least[y]
    assert all(0 <= row["score"] <= 1 for row in rows)


def _labelled(spark):
    r = random.Random(1)
    texts, labels = [], []
    for i in range(120):
        words = sentence(r, 60, 300).split()
        if i % 3 == 0:
            for _ in range(6):
                words[r.randrange(60)] = r.choice(["grumbletoad", "nastyfroggle", "vilesnark"])
        texts.append(" ".join(words))
        labels.append((i, int(i % 3 != 0), int(i % 3 == 0)))
    return texts, spark.createDataFrame([*labels, (5, None, None), (None, 1, 1), (0, 0, 1), (999, 1, 0)], LABELS)


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_odd_rows(spark, operator):
    texts, labels = _labelled(spark)
    ids = [*range(120), 3, None, 500, 501, 502]
    docs = documents(spark, [*texts, texts[3], texts[4], None, "", "grumbletoad " * 20_000], ids).withColumn("score", F.lit("x")).withColumn("id", F.lit(1))
    rows = operator(docs, labels).collect()
    assert len(rows) == 125
    by_id = {}
    for row in rows:
        by_id.setdefault(row["doc_id"], []).append(row)
    assert len(by_id[3]) == 2 and by_id[3][0]["score"] == by_id[3][1]["score"]
    assert not by_id[None][0]["held_out"]
    assert by_id[500][0]["score"] == pytest.approx(by_id[501][0]["score"], abs=0.5)
    assert {row["predicted"] for row in rows} <= {0, 1}
    if operator is toxicity:
        assert by_id[None][0]["score"] == by_id[4][0]["score"]
        assert by_id[502][0]["predicted"] == 1 and by_id[501][0]["predicted"] == 0
        right = sum(by_id[i][0]["predicted"] == (i % 3 == 0) for i in range(120))
        assert right > 110


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_empty_tables_and_one_label(spark, operator):
    texts, labels = _labelled(spark)
    none = spark.createDataFrame([], LABELS)
    assert operator(spark.createDataFrame([], DOCS), labels).collect() == []
    docs = documents(spark, texts[:3])
    assert {row["score"] < 0.01 for row in operator(docs, none).collect()} == {True}
    all_good = spark.createDataFrame([(i, 1, 1) for i in range(3)], LABELS)
    assert {row["predicted"] for row in operator(docs, all_good).collect()} == {1}


def test_labels_of_the_held_out_fold_do_not_count(spark):
    texts, labels = _labelled(spark)
    docs = documents(spark, texts)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    turned = labels.withColumn("toxic", F.when(fold == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({row["doc_id"]: row["score"] for row in toxicity(docs, x).collect()} for x in (labels, turned))
    assert a == b


def _few(random_, count, hostile):
    texts = []
    for i in range(count):
        words = sentence(random_, 60, 300).split()
        if i < hostile:
            for _ in range(4):
                words[random_.randrange(60)] = random_.choice(["grumbletoad", "nastyfroggle", "vilesnark"])
        texts.append((int(i < hostile), " ".join(words)))
    return texts


def test_savings_are_those_of_two_compressions_a_window():
    r = random.Random(3)
    ordinary = " ".join(text for _, text in _few(r, 40, 0)).encode()
    toxic = b" grumbletoad  vilesnark "
    texts = [text for _, text in _few(r, 30, 15)] + ["", None, "x", "grumbletoad" * 300, "\u00e9\u00e8 vilesnark. \t\n zzz"]
    data, offsets = spread(pa.array(texts, pa.large_string()))
    for cell in (1, 16):
        begin, end, rows = windows(data, offsets, cell)
        plain, hostile = compressor(ordinary), compressor(ordinary + toxic)
        pieces = [data[a:b].tobytes() + b"\n" * 32 for a, b in zip(begin, end, strict=True)]
        expected = [max(len(plain.compress(piece)) - len(hostile.compress(piece)), 0) for piece in pieces]
        assert Scorer(ordinary, toxic).savings(data, begin, end).tolist() == expected
        assert max(expected) >= 4 and len(expected) == len(rows)
        words = [word for text in texts for word in (text or "").lower().encode().split()]
        assert [word for a, b in zip(begin, end, strict=True) for word in data[a:b].tobytes().split()] == words


def test_words_of_toxic_texts_are_found_by_compression():
    texts = _few(random.Random(4), 240, 80)
    model = train(texts, 1 / 3)
    assert {b"grumbletoad", b"nastyfroggle", b"vilesnark"} <= set(model.toxic.split())
    # A word that toxic and ordinary texts share alike is none of them.
    assert not {b"w1", b"w250"} & set(model.toxic.split())
    stray = [(y, text + " grumbletoad" if not y and i % 40 == 0 else text) for i, (y, text) in enumerate(texts)]
    assert b"grumbletoad" in train(stray, 1 / 3).toxic.split()
    shared = [(y, text + " grumbletoad") for y, text in texts]
    assert b"grumbletoad" not in train(shared, 1 / 3).toxic.split()


def test_training_on_one_text_a_label():
    model = train([(0, ""), (1, "")], 0.5)
    assert len(Scorer(model.ordinary, model.toxic).features(pa.array(["a b", "", None], pa.large_string()))) == 3


def test_pairs_by_squares_are_pairs_by_pairs():
    made = features(pa.array(["a b c", "", "a a a b\nc!"]), pa.array([5, None, 9]))
    machine = FactorisationMachine(bin_edges(made.statistics))
    index, value, bounds = machine.rows(made)
    z, _, _ = machine.raw(index, value, bounds)
    for i in range(3):
        own, x = index[bounds[i]:bounds[i + 1]], value[bounds[i]:bounds[i + 1]]
        pairs = sum(
            machine.vectors[own[a]] @ machine.vectors[own[b]] * x[a] * x[b] for a in range(len(own)) for b in range(a)
        )
        assert z[i] == pytest.approx(machine.constant + machine.weights[own] @ x + pairs, abs=1e-4)


def test_accepted_keeps_the_columns_and_the_good_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    kept = accepted(docs, labels)
    assert kept.columns == docs.columns
    good = {row["doc_id"] for row in quality(docs, labels).filter("predicted = 1").collect()}
    assert {row["doc_id"] for row in kept.select("doc_id").collect()} == good


def test_counts_that_are_null_have_a_bin_of_their_own():
    made = features(pa.array(["a b", "c d", "e f", "g"]), pa.array([3, None, 7, -2]))
    machine = FactorisationMachine(bin_edges(made.statistics))
    index, _, bounds = machine.rows(made)
    kinds = made.statistics.shape[1]
    base = (1 << BUCKET_BITS) + (kinds - 1) * WIDTH
    assert [index[end - 1] - base == BINS for end in bounds[1:]] == [False, True, False, False]
    assert index[bounds[4] - 1] == base and index.max() < len(machine.weights)
    # Learned from rows with counts only, a null adds nothing: neither a weight nor pairs.
    known = features(pa.array(["a b", "c d", "e f", "g"] * 8), pa.array([3, 5, 7, 1] * 8))
    machine = FactorisationMachine(bin_edges(known.statistics))
    machine.fit(known, np.array([1, 0, 1, 0] * 8, dtype=float), np.ones(32), 3)
    assert machine.weights[base + BINS] == 0 and not machine.vectors[base + BINS].any()


def test_declared_counts_are_learned_from(spark):
    r = random.Random(8)
    texts = [sentence(r, 40, 300)] * 400
    good = [r.random() < 0.5 for _ in texts]
    labels = spark.createDataFrame([(i, int(y), 0) for i, y in enumerate(good)], LABELS)
    # Good rows declare far more than they have, or nothing at all: the texts themselves are all the same.
    for told in (9_000, None):
        docs = documents(spark, texts).withColumn("n_chars", F.when(F.col("doc_id").isin([i for i, y in enumerate(good) if y]), told).otherwise(200))
        rows = quality(docs, labels).collect()
        right = sum(row["predicted"] == good[row["doc_id"]] for row in rows if row["held_out"])
        assert right > 0.95 * sum(row["held_out"] for row in rows)
        alone = quality(docs, labels, n_chars=None).collect()
        assert sum(row["predicted"] == good[row["doc_id"]] for row in alone if row["held_out"]) < 0.7 * sum(row["held_out"] for row in alone)
