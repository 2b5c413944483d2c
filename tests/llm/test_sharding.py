import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstat.llm import sharding
from rillstat.llm.ranges import packed, quantiles
from rillstat.llm.sharding import sharded
from tests.llm.frames import DOCS, documents, sentence


def check(rows, texts, shards=16, tolerance=0.06):
    sizes, slots, groups = defaultdict(int), defaultdict(list), defaultdict(set)
    for row in rows:
        text = texts[row["doc_id"]] or ""
        assert row["size"] == len(text.encode()) + 1 and row["text_crc32"] == zlib.crc32(text.encode())
        assert row["law"] == "bytes" and row["grown_shard"] is None
        sizes[row["shard"]] += row["size"]
        slots[row["shard"]].append(row["slot"])
        groups[text].add(row["shard"])
    mean = sum(sizes.values()) / shards
    most = max(row["size"] for row in rows)
    assert set(sizes) <= set(range(shards))
    assert all(abs(size - mean) <= tolerance * mean + most for size in sizes.values())
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    return groups, mean


def test_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    rows = sharded(docs, carry=False).collect()
    assert len(rows) == len(texts)
    groups, _ = check(rows, texts)
    assert all(len(found) == 1 for found in groups.values())


def test_a_hot_text_is_divided(spark):
    r = random.Random(1)
    texts = ["hot text " * 5] * 1500 + [sentence(r, r.randrange(1, 60)) for _ in range(3000)] + [None, ""]
    r.shuffle(texts)
    rows = sharded(documents(spark, texts), carry=False).collect()
    groups, _ = check(rows, texts)
    assert len(groups["hot text " * 5]) > 1
    assert sum(len(found) > 1 for found in groups.values()) == 1


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    texts = ["a", "b" * 1000, None, "", "a"]
    docs = documents(spark, [*texts, "a", "a"], [1, 2, 3, 4, 5, 1, None]).withColumns({"shard": F.lit("old"), "_x": F.lit(1)})
    found = sharded(docs, shards=4)
    assert found.columns == [*[name for name in docs.columns if name != "shard"], "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = found.collect()
    assert len(rows) == 7 and sum(row["doc_id"] == 1 for row in rows) == 2
    slots = defaultdict(list)
    for row in rows:
        slots[row["shard"]].append(row["slot"])
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())


def test_an_empty_table(spark):
    assert sharded(spark.createDataFrame([], DOCS)).collect() == []


def test_one_id_for_a_third_of_the_rows(spark):
    docs = documents(spark, ["same"] * 2000 + [f"text {i}" for i in range(4000)], [7] * 2000 + list(range(10, 4010)))
    rows = sharded(docs, carry=False).collect()
    assert len({row["shard"] for row in rows if row["doc_id"] == 7}) >= 4
    sizes = np.bincount([row["shard"] for row in rows], [row["size"] for row in rows])
    assert sizes.max() < 1.06 * sizes.mean()


def test_packed_keys_compare_as_the_keys_do():
    r = np.random.default_rng(1)
    a, b = r.integers(-3, 3, 500), r.integers(-(2**62), 2**62, 500)
    assert (np.argsort(packed(a, b), kind="stable") == np.lexsort((b, a))).all()


@pytest.mark.parametrize("ranges", [1, 2, 7])
def test_quantiles_cut_the_weight_evenly(ranges):
    cuts = quantiles([np.arange(700), np.ones(700)], ranges)
    assert len(cuts) == ranges - 1 and cuts == sorted(cuts)
    assert quantiles([np.arange(0), np.ones(0)], ranges) == []


def test_a_small_group_stays_together_whatever_the_ranges(spark, monkeypatch):
    """Ranges narrower than the groups, which cuts fall into."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", 10)
    texts = [f"group {i % 200}" for i in range(2000)] + [f"text {i}" for i in range(2000)]  # groups of 4 % of a shard
    rows = sharded(documents(spark, texts), carry=False).collect()
    groups, _ = check(rows, texts, tolerance=0.12)
    assert all(len(found) == 1 for found in groups.values())


def test_columns_with_any_names(spark):
    docs = documents(spark, ["a", "b", "a"])
    for name in ("_id", "_size", "_hash", "_row", "_crc", "_doc", "_range", "_place", "slot"):
        docs = docs.withColumn(name, F.lit("x"))
    found = sharded(docs, shards=2)
    assert found.columns[:len(docs.columns) - 1] == [name for name in docs.columns if name != "slot"]
    assert found.filter("_id = 'x' AND _size = 'x'").count() == 3


def test_quantiles_are_those_of_sorted_rows():
    r = random.Random(4)
    rows = [(r.randrange(-5, 5), r.choice([-(1 << 63), 0, (1 << 63) - 1]), float(r.randrange(1, 9))) for _ in range(300)]
    total, ends = sum(row[2] for row in rows), 0.0
    expected, wanted = set(), [total * i / 12 for i in range(1, 12)]
    for row in sorted(rows):
        ends += row[2]
        while wanted and ends >= wanted[0]:
            expected.add(row[:2])
            wanted.pop(0)
    assert quantiles([np.array(column) for column in zip(*rows, strict=True)], 12) == sorted(expected)
