import hashlib

import pytest
from pyspark.sql import functions as F

from rillstat.llm import manifest as module
from rillstat.llm.manifest import folded, manifest, siblings, spelled
from tests.llm.frames import DOCS

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if row[name] is None else f"{len(str(row[name]).encode())}:{row[name]}" for name in FIELDS))


def tree(nodes, fanout):
    """The root, and the siblings of each leaf from the bottom up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at):
            first = i // fanout * fanout
            path += [n for k, n in enumerate(nodes[first:first + fanout], first) if k != i]
        nodes = [sha("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], paths


def plain(rows, fanout):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, made = [], []
    for name in names:
        ordered = sorted(groups[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        top, paths = tree([leaf_of(r) for r in ordered], fanout)
        made.append((top, ordered, paths))
        tops.append(top)
    root, above = tree(tops, fanout)
    return sorted(
        (str(r["doc_id"]), leaf_of(r), top, root, "".join(path + beyond))
        for (top, ordered, paths), beyond in zip(made, above) for r, path in zip(ordered, paths)
    )


def result(spark, rows, fanout, table=None):
    docs = spark.createDataFrame(rows, DOCS) if table is None else table
    leaf = F.sha2(spelled(*map(F.col, FIELDS)), 256)
    made = manifest(docs, leaf, "lang", ["doc_id"], {"doc_id": F.col("doc_id")}, fanout)
    made = made.withColumn("whole", folded(F.col("leaf"), "path") == F.col("root")).withColumn("proof", siblings("path"))
    found = made.select("doc_id", "leaf", "subroot", "root", "proof", "whole").collect()
    assert all(row["whole"] for row in found)
    return sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof"]) for r in found)


def documents(count, langs, seed=0):
    return [
        {"doc_id": i * 7919 % 100_003, "text": f"text {i}", "lang": langs[(i * i + seed) % len(langs)], "source": "s", "n_chars": i}
        for i in range(count)
    ]


@pytest.mark.parametrize("count, langs, fanout", [
    (1, ["en"], 2), (2, ["en"], 2), (3, ["en", None], 2), (65, ["a", "b", "c", "d", "e"], 2), (300, ["x", "x", "x", None, "", "é"], 2), (100, ["p", "q"], 3),
])
def test_it_is_the_definition(spark, monkeypatch, count, langs, fanout):
    monkeypatch.setattr(module, "BLOCK", 8)  # several tiers
    rows = documents(count, langs)
    assert result(spark, rows, fanout) == plain(rows, fanout)


def test_blocks_change_nothing(spark):
    rows = documents(600, ["en", "en", "en", "de"])
    assert result(spark, rows, 4) == plain(rows, 4)


def test_as_many_groups_as_rows(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 4)
    rows = [dict(row, lang=f"l{row['doc_id']}") for row in documents(70, ["x"])]
    assert result(spark, rows, 2) == plain(rows, 2)


def test_odd_rows(spark):
    rows = documents(40, ["en", "de", None])
    rows += rows[:9] * 3 + [
        {"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None},
        {"doc_id": None, "text": "", "lang": "", "source": "", "n_chars": 0},
        {"doc_id": 5, "text": "ü" * 100_000, "lang": "en", "source": "-", "n_chars": -1},
        {"doc_id": 5, "text": "1:2", "lang": "en", "source": "s", "n_chars": 2**62},
    ]
    assert result(spark, rows, 2) == plain(rows, 2)


def test_other_columns_do_not_matter(spark):
    rows = documents(30, ["en", "de"])
    table = spark.createDataFrame(rows, DOCS)
    for name in ("_group", "_node", "_n", "_pos", "_row", "_key0", "path", "leaf", "root", "_leaf"):
        table = table.withColumn(name, F.lit(1))
    assert result(spark, rows, 2, table) == plain(rows, 2)


def test_an_empty_table(spark):
    assert result(spark, [], 2) == []


def test_a_changed_leaf_misses_the_root(spark):
    rows = documents(20, ["en", "de"])
    docs = spark.createDataFrame(rows, DOCS)
    leaf = F.sha2(spelled(*map(F.col, FIELDS)), 256)
    made = manifest(docs, leaf, "lang", ["doc_id"], {"doc_id": F.col("doc_id")})
    assert made.filter(folded(F.sha2("leaf", 256), "path") == F.col("root")).count() == 0
