import random

import pytest
from pyspark.sql import functions as F

from rillstat.llm import metric_join
from rillstat.llm.metric_join import jaccard_components
from tests.llm.frames import documents, sentence


def shingled(text, size=5):
    words = [w for w in (text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def plain(ids, texts, numerator=80):
    """All pairs of distinct sets; ids with several texts are one document."""
    sets = [shingled(text) for text in texts]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    points = sorted({s for s in sets if s}, key=sorted)
    for i, a in enumerate(points):
        for b in points[:i]:
            if 100 * len(a & b) >= numerator * len(a | b):
                parent[root(a)] = root(b)
    for id, s in zip(ids, sets):
        if id is not None and s:
            parent[root(("id", id))] = root(s)
    least = {}
    for id, s in zip(ids, sets):
        if id is not None and s:
            least[root(s)] = min(id, least.get(root(s), id))
    owned = {id: least[root(s)] for id, s in zip(ids, sets) if s and id is not None}
    return sorted((str(id), len(s), str(least.get(root(s)) if s else owned.get(id, id))) for id, s in zip(ids, sets))


def result(spark, texts, ids=None, **options):
    docs = documents(spark, texts, ids)
    return sorted((str(r[0]), r[1], str(r[2])) for r in jaccard_components(docs, **options).collect())


def edited(random_, text, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[random_.randrange(len(words))] = f"x{random_.randrange(10**6)}"
    return " ".join(words)


def corpus(seed, groups=12):
    random_ = random.Random(seed)
    texts = [sentence(random_, random_.randrange(1, 300)) for _ in range(60)]
    for _ in range(groups):
        base = sentence(random_, random_.randrange(30, 250))
        texts += [edited(random_, base, random_.randrange(0, 1 + len(base.split(" ")) // 20)) for _ in range(random_.randrange(2, 9))]
    shared = [sentence(random_, 60) for _ in range(3)]
    texts += [sentence(random_, random_.randrange(5, 60)) + " " + random_.choice(shared) for _ in range(40)]
    texts += [" ".join(random_.sample(shared, 2)) for _ in range(6)]
    random_.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_it_is_the_definition(spark, seed):
    texts = corpus(seed)
    assert result(spark, texts) == plain(range(len(texts)), texts)


@pytest.mark.parametrize("numerator", [50, 75, 95])
def test_other_similarities(spark, numerator):
    texts = corpus(7)
    assert result(spark, texts, numerator=numerator) == plain(range(len(texts)), texts, numerator)


@pytest.mark.parametrize("copies", [0.0, 2.0, 100.0])
def test_large_regions_are_divided(spark, monkeypatch, copies):
    """A wide group of near copies, of which many are too far from each other, by pivots and by blocks."""
    monkeypatch.setattr(metric_join, "REGION_ROWS", 8)
    monkeypatch.setattr(metric_join, "PIVOTS", 3)
    monkeypatch.setattr(metric_join, "COPIES", copies)
    random_ = random.Random(11)
    base = sentence(random_, 120, 10**6)
    bases = [edited(random_, base, k) for k in (0, 3, 5)]
    words = [f"v{i}" for i in range(4)]
    texts = []
    for text in bases:
        for _ in range(40):
            parts = text.split(" ")
            for _ in range(random_.randrange(0, 5)):
                parts[random_.randrange(len(parts))] = random_.choice(words)
            texts.append(" ".join(parts))
    divided = []
    plain_divided = metric_join._divided
    monkeypatch.setattr(metric_join, "_divided", lambda *a: divided.append(1) or plain_divided(*a))
    assert result(spark, texts) == plain(range(len(texts)), texts)
    assert divided


def test_a_link_at_the_bound(spark):
    words = [f"w{i}" for i in range(13)]
    # 9 shingles each, 8 in common of 10.
    at = [" ".join(words), " ".join(words[:12] + ["y"])]
    assert result(spark, at) == [("0", 9, "0"), ("1", 9, "0")]
    below = [" ".join(words[:12]), " ".join(words[:11] + ["y"])]
    assert result(spark, below) == [("0", 8, "0"), ("1", 8, "1")]


def test_odd_rows(spark):
    random_ = random.Random(5)
    text = sentence(random_, 100)
    other = sentence(random_, 80)
    texts = [text, text.upper(), None, "", " \n\t", "a b", "A  B", "a b c", other, None, text, other, text, "", "w " * 20_000, "x" * 100_000]
    ids = [4, 3, 9, 8, 7, 20, 21, 22, None, None, 4, 30, 30, 4, 40, 41]
    assert result(spark, texts, ids) == plain(ids, texts)


def test_copies_and_other_columns(spark):
    text = sentence(random.Random(1), 50)
    docs = documents(spark, [text] * 200 + ["a b c d e f"])
    for name in ("_id", "id", "node", "n", "print", "region", "comp", "component", "shingle"):
        docs = docs.withColumn(name, F.lit("x"))
    found = {tuple(row) for row in jaccard_components(docs).collect()}
    assert found == {(i, 46, 0) for i in range(200)} | {(200, 2, 200)}


def test_empty_tables(spark):
    assert result(spark, []) == []
    assert result(spark, [None, ""]) == [("0", 0, "0"), ("1", 0, "1")]


def dense(seed, count, words=120, outliers=4):
    """Near copies of one text, all distances alike; about one in ``outliers`` has so many changes that few links are left."""
    random_ = random.Random(seed)
    base = sentence(random_, words, 10**6).split(" ")
    texts = []
    for i in range(count):
        parts = list(base)
        for _ in range(random_.randrange(3, 6) if i % outliers == 0 else random_.randrange(0, 3)):
            parts[random_.randrange(words)] = f"v{random_.randrange(4)}"
        texts.append(" ".join(parts))
    return texts


def test_a_dense_group_has_one_row_per_member_and_region(spark, monkeypatch):
    """Pairs of blocks of a region that pivots do not divide would make rows with the square of its size."""
    for name, value in {"REGION_ROWS": 8, "PIVOTS": 3, "COPIES": 0.0}.items():
        monkeypatch.setattr(metric_join, name, value)
    members, joined = [], []
    plain_regions, plain_join = metric_join._first_regions, metric_join._joined_in_task

    def regions(*a):
        members.append(plain_regions(*a))
        return members[0]

    def counted(*bounds):
        work, rows = plain_join(*bounds), spark.sparkContext.accumulator(0)
        joined.append(rows)
        return lambda region: rows.add(len(region)) or work(region)

    monkeypatch.setattr(metric_join, "_first_regions", regions)
    monkeypatch.setattr(metric_join, "_joined_in_task", counted)
    texts = dense(3, 200)
    assert result(spark, texts) == plain(range(len(texts)), texts)
    assert 0 < joined[0].value <= members[0].count()


@pytest.mark.parametrize(("rows", "numerator"), [(4, 80), (16, 85)])
def test_differences_too_many_for_a_task(spark, monkeypatch, rows, numerator):
    """Members without a possible partner leave, the rest goes on in blocks."""
    for name, value in {"REGION_ROWS": 4, "CENTRE_ROWS": rows, "PIVOTS": 2, "COPIES": 0.0}.items():
        monkeypatch.setattr(metric_join, name, value)
    texts = dense(3, 160)
    asked = []
    plain_linkable = metric_join._linkable
    monkeypatch.setattr(metric_join, "_linkable", lambda *a: asked.append(1) or plain_linkable(*a))
    assert result(spark, texts, numerator=numerator) == plain(range(len(texts)), texts, numerator)
    assert asked
