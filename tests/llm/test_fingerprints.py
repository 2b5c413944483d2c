import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rillstat.llm import fingerprints as fp
from tests.llm.frames import DOCS, documents, sentence


def test_the_lexicon_has_the_terms_of_the_band(spark, monkeypatch):
    r = random.Random(2)
    texts = [" ".join(f"t{min(int(r.expovariate(0.02)), 400)}" for _ in range(60)) + "!" for _ in range(300)] + [None, ""]
    counts = Counter(term for text in texts for term in set(re.findall(r"\w+", text or "")))
    band = {term for term, n in counts.items() if 0.02 * 302 <= n <= 0.3 * 302}
    hashed = {int(fp.terms(pa.array([term]))[0][0]) for term in band}
    for chunk, many, block in ((20_000, 4 << 20, 1 << 20), (10, 4 << 20, 16), (20_000, 8, 64)):
        monkeypatch.setattr(fp, "CHUNK_DOCS", chunk)
        monkeypatch.setattr(fp, "CHUNK_TERMS", many)
        monkeypatch.setattr(fp, "BLOCK_TERMS", block)
        assert set(fp.lexicon_of(documents(spark, texts).select("text"), 0.02, 0.3).tolist()) == hashed


def test_edited_texts_and_fingerprints_of_all_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = dict(rows.select("doc_id", "text").collect())
    ids = sorted(texts)
    by_print = {}
    better = 0
    for row in fp.compared(rows).collect():
        i = row["doc_id"]
        text, after = texts[i], texts[ids[(ids.index(i) + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_print.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        better += row["near_edited"] > row["near_next"]
    assert better > 0.8 * len(ids)


def test_ranges_do_not_matter(spark, monkeypatch):
    r = random.Random(3)
    texts = [sentence(r, r.randrange(1, 60), 200) for _ in range(400)]
    docs = documents(spark, texts, r.sample(range(10_000), 400))
    one = sorted(fp.compared(docs).collect())
    monkeypatch.setattr(fp, "RANGE_BYTES", 50)
    many = sorted(fp.compared(docs.repartition(7)).collect())
    assert one == many


def test_odd_rows(spark):
    texts = [None, "", "a", "Same text here", "same TEXT, here!", "x " * 100_000, "", "tie", "tie"]
    docs = documents(spark, texts, [0, 1, 2, 3, 4, 5, None, 7, 7]).withColumns({"id": F.lit("x"), "mark": F.lit(1), "n_chars": F.lit("y")})
    rows = fp.compared(docs).collect()
    assert len(rows) == 9
    own = {row["doc_id"]: row for row in rows}
    assert own[0]["fingerprint"] == own[1]["fingerprint"] == "0" * (4 * fp.PARTS)
    assert own[0]["edited_sha256"] == hashlib.sha256(b"").hexdigest() and own[0]["near_edited"] == 1.0
    assert own[3]["fingerprint"] == own[4]["fingerprint"] and own[3]["near_next"] == 1.0
    assert own[5]["edited_sha256"] == hashlib.sha256(("x " * 50_000 + "tie").encode()).hexdigest()
    assert fp.compared(spark.createDataFrame([], DOCS)).collect() == []
    alone = fp.compared(documents(spark, ["only one document"])).first()
    text = "only one document"
    assert alone["edited_sha256"] == hashlib.sha256((text[:9] + text[:8]).encode()).hexdigest()


def test_likeness_grows_with_what_is_shared():
    r = random.Random(5)
    words = [f"t{i}" for i in range(200)]
    lexicon = fp.Lexicon(np.unique(fp.terms(pa.array([" ".join(words)]))[0]))
    base = r.sample(words, 100)
    likeness = []
    for shared in (100, 90, 70, 40, 0):
        other = base[:shared] + [w for w in words if w not in base][:100 - shared]
        a, b = (fp.fingerprints(pa.array([" ".join(x)]), lexicon) for x in (base, other))
        likeness.append(float(fp.likeness(a, b)[0]))
    assert likeness[0] == 1.0 and likeness == sorted(likeness, reverse=True) and likeness[-1] < 0.05


def _finish(x):
    """The mixing of 64 bits that the hashes end in."""
    return int(fp.mixed(np.array([x % (1 << 64)], dtype=np.uint64))[0])


def _plain_fingerprint(text, lexicon):
    """The fingerprint by plain loops over the terms: a set for each part, its sum hashed to 16 bits."""
    every = {int(fp.terms(pa.array([term]))[0][0]) for term in re.findall(r"[^\s!-/:-@\[-`{-~]+", text)}
    kept = {term for term in every if term in lexicon} or every
    parts = [kept]
    for order in range(fp.ORDERS):
        drawn = {term: _finish(term + 0x9E3779B97F4A7C15 * (order + 1)) for term in kept}
        for level in range(fp.LEVELS):
            parts.append({term for term in kept if drawn[term] < 1 << (63 - level)})
    hashes = [max(_finish(sum(_finish(term ^ 0x94D049BB133111EB) for term in part)) >> 48, 1) if part else 0 for part in parts]
    return hashes


def _plain_likeness(a, b):
    either = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
    return sum(x == y for x, y in either) / len(either) if either else 1.0


def test_fingerprints_and_likeness_are_those_of_plain_loops(spark):
    r = random.Random(9)
    texts = [sentence(r, r.choice([0, 1, 5, 40, 200]), 150) for _ in range(60)] + ["", None, "only-here; twice, only-here"]
    counts = Counter(term for text in texts for term in set(re.findall(r"\w+", (text or "").replace("-", " "))))
    lexicon = {int(fp.terms(pa.array([term]))[0][0]) for term, n in counts.items() if 0.05 * 63 <= n <= 0.3 * 63}
    assert lexicon == set(fp.lexicon_of(documents(spark, texts).select("text"), 0.05, 0.3).tolist()) and len(lexicon) > 20
    marks = [_plain_fingerprint(text or "", lexicon) for text in texts]
    written = lambda mark: "".join(f"{x:04x}" for x in mark)
    for row in fp.compared(documents(spark, texts), low=0.05, high=0.3).collect():
        i = row["doc_id"]
        text, after = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        half = len(text) // 2
        edited = _plain_fingerprint(text[:len(text) - half] + after[:half], lexicon)
        assert (row["fingerprint"], row["edited_fingerprint"]) == (written(marks[i]), written(edited))
        assert row["near_edited"] == _plain_likeness(marks[i], edited)
        assert row["near_next"] == _plain_likeness(marks[i], marks[(i + 1) % len(texts)])
