from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpus_pipeline import weighted
from rillstat.llm.mixing import layout_topic, mixed, rake, sampling_scale, token_count
from rillstat.llm.queries import TARGETS
from tests.llm.frames import DOCS


def docs_of(spark, rows):
    return spark.createDataFrame([(i, text, lang, source, 0) for i, (text, lang, source) in enumerate(rows)], DOCS)


def test_raking_is_plain_proportional_fitting(spark):
    table = {("a", "x"): 40, ("a", "y"): 30, ("b", "x"): 20, ("b", "y"): 10, ("c", "x"): 5, ("c", "y"): 0}
    cells = spark.createDataFrame([(f"={s}", f"={t}", n) for (s, t), n in table.items()], "s STRING, t STRING, base BIGINT")
    targets = {"s": {"a": 0.2, "b": 0.5, "c": 0.3}, "t": {"x": 0.6, "y": 0.4}}
    found = {(row["s"], row["t"]): row["fitted"] for row in rake(cells, targets).collect()}
    fitted = {(f"={s}", f"={t}"): float(n) for (s, t), n in table.items()}
    for _ in range(500):
        for at, shares in enumerate(targets.values()):
            for value, share in shares.items():
                own = [key for key in fitted if key[at] == f"={value}"]
                total = sum(fitted[key] for key in own)
                for key in own:
                    fitted[key] *= share * 105 / total
    assert found == pytest.approx(fitted, rel=1e-3, abs=1e-6)


def test_the_sample_has_the_target_marginals(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mixed(docs, {"lang": 0.0, "source": 0.5}, budget=0.5)
    rows = rows.select("doc_id", "lang", "mix_tokens", "mix_probability", "mix_weight").collect()
    wanted = Counter()
    for row in rows:
        wanted[row["lang"]] += row["mix_tokens"] * row["mix_weight"]
    total = sum(wanted.values())
    assert all(abs(share / total - 0.25) < 0.03 for share in wanted.values())
    whole = docs.agg(F.sum(token_count("text"))).first()[0]
    assert sum(row["mix_tokens"] for row in rows) == pytest.approx(0.5 * whole, rel=0.05)
    assert all(0 < row["mix_probability"] <= 1 and (row["mix_weight"] == 1 or row["mix_probability"] == 1) for row in rows)


def test_rows_that_repeat_have_the_target_marginals_without_weights(spark):
    rows = [("a b c d", "en", "s")] * 900 + [("a b c d", "fr", "s")] * 60 + [("a b c d", "de", "t")] * 40
    found = mixed(docs_of(spark, rows), {"lang": {"en": 0.4, "fr": 0.4, "de": 0.2}}, budget=0.7, repeats=True).collect()
    tokens, times = Counter(), Counter()
    for row in found:
        tokens[row["lang"]] += row["mix_tokens"]
        times[row["doc_id"]] += 1
    assert sum(tokens.values()) == pytest.approx(0.7 * 4000, rel=0.05)
    for lang, share in (("en", 0.4), ("fr", 0.4), ("de", 0.2)):
        assert tokens[lang] / sum(tokens.values()) == pytest.approx(share, abs=0.03)
    # 700 rows: 280 of the 60 in fr, 140 of the 40 in de, 280 of the 900 in en.
    assert {times[i] for i in range(900, 960)} == {4, 5} and {times[i] for i in range(960, 1000)} == {3, 4}
    assert max(times[i] for i in range(900)) == 1 and all(row["mix_weight"] == 1 for row in found)


def test_the_pipeline_stage_reaches_the_targets_in_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    topic = layout_topic("text").alias("topic")
    before = docs.select("source", "lang", topic, token_count("text").alias("n")).collect()
    after = weighted(spark, docs, "").select("source", "lang", topic, token_count("text").alias("n")).collect()
    for name in ("source", "lang", "topic"):
        own, got = Counter(), Counter()
        for counts, rows in ((own, before), (got, after)):
            for row in rows:
                counts[row[name]] += row["n"]
        roots = {value: n ** TARGETS[name] for value, n in own.items() if n}
        for value, root in roots.items():
            assert got[value] / sum(got.values()) == pytest.approx(root / sum(roots.values()), abs=0.02)


def test_the_scale_meets_the_budget(spark):
    cells = spark.createDataFrame([(10, 40.0), (30, 20.0), (60, 40.0)], "base BIGINT, fitted DOUBLE")
    scale = sampling_scale(cells, 50.0)
    assert sum(n * min(1.0, f / n * scale) for n, f in [(10, 40.0), (30, 20.0), (60, 40.0)]) == pytest.approx(50, rel=1e-6)


def test_nulls_empty_texts_and_clashing_columns(spark):
    rows = [("a b c", "en", "s"), (None, None, None), ("", "en", None), (" \n", "fr", "s"), ("x " * 50_000, "fr", "t"), ("a b c", "en", "s")]
    docs = docs_of(spark, rows).withColumns({"topic": F.lit("own"), "mix_weight": F.lit("old"), "base": F.lit(1), "fitted": F.lit(2)})
    found = mixed(docs, {"source": 0.5, "lang": 1.0, "topic": 1.0}, budget=1.0).collect()
    assert sorted(row["doc_id"] for row in found) == [0, 1, 2, 3, 4, 5]
    assert {row["doc_id"]: row["mix_tokens"] for row in found} == {0: 3, 1: 0, 2: 0, 3: 0, 4: 50_000, 5: 3}
    assert found[0]["mix_weight"] >= 1 and found[0]["topic"] == "own"


def test_empty_tables(spark):
    assert mixed(spark.createDataFrame([], DOCS), {"source": 0.5, "topic": 0.5}).collect() == []
    blank = docs_of(spark, [("", "en", "s"), (None, "en", "s")])
    assert mixed(blank, {"source": 0.5}).count() == 2


def test_no_python_on_the_main_path(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = mixed(docs, {"source": 0.5, "lang": 0.5, "topic": 0.5})._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan
