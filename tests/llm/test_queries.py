import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from rillstat.llm.near_duplicates import near_duplicates
from rillstat.llm.queries import ORACLES, QUERIES
from rillstat.sinks.tables import stored
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_the_query_is_its_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_the_query_runs_over_its_whole_table(spark, name):
    rows = QUERIES[name](spark, FOLDER)
    assert len(set(rows.columns)) == len(rows.columns)
    count = rows.count()
    whole = {"op6_preference_format": None, "op10_url_filter": "pages", "op2_benchmark_decontamination": None, "op4_mix_to_targets": None, "op11_hard_negatives": None}.get(name, "documents")
    if whole:
        assert count == spark.read.parquet(f"{FOLDER}/{whole}.parquet").count()
    else:
        assert count > 0


def test_there_is_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))


def test_the_pipeline_stage_by_stage(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert after.columns == columns and after.count() < before
            assert after.join(docs, "doc_id", "left_anti").isEmpty()
        else:
            assert after.columns[:5] == columns and after.count() == before
        if i == 1:
            assert near_duplicates(after).filter("NOT kept").isEmpty()
        docs, before = after, after.count()


def test_the_pipeline_takes_an_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() == 0


def test_the_pipeline_takes_columns_with_any_names(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = [
        "_id", "_size", "_hash", "_row", "_doc", "_wanted", "_copy", "_mix_0", "_key", "_print", "_kept", "_rows", "id", "key", "row", "print", "low", "high",
        "marked", "kept", "times", "a", "b", "own_0", "own_1", "mix_0", "wanted", "copy", "doc", "score", "node", "found",
    ]
    docs = docs.withColumns({name: F.lit(name) for name in names})
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
        assert docs.columns[:37] == ["doc_id", "text", "lang", "source", "n_chars", *names]
        assert docs.count() > 0 and docs.filter(" OR ".join(f"`{name}` <> '{name}'" for name in names)).count() == 0


def test_the_pipeline_takes_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    odd = docs.limit(3).select(F.lit(None).cast("bigint").alias("doc_id"), *(F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in columns[1:]))
    docs = docs.unionByName(odd).unionByName(docs.limit(20))
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
    assert docs.count() > 0
