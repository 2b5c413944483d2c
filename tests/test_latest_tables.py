"""Tables kept by upserts: what they hold, which buckets a batch rewrites, and what readers see."""

import json

import pytest
from pyspark.sql import functions as F

from rillstat.sinks import latest, tables

KV = "k BIGINT, v BIGINT"


def manifest(path):
    return json.loads(sorted((path / "manifests").glob("*.json"))[-1].read_text())


def upsert(spark, path, run="a", **options):
    sink = latest.upsert_batches(str(path), run, ["k"], ["v"], **options)
    return lambda rows, batch: sink(spark.createDataFrame(rows, KV), batch)


def read(spark, path):
    return {r.k: r.v for r in latest.latest_table(spark, str(path), KV).collect()}


def test_a_table_kept_by_upserts(spark, tmp_path):
    path, expected = tmp_path / "table", {}
    for run in ("a", "b"):
        put = upsert(spark, path, run, buckets=4)
        for batch in range(4):
            rows = [(k, batch * 100 + k) for k in range(batch % 3, 12, 3)]
            for _ in range(2):  # each batch comes twice
                put(rows, batch)
            expected.update(rows)
            assert read(spark, path) == expected
    assert len(list((path / "manifests").glob("*.json"))) == 2
    assert not list((path / "staged").iterdir())
    assert latest.latest_table(spark, str(tmp_path / "none"), KV).count() == 0


def test_only_touched_buckets_are_written(spark, tmp_path):
    put = upsert(spark, tmp_path, buckets=16)
    put([(k, 0) for k in range(500)], 0)
    before = manifest(tmp_path)
    assert len(before["folders"]) == 16 and sum(before["rows"].values()) == 500
    put([(3, 1), (10_000, 2)], 1)
    after = manifest(tmp_path)
    changed = {b for b in after["folders"] if after["folders"][b] != before["folders"].get(b)}
    keys = spark.createDataFrame([(3, 0), (10_000, 0)], KV).select(F.pmod(F.xxhash64("k"), F.lit(16))).distinct()
    assert changed == {str(r[0]) for r in keys.collect()}
    assert len(list((tmp_path / "data" / "version=000000000000000001").glob("_bucket=*"))) == len(changed)
    assert read(spark, tmp_path) == {k: 0 for k in range(500)} | {3: 1, 10_000: 2}
    put([], 2)
    assert manifest(tmp_path) == after


def test_buckets_and_tasks_grow_with_the_table(spark, tmp_path):
    put = upsert(spark, tmp_path, rows_per_bucket=100)
    expected, buckets = {}, []
    for batch in range(4):
        rows = [(k, batch) for k in range(batch * 300, batch * 300 + 300)]
        put(rows, batch)
        expected.update(rows)
        found = manifest(tmp_path)
        buckets.append(found["buckets"])
        assert read(spark, tmp_path) == expected
    assert buckets == [1, 4, 8, 16] and len(found["folders"]) == 16
    files = [len(list((tmp_path / folder).glob("*.parquet"))) for folder in found["folders"].values()]
    assert files == [1] * 16


def test_a_broken_write_is_not_seen(spark, tmp_path, monkeypatch):
    put = upsert(spark, tmp_path, buckets=2)
    put([(1, 1), (2, 2)], 0)
    monkeypatch.setattr(latest, "_put", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        put([(1, 5), (3, 3)], 1)
    assert read(spark, tmp_path) == {1: 1, 2: 2}
    monkeypatch.undo()
    put([(1, 5), (3, 3)], 1)
    assert read(spark, tmp_path) == {1: 5, 2: 2, 3: 3}


def test_a_reader_keeps_its_version(spark, tmp_path):
    put = upsert(spark, tmp_path, buckets=2)
    put([(k, 0) for k in range(50)], 0)
    table = latest.latest_table(spark, str(tmp_path), KV)
    put([(k, 1) for k in range(50)], 1)
    assert {r.v for r in table.collect()} == {0}
    assert set(read(spark, tmp_path).values()) == {1}
    put([(k, 2) for k in range(50)], 2)
    assert [p.name for p in sorted((tmp_path / "data").iterdir())] == [f"version={n:018d}" for n in (1, 2)]


def test_null_keys(spark, tmp_path):
    put = upsert(spark, tmp_path, buckets=4)
    put([(None, 1), (1, 1)], 0)
    put([(None, 2)], 1)
    assert read(spark, tmp_path) == {None: 2, 1: 1}


def test_files_of_a_batch_go_by_size(spark, tmp_path):
    small, large = tables.append_batches(str(tmp_path / "s"), "c", by_size=True), tables.append_batches(str(tmp_path / "l"), "c", by_size=True)
    small(spark.range(100).repartition(8), 0)
    from rillstat.session import settings

    with settings(spark, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.shuffle.partitions": "16"}):
        large(spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")), 0)
    assert len(list((tmp_path / "s").rglob("*.parquet"))) == 1
    assert len(list((tmp_path / "l").rglob("*.parquet"))) > 8
