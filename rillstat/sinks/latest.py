"""Tables of the last values of each key, whose upkeep grows with the changes and not with the table.

A table is cut into buckets by the hash of the key. A batch rewrites the buckets that it touches, each by a task, and
leaves the files of all others alone. A manifest per version says which files make up the table; it is put in place last
and at once, so a reader sees one version whole, and a broken write leaves nothing but files that no manifest names.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstat.sinks.tables import Sink, file_system, run_folder

#: Rows of a bucket that are aimed at; the table gets twice the buckets when it outgrows them.
ROWS_PER_BUCKET = 1_000_000

#: Versions that stay readable.
KEPT_VERSIONS = 2


def _manifests(spark: SparkSession, path: str) -> list[str]:
    """The names of the table's manifests, the oldest first."""
    files, make = file_system(spark, path)
    if not files.exists(make(f"{path}/manifests")):
        return []
    names = (entry.getPath().getName() for entry in files.listStatus(make(f"{path}/manifests")))
    return sorted(name for name in names if name.endswith(".json"))


def _read(spark: SparkSession, path: str, name: str) -> dict:
    files, make = file_system(spark, path)
    stream = files.open(make(f"{path}/manifests/{name}"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, name: str, manifest: dict) -> None:
    """Write a manifest beside its place and move it there."""
    files, make = file_system(spark, path)
    draft = make(f"{path}/manifests/.{name}.draft")
    stream = files.create(draft, True)
    try:
        stream.write(json.dumps(manifest).encode())
    finally:
        stream.close()
    if not files.rename(draft, make(f"{path}/manifests/{name}")):
        raise OSError(f"could not put {path}/manifests/{name} in place")


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _rows(spark: SparkSession, path: str, manifest: dict, schema, buckets: Sequence[str] | None = None) -> DataFrame:
    """The rows of some buckets, or of all of them."""
    folders = manifest["folders"]
    chosen = [folders[b] for b in (folders if buckets is None else buckets) if b in folders]
    if not chosen:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/{folder}" for folder in chosen))


def upsert_batches(
    path: str, checkpoint: str, keys: Sequence[str], values: Sequence[str], buckets: int = 1, rows_per_bucket: int = ROWS_PER_BUCKET
) -> Sink:
    """Keep the last values of each key in a table at ``path``, which :func:`latest_table` reads.

    A batch holds one row per key. Only the buckets that it touches are written anew, by as many tasks. The table starts with ``buckets`` of them
    and doubles their number, writing all once, whenever it holds more than ``rows_per_bucket`` rows for each. A batch that comes
    again finds its version there and changes nothing. A later run starts from its first batch and puts its values over
    those of the earlier ones. Null keys are keys like others. Versions before the last two are removed.
    """
    columns = [*keys, *values]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        files, make = file_system(spark, path)
        run = run_folder(spark, f"{path}/runs", checkpoint)
        files.mkdirs(make(f"{path}/runs/{run}"))
        number = f"{run[4:].split('-')[0]}{batch_id:012d}"
        names = _manifests(spark, path)
        if f"{number}.json" in names:
            return
        last = _read(spark, path, names[-1]) if names else {"buckets": buckets, "folders": {}, "rows": {}}
        count, held = last["buckets"], sum(last["rows"].values())
        while held > count * rows_per_bucket:
            count *= 2
        # Written once, as a batch of a stream with state must not be worked out twice.
        staged = f"{path}/staged/{number}"
        batch.select(*columns).withColumn("_bucket", _bucket(keys, count)).write.mode("overwrite").parquet(staged)
        new = spark.read.parquet(staged)
        touched = [str(row[0]) for row in new.select("_bucket").distinct().collect()]
        if not touched and count == last["buckets"]:
            files.delete(make(staged), True)
            return
        schema = batch.select(*columns).schema
        if count == last["buckets"]:
            old = _rows(spark, path, last, schema, touched)
        else:
            old, touched = _rows(spark, path, last, schema), [str(b) for b in range(count)]
        old = old.withColumn("_bucket", _bucket(keys, count)).withColumn("_new", F.lit(0))
        both = old.unionByName(new.withColumn("_new", F.lit(1))).repartition(len(touched), "_bucket")
        # Grouped inside the buckets, which lie in one task each.
        newest = both.groupBy("_bucket", *keys).agg(F.max_by(F.struct(*values), "_new").alias("_values"))
        version = f"data/version={number}"
        newest.select("_bucket", *keys, "_values.*").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/{version}")
        sizes = spark.read.parquet(f"{path}/{version}").groupBy("_bucket").count().collect()
        kept = last if count == last["buckets"] else {"folders": {}, "rows": {}}
        manifest = {
            "buckets": count,
            "folders": kept["folders"] | {str(b): f"{version}/_bucket={b}" for b, _ in sizes},
            "rows": kept["rows"] | {str(b): n for b, n in sizes},
        }
        _put(spark, path, f"{number}.json", manifest)
        files.delete(make(staged), True)
        _remove_old(spark, path)

    return write


def _remove_old(spark: SparkSession, path: str) -> None:
    """Remove manifests before the last ones, and files that none of these names."""
    files, make = file_system(spark, path)
    names = _manifests(spark, path)
    last = [_read(spark, path, name) for name in names[-KEPT_VERSIONS:]]
    used = {folder for manifest in last for folder in manifest["folders"].values()}
    newest = names[-1].removesuffix(".json")
    for name in names[:-KEPT_VERSIONS]:
        files.delete(make(f"{path}/manifests/{name}"), False)
    versions = {folder.split("/")[1] for folder in used}
    for entry in files.listStatus(make(f"{path}/data")):
        version = entry.getPath().getName()
        if version not in versions and version.removeprefix("version=") < newest:
            files.delete(entry.getPath(), True)
            continue
        for bucket in files.listStatus(entry.getPath()):
            name = bucket.getPath().getName()
            if name.startswith("_bucket=") and f"data/{version}/{name}" not in used and version.removeprefix("version=") < newest:
                files.delete(bucket.getPath(), True)


def latest_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table that :func:`upsert_batches` keeps, in its last version: one row per key."""
    names = _manifests(spark, path)
    if not names:
        return spark.createDataFrame([], schema)
    return _rows(spark, path, _read(spark, path, names[-1]), schema)
