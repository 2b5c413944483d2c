"""A corpus filtered, deduplicated, decontaminated, mixed and sharded, stage by stage.

Each stage takes the session, the documents its predecessor kept and the folder of the tables,
and returns the documents it keeps with their own columns; the last one adds the shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillstat.llm.decontamination import decontaminated
from rillstat.llm.mixing import mixed
from rillstat.llm.near_duplicates import deduplicated
from rillstat.llm.quality import accepted
from rillstat.llm.queries import TARGETS
from rillstat.llm.sharding import sharded
from rillstat.session import new_folder


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return deduplicated(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose rows have the target marginals; documents wanted more than once are repeated."""
    return mixed(docs, TARGETS, repeats=True).select(*docs.columns)


def placed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot."""
    return sharded(docs)


STAGES = [
    ("quality classifier", good),
    ("MinHash near-dedup", distinct),
    ("benchmark decontamination", clean),
    ("mixing sources to target weights", weighted),
    ("sharding", placed),
]

#: The classifier's model and MinHash cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
