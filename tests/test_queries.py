"""Every registered query against its SQL in DuckDB."""

import compare
import pytest

import __spark_entry__ as registry
from rillstat.plans.oracles import ORACLES
from rillstat.plans.queries import QUERIES
from rillstat.plans.stream_queries import STREAM_QUERIES

BATCH = list(QUERIES)
STREAM = list(STREAM_QUERIES)


def check(spark, name, folder):
    difference = compare.difference(
        registry.queries()[name](spark, folder), compare.connect(folder), registry.oracle_sql()[name]
    )
    assert difference is None, difference


@pytest.mark.parametrize("name", BATCH)
def test_batch(spark, name):
    check(spark, name, "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", STREAM)
def test_stream(spark, name):
    check(spark, name, "/root/testdata/sf0.001")


def test_entry(spark):
    assert registry.entry(spark).count() > 0


def test_all_have_sql():
    assert set(ORACLES) == {*QUERIES, *STREAM_QUERIES}
    assert {*QUERIES, *STREAM_QUERIES} <= set(registry.queries())
