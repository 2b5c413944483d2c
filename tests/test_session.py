import pytest

from rillstat import session
from rillstat.functions.times import millis, with_instant


class Conf:
    def __init__(self, **values):
        self.values = {name.replace("_", "."): value for name, value in values.items()}

    def get(self, name, default=None):
        return self.values.get(name, default)


class Session:
    def __init__(self, **values):
        self.conf = Conf(**values)


def test_shared_folder_is_the_configured_one():
    assert session.shared_folder(Session(spark_checkpoint_dir="hdfs://a/b/", spark_master="yarn")) == "hdfs://a/b"


def test_cluster_needs_the_setting():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session(spark_master="yarn"))


def test_local_session_may_do_without():
    assert session.shared_folder(Session(spark_master="local[2]"))


def test_folders_are_new(spark):
    assert session.new_folder(spark, "x") != session.new_folder(spark, "x")


@pytest.mark.parametrize(
    "text, expected", [("500 milliseconds", 500), ("1 second", 1000), ("60 minutes", 3600000), ("1 hour", 3600000), ("2 days", 172800000),
    ("1 hour 30 minutes", 5400000), ("1.5 seconds", 1500), ("1 week", 604800000)]
)
def test_millis(spark, text, expected):
    assert millis(text) == expected


@pytest.mark.parametrize("text", ["1 month", "2 years", "0 seconds", "-1 hour", "1 microsecond", "soon"])
def test_durations_without_millis(spark, text):
    with pytest.raises(Exception):  # noqa: B017  Spark's own error for what is no interval
        millis(text)


@pytest.mark.parametrize("zone", ["UTC", "America/Denver", "Asia/Kolkata"])
def test_instant_does_not_depend_on_the_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 10:00:00' AS ts")
        assert with_instant(df).selectExpr("unix_millis(ts)").first()[0] == 1704103200000
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
