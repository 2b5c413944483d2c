"""Session settings and the shared folder that streams and tables live in."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Settings a streaming query needs when it starts.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app: str = "rillstat", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution, RocksDB state and an early cut of groups for any rank.

    ``settings`` holds further Spark settings with ``__`` for each dot, such as
    ``spark__sql__shuffle__partitions="2000"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.optimizer.windowGroupLimitThreshold": str(2**31 - 1),
        **STATE_SETTINGS,
    }
    given = {name.replace("__", "."): value for name, value in settings.items()}
    for name, value in (defaults | given).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Apply ``values`` inside the block and restore the session's own afterwards.

    A streaming query copies the settings when it starts, so the block only has
    to span the start.
    """
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


@cache
def _local_folder() -> tempfile.TemporaryDirectory:
    """A folder that goes when the process ends, with all copies that were stored in it."""
    return tempfile.TemporaryDirectory(prefix="rillstat-", ignore_cleanup_errors=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach.

    Only a ``local[...]`` session may do without the setting: it has one machine,
    so a temporary folder is as good.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.conf.get("spark.master", "").startswith("local"):
        return _local_folder().name
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder under :func:`shared_folder` that no earlier run has used."""
    return f"{shared_folder(spark)}/rillstat/{name}-{uuid.uuid4().hex}"
