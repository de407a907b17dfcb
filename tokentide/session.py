"""Session helpers: Spark settings, the shared scratch folder, written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings for jobs over long texts. A row can hold more than a million tokens,
# so batches to Python are bounded by rows and (Spark default) by bytes.
JOB_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}

# Keyed stream state: only this store holds lists, maps and timers, and with a changelog a
# micro-batch writes what it changed and no more.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

# The shuffle files of a query go with its end, not when the driver happens to collect its garbage.
WRITE_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def start(app_name: str = "tokentide", **settings: str) -> SparkSession:
    """A session with the settings above; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in (JOB_SETTINGS | STATE_SETTINGS).items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package from its checkout.

    On a cluster the package travels with ``--py-files`` or the image instead.
    """
    root = str(Path(__file__).resolve().parent.parent)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(
            [root, *filter(None, paths)]
        )
    return spark


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def state_settings(spark: SparkSession) -> AbstractContextManager[None]:
    """The settings of stateful streams while they start; a started query keeps them."""
    return _settings(spark, STATE_SETTINGS)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without one falls back to a folder of this machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tokentide-"))
        folder = context.getCheckpointDir()
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for one intermediate result of this application."""
    app = spark.sparkContext.applicationId
    return f"{scratch_dir(spark).rstrip('/')}/tokentide/{app}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage and freezes values that depend on task layout, and keeps
    column pruning for whatever reads the result, which a row checkpoint would not.
    What the write shuffled is removed at once, as nothing reads it again.
    """
    path = scratch_path(df.sparkSession, label)
    with _settings(df.sparkSession, WRITE_SETTINGS):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
