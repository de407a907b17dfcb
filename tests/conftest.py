"""One local session for all tests."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from tokentide.session import ship_package


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield ship_package(session)
    session.stop()


@pytest.fixture
def rows(spark):
    """Build a frame from tuples and a schema text."""

    def build(data, schema):
        return spark.createDataFrame(data, schema)

    return build


@pytest.fixture
def shuffled(spark):
    """Ids of the shuffles that have files on disk, without those from before the test."""

    def ids():
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        names = [path.rsplit("/", 1)[-1].split("_") for path in manager.getAllFiles().mkString("\n").split("\n")]
        return {int(name[1]) for name in names if name[0] == "shuffle"}

    before = max(ids(), default=-1)
    return lambda: {one for one in ids() if one > before}
