"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import database, differences
from tests.plans import plan_text

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_agrees_with_sql(spark, connection, name):
    frame = queries()[name](spark, SF_DIR)
    found = frame.toPandas()
    plan = plan_text(frame)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if name in oracle_sql():
        assert differences(found, connection.execute(oracle_sql()[name]).df()) == []
    else:
        assert len(found) > 0


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())
