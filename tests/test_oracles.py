"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from settlegrid.plans import registry
from settlegrid.tables import NAMES
from tools.compare import canonical

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in NAMES:
        connection.sql(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF_DIR).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got).equals(canonical(want))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF_DIR).count() >= 0


def test_entry(spark):
    import __spark_entry__

    frame = __spark_entry__.queries()["i8_percolation_indicators"](spark, SF_DIR)
    assert frame.columns == ["series", "r_crit", "perc_dcrit", "perc_gmax", "w_trans", "gamma"] and frame.count() > 0
