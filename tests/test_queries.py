"""Every registered query against its SQL on the smallest data set, and its plan."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from loomgraph.plans import PLANS as LIBRARY
from tools.check import TABLES, compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
PLANS, SQL = queries(), oracle_sql()
#: Queries of the library without SQL, and where they are tested instead.
TESTED_ELSEWHERE: dict[str, str] = {}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def test_only_these_have_no_sql():
    assert set(LIBRARY) - set(SQL) == set(TESTED_ELSEWHERE)


@pytest.mark.parametrize("name", [n for n in LIBRARY if n in SQL])
def test_query_matches_sql(spark, duck, name):
    good, note = compare(spark, duck, name, PLANS[name], SQL.get(name), SF)
    assert good, note


@pytest.mark.parametrize("name", ["bfs_out", "resolve_names", "build_edges", "caller_attribution", "search", "references_typescript"])
def test_no_nested_loops(spark, name):
    plan = PLANS[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_entry(spark):
    assert entry(spark).count() > 0
