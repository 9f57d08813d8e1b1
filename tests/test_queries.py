"""Every registered query against its oracle on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check import TABLES, rows_of, same_type

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns[:2] == ["Window_Start", "Window_End"]
    assert frame.count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    frame = contract.queries()[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    rows = frame.collect()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    answer = duck.execute(sql)
    names = [d[0] for d in answer.description]
    types = {d[0]: str(d[1]) for d in answer.description}
    assert sorted(frame.columns) == sorted(names)
    assert rows_of(frame.columns, rows) == rows_of(names, answer.fetchall())
    assert all(same_type(kind, types[column]) for column, kind in frame.dtypes)
