"""The registered queries on the smallest tables, against oracle SQL where there is one."""

import os

import duckdb
import pytest

from loadlens.llm import queries
from tools.check import TABLES, rows_of, same_type

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")
NATIVE = ("op3", "op4", "op7", "op10")


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, len(queries.QUERIES) + 1))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    frame = queries.QUERIES[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name.split("_")[0] in NATIVE:
        assert "InArrow" not in plan and "Python" not in plan
    rows = frame.collect()
    sql = queries.ORACLES.get(name)
    if sql is None:
        whole = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
        assert len(rows) == whole or name.startswith("op3") and rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    types = {d[0]: str(d[1]) for d in answer.description}
    assert rows_of(frame.columns, rows) == rows_of(names, answer.fetchall())
    assert all(same_type(kind, types[column]) for column, kind in frame.dtypes)
