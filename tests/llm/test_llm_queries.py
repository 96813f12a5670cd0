"""The registered training-text queries against their comparison SQL on the smallest test tables."""

import os

import duckdb
import pytest

from rankintel.llm.catalog import oracle_sql, queries

ROOT = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "conversations")

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{ROOT}/{table}.parquet'")
    expected = duck.execute(oracle_sql()[name])
    names = sorted(d[0] for d in expected.description)
    at = [[d[0] for d in expected.description].index(n) for n in names]
    df = queries()[name](spark, ROOT)
    assert sorted(df.columns) == names
    assert sorted(str(tuple(r[n] for n in names)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in expected.fetchall())


def test_native_chat_runs_no_python(spark):
    plan = queries()["op7_chat"](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
