"""Every registered query against its comparison SQL on the smallest test tables, and a look at its plan."""

import math
import os
from datetime import date, datetime

import duckdb
import pytest

from rankintel.plans.catalog import queries
from rankintel.plans.oracles import oracle_sql

ROOT = os.environ.get("RANKINTEL_TEST_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = queries(), oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(ROOT):
        if file.endswith(".parquet"):
            connection.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{ROOT}/{file}'")
    return connection


def shown(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.9g}"
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return str(value)


def table(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, ROOT)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    expected = duck.execute(SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(df.columns)
    assert table(df.columns, df.collect()) == table(names, expected.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
