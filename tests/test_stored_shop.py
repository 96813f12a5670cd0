"""The marketplace report for a table of queries reads its results from a stored table, made in one pass without leftovers."""

import time
from datetime import datetime

import pytest

from rankintel.plans.bindings import Bound
from rankintel.plans.catalog import queries
from rankintel.sources.tables import SHUFFLES_GO

SHAPES = {
    "customer": "c_custkey long, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "documents": "doc_id long, text string, lang string",
    "labels": "doc_id long, quality int, toxic int",
}


def part(key, name):
    return (key, name, "Brand#1", "LARGE", 1, 2.0)


ROWS = {
    "customer": [(1, "TOYS"), (2, "TOYS"), (12, "CARS"), (None, "CARS")],
    "orders": [(10, 1, datetime(2024, 1, 1)), (11, 1, datetime(2024, 1, 2)), (12, 2, datetime(2024, 1, 3)), (13, None, datetime(2024, 1, 3)), (14, 2, None), (12, 2, datetime(2024, 1, 3)), (None, 1, datetime(2025, 1, 1))],
    "lineitem": [
        (10, 5, 1, 1, 1.0, 10.0, "A", "F"),
        (11, 99, 1, 1, 9.0, 90.0, "A", "F"),  # the newest of its place, but of a part that is not there
        (11, None, 1, 1, 9.0, 90.0, "A", "F"),
        (10, 5, 1, 2, 1.0, 10.0, "A", "F"), (11, 6, 1, 2, 2.5, 20.0, "R", "O"), (11, 6, 1, 2, 2.5, 20.0, None, "F"),
        (12, 7, 3, 1, 3.0, 30.0, "N", None), (12, 7, 3, 1, 3.0, 30.0, "N", None), (14, 5, 1, 1, 4.0, 40.0, "N", "F"),
        (13, 5, 1, 3, 5.0, None, "N", "O"), (None, 5, 1, 4, 6.0, 60.0, "N", "O"), (12, 98, 1, 5, 7.0, 70.0, "N", "O"),
    ],
    "part": [part(5, "ring"), part(6, "cap"), part(6, "cap"), part(7, None), part(8, "bolt"), part(None, "none")],
    "documents": [(5, "some text", "de"), (7, "more", "fr")],
    "labels": [(5, 1, 0), (7, 0, 1)],
}


@pytest.fixture
def root(spark, tmp_path):
    for name, shape in SHAPES.items():
        spark.createDataFrame(ROWS[name], shape).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").splitlines()
    return {f for f in files if "shuffle_" in f}


def test_report_reads_stored_results(spark, root, rows):
    shown = queries()["list_marketplace_results_asked"](spark, root)
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    # The lines of all orders were sorted into results once for each place that asks for these.
    assert "l_orderkey" not in plan and "o_orderkey" not in plan
    assert rows(shown, "query", "position", "url", "title", "price_usd", "shop", "star_seller", "karat", "total", "similar_queries") == [
        ("1", 1, 5, "ring", 10.0, "A", True, "de", 2, None), ("1", 2, 6, "cap", 20.0, "R", False, "", 2, None),
        ("1 TOYS", None, None, None, None, None, None, None, None, "1"),
        ("12", None, None, None, None, None, None, None, None, ""), ("12 CARS", None, None, None, None, None, None, None, None, ""),
        ("2", 1, 7, "", 30.0, "N", False, "fr", 1, None), ("2 TOYS", None, None, None, None, None, None, None, None, "2"),
    ]


def test_stored_results_are_the_results(spark, root, tmp_path, rows):
    b = Bound(spark, root)
    stored = b.stored_shop_serp(f"{tmp_path}/stored")
    assert stored.dtypes == b.shop_serp.dtypes and stored.count() == 4
    assert rows(stored) == rows(b.shop_serp)


def test_storing_leaves_no_shuffle_files(spark, root, tmp_path):
    before, setting = shuffle_files(spark), spark.conf.get(SHUFFLES_GO, None)
    Bound(spark, root).stored_shop_serp(f"{tmp_path}/stored")
    assert spark.conf.get(SHUFFLES_GO, None) == setting
    until = time.monotonic() + 20
    while shuffle_files(spark) - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
