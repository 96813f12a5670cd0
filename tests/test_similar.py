"""Similar queries for a table of queries, against the rule for one query and by plain loops."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rankintel.operators import history, results
from rankintel.operators.similar import missing_queries, similar_queries, similar_to_each


def matches(text: str, word: str) -> bool:
    """LIKE '%word%', ignoring case, by trying every stretch of the text."""

    def like(t: str, p: str) -> bool:
        if not p:
            return not t
        if p[0] == "%":
            return any(like(t[i:], p[1:]) for i in range(len(t) + 1))
        return bool(t) and (p[0] in ("_", t[0])) and like(t[1:], p[1:])

    return like(text.lower(), f"%{word.lower()}%")


def expected(asked, stored, limit=5):
    out = []
    for query in {q for q in asked if q and q.split()}:
        near = sorted({t for t in stored if t is not None and matches(t, query.split()[0])})[:limit]
        out += [(query, i + 1, t) for i, t in enumerate(near)]
    return sorted(out)


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "query string")


def got(spark, asked, stored):
    return sorted(tuple(r) for r in similar_to_each(frame(spark, asked), frame(spark, stored)).collect())


STORED = ["gold ring", "Gold Ring", "old GOLD", "silver", "a", "", None, "14k gold", "goldfish", "solid gold", "50% off", "x_y", "a\\b", "ÉTÉ ring", "日本 gold"]
ASKED = ["gold band", "GOLD", "  gold  x", "g", "ol", "s_lver x", "%", "___", "_%_", "g%d", "nothing here", "", "   ", None, "a\\b", "été", "日本", "%%off", "______________"]


def test_matches_plain_loops(spark):
    assert got(spark, ASKED, STORED) == expected(ASKED, STORED)
    for query in ["gold band", "s_lver x", "%", "a\\b", "   "]:
        one = [r.query for r in similar_queries(frame(spark, STORED), query).collect()]
        assert one == [t for q, _, t in expected([query], STORED)], query


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abA_% é\\", max_size=6), max_size=8), st.lists(st.text("abA_% é\\", max_size=8), max_size=12))
def test_random_texts(spark, asked, stored):
    assert got(spark, asked, stored) == expected(asked, stored)


def test_empty_sides(spark):
    assert got(spark, [], STORED) == [] and got(spark, ASKED, []) == []


def test_one_gram_in_a_third_of_all_queries(spark):
    stored = spark.range(30_000).selectExpr("IF(id % 3 = 0, concat('gold ', id), concat('q', id)) AS query")
    asked = spark.range(2_000).selectExpr("concat(IF(id % 2 = 0, 'gold', concat('q', id)), ' more ', id) AS query")
    found = similar_to_each(asked, stored)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    first = {r.query: r.similar for r in found.where("rank = 1").collect()}
    assert first["gold more 0"] == "gold 0" and first["q1 more 1"] == "q1" and first["gold more 1998"] == "gold 0"
    assert found.where("query = 'gold more 4'").count() == 5


def test_only_bounded_sides_are_broadcast(spark):
    # Words, queries and texts grow with the tables; by their estimated sizes Spark would send them all to the driver.
    asked, stored = spark.range(3_000).selectExpr("concat(id, ' RING') AS query"), spark.range(3_000).selectExpr("concat('Customer#', lpad(id, 9, '0')) AS query")
    found = missing_queries(asked, stored)
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert joins and all("_start" in line and "LeftSemi" in line for line in joins)
    near = {r.query: list(r.similar_queries) for r in found.where("query IN ('7 RING', '2999 RING')").collect()}
    assert near == {"7 RING": [f"Customer#{n:09d}" for n in (7, 17, 27, 37, 47)], "2999 RING": ["Customer#000002999"]}


def test_words_longer_than_a_gram(spark):
    stored = ["a long necklace", "aaaaaaaaaaaaaaaa", "necklaces", "NECKLACE", "neck lace", "x necklaces", "old necklaces", "aaaaaaaaa"]
    asked = ["necklace x", "necklaces x", "aaaaaaaa", "aaaaaaaaaa b", "neckla%s", "n_cklaces", "a", "aa", "necklacesss"]
    assert got(spark, asked, stored) == expected(asked, stored)


def test_missing_queries(spark):
    rows = missing_queries(frame(spark, ["gold ring", "gold band", "none", " ", None]), frame(spark, STORED)).collect()
    assert {r.query: r.similar_queries for r in rows} == {
        "gold band": ["14k gold", "Gold Ring", "gold ring", "goldfish", "old GOLD"], "none": [], " ": [],
    }


@pytest.fixture
def asked(spark):
    return frame(spark, ["rings", "ring x", "other"])


def test_reports_name_similar_queries(spark, asked, rows):
    serp = spark.createDataFrame([("rings", 1, "u1", "One"), ("rings", 2, "u2", None), ("bands", 1, "u1", "One")], "query string, position int, url string, title string")
    classes = spark.createDataFrame([("u1", "vermeil", "14k", "high")], "url string, metal_type string, karat string, confidence string")
    shown = results.list_serp_results(serp, classes, asked, limit=1)
    assert rows(shown, "query", "position", "metal_type", "similar_queries") == [
        ("other", None, None, []), ("ring x", None, None, ["rings"]), ("rings", 1, "vermeil", None),
    ]
    # A page beyond a query's results is empty, but the query is not missing.
    assert rows(results.list_serp_results(serp, classes, asked, limit=1, offset=5), "query") == [("other",), ("ring x",)]
    shop = serp.selectExpr("*", "1.0D AS price_usd", "'s' AS shop", "1 AS reviews", "true AS star_seller")
    assert rows(results.list_marketplace_results(shop, classes, asked), "query", "position", "similar_queries") == [
        ("other", None, []), ("ring x", None, ["rings"]), ("rings", 1, None), ("rings", 2, None),
    ]


def test_history_names_similar_queries(spark, asked, rows):
    snaps = spark.createDataFrame([(1, "rings", "2024-01-01", 3, 9)], "snapshot_id long, query string, scraped_at string, our_position int, total_results int")
    found = spark.createDataFrame([(1, 1, "x.com", False)], "snapshot_id long, position int, domain string, is_ours boolean")
    shown = history.serp_history(snaps, found, asked)
    assert rows(shown, "query", "snapshot_id", "similar_queries") == [("other", None, []), ("ring x", None, ["rings"]), ("rings", 1, None)]
