from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rankintel.operators import history, intel, results, stats


@pytest.fixture(scope="module")
def tables(spark):
    def day(n):
        return datetime(2024, 1, n)

    serp = spark.createDataFrame(
        [("rings", 1, "u1", "One", "s" * 250), ("rings", 2, "u2", None, None), ("bands", 1, "u3", "Three", ""), ("bands", 2, "u1", "One", "")],
        "query string, position int, url string, title string, snippet string",
    )
    pages = spark.createDataFrame([("u1", "Page one"), ("u2", "")], "url string, page_title string")
    classes = spark.createDataFrame(
        [("u1", "solid_gold", "18k", "gold", 10.0, "e" * 200, "high", day(1)), ("u4", "vermeil", None, None, None, None, None, day(2))],
        "url string, metal_type string, karat string, base_metal string, price_usd double, evidence string, confidence string, classified_at timestamp",
    )
    return serp, pages, classes


def test_intel_defaults_and_global_limit(tables, rows):
    shown = intel.competitor_intel(*tables, keywords=["rings", "bands"], limit=3)
    got = rows(shown, "query", "position", "page_title", "metal_type", F.length("evidence"))
    assert got == [("bands", 1, "Three", "unknown", 0), ("bands", 2, "Page one", "solid_gold", 120), ("rings", 1, "Page one", "solid_gold", 120)]
    assert intel.competitor_intel(*tables, limit=None).count() == 4
    assert intel.competitor_intel(*tables, limit=1, per_query=True).count() == 2


def test_coverage_follows_the_limited_rows(spark, tables, rows):
    keywords = spark.createDataFrame([(0, "rings"), (1, "none"), (2, "bands")], "ordinal int, keyword string")
    some = intel.competitor_intel(*tables, keywords=keywords.select("keyword"), limit=2)
    assert rows(intel.keyword_coverage(keywords, some)) == [(0, "rings", False), (1, "none", False), (2, "bands", True)]


@pytest.mark.parametrize(
    "labels, code, text",
    [
        ([], "no_data", "No competitor data found for these keywords."),
        (["vermeil", "gold_plated", "gold_filled"], "none_solid", None),
        (["solid_gold", "unknown", "unknown", "unknown"], "few_solid", "Only 1/4 solid gold competitors. Strong differentiation opportunity on material quality."),
        (["solid_gold", "unknown", "unknown"], "many_solid", "1/3 competitors are solid gold — differentiate on designer credentials, handcrafted, Nevada-made."),
    ],
)
def test_insight(spark, labels, code, text):
    df = spark.createDataFrame([(m,) for m in labels], "metal_type string")
    row = intel.insight(intel.metal_summary(df)).first()
    assert row.insight_code == code and (text is None or row.insight == text)


@pytest.mark.parametrize(
    "solid, others, code",
    [(0, 0, "no_data"), (0, 3, "none_solid"), (1, 15, "few_solid"), (1, 3, "some_solid"), (1, 1, "many_solid")],
)
def test_breakdown(spark, solid, others, code):
    labels = ["solid_gold"] * solid + ["vermeil"] * others
    serp = spark.createDataFrame([("q", n, f"u{n}") for n in range(len(labels))], "query string, position int, url string")
    classes = spark.createDataFrame([(f"u{n}", m) for n, m in enumerate(labels)], "url string, metal_type string")
    shares = intel.metal_breakdown(serp, classes, limit=50)
    row = intel.breakdown_summary(shares).first()
    assert row.summary_code == code
    if others == 15:
        # 1 of 16 is 6.25 percent: half goes to the even digit.
        assert row.solid_pct == 6.2 and row.summary.startswith("Only 6.2% solid gold. 93.8% is plated/vermeil.")


def test_context_needs_page_and_label(tables, rows):
    assert rows(intel.keyword_context(*tables), "query", "position", "url") == [("bands", 2, "u1"), ("rings", 1, "u1")]


def test_result_pages(tables, rows):
    serp, _, classes = tables
    first = results.list_serp_results(serp, classes, "rings", limit=1)
    assert rows(first, "position", "metal_type", "total", "has_more", F.length("snippet")) == [(1, "solid_gold", 2, True, 200)]
    second = results.list_serp_results(serp, classes, "rings", limit=1, offset=1)
    assert rows(second, "position", "title", "classified", "metal_type", "has_more") == [(2, "", False, "not classified", False)]


def test_similar_queries(spark, rows):
    stored = spark.createDataFrame([("Gold ring",), ("gold ring",), ("old GOLD",), ("silver",)], "query string")
    assert rows(results.similar_queries(stored, "gold band")) == [("Gold ring",), ("gold ring",), ("old GOLD",)]
    assert rows(results.similar_queries(stored, "s_lver x")) == [("silver",)]


def test_product_classification(tables, rows):
    known = results.product_classification(*tables, url="u1")
    assert rows(known, "status", "query", "position", "page_title") == [("classified", "bands", 2, "Page one"), ("classified", "rings", 1, "Page one")]
    assert rows(results.product_classification(*tables, url="u3"), "status", "query") == [("in_serp_not_classified", "bands")]
    assert rows(results.product_classification(*tables, url="u4"), "status", "metal_type", "query") == [("classified", "vermeil", None)]
    assert rows(results.product_classification(*tables, url="nope"), "url", "status") == [("nope", "not_found")]


def test_stats(tables):
    row = stats.db_stats(*tables).first()
    assert (row.serp_results, row.keywords_count, row.product_pages, row.classifications) == (4, 2, 2, 2)


def test_marketplace_intel_prefers_listing_values(spark):
    serp = spark.createDataFrame([("q", 1, "u", "serp", 5.0, None, 3, True)], "query string, position int, url string, title string, price_usd double, shop string, reviews int, star_seller boolean")
    listings = spark.createDataFrame(
        [("u", "", 0.0, "Shop", ["gold"], [str(n) for n in range(12)], 7, None, None, None)],
        "url string, title string, price_usd double, shop string, materials array<string>, tags array<string>, favorites int, metal_type string, karat string, confidence string",
    )
    row = results.marketplace_intel(serp, listings, "q").first()
    assert (row.title, row.price_usd, row.shop, row.metal_type, len(row.tags)) == ("serp", 5.0, "Shop", "not_classified", 10)
    row = results.list_marketplace_results(serp, listings, "q").first()
    assert (row.metal_type, row.total, row.classified) == ("not classified", 1, False)


def snaps(spark, positions):
    data = [(n, "q", datetime(2024, 1, 1 + n), p, 10) for n, p in enumerate(positions)]
    return spark.createDataFrame(data, "snapshot_id long, query string, scraped_at timestamp, our_position int, total_results int")


@pytest.mark.parametrize(
    "positions, trend, current",
    [
        ([None, None], "not_ranked", None), ([None, 4], "stable", 4), ([5, None, 2, None], "improving", 2), ([2, 5], "declining", 5), ([3, 9, 3], "stable", 3),
    ],
)
def test_position_trend(spark, positions, trend, current):
    row = history.position_trend(snaps(spark, positions), "q").first()
    assert (row.trend, row.current_position, row.weeks_tracked) == (trend, current, len(positions))


def test_trend_window(spark):
    row = history.position_trend(snaps(spark, [1, 9, 8]), "q", limit=2).first()
    assert (row.trend, row.weeks_tracked) == ("improving", 2)


def test_serp_history_keeps_snapshots_without_competitors(spark):
    res = spark.createDataFrame(
        [(0, 2, "b", False), (0, 1, "a", False), (0, 6, "far", False), (1, 1, "ours", True), (1, 2, None, False)],
        "snapshot_id long, position int, domain string, is_ours boolean",
    )
    got = history.serp_history(snaps(spark, [3, 4]), res, "q").orderBy("snapshot_id").collect()
    assert [[(d.position, d.domain) for d in r.top_domains] for r in got] == [[(1, "a"), (2, "b")], []]


def test_products_and_prices(spark, rows):
    products = spark.createDataFrame(
        [("u1", "a.com"), ("u2", "b.com"), ("u3", "b.com")], "url string, domain string"
    ).withColumns({"first_seen_at": F.lit(None).cast("timestamp"), "last_scraped_at": F.lit(None).cast("timestamp")})
    owners = spark.createDataFrame([("a.com", None), ("b.com", "Bee")], "domain string, name string")
    shots = spark.createDataFrame(
        [
            ("u1", datetime(2024, 1, 1), 9.0, False, False), ("u1", datetime(2024, 1, 8), None, False, True),
            ("u2", datetime(2024, 1, 1), 5.0, False, False), ("u2", datetime(2024, 1, 8), 7.0, True, False),
        ],
        "url string, scraped_at timestamp, price_usd double, price_changed boolean, description_changed boolean",
    )
    cheapest = history.competitor_products(products, owners, shots)
    assert [(r.url, r.name, r.price_usd) for r in cheapest.collect()] == [("u1", "a.com", None), ("u3", "Bee", None), ("u2", "Bee", 7.0)]
    assert rows(history.competitor_products(products, owners, shots, only_changed=True), "url") == [("u1",), ("u2",)]
    assert rows(history.competitor_products(products, owners, shots, domain="b.com"), "url") == [("u2",), ("u3",)]
    ranges = history.price_range(shots, products)
    assert rows(ranges, "url", "status", "total_snapshots", "price_changes_detected", "min_price", "max_price", "current_price") == [
        ("u1", "ok", 2, 0, 9.0, 9.0, None), ("u2", "ok", 2, 1, 5.0, 7.0, 7.0), ("u3", "no_snapshots", 0, 0, None, None, None),
    ]
    assert [r.price_usd for r in history.price_history(shots, products, "u2").collect()] == [5.0, 7.0]


def test_delta_changes(spark, tables):
    log = spark.createDataFrame(
        [("u1", "karat", None, "14k", datetime(2024, 1, 1)), ("u9", "karat", "14k", None, datetime(2024, 1, 2))],
        "url string, field string, old_value string, new_value string, detected_at timestamp",
    )
    assert [(r.url, r.page_title) for r in history.delta_changes(log, tables[1], 1).collect()] == [("u9", "")]
    assert history.delta_changes(log, tables[1]).count() == 2
