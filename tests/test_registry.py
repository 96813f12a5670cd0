import json

import pytest
from pyspark.sql import functions as F

from rankintel.operators import registry, selection, snapshots, upsert
from rankintel.sources.keywords import read_keywords
from rankintel.sources.pages import stored_pages


@pytest.mark.parametrize(
    "url, domain",
    [
        ("https://WWW.A.com:8080/x", "a.com:8080"),
        ("http://www.www.b.com?q=1", "b.com"),
        ("https://user@c.com#f", "user@c.com"),
        ("//d.com/x", "d.com"),
        ("e.com/x", ""),
        ("mailto:x@f.com", ""),
        ("http://[bad/x", ""),
        (None, ""),
    ],
)
def test_domain(spark, url, domain):
    df = spark.createDataFrame([(url,)], "url string")
    assert registry.with_domain(df).first().domain == domain


def keyword_file(tmp_path):
    items = [
        {"product_handle": "a", "product_title": "A", "our_url": "https://ours.com/a", "views_90d": 5, "queries": ["q1", "q2"]},
        {"product_handle": "b", "queries": ["q2", "q3"]},
        {"product_handle": "a", "product_title": "A2", "our_url": "https://ours.com/a2", "queries": ["q1"]},
        {"our_url": "x"},
    ]
    path = tmp_path / "keywords.json"
    path.write_text(json.dumps(items))
    return str(path)


def test_read_keywords(spark, tmp_path):
    products, queries = read_keywords(spark, keyword_file(tmp_path))
    assert [(r.handle, r.title, r.our_url, r.views_90d) for r in products.orderBy("ordinal").collect()] == [
        ("a", "A", "https://ours.com/a", 5), ("b", "b", "", 0), ("a", "A2", "https://ours.com/a2", 0), ("", "", "x", 0),
    ]
    assert [r.query for r in queries.orderBy("item", "pos").collect()] == ["q1", "q2", "q3"]


def test_seeding_and_query_map(spark, tmp_path):
    products, _ = read_keywords(spark, keyword_file(tmp_path))
    first = F.lit("2024-01-01").cast("timestamp")
    seeded = registry.seed_products(None, products, first)
    got = {r.handle: r for r in seeded.collect()}
    assert (got["a"].title, got["a"].queries) == ("A2", ["q1"])
    # q2 is left to b; the second naming of a keeps a's place before b.
    mapped = {r.query: r.our_handle for r in registry.query_product_map(seeded).collect()}
    assert mapped == {"q1": "a", "q2": "b", "q3": "b"}
    later = registry.seed_products(seeded, products.where("handle = 'b'"), F.lit("2024-02-01").cast("timestamp"))
    assert {r.handle: str(r.created_at) for r in later.collect()}["b"].startswith("2024-01-01")


def results(spark):
    rows = [
        ("q1", 1, "https://www.x.com/1", "2024-01-01"),
        ("q1", 2, "https://ours.com/a/", "2024-01-01"),
        ("q1", 3, "https://ours.com/b", "2024-01-01"),
        ("q2", 1, "https://y.com/1", "2024-01-02"),
        ("q2", 2, "no domain", "2024-01-02"),
        ("q3", 1, "https://x.com/1", "2024-01-03"),
    ]
    df = spark.createDataFrame(rows, "query string, position int, url string, day string")
    return df.select("query", "position", "url", F.lit("t").alias("title"), F.col("day").cast("timestamp").alias("scraped_at"))


def test_snapshots(spark, rows):
    mapping = spark.createDataFrame([("q1", "a", "https://www.ours.com/a"), ("q2", "b", "")], "query string, our_handle string, our_url string")
    got = rows(snapshots.build_snapshots(results(spark), mapping), "query", "our_handle", "our_position", "total_results")
    assert got == [("q1", "a", 2, 3), ("q2", "b", None, 2), ("q3", None, None, 1)]
    flat = snapshots.build_snapshot_results(results(spark), ["www.ours.com"])
    assert rows(flat.where("is_ours"), "position") == [(2,), (3,)]


def test_registries(spark, rows):
    found = registry.competitor_registry(results(spark), ["ours.com"])
    assert rows(found, "domain", F.to_date("first_seen_at").cast("string"), F.to_date("updated_at").cast("string")) == [
        ("x.com", "2024-01-01", "2024-01-03"), ("y.com", "2024-01-02", "2024-01-02"),
    ]
    again = registry.competitor_registry(results(spark).withColumn("scraped_at", F.lit("2025-01-01").cast("timestamp")), ["ours.com"], found)
    assert rows(again, "domain", F.year("first_seen_at"), F.year("updated_at")) == [("x.com", 2024, 2025), ("y.com", 2024, 2025)]
    pages = registry.competitor_product_registry(results(spark), ["ours.com"])
    assert rows(pages, "url", "domain") == [("https://www.x.com/1", "x.com"), ("https://x.com/1", "x.com"), ("https://y.com/1", "y.com")]


def test_selection(spark, rows):
    done = spark.createDataFrame([("https://y.com/1",)], "url string")
    left = selection.select_unclassified(results(spark), done, ["OURS.com"], 2)
    assert [r.url for r in left.collect()] == ["https://x.com/1", "no domain"]
    assert len(rows(selection.select_uncrawled(results(spark), done))) == 5
    assert rows(selection.select_uncrawled(results(spark), done, 1), "url") == [("https://ours.com/a/",)]


def test_upsert_keeps_stale_tail(spark, rows):
    old = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("q", 3, "c")], "query string, position int, url string")
    new = spark.createDataFrame([("q", 1, "x"), ("q", 2, "y")], "query string, position int, url string")
    once = upsert.upsert_replace(old, new, ["query", "position"], ["url"])
    assert rows(once) == [("q", 1, "x"), ("q", 2, "y"), ("q", 3, "c")]
    assert rows(upsert.upsert_replace(once, new, ["query", "position"], ["url"])) == rows(once)


def test_upsert_multi_chain(spark, rows):
    # 1 and 2 share the url, 2 and 3 the listing: 2 evicts 1 although 3 evicts 2; NULL listings never collide.
    data = [(1, "u1", "l1"), (2, "u1", "l2"), (3, "u3", "l2"), (4, "u4", None), (5, "u5", None)]
    df = spark.createDataFrame(data, "n int, url string, listing_id string")
    keys = [["url"], ["listing_id"]]
    assert rows(upsert.upsert_replace_multi(None, df, keys, ["n"]), "n") == [(3,), (4,), (5,)]
    split = upsert.upsert_replace_multi(upsert.upsert_replace_multi(None, df.where("n < 3"), keys, ["n"]), df.where("n >= 3"), keys, ["n"])
    assert rows(split, "n") == [(3,), (4,), (5,)]


def test_upsert_update_and_ignore(spark, rows):
    old = spark.createDataFrame([("a", "old", 1), ("b", "old", 1)], "k string, title string, made int")
    new = spark.createDataFrame([("a", None, 2), ("c", "new", 2), ("c", "newer", 3)], "k string, title string, made int")
    assert rows(upsert.upsert_update(old, new, ["k"], ["title"], ["made"])) == [("a", None, 1), ("b", "old", 1), ("c", "newer", 3)]
    assert rows(upsert.insert_ignore(old, new, ["k"], ["made"])) == [("a", "old", 1), ("b", "old", 1), ("c", "new", 2)]


def test_stored_pages_keep_the_first(spark, rows):
    at = F.lit("2024-01-01").cast("timestamp")
    pages = spark.createDataFrame([("u", "<title>A</title>" + "x" * 60_000), ("v", "")], "url string, html string")
    first = stored_pages(pages, at)
    assert rows(first, "url", "page_title", F.length("raw_html")) == [("u", "A", 50_000)]
    second = stored_pages(spark.createDataFrame([("u", "<title>B</title>"), ("w", "z")], "url string, html string"), at, first)
    # Only pages to append come back; the table they grow still holds the first page of u.
    assert rows(first.unionByName(second), "url", "page_title") == [("u", "A"), ("w", "")]
