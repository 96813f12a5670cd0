import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rankintel.operators.results import list_serp_results, similar_queries
from rankintel.plans import batch
from rankintel.plans.batch import Corpora, RunOptions, _pages_of, latest_digest, newest_fetch, run_batch
from rankintel.sources.keywords import read_keywords
from rankintel.sources.tables import append_history, before_run, load_tables, moment, read_table
from rankintel.sources.versions import attempts, manifests, published_folders

FETCHED = datetime(2024, 1, 1)
SHOP = "https://www.etsy.com/listing"


def search_page(*urls):
    return "<html>" + "".join(f'<a href="{u}"><h3>Title {u[-1]}</h3></a>' for u in urls) + "</html>"


def product_page(price, words):
    return f"<title>{words}</title><p>{words} for ${price}.00 in stock</p>" + "<i></i>" * 60


def shop_page(*ids):
    items = [{"url": f"{SHOP}/{i}/x?ref=1", "name": f"Listing {i}", "offers": {"price": 5 + i}} for i in ids]
    return f'<script type="application/ld+json">{json.dumps({"@type": "ItemList", "itemListElement": items})}</script>'


def listing_page(price):
    product = {"@type": "Product", "name": "Vermeil ring", "offers": {"price": price}, "brand": "Maker"}
    return f'<script type="application/ld+json">{json.dumps(product)}</script>"tags": ["14k"]' + " " * 500


def pages(spark, key, data):
    return spark.createDataFrame([(k, html, FETCHED) for k, html in data], f"{key} string, html string, fetched_at timestamp")


@pytest.fixture(scope="module")
def outcome(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    keywords = root / "keywords.json"
    keywords.write_text(
        json.dumps([{"product_handle": "ring", "product_title": "Ring", "our_url": "https://www.ours.com/ring", "queries": ["gold ring", "band"]}])
    )
    products, _ = read_keywords(spark, str(keywords))
    ours = "https://www.ours.com/ring"

    def run(number, serp, prices, folders, at, limit=None):
        corpora = Corpora(
            serp=pages(spark, "query", serp),
            products=pages(spark, "url", prices),
            shop=pages(spark, "query", [("ring", shop_page(1, 2))]),
            listings=pages(spark, "url", [(f"{SHOP}/1/x", listing_page(0)), (f"{SHOP}/2/x", "thin")]),
        )
        options = RunOptions(our_domains=["ours.com"], classify_limit=limit, skip_pages=False)
        return run_batch(spark, products, corpora, folders, str(root / f"v{number}"), str(root / "appended"), at, options)

    first = run(
        1,
        [("gold ring", search_page("https://a.com/1", "https://b.com/2", "https://c.com/3", ours)), ("band", search_page("https://a.com/1")), ("other", search_page("https://z.com/1"))],
        [("https://a.com/1", product_page(100, "14k solid gold ring")), ("https://b.com/2", product_page(50, "gold plated brass band"))],
        None,
        datetime(2024, 1, 7),
    )
    counts = {name: df.count() for name, df in first.tables.items()}
    digest = latest_digest(first.tables)
    arguments = (
        2,
        [("gold ring", search_page(ours, "https://a.com/1", "https://d.com/4"))],
        [("https://d.com/4", product_page(70, "sterling silver ring"))],
        first.folders,
        datetime(2024, 1, 14),
    )
    second = run(*arguments)
    seen = {name: df.count() for name, df in second.tables.items()}, second.summary.first()
    # The repeated run replaces what the second published, so its tables are read from here on.
    return first, counts, digest, run(*arguments), seen, root


def test_first_run(outcome):
    first, counts, digest, *_ = outcome
    assert digest is None
    assert counts == {
        "our_products": 1, "serp_results": 5, "competitors": 3, "competitor_products": 3, "classifications": 3,
        "shop_serp_results": 2, "shop_listings": 2, "product_pages": 2, "deltas": 9, "serp_snapshots": 2,
        "serp_snapshot_results": 5, "product_snapshots": 3,
    }
    labels = {r.url: (r.metal_type, r.karat, r.price_usd, r.evidence) for r in first.tables["classifications"].collect()}
    assert labels["https://a.com/1"][:3] == ("solid_gold", "14k", 100.0)
    assert labels["https://b.com/2"][:3] == ("gold_plated", "unknown", 50.0)
    assert labels["https://c.com/3"] == ("unknown", "unknown", None, "fallback: empty page (0 chars)")


def test_marketplace_step(outcome):
    rows = {r.url: r for r in outcome[0].tables["shop_listings"].collect()}
    good, thin = rows[f"{SHOP}/1/x"], rows[f"{SHOP}/2/x"]
    assert (good.listing_id, good.title, good.shop, good.metal_type, good.karat, good.price_usd) == ("1", "Vermeil ring", "Maker", "vermeil", "14k", None)
    assert (thin.listing_id, thin.title, thin.metal_type, thin.tags) == ("2", None, "unknown", [])
    assert [r.price_usd for r in outcome[0].tables["shop_serp_results"].orderBy("position").collect()] == [6.0, 7.0]


def test_second_run_keeps_the_stale_tail_and_grows_histories(outcome):
    second = outcome[3]
    kept = {(r.query, r.position): r.url for r in second.tables["serp_results"].collect()}
    assert kept[("gold ring", 1)] == "https://www.ours.com/ring" and kept[("gold ring", 4)] == "https://www.ours.com/ring"
    assert len(kept) == 5
    latest = second.tables["serp_snapshots"].where(F.col("run_date") == F.lit("2024-01-14").cast("date")).first()
    assert (latest.query, latest.our_position, latest.total_results) == ("gold ring", 1, 3)
    assert second.tables["classifications"].count() == 4
    first_seen = {r.domain: (r.first_seen_at.day, r.updated_at.day) for r in second.tables["competitors"].collect()}
    assert first_seen == {"a.com": (7, 14), "b.com": (7, 7), "c.com": (7, 7), "d.com": (14, 14)}


def test_digest_of_two_runs(outcome):
    lines = [(r.section, r.subject, r.detail) for r in latest_digest(outcome[3].tables).orderBy("section", "rank").collect()]
    assert lines == [
        ("dropouts", "a.com", "band"), ("dropouts", "b.com", "gold ring"), ("dropouts", "c.com", "gold ring"),
        ("entrants", "d.com", "gold ring"), ("pos_shifts", "gold ring", "#4→#1"),
    ]


def test_repeating_a_run_changes_nothing(outcome):
    again, (counts, summary) = outcome[3], outcome[4]
    assert {name: df.count() for name, df in again.tables.items()} == counts
    assert again.summary.first() == summary


def test_tables_load_as_views(spark, outcome):
    tables = load_tables(spark, str(outcome[5] / "appended"), views=True)
    assert spark.sql("SELECT count(*) FROM serp_snapshots").first()[0] == 3
    assert tables["shop_listings"].count() == 0


def test_a_version_that_is_read_is_never_written_over(spark, tmp_path):
    folders = {"competitors": f"{tmp_path}/v1/competitors"}
    with pytest.raises(ValueError, match="competitors"):
        run_batch(spark, None, None, folders, f"{tmp_path}/v1", f"{tmp_path}/appended", datetime(2024, 1, 1))


def test_a_blank_query_is_similar_to_none(spark):
    stored = spark.createDataFrame([("gold ring",)], "query string")
    assert similar_queries(stored, "  ").count() == 0
    assert similar_queries(stored, "Gold x").count() == 1


def test_a_repeated_append_replaces_what_the_run_left(spark, tmp_path):
    at, other = datetime(2024, 1, 7, 10), datetime(2024, 1, 7, 11)

    def rows(run, *values):
        shape = "url string, field string, old_value string, new_value string"
        return spark.createDataFrame([("u", "f", None, v) for v in values], shape).withColumn("detected_at", moment(run))

    def append(run, *values):
        table = append_history(rows(run, *values), str(tmp_path), "deltas", "detected_at", run)
        return sorted(r.new_value for r in table.collect())

    append(at, "a", "b", "c")
    assert append(other, "x") == ["a", "b", "c", "x"]
    assert append(at, "a", "b", "d", "e") == ["a", "b", "d", "e", "x"]
    history = read_table(spark, f"{tmp_path}/deltas", "deltas")
    assert [r.new_value for r in before_run(history, at, "detected_at").collect()] == ["x"]


def test_fetches_of_a_query_are_not_mixed(spark):
    shape = "query string, fetched_at string"
    fetched = spark.createDataFrame([("q", "2024-01-01"), ("q", "2024-01-02"), ("r", None), ("s", "2024-01-01"), ("s", "2024-01-03")], shape)
    links = spark.createDataFrame([("q", "2024-01-01", "old"), ("q", "2024-01-02", "new"), ("r", None, "only"), ("s", "2024-01-01", "gone")], shape + ", url string")
    assert sorted(r.url for r in newest_fetch(fetched, links).collect()) == ["new", "only"]


def test_a_page_of_results_comes_in_order(spark):
    serp = spark.createDataFrame([("q", i, f"u{i}", None) for i in range(1, 41)], "query string, position int, url string, title string").repartition(7)
    classes = spark.createDataFrame([(f"u{i}", "gold", "14k") for i in range(1, 41, 3)], "url string, metal_type string, karat string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        page = list_serp_results(serp, classes, "q", 15, 5).collect()
        large = list_serp_results(serp, classes, "q", 20_000, 5).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [r.position for r in page] == list(range(6, 21))
    assert [r.position for r in large] == list(range(6, 41))


def test_selected_pages_are_found_where_they_lie(spark):
    corpus = spark.range(4000).selectExpr("concat('u', id) AS url", "IF(id % 10 = 9, '', 'x') AS html")
    selected = spark.range(0, 4000, 100).selectExpr("concat('u', id) AS url")
    found = _pages_of(selected, corpus)
    assert found.columns == ["url", "html"]
    assert found.join(selected, "url", "left_semi").count() == 40
    assert found.count() < 100
    assert _pages_of(selected.limit(0), corpus).count() == 0


class Killed(Exception):
    pass


def contents(tables):
    return {name: sorted(str(r.asDict()) for r in df.collect()) for name, df in tables.items()}


@pytest.fixture
def small_batch(spark, tmp_path):
    """A run over two searches and two pages, by root folder, day and searches."""
    keywords = tmp_path / "keywords.json"
    keywords.write_text(json.dumps([{"product_handle": "ring", "product_title": "Ring", "our_url": "https://www.ours.com/ring", "queries": ["gold ring", "band"]}]))
    products, _ = read_keywords(spark, str(keywords))
    sold = [("https://a.com/1", product_page(100, "14k solid gold ring")), ("https://b.com/2", product_page(50, "gold plated brass band"))]

    def run(root, day, serp):
        corpora = Corpora(serp=pages(spark, "query", serp), products=pages(spark, "url", sold))
        appended = str(tmp_path / root / "appended")
        at = datetime(2024, 1, day)
        return run_batch(spark, products, corpora, published_folders(spark, appended, at), str(tmp_path / root / f"v{day}"), appended, at)

    return run


def test_a_run_that_breaks_off_leaves_what_was_published(spark, small_batch, tmp_path, monkeypatch):
    searches = [("gold ring", search_page("https://a.com/1", "https://b.com/2"))], [("gold ring", search_page("https://b.com/2", "https://c.com/3")), ("band", search_page("https://a.com/1"))]
    small_batch("clean", 1, searches[0])
    clean = contents(small_batch("clean", 2, searches[1]).tables)
    small_batch("broken", 1, searches[0])
    appended = str(tmp_path / "broken" / "appended")
    before, folders = contents(load_tables(spark, appended)), published_folders(spark, appended)
    for last in (1, 3, 8):
        written = []
        with monkeypatch.context() as patch:
            for name in ("write_keyed", "append_attempt", "publish"):
                own = getattr(batch, name)

                def stopped(*given, own=own):
                    if len(written) == last:
                        raise Killed
                    written.append(1)
                    return own(*given)

                patch.setattr(batch, name, stopped)
            with pytest.raises(Killed):
                small_batch("broken", 2, searches[1])
        assert len(written) == last
        assert contents(load_tables(spark, appended)) == before
        assert published_folders(spark, appended) == folders
    again = small_batch("broken", 2, searches[1])
    assert contents(again.tables) == clean
    assert contents(load_tables(spark, appended)) == {name: clean[name] if name in attempts(spark, appended) else [] for name in clean}


def test_a_repeat_without_rows_leaves_none(spark, small_batch, tmp_path):
    small_batch("empty", 1, [("gold ring", search_page("https://a.com/1"))])
    appended = str(tmp_path / "empty" / "appended")
    assert load_tables(spark, appended)["serp_snapshot_results"].count() == 1
    small_batch("empty", 1, [("gold ring", "<p>nothing</p>")])
    rows = {r.name: r.n_rows for r in manifests(spark, appended).where("number = 2 AND folder IS NULL").collect()}
    assert rows["serp_snapshot_results"] == 0
    assert published_folders(spark, appended, datetime(2024, 1, 1)) == {}
    assert load_tables(spark, appended)["serp_snapshot_results"].count() == 0


def test_a_repeated_append_without_rows_takes_the_earlier_ones_away(spark, tmp_path):
    at, other = datetime(2024, 1, 7, 10), datetime(2024, 1, 7, 11)
    shape = "url string, field string, old_value string, new_value string, detected_at timestamp"

    def append(run, *values):
        rows = spark.createDataFrame([("u", "f", None, v, at) for v in values], shape)
        return sorted(r.new_value for r in append_history(rows, str(tmp_path), "deltas", "detected_at", run).collect())

    assert append(at) == []
    assert append(at, "a", "b") == ["a", "b"]
    assert append(other, "x") == ["a", "b", "x"]
    assert append(at) == ["x"]
    assert append(None, "y") == ["x", "y"] and append(None, "y") == ["x", "y", "y"]
    assert sorted(r.new_value for r in load_tables(spark, str(tmp_path))["deltas"].collect()) == ["x", "y", "y"]
