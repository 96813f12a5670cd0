"""Every operator as a query over the test tables: name → function of (spark, directory)."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from datetime import datetime
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankintel.functions.text import squeeze
from rankintel.functions.urls import domain_of
from rankintel.operators import classify, deltas, history, intel, listing, registry, results, runs, selection, snapshots, stats, upsert
from rankintel.operators.digest import digest_rows
from rankintel.operators.marketplace import fix_zero_positions, marketplace_results
from rankintel.operators.page_text import html_to_text, jsonld_leaves, page_guard
from rankintel.operators.ranked_links import ranked_links
from rankintel.operators.similar import similar_to_each
from rankintel.plans.batch import Corpora, RunOptions, RunResult, run_batch
from rankintel.plans.bindings import LINK_SITE, Bound, bound
from rankintel.sources.keywords import distinct_queries, read_keywords
from rankintel.sources.pages import stored_pages
from rankintel.sources.tables import append_history, load_tables, write_keyed, write_staged

# Parameters shared with the comparison SQL.
CUT = "1998-01-01"
EVENT_CUT = "2024-01-16"
OUR_SITES = ("www.brand-3.example.com", "brand-7.example.com")
TEXT_RULES = (("address", r"(?i)\bemail\b|@"), ("licence", r"(?i)licen[cs]e|copyright"), ("wordy", r"(?i)\bthe\b"))

Query = Callable[[Bound], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({name: F.col(name).cast("string") for name, kind in df.dtypes if kind == "date"})


def _early(df: DataFrame, column: str, cut: str) -> tuple[DataFrame, DataFrame]:
    """A table as two consecutive batches."""
    stamp = F.lit(cut).cast("timestamp_ntz")
    return df.where(F.col(column) < stamp), df.where(F.col(column) >= stamp)


# Keyed writes.


@query
def upsert_replace(b: Bound) -> DataFrame:
    first, second = _early(b.result_rows, "scraped_at", CUT)
    keys = ["query", "position"]
    table = upsert.upsert_replace(upsert.upsert_replace(None, first, keys, b.arrival), second, keys, b.arrival)
    return table.select("query", "position", "url", "scraped_at", "l_suppkey")


@query
def upsert_replace_multi(b: Bound) -> DataFrame:
    rows = b.prod_snaps.select(
        F.col("product_id").alias("url"),
        F.when(F.col("metal_type") != "error", F.floor(F.col("price_usd") * 10).cast("bigint")).alias("listing_id"),
        "scraped_at", "id", "price_usd",
    )
    first, second = _early(rows, "scraped_at", EVENT_CUT)
    keys, order = [["url"], ["listing_id"]], ["scraped_at", "id"]
    return upsert.upsert_replace_multi(upsert.upsert_replace_multi(None, first, keys, order), second, keys, order)


@query
def upsert_update(b: Bound) -> DataFrame:
    rows = b.table("orders").select(
        F.col("o_custkey").alias("handle"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("ordinal"),
        F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("views"),
    )
    first, second = _early(rows, "updated_at", CUT)
    seeded = upsert.upsert_update(None, first, ["handle"], ["title", "updated_at"], ["updated_at", "ordinal"])
    return upsert.upsert_update(seeded, second, ["handle"], ["title", "updated_at"], ["updated_at", "ordinal"])


@query
def insert_ignore(b: Bound) -> DataFrame:
    rows = b.result_rows.select("url", "l_suppkey", "scraped_at", "l_orderkey", "l_extendedprice")
    first, second = _early(rows, "scraped_at", CUT)
    keys, order = ["url", "l_suppkey"], ["scraped_at", "l_orderkey", "l_extendedprice"]
    return upsert.insert_ignore(upsert.insert_ignore(None, first, keys, order), second, keys, order)


@query
def touch_last_scraped(b: Bound) -> DataFrame:
    return upsert.touch_last_scraped(b.comp_products, b.prod_snaps, "product_id")


# Extraction.


@query
def read_pages(b: Bound) -> DataFrame:
    pages = stored_pages(b.html_pages, F.lit("2024-01-01").cast("timestamp_ntz"))
    return pages.select("url", "page_title", F.md5("raw_html").alias("html_md5"), "scraped_at")


@query
def ranked_links_(b: Bound) -> DataFrame:
    return ranked_links(b.search_pages)


@query
def marketplace_results_(b: Bound) -> DataFrame:
    return marketplace_results(b.shop_pages).drop("shop", "reviews")


@query
def fix_zero_positions_(b: Bound) -> DataFrame:
    zero_based = b.serp.select("query", "url", (F.col("position") - 1).alias("position"), F.col("position").alias("seq"))
    return fix_zero_positions(zero_based)


@query
def html_to_text_(b: Bound) -> DataFrame:
    return html_to_text(b.html_pages).select("page_id", "page_text")


@query
def jsonld_leaves_(b: Bound) -> DataFrame:
    return jsonld_leaves(b.article_pages)


@query
def listing_metadata(b: Bound) -> DataFrame:
    return _flat_lists(listing.listing_metadata(b.listing_pages))


@query
def classification_text(b: Bound) -> DataFrame:
    return listing.classification_text(listing.listing_metadata(b.listing_pages)).select("url", "page_text")


@query
def listing_row(b: Bound) -> DataFrame:
    facts = listing.listing_metadata(b.listing_pages)
    labelled = facts.withColumns({"label_price": F.lit(9.5), "metal_type": F.lit(None).cast("string"), "karat": F.lit("14k"), "confidence": F.lit("")})
    return _flat_lists(listing.listing_row(labelled, F.lit("2024-01-01").cast("timestamp_ntz")))


def _flat_lists(df: DataFrame) -> DataFrame:
    return df.withColumns({"materials": F.array_join("materials", ","), "tags": F.array_join("tags", ",")})


@query
def parse_model_json(b: Bound) -> DataFrame:
    return classify.parse_model_json(b.model_answers)


@query
def page_guard_(b: Bound) -> DataFrame:
    return page_guard(b.html_pages, min_chars=2000, html="html").select("page_id", "fallback_reason")


@query
def rule_labels(b: Bound) -> DataFrame:
    return classify.rule_labels(b.docs, "text", TEXT_RULES).select("doc_id", "label")


@query
def classify_products(b: Bound) -> DataFrame:
    """The default rules, with the rules of the shop's own vocabulary in front of a plain text."""
    docs = b.docs.select("doc_id", squeeze(F.col("text")).alias("page_text"))
    return classify.classify_products(docs, metal_rules=TEXT_RULES).select("doc_id", "metal_type", "karat", "base_metal", "confidence")


def _by_length(texts: pd.Series) -> pd.DataFrame:
    long = texts.str.len() > 1000
    return pd.DataFrame({"metal_type": long.map({True: "vermeil", False: "unknown"}), "price_usd": texts.str.len() / 4})


@query
def classify_products_custom(b: Bound) -> DataFrame:
    docs = b.docs.select("doc_id", "text")
    return classify.classify_products(docs, "text", _by_length).select("doc_id", "metal_type", "karat", "price_usd", "confidence")


# Registries, snapshots, selection.


@query
def url_domain(b: Bound) -> DataFrame:
    return registry.with_domain(b.table("pages").select("page_id", "url"))


@query
def keyword_queries(b: Bound) -> DataFrame:
    return distinct_queries(_our_products(b).withColumn("ordinal", F.col("handle")))


def _our_products(b: Bound) -> DataFrame:
    """Customers as products: each is tracked by queries it shares with others."""
    return b.table("customer").select(
        F.col("c_custkey").alias("handle"),
        F.concat(F.lit("https://brand-"), (F.col("c_nationkey") + 1).cast("string"), F.lit(".example.com/")).alias("our_url"),
        F.array("c_mktsegment", F.concat("c_mktsegment", F.lit(" "), F.col("c_nationkey").cast("string")), "c_name").alias("queries"),
        F.col("c_custkey").alias("ordinal"),
    )


@query
def query_product_map(b: Bound) -> DataFrame:
    return registry.query_product_map(_our_products(b))


def _query_map(b: Bound) -> DataFrame:
    return _our_products(b).select(F.col("handle").alias("query"), F.col("handle").alias("our_handle"), "our_url")


@query
def competitor_registry(b: Bound) -> DataFrame:
    return registry.competitor_registry(b.sightings).drop("name")


@query
def competitor_product_registry(b: Bound) -> DataFrame:
    return registry.competitor_product_registry(b.sightings).drop("last_scraped_at")


@query
def build_snapshots(b: Bound) -> DataFrame:
    return snapshots.build_snapshots(b.web, _query_map(b))


@query
def build_snapshots_per_run(b: Bound) -> DataFrame:
    return _dates_as_text(snapshots.build_snapshots(b.web.withColumn("run_date", F.to_date("scraped_at")), _query_map(b), ["run_date"]))


@query
def build_snapshot_results(b: Bound) -> DataFrame:
    return snapshots.build_snapshot_results(b.web, OUR_SITES, F.col("l_orderkey"))


@query
def select_uncrawled(b: Bound) -> DataFrame:
    return selection.select_uncrawled(b.serp, b.pages)


def _labelled_urls(b: Bound) -> DataFrame:
    return b.web.join(b.classes.select("karat", F.col("url").alias("_key")), F.substring_index("url", "/", -1).cast("bigint") == F.col("_key")).select("url").distinct()


@query
def select_unclassified(b: Bound) -> DataFrame:
    return selection.select_unclassified(b.web, _labelled_urls(b), ["BRAND-3.example.com"], limit=None)


@query
def select_unclassified_newest(b: Bound) -> DataFrame:
    return selection.select_unclassified(b.web, _labelled_urls(b), ["BRAND-3.example.com"], limit=50)


@query
def select_unscraped_listings(b: Bound) -> DataFrame:
    return selection.select_unscraped_listings(b.shop_serp, b.listings)


# Changes.

_SNAP_FIELDS = ("metal_type", "description", "price_usd")


def _change_log(b: Bound) -> DataFrame:
    log = deltas.delta_log(b.prod_snaps, _SNAP_FIELDS, "product_id", ("scraped_at", "id"))
    return log.withColumnRenamed("product_id", "url")


@query
def delta_log(b: Bound) -> DataFrame:
    return _change_log(b)


@query
def detect_deltas(b: Bound) -> DataFrame:
    log = _change_log(b).withColumn("field", F.when(F.col("field") == "description", "karat").otherwise(F.col("field")))
    now = F.lit("2024-03-01").cast("timestamp_ntz")
    return deltas.detect_deltas(b.classes, log, now)


@query
def snapshot_change_flags(b: Bound) -> DataFrame:
    flagged = deltas.snapshot_change_flags(b.prod_snaps, b.comp_products, "product_id", ("scraped_at", "id"))
    return flagged.select("id", "product_id", "price_changed", "description_changed", "description")


@query
def recent_runs(b: Bound) -> DataFrame:
    return _dates_as_text(runs.recent_runs(b.snaps))


def _tops(b: Bound) -> tuple[DataFrame, DataFrame]:
    current, previous = runs.latest_pair(b.snaps)
    return tuple(runs.top_n_domains(b.snaps, b.snap_res, [run], query="query_grp") for run in (current, previous))


@query
def top_n_domains(b: Bound) -> DataFrame:
    return _dates_as_text(runs.top_n_domains(b.snaps, b.snap_res, query="query_grp"))


@query
def entrants(b: Bound) -> DataFrame:
    return runs.entrants(*_tops(b))


@query
def dropouts(b: Bound) -> DataFrame:
    return runs.dropouts(*_tops(b))


@query
def our_positions(b: Bound) -> DataFrame:
    return _dates_as_text(runs.our_positions(b.snaps, query="query_grp"))


@query
def position_shifts(b: Bound) -> DataFrame:
    return runs.position_shifts(b.snaps, *runs.latest_pair(b.snaps), query="query_grp")


def _price_days(b: Bound) -> tuple:
    return (b.comp_products, b.prod_snaps, *runs.latest_pair(b.prod_snaps))


@query
def price_moves(b: Bound) -> DataFrame:
    return runs.price_move_pairs(*_price_days(b), key="product_id")


@query
def price_move_ranges(b: Bound) -> DataFrame:
    return runs.price_move_ranges(*_price_days(b), key="product_id")


@query
def price_moves_latest(b: Bound) -> DataFrame:
    return runs.price_moves(*_price_days(b), key="product_id", order=("scraped_at", "id"))


@query
def run_diffs(b: Bound) -> DataFrame:
    return _dates_as_text(runs.run_diffs(b.snaps, b.snap_res, query="query_grp"))


@query
def digest(b: Bound) -> DataFrame:
    now, then = _tops(b)
    shifts = runs.position_shifts(b.snaps, *runs.latest_pair(b.snaps), query="query_grp")
    days = _price_days(b)
    ranges = runs.price_move_ranges(*days, key="product_id")
    largest = runs.largest_price_moves(*days, ranges, key="product_id")
    return digest_rows(runs.entrants(now, then), runs.dropouts(now, then), largest, shifts, all_moves=ranges)


# Reports.


@query
def db_stats(b: Bound) -> DataFrame:
    return stats.db_stats(b.serp, b.pages, b.classes)


@query
def label_histogram(b: Bound) -> DataFrame:
    return stats.label_histogram(b.classes)


@query
def covered_queries(b: Bound) -> DataFrame:
    return stats.covered_queries(b.serp)


@query
def competitor_intel(b: Bound) -> DataFrame:
    return intel.competitor_intel(b.serp, b.pages, b.classes, limit=None)


@query
def competitor_intel_top(b: Bound) -> DataFrame:
    return intel.competitor_intel(b.serp, b.pages, b.classes)


@query
def competitor_intel_per_query(b: Bound) -> DataFrame:
    return intel.competitor_intel(b.serp, b.pages, b.classes, limit=3, per_query=True)


@query
def keyword_coverage(b: Bound) -> DataFrame:
    keywords = b.table("customer").select(F.col("c_custkey").alias("ordinal"), F.col("c_custkey").alias("keyword"))
    return intel.keyword_coverage(keywords, intel.competitor_intel(b.serp, b.pages, b.classes, keywords.select("keyword"), None))


def _all_intel(b: Bound) -> DataFrame:
    return intel.competitor_intel(b.serp, b.pages, b.classes, limit=None)


@query
def metal_summary(b: Bound) -> DataFrame:
    return intel.metal_summary(_all_intel(b))


@query
def insight(b: Bound) -> DataFrame:
    return intel.insight(intel.metal_summary(_all_intel(b)))


@query
def metal_breakdown(b: Bound) -> DataFrame:
    return intel.metal_breakdown(b.serp, b.classes, limit=None)


@query
def metal_breakdown_by_query(b: Bound) -> DataFrame:
    return intel.metal_breakdown_by_query(b.serp, b.classes, limit=5, per_query=True)


@query
def metal_breakdown_by_query_all(b: Bound) -> DataFrame:
    return intel.metal_breakdown_by_query(b.serp, b.classes, limit=None)


@query
def breakdown_summary(b: Bound) -> DataFrame:
    return intel.breakdown_summary(intel.metal_breakdown(b.serp, b.classes, limit=None))


@query
def keyword_context(b: Bound) -> DataFrame:
    return intel.keyword_context(b.serp, b.pages, b.classes, limit=None)


@query
def keyword_context_top(b: Bound) -> DataFrame:
    return intel.keyword_context(b.serp, b.pages, b.classes)


@query
def list_serp_results(b: Bound) -> DataFrame:
    return results.list_serp_results(b.serp, b.classes, limit=3, offset=2)


@query
def list_serp_results_all(b: Bound) -> DataFrame:
    return results.list_serp_results(b.serp, b.classes, limit=None)


def _asked(b: Bound) -> DataFrame:
    """Each customer's key, as results store it, and the key with more words, which no result has as its query."""
    key = F.col("c_custkey").cast("string")
    return b.table("customer").select(F.explode(F.array(key, F.concat(key, F.lit(" "), F.col("c_mktsegment")))).alias("asked"))


def _text_query(df: DataFrame) -> DataFrame:
    return df.withColumn("query", F.col("query").cast("string"))


def _flat_similar(rows: DataFrame) -> DataFrame:
    return rows.withColumn("similar_queries", F.array_join("similar_queries", "|"))


@query
def list_serp_results_asked(b: Bound) -> DataFrame:
    return _flat_similar(results.list_serp_results(_text_query(b.serp), b.classes, _asked(b), limit=3, offset=2))


@query
def list_marketplace_results_asked(b: Bound) -> DataFrame:
    shop = b.stored_shop_serp(work_folder(b.spark))
    return _flat_similar(results.list_marketplace_results(_text_query(shop), b.listings, _asked(b), limit=5))


@query
def serp_history_asked(b: Bound) -> DataFrame:
    return _flat_similar(_flat_history(history.serp_history(_text_query(b.snaps), b.snap_res, _asked(b))))


@query
def similar_queries_each(b: Bound) -> DataFrame:
    stored = _our_products(b).select(F.explode("queries").alias("query"))
    words = b.table("customer").select(F.lower("c_mktsegment").alias("asked")).union(b.table("part").select("p_name"))
    return similar_to_each(_asked(b).union(words), stored)


@query
def similar_queries(b: Bound) -> DataFrame:
    return results.similar_queries(b.table("part"), "Small ring", column="p_name")


@query
def product_classification(b: Bound) -> DataFrame:
    return results.product_classification(b.serp, b.pages, b.classes)


@query
def delta_changes(b: Bound) -> DataFrame:
    return history.delta_changes(_change_log(b), b.pages)


@query
def delta_changes_all(b: Bound) -> DataFrame:
    return history.delta_changes(_change_log(b), b.pages, limit=None)


@query
def list_marketplace_results(b: Bound) -> DataFrame:
    return results.list_marketplace_results(b.shop_serp, b.listings, limit=5)


@query
def list_marketplace_results_all(b: Bound) -> DataFrame:
    return results.list_marketplace_results(b.shop_serp, b.listings, limit=None)


@query
def marketplace_intel(b: Bound) -> DataFrame:
    return _flat_lists(results.marketplace_intel(b.shop_serp, b.listings, limit=None))


@query
def marketplace_metal_summary(b: Bound) -> DataFrame:
    return results.marketplace_metal_summary(results.marketplace_intel(b.shop_serp, b.listings, limit=None))


def _flat_history(rows: DataFrame) -> DataFrame:
    listed = F.array_join(F.transform("top_domains", lambda d: F.concat(d["domain"], F.lit(":"), d["position"].cast("string"))), "|")
    return rows.withColumn("top_domains", listed).drop("our_url")


@query
def serp_history(b: Bound) -> DataFrame:
    return _flat_history(history.serp_history(b.snaps, b.snap_res))


@query
def serp_history_all(b: Bound) -> DataFrame:
    return _flat_history(history.serp_history(b.snaps, b.snap_res, limit=None))


@query
def position_trend(b: Bound) -> DataFrame:
    return history.position_trend(b.snaps)


@query
def position_trend_all(b: Bound) -> DataFrame:
    return history.position_trend(b.snaps, limit=None)


@query
def competitor_products(b: Bound) -> DataFrame:
    shown = history.competitor_products(
        b.comp_products, b.competitors, b.prod_snaps, limit=None, key="product_id", on="competitor_id", order=("scraped_at", "id")
    )
    return shown.select("url", "domain", "name", "price_usd", "metal_type", "karat", "description", "first_seen_at", "last_scraped_at", "snapshot_at")


def _changed_products(b: Bound, **limit) -> DataFrame:
    flagged = deltas.snapshot_change_flags(b.prod_snaps, None, "product_id", ("scraped_at", "id"))
    shown = history.competitor_products(
        b.comp_products, b.competitors, flagged, only_changed=True, key="product_id", on="competitor_id", order=("scraped_at", "id"), **limit
    )
    return shown.select("url", "domain", "price_usd", "price_changed", "description_changed", "snapshot_at")


@query
def competitor_products_changed(b: Bound) -> DataFrame:
    return _changed_products(b)


@query
def competitor_products_changed_all(b: Bound) -> DataFrame:
    return _changed_products(b, limit=None)


@query
def price_history(b: Bound) -> DataFrame:
    rows = history.price_history(b.prod_snaps, b.owned_products, key="product_id", order=("scraped_at", "id"))
    return rows.select("url", "domain", "scraped_at", "id", "price_usd", "metal_type", "karat", "description", "price_changed")


@query
def price_range(b: Bound) -> DataFrame:
    flagged = deltas.snapshot_change_flags(b.prod_snaps, None, "product_id", ("scraped_at", "id"))
    return history.price_range(flagged, b.owned_products, key="product_id", order=("scraped_at", "id"))


@query
def run_summary(b: Bound) -> DataFrame:
    return stats.run_summary(b.serp, b.snaps, b.competitors, b.pages, b.prod_snaps, b.classes)


# Files and tables that Spark writes and the sources read back.


def _keyword_files(b: Bound) -> str:
    """The customers as keyword files of at most 1,000 products each; some leave out the title or the views."""
    path = f"{work_folder(b.spark)}/keywords"
    key = F.col("handle")
    items = _our_products(b).select(
        F.floor(key / 1000).alias("file"),
        F.struct(
            key.cast("string").alias("product_handle"), F.when(key % 2 == 0, F.col("our_url")).alias("product_title"), "our_url",
            F.when(key % 3 == 0, key.cast("int")).alias("views_90d"), "queries",
        ).alias("item"),
    )
    items.groupBy("file").agg(F.to_json(F.collect_list("item")).alias("value")).write.partitionBy("file").text(path)
    return path


@query
def read_keywords_(b: Bound) -> DataFrame:
    products, _ = read_keywords(b.spark, _keyword_files(b))
    return products.withColumn("queries", F.array_join("queries", "|")).drop("ordinal")


@query
def append_history_(b: Bound) -> DataFrame:
    """Runs in turn: one repeated with other rows, one with rows, one repeated without any."""
    root, log = work_folder(b.spark), _change_log(b)
    log = log.withColumns({"url": F.col("url").cast("string"), "detected_at": F.col("detected_at").cast("timestamp")})
    log = write_staged(log, root, "log")
    cut = F.lit(EVENT_CUT).cast("timestamp")
    early, late = log.where(F.col("detected_at") < cut), log.where(F.col("detected_at") >= cut)
    grown = log
    for day, rows in ((1, late), (1, early), (2, late), (3, early), (3, early.where(F.lit(False)))):
        grown = append_history(rows, root, "deltas", "detected_at", datetime(2024, 2, day))
    return grown.drop("run_date").withColumn("detected_at", F.col("detected_at").cast("timestamp_ntz"))


@query
def load_tables_(b: Bound) -> DataFrame:
    """Every row of four tables as they are read back, and of the others, which are not there."""
    root, none = work_folder(b.spark), F.lit(None)
    write_keyed(b.serp.withColumn("snippet", none), root, "serp_results")
    write_keyed(b.classes, root, "classifications")
    stamped = _our_products(b).withColumns({"title": none, "views_90d": none, "created_at": none})
    write_keyed(stamped, root, "our_products")
    append_history(_change_log(b), root, "deltas", "detected_at", datetime(2024, 2, 1))
    shown = {
        "serp_results": (("query", "position"), "url"), "classifications": (("url",), "metal_type"),
        "our_products": (("handle",), "our_url"), "deltas": (("url", "field"), "new_value"),
    }
    found = [
        table.select(
            F.lit(name).alias("name"), F.concat_ws("|", *shown.get(name, ((table.columns[0],), ""))[0]).alias("key"),
            F.col(shown[name][1] if name in shown else table.columns[-1]).cast("string").alias("value"),
        )
        for name, table in load_tables(b.spark, root).items()
    ]
    return reduce(DataFrame.union, found)


# The whole run.


def work_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder; a temporary one only on a local session without one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return tempfile.mkdtemp(prefix="rankintel-")
    return f"{shared.rstrip('/')}/rankintel-{datetime.now():%Y%m%d%H%M%S%f}"


def _two_runs(b: Bound) -> RunResult:
    """Two runs over the documents: each is a product tracked by its own query, each of its lines a product page."""
    root = work_folder(b.spark)
    name = F.col("doc_id").cast("string")
    products = b.lines.select(
        name.alias("handle"), F.col("source").alias("title"), F.lit(LINK_SITE).alias("our_url"), F.lit(0).alias("views_90d"),
        F.array(name).alias("queries"), F.col("doc_id").alias("ordinal"),
    )
    lines = b.lines.select(F.explode(F.array_distinct("lines")).alias("line"), "lang")
    pages = lines.groupBy("line").agg(F.min("lang").alias("lang"))
    seen = F.lit("2024-01-01").cast("timestamp")
    corpora = Corpora(
        serp=b.search_pages.select(F.col("query").cast("string").alias("query"), "html", seen.alias("fetched_at")),
        products=pages.select(
            F.concat(F.lit(LINK_SITE), F.md5("line")).alias("url"), F.concat(F.lit("<title>"), "lang", F.lit("</title>"), "line").alias("html"), seen.alias("fetched_at")
        ),
    )
    options = RunOptions(classify_limit=None, our_domains=("ours.example",))
    done = None
    for turn in (1, 2):
        done = run_batch(
            b.spark, products, corpora, done.folders if done else None, f"{root}/v{turn}", f"{root}/appended",
            datetime(2024, 1, 7 * turn), options,
        )
    return done


@query
def run_batch_(b: Bound) -> DataFrame:
    return _two_runs(b).summary


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, root: build(bound(spark, root))

    return {name.rstrip("_"): bind(build) for name, build in QUERIES.items()}
