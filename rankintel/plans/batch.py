"""One analytics run: page corpora in, a new version of the tables and the appended histories out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankintel.operators.classify import Classifier, classification_row, label_pages, unread_pages
from rankintel.operators.deltas import detect_deltas, snapshot_change_flags
from rankintel.operators.digest import digest_rows
from rankintel.operators.listing import classification_text, listing_metadata, listing_row
from rankintel.operators.lookup import only_keywords
from rankintel.operators.marketplace import MARKETPLACE_DOMAIN, marketplace_results
from rankintel.operators.page_text import (
    BODY_CHARS,
    LISTING_PAGE_CHARS,
    PRODUCT_PAGE_CHARS,
    TEXT_CHARS,
    html_to_text,
)
from rankintel.operators.ranked_links import ranked_links
from rankintel.operators.registry import (
    competitor_product_registry,
    competitor_registry,
    query_product_map,
    seed_products,
)
from rankintel.operators.runs import dropouts, entrants, latest_pair, position_shifts, price_moves, top_n_domains
from rankintel.operators.selection import select_unclassified, select_uncrawled, select_unscraped_listings
from rankintel.operators.snapshots import build_snapshot_results, build_snapshots, snapshot_key
from rankintel.operators.stats import run_summary
from rankintel.operators.upsert import last_per_key, touch_last_scraped, upsert_replace, upsert_replace_multi
from rankintel.schemas import APPENDED_TABLES, KEYED_TABLES
from rankintel.sources.keywords import distinct_queries
from rankintel.sources.pages import fetched, stored_pages
from rankintel.sources.tables import before_run, folder_of, moment, read_table, write_keyed, write_staged
from rankintel.sources.versions import append_attempt, attempts, new_attempt, publish, read_grown, run_name


@dataclass
class Corpora:
    """Page corpora of a run; a missing one skips the steps that need it.

    serp and shop hold query, html, fetched_at; products and listings hold url, html, fetched_at.
    """

    serp: DataFrame | None = None
    products: DataFrame | None = None
    shop: DataFrame | None = None
    listings: DataFrame | None = None


@dataclass
class RunOptions:
    """What a run does. The limits bound its work selections; None means everything.

    body_chars and text_chars cut what a classifier is given; the rules, used without one, read whole texts.
    """

    our_domains: Sequence[str] = ()
    classifier: Classifier | None = None
    body_chars: int | None = BODY_CHARS
    text_chars: int | None = TEXT_CHARS
    skip_serp: bool = False
    skip_pages: bool = True
    skip_classify: bool = False
    skip_delta: bool = False
    pages_limit: int | None = None
    classify_limit: int | None = None
    listings_limit: int | None = None
    shop_domain: str = MARKETPLACE_DOMAIN


@dataclass
class RunResult:
    """All tables after a run, the folder each keyed table now lives in, and the one-row summary."""

    tables: dict[str, DataFrame]
    folders: dict[str, str]
    summary: DataFrame


# Bitmaps that tell selected urls, whatever their number; Spark's bitmaps hold BITMAP_BITS bits in 4 KB each.
BITMAPS, BITMAP_BITS = 1024, 32_768


def _pages_of(selected: DataFrame, corpus: DataFrame) -> DataFrame:
    """Fetched pages whose url may be a selected one, found where the html lies.

    The hashes of the selected urls are folded into bitmaps that hold at most 4 MB together, so broadcasting them is
    safe for any selection. Every selected page passes, and so does another one whose hash meets a set bit: join the
    extracted rows with the selected urls.
    """
    hash_ = F.xxhash64("url")
    bucket, bit = F.pmod(hash_, F.lit(BITMAPS)).alias("_bucket"), F.pmod(F.shiftright(hash_, 32), F.lit(BITMAP_BITS)).alias("_bit")
    bitmaps = selected.select(bucket, bit).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substr("_bits", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = fetched(corpus).select("*", bucket, bit).join(F.broadcast(bitmaps), "_bucket")
    return marked.where(F.getbit(byte, F.pmod("_bit", F.lit(8)).cast("int")) == 1).drop("_bucket", "_bit", "_bits")


def _onto(selected: DataFrame, reduced: DataFrame) -> DataFrame:
    """Selected urls with the newest fetch of each, joined only after the html has been reduced to facts."""
    newest = last_per_key(reduced, ["url"], ["fetched_at"]).drop("fetched_at")
    return selected.select("url").join(newest, "url", "left")


def newest_fetch(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows that come from the newest fetch of their query.

    A query's pages may have been fetched several times, and results of different fetches are never mixed. The newest
    stamp comes from a scan of two columns and meets the narrow rows; html is not joined. A query without any stamp
    keeps its rows.
    """
    newest = pages.groupBy("query").agg(F.max("fetched_at").alias("_newest"))
    return rows.join(newest, "query").where(F.col("fetched_at").eqNullSafe(F.col("_newest"))).drop("_newest")


def _labelled(selected: DataFrame, pages: DataFrame, min_chars: int, blank_reason: str, options: RunOptions) -> DataFrame:
    """Selected urls with the labels of the newest page of each; one without a fetched page gets the fallback labels.

    Rules label pages where they lie, so that whole texts pass no shuffle. A classifier of the user's own costs more
    than a shuffle of its cut texts, and is asked about the newest pages only.
    """
    if options.classifier is not None:
        return label_pages(_onto(selected, pages), min_chars, blank_reason, options.classifier)
    labels = label_pages(pages, min_chars, blank_reason).withColumn("_read", F.lit(True))
    return unread_pages(_onto(selected, labels), "_read", F.lit("empty page (0 chars)"))


def product_labels(selected: DataFrame, corpus: DataFrame, options: RunOptions) -> DataFrame:
    """Labels of the selected urls; one without a fetched page gets the fallback labels."""
    pages = _pages_of(selected, corpus).withColumn("html_chars", F.length("html"))
    whole = {"max_chars": None, "body_chars": None, "leaf_limit": None, "broken_chars": None}
    widths = whole if options.classifier is None else {"max_chars": options.text_chars, "body_chars": options.body_chars}
    texts = html_to_text(pages, **widths).select("url", "fetched_at", "html_chars", "page_text")
    return _labelled(selected, texts, PRODUCT_PAGE_CHARS, "could not extract text from HTML", options)


def listing_rows(selected: DataFrame, corpus: DataFrame, options: RunOptions, scraped_at: Column) -> DataFrame:
    """Listing table rows of the selected urls; a page too thin to read leaves its facts empty."""
    facts = ("title", "price_usd", "shop", "materials", "tags", "reviews", "favorites")
    pages = _pages_of(selected, corpus).withColumn("html_chars", F.length("html"))
    if options.classifier is None:
        read = classification_text(listing_metadata(pages, description_chars=None), max_chars=None)
    else:
        read = classification_text(listing_metadata(pages), max_chars=options.text_chars)
    readable = F.col("html_chars") >= LISTING_PAGE_CHARS
    packed = read.select("url", "fetched_at", "html_chars", "page_text", F.when(readable, F.struct(*facts)).alias("_page"))
    labels = _labelled(selected, packed, LISTING_PAGE_CHARS, "could not extract text", options)
    rows = labels.select(
        "url", "_page.*", F.col("price_usd").alias("label_price"), "metal_type", "karat", "confidence"
    )
    return listing_row(rows, scraped_at)


def product_snapshot_rows(labels: DataFrame, registry: DataFrame, stored: DataFrame, scraped_at: Column) -> DataFrame:
    """Snapshots of the labelled registered products, flagged against the newest stored one of each."""
    taken = ("title", "price_raw", "price_usd", "description", "metal_type", "karat", "materials", "availability")
    fresh = labels.join(registry.select("url"), "url", "left_semi").select("url", scraped_at.alias("scraped_at"), *taken)
    known = stored.join(fresh.select("url"), "url", "left_semi").where(F.col("scraped_at") < scraped_at)
    before = last_per_key(known, ["url"], ["scraped_at"]).select("url", "scraped_at", *taken)
    return snapshot_change_flags(before.unionByName(fresh)).where(F.col("scraped_at") == scraped_at)


def latest_digest(tables: dict[str, DataFrame]) -> DataFrame | None:
    """Digest of the two newest runs, or None while there is only one."""
    heads, rows = tables["serp_snapshots"], tables["serp_snapshot_results"]
    current, previous = latest_pair(heads)
    if previous is None:
        return None
    now, then = (top_n_domains(heads, rows.where(F.col("run_date") == run), [run]) for run in (current, previous))
    return digest_rows(
        entrants(now, then),
        dropouts(now, then),
        price_moves(tables["competitor_products"], tables["product_snapshots"], current, previous),
        position_shifts(heads, current, previous),
    )


def run_batch(
    spark: SparkSession,
    keyword_products: DataFrame,
    corpora: Corpora,
    folders: dict[str, str] | None,
    tables_out: str,
    appended: str,
    run_at: datetime,
    options: RunOptions | None = None,
    shop_products: DataFrame | None = None,
) -> RunResult:
    """Run every step in order.

    folders is what the previous run returned (None for the first); the keyed tables this run changes are
    written below tables_out, the others stay where they are. appended is the root of the growing tables.
    Both lie on shared storage. keyword_products and shop_products are the first result of `read_keywords`.

    Each table is written once and read back before a later step uses it, so no step repeats another's work.
    A call writes into places of its own and publishes them with its last write (see `versions`): one that breaks off
    changes nothing that readers see, and a repeated one replaces all that the run had published, also by no rows.
    `published_folders` tells the folders to start the next run from. tables_out must not be the root of a folder in
    `folders`.
    """
    opt = options or RunOptions()
    now = moment(run_at)
    places = dict(folders or {})
    clash = sorted(name for name, place in places.items() if place.rstrip("/") == folder_of(tables_out, name))
    if clash:
        raise ValueError(f"tables_out holds the tables that are read: {', '.join(clash)}")
    tables = {name: read_table(spark, places.get(name), name) for name in KEYED_TABLES}
    attempt, counted = new_attempt(run_at), attempts(spark, appended)
    out, grown = folder_of(tables_out, attempt), []
    tables |= {name: read_grown(spark, appended, name, counted.get(name, {})) for name in APPENDED_TABLES}

    def keep(name: str, df: DataFrame) -> None:
        tables[name] = write_keyed(df, out, name)
        places[name] = folder_of(out, name)

    def append(name: str, df: DataFrame, stamp: str = "scraped_at") -> None:
        append_attempt(df, appended, name, attempt, stamp)
        grown.append(name)
        tables[name] = read_grown(spark, appended, name, counted.get(name, {}) | {run_name(run_at): attempt})

    def of_run(df: DataFrame) -> DataFrame:
        dated = df.where(F.col("run_date") == F.to_date(now)) if "run_date" in df.columns else df
        return dated.where(F.col("scraped_at") == now)

    keep("our_products", seed_products(tables["our_products"], keyword_products, now))

    # Ranked results, snapshots, registries.
    registry = tables["competitor_products"]
    if corpora.serp is not None and not opt.skip_serp:
        wanted = only_keywords(corpora.serp, distinct_queries(keyword_products).select("query"))
        links = last_per_key(newest_fetch(wanted, ranked_links(wanted)), ["query", "position"], ["fetched_at", "url"])
        # The write of the table reads its batch twice, so pages are parsed before.
        found = write_staged(links.drop("fetched_at").withColumn("scraped_at", now), out, "run_results")
        keep("serp_results", upsert_replace(tables["serp_results"], found, ["query", "position"], ["scraped_at"]))
        fresh = of_run(tables["serp_results"])
        heads = build_snapshots(fresh, query_product_map(tables["our_products"]))
        append(
            "serp_snapshots", heads.withColumns({"snapshot_id": snapshot_key(F.col("query"), now), "scraped_at": now})
        )
        append("serp_snapshot_results", build_snapshot_results(fresh, opt.our_domains).withColumn("scraped_at", now))
        sighted = of_run(tables["serp_snapshot_results"])
        keep("competitors", competitor_registry(sighted, existing=tables["competitors"]))
        registry = competitor_product_registry(sighted, existing=registry)

    # Stored pages.
    if corpora.products is not None and not opt.skip_pages:
        crawled = before_run(tables["product_pages"], run_at)
        missing = select_uncrawled(tables["serp_results"], crawled, opt.pages_limit)
        arrived = _pages_of(missing, corpora.products).join(missing, "url", "left_semi")
        append("product_pages", stored_pages(arrived, now))

    # Labels, product snapshots, change log.
    if corpora.products is not None and not opt.skip_classify:
        todo = select_unclassified(
            tables["serp_results"], tables["classifications"], opt.our_domains, opt.classify_limit
        )
        labels = write_staged(product_labels(todo, corpora.products, opt), out, "run_labels")
        labelled = upsert_replace(tables["classifications"], classification_row(labels, now), ["url"], ["classified_at"])
        keep("classifications", labelled)
        append("product_snapshots", product_snapshot_rows(labels, registry, tables["product_snapshots"], now))
        registry = touch_last_scraped(registry, of_run(tables["product_snapshots"]))
    if registry is not tables["competitor_products"]:
        keep("competitor_products", registry)
    if not opt.skip_delta:
        logged = before_run(tables["deltas"], run_at, "detected_at")
        append("deltas", detect_deltas(tables["classifications"], logged, now), "detected_at")

    # Marketplace results and listings.
    if corpora.shop is not None:
        wanted = corpora.shop
        if shop_products is not None:
            wanted = only_keywords(wanted, distinct_queries(shop_products).select("query"))
        ranked = marketplace_results(wanted, domain=opt.shop_domain)
        ranked = newest_fetch(wanted, ranked)
        last = last_per_key(ranked, ["query", "position"], ["fetched_at", "seq", "url"]).drop("fetched_at", "seq")
        found = write_staged(last.withColumn("scraped_at", now), out, "run_shop_results")
        keep("shop_serp_results", upsert_replace(tables["shop_serp_results"], found, ["query", "position"], ["scraped_at"]))
    if corpora.listings is not None:
        todo = select_unscraped_listings(tables["shop_serp_results"], tables["shop_listings"], opt.listings_limit)
        rows = write_staged(listing_rows(todo, corpora.listings, opt, now), out, "run_listings")
        listings = upsert_replace_multi(tables["shop_listings"], rows, [["url"], ["listing_id"]], ["scraped_at", "url"])
        keep("shop_listings", listings)

    rows = {name: read_grown(spark, appended, name, {run_name(run_at): attempt}).count() for name in grown}
    publish(spark, appended, run_at, attempt, places, rows)
    counted_tables = ("serp_results", "serp_snapshots", "competitors", "product_pages", "product_snapshots", "classifications")
    return RunResult(tables, places, run_summary(*[tables[name] for name in counted_tables]))
