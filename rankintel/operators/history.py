"""Histories: change log, positions of a query over time, products and their prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankintel.functions.text import or_else
from rankintel.operators.lookup import attach, is_single, of_query, top_per_group
from rankintel.operators.similar import with_missing
from rankintel.operators.upsert import last_per_key

# Default limits and how far down competitor domains are listed.
CHANGES, SNAPSHOTS, PRODUCTS = 100, 20, 30
TOP_POSITION = 5


def delta_changes(
    deltas: DataFrame, pages: DataFrame, limit: int | None = CHANGES, order: Sequence[str] = ("detected_at", "url", "field")
) -> DataFrame:
    """Newest change rows with their page title; newest first if limited."""
    newest = deltas if limit is None else deltas.orderBy(*[F.desc(c) for c in order]).limit(limit)
    titled = attach(newest, [pages.select("url", "page_title")], bound=limit)
    ordered = titled if limit is None else titled.orderBy(*[F.desc(c) for c in order])
    return ordered.select(
        "url", F.coalesce("page_title", F.lit("")).alias("page_title"), "field", "old_value", "new_value", "detected_at"
    )


def _newest_snapshots(snapshots: DataFrame, query, limit: int | None, query_col: str) -> DataFrame:
    named = snapshots.withColumn("query", F.col(query_col)) if query_col != "query" else snapshots
    return top_per_group(of_query(named, query), ["query"], [F.desc("scraped_at"), F.desc("snapshot_id")], limit)


def serp_history(
    snapshots: DataFrame,
    results: DataFrame,
    query=None,
    limit: int | None = SNAPSHOTS,
    top: int = TOP_POSITION,
    query_col: str = "query",
) -> DataFrame:
    """Newest snapshots with our position, totals and the foreign domains among the first positions.

    top_domains holds at most `top` entries, positions being unique within a snapshot. Snapshots without
    any stay, with an empty list. Newest first if one query is asked for. `query` may be a DataFrame of queries: then
    those without any snapshot have a row each with `similar_queries`, which is null in all other rows.
    """
    newest = _newest_snapshots(snapshots, query, limit, query_col)
    near = results.where(~F.col("is_ours") & (F.col("position") <= top) & F.col("domain").isNotNull())
    if query is not None:
        near = near.join(newest.select("snapshot_id"), "snapshot_id", "left_semi")
    domains = near.groupBy("snapshot_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "domain"))).alias("top_domains")
    )
    our_url = F.col("our_url") if "our_url" in snapshots.columns else F.lit(None).cast("string").alias("our_url")
    shown = newest.join(domains, "snapshot_id", "left").select(
        "query", "snapshot_id", "scraped_at", our_url, "our_position", "total_results",
        F.coalesce("top_domains", F.array().cast("array<struct<position:int,domain:string>>")).alias("top_domains"),
    )
    if isinstance(query, DataFrame):
        return with_missing(shown, query, snapshots, query_col)
    return shown.orderBy(F.desc("scraped_at"), F.desc("snapshot_id")) if is_single(query) else shown


def position_trend(snapshots: DataFrame, query=None, limit: int | None = SNAPSHOTS, query_col: str = "query") -> DataFrame:
    """query, weeks_tracked, current_position, trend: oldest against newest known position in the window.

    our_url is that of the newest snapshot, if the snapshots carry one.
    """
    stamp = F.struct("scraped_at", "snapshot_id")
    ours = [F.max_by(F.struct("our_url"), stamp)["our_url"].alias("our_url")] if "our_url" in snapshots.columns else []
    known = F.when(F.col("our_position").isNotNull(), stamp)
    folded = (
        _newest_snapshots(snapshots, query, limit, query_col)
        .groupBy("query")
        .agg(
            F.count(F.lit(1)).alias("weeks_tracked"),
            F.max_by("our_position", known).alias("current_position"),
            F.min_by("our_position", known).alias("_oldest"),
            *ours,
        )
    )
    now, then = F.col("current_position"), F.col("_oldest")
    trend = F.when(now.isNull(), "not_ranked").when(now < then, "improving").when(now > then, "declining").otherwise("stable")
    return folded.withColumn("trend", trend).drop("_oldest")


def _defaulted(df: DataFrame) -> dict[str, Column]:
    """Snapshot columns with the report defaults; columns a table lacks read as missing."""

    def given(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    texts = {n: F.coalesce(given(n), F.lit("")) for n in ("title", "price_raw", "description", "materials")}
    codes = {n: or_else(given(n), "unknown") for n in ("metal_type", "karat", "availability")}
    flags = {n: F.coalesce(given(n, "boolean"), F.lit(False)) for n in ("price_changed", "description_changed")}
    return {**texts, **codes, **flags}


def competitor_products(
    products: DataFrame,
    competitors: DataFrame,
    snapshots: DataFrame,
    domain: str | None = None,
    only_changed: bool = False,
    limit: int | None = PRODUCTS,
    key: str = "url",
    on: str = "domain",
    order: Sequence[str] = ("scraped_at",),
) -> DataFrame:
    """Products with their newest snapshot, cheapest first and unpriced before all.

    The newest snapshot per product is a top-1 window taken before the join, so each side is unique on the
    product. `only_changed` also drops products without any snapshot.
    """
    owners = competitors if domain is None else competitors.where(F.col("domain") == F.lit(domain))
    owned = products.select(*dict.fromkeys([key, on, "url"]), "first_seen_at", "last_scraped_at").join(
        owners.select(*dict.fromkeys([on, "domain"]), "name"), on
    )
    newest = last_per_key(snapshots, [key], list(order))
    if only_changed:
        newest = newest.where(F.col("price_changed") | F.col("description_changed"))
    texts = _defaulted(newest)
    taken = newest.select(key, "price_usd", F.col("scraped_at").alias("snapshot_at"), *[c.alias(n) for n, c in texts.items()])
    joined = owned.join(taken, key, "inner" if only_changed else "left")
    shown = joined.select(
        "url", "domain", or_else(F.col("name"), F.col("domain")).alias("name"), "price_usd",
        *[c.alias(n) for n, c in _defaulted(joined).items()],
        "first_seen_at", "last_scraped_at", "snapshot_at",
    )
    return shown if limit is None else shown.orderBy(F.asc_nulls_first("price_usd"), "url").limit(limit)


def _owned_snapshots(snapshots: DataFrame, products: DataFrame, url, key: str) -> tuple[DataFrame, DataFrame]:
    name = [or_else(F.col("name"), F.col("domain")).alias("name")] if "name" in products.columns else []
    owned = products.select(*dict.fromkeys([key, "url"]), "domain", *name)
    return snapshots, owned if url is None else owned.where(F.col("url") == F.lit(url))


def price_history(
    snapshots: DataFrame, products: DataFrame, url=None, key: str = "url", order: Sequence[str] = ("scraped_at",)
) -> DataFrame:
    """All snapshots with report defaults; in time order for a single url.

    `products` carries url, domain and, if known, the competitor's name.
    """
    rows, owned = _owned_snapshots(snapshots, products, url, key)
    if key == "url" and url is not None:
        rows = rows.where(F.col("url") == F.lit(url))
    joined = rows.join(owned, key)
    shown = joined.select(
        *[c for c in ("url", "domain", "name") if c in joined.columns], *dict.fromkeys(["scraped_at", *order]), "price_usd",
        *[c.alias(n) for n, c in _defaulted(rows).items()],
    )
    return shown if url is None else shown.orderBy(*order)


def price_range(
    snapshots: DataFrame, products: DataFrame, url=None, key: str = "url", order: Sequence[str] = ("scraped_at",)
) -> DataFrame:
    """Per product: status, snapshot count, price flags, lowest, highest and current price (NULL if the newest has none).

    Everything folds map-side before the shuffle. `price_changed` counts when the snapshots carry it.
    """
    rows, owned = _owned_snapshots(snapshots, products, url, key)
    if key == "url" and url is not None:
        rows = rows.where(F.col("url") == F.lit(url))
    flag = F.col("price_changed") if "price_changed" in rows.columns else F.lit(False)
    folded = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(flag.cast("bigint")).alias("_flags"),
        F.min("price_usd").alias("min_price"),
        F.max("price_usd").alias("max_price"),
        F.max_by(F.struct("price_usd"), F.struct(*order)).alias("_newest"),
    )
    return owned.join(folded, key, "left").select(
        *[c for c in ("url", "domain", "name") if c in owned.columns],
        F.when(F.col("_rows").isNull(), "no_snapshots").otherwise("ok").alias("status"),
        F.coalesce("_rows", F.lit(0)).cast("bigint").alias("total_snapshots"),
        F.coalesce("_flags", F.lit(0)).cast("bigint").alias("price_changes_detected"),
        "min_price",
        "max_price",
        F.col("_newest.price_usd").alias("current_price"),
    )
