"""Result lists, single products, stored queries and marketplace listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankintel.functions.text import cut, or_else
from rankintel.operators.lookup import attach, is_single, of_query, top_per_group
from rankintel.operators.similar import similar_queries, with_missing

__all__ = [
    "list_marketplace_results", "list_serp_results", "marketplace_intel", "marketplace_metal_summary", "product_classification",
    "similar_queries",
]

# Widths, list lengths and the two spellings of the missing label.
SNIPPET_CHARS = 200
UNCLASSIFIED_APPEARANCES = 5
SHOWN_TAGS = 10
NOT_CLASSIFIED, NOT_CLASSIFIED_KEY = "not classified", "not_classified"


def _page_of(results: DataFrame, query, limit: int | None, offset: int = 0) -> DataFrame:
    """One page of a query's results, or of every (asked) query's."""
    chosen = of_query(results, query)
    if not is_single(query):
        return top_per_group(chosen, ["query"], [F.asc("position"), F.asc("url")], limit, offset)
    chosen = chosen.orderBy("position", "url")
    # The limit comes first: adaptive execution may drop a later sort over a limit of an offset.
    return (chosen if limit is None else chosen.limit(offset + limit)).offset(offset)


def _totals(results: DataFrame, query) -> DataFrame:
    """query, total; counted apart from the page so that no query is gathered in one task."""
    return of_query(results, query).groupBy("query").agg(F.count(F.lit(1)).alias("total"))


def _bound(query, limit: int | None) -> int | None:
    return limit if is_single(query) else None


def _answered(shown: DataFrame, query, stored: DataFrame, *order: str) -> DataFrame:
    """In order for one query; for a table of queries with a row of similar ones for each that found nothing."""
    if isinstance(query, DataFrame):
        return with_missing(shown, query, stored)
    return shown.orderBy(*order) if is_single(query) else shown


def list_serp_results(
    serp: DataFrame, classes: DataFrame, query=None, limit: int | None = 20, offset: int = 0, snippet_chars: int | None = SNIPPET_CHARS
) -> DataFrame:
    """A page of results with labels, the query's total and whether more follow; a snippet width of None keeps it whole.

    `query` is one query, None for all, or a DataFrame of queries: then those without any results have a row each with
    `similar_queries`, which is null in all other rows.
    """
    page = _page_of(serp, query, limit, offset)
    labels = classes.select("url", "metal_type", "karat", _optional(classes, "confidence"))
    joined = attach(page, [labels], bound=_bound(query, limit)).join(_totals(serp, query), "query")
    last = F.lit(None) if limit is None else F.lit(offset + limit)
    shown = joined.select(
        "query",
        "position",
        "url",
        F.coalesce("title", F.lit("")).alias("title"),
        cut(F.coalesce(_optional(serp, "snippet"), F.lit("")), snippet_chars).alias("snippet"),
        F.col("metal_type").isNotNull().alias("classified"),
        or_else(F.col("metal_type"), NOT_CLASSIFIED).alias("metal_type"),
        F.coalesce("karat", F.lit("")).alias("karat"),
        F.coalesce("confidence", F.lit("")).alias("confidence"),
        "total",
        F.coalesce(F.col("total") > last, F.lit(False)).alias("has_more"),
    )
    return _answered(shown, query, serp, "position")


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)


def product_classification(serp: DataFrame, pages: DataFrame, classes: DataFrame, url: str | None = None) -> DataFrame:
    """url, status, labels and one row per appearance (query, position, title) in the results.

    status is `classified`, or `in_serp_not_classified` with the best five appearances only. With a url that is
    nowhere the answer is one `not_found` row. Appearances stay rows: a url may have any number of them.
    """
    if url is not None:
        here = F.col("url") == F.lit(url)
        serp, pages, classes = serp.where(here), pages.where(here), classes.where(here)
    facts = classes.withColumn("_known", F.lit(True))
    labelled = attach(serp.select("url", "query", "position", "title"), [pages.select("url", "page_title"), facts])
    known = F.coalesce("_known", F.lit(False))
    shown = [
        F.coalesce("page_title", F.lit("")).alias("page_title"),
        *[_optional(classes, n, "double" if n == "price_usd" else "string") for n in ("metal_type", "karat", "base_metal", "price_usd", "evidence", "confidence")],
        _optional(classes, "classified_at", "timestamp"),
    ]
    hits = labelled.where(known).select("url", F.lit("classified").alias("status"), *shown, "query", "position", "title")
    # Cut to five per url before the anti join: cut after it, a url filling many rows would sit in one task.
    best = top_per_group(
        serp.select("url", "query", "position"), ["url"], [F.asc("position"), F.asc("query")], UNCLASSIFIED_APPEARANCES
    )
    waiting = best.join(classes.select("url"), "url", "left_anti").withColumn("status", F.lit("in_serp_not_classified"))
    unseen = (
        classes.join(serp.select("url").distinct(), "url", "left_anti")
        .join(pages.select("url", "page_title"), "url", "left")
        .select("url", F.lit("classified").alias("status"), *shown)
    )
    found = hits.unionByName(waiting, allowMissingColumns=True).unionByName(unseen, allowMissingColumns=True)
    if url is None:
        return found
    asked = serp.sparkSession.range(1).select(F.lit(url).alias("url"))
    return asked.join(found, "url", "left").withColumn("status", F.coalesce("status", F.lit("not_found")))


def list_marketplace_results(serp: DataFrame, listings: DataFrame, query=None, limit: int | None = 20) -> DataFrame:
    """Ranked marketplace results with the labels of their listings and the query's total.

    `query` as in `list_serp_results`.
    """
    page = _page_of(serp, query, limit)
    labels = listings.select("url", "metal_type", "karat", "confidence")
    joined = attach(page, [labels], bound=_bound(query, limit)).join(_totals(serp, query), "query")
    shown = joined.select(
        "query",
        "position",
        "url",
        F.coalesce("title", F.lit("")).alias("title"),
        "price_usd",
        F.coalesce("shop", F.lit("")).alias("shop"),
        "reviews",
        F.coalesce("star_seller", F.lit(False)).alias("star_seller"),
        F.col("metal_type").isNotNull().alias("classified"),
        or_else(F.col("metal_type"), NOT_CLASSIFIED).alias("metal_type"),
        F.coalesce("karat", F.lit("")).alias("karat"),
        F.coalesce("confidence", F.lit("")).alias("confidence"),
        "total",
    )
    return _answered(shown, query, serp, "position")


def marketplace_intel(serp: DataFrame, listings: DataFrame, query=None, limit: int | None = 20) -> DataFrame:
    """Ranked marketplace results; the listing's title, price and shop win over the result's where given.

    In order of position if one query is asked for.
    """
    none = F.array().cast("array<string>")
    page = _page_of(serp, query, limit).select(
        "query", "position", "url", "reviews", "star_seller",
        F.col("title").alias("_title"), F.col("price_usd").alias("_price"), F.col("shop").alias("_shop"),
    )
    facts = listings.select(
        "url", "title", "price_usd", "shop", "materials", F.slice(F.coalesce("tags", none), 1, SHOWN_TAGS).alias("tags"),
        "favorites", "metal_type", "karat", "confidence",
    )
    joined = attach(page, [facts], bound=_bound(query, limit))
    shown = joined.select(
        "query",
        "position",
        "url",
        or_else(F.col("title"), or_else(F.col("_title"), "")).alias("title"),
        F.coalesce(F.nullif(F.col("price_usd"), F.lit(0.0)), F.col("_price")).alias("price_usd"),
        or_else(F.col("shop"), or_else(F.col("_shop"), "")).alias("shop"),
        "reviews",
        "favorites",
        F.coalesce("star_seller", F.lit(False)).alias("star_seller"),
        or_else(F.col("metal_type"), NOT_CLASSIFIED_KEY).alias("metal_type"),
        F.coalesce("karat", F.lit("")).alias("karat"),
        F.coalesce("confidence", F.lit("")).alias("confidence"),
        F.coalesce("materials", none).alias("materials"),
        F.coalesce("tags", none).alias("tags"),
    )
    return shown.orderBy("position", "url") if is_single(query) else shown


def marketplace_metal_summary(intel: DataFrame) -> DataFrame:
    """query, metal_type, n of marketplace intel rows."""
    return intel.groupBy("query", "metal_type").agg(F.count(F.lit(1)).alias("n"))
