"""Work selection: result urls that still lack a page, a label or a listing.

Urls are made distinct first (a combinable aggregate), so the anti join sees each url once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_uncrawled(results: DataFrame, pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Result urls without a stored page; with a limit, the first ones by url."""
    missing = results.select("url").distinct().join(pages.select("url"), "url", "left_anti")
    return missing if limit is None else missing.orderBy("url").limit(limit)


def select_unclassified(
    results: DataFrame, classes: DataFrame, exclude_domains: Sequence[str] = (), limit: int | None = None
) -> DataFrame:
    """url and newest sighting of result urls without a label; our own sites are left out.

    With a limit, the newest sightings, newest first.
    """
    fresh = results.select("url", "scraped_at")
    for name in exclude_domains:
        fresh = fresh.where(~F.col("url").ilike(f"%{name}%"))
    newest = fresh.groupBy("url").agg(F.max("scraped_at").alias("scraped_at"))
    missing = newest.join(classes.select("url"), "url", "left_anti")
    return missing if limit is None else missing.orderBy(F.desc("scraped_at"), "url").limit(limit)


def select_unscraped_listings(results: DataFrame, listings: DataFrame, limit: int | None = None) -> DataFrame:
    """Marketplace result urls without a listing row."""
    return select_uncrawled(results, listings, limit)
