"""Snapshots of a run: one header per query, one row per result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankintel.functions.urls import domain_of
from rankintel.operators.registry import is_ours, with_domain


def snapshot_key(query: Column, scraped_at: Column) -> Column:
    """Reproducible snapshot id."""
    return F.xxhash64(query, scraped_at)


def build_snapshots(results: DataFrame, query_map: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """Header per query (and run columns): our_handle, our_url, our_position, total_results.

    Our position is the smallest one whose domain is our url's domain. (A result equal to our url up to a
    trailing slash has that same domain, so the url itself needs no second test.) Results are reduced to one
    row per query and domain before they meet our url, so the joins are on unique keys and a query with very
    many results is never gathered in one task. Results are read once.
    """
    key = ["query", *run]
    per_domain = (
        (results if "domain" in results.columns else with_domain(results))
        .groupBy(*key, "domain")
        .agg(F.min("position").alias("_best"), F.count(F.lit(1)).alias("_rows"))
    )
    ours = query_map.select("query", "our_handle", "our_url")
    ours_at = ours.where(F.col("our_url") != "").select(
        "query", domain_of(F.col("our_url")).alias("domain"), F.lit(True).alias("_ours")
    )
    heads = (
        per_domain.join(ours_at, ["query", "domain"], "left")
        .groupBy(*key)
        .agg(
            F.min(F.when(F.col("_ours"), F.col("_best"))).alias("our_position"),
            F.sum("_rows").cast("int").alias("total_results"),
        )
    )
    return heads.join(ours, "query", "left").select(*key, "our_handle", "our_url", "our_position", "total_results")


def build_snapshot_results(results: DataFrame, our_domains: Sequence[str], key: Column | None = None) -> DataFrame:
    """Every result row with its snapshot, domain and whether it is ours. Row by row, no shuffle."""
    ident = snapshot_key(F.col("query"), F.col("scraped_at")) if key is None else key
    named = results if "domain" in results.columns else with_domain(results)
    return named.select(
        ident.alias("snapshot_id"), "position", "url", "title", "domain", is_ours(F.col("domain"), our_domains).alias("is_ours")
    )
