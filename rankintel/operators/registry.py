"""Registries of products, competitor domains and competitor product pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankintel.functions.urls import domain_of
from rankintel.operators.upsert import insert_ignore, upsert_update


def with_domain(df: DataFrame, url: str = "url", out: str = "domain") -> DataFrame:
    return df.withColumn(out, domain_of(F.col(url)))


def clean_domains(domains: Sequence[str]) -> list[str]:
    return sorted({d.lower().replace("www.", "") for d in domains})


def is_ours(domain: Column, our_domains: Sequence[str]) -> Column:
    names = clean_domains(our_domains)
    return domain.isin(*names) if names else F.lit(False)


def seed_products(existing: DataFrame | None, products: DataFrame, seeded_at: Column) -> DataFrame:
    """Upsert the keyword file's products by handle; place and creation time of known ones stay.

    A handle the file names twice keeps its first place and its last values.
    """
    values = ("title", "our_url", "views_90d", "queries")
    batch = products.groupBy("handle").agg(
        F.min("ordinal").alias("ordinal"), F.max_by(F.struct(*values), "ordinal").alias("_last")
    )
    batch = batch.select("handle", "_last.*", "ordinal", seeded_at.alias("created_at"))
    return upsert_update(existing, batch, ["handle"], list(values), ["ordinal"])


def query_product_map(products: DataFrame) -> DataFrame:
    """query → handle, our_url of the last product (in insertion order) that lists the query."""
    order = [c for c in ("created_at", "ordinal") if c in products.columns]
    listed = products.select(F.explode("queries").alias("query"), "handle", "our_url", *order)
    last = listed.groupBy("query").agg(F.max_by(F.struct("handle", "our_url"), F.struct(*order)).alias("_last"))
    return last.select("query", F.col("_last.handle").alias("our_handle"), F.col("_last.our_url").alias("our_url"))


def _competitors_in(results: DataFrame, our_domains: Sequence[str]) -> DataFrame:
    named = results if "domain" in results.columns else with_domain(results)
    ours = F.col("is_ours") if "is_ours" in results.columns else is_ours(F.col("domain"), our_domains)
    return named.where(~ours & (F.col("domain") != ""))


def competitor_registry(
    results: DataFrame, our_domains: Sequence[str] = (), existing: DataFrame | None = None, seen: str = "scraped_at"
) -> DataFrame:
    """One row per competitor domain: first seen, last updated. Counts combine before the shuffle."""
    found = (
        _competitors_in(results, our_domains)
        .groupBy("domain")
        .agg(F.min(seen).alias("first_seen_at"), F.max(seen).alias("updated_at"))
        .select("domain", F.lit(None).cast("string").alias("name"), "first_seen_at", "updated_at")
    )
    return upsert_update(existing, found, ["domain"], ["updated_at"], ["updated_at"]) if existing is not None else found


def competitor_product_registry(
    results: DataFrame, our_domains: Sequence[str] = (), existing: DataFrame | None = None, seen: str = "scraped_at"
) -> DataFrame:
    """One row per competitor page: the first sighting stays."""
    found = (
        _competitors_in(results, our_domains)
        .groupBy("url")
        .agg(F.min(F.struct(seen, "domain")).alias("_first"))
        .select(
            "url",
            F.col("_first.domain").alias("domain"),
            F.col(f"_first.{seen}").alias("first_seen_at"),
            F.lit(None).cast("timestamp").alias("last_scraped_at"),
        )
    )
    return insert_ignore(existing, found, ["url"], ["first_seen_at"]) if existing is not None else found
