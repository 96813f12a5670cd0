"""Whole-table counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankintel.operators.intel import PLATED, SOLID, VERMEIL


def _counted(df: DataFrame, name: str):
    return df.agg(F.count(F.lit(1)).alias(name))


def _side_by_side(parts: list[DataFrame]) -> DataFrame:
    """One-row aggregates put next to each other as scalar subqueries of a single row."""
    base, *others = parts
    for part in others:
        for name in part.columns:
            base = base.withColumn(name, part.select(name).scalar())
    return base


def db_stats(serp: DataFrame, pages: DataFrame, classes: DataFrame) -> DataFrame:
    """One row: table sizes, newest label time, number of distinct queries."""
    return _side_by_side(
        [
            serp.agg(F.count(F.lit(1)).alias("serp_results"), F.countDistinct("query").alias("keywords_count")),
            _counted(pages, "product_pages"),
            classes.agg(F.count(F.lit(1)).alias("classifications"), F.max("classified_at").alias("last_classified_at")),
        ]
    )


def label_histogram(classes: DataFrame) -> DataFrame:
    """metal_type, n over the label table, largest first."""
    return classes.groupBy("metal_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "metal_type")


def covered_queries(serp: DataFrame) -> DataFrame:
    """The distinct stored queries, sorted; rows rather than one list."""
    return serp.select("query").distinct().orderBy("query")


def run_summary(
    serp: DataFrame,
    snapshots: DataFrame,
    competitors: DataFrame,
    pages: DataFrame,
    product_snapshots: DataFrame,
    classes: DataFrame,
) -> DataFrame:
    """One row of nine counts, three of them label groups."""
    metal = F.col("metal_type")
    return _side_by_side(
        [
            _counted(serp, "serp_results"),
            _counted(snapshots, "serp_snapshots"),
            _counted(competitors, "competitors"),
            _counted(pages, "product_pages"),
            _counted(product_snapshots, "product_snapshots"),
            classes.agg(
                F.count(F.lit(1)).alias("classified"),
                F.count_if(metal == SOLID).alias("solid_gold"),
                F.count_if(metal == VERMEIL).alias("vermeil"),
                F.count_if(metal.isin(*PLATED)).alias("plated_or_filled"),
            ),
        ]
    )
