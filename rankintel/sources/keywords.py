"""Keyword files: a JSON array of products with the queries each is tracked by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankintel import schemas


def read_keywords(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(products, queries) of a keyword file.

    products: handle, title, our_url, views_90d, queries, ordinal, missing fields defaulted.
    queries: query, item, pos of the first listing of each distinct query; sort by item, pos for file order.
    """
    items = (
        spark.read.schema(schemas.ddl(schemas.KEYWORD_FILE))
        .option("multiLine", True)
        .json(path)
        .withColumn("ordinal", F.monotonically_increasing_id())
    )
    handle = F.coalesce("product_handle", F.lit(""))
    products = items.select(
        handle.alias("handle"),
        F.coalesce("product_title", handle).alias("title"),
        F.coalesce("our_url", F.lit("")).alias("our_url"),
        F.coalesce("views_90d", F.lit(0)).alias("views_90d"),
        F.coalesce("queries", F.array().cast("array<string>")).alias("queries"),
        "ordinal",
    )
    return products, distinct_queries(products)


def distinct_queries(products: DataFrame) -> DataFrame:
    """query, item, pos: each query once, where it is listed first."""
    listed = products.select(F.col("ordinal").alias("item"), F.posexplode("queries").alias("pos", "query"))
    return listed.groupBy("query").agg(F.min(F.struct("item", "pos")).alias("_first")).select("query", "_first.*")
