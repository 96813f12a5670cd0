"""Attaching unique-key facts to result rows, and top-k per group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A row limit up to this size is proof enough that the limited rows fit a broadcast.
BOUNDED_ROWS = 10_000


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], limit: int | None, offset: int = 0) -> DataFrame:
    """Rows offset+1 .. offset+limit of each group; Spark prunes to offset+limit rows per group before the shuffle."""
    if limit is None and not offset:
        return df
    nth = F.col("_nth")
    wanted = nth > offset if limit is None else (nth > offset) & (nth <= offset + limit)
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(wanted).drop("_nth")


def attach(rows: DataFrame, facts: Sequence[DataFrame], key: str = "url", bound: int | None = None) -> DataFrame:
    """Left join `rows` with fact tables that are unique on the key.

    bound=None: the facts are first merged on their unique key and joined once. The rows then pass a single
    join that adaptive execution can split when one url fills much of them; two joins in a row on the same
    key would share one shuffle and could not be split.
    bound=n (the caller limited `rows` to n): the facts are cut down to the rows' keys by a broadcast semi
    join, so the big tables are scanned but never shuffled. The rows are the same either way.
    """
    if bound is not None and bound <= BOUNDED_ROWS:
        wanted = F.broadcast(rows.select(key).distinct())
        return reduce(lambda df, fact: df.join(fact.join(wanted, key, "left_semi"), key, "left"), facts, rows)
    return rows.join(reduce(lambda a, b: a.join(b, key, "full"), facts), key, "left")


def only_keywords(df: DataFrame, keywords: Sequence | DataFrame | None, column: str = "query") -> DataFrame:
    """Rows of the given keywords: a list becomes a pushed-down filter, a DataFrame a semi join, None keeps all."""
    if keywords is None:
        return df
    if isinstance(keywords, DataFrame):
        return df.join(keywords.select(F.col(keywords.columns[0]).alias(column)).distinct(), column, "left_semi")
    return df.where(F.col(column).isin(list(keywords)))


def of_query(df: DataFrame, query) -> DataFrame:
    """Rows of one query, of each query in the first column of a DataFrame, or (None) all rows."""
    if query is None or isinstance(query, DataFrame):
        return only_keywords(df, query)
    return df.where(F.col("query") == F.lit(query))


def is_single(query) -> bool:
    """Whether one query is asked for, so that its rows come in order and are bounded by the limit."""
    return query is not None and not isinstance(query, DataFrame)
