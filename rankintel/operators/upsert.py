"""Keyed writes expressed as joins of the current table with an incoming batch.

Keyed tables hold at most one row per key. Only the batch is ever deduplicated, with a top-1 window that
Spark prunes before the shuffle, so a key that fills a third of the batch costs one row per map task.
The current table is left in place: it is anti-joined with the batch's distinct keys, which Spark
broadcasts when they are small and shuffles on the key when they are not.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row per key in the given order (names or sort columns)."""
    ranked = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_nth = 1").drop("_nth")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key; `order` names the columns of the arrival order."""
    return keep_one(df, keys, [F.col(c).desc_nulls_last() for c in order])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return keep_one(df, keys, [F.col(c).asc_nulls_first() for c in order])


def _without(existing: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    return existing.join(batch.select(*keys).distinct(), list(keys), "left_anti")


def upsert_replace(existing: DataFrame | None, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The batch's last row per key replaces the whole row; keys the batch does not name stay.

    So a result list that got shorter leaves its old tail positions in the table.
    """
    last = last_per_key(batch, keys, order)
    if existing is None:
        return last
    return _without(existing, batch, keys).unionByName(last)


def upsert_replace_multi(
    existing: DataFrame | None, batch: DataFrame, key_sets: Sequence[Sequence[str]], order: Sequence[str]
) -> DataFrame:
    """Replacement where a collision on any one of several unique keys evicts the earlier row.

    A row survives only if no later row shares any of its keys, even a later row that is itself evicted.
    NULL keys never collide. `order` must be total and non-NULL. The newest order value per key is a
    combinable aggregate, and the join back is on key and order together, so a hot key stays spread.
    """
    survivors = batch
    for n, keys in enumerate(key_sets):
        present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        stamps = [c for c in order if c not in keys]
        newest = (
            batch.where(present)
            .groupBy(*keys)
            .agg(F.max(F.struct(*order)).alias("_top"))
            .select(*keys, *[F.col(f"_top.{c}").alias(c) for c in stamps], F.lit(True).alias(f"_newest_{n}"))
        )
        survivors = survivors.join(newest, [*keys, *stamps], "left").where(~present | F.col(f"_newest_{n}"))
    survivors = survivors.select(*batch.columns)
    if existing is None:
        return survivors
    for keys in key_sets:
        existing = _without(existing, batch, keys)
    return existing.unionByName(survivors)


def upsert_update(
    existing: DataFrame | None, batch: DataFrame, keys: Sequence[str], set_cols: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Insert new keys; for known keys overwrite only `set_cols`, with NULL if the batch says so."""
    last = last_per_key(batch, keys, order)
    if existing is None:
        return last
    change = last.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in set_cols])
    updated = existing.join(change, list(keys), "left").select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in set_cols else F.col(c)
            for c in existing.columns
        ]
    )
    added = last.join(existing.select(*keys), list(keys), "left_anti")
    return updated.unionByName(added)


def insert_ignore(existing: DataFrame | None, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First writer wins: only keys the table does not hold yet are added."""
    first = first_per_key(batch, keys, order)
    if existing is None:
        return first
    return existing.unionByName(first.join(existing.select(*keys), list(keys), "left_anti"))


def touch_last_scraped(products: DataFrame, snapshots: DataFrame, key: str = "url") -> DataFrame:
    """Move `last_scraped_at` to the newest snapshot of each product that has one."""
    newest = snapshots.groupBy(key).agg(F.max("scraped_at").alias("_seen"))
    touched = products.join(newest, key, "left")
    return touched.withColumn("last_scraped_at", F.coalesce("_seen", "last_scraped_at")).select(*products.columns)
