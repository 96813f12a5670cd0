"""Exact top-k search by integer inner product: tiled matrix products, selection per tile, merging in a tree.

Queries are dealt into tiles and candidates into shards of bounded size. Every pair of a tile and a shard is a matrix
product of its own, of which each query keeps its k best; these short lists are merged in groups of `FAN` shards, level
by level. Nothing is approximated: ties at the end of a list go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 64
TILE_ROWS = 2_048
SHARD_ROWS = 8_192
FAN = 8
FOUND = "query_id long, vec_id long, score long, shard int"


def quantised(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """key and `__v` (little-endian 64-bit floor(scale * x)) of the rows whose vectors take part.

    Null ids, null or empty vectors, and vectors that hold a null or a non-finite component take no part.
    """
    x = vectors[vector].cast("array<double>")
    picked = vectors.select(vectors[key].cast("long").alias("__id"), x.alias("__x"))
    whole = (F.size("__x") > 0) & ~F.exists("__x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    picked = picked.where(F.col("__id").isNotNull() & whole)
    schema = "__id long, __d int, __v binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            values = np.floor(scale * lists.flatten().to_numpy())
            if np.abs(values).max(initial=0) >= 1 << 62:
                raise OverflowError("a component is too large for a long")
            flat = values.astype("<i8").tobytes()
            ends = np.concatenate([[0], np.cumsum(sizes)]) * 8
            cells = [flat[ends[i] : ends[i + 1]] for i in range(len(sizes))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), pa.array(cells, pa.binary())], names=["__id", "__d", "__v"])

    return picked.mapInArrow(run, schema)


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where no sum can leave the exact range, else in integers."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * rows.shape[1]
    if most < 1 << 24:
        return (queries.astype(np.float32) @ rows.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return queries @ rows.T
    raise OverflowError("an inner product may not fit into a long")


def best_of_tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query, row, score) of each query, the query's own id left out."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, 4_000_000 // max(1, len(ids)))  # scores held at a time
    for at in range(0, len(query_ids), step):
        own, scores = query_ids[at : at + step], _products(queries[at : at + step], rows)
        same = np.searchsorted(ids, own)
        hit = (same < len(ids)) & (ids[np.minimum(same, len(ids) - 1)] == own)
        keep = min(k + 1, len(ids))  # one more for the query's own row
        numbers = np.broadcast_to(np.arange(len(ids)), scores.shape)  # they follow ids, so (score, -number) has no ties
        if np.abs(scores).max(initial=0) < (1 << 62) // len(ids):
            ranked = numbers - scores * len(ids)
            columns = np.argpartition(ranked, keep - 1, axis=1)[:, :keep]
            columns = np.take_along_axis(columns, np.argsort(np.take_along_axis(ranked, columns, axis=1), axis=1), axis=1)
        else:
            columns = np.lexsort((numbers, -scores), axis=1)[:, :keep]
        values = np.take_along_axis(scores, columns, axis=1)
        mine = hit[:, None] & (columns == same[:, None])
        mine |= np.cumsum(~mine, axis=1) > k  # without the own row one more was kept
        who = np.repeat(own, columns.shape[1]).reshape(columns.shape)
        found.append(tuple(x[~mine] for x in (who, ids[columns], values)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _matrix(cells: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(cells), "<i8").reshape(len(cells), -1)


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best other rows of each query row.

    Only vectors of a query's own length are compared with it. Rows that repeat an id count once (the row with the
    greatest vector). Scores that a long cannot hold are an error.
    """
    picked = vectors.where(vectors[key].isNotNull()).select(key, vector, F.coalesce(is_query, F.lit(False)).alias("__asks"))
    asks = picked.where("__asks").select(F.col(key).cast("long").alias("__id")).distinct()
    all_ = quantised(picked, key, vector, scale).groupBy("__id").agg(F.max_by(F.struct("__d", "__v"), "__v").alias("__row")).select("__id", "__row.*")
    n, n_queries = vectors.count(), asks.count()
    shards, tiles = max(1, -(-n // SHARD_ROWS)), max(1, -(-n_queries // TILE_ROWS))

    def dealt(parts: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("__id", F.lit(salt)), F.lit(parts)).cast("int")

    queries = all_.join(asks, "__id", "left_semi").withColumn("tile", dealt(tiles, 1)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    rows = all_.withColumn("shard", dealt(shards, 2)).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))

    def tile(key_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "shard": []}, dtype="int64")
        who, ids, scores = best_of_tile(left["__id"].to_numpy(), _matrix(left["__v"]), right["__id"].to_numpy(), _matrix(right["__v"]), k)
        return pd.DataFrame({"query_id": who, "vec_id": ids, "score": scores, "shard": np.int32(key_[1])})

    on = ("tile", "shard", "__d")
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # columns of its own beside the queries'
    found = queries.groupBy(*on).cogroup(rows.groupBy(*on)).applyInPandas(tile, FOUND)
    best = [F.col("score").desc(), F.col("vec_id")]
    while shards > 1:
        shards = -(-shards // FAN)
        found = found.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int"))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(*best))).where(F.col("rank") <= k).drop("rank")
    last = Window.partitionBy("query_id").orderBy(*best)
    return found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
