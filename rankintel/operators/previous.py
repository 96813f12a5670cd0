"""The previous row of the same key, without gathering a long history in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], chunk: Column | None = None
) -> DataFrame:
    """Add `previous`: a struct of `values` from the key's preceding row, NULL for its first row.

    A plain lag sorts all rows of a key in one task. Here a key is cut into chunks along its order (`chunk`
    must not decrease with it; default: the hour of the first order column, a time). Inside a chunk an
    ordinary lag does the work, spread by key and chunk. Only the first row of each chunk, which also carries
    the chunk's last values, goes on to a lag over the key's chunks. The explicit repartition matters: rows
    that arrive already hashed by the key alone would otherwise stay together.
    """
    piece = F.date_trunc("hour", F.col(order[0])) if chunk is None else chunk
    told = F.struct(*values)
    spread = df.withColumn("_chunk", piece).repartition(*keys, "_chunk")
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    rows = (
        spread.withColumn("_nth", F.row_number().over(inner))
        .withColumn("previous", F.lag(told).over(inner))
        .withColumn("_tail", F.last(told).over(inner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    followers = rows.where("_nth > 1")
    heads = rows.where("_nth = 1").withColumn(
        "previous", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_chunk"))
    )
    return followers.unionByName(heads).drop("_chunk", "_nth", "_tail")
