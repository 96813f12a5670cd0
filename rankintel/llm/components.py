"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankintel.llm.shared import stored


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; a component is named by its smallest node.

    Each round hangs every node's larger neighbours on its smallest neighbour, then its smaller neighbours and itself
    on the smallest of them, until each node hangs on the smallest node alone. The number of rounds grows with the
    logarithm of the longest path; each round's links are written to the shared folder, so nothing is computed twice
    and a lost executor costs one round at most.
    """
    hung = links.select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo")).where("hi > lo").distinct()
    hung, before = stored(hung, "links"), None
    while True:
        seen = hung.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(seen) == before or not seen[0]:
            return hung.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(hung.select("lo", "lo").distinct())
        before = tuple(seen)
        both = hung.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(hung.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi > lo")
        hung = stored(small.union(lowest.select("hi", F.col("m").alias("lo"))).distinct(), "links")
