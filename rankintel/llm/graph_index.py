"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Vectors are dealt into shards of bounded size; equal vectors are one node, whatever their number. A shard's graph is
built in rounds: greedy searches in the graph so far propose neighbours for the nodes that are added, relaxed distance
pruning keeps diverse ones, and edges back to the added nodes are pruned alike. A query walks every shard's graph with a
beam from a few spread entries; the best of a task's shards are merged before they leave it, and tasks' lists by query.

Nearness is the inner product. A shard holds vectors of about one length, and they get one more component there that
makes all as long as the longest, so that the nearest by distance are those of the largest inner product. Scores of what is found are made again from the
original vectors, component by component in double precision.

The index is a table (one row a shard). Queries go to it in blocks of bounded bytes; every task reads its shards once a
block, and what is shuffled is k rows for each query and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankintel.llm.shared import stored

#: Vectors of a shard, about; edges of a node at most; beam of the build and of a query.
SHARD_ROWS = 4_096
DEGREE = 28
BUILD_BEAM = 48
BEAM = 96
#: Lengths of a shard's vectors differ by this factor at most.
BAND = 1.2
#: How much longer a way around may be for an edge to be left out.
RELAX = 1.2
ENTRIES = 16
#: Best entries of a beam that are expanded at once, and walks made side by side.
EXPANDED = 4
WALKS = 256
#: Bytes of a block of queries, which is broadcast, and of a shard's vectors.
BLOCK_BYTES = 8_000_000
SHARD_BYTES = 32_000_000

FOUND = "query_id long, vec_id long, score double"


# ---------------------------------------------------------------- graph of a shard


def _distances(x: np.ndarray, ids: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of rows `ids` (walk, candidate) from the vectors `to` (walk); all are of length 1."""
    return np.maximum(0, 2 - 2 * (x[ids] @ to[:, :, None])[:, :, 0])


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, to: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each vector of `to` the nodes of its beam at the end (-1: none), nearest first, and their distances.

    `graph` has a row of neighbours for each node, filled up with -1.
    """
    walks, n = len(to), len(x)
    seen = np.zeros((walks, n + 1), bool)  # the last column is for -1
    seen[:, -1] = True
    ids = np.full((walks, beam), -1, np.int64)
    far = np.full((walks, beam), np.inf, np.float32)
    done = np.ones((walks, beam), bool)
    active = np.arange(walks)
    fresh = np.broadcast_to(entries, (walks, len(entries)))
    while len(active):
        rows = active[:, None]
        # Of a node that several expanded entries lead to, one place counts: the last that was written.
        fresh = np.where(seen[rows, fresh], -1, fresh)
        turn = np.zeros((len(active), n + 1), np.int16)
        here = np.arange(len(active))[:, None]
        numbers = np.broadcast_to(np.arange(fresh.shape[1], dtype=np.int16), fresh.shape)
        turn[here, fresh] = numbers
        fresh = np.where(turn[here, fresh] == numbers, fresh, -1)
        seen[rows, fresh] = True
        away = np.where(fresh >= 0, _distances(x, np.maximum(fresh, 0), to[active]), np.inf).astype(np.float32)
        all_ids = np.concatenate([ids[active], fresh], 1)
        all_far = np.concatenate([far[active], away], 1)
        all_done = np.concatenate([done[active], fresh < 0], 1)
        if all_far.shape[1] > beam:
            best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
            all_ids, all_far, all_done = (np.take_along_axis(a, best, 1) for a in (all_ids, all_far, all_done))
        order = np.argsort(all_far, axis=1, kind="stable")
        all_ids, all_far, all_done = (np.take_along_axis(a, order, 1) for a in (all_ids, all_far, all_done))
        left = ~all_done
        chosen = left & (np.cumsum(left, axis=1) <= EXPANDED)
        ids[active], far[active], done[active] = all_ids, all_far, all_done | chosen
        on = chosen.any(1)
        active, chosen, all_ids = active[on], chosen[on], all_ids[on]
        picked = np.argsort(~chosen, axis=1, kind="stable")[:, :EXPANDED]
        nodes = np.where(np.take_along_axis(chosen, picked, 1), np.take_along_axis(all_ids, picked, 1), -1)
        fresh = np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(len(active), EXPANDED * graph.shape[1])
    return ids, far


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, relax: float = RELAX) -> np.ndarray:
    """Diverse neighbours of each node (-1: none), from candidates (-1: none) that hold no node twice.

    The nearest candidate is kept, and all go to which the way over it is not longer by `relax`; so on with the rest.
    """
    rows = np.arange(len(nodes))
    away = np.where((candidates >= 0) & (candidates != nodes[:, None]), _distances(x, np.maximum(candidates, 0), x[nodes]), np.inf)
    vectors = x[np.maximum(candidates, 0)]
    out = np.full((len(nodes), degree), -1, np.int64)
    for i in range(degree):
        nearest = away.argmin(1)
        some = away[rows, nearest] < np.inf
        if not some.any():
            break
        out[some, i] = candidates[rows, nearest][some]
        between = np.maximum(0, 2 - 2 * (vectors @ vectors[rows, nearest][:, :, None])[:, :, 0])
        # Distances are squared, so the factor is, too. The kept one is at distance 0 from itself and goes with them.
        away[relax * relax * between <= away] = np.inf
        away[rows, nearest] = np.inf
    return out


def _added_back(x: np.ndarray, graph: np.ndarray, new: np.ndarray) -> None:
    """Edges from the neighbours of `new` back to them; where there is no room, all are pruned."""
    degree = graph.shape[1]
    target, source = graph[new].ravel(), np.repeat(new, degree)
    target, source = target[target >= 0], source[target >= 0]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    nodes, starts, counts = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(starts, counts)
    by_count = np.argsort(counts, kind="stable")
    number = np.empty(len(nodes), np.int64)
    at = 0
    while at < len(by_count):
        # Nodes of about the same number of new edges together, so that no table is wide for the sake of one node.
        part = by_count[at : at + 4 * WALKS]
        part = part[: max(1, int(np.searchsorted(counts[part], 2 * counts[part[0]] + degree, side="right")))]
        at += len(part)
        width = int(counts[part].max())
        extra = np.full((len(part), width), -1, np.int64)
        number[:] = -1
        number[part] = np.arange(len(part))
        row = number[np.repeat(np.arange(len(nodes)), counts)]
        extra[row[row >= 0], place[row >= 0]] = source[row >= 0]
        old = graph[nodes[part]]
        extra = np.where((extra[:, :, None] == old[:, None, :]).any(2), -1, extra)
        graph[nodes[part]] = robust_prune(x, nodes[part], np.concatenate([old, extra], 1), degree)


def _entries(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Nodes to start from: the one nearest the middle, others far from each other among some drawn at random, and the
    longest of the original vectors, which are near to many queries.
    """
    longest = np.argsort(x[:, -1], kind="stable")[:ENTRIES]
    drawn = rng.choice(len(x), min(len(x), 32 * ENTRIES), replace=False)
    gap = x[drawn] - x.mean(0)
    chosen = [int(np.einsum("nd,nd->n", gap, gap).argmin())]
    nearest = np.full(len(drawn), np.inf)
    for _ in range(min(ENTRIES, len(drawn)) - 1):
        gap = x[drawn] - x[drawn[chosen[-1]]]
        nearest = np.minimum(nearest, np.einsum("nd,nd->n", gap, gap))
        chosen.append(int(nearest.argmax()))
    return np.union1d(drawn[chosen], longest).astype(np.int64)


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The graph over the rows of `x`, all of length 1 (neighbours, filled up with -1), and its entries.

    The last component is what a vector lacks to the length of the longest.
    """
    n, rng = len(x), np.random.default_rng(seed)
    graph = np.full((n, degree), -1, np.int64)
    entries = _entries(x, rng)
    order = np.concatenate([entries, rng.permutation(np.setdiff1d(np.arange(n), entries))])
    # The entries are each other's first candidates, so that all are reached.
    graph[entries] = robust_prune(x, entries, np.broadcast_to(entries, (len(entries), len(entries))), degree)
    done = len(entries)
    while done < n:
        new = order[done : done + min(WALKS, done)]
        found, _ = beam_search(x, graph, entries, x[new], beam)
        graph[new] = robust_prune(x, new, found, degree)
        _added_back(x, graph, new)
        done += len(new)
    return graph, entries


# ---------------------------------------------------------------- index and search


def _valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """__id and __x (doubles): rows with an id whose vector holds finite numbers, not all of them zero."""
    picked = vectors.select(vectors[key].cast("long").alias("__id"), vectors[vector].cast("array<double>").alias("__x"))
    odd = F.exists("__x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return picked.where(F.col("__id").isNotNull() & (F.size("__x") > 0)).where(~odd & F.exists("__x", lambda c: c != 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def index(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: dim, shard, x (vectors as doubles), ids and first (ids of each node, and where they start),
    graph, entries, degree.

    Every vector that takes part is a node. Of equal vectors a node keeps the k + 1 smallest ids: no query returns
    more than k others. Only vectors of one length share a shard.
    """
    valid = _valid(vectors, key, vector).distinct()
    # Ranks beyond k + 1 are cut before the shuffle, so that a vector which a third of all rows have is no burden.
    ranked = valid.withColumn("__rank", F.row_number().over(Window.partitionBy("__x").orderBy("__id"))).where(F.col("__rank") <= k + 1)
    nodes = ranked.groupBy("__x").agg(F.sort_array(F.collect_list("__id")).alias("__ids"))
    nodes = stored(nodes.withColumn("dim", F.size("__x")), "nodes")
    length = F.sqrt(F.aggregate("__x", F.lit(0.0), lambda sum_, c: sum_ + c * c))
    banded = nodes.withColumn("band", F.round(F.log(length) / float(np.log(BAND))).cast("int"))
    # A row for each length of vectors that occurs and each band, whose number is bounded by what a double can hold.
    most = F.greatest(F.lit(1), F.least(F.lit(shard_rows), F.floor(SHARD_BYTES / (8 * F.col("dim")))))
    parts = banded.groupBy("dim", "band").agg(F.count("*").alias("n")).select("dim", "band", F.ceil(F.col("n") / most).alias("parts"))
    shard = F.concat_ws(".", "band", F.pmod(F.xxhash64("__x"), "parts"))
    dealt = banded.join(F.broadcast(parts), ["dim", "band"]).withColumn("shard", shard)

    def built(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.iloc[np.argsort([ids[0] for ids in rows["__ids"]])]
        x = np.stack(rows["__x"].to_numpy())
        squares = np.einsum("nd,nd->n", x, x)
        longer = np.sqrt(np.maximum(0.0, squares.max() - squares))
        graph, entries = build((np.column_stack([x, longer]) / np.sqrt(squares.max())).astype(np.float32))
        ids = np.concatenate(rows["__ids"].to_numpy())
        first = np.concatenate([[0], np.cumsum([len(i) for i in rows["__ids"]])])
        cells = {"x": x, "ids": ids.astype(np.int64), "first": first, "graph": graph.astype(np.int32), "entries": entries.astype(np.int32)}
        made = {name: [value.tobytes()] for name, value in cells.items()}
        return pd.DataFrame({"dim": [x.shape[1]], "shard": [rows["shard"].iloc[0]], **made, "degree": [graph.shape[1]]})

    schema = "dim int, shard string, x binary, ids binary, first binary, graph binary, entries binary, degree int"
    return stored(dealt.groupBy("dim", "shard").applyInPandas(built, schema), "graphs")


class _Shard:
    def __init__(self, row: dict) -> None:
        self.x = np.frombuffer(row["x"], np.float64).reshape(-1, row["dim"])
        self.ids, self.first = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["first"], np.int64)
        self.graph = np.frombuffer(row["graph"], np.int32).reshape(-1, row["degree"])
        self.entries = np.frombuffer(row["entries"], np.int32).astype(np.int64)
        squares = np.einsum("nd,nd->n", self.x, self.x)
        self._long = np.sqrt(squares.max())
        self._space = (np.column_stack([self.x, np.sqrt(np.maximum(0.0, squares.max() - squares))]) / self._long).astype(np.float32)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best found for each query, its own id left out."""
        size = np.sqrt(np.einsum("nd,nd->n", queries, queries))
        to = np.column_stack([queries / size[:, None], np.zeros(len(queries))]).astype(np.float32)
        nodes, _ = beam_search(self._space, self.graph, self.entries, to, beam)
        who, slot = np.nonzero(nodes >= 0)
        node = nodes[who, slot]
        scores = np.zeros(len(who))
        for d in range(self.x.shape[1]):
            scores += queries[who, d] * self.x[node, d]
        counts = np.diff(self.first)[node]
        who, scores = np.repeat(who, counts), np.repeat(scores, counts)
        ids = self.ids[np.repeat(self.first[node] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))]
        others = ids != query_ids[who]
        return best_of(who[others], ids[others], scores[others], k)


def best_of(who: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of largest score for each query, ties to the smaller id; in order."""
    order = np.lexsort((ids, -scores, who))
    who, ids, scores = who[order], ids[order], scores[order]
    first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
    rank = np.arange(len(who)) - np.repeat(first, np.diff(np.concatenate([first, [len(who)]])))
    return who[rank < k], ids[rank < k], scores[rank < k]


def search(graphs: DataFrame, queries: DataFrame, k: int = 20, beam: int = BEAM, key: str = "vec_id", vector: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found for each query row, itself left out.

    Queries that hold no vector to search with (see `index`) have no rows; only vectors of a query's own length are
    compared with it. Queries that repeat an id and a vector count once.
    """
    if beam < k + 1:
        raise ValueError("the beam must hold the query itself and k others")
    spark = graphs.sparkSession
    asked = stored(_valid(queries, key, vector).distinct().withColumn("dim", F.size("__x")), "queries")
    blocks = {r["dim"]: max(1, -(-r["n"] * r["dim"] * 8 // block_bytes)) for r in asked.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    found = spark.createDataFrame([], FOUND)
    for dim, parts in sorted(blocks.items()):
        for part in range(parts):
            rows = asked.where(F.col("dim") == dim).where(F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(parts)) == part)
            table = rows.select("__id", "__x").toArrow()  # about `block_bytes`
            cells = {"ids": table.column(0).to_numpy(), "x": _matrix(table.column(1).combine_chunks(), dim)}
            held = spark.sparkContext.broadcast(cells)

            def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                ids, x = held.value["ids"], held.value["x"]
                best: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
                for batch in batches:
                    for row in batch.to_pylist():
                        shard, new = _Shard(row), []
                        for at in range(0, len(ids), WALKS):
                            who, near, scores = shard.nearest(ids[at : at + WALKS], x[at : at + WALKS], k, beam)
                            new.append((who + at, near, scores))
                        best = best_of(*(np.concatenate([b, *n]) for b, n in zip(best, zip(*new))), k) if new else best
                yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "vec_id", "score"])

            near = graphs.where(F.col("dim") == dim).mapInArrow(run, FOUND)
            last = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
            merged = near.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
            found = found.unionByName(stored(merged.drop("rank"), "found"))
            held.destroy()
    # A query id that stands for several vectors has the best of all of them.
    last = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: `search` of the rows that ask, in an `index` over all rows.

    Null ids, null, empty or zero vectors and vectors that hold a null or non-finite component take no part, neither
    as queries nor as candidates. An empty table gives an empty result.
    """
    return search(index(vectors, k, key, vector), vectors.where(F.coalesce(is_query, F.lit(False))), k, beam, key, vector)
