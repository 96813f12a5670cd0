"""The graph index: recall against brute force, exact scores, ties, odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankintel.llm import graph_index

SCHEMA = "vec_id long, embedding array<float>, label int, query_id long, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 1, 2, "s") for i, x in rows], SCHEMA)


def product(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def brute(rows, asks, k):
    rows = [(i, [float(np.float32(v)) for v in x]) for i, x in rows if i is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x)]
    out = {}
    for query, own in rows:
        if asks(query):
            others = sorted((-product(own, x), i) for i, x in rows if i != query and len(x) == len(own))
            out[query] = [(i, -s) for s, i in others[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, expected):
    hits = [len({i for i, _ in got.get(q, [])} & {i for i, _ in e}) / len(e) for q, e in expected.items() if e]
    return sum(hits) / len(hits)


@pytest.mark.parametrize("kind", ["ball", "clusters", "lengths"])
def test_recall_and_scores(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24))
    if kind == "clusters":
        x = x * 0.05 + rng.normal(size=(12, 24))[rng.integers(0, 12, 3000)]
    if kind == "lengths":
        x *= rng.exponential(size=(3000, 1)) + 0.01
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    index = graph_index.index(frame(spark, rows), 20, shard_rows=900)
    sizes = [len(r.ids) // 8 for r in index.collect()]
    assert len(sizes) >= 4 and sum(sizes) == 3000 and max(sizes) < 1000
    got = found(graph_index.search(index, frame(spark, rows).where("vec_id % 20 = 0"), 20, block_bytes=5000))
    expected = brute(rows, lambda i: i % 20 == 0, 20)
    assert recall(got, expected) >= 0.95
    exact = {q: dict(brute(rows, lambda i, q=q: i == q, 3000)[q]) for q in (0, 20, 40)}
    for q, scores in exact.items():
        assert all(scores[i] == s for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))


def test_equal_vectors_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[::3] = x[0]  # a vector that a third of all rows have
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, []), (1040, [0.0] * 8), (1060, [1.0, None] * 4), (1080, [float("nan")] * 8), (1100, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(2000, [1.0, 2.0]), (2020, [2.0, 1.0]), (2040, [5.0, 5.0, 5.0]), (20, x[20].tolist())]
    got = found(graph_index.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, 20))
    expected = brute(list(dict(rows).items()), lambda i: i % 20 == 0, 20)
    assert recall(got, expected) >= 0.95
    assert got[0] == expected[0] and got[60] == expected[60]  # ties go to the smaller ids, the own one left out
    assert [i for i, _ in got[2000]] == [2020] and 2040 not in got
    assert set(got) == {q for q, e in expected.items() if e}


def test_empty_table_and_one_row(spark):
    ask = F.col("vec_id") % 20 == 0
    assert graph_index.nearest(frame(spark, []), ask).count() == 0
    assert graph_index.nearest(frame(spark, [(0, [1.0, 2.0])]), ask).count() == 0
    assert graph_index.nearest(frame(spark, [(0, None), (20, [0.0])]), ask).count() == 0


def test_pruning_keeps_diverse_edges():
    x = np.array([[1, 0], [0.99, 0.14], [0.98, 0.2], [0.0, 1.0]], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    kept = graph_index.robust_prune(x, np.array([0]), np.array([[1, 2, 3, -1]]), 3)
    assert kept.tolist() == [[1, 3, -1]]
