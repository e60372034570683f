import random

import numpy as np
from pyspark.sql import functions as F

from depsight.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank int"


def brute(rows, k):
    import math

    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in {i: min(v for j, v in ok if j == i) for i, _ in ok if i % 100 == 0}.items():
        found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(found)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA)


def run(spark, rows, k=10):
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(frame(spark, rows), F.col("vec_id") % 100 == 0, k).collect()}


def rows(n=700, d=8, seed=1):
    r = random.Random(seed)
    return [(i, [r.randint(-64, 64) / 64 for _ in range(d)]) for i in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 128)
    data = rows() + [(1000, None), (1100, [1.0, None]), (1200, [float("nan")] * 8), (1300, [float("inf")] * 8), (1400, [0.5] * 3), (1401, [0.25] * 3), (None, [0.5] * 8)]
    assert run(spark, data) == brute(data, 10)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    data = rows(900)
    assert run(spark, data) == brute(data, 10)


def test_ties_few_rows_large_values_and_empty(spark):
    same = [(i, [0.5, 0.5]) for i in range(30)]
    assert run(spark, same) == brute(same, 10)
    few = [(0, [1.0]), (1, [2.0])]
    assert run(spark, few) == {(0, 1, 1, 1024 * 2048)}
    big = [(0, [float(2**20)] * 4), (1, [float(2**10)] * 4), (2, [-1.0] * 4)]
    assert run(spark, big) == brute(big, 10)
    assert run(spark, []) == set()


def test_blocks_below_the_kth_score_are_passed_over():
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 16)) * 900
    c = np.floor(centres[r.integers(0, 40, 2048)] + r.normal(size=(2048, 16)) * 40).astype(np.int64)
    order, q = topk.arranged(c), c[:50]
    assert sorted(order.tolist()) == list(range(2048))
    scored: list[int] = []
    got = {i: (ids, x) for i, ids, x in topk.best_of(q, np.arange(50), c[order], order, 10, np.full(50, -np.inf), scored)}
    for i in range(50):
        every = c @ q[i]
        every[i] = np.iinfo(np.int64).min
        assert sorted(got[i][1], reverse=True)[:10] == sorted(every, reverse=True)[:10]
    assert sum(scored) < 0.6 * 50 * 2048 / topk.BLOCK
