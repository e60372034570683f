"""Exact top-k inner products by block-at-a-time pruning.

Vectors become integers (floor of 1024 times each component). Candidates are taken in blocks of rows that are alike; a block keeps the
largest and smallest value of each dimension (its term maxima; the minima serve negative weights) and its rows as
forward index. For each query, blocks are visited by falling summed bound and scored whole until the bound falls
below the k-th score; the bound is exact, so pruning loses nothing. Queries go through in blocks of QUERY_BLOCK rows,
which bounds what is sent to the executors; each block is merged by a grouped top-k.

Defined results: null vectors and vectors with null or non-finite components take no part; vectors of another length
than the query's are no candidates; vec_id is the row's key, so rows of a query's own vec_id are not its candidates
and a repeated query id is answered once (by its least vector); repeated candidate rows each count; scores must fit a long.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SCALE, BLOCK, CHUNK, QUERY_BLOCK, WAVE = 1024, 32, 4096, 4096, 16


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<bigint>), rows that take no part left out. Nothing beyond 2^53 / 1024 is representable."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.col("embedding").isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * SCALE).cast("long")).alias("v"))


def arranged(c: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """An order of the rows in which blocks hold rows that are alike, so that their maxima are tight: halves along the
    direction of most variance, again and again."""
    out, open_ = [], [np.arange(len(c))]
    x = c.astype(float)
    while open_:
        rows = open_.pop()
        if len(rows) <= block:
            out.append(rows)
            continue
        own = x[rows] - x[rows].mean(axis=0)
        axis = np.ones(own.shape[1])
        for _ in range(4):  # a few steps of the power method are near enough
            axis = own.T @ (own @ axis)
            axis /= np.linalg.norm(axis) or 1.0
        rows = rows[np.argsort(own @ axis, kind="stable")]
        half = -(-len(rows) // (2 * block)) * block
        open_ += [rows[half:], rows[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def best_of(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, floor: np.ndarray, scored: list[int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the candidates of this chunk that can be among its k best; floor: k-th scores known so far, raised
    here. scored gets the number of blocks that were not passed over."""
    exact = float(np.abs(q).max(initial=1)) * float(np.abs(c).max(initial=1)) * max(q.shape[1], 1) < 2**53
    kind = np.float64 if exact else object
    q, c = q.astype(kind), c.astype(kind)
    edges = np.arange(0, len(c), BLOCK)
    if exact:
        top, low = np.maximum.reduceat(c, edges), np.minimum.reduceat(c, edges)
    else:
        top = np.array([c[e : e + BLOCK].max(axis=0) for e in edges], object)
        low = np.array([c[e : e + BLOCK].min(axis=0) for e in edges], object)
    bound = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bound.astype(np.float64), axis=1, kind="stable")
    for i in range(len(q)):
        ids, scores, at, visit = [], [], 0, order[i]
        while at < len(visit):
            wave = visit[at : at + WAVE]
            wave = wave[bound[i, wave] >= floor[i]]
            if not len(wave):
                break
            at += WAVE
            if scored is not None:
                scored.append(len(wave))
            rows = (edges[wave][:, None] + np.arange(BLOCK)).ravel()
            rows = rows[rows < len(c)]
            rows = rows[c_ids[rows] != q_ids[i]]
            ids.append(c_ids[rows])
            scores.append(c[rows] @ q[i])
            if sum(map(len, scores)) >= k:
                ids, scores = [np.concatenate(ids)], [np.concatenate(scores)]
                keep = np.lexsort((ids[0], -scores[0]))[:k] if exact else np.array(sorted(range(len(ids[0])), key=lambda r: (-scores[0][r], ids[0][r]))[:k])
                ids, scores = [ids[0][keep]], [scores[0][keep]]
                floor[i] = max(floor[i], scores[0][-1])
        if ids and sum(map(len, ids)):
            yield i, np.concatenate(ids), np.concatenate(scores)


def top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score for every query row; is_query: Column that tells which rows ask."""
    spark = vectors.sparkSession
    data = quantised(vectors)
    asked = cut(quantised(vectors.where(is_query)).where("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v")))
    total = asked.count()
    parts = max(1, -(-total // QUERY_BLOCK))
    # A dealt number keeps each block near QUERY_BLOCK rows; twice that is the bound.
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
    found = []
    for part in range(parts):
        rows = dealt.where(F.col("part") == part).limit(2 * QUERY_BLOCK + 1).collect() if parts > 1 else asked.collect()
        if len(rows) > 2 * QUERY_BLOCK:
            raise RuntimeError("a block of queries is larger than its bound")
        by_size: dict[int, list] = {}
        for r in rows:
            by_size.setdefault(len(r["v"]), []).append((r["vec_id"], r["v"]))
        sent = spark.sparkContext.broadcast({d: (np.array([x[0] for x in g], np.int64), np.array([x[1] for x in g], np.int64).reshape(len(g), d)) for d, g in by_size.items()})

        def run(it: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries = sent.value
            floors = {d: np.full(len(g[0]), -np.inf) for d, g in queries.items()}
            best: dict[int, list[tuple[int, int]]] = {}
            for b in it:
                for at in range(0, b.num_rows, CHUNK):
                    s = b.slice(at, CHUNK)
                    ids, lists = s.column("vec_id").to_numpy(zero_copy_only=False), s.column("v")
                    lengths = np.diff(lists.offsets.to_numpy())
                    for d, (q_ids, q) in queries.items():
                        rows = np.flatnonzero(lengths == d)
                        if not len(rows):
                            continue
                        c = lists.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), d)
                        order = arranged(c)
                        c, rows = c[order], rows[order]
                        for i, got, scores in best_of(q, q_ids, c, ids[rows], k, floors[d]):
                            held = best.setdefault(int(q_ids[i]), [])
                            held += [(-int(x), int(y)) for x, y in zip(scores, got)]
                            held.sort()
                            del held[k:]
                            if len(held) == k:
                                floors[d][i] = max(floors[d][i], -held[-1][0])
            flat = [(q, v, -s) for q, held in best.items() for s, v in held]
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in flat], pa.int64()) for n in range(3)], ["query_id", "vec_id", "score"])

        got = data.where("vec_id is not null").mapInArrow(run, "query_id long, vec_id long, score long")
        found.append(cut(got) if parts > 1 else got)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
