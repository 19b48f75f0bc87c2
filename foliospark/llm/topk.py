"""Exact top-k by block-at-a-time pruning.

A component x becomes the integer floor(64 x); the score is the inner product, which plays the part of a sum over
query terms (dimensions). Vectors are ordered by halving at the median of the widest dimension, again and again, and cut
into ranges, the blocks, so that near vectors share one. Each block keeps the largest and smallest value of every dimension, so
that a query's bound for the block is the sum of q * max (q > 0) or q * min (q < 0). A query visits blocks by falling bound
and scores through a block's forward index (its integer matrix) until the next bound falls below the k-th score so far;
blocks at that bound are scored, so ties are exact. Where vectors form no clusters (as random ones in 64 dimensions), bounds
prune little and the search is a scan.

Distribution: vectors are dealt to chunks and queries to groups by hash; a (chunk, group) pair is one task unit, and only
its best k a query leave it. Both sizes are fixed, so memory is bounded.

Cases: vectors that are null or empty, or hold null or non-finite components, take no part; vectors of different lengths
don't meet; null vec_id takes no part; a row is no candidate of a query with its own vec_id; repeated rows are candidates
each, but one query; queries that share a vec_id and differ are told apart by query_copy (0 for the first, by their vectors);
fewer than k candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K, EVERY = 20, 20
CHUNK, GROUP, BLOCK = 16_384, 4_096, 64


def quantized(vector: Column) -> Column:
    """floor(64 x) of each component, or null if the vector is unusable."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = vector.isNotNull() & F.forall(x, lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False)))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * 64).cast("long")))


def block_order(vectors: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """An order in which ranges of ``block`` rows are near each other: halves at multiples of it, by the widest dimension."""
    out, todo = np.arange(len(vectors)), [(0, len(vectors))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo > block:
            own = vectors[out[lo:hi]]
            mid = (hi - lo) // 2 // block * block or block
            values = own[:, int(own.var(0).argmax())]
            out[lo:hi] = out[lo:hi][np.argpartition(values, mid)] if mid < hi - lo else out[lo:hi]
            todo += [(lo, lo + mid), (lo + mid, hi)]
    return out


def search_chunk(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, block: int = BLOCK, visited: list | None = None) -> list[tuple[int, int, int]]:
    """(query, vec_id, score) of the k best of the chunk for each query (its place in query_ids); ties to smaller ids. ``visited`` gets the shares of blocks scored."""
    order = block_order(vectors, block)
    vectors, ids = vectors[order], ids[order]
    first = np.arange(0, len(ids), block)
    most, least = np.maximum.reduceat(vectors, first), np.minimum.reduceat(vectors, first)
    bounds = np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T
    out = []
    for place, (q, own, bound) in enumerate(zip(queries, query_ids, bounds, strict=True)):
        visit = np.argsort(-bound, kind="stable")
        scores, found = np.empty(0, np.int64), np.empty(0, np.int64)
        at, step = 0, max(1, -(-2 * k // block))
        while at < len(visit):
            if len(scores) >= k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                if bound[visit[at]] < kth:
                    break
            rows = (first[visit[at : at + step]][:, None] + np.arange(block)).ravel()
            rows = rows[rows < len(ids)]
            rows = rows[ids[rows] != own]
            scores, found = np.append(scores, vectors[rows] @ q), np.append(found, ids[rows])
            at, step = at + step, min(2 * step, 64)
            if len(scores) > 4 * k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                scores, found = scores[scores >= kth], found[scores >= kth]
        if visited is not None:
            visited.append(min(at, len(visit)) / len(visit))
        best = np.lexsort((found, -scores))[:k]
        out += [(place, int(i), int(s)) for i, s in zip(found[best], scores[best], strict=True)]
    return out


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score, query_copy) with the rows whose vec_id is divisible by ``every`` as queries."""
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantized(F.col("embedding")).alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    usable = usable.withColumn("d", F.size("v"))
    n = usable.count()
    chunks, groups = max(1, -(-n // CHUNK)), max(1, -(-n // (GROUP * every)))
    spread = lambda m, salt: F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    copy = F.row_number().over(Window.partitionBy("vec_id").orderBy("v")) - 1  # of the different vectors of one id
    queries = usable.where(F.col("vec_id") % every == 0).distinct().withColumn("copy", copy).withColumn("g", spread(groups, "g")).withColumn("c", each(chunks))
    candidates = usable.withColumn("c", spread(chunks, "c")).withColumn("g", each(groups))

    def search(own: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        rows, names = [], ["query_id", "copy", "vec_id", "score"]
        if len(own) and len(cands):
            matrix = lambda f: np.stack(f["v"].to_numpy()).astype(np.int64)
            ids, copies = own["vec_id"].to_numpy(np.int64), own["copy"].to_numpy(np.int64)
            found = search_chunk(matrix(cands), cands["vec_id"].to_numpy(np.int64), matrix(own), ids, k)
            rows = [(ids[q], copies[q], i, s) for q, i, s in found]
        return pd.DataFrame(rows, columns=names, dtype=np.int64)

    best = queries.groupBy("d", "c", "g").cogroup(candidates.groupBy("d", "c", "g")).applyInPandas(search, "query_id long, copy int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score", F.col("copy").alias("query_copy"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY v) - 1 AS INTEGER) AS query_copy FROM (SELECT DISTINCT vec_id, v FROM e WHERE vec_id % 20 = 0)
), s AS (
  SELECT q.vec_id AS query_id, query_copy, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN e c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, query_copy ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score, query_copy
FROM s QUALIFY row_number() OVER (PARTITION BY query_id, query_copy ORDER BY score DESC, vec_id) <= 20
"""
