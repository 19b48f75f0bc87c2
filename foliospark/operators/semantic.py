"""Approximate nearest neighbours of section vectors: a neighbour graph for each cell of vectors, searched by beam.

Vectors are dealt to cells by a hash of their id. A cell is one row: its ids, its matrix, and for every vector the places of its near
neighbours, with edges back and a few far ones. A query walks each cell's graph from the nearest of its entry points and keeps the
``ef`` best it has seen; the cells' k best are merged. How wide that beam must be lies with the vectors, so a cell is searched when it is
made, with points between its vectors as queries, and keeps the width that found RECALL of the exact nearest. Every cell is asked, so no vector is out of reach by where it lies.

Changes go to new segments: added vectors get cells of their own, removed or replaced ids are tombstones of the segments before. When
these outweigh MERGE of the first segment, all living vectors are dealt anew. Segments and tombstones are stored tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Vectors of a cell; neighbours and edges in all of a vector; far edges; the least beam; share of changes before a merge.
CELL, NEAR, EDGES, FAR, LEAST_EF, MERGE = 8192, 16, 32, 4, 100, 0.25
#: The share of the TRIED_K nearest of 2 * TRIALS queries that a cell's beam must find.
RECALL, TRIALS, TRIED_K = 0.98, 16, 10
#: Bytes of query vectors that are broadcast; beyond it queries and cells meet in a shuffle.
BROADCAST = 16 << 20

_CELLS = "cell int, d int, ids array<string>, models array<string>, vectors binary, edges binary, beam int"


def squared(vectors: np.ndarray, norms: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of each q (rows) to each vector, by one product."""
    return np.maximum(norms[None, :] - 2 * (q @ vectors.T) + (q * q).sum(1)[:, None], 0)


def neighbour_graph(vectors: np.ndarray, seed: int = 7) -> np.ndarray:
    """For each vector the places of up to EDGES others, -1 where there are fewer: its nearest, those that it is near to, some far ones."""
    n = len(vectors)
    edges = np.full((n, EDGES), -1, np.int32)
    if n < 2:
        return edges
    norms = (vectors * vectors).sum(1)
    k = min(NEAR, n - 1)
    near = np.empty((n, k), np.int64)
    for lo in range(0, n, 512):
        d = squared(vectors, norms, vectors[lo : lo + 512])
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        some = np.argpartition(d, k - 1, axis=1)[:, :k]
        near[lo : lo + 512] = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)
    edges[:, :k] = near
    used = np.full(n, k)
    back = np.argsort(np.tile(np.arange(k), (n, 1)).ravel(), kind="stable")  # the nearest get their edge back first
    heads, tails = near.ravel()[back], np.repeat(np.arange(n), k)[back]
    order = np.argsort(heads, kind="stable")
    heads, tails = heads[order], tails[order]
    place = np.arange(len(heads)) - np.searchsorted(heads, heads)
    room = place < EDGES - FAR - k
    edges[heads[room], k + place[room]] = tails[room]
    used = np.minimum(k + np.bincount(heads, minlength=n), EDGES - FAR)
    far = np.random.default_rng(seed).integers(0, n, (n, FAR))
    edges[np.arange(n)[:, None], used[:, None] + np.arange(FAR)] = far
    return edges


def beam(vectors: np.ndarray, norms: np.ndarray, edges: np.ndarray, alive: np.ndarray, q: np.ndarray, k: int, ef: int, visited: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and squared distances of about the k nearest living vectors; ``visited`` gets the number of distances taken."""
    n = len(vectors)
    entries = np.unique(np.linspace(0, n - 1, min(n, max(64, 4 * int(n**0.5)))).astype(np.int64))
    seen = np.zeros(n, bool)
    seen[entries] = True
    dist = squared(vectors[entries], norms[entries], q[None, :])[0]
    best = np.argsort(dist, kind="stable")[:ef]
    pool, dist, done = entries[best], dist[best], np.zeros(len(best), bool)
    taken = len(entries)
    while True:
        todo = np.flatnonzero(~done)[:8]
        if not len(todo):
            break
        done[todo] = True
        new = np.unique(edges[pool[todo]])
        new = new[new >= 0]
        new = new[~seen[new]]
        if not len(new):
            continue
        seen[new] = True
        taken += len(new)
        near = squared(vectors[new], norms[new], q[None, :])[0]
        pool, dist, done = np.concatenate([pool, new]), np.concatenate([dist, near]), np.concatenate([done, np.zeros(len(new), bool)])
        keep = np.argsort(dist, kind="stable")[:ef]
        pool, dist, done = pool[keep], dist[keep], done[keep]
    if visited is not None:
        visited.append(taken)
    live = alive[pool]
    return pool[live][:k], dist[live][:k]


def walk(vectors: np.ndarray, norms: np.ndarray, edges: np.ndarray, alive: np.ndarray, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest that a beam has seen; equal distances in the order of places."""
    at, _ = beam(vectors, norms, edges, alive, q, ef, ef)
    exact = np.sqrt(((vectors[at] - q) ** 2).sum(1))
    best = np.lexsort((at, exact))[:k]
    return at[best], exact[best]


def beam_of(vectors: np.ndarray, edges: np.ndarray, seed: int = 11) -> int:
    """The beam's width, in doublings of LEAST_EF, that finds RECALL of the nearest of points halfway between two vectors and of means of many."""
    n, r = len(vectors), np.random.default_rng(seed)
    norms, alive, k = (vectors * vectors).sum(1), np.ones(n, bool), min(TRIED_K, n)
    asked = np.stack([vectors[r.integers(0, n, m)].mean(0) for m in (2, 64) for _ in range(TRIALS)])
    exact = [set(np.argsort(((vectors - q) ** 2).sum(1), kind="stable")[:k]) for q in asked]
    ef = LEAST_EF
    while ef < n and sum(len(near.intersection(walk(vectors, norms, edges, alive, q, k, ef)[0])) for q, near in zip(asked, exact, strict=True)) < RECALL * k * len(asked):
        ef *= 2
    return min(ef, n)


def _build(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
    f = f.sort_values("id", kind="stable")
    vectors = np.stack(f["vector"].to_numpy()).astype(np.float32)
    wide = vectors.astype(np.float64)
    edges = neighbour_graph(wide)
    row = {"cell": key[0], "d": key[1], "ids": list(f["id"]), "models": list(f["model"]), "vectors": vectors.tobytes(), "edges": edges.tobytes(), "beam": beam_of(wide, edges)}
    return pd.DataFrame([row])


def _search(row: dict, query_ids: np.ndarray, queries: np.ndarray, k: int, ef: int) -> pd.DataFrame:
    ids, d = row["ids"], row["d"]
    vectors = np.frombuffer(row["vectors"], np.float32).reshape(len(ids), d).astype(np.float64)
    edges, norms = np.frombuffer(row["edges"], np.int32).reshape(len(ids), EDGES), (vectors * vectors).sum(1)
    dead = set(row["dead"] if row["dead"] is not None else ())
    alive = np.array([i not in dead for i in ids]) if dead else np.ones(len(ids), bool)
    out, ef = [], max(ef, row["beam"] * -(-k // TRIED_K)) + len(dead)
    for q, v in zip(query_ids, queries, strict=True):
        at, exact = walk(vectors, norms, edges, alive, v, k, ef)
        out += [(int(q), ids[i], row["models"][i], float(x)) for i, x in zip(at, exact, strict=True)]
    return pd.DataFrame(out, columns=["query_id", "id", "model", "distance"])


_FOUND = "query_id long, id string, model string, distance double"


@dataclass
class SemanticIndex:
    """Segments of cells (segment, cell, ...), the vectors they were made from (segment, id, model, vector), tombstones (segment, id), rows of each segment."""

    cells: DataFrame
    vectors: DataFrame
    gone: DataFrame | None
    sizes: tuple[tuple[int, int], ...]  # rows and cells of each segment
    changed: int = 0

    @classmethod
    def build(cls, vectors: DataFrame, cell: int = CELL) -> SemanticIndex:
        """From (id, vector, and model if there is one); rows with null or empty vectors take no part."""
        cells, own, size = cls._segment(vectors, 0, cell)
        return cls(cells, own, None, (size,))

    @staticmethod
    def _segment(vectors: DataFrame, number: int, cell: int) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
        model = F.col("model").cast("string") if "model" in vectors.columns else F.lit(None).cast("string")
        own = vectors.select(F.lit(number).alias("segment"), F.col("id").cast("string").alias("id"), model.alias("model"), F.col("vector").cast("array<float>").alias("vector"))
        own = stored(own.where("id is not null and vector is not null and size(vector) > 0"), "vectors")
        n = own.count()
        parts = max(1, -(-n // cell))
        dealt = own.withColumn("cell", _cell(F.lit(parts))).withColumn("d", F.size("vector"))
        cells = dealt.groupBy("cell", "d").applyInPandas(_build, _CELLS).withColumn("segment", F.lit(number))
        return stored(cells, "cells"), own, (n, parts)

    def replace(self, gone: DataFrame | None = None, vectors: DataFrame | None = None, cell: int = CELL) -> SemanticIndex:
        """Without the ids of ``gone`` (id); with those of ``vectors``, which replace rows of the same ids. Only these are indexed."""
        last = len(self.sizes)
        dead = gone.select(F.col("id").cast("string").alias("id")) if gone is not None else None
        if vectors is not None:
            new = vectors.select(F.col("id").cast("string").alias("id"))
            dead = new if dead is None else dead.unionByName(new)
        if dead is None:
            return self
        # a tombstone counts for all segments so far
        dead = dead.where("id is not null").distinct().select(F.explode(F.sequence(F.lit(0), F.lit(last - 1))).alias("segment"), "id")
        dead = stored(dead if self.gone is None else self.gone.unionByName(dead).distinct(), "tombstones")
        cells, own, sizes = self.cells, self.vectors, self.sizes
        if vectors is not None:
            added, rows, size = self._segment(vectors, last, cell)
            cells, own, sizes = cells.unionByName(added), own.unionByName(rows), (*sizes, size)
        grown = SemanticIndex(cells, own, dead, sizes)
        changes = sum(n for n, _ in sizes[1:]) + dead.select("id").distinct().count()
        return grown if changes <= MERGE * max(1, sizes[0][0]) else SemanticIndex.build(grown.living().drop("segment"), cell)

    def living(self) -> DataFrame:
        return self.vectors if self.gone is None else self.vectors.join(self.gone, ["segment", "id"], "left_anti")

    def _cells(self) -> DataFrame:
        """The cells with the ids that are gone from each."""
        if self.gone is None:
            return self.cells.withColumn("dead", F.lit(None).cast("array<string>"))
        parts = F.element_at(F.array(*[F.lit(p) for _, p in self.sizes]), F.col("segment") + 1)
        dead = self.gone.withColumn("cell", _cell(parts)).groupBy("segment", "cell").agg(F.collect_list("id").alias("dead"))
        return self.cells.join(dead, ["segment", "cell"], "left")

    def search(
        self, queries: DataFrame, k: int = 10, ef: int | None = None, sections: DataFrame | None = None, where: Column | None = None, same_model: bool = False
    ) -> DataFrame:
        """(query_id, rank, id, distance, score) of the nearest vectors of each query (query_id, vector, and model if asked for).

        ``sections`` (id and more) is joined to the k nearest; ``where`` over its columns and same_model act after the top k, so fewer may be left.
        """
        k, ef = max(k, 1), max(ef or max(2 * max(k, 1), LEAST_EF), k)
        model = "model" if "model" in queries.columns else F.lit(None).cast("string").alias("model")
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"), model).where("query_id is not null and size(vector) > 0")
        size = asked.agg(F.coalesce(F.sum(F.size("vector") * 8 + 64), F.lit(0))).first()[0]
        found = self._broadcast_search(asked, k, ef) if size <= BROADCAST else self._shuffled_search(asked, k, ef, -(-size // BROADCAST))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        top = found.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", 1 / (1 + F.col("distance")))
        if same_model:
            top = top.join(asked.select("query_id", F.col("model").alias("asked")), "query_id").where(F.col("model").eqNullSafe(F.col("asked")))
        top = top.select("query_id", "rank", "id", "distance", "score")
        if sections is not None:
            top = top.join(sections, "id")
        return top if where is None else top.where(where)

    def _broadcast_search(self, asked: DataFrame, k: int, ef: int) -> DataFrame:
        by_size: dict[int, list] = {}
        for r in asked.collect():  # at most BROADCAST bytes
            by_size.setdefault(len(r.vector), []).append(r)
        held = asked.sparkSession.sparkContext.broadcast({d: (np.array([r.query_id for r in rows]), np.array([r.vector for r in rows], np.float64)) for d, rows in by_size.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    row = b.slice(i, 1).to_pylist()[0]
                    if row["d"] in held.value:
                        yield pa.RecordBatch.from_pandas(_search(row, *held.value[row["d"]], k, ef), schema=pa.schema([("query_id", pa.int64()), ("id", pa.string()), ("model", pa.string()), ("distance", pa.float64())]))

        return self._cells().drop("segment").mapInArrow(run, _FOUND)

    def _shuffled_search(self, asked: DataFrame, k: int, ef: int, groups: int) -> DataFrame:
        """Queries in groups of about BROADCAST bytes, each group to every cell of its vectors' length."""
        places = self.cells.select("segment", "cell", "d").distinct().toDF("q_segment", "q_cell", "q_d")
        dealt = asked.join(places, F.size("vector") == F.col("q_d")).withColumn("q_g", F.pmod(F.xxhash64("query_id"), F.lit(groups)))

        def run(qs: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
            if not len(qs) or not len(cells):
                return pd.DataFrame({"query_id": [], "id": [], "model": [], "distance": []})
            return _search(cells.iloc[0].to_dict(), qs["query_id"].to_numpy(), np.stack(qs["vector"].to_numpy()), k, ef)

        cells = self._cells().withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        keys = ["segment", "cell", "d", "g"]
        return dealt.groupBy(*[f"q_{k}" for k in keys]).cogroup(cells.groupBy(*keys)).applyInPandas(run, _FOUND)


def _cell(parts: Column) -> Column:
    return F.pmod(F.xxhash64("id"), parts).cast("int")
