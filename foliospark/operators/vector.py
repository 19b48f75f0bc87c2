"""Vector search over section embeddings, and the embedding cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sha256


def distance(vector: Column, query: list[float]) -> Column:
    """Euclidean, in double precision."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.sqrt(F.aggregate(F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))


def nearest(
    vectors: DataFrame, query: list[float], k: int = 10, where: Column | None = None, model: str | None = None, post_filter: bool = False, id_col: str = "section_id"
) -> DataFrame:
    """The k nearest rows with distance and score 1 / (1 + d); vectors of another length are left out.

    Filters come before the top-k, or after it with post_filter (the result may then be short).
    """
    own = vectors.where(F.size("vector") == len(query))
    if model is not None:
        own = own.where(F.col("model") == model)
    if where is not None and not post_filter:
        own = own.where(where)
    top = own.withColumn("distance", distance(F.col("vector"), query)).orderBy("distance", id_col).limit(k)
    top = top.where(where) if where is not None and post_filter else top
    return top.withColumn("score", 1 / (1 + F.col("distance")))


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest vectors (id, vector) of each query (query_id, vector), exact. For a few hundred queries: they go to every partition of the vectors."""
    asked = [(r.query_id, np.array(r.vector, np.float64)) for r in queries.select("query_id", "vector").collect()]  # the stated queries

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for d in {len(q) for _, q in asked}:
                own = f[[v is not None and len(v) == d for v in f["vector"]]]
                if not len(own):
                    continue
                ids, rows = own["id"].to_numpy(), np.stack(own["vector"].to_numpy()).astype(np.float64)
                for query, q in asked:
                    if len(q) == d:
                        far = np.sqrt(((rows - q) ** 2).sum(1))
                        best = np.lexsort((ids, far))[:k]
                        yield pd.DataFrame({"query_id": query, "id": ids[best], "distance": far[best]})

    found = vectors.select("id", F.col("vector").cast("array<float>").alias("vector")).mapInPandas(run, "query_id long, id string, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_approximate(vectors: DataFrame, query: list[float], k: int = 10, bucket: float = 2.0, tables: int = 8, id_col: str = "section_id") -> DataFrame:
    """The same by random-projection hashing; candidates are found without computing all distances."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    own = vectors.where(F.size("vector") == len(query)).withColumn("_v", array_to_vector(F.col("vector").cast("array<double>")))
    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=bucket, numHashTables=tables, seed=42).fit(own)
    found = model.approxNearestNeighbors(own, Vectors.dense(query), k, distCol="distance")
    return found.drop("_v", "_h").withColumn("score", 1 / (1 + F.col("distance"))).orderBy("distance", id_col)


def embedding_text(title: Column, content: Column) -> Column:
    return F.concat(title, F.lit("\n"), content)


def cache_misses(sections: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """(section_id, content_hash, input) of sections whose text the model's cache lacks."""
    text = embedding_text(F.col("title"), F.col("content"))
    wanted = sections.select("section_id", sha256(text).alias("content_hash"), text.alias("input"))
    return wanted.join(cache.where(F.col("model") == model), ["section_id", "content_hash"], "left_anti")


def embed(sections: DataFrame, cache: DataFrame, model: str, encode: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """The cache with the misses added; ``encode`` (a plug-in) turns texts into vectors, a batch at a time."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"section_id": f["section_id"], "content_hash": f["content_hash"], "model": model, "vector": encode(list(f["input"]))})

    added = cache_misses(sections, cache, model).mapInPandas(run, "section_id string, content_hash string, model string, vector array<float>")
    return cache.unionByName(added.withColumn("cached_at", F.current_timestamp()), allowMissingColumns=True)


def cache_put(cache: DataFrame, rows: DataFrame) -> DataFrame:
    keys = ["section_id", "content_hash", "model"]
    return cache.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def cache_get(cache: DataFrame, section_id: str, content_hash: str, model: str) -> DataFrame:
    return cache.where((F.col("section_id") == section_id) & (F.col("content_hash") == content_hash) & (F.col("model") == model))


def cache_remove(cache: DataFrame, section_id: str) -> DataFrame:
    return cache.where(F.col("section_id") != section_id)


def cache_load(cache: DataFrame, model: str) -> DataFrame:
    """All entries of a model."""
    return cache.where(F.col("model") == model).select("section_id", "content_hash", "vector")


def cache_clear(cache: DataFrame) -> DataFrame:
    return cache.limit(0)


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.countDistinct("model").alias("models"), F.coalesce(F.sum(F.size("vector") * 4), F.lit(0)).cast("long").alias("raw_bytes"))


def attach(sections: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Sections with their vectors, null where the cache has none for the present text."""
    keyed = sections.withColumn("content_hash", sha256(embedding_text(F.col("title"), F.col("content"))))
    return keyed.join(cache.where(F.col("model") == model).select("section_id", "content_hash", "model", "vector"), ["section_id", "content_hash"], "left")
