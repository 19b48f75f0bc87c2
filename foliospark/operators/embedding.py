"""Encoders, the embedding cache as a table, semantic search by text, and embedding in the background.

An encoder is named by a function that loads it: ``load() -> encode(list of texts) -> list of vectors``. It is called once in a Python
worker's task, not once a row or a batch. The cache is a folder of Zstandard-compressed Parquet, partitioned by model and by a range of the section
ids' hashes; an upsert rewrites the ranges that it touches, by dynamic partition overwrite, and leaves the others alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput, StorageError
from ..functions.text import sha256
from ..storage import stored
from .index import _RUN, WORDS, parts_of
from .semantic import SemanticIndex
from .vector import cache_misses, embedding_text

Encode = Callable[[list[str]], list]
Load = Callable[[], Encode]

#: Ranges of section hashes in a model's cache.
RANGES = 16
_CACHE = "section_id string, content_hash string, vector array<float>, cached_at timestamp, model string, part int"


def hashed_encoder(dims: int = 64) -> Encode:
    """A deterministic encoder without a model: each token counts in the dimension that its MD5 names. Texts with common words are near."""
    places: dict[str, list[int]] = {}  # of the tokens of a word, kept between batches up to a fixed number of words

    def places_of(run: str) -> list[int]:
        got = places.get(run)
        if got is None:
            if len(places) > WORDS:
                places.clear()
            own = (run.lower(), *(p for p, _, _ in parts_of(run)))
            got = places[run] = [int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % dims for t in own]
        return got

    def encode(texts: list[str]) -> list[np.ndarray]:
        out = np.zeros((len(texts), dims), np.float32)
        for row, text in zip(out, texts, strict=True):
            row += np.bincount([i for run in _RUN.findall(text) for i in places_of(run)], minlength=dims)
        return list(out)

    return encode


def encoder(load: Load) -> Callable[[Column], Column]:
    """The encoder as a column function; it is loaded once for all batches of a task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            yield pd.Series([np.asarray(v, np.float32) for v in encode(list(texts.fillna("")))])

    return run


@dataclass(frozen=True)
class EmbeddingCache:
    """The cache under ``path``: (section_id, content_hash, model, vector, cached_at)."""

    spark: SparkSession
    path: str

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(_CACHE).parquet(self.path).drop("part")
        except Exception as e:  # no folder yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], _CACHE).drop("part")

    def _all(self) -> DataFrame:
        return self.rows().withColumn("part", _range(F.col("section_id")))

    def _write(self, rows: DataFrame) -> None:
        rows = stored(rows.select("section_id", "content_hash", "vector", "cached_at", "model", "part"), "cache")  # read before its ranges are replaced
        rows.repartition("model", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("model", "part").parquet(self.path)

    def put(self, rows: DataFrame) -> None:
        """Upserts (section_id, content_hash, model, vector, and cached_at if there is one); of rows with equal keys one stays."""
        at = F.col("cached_at") if "cached_at" in rows.columns else F.current_timestamp()
        new = rows.select("section_id", "content_hash", "model", F.col("vector").cast("array<float>").alias("vector"), at.cast("timestamp").alias("cached_at")).dropDuplicates(["section_id", "content_hash", "model"])
        new = stored(new.withColumn("part", _range(F.col("section_id"))), "new")
        touched = new.select("model", "part").distinct()
        rest = self._all().join(touched, ["model", "part"], "left_semi").join(new.select("section_id", "content_hash", "model"), ["section_id", "content_hash", "model"], "left_anti")
        self._write(new.unionByName(rest))

    def get(self, keys: DataFrame) -> DataFrame:
        """The entries of (section_id, content_hash, model) rows."""
        return self.rows().join(keys.select("section_id", "content_hash", "model").distinct(), ["section_id", "content_hash", "model"])

    def load(self, model: str) -> DataFrame:
        return self.rows().where(F.col("model") == model).select("section_id", "content_hash", "vector")

    def remove(self, sections: DataFrame) -> None:
        """Without any entry of the sections (section_id). Their ranges are written anew; a range that would be empty keeps one row without a section."""
        gone = stored(sections.select("section_id").distinct(), "gone")
        touched = self._all().join(gone, "section_id", "left_semi").select("model", "part").distinct()
        rest = self._all().join(touched, ["model", "part"], "left_semi").join(gone, "section_id", "left_anti")
        blank = touched.select(F.lit(None).cast("string").alias("section_id"), F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("timestamp").alias("cached_at"), "model", "part")
        self._write(rest.unionByName(blank))

    def clear(self) -> None:
        """Without any entry: an empty table in place of the folder."""
        self.spark.createDataFrame([], _CACHE).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("model", "part").parquet(self.path)

    def entries(self) -> DataFrame:
        return self.rows().where("section_id is not null")

    def stats(self) -> DataFrame:
        """entries, models, raw_bytes of the vectors, file_bytes, and ratio = raw / file."""
        own = self.entries().agg(F.count("*").alias("entries"), F.countDistinct("model").alias("models"), F.coalesce(F.sum(F.size("vector") * 4), F.lit(0)).cast("long").alias("raw_bytes"))
        try:
            files = self.spark.read.schema(_CACHE).parquet(self.path).select("_metadata.file_path", "_metadata.file_size").distinct()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            files = self.spark.createDataFrame([], "file_path string, file_size long")
        size = files.agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("file_bytes")).first()[0]
        return own.withColumn("file_bytes", F.lit(size).cast("long")).withColumn("ratio", F.when(F.col("file_bytes") > 0, F.col("raw_bytes") / F.col("file_bytes")))


def _range(section: Column) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(section), F.lit(RANGES)), F.lit(0)).cast("int")


def embed_sections(sections: DataFrame, cache: EmbeddingCache, model: str, load: Load) -> int:
    """Encodes what the cache lacks of the sections (section_id, title, content) and puts it there; gives how many that were."""
    missing = stored(cache_misses(sections, cache.rows(), model), "missing")
    n = missing.count()
    if n:
        cache.put(missing.select("section_id", "content_hash", F.lit(model).alias("model"), encoder(load)(F.col("input")).alias("vector")))
    return n


def vectors_of(sections: DataFrame, cache: EmbeddingCache, model: str) -> DataFrame:
    """(id, model, vector) of the sections whose present text the cache knows."""
    text = embedding_text(F.col("title"), F.col("content"))
    keys = sections.select("section_id", sha256(text).alias("content_hash"), F.lit(model).alias("model"))
    return cache.get(keys).select(F.col("section_id").alias("id"), "model", "vector")


def search_texts(index: SemanticIndex, queries: DataFrame, model: str, load: Load | None, k: int = 10, ef: int | None = None, **options) -> DataFrame:
    """The nearest sections of each query (query_id, query), whose vectors the encoder gives; as ``SemanticIndex.search`` else."""
    if load is None:
        raise InvalidInput("no embedding model is configured")
    asked = stored(queries.select("query_id", F.lit(model).alias("model"), encoder(load)(F.col("query")).alias("vector")), "queries")
    return index.search(asked, k, ef, **options)


@dataclass(frozen=True)
class Embeddings:
    """Embedding in the background: sections arrive as Parquet files in ``source``; the cache, progress and the ready flag are under ``folder``."""

    spark: SparkSession
    source: str
    folder: str
    model: str
    load: Load

    @property
    def cache(self) -> EmbeddingCache:
        return EmbeddingCache(self.spark, f"{self.folder}/cache")

    def catch_up(self, schema: str = "section_id string, title string, content string", files: int = 64) -> None:
        """Embeds all that has arrived, in batches of files, then swaps the ready flag. Run anew after a failure, it goes on with the batch that failed."""
        self._flag(False)

        def upsert(batch: DataFrame, _: int) -> None:
            embed_sections(batch.dropDuplicates(["section_id", "title", "content"]), self.cache, self.model, self.load)

        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(self.source)
        job = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True).start()
        job.awaitTermination()
        self._flag(True)

    def _flag(self, ready: bool) -> None:
        self.spark.createDataFrame([(ready, self.model)], "ready boolean, model string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/ready")

    def ready(self) -> bool:
        try:
            return bool(self.spark.read.parquet(f"{self.folder}/ready").where(F.col("ready") & (F.col("model") == self.model)).count())
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return False

    def index(self, sections: DataFrame) -> SemanticIndex:
        """The index of the sections' vectors, as soon as all are there."""
        if not self.ready():
            raise StorageError("embeddings are still being made")
        return SemanticIndex.build(vectors_of(sections, self.cache, self.model))
