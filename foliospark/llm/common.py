"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds the rows of an Arrow batch, so that long texts don't pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Such a bound on the rows of an Arrow batch for what runs inside; the session's own holds again afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the cluster's shared folder (spark.checkpoint.dir).

    What led to it is not needed any more: a collection lets Spark's cleaner remove those shuffle files.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    done = df.checkpoint()
    del df
    gc.collect()
    sc._jvm.System.gc()
    return done


def parts(text: str, size: int = 1 << 20, gap: str = " ") -> Iterator[str]:
    """Slices of about ``size`` that each end before a gap following a non-gap; together they are the text."""
    at = 0
    while len(text) - at > size:
        cut_at = text.find(gap, at + size)
        while cut_at > 0 and text[cut_at - 1] == gap:
            cut_at = text.find(gap, cut_at + 1)
        if cut_at < 0:
            break
        yield text[at:cut_at]
        at = cut_at
    yield text[at:] if at else text


def slices(text: bytes, gap: re.Pattern, size: int = 1 << 20) -> Iterator[bytes]:
    """Slices of about ``size`` that end before a gap; together they are the text."""
    at = 0
    while len(text) - at > size:
        cut_at = gap.search(text, at + size)
        if not cut_at:
            break
        yield text[at : cut_at.start()]
        at = cut_at.start()
    yield text[at:] if at else text


#: Bits of a membership filter for each key, and its bounds: 8 KiB and 32 MiB.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28


def _bits(n: int, most: int) -> int:
    """A power of two for so many keys. Beyond ``most`` the filter lets more through; what it feeds decides exactly anyway."""
    return min(most, max(LEAST_BITS, 1 << (BITS_A_KEY * max(n, 1) - 1).bit_length()))


def filter_of(keys: DataFrame, column: str) -> np.ndarray:
    """A one-hash Bloom filter of a long column, as 64-bit words; built on the executors by bit_or, sized by the number of keys. ``keys`` is read twice."""
    keys = keys.where(F.col(column).isNotNull())
    bits = _bits(keys.count(), MOST_BITS)
    spot = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = keys.select(F.shiftright(spot, 6).alias("w"), F.expr(f"shiftleft(1L, cast(({column} & 63L) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    got = words.toPandas()  # at most a 64th of the bits
    out = np.zeros(bits // 64, np.int64)
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
    return out.view(np.uint64)


def in_filter(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    spot = keys.view(np.uint64) & np.uint64(64 * len(words) - 1)
    return (words[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1


#: Bits of the native filter at most: a table of a million 64-bit words.
MOST_NATIVE_BITS = 1 << 26


def may_hold(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose long column may be among the keys', by such a filter as a broadcast table of at most MOST_NATIVE_BITS / 64 rows; DataFrame functions only. ``keys`` is read twice."""
    bits = _bits(keys.count(), MOST_NATIVE_BITS)
    word = F.shiftrightunsigned(column, 6).bitwiseAND(F.lit(bits // 64 - 1))
    bit = F.expr(f"shiftleft(1L, cast((`{column}` & 63L) as int))")
    words = keys.where(F.col(column).isNotNull()).groupBy(word.alias("filter_word")).agg(F.bit_or(bit).alias("filter_bits"))
    held = rows.withColumn("filter_word", word).join(F.broadcast(words), "filter_word").where(F.col("filter_bits").bitwiseAND(bit) != 0)
    return held.drop("filter_word", "filter_bits")


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind them as long as the frame has such a column."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def row_with(docs: DataFrame, *columns) -> DataFrame:
    """The named columns beside ``row``, which holds all of the frame's own: no name of an input can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash; kept between batches up to a fixed number of words."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word):
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
