"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile is the list of the most frequent character n-grams (1 to 3, letters only, words padded with a boundary).
A document's own list is compared with each language's: the distance is the sum of the rank differences, an
n-gram that the profile lacks counting the profile's length. The nearest language wins; ties go to the smaller name.

Profiles are learned from at most about ``max_docs`` training documents a language, chosen by a hash of doc_id.

Cases: null text or text without letters is ``und`` with score 0, as is every text if nothing could be learned; null
doc_id: never trained on, held_out false; repeated rows and ids give a row each; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, small_batches, table

PROFILE = 400
MAX_DOCS = 2000
_BOUND = 1


class Grams:
    """Distinct n-grams of a text as integers, with their counts."""

    def __init__(self):
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def _keys(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.full(len(code) + 2, _BOUND, np.uint64)
        c[1:-1] = np.where(self.letter[code], code + np.uint32(2), np.uint32(_BOUND))
        c = c[np.append(True, (c[1:] != _BOUND) | (c[:-1] != _BOUND))]
        if len(c) < 2:
            return c[:0]
        two = (c[:-1] << np.uint64(21)) | c[1:]
        three = ((two[:-1] << np.uint64(21)) | c[2:])[c[1:-1] != _BOUND]
        return np.concatenate([c[c != _BOUND], two, three])

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        found = [np.unique(self._keys(p), return_counts=True) for p in parts(text or "")]
        return found[0] if len(found) == 1 else add_up(*map(np.concatenate, zip(*found, strict=True)))


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, counts, len(u)).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams; equal counts by key."""
    if len(keys) > most:
        floor = np.partition(counts, len(counts) - most)[len(counts) - most]
        keys, counts = keys[counts >= floor], counts[counts >= floor]
    return keys[np.lexsort((keys, -counts))[:most]]


class Profiles:
    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.keys = np.unique(np.concatenate([np.array([2**63], np.uint64), *profiles.values()]))
        self.rank = np.full((len(self.keys), len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.keys, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def nearest(self, own: np.ndarray) -> tuple[str, float]:
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        rank = np.where((self.keys[at] == own)[:, None], self.rank[at], -1)
        far = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own))[:, None])).sum(0)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (len(own) * self.size))


def learn(train: DataFrame, max_docs: int = MAX_DOCS, size: int = PROFILE) -> Profiles:
    """From (doc_id, text, lang) rows; what reaches the driver is ``size`` n-grams a language."""
    train = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in train.groupBy("lang").count().collect()}
    if not counts:
        return Profiles({}, size)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, max_docs / n))])
    sample = train.where(F.pmod(F.xxhash64("doc_id", F.lit("profile")), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def count(batches):
        grams = Grams()
        for b in batches:
            by: dict[str, list] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                by.setdefault(lang, []).append(grams(text))
            for lang, found in by.items():
                u, n = add_up(*map(np.concatenate, zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    sums = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = sums.withColumn("r", F.row_number().over(order)).where(f"r <= {size}").orderBy("lang", "r").toPandas()
    return Profiles({str(k): g["gram"].to_numpy(np.int64).view(np.uint64) for k, g in top.groupby("lang")}, size)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of rows with doc_id, held_out, text. Map-only."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # a profile for each language

    def predict(batches):
        grams, own = Grams(), shared.value
        for b in batches:
            got = [own.nearest(ranked(*grams(t), own.size)) for t in b.column("text").to_pylist()]
            cols = [b.column("doc_id"), b.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).alias("fold")
    )
    profiles = learn(docs.where("fold != 2"))
    return identify(docs.withColumn("held_out", F.coalesce(F.col("fold") == 2, F.lit(False))), profiles)
