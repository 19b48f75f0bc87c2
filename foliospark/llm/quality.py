"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades from the labels: 0 toxic, 1 poor but not toxic, 2 good. One weight vector over hashed text features is shared
by ordered thresholds: P(grade <= k) = logistic(threshold_k - w.x). Selection goes by the tail probability P(grade = 2).
Features are distinct words and runs of punctuation, hashed, and buckets of a few shape measures (case, punctuation,
repetition, length).

It is fitted on at most about ``max_rows`` labelled documents with ``max_features`` features in all, chosen by a hash of
doc_id: that bounds the rows and the bytes that reach the driver. Everything is scored.

Cases: null text counts as empty; labels without a grade or a document don't train; of several grades of one doc_id the least
counts, and of several texts one; without labels everything is kept; repeated rows and ids give a row each; other columns stay
(the result's own names, which can be chosen, replace equal ones); an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WordHashes, cut, parts, small_batches, table

BUCKETS = 1 << 18
MAX_ROWS, MAX_FEATURES = 8_000, 8_000_000
NAMES = ("expected_grade", "p_good", "keep")
GRADES = 3
_TOKENS = re.compile(r"[^\W\d_]+|[^\w\s]+")


class Features:
    def __init__(self):
        self.hashes = WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct buckets of the whole text."""
        text = text or ""
        found, total, equal, marks, last = set(), 0, 0, 0, None
        for part in parts(text):
            words = _TOKENS.findall(part.lower())
            total += len(words)
            marks += sum(not w[0].isalpha() for w in words)
            equal += sum(a == b for a, b in zip(words, [last, *words[:-1]], strict=True)) if words else 0
            last = words[-1] if words else last
            found.update(words)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        upper, lower = int(((raw >= 65) & (raw <= 90)).sum()), int(((raw >= 97) & (raw <= 122)).sum())
        share = lambda a, b: int(10 * a / max(b, 1))
        shape = [f"#upper{share(upper, upper + lower)}", f"#marks{share(marks, total)}", f"#equal{share(equal, total)}", f"#distinct{share(len(found), total)}", f"#size{total.bit_length()}"]
        return np.unique(self.hashes.of([*found, *shape]) & np.uint64(BUCKETS - 1)).astype(np.int32)


@dataclass
class Ordinal:
    """Thresholds and weights of a cumulative-link model of three grades."""

    thresholds: tuple[float, float]
    weights: np.ndarray

    def tails(self, buckets: np.ndarray) -> tuple[float, float]:
        """P(grade >= 1), P(grade >= 2)."""
        s = float(self.weights[buckets].sum())
        return tuple(float(1 / (1 + np.exp(np.clip(t - s, -40, 40)))) for t in self.thresholds)


def fit(rows: list[np.ndarray], grades: np.ndarray, steps: int = 300, rate: float = 0.1, l2: float = 1e-3, least_df: int = 3) -> Ordinal:
    """Maximum likelihood by full-batch Adam."""
    n = len(rows)
    if not n:
        return Ordinal((-40.0, -40.0), np.zeros(BUCKETS, np.float32))  # nothing known: all are kept
    idx, size = np.concatenate(rows), np.array([len(r) for r in rows])
    df = np.bincount(idx, minlength=BUCKETS)
    own = np.flatnonzero(df >= min(least_df, n))
    to = np.full(BUCKETS, len(own))
    to[own] = np.arange(len(own))
    row, col = np.repeat(np.arange(n), size), to[idx]
    row, col = row[col < len(own)], col[col < len(own)]
    below = [(np.sum(grades <= k) + 0.5) / (n + 1) for k in range(GRADES - 1)]
    t0 = np.log(below[0] / (1 - below[0]))
    p = np.zeros(len(own) + 2)  # weights, first threshold, log of the gap
    p[-2:] = t0, np.log(max(np.log(below[1] / (1 - below[1])) - t0, 0.1))
    m, v = np.zeros_like(p), np.zeros_like(p)
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    y0, y1, y2 = (grades == k for k in range(GRADES))
    for step in range(1, steps + 1):
        s = np.bincount(row, p[col], n)
        gap = np.exp(p[-1])
        lo, hi = logistic(p[-2] - s), logistic(p[-2] + gap - s)
        mid = np.maximum(hi - lo, 1e-9)
        ds = np.where(y0, 1 - lo, np.where(y1, 1 - lo - hi, -hi))
        d_lo = np.where(y0, lo - 1, np.where(y1, lo * (1 - lo) / mid, 0))
        d_hi = np.where(y1, -hi * (1 - hi) / mid, np.where(y2, hi, 0))
        g = np.append(np.bincount(col, ds[row], len(own)), [d_lo.sum() + d_hi.sum(), gap * d_hi.sum()]) / n
        g[:-2] += l2 * p[:-2]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[own] = p[:-2]
    return Ordinal((float(p[-2]), float(p[-2] + np.exp(p[-1]))), weights)


def graded(labels: DataFrame) -> DataFrame:
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.cast("int").alias("grade")).where("doc_id is not null and grade is not null")
    return own.groupBy("doc_id").agg(F.min("grade").alias("grade"))


def training_rows(docs: DataFrame, grades: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grades of a bounded sample; texts stay on the executors."""
    small_batches(docs.sparkSession)
    share = min(1.0, max_rows / max(grades.count(), 1))
    place = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30))

    def extract(batches):
        features = Features()
        for b in batches:
            got = [features(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("place"), b.column("grade"), pa.array(got, pa.binary())], ["place", "grade", "buckets"])

    sample = grades.where(place < share * (1 << 30))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")  # about max_rows rows
    own = own.groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = cut(own.select(place.alias("place"), "grade", "text").mapInArrow(extract, "place long, grade int, buckets binary"))
    total = rows.agg(F.sum(F.length("buckets"))).first()[0] or 0
    got = rows.where(F.col("place") < share * (1 << 30) * min(1.0, 4 * max_features / max(total, 1))).select("grade", "buckets").toPandas()
    order = sorted(range(len(got)), key=lambda i: (got["buckets"][i], got["grade"][i]))  # the same fit whatever the order of arrival
    return [np.frombuffer(got["buckets"][i], np.int32) for i in order], got["grade"].to_numpy(np.int64)[order]


def score(docs: DataFrame, model: Ordinal, keep_above: float = 0.5, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """The rows with the expected grade, the probability of a good one, and whether to keep them. Map-only."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    names = list(names)
    docs = docs.drop(*names)
    schema = StructType(docs.schema.fields[:]).add(names[0], "double").add(names[1], "double").add(names[2], "boolean")

    def predict(batches):
        features, own = Features(), shared.value
        for b in batches:
            tails = [own.tails(features(t)) for t in b.column("text").to_pylist()]
            good = pa.array([t[1] for t in tails], pa.float64())
            cols = [*b.columns, pa.array([sum(t) for t in tails], pa.float64()), good, pa.array([t[1] >= keep_above for t in tails], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, *names])

    return docs.mapInArrow(predict, schema)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, names: tuple[str, str, str] = NAMES) -> DataFrame:
    return score(docs, fit(*training_rows(docs, graded(labels), max_rows)), names=names)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return classify(docs, table(spark, sf_dir, "labels")).drop("text")
