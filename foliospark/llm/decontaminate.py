"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased runs of word characters. Each mask of 9 places hashes the 6 words at its ones and ignores the
others, so a substituted word in an ignored place does not hide a hit. Hashes of benchmark items and of documents are
joined; hits on one diagonal (document place minus item place) are verified by aligning the whole item along it: the
stretch with the most equal words among those of at least 80 % must have 13 equal words (80 % of an item of up to 16). The
masks find 98 % or more of items of 12 words and more in which a fifth of the words was replaced at random. Items of 5 to 11
words have masks of their own length that leave out each word (each two of 10 or 11), so all that pass are found; shorter
ones are too common to tell.

Documents are first passed through a filter of the benchmark's hashes, sized by their number, so only probable hits are
shuffled; the join then decides. Each distinct text is verified once, in rows of bounded size: a hit brings the document's words
under the item, not texts. Equal documents and equal items meet their ids at the end.

Cases: null and empty texts match nothing; null ids stay null in the result; equal documents and equal items are
reported each under its id; rows that repeat an id and a text count once; extra columns are ignored; an empty table on
either side gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, cut, filter_of, in_filter, mix, row_with, small_batches, table

#: Places of the masks that count.
MASKS = ("110011101", "111110001", "100101111")
#: Items of fewer words than SHORT have masks of their own.
LEAST_WORDS, SHORT = 5, 12
LEAST_EQUAL, LEAST_SHARE = 13, 0.8
#: Hits of a text that are verified in one row, about.
HITS = 1_000
#: Words of texts that are hashed in one array, about.
PORTION = 1 << 16
#: What an unequal word scores where an equal one scores 1: a stretch of the least share has 0 or more.
UNEQUAL = -4
_WORDS = re.compile(r"\w+")
_P = np.uint64(0x9E3779B97F4A7C15)


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each place at which the mask fits."""
    n = len(words) - len(mask) + 1
    if n < 1:
        return words[:0]
    h = np.full(n, len(mask), np.uint64)
    for j, one in enumerate(mask):
        if one == "1":
            h = (h ^ words[j : j + n]) * _P
            h ^= h >> np.uint64(29)
    return mix(h)


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the stretch with the most equal words among those with a share of LEAST_SHARE; of these the shortest."""
    total = np.append(0, np.cumsum(np.where(equal, 1, UNEQUAL)))
    count = np.append(0, np.cumsum(equal))
    # for each end, the first start from which the total does not fall: where the running minimum reaches it
    start = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
    got = count - count[start]
    most = got.max()
    if not most:
        return 0, 0
    ends = np.flatnonzero(got == most)
    spots = np.flatnonzero(equal)
    first, last = spots[count[start[ends]]], spots[count[ends] - 1]
    k = int((last - first).argmin())
    return int(first[k]), int(last[k]) + 1


def own_masks(n: int) -> list[str]:
    """The masks of an item of n words: for a short one, those that leave out as many words as may differ."""
    if n >= SHORT:
        return list(MASKS)
    return ["".join("0" if k in out else "1" for k in range(n)) for out in combinations(range(n), n // 5)] if n >= LEAST_WORDS else []


def _words(text: str | None, hashes: WordHashes) -> np.ndarray:
    return hashes.of(_WORDS.findall((text or "").lower()))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_th, words, n) of the distinct texts of items; words are 64-bit hashes."""
    def hashed(batches):
        hashes = WordHashes()
        for b in batches:
            own = [_words(t, hashes) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("th"), pa.array([w.tobytes() for w in own], pa.binary()), pa.array([len(w) for w in own], pa.int64())], ["item_th", "words", "n"])

    texts = benchmark.groupBy("th").agg(F.min("text").alias("text"))
    return texts.select("th", "text").mapInArrow(hashed, "item_th long, words binary, n long").where(F.col("n") >= LEAST_WORDS)


def _item_seeds(items: DataFrame) -> DataFrame:
    """(key, item_th, n, at)."""
    def seeds(batches):
        for b in batches:
            out = [[], [], [], []]
            for th, raw, n in zip(*(b.column(c).to_pylist() for c in ("item_th", "words", "n")), strict=True):
                for mask in own_masks(n):
                    h = seed_hashes(np.frombuffer(raw, np.uint64), mask)
                    for own, new in zip(out, (h.view(np.int64).tolist(), [th] * len(h), [n] * len(h), range(len(h))), strict=True):
                        own.extend(new)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["key", "item_th", "n", "at"])

    return items.mapInArrow(seeds, "key long, item_th long, n long, at long")


def text_seeds(texts: Iterable[tuple[int, np.ndarray]], masks: list[str], keep: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Columns (th, key, pos) of the seeds in the filter, of texts (th, words): those of many texts are hashed in one array."""
    texts = iter(texts)
    while True:
        ths, own, n = [], [], 0
        for th, words in texts:
            ths.append(th)
            own.append(words)
            n += len(words)
            if n >= PORTION:
                break
        if not ths:
            return
        words, ends = np.concatenate(own), np.cumsum([len(w) for w in own])
        starts = ends - [len(w) for w in own]
        out = [[], [], []]
        for mask in masks:
            h = seed_hashes(words, mask)
            at = np.flatnonzero(in_filter(keep, h))
            text = np.searchsorted(starts, at, "right") - 1
            inside = at + len(mask) <= ends[text]
            at, text = at[inside], text[inside]
            for col, new in zip(out, (np.array(ths, np.int64)[text], h[at].view(np.int64), at - starts[text]), strict=True):
                col.append(new)
        yield [np.concatenate(c) for c in out]


def _doc_seeds(docs: DataFrame, masks: list[str], keep: np.ndarray) -> DataFrame:
    """(th, key, pos) of the seeds of texts that may be an item's; th is a hash of the text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(keep)

    def hashed(batches):
        hashes = WordHashes()
        for b in batches:
            pairs = zip(*(b.column(c).to_pylist() for c in ("th", "text")), strict=True)
            for cols in text_seeds(((th, _words(text, hashes)) for th, text in pairs), masks, shared.value):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["th", "key", "pos"])

    return docs.select("th", "text").mapInArrow(hashed, "th long, key long, pos long")


def _windows(texts: DataFrame) -> DataFrame:
    """(th, item_th, diagonal, first, words): a document's words under an item, of rows (th, text, hits)."""
    def cut_out(batches):
        hashes = WordHashes()
        for b in batches:
            rows = []
            for th, text, hits in zip(*(b.column(c).to_pylist() for c in ("th", "text", "hits")), strict=True):
                words = _words(text, hashes)
                for h in hits:
                    lo, hi = max(0, -h["diagonal"]), min(h["n"], len(words) - h["diagonal"])
                    rows.append((th, h["item_th"], h["diagonal"], lo, words[lo + h["diagonal"] : hi + h["diagonal"]].tobytes()))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], ["th", "item_th", "diagonal", "first", "own"])

    return texts.select("th", "text", "hits").mapInArrow(cut_out, "th long, item_th long, diagonal long, first long, own binary")


def _aligned(windows: DataFrame) -> DataFrame:
    """(th, item_th, start_word, n_words, n_equal) of the windows whose best stretch is long enough, of rows with the items' words."""
    def verify(batches):
        for b in batches:
            out = []
            for th, item, d, lo, own, words in zip(*(b.column(c).to_pylist() for c in ("th", "item_th", "diagonal", "first", "own", "words")), strict=True):
                x, y = np.frombuffer(own, np.uint64), np.frombuffer(words, np.uint64)
                equal = y[lo : lo + len(x)] == x
                s, e = best_stretch(equal)
                n = int(equal[s:e].sum())
                if n >= min(LEAST_EQUAL, -(-4 * len(y) // 5)):
                    out.append((th, item, lo + d + s, e - s, n))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["th", "item_th", "start_word", "n_words", "n_equal"])

    names = ["th", "item_th", "diagonal", "first", "own", "words"]
    return windows.select(*names).mapInArrow(verify, "th long, item_th long, start_word long, n_words long, n_equal long")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, th, item_id, start_word, n_words, n_equal): the best verified overlap of each document and item."""
    prepared = lambda f, c: f.select(F.col(c).cast("long").alias(c), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("th")).where("text is not null")
    docs, benchmark = prepared(docs, "doc_id"), prepared(benchmark, "item_id")
    items = cut(_items(benchmark))
    seeds = cut(_item_seeds(items))
    lengths = sorted(r[0] for r in items.where(F.col("n") < SHORT).select("n").distinct().collect())  # at most 7
    hits = _doc_seeds(docs, [*MASKS, *(m for n in lengths for m in own_masks(n))], filter_of(seeds, "key")).join(seeds, "key")
    hits = cut(hits.select("th", "item_th", "n", (F.col("pos") - F.col("at")).alias("diagonal")).distinct())
    parts = hits.groupBy("th").agg(F.ceil(F.count("*") / HITS).alias("parts"))
    dealt = hits.join(parts, "th").withColumn("part", F.pmod(F.xxhash64("item_th", "diagonal"), F.col("parts")))
    found = dealt.groupBy("th", "part").agg(F.collect_list(F.struct("item_th", "diagonal", "n")).alias("hits"))
    near = _only(docs, filter_of(hits, "th")).groupBy("th").agg(F.min("text").alias("text"))
    windows = _windows(near.join(found, "th"))
    best = _aligned(windows.join(items.select("item_th", "words"), "item_th")).groupBy("th", "item_th").agg(F.max(F.struct("n_equal", -F.col("n_words"), -F.col("start_word"))).alias("b"))
    best = cut(best.select("th", "item_th", (-F.col("b.col3")).alias("start_word"), (-F.col("b.col2")).alias("n_words"), "b.n_equal"))
    named = best.join(docs.select("doc_id", "th").distinct(), "th").join(benchmark.select("item_id", F.col("th").alias("item_th")).distinct(), "item_th")
    return named.select("doc_id", "th", "item_id", "start_word", "n_words", "n_equal")


def _only(docs: DataFrame, keep: np.ndarray) -> DataFrame:
    """The rows whose th may be in the filter: the texts of others are not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(keep)

    def passing(batches):
        for b in batches:
            yield b.filter(pa.array(in_filter(shared.value, b.column("th").to_numpy(zero_copy_only=False))))

    return docs.select("text", "th").mapInArrow(passing, "text string, th long")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents without a verified overlap, with their columns, whatever their names."""
    bad = overlaps(docs, benchmark).select(F.col("th").alias("bad")).distinct()
    rows = row_with(docs, F.xxhash64(F.col("text").cast("string")).alias("th"))
    return rows.join(bad, F.col("th") == F.col("bad"), "left_anti").select("row.*")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")
