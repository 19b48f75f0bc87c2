"""Phrase collocation mining: the phrases of each language whose words stand together more often than apart.

Method: PCY/DHP hashing with Apriori pruning, a pass over the texts for each phrase length k. Pass k counts exactly the phrases of k words
that may be frequent, and counts in hash buckets the phrases of k + 1 words whose two parts of k words were candidates of this
pass. The buckets' counts are added up over all chunks; those that reach the threshold become a bitmap. A phrase is a candidate
of pass k + 1 if both its parts of k words are frequent (a filter of the exactly counted frequent phrases) and its bucket's bit
is set; words that are not frequent part phrases like separators do. These tests only let more through, never less, so counts are exact.

Sizes: bitmaps have 2 ** BUCKET_BITS bits and frequency filters at most 32 MiB, whatever the corpus; these alone are broadcast. A task
holds a chunk of CHUNK_WORDS words; long texts go on in the next chunk with the three words that a phrase may still need. A frequent
word or phrase is one row a chunk when it is shuffled. The best of a language are taken from SALTS parts, then of these.

Cases: null text is empty, null lang is `und` (as is the lang `und`); words and phrases keep what is not space, tab or a separator, so digits
and symbols are words; a row is a document, so repeated rows count each; no candidate or an empty table gives no rows;
ties in score and a go to the smaller phrase by UTF-8 bytes; scores are computed as decimals of 38 digits; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stored
from .common import arrow_batches, filter_of, in_filter, mix, slices, table

LEAST, LONGEST, BEST, SHARE, SCALE = 30, 4, 2000, 80, 2_000_000
CHUNK_WORDS, BOOK_WORDS, BUCKET_BITS, RANGE_BITS, SALTS = 2_000_000, 1_000_000, 26, 16, 64

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_GAP = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
#: Lower-case letters, one kind of separator and one of space.
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + _BREAKS + b"\t", bytes(range(97, 123)) + b"\n" * len(_BREAKS) + b" ")
_SCHEMA = "lang binary, phrase binary, h long, n long, range int, offsets binary, counts binary"


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, lower-cased, and a line feed for each separator; without a match for each, which takes several times as long."""
    out = text.translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
    return list(filter(None, out))


class _Words(dict):
    """A language's words as numbers, given when a word is first seen; 0 for separators and for words that are known not to be frequent."""

    def __init__(self, lang: bytes, book: _Book):
        super().__init__({b"\n": 0})
        self.lang, self.book = lang, book

    def __missing__(self, word: bytes) -> int:
        got = self[word] = self.book.number(self.lang, word)
        return got


class _Book:
    """The words behind the numbers of all languages, with their hashes. ``frequent``: 64-bit words of a filter that a word's hash must pass."""

    def __init__(self, frequent: np.ndarray | None = None):
        import xxhash

        self.hash = xxhash.xxh64_intdigest
        self.filter = None if frequent is None else memoryview(frequent)
        self.mask = 0 if frequent is None else 64 * len(frequent) - 1
        self.clear()

    def clear(self) -> None:
        self.of: dict[bytes, _Words] = {}
        self.words, self.langs, self.hashes, self.seen = [b""], [b""], [0], 0

    def forget(self) -> None:
        """Between chunks: numbers begin anew where too many words have been seen."""
        if self.seen > BOOK_WORDS:
            self.clear()

    def language(self, lang: bytes) -> _Words:
        own = self.of.get(lang)
        if own is None:
            own = self.of[lang] = _Words(lang, self)
        return own

    def number(self, lang: bytes, word: bytes) -> int:
        h = self.hash(lang + b"\0" + word)
        self.seen += 1
        if self.filter is not None and not self.filter[(h & self.mask) >> 6] >> (h & 63) & 1:
            return 0
        self.words.append(word)
        self.langs.append(lang)
        self.hashes.append(h)
        return len(self.words) - 1


class _Chunk:
    """A run of words as numbers, 0 between pieces."""

    def __init__(self, book: _Book):
        self.book = book
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: bytes, tokens: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.book.language(lang).__getitem__, tokens), np.int64, len(tokens)))
        self.size += len(tokens)

    def end(self) -> None:
        self.parts.append(np.zeros(1, np.int64))
        self.size += 1

    def numbers(self) -> np.ndarray:
        """All numbers, with room for a phrase behind them."""
        return np.concatenate([*self.parts, np.zeros(LONGEST, np.int64)])

    def next(self, lang: bytes) -> _Chunk:
        """The chunk after this one, with the words that phrases starting here would miss."""
        tail = self.numbers()[:-LONGEST][-(LONGEST - 1) :]
        words = [self.book.words[i] or b"\n" for i in tail]
        self.book.forget()
        out = _Chunk(self.book)
        out.add(lang, words)
        return out


def distinct_phrases(ids: np.ndarray, start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the places has each phrase of k words that starts there, one for each, and the phrase's count; exact: keys are numbered, not hashed to a value."""
    number, several = pd.factorize(ids[start])
    for j in range(1, k):
        number, several = pd.factorize(number.astype(np.int64) << 32 | ids[start + j])
    at = np.empty(len(several), np.int64)
    at[number] = np.arange(len(start))
    return at, np.bincount(number, minlength=len(several))


def _pass(k: int, words, frequent, buckets):
    """Pass k; words: the filter of frequent words, frequent: that of frequent phrases of k - 1 words, buckets: the bitmap of k words (broadcast)."""

    def counted(chunk: _Chunk, limit: int) -> Iterator[pa.RecordBatch]:
        ids, book = chunk.numbers(), chunk.book
        word_hash = np.array(book.hashes, np.uint64)

        def phrase_hash(at: np.ndarray, size: int) -> np.ndarray:
            h = word_hash[ids[at]]
            for j in range(1, size):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word_hash[ids[at + j]])
            return h

        at = np.flatnonzero(ids)
        for j in range(1, k):
            at = at[ids[at + j] > 0]
        if k > 2:  # of two words, both are frequent by their numbers
            known = np.zeros(len(ids), bool)
            parts = np.flatnonzero(ids)
            for j in range(1, k - 1):
                parts = parts[ids[parts + j] > 0]
            known[parts] = in_filter(frequent.value, phrase_hash(parts, k - 1))
            at = at[known[at] & known[at + 1]]
        h = phrase_hash(at, k)
        if k > 1:
            bucket = h >> np.uint64(64 - BUCKET_BITS)
            full = buckets.value[(bucket >> np.uint64(3)).astype(np.int64)] >> (bucket & np.uint64(7)).astype(np.uint8) & 1 == 1
            at, h = at[full], h[full]
        may = np.zeros(len(ids) + 1, bool)
        may[at] = True
        own = at < limit
        first, n = distinct_phrases(ids, at[own], k)
        place, h = at[own][first], h[own][first]
        words, langs = pa.array(book.words, pa.binary()), pa.array(book.langs, pa.binary())
        for lo in range(0, len(place), 100_000):
            some = place[lo : lo + 100_000]
            phrases = words.take(pa.array(ids[some]))
            for j in range(1, k):
                phrases = pc.binary_join_element_wise(phrases, words.take(pa.array(ids[some + j])), b" ")
            none = pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.binary())
            cols = [langs.take(pa.array(ids[some])), phrases, pa.array(h[lo : lo + 100_000].view(np.int64)), pa.array(n[lo : lo + 100_000]), *none]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "phrase", "h", "n", "range", "offsets", "counts"])
        if k < LONGEST:
            longer = at[own & may[at + 1]]
            bucket, n = np.unique((phrase_hash(longer, k + 1) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), return_counts=True)
            part = bucket >> RANGE_BITS
            first = np.flatnonzero(np.diff(part, prepend=-1))
            low, n = (bucket & (1 << RANGE_BITS) - 1).astype(np.uint16), n.astype(np.uint32)
            packed = lambda x: pa.array([y.tobytes() for y in np.split(x, first[1:])] if len(first) else [], pa.binary())
            m = len(first)
            cols = [pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(part[first], pa.int32()), packed(low), packed(n)]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "phrase", "h", "n", "range", "offsets", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk(_Book(None if words is None else words.value))
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                for piece in slices(text, _GAP):
                    chunk.add(lang, tokens(piece))
                    if chunk.size >= CHUNK_WORDS:
                        yield from counted(chunk, chunk.size - (LONGEST - 1))
                        chunk = chunk.next(lang)
                chunk.end()
        yield from counted(chunk, chunk.size)

    return run


def _bits(least: int):
    """Adds up the counts of each range of buckets, which come sorted by range; a bit for each bucket that reaches the threshold."""

    def row(part: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"range": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(sums >= least, bitorder="little").tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(1 << RANGE_BITS, np.int64)
        for b in batches:
            for part, offsets, counts in zip(*(b.column(c).to_pylist() for c in ("range", "offsets", "counts")), strict=True):
                if part != now and now is not None:
                    yield row(now, sums)
                    sums[:] = 0
                now = part
                sums[np.frombuffer(offsets, np.uint16)] += np.frombuffer(counts, np.uint32)
        if now is not None:
            yield row(now, sums)

    return run


def bucket_bitmap(made: DataFrame, least: int) -> np.ndarray:
    """2 ** BUCKET_BITS bits as bytes: a fixed size."""
    sums = made.where("range is not null").select("range", "offsets", "counts").repartition("range").sortWithinPartitions("range")
    out = np.zeros(1 << BUCKET_BITS - 3, np.uint8)
    wide = 1 << RANGE_BITS - 3
    for r in sums.mapInArrow(_bits(least), "range int, bits binary").collect():
        out[r["range"] * wide : (r["range"] + 1) * wide] = np.frombuffer(r["bits"], np.uint8)
    return out


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[list[DataFrame], DataFrame]:
    """For 1 to 4 words: the phrases (lang, phrase, h, f) with f >= least; and (lang, n), all words of a language."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).cast("binary").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    out, words, frequent, buckets, of_words = [], None, None, None, None
    for k in range(1, LONGEST + 1):
        with arrow_batches(spark):
            made = stored(texts.mapInArrow(_pass(k, of_words, frequent, buckets), _SCHEMA), f"phrases-{k}")
        counts = made.where("range is null")
        if k == 1:
            words = counts.groupBy("lang").agg(F.sum("n").alias("n"))
        f = F.sum("n").alias("f")
        out.append(stored(counts.groupBy("lang", "phrase").agg(F.min("h").alias("h"), f).where(F.col("f") >= least), f"frequent-{k}"))
        if k < LONGEST:
            frequent = spark.sparkContext.broadcast(filter_of(out[-1], "h"))
            of_words = of_words or frequent
            buckets = spark.sparkContext.broadcast(bucket_bitmap(made, least))
    return out, words


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    tables, words = frequent_phrases(docs, least)
    lengths = [t.select(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), "f", F.lit(k + 1).alias("k")) for k, t in enumerate(tables)]
    whole = lengths[1].unionByName(lengths[2]).unionByName(lengths[3])
    split = F.split("phrase", " ", -1)
    part = lambda at, size: F.array_join(F.slice(split, at, size), " ")

    # both parts of every cut meet their counts in one join; parts of a frequent phrase are frequent
    side = lambda j, left: F.struct(j.alias("cut"), F.lit(left).alias("is_left"), (part(F.lit(1), j) if left else part(j + 1, F.col("k") - j)).alias("part"))
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda j: F.array(side(j, True), side(j, False))))
    each = whole.select("lang", "phrase", F.col("f").alias("a"), F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    parts = lengths[0].unionByName(lengths[1]).unionByName(lengths[2]).select("lang", F.col("phrase").alias("part"), "f")
    by_cut = each.join(parts, ["lang", "part"]).groupBy("lang", "phrase", "a", "cut").agg(F.sum(F.expr("if(is_left, f, 0)")).alias("l"), F.sum(F.expr("if(is_left, 0, f)")).alias("r"))
    score = F.expr(f"cast({SCALE} as decimal(10,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = by_cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))

    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda at: part(at, m))))
    longer = whole.where("k > 2").select("lang", F.explode(inside).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < SHARE * F.col("a")))
    flat = left.select("lang", "phrase", "a", "low.l", "low.r", "low.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    some = flat.withColumn("rank", rank("lang", "salt")).where(F.col("rank") <= best)
    top = some.withColumn("rank", rank("lang")).where(F.col("rank") <= best).drop("salt")
    own = words.select(F.col("lang").cast("string").alias("lang"), "n")
    return top.join(own, "lang").select("lang", F.col("rank").cast("int").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM i, range(1, 5) t(k) WHERE i + k - 1 <= len(w)) GROUP BY ALL
), c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS s, f AS a FROM f WHERE k >= 2 AND f >= 30
), cut AS (
  SELECT c.lang, c.phrase, c.a, j, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.a) // (l.f + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(s[1:j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(s[j + 1:], ' ')
), low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), sub AS (
  SELECT lang, phrase, max(a) AS longer FROM (SELECT c.lang, c.a, array_to_string(s[x.at:x.at + m.m - 1], ' ') AS phrase FROM c, range(2, 4) m(m), range(1, 4) x("at") WHERE m.m < k AND x.at + m.m - 1 <= k) GROUP BY ALL
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY ALL)
SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, phrase)::INTEGER AS rank, phrase, a, l, r, n.n, score
FROM low LEFT JOIN sub USING (lang, phrase) JOIN n ON n.lang = low.lang
WHERE longer IS NULL OR 100 * longer < 80 * a
QUALIFY rank <= 2000
"""
