"""Source divergence audit: how far the word use of each source is from that of the other sources and of its language.

Method: sort-based streaming. Every chunk of documents is sorted by (lang, term, source, document) and scanned into runs: one row
for each (lang, term, source), with the documents and occurrences of the run. The runs are dealt by (lang, term) and sorted again by
(lang, term, source, document); a scan of run lengths adds them up, so that document frequency and counts are known where
a term's run ends, and only terms of enough documents go on (the terms lead this sort, since their first bytes tell rows apart faster). A second scan over the kept terms, again sorted, emits for each
bucket of terms one partial sum for each pair of sources and the best terms of each source; these are added up and ranked.

Sizes: what a task holds is a chunk of CHUNK_TERMS distinct (document, term) pairs, the sources of one term, or TILE x TILE sums. A
frequent term is one row for each chunk and source when it is shuffled. The totals of a language's sources reach the
terms as rows that sort before them, so nothing is broadcast. Sources beyond TILE in a language are dealt to tiles; pairs of
sources are the result itself. A pair's sum starts from the case that both lack a term and is corrected for terms that either has,
so terms cost their sources, not all sources.

Cases: null text, lang and source are empty strings; a row is a document, so repeated rows count each and doc_id may be null;
a language without kept terms has pairs with value 0; a lone source has no pairs; an empty table gives no rows; values are 64-bit
integers, products beyond that are Python integers; other columns are ignored. Long texts are read in slices that end outside words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stored
from .common import arrow_batches, slices, table

LEAST_DOCS, TOP = 30, 50
SCALE, SMOOTH = 1_000_000_000, 5
#: Distinct (document, term) pairs of a chunk; sources of a tile; entries (term, source) of a bucket, and the least number of buckets.
CHUNK_TERMS, TILE, ENTRIES, LEAST_BUCKETS = 2_000_000, 1024, 1_000_000, 64
#: Entries of the working matrices.
CELLS = 4_000_000

# Of UTF-8 bytes with lower-case A-Z: ASCII letters and whatever is not ASCII.
_TERM, _GAP = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")


class _Terms(dict):
    """A language's terms as numbers, given when a term is first seen."""

    def __init__(self, lang: bytes, terms: list[bytes], langs: list[bytes]):
        super().__init__()
        self.lang, self.terms, self.langs = lang, terms, langs

    def __missing__(self, term: bytes) -> int:
        got = self[term] = len(self.terms)
        self.terms.append(term)
        self.langs.append(self.lang)
        return got


class _Chunk:
    """Documents whose (document, term) counts are collected, then sorted and scanned into runs."""

    def __init__(self):
        self.ids: dict[bytes, _Terms] = {}
        self.terms: list[bytes] = []
        self.sources: dict[bytes, int] = {}
        self.groups: dict[tuple[bytes, bytes], None] = {}
        self.langs: list[bytes] = []
        self.docs, self.docs_source = [], []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, doc: int | None, lang: bytes, source: bytes, text: bytes) -> None:
        vocabulary = self.ids.get(lang)
        if vocabulary is None:
            vocabulary = self.ids[lang] = _Terms(lang, self.terms, self.langs)
        own: list[np.ndarray] = []
        for piece in slices(text.lower(), _GAP):
            words = _TERM.findall(piece)
            own.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
        found, n = np.unique(np.concatenate(own), return_counts=True)
        self.groups[lang, source] = None
        self.docs.append(doc)
        self.docs_source.append(self.sources.setdefault(source, len(self.sources)))
        self.parts.append((found, n))
        self.size += len(found)

    def runs(self) -> pa.RecordBatch:
        """Rows (lang, term, source, document, df, n) by lang, term and source; each group also has one with an empty term."""
        term = np.concatenate([t for t, _ in self.parts])
        n = np.concatenate([n for _, n in self.parts])
        doc = np.repeat(np.arange(len(self.parts)), [len(t) for t, _ in self.parts])
        key = term * len(self.sources) + np.array(self.docs_source, np.int64)[doc]
        order = np.argsort(key, kind="stable")  # documents stay in order: a term id belongs to one language
        key, n, doc = key[order], n[order], doc[order]
        start = np.flatnonzero(np.diff(key, prepend=-1))
        term, source = key[start] // len(self.sources), key[start] % len(self.sources)
        pick = lambda values, at: pa.array(values, pa.binary()).take(pa.array(at))
        groups, blank = list(self.groups), len(self.groups)
        runs = [
            pa.concat_arrays([pick(self.langs, term), pa.array([g[0] for g in groups], pa.binary())]),
            pa.concat_arrays([pick(self.terms, term), pa.array([b""] * blank, pa.binary())]),
            pa.concat_arrays([pick(list(self.sources), source), pa.array([g[1] for g in groups], pa.binary())]),
            pa.concat_arrays([pa.array(self.docs, pa.int64()).take(pa.array(doc[start])), pa.nulls(blank, pa.int64())]),
            pa.array(np.concatenate([np.diff(start, append=len(key)), np.zeros(blank, np.int64)])),
            pa.array(np.concatenate([np.add.reduceat(n, start) if len(start) else n, np.zeros(blank, np.int64)])),
        ]
        return pa.RecordBatch.from_arrays(runs, ["lang", "term", "source", "document", "df", "n"])


_RUNS = "lang binary, term binary, source binary, document long, df long, n long"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk = _Chunk()
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "lang", "source", "text")), strict=True):
            chunk.add(*row)
            if chunk.size >= CHUNK_TERMS or len(chunk.docs) >= CHUNK_TERMS:
                yield chunk.runs()
                chunk = _Chunk()
    if chunk.docs:
        yield chunk.runs()


def changes(t: pa.Table, names: list[str]) -> np.ndarray:
    """Where a run of equal values of the columns begins."""
    new = np.zeros(len(t), bool)
    new[:1] = True
    for c in names:
        col = t.column(c)
        new[1:] |= pc.not_equal(col.slice(1), col.slice(0, len(t) - 1)).to_numpy()
    return np.flatnonzero(new)


def _folded(t: pa.Table) -> pa.Table:
    """The runs of a (lang, term, source) as one."""
    at = changes(t, ["lang", "term", "source"])
    if len(at) == len(t):
        return t
    out = t.take(pa.array(at))
    for c in ("df", "n"):
        out = out.set_column(out.schema.get_field_index(c), c, pa.array(np.add.reduceat(t.column(c).to_numpy(), at)))
    return out


def _kept(least: int):
    """Scans sorted runs; gives (lang, term, source, n, total, first) of terms in at least so many documents of the language."""

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not len(t):
            return
        t = _folded(t)
        at = changes(t, ["lang", "term"])
        size = np.diff(at, append=len(t))
        df, n = (np.add.reduceat(t.column(c).to_numpy(), at) for c in ("df", "n"))
        keep = np.repeat((df >= least) | (pc.binary_length(t.column("term")).to_numpy()[at] == 0), size)
        first = np.zeros(len(t), bool)
        first[at] = True
        out = pa.table({c: t.column(c) for c in ("lang", "term", "source", "n")} | {"total": pa.array(np.repeat(n, size)), "first": pa.array(first)})
        yield from out.filter(pa.array(keep)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            last = changes(t, ["lang", "term"])[-1]
            yield from done(t.slice(0, last))
            rest = _folded(t.slice(last).combine_chunks())  # at most a row for each source
        if rest is not None:
            yield from done(rest)

    return run


def smoothed(n: np.ndarray, of: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 5) / (of + 5 * terms)), exact."""
    if not terms:
        return np.zeros(len(n), np.int64)
    wide = len(n) and max(int(np.max(n)), int(np.max(of)) + SMOOTH * terms) > (1 << 62) // SCALE
    n, of = (np.asarray(x, object if wide else np.int64) for x in (n, of))
    return np.asarray(1 + SCALE * (n + SMOOTH) // (of + SMOOTH * terms), np.int64)


class _Group:
    """The terms of one bucket in one language, against the totals of its sources; of one tile of sources against another."""

    def __init__(self, bucket: int, lang: bytes, same: bool, top: int):
        self.bucket, self.lang, self.same, self.top = bucket, lang, same, top
        self.heads: list[pa.Table] = []
        self.rest: pa.Table | None = None
        self.sums = None

    def _open(self) -> None:
        t = pa.concat_tables(self.heads).combine_chunks()
        self.sources = t.column("source").combine_chunks()
        self.n, self.in_a, self.in_b = t.column("n").to_numpy(), t.column("in_a").to_numpy(), t.column("in_b").to_numpy()
        self.terms, self.lang_n = t.column("total")[0].as_py(), t.column("lang_n")[0].as_py()
        self.a, self.b = np.flatnonzero(self.in_a), np.flatnonzero(self.in_b)
        self.z = smoothed(np.zeros(len(self.n), np.int64), self.n, self.terms)
        self.base = np.abs(self.z[self.a][:, None] - self.z[self.b][None, :])
        self.sums = self.base * self.terms if self.bucket == 0 else np.zeros_like(self.base)
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), pa.array([], pa.binary()))

    def feed(self, t: pa.Table) -> None:
        heads = int((t.column("kind").to_numpy() == 0).sum())
        if heads:
            self.heads.append(t.slice(0, heads))
            t = t.slice(heads)
        if not len(t):
            return
        if self.sums is None:
            self._open()
        t = pa.concat_tables([self.rest, t]) if self.rest is not None else t
        at = changes(t, ["term"])
        self.rest = t.slice(at[-1]).combine_chunks()
        most = max(1, CELLS // len(self.n))
        for k in range(0, len(at) - 1, most):
            self._add(t.slice(at[k], at[min(k + most, len(at) - 1)] - at[k]))

    def _add(self, t: pa.Table) -> None:
        at = changes(t, ["term"])
        term = np.repeat(np.arange(len(at)), np.diff(at, append=len(t)))
        source = pc.index_in(t.column("source"), value_set=self.sources).to_numpy()
        p = smoothed(t.column("n").to_numpy(), self.n[source], self.terms)
        present = np.zeros((len(at), len(self.n)), bool)
        value = np.tile(self.z, (len(at), 1))
        present[term, source], value[term, source] = True, p
        here_b = value[:, self.b]
        for i, a in enumerate(self.a):  # terms that a has, against all of b
            own = term[source == a]
            if len(own):
                self.sums[i] += np.abs(here_b[own] - value[own, a][:, None]).sum(0) - len(own) * self.base[i]
        for j, b in enumerate(self.b):  # terms that b has and a lacks
            own = term[source == b]
            if len(own):
                less = np.abs(self.z[self.a] - value[own, b][:, None]) - self.base[:, j]
                self.sums[:, j] += np.where(present[own][:, self.a], 0, less).sum(0)
        if self.same:
            over = p - smoothed(t.column("total").to_numpy(), np.int64(self.lang_n), self.terms)
            some = np.flatnonzero((over > 0) & self.in_a[source])
            s, v = np.append(self.best[0], source[some]), np.append(self.best[1], over[some])
            words = pa.concat_arrays([self.best[2], t.column("term").combine_chunks().take(pa.array(some))])
            order = np.lexsort((-v, s))  # stable: words come in their own order
            s, v = s[order], v[order]
            begin = np.flatnonzero(np.diff(s, prepend=-1))
            keep = np.arange(len(s)) - np.repeat(begin, np.diff(begin, append=len(s))) < self.top
            self.best = (s[keep], v[keep], words.take(pa.array(order[keep])))

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.sums is None:
            self._open()
        if self.rest is not None:
            self._add(self.rest)
        for i, a in enumerate(self.a):
            if not self.terms and self.bucket:
                break
            other = self.b[self.b != a]
            if self.bucket == 0 or self.sums[i].any():
                yield self._batch(np.full(len(other), a), "pair", self.sources.take(pa.array(other)), self.sums[i][self.b != a])
        if self.same and len(self.best[0]):
            yield self._batch(self.best[0], "term", self.best[2], self.best[1])

    def _batch(self, source: np.ndarray, part: str, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
        whole = [pa.array([self.lang] * len(value), pa.binary()), self.sources.take(pa.array(source)), pa.array([part] * len(value), pa.string()), item, pa.array(value, pa.int64())]
        return pa.RecordBatch.from_arrays(whole, ["lang", "source", "part", "item", "value"])


def _partials(top: int):
    """Scans totals and kept terms, sorted by bucket, tiles, language, kind, term and source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key = None, None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            at = [*changes(t, ["bucket", "ta", "tb", "lang"]), len(t)]
            for lo, hi in zip(at, at[1:]):
                now = tuple(t.column(c)[lo].as_py() for c in ("bucket", "ta", "tb", "lang"))
                if now != key:
                    if group:
                        yield from group.rows()
                    group, key = _Group(now[0], now[3], now[1] == now[2], top), now
                group.feed(t.slice(lo, hi - lo))
        if group:
            yield from group.rows()

    return run


def _tiled(df: DataFrame, tiles: int) -> DataFrame:
    """Each row to the pairs of tiles (ta, tb) that its source is in, with in_a and in_b."""
    tile = F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int")
    every = F.sequence(F.lit(0), F.lit(tiles - 1))
    pair = lambda a, b: F.struct(a.alias("ta"), b.alias("tb"))
    pairs = F.concat(F.transform(every, lambda j: pair(F.col("tile"), j)), F.transform(F.filter(every, lambda j: j != F.col("tile")), lambda j: pair(j, F.col("tile"))))
    out = df.withColumn("tile", tile).withColumn("tiles", F.explode(pairs)).select(*df.columns, "tile", "tiles.ta", "tiles.tb")
    return out.withColumn("in_a", F.col("tile") == F.col("ta")).withColumn("in_b", F.col("tile") == F.col("tb")).drop("tile")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    spark = docs.sparkSession
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain("lang"), plain("source"), plain("text"))
    with arrow_batches(spark):
        runs = rows.mapInArrow(_chunks, _RUNS).repartition("lang", "term").sortWithinPartitions("term", "lang", "source", "document")
        kept = stored(runs.mapInArrow(_kept(least_docs), "lang binary, term binary, source binary, n long, total long, first boolean"), "kept-terms")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(F.count_if(F.col("first") & (F.length("term") > 0)).alias("total"), F.sum("n").alias("lang_n"))
    totals = stored(groups.join(langs, "lang"), "totals")
    size = totals.groupBy("lang").agg(F.count("*").alias("sources")).agg(F.max("sources")).first()[0] or 0
    terms = kept.where(F.length("term") > 0)
    tiles, buckets = max(1, -(-size // TILE)), max(LEAST_BUCKETS, -(-terms.count() // ENTRIES))

    bucket: Column = F.pmod(F.xxhash64("lang", "term"), F.lit(buckets)).cast("int")
    none = F.lit(b"")
    heads = totals.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "lang", F.lit(0).alias("kind"), none.alias("term"), "source", "n", "total", "lang_n")
    own = terms.select(bucket.alias("bucket"), "lang", F.lit(1).alias("kind"), "term", "source", "n", "total", F.lit(0).cast("long").alias("lang_n"))
    dealt = _tiled(heads.unionByName(own), tiles).repartition("bucket", "ta", "tb").sortWithinPartitions("bucket", "ta", "tb", "lang", "kind", "term", "source")
    partial = dealt.mapInArrow(_partials(top), "lang binary, source binary, part string, item binary, value long")
    whole = partial.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    text = lambda c: F.col(c).cast("string").alias(c)
    return whole.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top)).select(text("lang"), text("source"), "part", text("item"), "value", F.col("rank").cast("int").alias("rank"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), tf AS (
  SELECT lang, source, d, term, count(*) AS n
  FROM (SELECT lang, source, d, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs) GROUP BY ALL
), kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM tf GROUP BY ALL HAVING count(*) >= 30
), size AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY ALL
), g AS (SELECT DISTINCT lang, source FROM docs
), gt AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN kept k USING (lang)
  LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM tf GROUP BY ALL) c USING (lang, source, term)
), gn AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM gt GROUP BY ALL
), p AS (SELECT gt.lang, gt.source, gt.term, gt.n, 1 + (1000000000::HUGEINT * (gt.n + 5)) // (gn.n + 5 * size.v) AS p FROM gt JOIN gn USING (lang, source) JOIN size USING (lang)
), q AS (SELECT kept.lang, term, 1 + (1000000000::HUGEINT * (kept.n + 5)) // (size.n + 5 * size.v) AS q FROM kept JOIN size USING (lang)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 50
"""
