"""MinHash near-duplicates with HyperMinHash sketches.

A document's set is its distinct word shingles as 64-bit hashes. The top bits of a hash choose a bucket; of each bucket's
least hash the sketch keeps the count of leading zeros and the next mantissa bits, 16 bits in all. For banding, an empty
bucket borrows the register of the first non-empty one in its own fixed order of buckets (optimal densification), so
short documents are found like long ones; bands of 5 registers then hash to keys. The Jaccard estimate from the plain
registers is corrected for chance collisions; pairs that are far below the threshold by it (4 standard deviations) are
dropped, the others are verified on full sets.

Equal sets are one node, so exact copies are never compared. Members of a bucket are first paired with its pivot
(components.py). What is still apart after that is compared block against block among the members of a pivot, and only
links that join two components leave a block: no bucket is expanded into rows of pairs, and none is capped. A pair at the threshold misses all 25 bands with probability of about 4e-7.

Cases: null and empty texts and texts without words have no shingles and link to nothing; fewer words than a shingle make
one shingle of the whole sequence; repeated rows give a row each, and texts under one doc_id are one node; rows with null
doc_id can link others and are kept unless linked to a row with an id; extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, cut, filter_of, in_filter, mix, row_with, small_batches, table
from .components import components, open_clusters, pivot_pairs, stars, with_pivots

BUCKETS, MANTISSA, ROWS, BANDS = 128, 10, 5, 25
#: Shingles of a block on either side, about: 8 bytes each in a worker's memory.
BLOCKS = (1 << 18, 1 << 19)
EMPTY = np.uint16(0xFFFF)
#: Nodes of sets that have no row with an id lie above all ids.
NO_ID = 1 << 62
_P = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; words are parted by ASCII white space, A-Z lower-cased."""
    words = hashes.of((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not len(words):
        return words
    if len(words) < size:
        h = np.full(1, len(words), np.uint64)
        for w in words:
            h = mix(h * _P[0] ^ w)
        return h
    n = len(words) - size + 1
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h += words[j : j + n] * _P[j % len(_P)] + np.uint64(j // len(_P)) * mix(words[j : j + n])
    return np.unique(mix(h))


def sketch(own: np.ndarray) -> np.ndarray:
    bits = int(BUCKETS).bit_length() - 1
    low = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - bits)
    at = np.minimum(np.searchsorted(own, low), len(own) - 1)
    least = own[at]
    full = (least >= low) & ((least >> np.uint64(64 - bits)) == np.arange(BUCKETS, dtype=np.uint64))
    rest = (least << np.uint64(bits)) | np.uint64((1 << bits) - 1)
    zeros = np.zeros(BUCKETS, np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        few = rest < np.uint64(1 << (64 - step))
        zeros += few * np.uint64(step)
        rest = np.where(few, rest << np.uint64(step), rest)
    mantissa = (rest << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return np.where(full, (zeros << np.uint64(MANTISSA)) | mantissa, np.uint64(EMPTY)).astype(np.uint16)


_ORDERS = np.stack([np.random.RandomState(i).permutation(BUCKETS) for i in range(BUCKETS)])


def band_keys(registers: np.ndarray) -> np.ndarray:
    """The keys of the bands, after densification."""
    full = registers != EMPTY
    own = registers.astype(np.uint64)
    if not full.all():
        gaps = np.flatnonzero(~full)
        own[gaps] = registers[_ORDERS[gaps, full[_ORDERS[gaps]].argmax(1)]]
    h = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for j in range(ROWS):
        h = mix(h * _P[0] ^ own[j * BANDS : (j + 1) * BANDS])
    return h


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of registers, corrected for collisions, and the buckets they rest on."""
    both, some = (a != EMPTY) & (b != EMPTY), (a != EMPTY) | (b != EMPTY)
    n = some.sum(1)
    equal = (both & (a == b)).sum(1)
    chance = 2.0**-MANTISSA / 3  # equal leading zeros and mantissas of different least hashes
    return (equal - (both.sum(1) - equal) * chance) / np.maximum(n, 1), n


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, mark (a 128-bit digest of the set) and registers of each row."""
    small_batches(docs.sparkSession)

    def make(batches):
        import xxhash

        hashes = WordHashes()
        for b in batches:
            n, marks, regs = [], [], []
            for text in b.column("text").to_pylist():
                own = shingle_set(text, size, hashes)
                n.append(len(own))
                marks.append(xxhash.xxh3_128_digest(own.tobytes()))
                regs.append(sketch(own).tobytes() if len(own) else None)
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(marks, pa.binary()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "mark", "registers"])

    kinds = "doc_id long, n_shingles long, mark binary, registers binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(make, kinds)


def _no_id(mark):
    return F.shiftrightunsigned(F.xxhash64(mark), 2).bitwiseOR(F.lit(NO_ID))


def _keys(nodes: DataFrame) -> DataFrame:
    def make(batches):
        for b in batches:
            keys = [band_keys(np.frombuffer(r, np.uint16)) for r in b.column("registers").to_pylist()]
            node = np.repeat(b.column("node").to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array((np.concatenate(keys) if keys else np.empty(0, np.uint64)).view(np.int64))], ["node", "key"])

    return nodes.select("node", "registers").mapInArrow(make, "node long, key long")


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose estimate does not rule them out."""
    regs = nodes.select("node", "registers")
    both = pairs.join(regs.withColumnsRenamed({"node": "b", "registers": "rb"}), "b").join(regs.withColumnsRenamed({"node": "a", "registers": "ra"}), "a")

    def test(batches):
        at = percent / 100
        for b in batches:
            ra, rb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb"))
            j, n = estimate(ra, rb)
            ok = j >= at - 4 * np.sqrt(at * (1 - at) / np.maximum(n, 1)) - 0.02
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "ra", "rb").mapInArrow(test, "a long, b long").distinct()


def _sets(nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(node, own): the full sets of the nodes, read again from the texts; a fixed-size filter keeps others from being shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(nodes, "node"))

    def sets(batches):
        import xxhash

        hashes = WordHashes()
        for b in batches:
            ids = b.column("doc_id")
            maybe = ids.is_null().to_numpy(zero_copy_only=False) | in_filter(shared.value, ids.fill_null(0).to_numpy(zero_copy_only=False))
            b = b.filter(pa.array(maybe))
            own = [shingle_set(t, size, hashes).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([xxhash.xxh3_128_digest(s) for s in own], pa.binary()), pa.array(own, pa.binary())], ["doc_id", "mark", "own"])

    full = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sets, "doc_id long, mark binary, own binary")
    return full.select(F.coalesce("doc_id", _no_id("mark")).alias("node"), "mark", "own").join(nodes, "node", "left_semi").dropDuplicates(["node", "mark"]).drop("mark")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    pairs = cut(pairs)
    full = cut(_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), docs, size))
    both = pairs.join(full.withColumnsRenamed({"node": "b", "own": "sb"}), "b").join(full.withColumnsRenamed({"node": "a", "own": "sa"}), "a")

    def test(batches):
        for b in batches:
            ok = []
            for sa, sb in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                merged = np.sort(np.concatenate([x, y]), kind="stable")
                shared_n = int((merged[1:] == merged[:-1]).sum())
                ok.append(100 * shared_n >= percent * (len(merged) - shared_n))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long").distinct()


def span(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) between components (columns node, root, own) of two blocks: as few as join what can be joined.

    Sketch estimates rule pairs out; the others are confirmed on full sets, for one member against all likely ones at once.
    """
    boss: dict[int, int] = {}

    def find(x):
        while boss.get(x, x) != x:
            x = boss[x]
        return x

    out, at = [], percent / 100
    ls, rs = ([np.frombuffer(o, np.uint64) for o in f["own"]] for f in (left, right))
    l_node, r_node, l_root, r_root = (f[c].to_numpy(np.int64) for c in ("node", "root") for f in (left, right))
    lk, rk = (np.stack([sketch(s) for s in x]) for x in (ls, rs))
    size = np.array([len(s) for s in rs])
    flat, start = np.concatenate(rs), np.append(0, np.cumsum(size))
    for i in range(len(ls)):
        own = find(int(l_root[i]))
        j, n = estimate(lk[i][None, :], rk)
        likely = (j >= at - 4 * np.sqrt(at * (1 - at) / np.maximum(n, 1)) - 0.02) & (100 * np.minimum(size, len(ls[i])) >= percent * np.maximum(size, len(ls[i])))
        likely = np.flatnonzero(likely & (r_root != l_root[i]) & (r_node != l_node[i]))
        if not len(likely):
            continue
        some = np.concatenate([flat[start[k] : start[k + 1]] for k in likely])
        spot = np.minimum(np.searchsorted(ls[i], some), len(ls[i]) - 1)
        common = np.add.reduceat((ls[i][spot] == some).astype(np.int64), np.append(0, np.cumsum(size[likely]))[:-1])
        for k in likely[100 * common >= percent * (size[likely] + len(ls[i]) - common)]:
            other = find(int(r_root[k]))
            if other != own:
                boss[max(own, other)] = own = min(own, other)
                out.append((int(l_node[i]), int(r_node[k])))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def _spanned(buckets: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components that share a pivot, found block against block: no pair is a row."""
    left, right = open_clusters(buckets, roots, nodes.select("node", F.greatest("n", F.lit(256)).alias("n")), *BLOCKS)
    sets = cut(_sets(right.select("node").distinct(), docs, size))
    names = ["pivot", "lb", "rb", "node", "root", "own"]
    side = lambda f, names: f.join(sets, "node").select("pivot", "lb", "rb", "node", "root", "own").toDF(*names).groupBy(*names[:3])

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return span(x, y.set_axis(names, axis=1), percent) if len(x) and len(y) else pd.DataFrame({"a": [], "b": []}, dtype=np.int64)

    return side(left, names).cogroup(side(right, [f"{n}_" for n in names])).applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    made = cut(sketches(docs, size))
    nodes = made.where("n_shingles > 0").groupBy("mark").agg(F.min("doc_id").alias("node"), F.min("registers").alias("registers"), F.max("n_shingles").alias("n"))
    nodes = cut(nodes.select("mark", F.coalesce("node", _no_id("mark")).alias("node"), "registers", "n"))
    buckets = with_pivots(_keys(nodes))
    links = cut(_verified(_likely(pivot_pairs(buckets), nodes, percent), docs, size, percent))
    roots = components(links)
    more = cut(_spanned(buckets, roots, nodes.groupBy("node").agg(F.max("n").alias("n")), docs, size, percent))
    if not more.isEmpty():
        roots = components(stars(roots).union(more))
    named = made.select("doc_id", "n_shingles", "mark").join(nodes.select("mark", "node"), "mark", "left").join(roots, "node", "left")
    whole = F.coalesce("root", "node", "doc_id")
    named = named.select("doc_id", "n_shingles", F.when(whole < NO_ID, whole).alias("component_id"))
    return named.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents without those linked to a smaller id, with their columns, whatever their names."""
    gone = near_duplicates(docs, size, percent).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return row_with(docs, F.col("doc_id").cast("long").alias("own")).join(gone, F.col("own") == F.col("gone"), "left_anti").select("row.*")


def op9_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85)
