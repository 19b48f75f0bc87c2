"""Best-fit-decreasing packing of whole documents into sequences of fixed capacity.

The packer works on the histogram of piece lengths, which has at most ``capacity`` entries whatever the
corpus: pieces of one length are interchangeable, and best fit puts equal pieces into a bin until no more
fits, so whole runs of bins are filled in one step. A segment tree over remaining capacities finds the
tightest open bin in logarithmic time. The result is the packing that best-fit decreasing gives over ALL
pieces at once (no shards), as runs: "pieces r0.. of length L go q to a bin from bin b0 at offset o".
Each piece then finds its run by its rank among the pieces of its length.

Cases: null text counts as empty; an empty document is the end id alone; only documents longer than the
capacity are cut; repeated rows and ids are packed each; extra columns are ignored; no rows, no sequences.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, table

TOKENIZER = "word_bpe_49k.json"
CAPACITY, END = 4096, 1
#: Words remembered by a worker, at most.
MOST = 400_000
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")
#: White space outside ASCII, and controls that only Python takes for white space.
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: Words that normalization only lower-cases, and their pre-tokens.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PRE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Byte-level alphabet: printable Latin-1 stands for itself, the other bytes for characters from U+0100 on.
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SELF)}
_GAPS = re.compile("[ \t\n\r\f\v]+")


class TokenIds:
    """Ids of whole texts as little-endian 32-bit bytes; the library encodes each distinct word once.

    The tokenizer's pre-tokens never span white space, so the ids of a text are those of its words in turn.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.seen = Tokenizer.from_file(path), {}
        self.runs: dict[str, bytes] = {}
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Plain Latin words go to the tokenizer's BPE model by pre-token, each once; others through the whole tokenizer."""
        out, runs, tokenize, raw = [], self.runs, self.tokenizer.model.tokenize, self.raw
        for w in words:
            if _PLAIN.fullmatch(w):
                low = w.lower()
                found = [low] if low.isalpha() else _PRE.findall(low)
                for t in found:
                    if t not in runs:
                        got = tokenize(t if t.isascii() else t.encode().decode("latin-1").translate(_BYTES))
                        runs[t] = raw[got[0].id] if len(got) == 1 else b"".join([raw[x.id] for x in got])
                out.append(runs[low] if len(found) == 1 else b"".join([runs[t] for t in found]))
            else:
                out.append(self.encode(w).tobytes())
        return out

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.seen) > MOST:  # the words that came first are the frequent ones
            self.seen = dict(islice(self.seen.items(), MOST // 2))
        if len(self.runs) > MOST:
            self.runs = dict(islice(self.runs.items(), MOST // 2))
        words = [None if _SPECIAL.search(t) else _GAPS.split(t) if _ODD.search(t) else t.split() for t in (x or "" for x in texts)]
        new = list(set().union(*(w for w in words if w)).difference(self.seen))
        self.seen.update(zip(new, self.encode_words(new), strict=True))
        return [b"".join(map(self.seen.__getitem__, w)) if w is not None else self.encode(t).tobytes() for w, t in zip(words, texts, strict=True)]


def pieces_of(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32."""
    small_batches(docs.sparkSession)

    def cut_up(batches):
        import public_tokenizers

        ids_of = TokenIds(tokenizer_path or public_tokenizers.path(TOKENIZER))
        end, step = np.array([END], "<u4").tobytes(), 4 * capacity
        for b in batches:
            rows, texts = [], b.column("text").to_pylist()
            doc_ids = b.column("doc_id").to_pylist()
            for at in range(0, len(texts), 128):
                for doc, ids in zip(doc_ids[at : at + 128], ids_of(texts[at : at + 128]), strict=True):
                    ids += end
                    for k in range(0, len(ids), step):
                        own = ids[k : k + step]
                        rows.append((doc, k // step, k // 4, len(own) // 4, zlib.crc32(own)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


class OpenBins:
    """A segment tree over remaining capacities; each leaf holds runs of open bins."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.runs: dict[int, list[list[int]]] = defaultdict(list)

    def add(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.runs[room].append([first, n])
            self._count(room, n)

    def _count(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.tree[i] += by
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of at least ``need`` that an open bin has."""
        i = need + self.leaves
        while not self.tree[i]:
            while i & 1:  # right children climb
                i >>= 1
                if i == 1 or not i:
                    return None
            if not i:
                return None
            i += 1
            if i >= 2 * self.leaves or (i & (i - 1)) == 0:
                return None
        while i < self.leaves:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.leaves

    def take(self, room: int, n: int) -> tuple[int, int]:
        """Up to n bins of that room, as one run."""
        run = self.runs[room][-1]
        first, got = run[0], min(n, run[1])
        run[0], run[1] = first + got, run[1] - got
        if not run[1]:
            self.runs[room].pop()
        self._count(room, -got)
        return first, got


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces to a bin, first bin, offset), and the number of bins."""
    bins, runs, n_bins = OpenBins(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = bins.tightest(length)
            per = (capacity if room is None else room) // length
            whole = max(1, left // per)  # the last bin may get fewer
            each = min(per, left)
            if room is None:
                room, first, got = capacity, n_bins, whole
                n_bins += whole
            else:
                first, got = bins.take(room, whole)
            runs.append((length, rank, each, first, capacity - room))
            bins.add(room - each * length, first, got)
            rank, left = rank + each * got, left - each * got
    return runs, n_bins


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int = 64) -> DataFrame:
    """Adds sequence_id and offset. ``pieces`` is read twice: give a materialized table.

    Ranks within a length are dealt by a salted window, so that a length that many pieces share is no single task.
    """
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))  # at most capacity x salts rows
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity rows
    runs, _ = best_fit(histogram, capacity)
    # the runs of each length have ascending ranks; lengths and ranks form one sorted key
    flat = np.array(sorted(runs), np.int64).reshape(-1, 5)
    key = (flat[:, 0] << 48) + flat[:, 1]
    shared = pieces.sparkSession.sparkContext.broadcast((key, flat))

    def place(batches):
        key, flat = shared.value
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = flat[np.searchsorted(key, (length << 48) + rank, "right") - 1]
            nth = rank - run[:, 1]
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            cols += [pa.array(run[:, 3] + nth // run[:, 2]), pa.array(run[:, 4] + nth % run[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("own", F.row_number().over(own) - 1)
        .join(counts.select("length", "salt", "before"), ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).cast("long").alias("rank"))
    )
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(cut(pieces_of(docs, tokenizer_path, capacity)), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
