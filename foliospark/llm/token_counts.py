"""Token counts by rank-synchronous merging of ragged arrays.

Pre-tokens of a batch lie in one flat symbol array with the index of their sequence beside it. In each
step every sequence finds its lowest-rank adjacent pair and merges all of that pair's non-overlapping
occurrences at once, from the left; sequences without a mergeable pair leave. What survives is counted.

Cases: null text counts as empty; an empty text has 0 tokens; repeated rows and ids give a row each;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, small_batches, table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Pre-tokens remembered by a worker, at most.
MOST = 400_000
_RUNS = re.compile(r" *[^ ]+| +")
_NONE = np.int32(2**31 - 1)


class PieceMerges:
    """The merge table of a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only models with identity normalization and a dummy prefix are supported")
        plain = [(p.piece, p.score) for p in model.pieces if p.type in (1, 4, 5)]
        #: Runs of spaces all have one score, so the leftmost merges first; they are counted apart.
        self.runs = {len(p) for p, _ in plain if set(p) == {SPACE}} | {1}
        if any(SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) and p.strip(SPACE) for p, _ in plain):
            raise ValueError("pieces that join words are not supported")
        plain = [(p, s) for p, s in plain if len(p) == 1 or set(p) != {SPACE}]
        order = {p: i for i, (p, _) in enumerate(sorted(plain, key=lambda x: -x[1]))}
        known = dict(order)
        for p in order:
            for c in p:
                known.setdefault(c, len(known))
        self.n = len(known) + 1
        self.chars = {c: i for c, i in known.items() if len(c) == 1}
        pairs = sorted(
            (known[p[:i]] * self.n + known[p[i:]], order[p]) for p in order for i in range(1, len(p)) if p[:i] in known and p[i:] in known
        )
        self.keys = np.array([k for k, _ in pairs] + [2**62], np.int64)
        self.ranks = np.array([r for _, r in pairs] + [_NONE], np.int32)  # a piece's rank is its symbol too
        self.weight = np.ones(self.n, np.int64)
        for p, i in known.items():
            if p not in order:
                self.weight[i] = len(p.encode())
        self.symbol = np.full(0x110000, self.n - 1, np.int64)
        self.symbol[[ord(c) for c in self.chars]] = list(self.chars.values())
        self.run_counts: dict[int, int] = {}

    def run(self, m: int) -> int:
        """Tokens of m spaces: the leftmost pair whose joined length is a piece merges first."""
        if m not in self.run_counts:
            done: list[int] = []
            for _ in range(m):
                done.append(1)
                while len(done) > 1 and done[-2] + done[-1] in self.runs:
                    last = done.pop()
                    done[-1] += last
            self.run_counts[m] = len(done)
        return self.run_counts[m]

    def rank_at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.n + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def count(self, tokens: list[str]) -> list[int]:
        """Surviving symbols of each pre-token; a character outside the vocabulary counts its UTF-8 bytes."""
        if not tokens:
            return []
        unknown = self.n - 1
        code = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32)
        seq = np.repeat(np.arange(len(tokens), dtype=np.int32), list(map(len, tokens)))
        sym = self.symbol[code]
        odd = sym == unknown
        total = np.bincount(seq[odd], _utf8_len(code[odd]), len(tokens)).astype(np.int64)
        space = self.chars.get(SPACE, unknown)
        rank = np.full(len(sym), _NONE)
        inner = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inner] = self.rank_at(sym[inner], sym[inner + 1])
        while len(sym):
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            size = np.diff(np.append(first, len(sym)))
            lowest = np.minimum.reduceat(rank, first)
            if (lowest == _NONE).any():
                done = np.repeat(lowest == _NONE, size)
                s, q = sym[done], seq[done]
                alone = s == space
                total += np.bincount(q[~alone], np.where(s[~alone] == unknown, 0, self.weight[s[~alone]]), len(tokens)).astype(np.int64)
                if alone.any():  # spaces that no word took
                    for j, m in zip(*np.unique(q[alone], return_counts=True), strict=True):
                        total[j] += self.run(int(m))
                sym, seq, rank = sym[~done], seq[~done], rank[~done]
                size, lowest = size[lowest != _NONE], lowest[lowest != _NONE]
                if not len(sym):
                    break
            spot = np.flatnonzero(rank == np.repeat(lowest, size))
            if (np.diff(spot) == 1).any():  # runs of overlapping hits: each second one from the left
                k = np.arange(len(spot))
                spot = spot[(k - np.maximum.accumulate(np.where(np.append(True, np.diff(spot) > 1), k, 0))) % 2 == 0]
            sym[spot] = rank[spot]
            keep = np.ones(len(sym), bool)
            keep[spot + 1] = False
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            spot -= np.arange(len(spot))
            near = np.concatenate([spot, spot[spot > 0] - 1])  # the pairs that a merge has changed
            after = np.minimum(near + 1, len(sym) - 1)
            rank[near] = np.where((after > near) & (seq[near] == seq[after]), self.rank_at(sym[near], sym[after]), _NONE)
        return total.tolist()


def _utf8_len(code: np.ndarray) -> np.ndarray:
    return 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)


class PieceCounter:
    def __init__(self, path: str):
        self.merges, self.seen = PieceMerges(path), {}

    @staticmethod
    def tokens(text: str) -> list[str]:
        """Pre-tokens without their first space, which each has."""
        if "  " in text or text.endswith(" ") or text.startswith(" "):
            return [t[1:] for t in _RUNS.findall(" " + text)]
        return text.split(" ")

    def __call__(self, texts: list[str | None]) -> list[int]:
        out, held, chars = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            for k, part in enumerate(parts((text or "").replace(SPACE, " "))):
                if part:
                    held.append((i, self.tokens(part[1:] if k else part)))
                    chars += len(part)
                if chars > 4 << 20:
                    self.add(held, out)
                    held, chars = [], 0
        self.add(held, out)
        return out

    def add(self, held: list[tuple[int, list[str]]], out: list[int]) -> None:
        """Merges the pre-tokens that aren't known yet, all at once; then sums."""
        if len(self.seen) > MOST:  # the pre-tokens that came first are the frequent ones
            self.seen = dict(islice(self.seen.items(), MOST // 2))
        new = list(set().union(*(words for _, words in held)).difference(self.seen))
        self.seen.update(zip(new, self.merges.count([SPACE + w.replace(" ", SPACE) for w in new]), strict=True))
        for i, words in held:
            out[i] += sum(map(self.seen.__getitem__, words))


def token_counts(docs: DataFrame, model_path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row's whole text. Map-only: no shuffle."""
    small_batches(docs.sparkSession)

    def count(batches):
        import public_tokenizers

        counter = PieceCounter(model_path or public_tokenizers.path(MODEL))
        for b in batches:
            n = pa.array(counter(b.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    got = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string"))
    return got.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
