"""Secret scans with a trigram inverted index; DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived (an OR of ANDs that every match
must satisfy, letters folded to lower case). The index has a posting (trigram, text digest) for each trigram
of the rules' vocabulary that a text holds; postings of a clause are intersected by counting, and only the
candidates of a rule are verified with its expression. A rule without mandatory trigrams scans every text.

Cases: null text counts as empty (no spans, the digest of the empty string); empty texts likewise; copies share
one posting; repeated rows and ids give a row each; spans of equal start are ordered by kind; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, may_hold, table


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int = 0  # the group whose length decides
    least: int = 1
    fold: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.fold else "") + self.regex


#: The base kinds, in the order in which equal starts are listed; a shorter match is used up but dropped.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    # A match takes the whole run, and no later match starts in it that would be longer: the least length can stand in the expression.
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _least(clauses) -> set[frozenset[str]]:
    """Absorption: a clause that contains another says nothing more."""
    kept: set[frozenset[str]] = set()
    for c in sorted(clauses, key=len):
        if not any(k <= c for k in kept):
            kept.add(c)
    return kept


ANY = {frozenset()}  # one clause without demands: true of every text


def trigram_query(regex: str, most: int = 64) -> set[frozenset[str]]:
    """An OR of ANDs of lower-case trigrams that every match of the expression satisfies; ANY if there is none."""

    def both(a, b):
        out = _least(x | y for x in a for y in b)
        return out if len(out) <= most else min(a, b, key=len)

    def flush(exact, query):
        return both(query, _least(_grams(s) for s in exact))

    def walk(items) -> tuple[set[str] | None, set[frozenset[str]]]:
        """The exact strings of the sequence (None: unknown), and the query of what has been passed."""
        exact, query, whole = {""}, ANY, True
        for op, arg in items:
            own, sub = None, ANY
            if op is rc.LITERAL:
                own = {chr(arg).lower()}
            elif op is rc.IN and all(o is rc.LITERAL for o, _ in arg) and len(arg) <= 8:
                own = {chr(c).lower() for _, c in arg}
            elif op is rc.SUBPATTERN:
                own, sub = walk(arg[3])
            elif op is rc.BRANCH:
                found = [walk(x) for x in arg[1]]
                if all(e is not None for e, _ in found):
                    own = set().union(*(e for e, _ in found))
                else:
                    sub = _least(set().union(*(q if e is None else flush(e, q) for e, q in found)))
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
                low, high, what = arg
                e, q = walk(what)
                if e is not None and high == 1:
                    own = e | ({""} if low == 0 else set())
                elif low:
                    sub = q if e is None else flush(e, q)
            if own is not None and len(exact) * len(own) <= most:
                exact = {a + b for a in exact for b in own}
            else:
                query, whole = both(flush(exact, query), sub if own is None else _least(_grams(s) for s in own)), False
                exact = {""}
        return (exact, query) if whole else (None, flush(exact, query))

    exact, query = walk(rp.parse(regex))
    return _least(flush(exact, query) if exact is not None else query)


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(gram, key) for each trigram of the vocabulary and each distinct text (a column ``text`` and its ``key``) that holds it."""
    vocabulary = F.array(*[F.lit(t) for t in trigrams])
    held = F.transform(F.array(F.lower("text")), lambda low: F.filter(vocabulary, lambda t: F.contains(low, t)))[0]  # lower-cased once
    return texts.select("key", F.explode(held).alias("gram")).distinct()


def candidates(index: DataFrame, queries: dict[str, set[frozenset[str]]]) -> DataFrame:
    """(key, rules): the rules of which a clause has all its trigrams in the text."""
    spark = index.sparkSession
    rows = [(kind, i, g, len(c)) for kind, q in queries.items() for i, c in enumerate(sorted(q, key=sorted)) for g in sorted(c)]
    clauses = spark.createDataFrame(rows, "kind string, clause int, gram string, need int")  # as many rows as the rules have trigrams
    return (
        index.join(F.broadcast(clauses), "gram")
        .groupBy("key", "kind", "clause", "need").agg(F.count("*").alias("n"))
        .where("n = need")
        .groupBy("key").agg(F.collect_set("kind").alias("rules"))
    )


_SPANS = "array<struct<s:bigint,k:int,e:bigint,kind:string>>"
_STEPS = "array<struct<g:bigint,h:bigint,ok:boolean>>"


def _steps(text: Column, rule: Rule) -> Column:
    """For each match: the length of the text before it, its own length, and whether it passes."""
    gaps = F.split(text, rule.java, -1)
    hits = F.regexp_extract_all(text, F.lit(rule.java), 0)
    if rule.group:
        hits = F.zip_with(hits, F.regexp_extract_all(text, F.lit(rule.java), rule.group), lambda h, t: F.struct(h.alias("h"), t.alias("t")))
        own, tested = (lambda h: F.length(h["h"])), (lambda h: F.length(h["t"]))
    else:
        own = tested = F.length
    steps = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).cast("long").alias("g"), own(h).cast("long").alias("h"), (tested(h) >= rule.least).alias("ok")))
    return F.when(F.regexp_like(text, F.lit(rule.java)), steps.cast(_STEPS)).otherwise(F.array().cast(_STEPS))


def _placed(x: Column) -> Column:
    """Spans from steps, by running sums; chunks of 256 keep the sums near linear."""
    span = lambda s, e: F.struct(s.alias("s"), x["k"].alias("k"), e.alias("e"), x["kind"].alias("kind"))
    state = lambda at, got, kind: F.struct(at.cast("long").alias("at"), got.cast(kind).alias("got"))

    def sums(part):
        return F.aggregate(
            part,
            state(F.lit(0), F.array(), _SPANS),
            lambda a, p: state(a["at"] + p["g"] + p["h"], F.concat(a["got"], F.array(span(a["at"] + p["g"], a["at"] + p["g"] + p["h"]))), _SPANS),
        )

    steps = F.filter(x["steps"], lambda p: p["h"].isNotNull())  # the text after the last match has no match
    chunks = F.transform(
        F.array(steps), lambda z: F.when(F.size(z) > 0, F.transform(F.sequence(F.lit(0), F.size(z) - 1, F.lit(256)), lambda c: sums(F.slice(z, c + 1, F.lit(256)))))
    )[0]
    spans = F.aggregate(
        F.coalesce(chunks, F.array().cast(f"array<struct<at:bigint,got:{_SPANS}>>")),
        state(F.lit(0), F.array(), f"array<{_SPANS}>"),
        lambda a, c: state(
            a["at"] + c["at"], F.concat(a["got"], F.array(F.transform(c["got"], lambda g: span(g["s"] + a["at"], g["e"] + a["at"])))), f"array<{_SPANS}>"
        ),
        lambda a: F.flatten(a["got"]),
    )
    return F.filter(F.zip_with(spans, steps, lambda s, p: F.struct(s.alias("s"), p["ok"].alias("ok"))), lambda z: z["ok"])


def _spans(text: Column, rules: list[tuple[int, Rule]]) -> Column:
    """array<struct<s, k, e, kind>> of rules with their places; a rule whose places are null is left out."""
    each = [F.struct(_steps(text, r).alias("steps"), F.lit(i).alias("k"), F.lit(r.kind).alias("kind")) for i, r in rules]
    return F.transform(F.flatten(F.transform(F.array(*each), _placed)), lambda z: z["s"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text, and found: array<struct<s, k, e, kind>>, ordered by start and then by the rules' order.

    Rules without a query run over each row where it is. Candidates of the others are verified once for each distinct text, and
    only their texts are shuffled; the spans then join the rows by digest.
    """
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    indexed = {k: q for k, q in queries.items() if q != ANY}
    keyed = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = [(i, r) for i, r in enumerate(rules) if r.kind not in indexed]
    here = _spans(F.col("text"), whole) if whole else F.array().cast(_SPANS)
    if not indexed:
        return keyed.select("doc_id", "text", F.array_sort(here).alias("found"))
    keyed = keyed.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    vocabulary = sorted(set().union(*(c for q in indexed.values() for c in q)))
    wanted = cut(candidates(postings(keyed, vocabulary), indexed).withColumn("short", F.xxhash64("key")))
    held = may_hold(keyed.select("text", "key", F.xxhash64("key").alias("short")), wanted.select("short"), "short")
    texts = held.groupBy("key").agg(F.min("text").alias("text")).join(wanted.select("key", "rules"), "key")
    own = lambda r: F.when(F.array_contains("rules", r.kind), F.col("text")).otherwise(F.lit(""))
    each = [F.struct(_steps(own(r), r).alias("steps"), F.lit(i).alias("k"), F.lit(r.kind).alias("kind")) for i, r in enumerate(rules) if r.kind in indexed]
    there = texts.select(F.col("key").alias("own"), F.transform(F.flatten(F.transform(F.array(*each), _placed)), lambda z: z["s"]).alias("there")).where(F.size("there") > 0)
    both = keyed.withColumn("here", here).join(there, F.col("key") == F.col("own"), "left")
    return both.select("doc_id", "text", F.array_sort(F.concat("here", F.coalesce("there", F.array().cast(_SPANS)))).alias("found"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(table(spark, sf_dir, "documents"))
    line = lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.transform(F.filter("found", lambda x: x["k"] < len(BASE)), line), ",")
    return got.select(
        F.col("doc_id").cast("long"), *[count(r.kind) for r in BASE],
        F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("found", line), ",").alias("spans"),
    )
