"""Connected components, and the candidate links that they need.

Buckets of similar items are not expanded into all pairs. First each bucket's members are tried against its pivot, the
member that shares the most bucket places with others, or simply its least; then, where a bucket still has members of
several components, its members outside the largest of them are tried against the members of other components. Every pair that shares a
bucket is then either in one component already or has been tried, so no link that could join two components is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, may_hold


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b longs): root is the component's smallest node.

    Alternates large-star and small-star steps until the edges are stars: that is seen by counting, without a round that
    changes nothing. Hubs are partially aggregated; the state is cut to a checkpoint in each round.
    """
    e = cut(edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    while True:
        if _are_stars(e):
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(e.select("lo", "lo").distinct())
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        hub = large.join(least, "hi")
        e = cut(hub.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", F.col("m").alias("lo"))).distinct())


def _are_stars(e: DataFrame) -> bool:
    """Whether each node is the greater end of one edge at most, and the lesser end of none if it is that: then the lesser ends are the roots."""
    ends = e.select(F.col("hi").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("lo", F.lit(0), F.lit(1)))
    ends = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.select(F.max((F.col("up") + F.col("down") > 1) & (F.col("up") > 0))).first()[0]


def stars(roots: DataFrame) -> DataFrame:
    """Found components as edges again, to which further ones can be added."""
    return roots.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def with_pivots(members: DataFrame) -> DataFrame:
    """(key, node, pivot) of buckets (key, node) that have two members or more."""
    counts = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(members.join(counts, "key"))
    fame = shared.groupBy("node").agg(F.sum("n").alias("fame"))
    best = shared.join(fame, "node").groupBy("key").agg(F.max(F.struct("fame", -F.col("node"))).alias("best"))
    return cut(shared.select("key", "node").join(best.select("key", (-F.col("best.col2")).alias("pivot")), "key"))


def pivot_pairs(buckets: DataFrame) -> DataFrame:
    """(a, b): each member with its bucket's pivot, once."""
    return buckets.where("node != pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


#: Members of a block on either side, where pairs are tested in arrays.
SIDE = 256


def open_pairs(buckets: DataFrame, roots: DataFrame, traits: DataFrame, alike, side: int = SIDE, few: int = 0, linked=None) -> DataFrame:
    """(a, b): pairs of members of different components in a bucket that are alike by their traits (node, ...); pivots have been tried.

    Members outside a bucket's largest component meet all its members block against block, as arrays: only pairs that
    pass become rows, each under the least key that its two share. ``alike`` takes two functions from a trait's name to its
    column. With ``few`` they meet eight of the members only, others for each number: what that joins needs no further pairs.
    With ``linked``, a test like ``alike`` that is made last, pairs are links: in place of the other member they have its
    component's root, once a block, so that a group of n members that are all linked gives no n * n rows.
    """
    own = buckets.where("node != pivot").select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    # most buckets are one component by now: only the others meet their sizes and traits
    ends = own.groupBy("key").agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first != last").select("key")
    own = cut(own.join(ends, "key"))
    sizes = own.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / side).cast("int")
    sizes = sizes.where("roots > 1").select("key", F.col("top.root").alias("top"), blocks(F.col("n") - F.col("top.n")).alias("nl"), blocks(F.col("n")).alias("nr"))
    # as many as a node has; no pair of different components shares another bucket, unless as a pivot, and then it has been tried
    keys = own.groupBy("node").agg(F.collect_set("key").alias("keys"))
    several = cut(own.join(sizes, "key").join(may_hold(traits, keys, "node").join(keys, "node"), "node"))
    item = F.struct("node", "root", "top", "keys", *[c for c in traits.columns if c != "node"])
    if few:
        least = several.groupBy("key", (F.col("root") == F.col("top")).alias("in_top")).agg(F.array(*[f(item, F.xxhash64("node", F.lit(2 * few + k))) for k in range(2) for f in (F.min_by, F.max_by)]).alias("some"))
        right = least.groupBy("key").agg(F.flatten(F.collect_list("some")).alias("right"))  # at most eight
        both = several.where("root != top").select("key", F.array(item).alias("left")).join(right, "key")
    else:
        dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = several.where("root != top").select("key", dealt("nl").alias("lb"), each("nr").alias("rb"), item.alias("item"))
        right = several.select("key", each("nl").alias("lb"), dealt("nr").alias("rb"), item.alias("item"))
        together = lambda f, name: f.groupBy("key", "lb", "rb").agg(F.collect_list("item").alias(name))
        both = together(left, "left").join(together(right, "right"), ["key", "lb", "rb"])

    # with few, the bucket of the least key may have other representatives
    once = lambda x, y: F.lit(True) if few else F.array_min(F.array_intersect(x["keys"], y["keys"])) == F.col("key")

    def meet(x):
        def open_to(y):
            found = (x["root"] != y["root"]) & ((y["root"] == x["top"]) | (x["node"] < y["node"]) | F.lit(few > 0)) & alike(lambda c: x[c], lambda c: y[c]) & once(x, y)
            return found & linked(lambda c: x[c], lambda c: y[c]) if linked else found

        found = F.filter("right", open_to)
        others = F.array_distinct(F.transform(found, lambda y: y["root"])) if linked else F.transform(found, lambda y: y["node"])
        return F.transform(others, lambda o: F.struct(F.least(x["node"], o).alias("a"), F.greatest(x["node"], o).alias("b")))

    return both.select(F.explode(F.flatten(F.transform("left", meet))).alias("p")).select("p.a", "p.b").distinct()


def open_clusters(buckets: DataFrame, roots: DataFrame, weights: DataFrame, left_block: int, right_block: int) -> tuple[DataFrame, DataFrame]:
    """(pivot, lb, rb, node, root) of two sides: members outside a pivot's largest component, and all its members.

    Both are dealt by hash to as many blocks as their weight (node, n) asks for, and each block of one side meets each of the
    other under (pivot, lb, rb).
    """
    own = buckets.where("node != pivot").select("pivot", "node").distinct().join(roots, "node", "left").join(weights, "node").select("pivot", "node", F.coalesce("root", "node").alias("root"), "n")
    sizes = own.groupBy("pivot", "root").agg(F.count("*").alias("members"), F.sum("n").alias("n"))
    sizes = sizes.groupBy("pivot").agg(F.count("*").alias("roots"), F.max(F.struct("members", "root", "n")).alias("top"), F.sum("n").alias("n"))
    sizes = sizes.where("roots > 1").select("pivot", F.col("top.root").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / left_block).cast("int").alias("nl"), F.ceil(F.col("n") / right_block).cast("int").alias("nr"))
    several = cut(own.drop("n").join(sizes, "pivot"))
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = several.where("root != top").select("pivot", dealt("nl").alias("lb"), each("nr").alias("rb"), "node", "root")
    return left, several.select("pivot", each("nl").alias("lb"), dealt("nr").alias("rb"), "node", "root")
