"""Line dedup, near-duplicates, decontamination, top-k, components, pipeline."""

import os
import random
import re
import sys
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliospark.llm import components as cc
from foliospark.llm import decontaminate, line_dedup, near_dups, topk
from foliospark.llm.common import WordHashes

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, key string, node string, n_lines string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "n", "l") for i, t in rows], COLUMNS)


def groups(n, links):
    boss = list(range(n))

    def find(x):
        while boss[x] != x:
            x = boss[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        boss[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def copies(seed, words, groups_of, edits):
    """Texts in groups of near copies of different closeness, with exact copies among them."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 5)))
    out = []
    for size in groups_of:
        base = [word() for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rnd.choice(edits)):
                own[rnd.randrange(len(own))] = word()
            out.append(" ".join(own))
    rnd.shuffle(out)
    return out


def test_components(spark):
    rnd = random.Random(6)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(rnd.randint(200, 400), rnd.randint(200, 400)) for _ in range(120)] + [(5, 5)]
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups(401, links)
    assert got == {i: want[i] for i in {x for e in links for x in e} if i in got} and len(got) == len({x for a, b in links if a != b for x in (a, b)})
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dups_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCKS", (240, 400))
    texts = copies(7, 80, [1] * 30 + [2, 3, 8, 25], [0, 0, 1, 2, 3, 4]) + ["one", "one two", "one two", "One  TWO", "", None, "Über über x", "über Über x"]
    rows = list(enumerate(texts, 10))
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = groups(len(sets), links)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(frame(spark, rows), 3, 85).collect()}
    assert got == {i: (len(s), rows[g][0], rows[g][0] == i) for (i, _), s, g in zip(rows, sets, want, strict=True)}
    left = near_dups.one_of_each(frame(spark, rows), 3, 85)
    assert sorted(r.doc_id for r in left.collect()) == sorted({rows[g][0] for g in want}) and left.columns == ["doc_id", "text", "key", "node", "n_lines"]


def test_near_dups_edges(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, "x y z w"), (2, None)]
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dups.near_duplicates(frame(spark, rows), 3, 85).collect())
    assert got == Counter({(5, 5, True): 2, (None, 5, False): 1, (None, None, True): 1, (2, 2, True): 1})
    assert near_dups.near_duplicates(frame(spark, [])).count() == 0


def test_span_leaves_no_pair_out():
    rnd = np.random.RandomState(8)
    base = np.unique(rnd.randint(0, 2**62, 200).astype(np.uint64))
    make = lambda k: np.sort(np.append(base[k:], rnd.randint(0, 2**62, k).astype(np.uint64)))
    left = pd.DataFrame({"node": [1, 2, 3], "root": [1, 2, 3], "own": [make(k).tobytes() for k in (0, 40, 3)]})
    right = pd.DataFrame({"node": [9, 10, 1], "root": [9, 9, 1], "own": [make(5).tobytes(), make(90).tobytes(), left["own"][0]]})
    got = near_dups.span(left, right, 85)
    assert len(groups_of := {frozenset(x) for x in zip(got["a"], got["b"], strict=True)}) == 2 and {1, 3, 9} == set().union(*groups_of)


def test_sketch_estimates():
    rnd = np.random.RandomState(9)
    for j in (0.5, 0.85):
        both = int(4000 * j)
        x = rnd.randint(0, 2**63, 8000 - both).astype(np.uint64) * np.uint64(2)
        a, b = np.unique(x[:4000]), np.unique(np.append(x[:both], x[4000:]))
        e, n = near_dups.estimate(near_dups.sketch(a)[None], near_dups.sketch(b)[None])
        assert n[0] == 128 and abs(e[0] - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.17
    assert len(near_dups.shingle_set("a b", 3, WordHashes())) == 1 and len(near_dups.shingle_set(" ", 3, WordHashes())) == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edit_links(texts):
    """All pairs of an edit similarity of 0.8 or more, without any gate on candidates."""
    out, counts = [], [Counter(x) for x in texts]
    for i, x in enumerate(texts):
        for j in range(i):
            allowed = int(max(len(x), len(texts[j])) * 0.2 + 1e-9)
            if abs(len(x) - len(texts[j])) <= allowed and sum((counts[i] - counts[j]).values()) <= allowed and (x == texts[j] or edit_distance(x, texts[j]) <= allowed):
                out.append((i, j))
    return out


def normal(line):
    return " ".join(re.findall(r"[^\W_]+", line.lower()))


def test_seeds_of_many_texts_are_hashed_at_once(monkeypatch):
    rng, calls, one = np.random.default_rng(5), [], decontaminate.seed_hashes
    texts = [(th, rng.integers(0, 1 << 63, n).astype(np.uint64)) for th, n in enumerate([0, 40, 3, 9, 0, 0, 25, 8, 200, 0])]
    keep = np.full(1024, np.uint64(0xFFFF0000FFFFFFFF))
    masks = [*decontaminate.MASKS, "01111"]
    want = {(th, k, int(p)) for th, w in texts for m in masks for p, k in enumerate(one(w, m).view(np.int64).tolist()) if decontaminate.in_filter(keep, one(w, m))[p]}
    monkeypatch.setattr(decontaminate, "seed_hashes", lambda w, m: calls.append(m) or one(w, m))
    for portion, most in ((1 << 16, 1), (50, 4)):
        monkeypatch.setattr(decontaminate, "PORTION", portion)
        calls.clear()
        got = [r for cols in decontaminate.text_seeds(texts, masks, keep) for r in zip(*(c.tolist() for c in cols), strict=True)]
        assert set(got) == want and len(got) == len(want) and len(calls) <= most * len(masks)
    assert not list(decontaminate.text_seeds([], masks, keep))


def test_components_end_where_edges_are_stars(spark, monkeypatch):
    calls, one = [], cc.cut
    monkeypatch.setattr(cc, "cut", lambda df: calls.append(1) or one(df))
    got = cc.components(spark.createDataFrame([(1, 2), (3, 1), (7, 9), (4, 4)], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)] and len(calls) == 1
    for edges in ([(1, 2), (2, 3)], [(1, 3), (2, 3)]):
        assert {(r.node, r.root) for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_line_dedup_against_brute_force(spark):
    """Nothing but edit similarity decides here."""
    rnd = random.Random(10)
    pool = copies(11, 25, [1] * 20 + [2, 5, 12], [0, 1, 1]) + ["***", "", "short line", "Short, LINE!", "word " * 400]
    rows = [(i, "\n".join(rnd.choices(pool, k=rnd.randint(1, 6)))) for i in range(40)] + [(50, None), (51, ""), (52, "***\n***")]
    docs = frame(spark, rows)
    spots = [(i, k, normal(x)) for i, t in rows if t for k, x in enumerate(t.split("\n")) if normal(x)]
    want = groups(len(spots), edit_links([x for _, _, x in spots]))
    gone = {s[:2] for i, s in enumerate(spots) if want[i] != i}
    assert len(gone) > 20
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    for i, t in rows:
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        assert (got[i].text, got[i].n_lines, got[i].n_removed) == (left, 0 if t is None else t.count("\n") + 1, sum(d == i for d, _ in gone))
    assert line_dedup.dedup_lines(docs).columns == ["doc_id", "text", "key", "node", "n_lines", "n_removed"]
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_recall_by_words_replaced(spark):
    """Pairs of lines of 5 to 50 words with up to a fifth replaced, each pair on its own; at least 0.9 of those that edit similarity links are found."""
    rnd, links, rows = random.Random(30), set(), []
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9)))
    for n, k in ((5, 1), (10, 1), (10, 2), (20, 1), (20, 4), (50, 1), (50, 3), (50, 8), (50, 10)):
        for _ in range(40):
            base = [word() for _ in range(n)]
            own = list(base)
            for at in rnd.sample(range(n), k):
                own[at] = word()
            a, b = " ".join(base), " ".join(own)
            rows += [(len(rows), a), (len(rows) + 1, b)]
            if edit_distance(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9):
                links.add((n, k, len(rows) - 1))
    gone = {r.doc_id for r in line_dedup.dedup_lines(frame(spark, rows)).where("n_removed = 1").select("doc_id").collect()}
    assert gone <= {x for _, _, x in links} and len(links) > 200
    for n, k in {x[:2] for x in links}:
        own = [x for x in links if x[:2] == (n, k)]
        assert sum(x[2] in gone for x in own) >= 0.9 * len(own), (n, k, len(own))


def test_line_dedup_names_and_hot_lines(spark):
    """Any column name of the input stays; open members are compared in blocks of any size."""
    names = ["_gone", "_d", "_h", "_th", "th", "gone", "row", "h", "key", "node", "d", "t"]
    rows = [(i, "same line of some words in every document\n" + f"own line {i} " * 3, *names) for i in range(30)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"] and got.where("_gone = '_gone' and th = 'th' and row = 'row'").count() == 30
    assert {r.doc_id: r.n_removed for r in got.collect()}[0] == 0 and got.where("doc_id > 0 and n_removed = 0").count() == 0


def test_open_pairs_leave_no_pair_out(spark):
    nodes = spark.createDataFrame([(i, i % 7) for i in range(60)], "node long, trait int")
    buckets = nodes.select(F.lit(1).alias("key"), "node", F.lit(0).cast("long").alias("pivot")).union(nodes.where("node < 20").select(F.lit(2), "node", F.lit(0).cast("long")))
    roots = nodes.where("node % 5 = 0").select("node", F.lit(0).cast("long").alias("root"))
    got = {(r.a, r.b) for r in cc.open_pairs(buckets, roots, nodes, lambda x, y: x("trait") == y("trait"), 4).collect()}
    root = {i: 0 if i % 5 == 0 else i for i in range(60)}
    some = {(r.a, r.b) for r in cc.open_pairs(buckets, roots, nodes, lambda x, y: x("trait") == y("trait"), 4, few=1).collect()}
    assert some and some < got
    assert got == {(i, j) for j in range(1, 60) for i in range(1, j) if i % 7 == j % 7 and root[i] != root[j]}


def test_linked_groups_give_a_row_for_each_member_and_component(spark):
    """60 members that all pass both tests, in three components: pairs would be hundreds of rows."""
    nodes = spark.createDataFrame([(i,) for i in range(60)], "node long")
    buckets = nodes.select(F.lit(1).alias("key"), "node", F.lit(0).cast("long").alias("pivot"))
    roots = nodes.select("node", F.when(F.col("node") < 30, 0).when(F.col("node") < 50, 30).otherwise(50).cast("long").alias("root"))
    traits = nodes.select("node", F.lit(1).alias("trait"))
    yes = lambda x, y: x("trait") == y("trait")
    got = {(r.a, r.b) for r in cc.open_pairs(buckets, roots, traits, yes, linked=yes).collect()}
    assert len(cc.open_pairs(buckets, roots, traits, yes).collect()) > 800 and len(got) <= 60
    found = {r.node: r.root for r in cc.components(cc.stars(roots).union(spark.createDataFrame(list(got), "a long, b long"))).collect()}
    assert set(found.values()) == {0} and len(found) == 60
    assert cc.open_pairs(buckets, roots, traits, yes, linked=lambda x, y: x("trait") != y("trait")).isEmpty()


def test_bound_over_words_is_never_under_the_distance(spark):
    """Replaced, left-out and added words: the bound holds, and is exact where whole words of one place are added."""
    rnd = random.Random(31)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 6)))
    pairs = [("one two three", "one two new words three"), ("a", "a b"), ("b", "a b"), ("x", "y")]
    for _ in range(60):
        x = [word() for _ in range(rnd.randint(1, 12))]
        y = [w if rnd.random() < 0.8 else word() for w in x if rnd.random() < 0.9] or [word()]
        pairs.append((" ".join(x), " ".join(y)))
    words = lambda c: F.split(c, " ", -1)
    short = F.when(F.size(words("x")) <= F.size(words("y")), words("x")).otherwise(words("y"))
    long = F.when(F.size(words("x")) <= F.size(words("y")), words("y")).otherwise(words("x"))
    got = spark.createDataFrame(pairs, "x string, y string").select("x", "y", line_dedup._at_most(short, long).alias("most")).collect()
    assert all(r.most >= edit_distance(r.x, r.y) for r in got) and [r.most for r in got[:4]] == [10, 2, 2, 1]


def test_line_dedup_finds_what_edit_similarity_links(spark):
    """Against brute force without any gate on the candidates, by number of words."""
    rnd = random.Random(14)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    pool = ["storage engine", "storage engines", "hello", "hallo", "one two three", "one twoo three", "Über uns gesagt", "über uns gesagtes", "一二三四五六七八九十一二三四", "一二三四五六七八九十一二三五"]
    for n in (4, 8, 10, 15, 20, 30, 50):
        for k in range(5):
            base = [word() for _ in range(n)]
            own = list(base)
            for at in rnd.sample(range(n), 1 + k * n // 30):
                own[at] = word()
            typed = list(" ".join(base))
            for at in rnd.sample(range(len(typed)), len(typed) // 30):
                typed[at] = "z"
            pool += [" ".join(base), " ".join(own), "".join(typed)]
    pool = list(dict.fromkeys(pool))
    rnd.shuffle(pool)
    links = edit_links([x.lower() for x in pool])
    want = groups(len(pool), links)
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(frame(spark, list(enumerate(pool)))).collect()}
    assert len(links) > 60 and got == {i: int(g != i) for i, g in enumerate(want)}


def test_simhash_by_hand(spark):
    many = "alpha bravo charlie delta foxtrot golf hotel india juliet november"
    texts = spark.createDataFrame([(1, "one two three two"), (2, many), (3, "ab")], "node long, norm string")
    got = {r.node: r for r in line_dedup.simhashes(texts).collect()}
    features = {1: ["one two three two"[i : i + 4] for i in range(14)], 2: [w for w in many.split() if len(w) > 4]}
    words = spark.createDataFrame([(w,) for f in features.values() for w in f], "w string").select("w", F.xxhash64("w").alias("h"), F.xxhash64("w", F.lit(1)).alias("g")).collect()
    for name, other in (("h", "sim"), ("g", "sim2")):
        code = {r.w: r[name] & (2**64 - 1) for r in words}
        for k, own in features.items():
            want = sum(1 << b for b in range(64) if 2 * sum(code[w] >> b & 1 for w in own) > len(own))
            assert (got[k][other] & (2**64 - 1), got[k].by) == (want, k == 2)
    assert len(got) == 3


def test_decontamination(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (40, 30, 16, 7, 3)]
    bench = spark.createDataFrame([(i, " ".join(w), "x") for i, w in enumerate(items)] + [(90, None, "x"), (91, "", "x"), (0, " ".join(items[0]), "x"), (92, " ".join(items[1]), "x")], "item_id long, text string, doc_id string")
    noise = lambda n: [word() for _ in range(n)]
    swapped = [w if k % 7 else word() for k, w in enumerate(items[0])]
    rows = [
        (1, [*noise(50), *items[0], *noise(9)], {0}), (2, [*noise(5), *swapped], {0}), (3, [*items[1], *items[2]], {1, 2, 92}), (4, noise(200), set()), (5, [*noise(3), *items[3]], {3}),
        (6, [*noise(9), *items[4], *items[0][:8]], set()), (7, items[0][10:26], {0}), (8, [], set()),
    ]
    docs = frame(spark, [(i, " ".join(w).upper()) for i, w, _ in rows] + [(9, None), (1, " ".join(rows[0][1]).upper()), (None, " ".join(items[2]))])
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect())
    assert got == Counter([(i, k) for i, _, s in rows for k in s] + [(None, 2)])
    left = decontaminate.decontaminate(docs, bench)
    assert sorted(r.doc_id for r in left.collect()) == [4, 6, 8, 9] and left.columns == docs.columns
    assert decontaminate.overlaps(docs, bench.limit(0)).count() == 0 and decontaminate.overlaps(docs.limit(0), bench).count() == 0


def test_best_stretch_against_brute_force():
    rnd = random.Random(15)
    for _ in range(400):
        equal = np.array([rnd.random() < 0.75 for _ in range(rnd.randint(1, 25))])
        want = max((int(equal[a:b].sum()), a - b) for b in range(len(equal) + 1) for a in range(b + 1) if 5 * equal[a:b].sum() >= 4 * (b - a))
        a, b = decontaminate.best_stretch(equal)
        assert (int(equal[a:b].sum()), a - b) == want


def test_decontamination_recall_against_brute_force(spark):
    """Items with up to a fifth of their words replaced: at least 0.9 of each length and number, all of the short ones, nothing else."""
    rnd, rows, items, want = random.Random(16), [], [], {}
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(5))
    for n, k in ((5, 1), (7, 1), (9, 1), (10, 2), (11, 2), (12, 2), (13, 2), (15, 1), (15, 3), (16, 3), (18, 3), (20, 4), (30, 6), (50, 10)):
        for _ in range(20):
            item = [word() for _ in range(n)]
            gone = set(rnd.sample(range(n), k))
            own = [word() if i in gone else w for i, w in enumerate(item)]
            items.append((len(items), " ".join(item)))
            want[len(rows)] = (n, k, sum(a == b for a, b in zip(item, own, strict=True)))
            rows.append((len(rows), " ".join([word() for _ in range(6)] + own + [word() for _ in range(6)])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(frame(spark, rows), bench).collect()}
    assert all(i == k for i, k in got)
    for n, k in sorted({x[:2] for x in want.values()}):
        own = [i for i, x in want.items() if x[:2] == (n, k) and 5 * x[2] >= 4 * n]
        assert sum((i, i) in got for i in own) >= (1.0 if n < decontaminate.SHORT else 0.9) * len(own), (n, k)


def test_decontamination_names_long_texts_and_many_hits(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "HITS", 3)
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november"
    names = ["_d", "_h", "_th", "th", "bad", "row"]
    rows = [(1, f"x {item} y " * 30), (2, "filler words only " * 40_000 + item), (3, "filler words only " * 40_000), (4, f"x {item} y " * 30)]
    docs = spark.createDataFrame([(*r, *names) for r in rows], ["doc_id", "text", *names])
    bench = spark.createDataFrame([(1, item), (2, item.upper()), (3, item + " oscar")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.n_equal) for r in decontaminate.overlaps(docs, bench).collect())
    assert got == Counter({(d, i, 14): 1 for d in (1, 2, 4) for i in (1, 2, 3)})
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and [tuple(r)[2:] for r in left.collect()] == [tuple(names)]
    assert near_dups.one_of_each(docs).columns == docs.columns and near_dups.one_of_each(docs).count() == 3


def test_top_k(spark, monkeypatch):
    for name, value in (("CHUNK", 60), ("GROUP", 3)):
        monkeypatch.setattr(topk, name, value)
    rnd = np.random.RandomState(13)
    vectors = [(i, [float(x) for x in np.round(rnd.randn(8) / 4, 1)]) for i in range(200)] + [(200, None), (201, [1.0, None] + [0.0] * 6), (202, [float("nan")] * 8), (203, [1.0]), (None, [1.0] * 8), (7, [0.5] * 8)]
    vectors += [vectors[40], vectors[40], (60, [0.25] * 8), (300, [0.5, 0.5]), (301, [1.0, -1.0]), (302, [2.0, 0.0]), (303, [])]  # a repeated query, two of one id, another length
    frame = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, score string")
    good = [(i, tuple(np.floor(64 * np.array(v, np.float32).astype(float)).astype(int))) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all()]
    copies_of, want = {}, set()
    for i, q in sorted(set(good)):
        if i % 20 == 0:
            copy = copies_of[i] = copies_of.get(i, -1) + 1
            best = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), k) for k, v in good if k != i and len(v) == len(q))[:20]
            want |= {(i, r, k, -s, copy) for r, (s, k) in enumerate(best, 1)}
    got = [tuple(int(x) for x in r) for r in topk.top_k(frame).select("query_id", "rank", "vec_id", "score", "query_copy").collect()]
    assert set(got) == want and len(got) == len(want) and {x for x in want if x[4] == 1} and {x[2] for x in want if x[0] == 300} == {301, 302}
    assert topk.top_k(frame.limit(0)).count() == 0 and topk.top_k(frame.where("vec_id < 9")).count() == 9  # 1 to 8, and 7 again


def test_blocks_are_pruned():
    """Of clustered vectors few blocks are visited, and the result is that of all."""
    rnd = np.random.RandomState(21)
    centres = rnd.randn(60, 32) * 3
    vectors = np.floor(64 * (centres[rnd.randint(0, 60, 12_000)] + rnd.randn(12_000, 32) / 4)).astype(np.int64)
    ids, queries = np.arange(12_000), np.arange(0, 12_000, 400)
    visited: list[float] = []
    got = topk.search_chunk(vectors, ids, vectors[queries], queries, 20, visited=visited)
    want = [(int(q), int(i), int(s)) for q in queries for s, i in sorted(zip(-(vectors @ vectors[q]), ids, strict=True)) [:21] if i != q]
    assert len(got) == 20 * len(queries) and {(int(queries[q]), i, s) for q, i, s in got} <= {(q, i, -s) for q, i, s in want}
    assert sum(visited) / len(visited) < 0.25, sum(visited) / len(visited)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_top_k_sql(spark):
    got = topk.op3_exact_topk(spark, SF)
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(f"select {', '.join(got.columns)} from ({topk.ORACLE_SQL})").fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import corpus_pipeline

    docs = corpus_pipeline.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names
        before, docs = docs, spark.createDataFrame(out.collect(), docs.schema)
        assert docs.join(before, "doc_id", "left_anti").count() == 0, name
    packed = corpus_pipeline.packing(spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_keeps_columns_of_any_name(spark):
    import corpus_pipeline

    names = ["keep", "p_good", "expected_grade", "n_lines", "n_removed", "gone", "th", "row", "own", "bad"]
    docs = corpus_pipeline.table(spark, SF, "documents").withColumns({n: F.lit(n) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.where(" or ".join(f"`{n}` <> '{n}'" for n in names)).count() == 0 and out.count() > 0, name
