import json
import math
import tracemalloc
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark import ids
from foliospark.errors import Conflict, InvalidInput, NotFound
from foliospark.functions import text
from foliospark.operators import catalog, diff, edits, history, reconcile, search, tree, vector
from foliospark.operators.workspace import Workspace, set_workspace
from foliospark.sources import workspace
from foliospark.sources.markdown import parse
from foliospark.streaming import feed

FILES = [
    ("garden/soil.md", "# Soil\n\nWhat plants stand in.\n\n## Compost\n\nLeaves rot slowly under damp straw.\n"),
    ("kitchen/bread.md", "# Bread\n\nFermenting dough rises overnight.\n\n## Rye\n\nRye dough stays sticky.\n"),
]


@pytest.fixture(scope="module")
def sections(spark):
    return workspace.sections_of(spark.createDataFrame(FILES, "relative_path string, markdown string")).cache()


@pytest.fixture(scope="module")
def index(sections):
    return search.FullTextIndex.build(sections)


TEXTS = {  # title, content of each section, roots included
    "soil": ("", ""), "Soil": ("Soil", "What plants stand in."), "Compost": ("Compost", "Leaves rot slowly under damp straw."),
    "bread": ("", ""), "Bread": ("Bread", "Fermenting dough rises overnight."), "Rye": ("Rye", "Rye dough stays sticky."),
}


def bm25(patterns, titles):
    """Scores by the formula, counted by hand over the small collection."""
    words = {k: ((t or k).lower().split(), c.lower().replace(".", "").split()) for k, (t, c) in TEXTS.items()}
    lengths = [[max(1, len(w[f])) for w in words.values()] for f in (0, 1)]
    average = [sum(x) / len(x) for x in lengths]
    total = dict.fromkeys(titles, 0.0)
    for p in patterns:
        hits = lambda ws: sum(w.startswith(p[:-1]) if p.endswith("*") else w == p for w in ws)  # noqa: B023, E731
        df = sum(bool(hits(t) + hits(c)) for t, c in words.values())
        for k in titles:
            for f, weight in ((0, 2.5), (1, 1.0)):
                tf = hits(words[k][f])
                if tf:
                    total[k] += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * max(1, len(words[k][f])) / max(1.0, average[f])))
    return {k: round(v, 6) for k, v in total.items()}


@pytest.mark.parametrize("query, options, titles", [
    ("compost rot", {}, ["Compost"]),
    ("dough", {}, ["Bread", "Rye"]),
    ("ferm*", {"path": "kitchen"}, ["Bread"]),
    ("straw dough", {"require_all": False, "path": "garden"}, ["Compost"]),
    ("rye sticky", {}, ["Rye"]),
])
def test_search(index, query, options, titles):
    got = [(r.title, round(r.score, 6)) for r in search.search(index, query, **options).collect()]
    assert dict(got) == bm25(query.split(), titles) and [s for _, s in got] == sorted((s for _, s in got), reverse=True)


@pytest.mark.parametrize("query, expected", [('"damp straw"', [("Compost", 2.0)]), ('"straw damp"', []), ("absent", []), ("", []), ("'rye'", [("Rye", 7.0)])])
def test_phrases(index, query, expected):
    assert [(r.title, r.score) for r in search.search(index, query).collect()] == expected


def test_document_filter(index, sections):
    doc = sections.where("title = 'Rye'").first().document_id
    assert {r.title for r in search.search(index, "dough", document=doc).collect()} == {"Bread", "Rye"}
    assert search.search(index, "compost", document=doc).count() == 0


def test_queries_and_texts_have_the_same_tokens(spark):
    words = ["हिन्दी", "日本語テキスト", "ÉcoleÉté", "ΑλφαΒητα", "don't_stop", "HTTPServer2Go", "Ǆungla", "١٢٣", "naïveBayes"]
    made = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: (r.t, r.u) for r in made.select("w", text.tokens(F.col("w")).alias("t")).join(text.token_rows(made, "w", "w").groupBy("w").agg(F.collect_list("term").alias("u")), "w").collect()}
    assert {w: search.query_tokens(w) for w in words} == {w: t for w, (t, _) in got.items()} and all(sorted(t) == sorted(u) for t, u in got.values())
    found = search.FullTextIndex.build(workspace.sections_of(spark.createDataFrame([("h.md", "# H\n\nयह हिन्दी है\n")], "relative_path string, markdown string")))
    assert [r.title for r in search.search(found, "हिन्दी").collect()] == ["H"]


def test_matches_and_updates(index, sections, spark, tmp_path):
    row = search.with_matches(search.search(index, "compost rot"), index, "compost rot").first()
    assert row.title_match and "rot slowly" in row.content_matches[0].snippet
    doc = sections.where("title = 'Compost'").first().document_id
    assert search.search_sections(index, doc, "straw", in_content=False).count() == 0
    less = index.replace_document(doc, None)
    assert less.n == 3 and search.search(less, "compost").count() == 0
    again = less.replace_document(doc, sections.where(F.col("document_id") == doc))
    assert {r.title: round(r.score, 6) for r in search.search(again, "compost rot").collect()} == bm25(["compost", "rot"], ["Compost"])
    kept = search.FullTextIndex.build(sections, str(tmp_path / "index"))
    assert [r.title for r in search.search(search.FullTextIndex.load(spark, str(tmp_path / "index")), "dough").collect()] == [r.title for r in search.search(kept, "dough").collect()]


@pytest.mark.parametrize("word, parts", [("camelCase", ["camelcase", "camel", "case"]), ("XMLParser", ["xmlparser", "xml", "parser"]), ("constant", ["constant"]), ("getHttpResponse", ["gethttpresponse", "get", "http", "response"])])
def test_tokens(spark, word, parts):
    assert spark.range(1).select(text.tokens(F.lit(word)).alias("t")).first().t == parts == search.query_tokens(word)


def test_atoms():
    got = search.query_atoms('foo "bar baz" qux*')
    assert [(a.kind, a.text) for a in got] == [("term", "foo"), ("phrase", "bar baz"), ("prefix", "qux")]
    assert [a.kind for a in search.query_atoms("don't")] == ["term", "phrase"]


def test_tree(sections):
    top = sections.where("title = 'Soil'").first()
    assert [r.title for r in tree.section_tree(sections, top.section_id).collect()] == ["Soil", "Compost"]
    assert [r.title for r in tree.section_tree(sections, top.section_id, 0).collect()] == ["Soil"]
    assert [r.title for r in tree.table_of_contents(sections, top.document_id).collect()] == ["Soil", "Compost"]
    docs = {r.relative_path: r.markdown for r in tree.render_documents(sections).collect()}
    assert docs == dict(FILES)
    assert tree.render_section(sections, top.section_id).first().markdown == "# Soil\n\nWhat plants stand in.\n"
    assert [r.title for r in tree.get_sections(sections, top.document_id, [top.path[0], top.section_id]).collect()] == ["soil", "Soil"]
    with pytest.raises(NotFound):
        tree.get_sections(sections, top.document_id, ["none"])
    assert {r.title: r.child_count for r in tree.section_info(sections).collect()}["Soil"] == 1


def test_discover(spark, tmp_path):
    for p in ("a.md", "b/C.MD", "b/d.txt", ".git/x.md", "b/skip.md"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("# T\n")
    (tmp_path / "b/link.md").symlink_to(tmp_path / "a.md")
    (tmp_path / "other").symlink_to(tmp_path / "b")
    got = workspace.discover(spark, str(tmp_path), "skip*\n")
    assert sorted(r.relative_path for r in got.collect()) == ["a.md", "b/C.MD"]
    with pytest.raises(InvalidInput):
        workspace.check_path("../x.md")


def test_vectors(spark):
    rows = [("a", [1.0, 0.0], "m"), ("b", [0.0, 1.0], "m"), ("c", [0.5, 0.5], "n"), ("d", [1.0], "m")]
    v = spark.createDataFrame(rows, "section_id string, vector array<float>, model string")
    assert [r.section_id for r in vector.nearest(v, [1.0, 0.0], 2).collect()] == ["a", "c"]
    assert [r.section_id for r in vector.nearest(v, [1.0, 0.0], 1, where=F.col("section_id") == "b", post_filter=True).collect()] == []
    assert [r.section_id for r in vector.nearest(v, [1.0, 0.0], 1, where=F.col("section_id") == "b").collect()] == ["b"]


def test_cache(spark, sections):
    empty = spark.createDataFrame([], "section_id string, content_hash string, model string, vector array<float>, cached_at timestamp")
    full = vector.embed(sections, empty, "m", lambda texts: [[float(len(t)), 1.0] for t in texts]).cache()
    assert full.count() == 6 and vector.cache_misses(sections, full, "m").count() == 0 and vector.cache_misses(sections, full, "x").count() == 6
    assert tuple(vector.cache_stats(full).first()) == (6, 1, 48)
    assert vector.cache_load(full, "m").count() == 6 and vector.cache_load(full, "x").count() == 0 and vector.cache_clear(full).count() == 0
    docs = workspace.documents_of(spark.createDataFrame(FILES, "relative_path string, markdown string"), sections)
    assert tree.get_document_by_name(docs, "bread").first().relative_path == "kitchen/bread.md"
    with pytest.raises(NotFound):
        tree.get_document_by_name(docs, "none")
    assert search.plain_snippet("é" * 50 + "hit" + "x" * 50, 100, 103) == "é" * 20 + "hit" + "x" * 40


def test_diff_and_merge():
    shapes = lambda a, b: [(h["old_start"], h["old_lines"], h["new_start"], h["new_lines"]) for h in diff.hunks(list(a), list(b))]
    assert shapes("abcdefghij", "abcXefghijk") == [(0, 7, 0, 7), (7, 3, 7, 4)]
    assert shapes("abcdefgh", "aXcdeYgh") == [(0, 5, 0, 5), (2, 6, 2, 6)]  # four lines apart: two hunks, whose contexts overlap
    assert shapes("abcd", "Xbcd") == [(0, 4, 0, 4)] and shapes("abc", "abc") == [] and shapes("", "a") == [(0, 0, 0, 1)]
    assert [k for k, _ in diff.line_diff(["a"], ["b"])] == ["Removed", "Added"]
    assert diff.lines_of("a\r\nb\x0bc\n\n") == ["a", "b\x0bc", ""] and diff.lines_of(None) == diff.lines_of("") == []
    base = "# Tides\n\nEbb at six.\nSlack at nine.\nFlood at noon.\n"
    assert diff.merge_texts(base, base.replace("six", "seven"), base.replace("noon", "one")).text == base.replace("six", "seven").replace("noon", "one")
    assert diff.merge_texts("x\nhigh water\n", "x\nlow water\n", "x\nno water\n").conflict
    assert diff.merge_texts(base, base, base + "end\n").text == base + "end\n"


def test_diff_against_brute_force(monkeypatch):
    """The whole table of distances, and the script read from its end."""
    import random

    rnd = random.Random(1)
    for block in (1, 2, 3, 512):
        monkeypatch.setattr(diff, "BLOCK", block)
        for _ in range(200):
            a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 9))] for _ in range(2))
            cost = {}
            for i in range(len(a) + 1):
                for j in range(len(b) + 1):
                    ways = [cost[k] + 1 for k in ((i - 1, j), (i, j - 1)) if k in cost]
                    cost[i, j] = cost[i - 1, j - 1] if i and j and a[i - 1] == b[j - 1] else min(ways, default=0)
            i, j, want = len(a), len(b), []
            while (i, j) != (0, 0):
                if i and j and a[i - 1] == b[j - 1]:
                    i, j = i - 1, j - 1
                    want.insert(0, ("Context", a[i]))
                elif not i or j and cost[i, j - 1] <= cost[i - 1, j]:
                    j -= 1
                    want.insert(0, ("Added", b[j]))
                else:
                    i -= 1
                    want.insert(0, ("Removed", a[i]))
            assert diff.line_diff(a, b) == want
    long = [str(k) for k in range(3000)]
    assert sum(k == "Context" for k, _ in diff.line_diff(long, long[1000:] + long[:1000])) == 2000


def test_versions(spark, sections):
    v = history.new_versions(sections, 1).unionByName(history.new_versions(sections.withColumn("content", F.concat("content", F.lit("!"))), 2)).cache()
    sec = sections.where("title = 'Compost'").first().section_id
    assert [r.seq for r in history.section_versions(v, sec).collect()] == [1, 2]
    first = history.section_versions(v, sec).first()
    assert history.switch_version(v, sec, first.version_id, 3).first().content == first.content
    now = history.latest_versions(v)
    with pytest.raises(Conflict):
        history.require_versions(now, spark.createDataFrame([(sec, first.version_id)], "section_id string, expected_version string"))
    pairs = v.where(F.col("section_id") == sec).groupBy("section_id").agg(F.min_by("version_id", "seq").alias("from_version"), F.max_by("version_id", "seq").alias("to_version"))
    assert [r.kind for r in history.diff_versions(v, pairs).collect()] == ["Removed", "Added"]
    snaps = history.create_snapshot(sections, "s1").unionByName(history.create_snapshot(sections.withColumn("content", F.upper("content")), "s2"))
    assert history.diff_snapshots(snaps, "s1", "s2").where("kind = 'Added'").count() == 4


def test_reconcile(spark):
    cols = "document_id string, section_id string, pos int, title string, ancestry array<string>, ordinal int, fingerprint string"
    parsed = spark.createDataFrame([("d", "p1", 1, "A", ["A"], 0, "f1"), ("d", "p2", 2, "B", ["B"], 1, "new"), ("d", "p3", 3, "C", ["C"], 2, "f9"), ("d", "p4", 4, "Z", ["Z"], 3, "tie")], cols)
    records = spark.createDataFrame([("d", "r1", "A2", ["A2"], 5, "f1"), ("d", "r2", "B", ["B"], 7, "old"), ("d", "r4", "Y", ["Y"], 9, "tie"), ("d", "r5", "X", ["X"], 9, "tie")], cols.replace("section_id string, pos int", "record_id string"))
    got = {r.pos: r.section_id for r in reconcile.reconcile(parsed, records).collect()}
    assert got == {1: "r1", 2: "r2", 3: "p3", 4: "p4"}
    assert "FlatMapGroupsInPandas" not in reconcile.assign(reconcile.scores(parsed, records))._jdf.queryExecution().toString()  # a frame for each document takes milliseconds



def test_reconcile_leaves_records_to_sections_that_match_them_better(spark):
    """A new section without text comes before an old one without text: the old one's record is its own."""
    cols = "document_id string, section_id string, pos int, title string, ancestry array<string>, ordinal int, fingerprint string"
    parsed = spark.createDataFrame([("d", "p1", 1, "New", ["S"], 1, "none"), ("d", "p2", 2, "B", ["S"], 2, "none"), ("d", "p3", 3, "C", ["S"], 3, "f3")], cols)
    records = spark.createDataFrame([("d", "r2", "B", ["S"], 1, "none"), ("d", "r3", "C", ["S"], 2, "f3")], cols.replace("section_id string, pos int", "record_id string"))
    assert {r.pos: r.section_id for r in reconcile.reconcile(parsed, records).collect()} == {1: "p1", 2: "r2", 3: "r3"}


def test_an_index_in_waves_is_the_same(spark, sections, monkeypatch):
    """Postings ranged a part of the terms at a time: the same rows, a range of its own for each part, nothing left of the occurrences."""
    import os

    from foliospark.operators import index as tables

    rows = lambda i: sorted(map(str, i.postings.drop("range").collect()))
    whole = tables.FullTextIndex.build(sections)
    monkeypatch.setattr(tables, "WAVE", 1000)
    parts = tables.FullTextIndex.build(sections)
    assert rows(parts) == rows(whole) and rows(whole)
    ends = parts.postings.groupBy("range").agg(F.min("term").alias("a"), F.max("term").alias("b")).orderBy("range").collect()
    assert all(x.b <= y.a for x, y in zip(ends, ends[1:])) and max(r["range"] for r in ends) >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = parts.blocks.inputFiles()[0].removeprefix("file://").rsplit("/blocks/", 1)[0]
    assert not os.path.exists(f"{folder}/tokens")


def test_the_driver_has_no_list_of_a_folders_files(spark, tmp_path):
    """Tasks find and read the files, as Spark's own reader does; no file index stands in the plan."""
    for name in ("a.md", "x/b.MD", "x/y/c.md", "x/y/z.txt", ".git/d.md", "_w/e.md", ".h.md", "drafts/f.md", "x/ü n.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(f"# {name}\r\n".encode())
    (tmp_path / "link.md").symlink_to(tmp_path / "a.md")
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        found = workspace.discover(spark, root, "drafts")
        assert {r.relative_path: r.markdown for r in found.collect()} == {n: f"# {n}\r\n" for n in ("a.md", "x/b.MD", "x/y/c.md", "x/ü n.md")}
        assert found.inputFiles() == []


def test_a_stored_frame_leaves_no_shuffle(spark):
    """Shuffle files go with the write that made them, and the setting is as it was."""
    from foliospark.storage import _CLEANUP, stored

    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    assert stored(spark.range(1000).repartition(3, "id"), "rows").count() == 1000
    assert tracker.shuffleStatuses().size() <= before + 1 and spark.conf.get(_CLEANUP) == "false"  # the count's own


def test_results_of_texts_stay_small():
    """A worker has the results of few texts at a time, whatever the batch; every row comes once, in its order."""
    import pandas as pd

    f = pd.DataFrame({"n": range(7), "text": ["a" * 60, None, "b" * 60, "c" * 250, "", "d", "e" * 90]})
    got = list(workspace.portions(f, "text", 100))
    assert [list(own["n"]) for own in got] == [[0, 1, 2], [3], [4, 5, 6]]
    assert list(workspace.portions(f[:0], "text")) == []


def test_arrow_batches_become_objects_a_portion_at_a_time(spark):
    """A batch of 24 MB of text (48 as Python strings) never has more than a few portions of objects; rows come in order, nulls and lists as they are."""
    texts = ["é" * 60_000 + str(i) for i in range(200)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"n": list(range(202)), "text": texts, "ids": [[str(i)] if i % 2 else None for i in range(202)]})
    del texts
    seen, runs = [], 0
    tracemalloc.start()
    for own in workspace.arrow_portions(batch, "text"):
        runs += 1
        seen += [(n, text and text[60_000:], ids) for n, text, ids in own]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == [(i, str(i) if i < 200 else None if i == 200 else "", [str(i)] if i % 2 else None) for i in range(202)]
    assert runs > 15 and peak < 8 << 20
    files = spark.createDataFrame([(f"{i}.md", f"# T{i}\n\nBody.\n") for i in range(3)], "relative_path string, markdown string")
    todo = files.select("relative_path", F.lit(0).alias("seq"), F.lit("create_section").alias("op"), F.lit('{"title": "New"}').alias("args")).where("relative_path != '1.md'")
    edited = edits.apply_edits(files, todo)
    for df in (edited, workspace.sections_of(edited)):
        assert "MapInArrow" in df._jdf.queryExecution().toString() and "MapInPandas" not in df._jdf.queryExecution().toString()
    assert [r.n for r in workspace.sections_of(edited).groupBy("relative_path").agg(F.count("*").alias("n")).orderBy("relative_path").collect()] == [3, 2, 3]


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, f"file://{tmp_path}/cat")
    files = spark.createDataFrame(FILES, "relative_path string, markdown string")
    docs = workspace.documents_of(files, workspace.sections_of(files))
    assert c.commit({"documents": docs}) == 1 and c.table("documents").count() == 2
    with pytest.raises(Conflict):
        c.commit({"documents": docs}, expected_generation=0)
    stray = tmp_path / "cat/generations/9-dead"
    stray.mkdir()
    assert c.recover() == ["9-dead"]
    one = docs.first()
    moved = catalog.move_file(docs, one.document_id, "new/place.md", one.content_hash)
    assert moved.where("relative_path = 'new/place.md'").count() == 1
    with pytest.raises(Conflict):
        catalog.move_file(docs, one.document_id, FILES[1][0] if one.relative_path == FILES[0][0] else FILES[0][0])
    with pytest.raises(InvalidInput):
        catalog.rename_file(docs, one.document_id, "a/b.md")
    active, gone = catalog.remove_file(docs, docs.limit(0).withColumn("archived_history", F.lit(True)), one.document_id)
    assert active.count() == 1 and gone.count() == 1
    back, rest = catalog.restore_file(active, gone, one.document_id)
    assert back.count() == 2 and rest.count() == 0
    with catalog.Lease(c), pytest.raises(Conflict), catalog.Lease(c):
        pass
    with catalog.Lease(c, seconds=-1), catalog.Lease(c):  # one that has run out is taken over
        pass


def test_catalog_writers_and_readers(spark, tmp_path):
    """There is a manifest at every moment, a generation is taken once, and a break before the manifest leaves the old state."""
    c, other = (catalog.Catalog(spark, f"file://{tmp_path}/cat") for _ in range(2))
    table = lambda n: spark.range(n).toDF("id")
    assert c.commit({"a": table(1)}) == 1
    late = other.manifest()
    assert c.commit({"a": table(2), "b": table(3)}) == 2
    with pytest.raises(Conflict):
        other._publish(late, {})
    (tmp_path / "cat/manifest-000000000003.claim").write_text("a writer that died")
    assert c.table("a").count() == 2 and c.recover() == ["manifest-000000000003.claim"]
    assert c.commit({"b": table(5)}) == 3 and other.table("a").count() == 2 and other.table("b").count() == 5


def test_catalog_replaces_buckets(spark, tmp_path):
    c = catalog.Catalog(spark, f"file://{tmp_path}/cat")
    rows = lambda *r: spark.createDataFrame(list(r), "path string, n int")
    c.commit({"t": rows(*[(f"p{k}", k) for k in range(200)])})
    c.replace("t", rows(("p1", -1), ("p1", -2), ("new", 0)), "path", gone=rows(("p2", 0)))
    before = set(c.manifest()["tables"]["t"])
    got = {(r.path, r.n) for r in c.table("t").collect()}
    assert got == {(f"p{k}", k) for k in range(200) if k not in (1, 2)} | {("p1", -1), ("p1", -2), ("new", 0)}
    c.replace("t", rows(("p1", 7)), "path")
    assert len(before - set(c.manifest()["tables"]["t"])) == 1 and c.table("t").where("path = 'p1'").count() == 1


@pytest.fixture
def space(spark, tmp_path):
    for path, markdown in FILES:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(markdown)
    return Workspace(spark, f"file://{tmp_path}")


def test_workspace_files(space, tmp_path):
    doc = space.import_document("garden/soil.md", "The ground")
    row = space.load().documents.where(F.col("document_id") == doc).first()
    assert (row.name, row.managed, space.info()["managed"]) == ("The ground", True, 1)
    with pytest.raises(InvalidInput):
        space.import_document("garden/soil.md")
    with pytest.raises(NotFound):
        space.import_document("garden/none.md")
    new = space.create_document("notes/first.md", "# First\n\nText.\n")
    assert (tmp_path / "notes/first.md").read_text() == "# First\n\nText.\n" and space.manage(new) == new
    with pytest.raises(Conflict):
        space.create_document("notes/first.md")
    for bad in ("../out.md", "/abs.md", "a\\b.md"):
        with pytest.raises(InvalidInput):
            space.export_document(new, bad)
    assert space.export_document(new, "out/copy.md")["bytes_written"] == len((tmp_path / "out/copy.md").read_bytes())
    (tmp_path / "out/copy.md").unlink()
    space.move_file(new, "deep/er/second.md")
    space.rename_file(new, "third.md")
    assert (tmp_path / "deep/er/third.md").exists() and not (tmp_path / "notes/first.md").exists()
    assert space.load().documents.where("relative_path = 'deep/er/third.md'").first().document_id == new
    with pytest.raises(Conflict):
        space.move_file(new, "elsewhere.md", expected_hash="sha256:other")
    sections = {r.section_id for r in space.catalog.table("sections").collect()}
    space.remove_file(new)
    assert not (tmp_path / "deep/er/third.md").exists() and space.info()["managed"] == 1
    space.restore_file(new, "back.md")
    assert (tmp_path / "back.md").read_text() == "# First\n\nText.\n" and space.info()["managed"] == 2
    assert {r.section_id for r in space.load().sections.where(F.col("document_id") == new).collect()} <= sections
    space.unmanage_file(doc)
    assert (tmp_path / "garden/soil.md").exists() and space.info()["managed"] == 1
    assert set_workspace(space.spark, space.root).root == space.root
    with pytest.raises(NotFound):
        set_workspace(space.spark, space.root + "/none")


def test_workspace_keeps_ids_over_edits_and_renames(space, spark, tmp_path):
    doc = space.import_document("garden/soil.md")
    old = {r.title: r.section_id for r in space.catalog.table("sections").collect()}
    edit = lambda *ops: space.edit(spark.createDataFrame([(doc, k, op, json.dumps(args)) for k, (op, args) in enumerate(ops)], "document_id string, seq int, op string, args string"), "me")
    assert edit(("insert_section", {"sibling": old["Compost"], "title": "Clay"}), ("append_to_section", {"section": old["Compost"], "content": "Warm."})).count() == 0
    assert "## Clay" in (tmp_path / "garden/soil.md").read_text()
    now = {r.title: r.section_id for r in space.load().sections.where(F.col("document_id") == doc).collect()}
    assert {k: v for k, v in now.items() if k != "Clay"} == old and now["Clay"] not in old.values()
    versions = {(r.title, r.seq) for r in space.catalog.table("versions").collect()}
    assert {t for t, s in versions if s > 1} == {"Clay", "Compost"}
    assert edit(("move_section", {"section": "sec-none"})).first().error.startswith("InvalidInput")
    (tmp_path / "garden/soil.md").rename(tmp_path / "garden/ground.md")
    state = space.load()
    assert state.renamed.first().new_path == "garden/ground.md"
    assert {r.section_id for r in state.sections.where(F.col("document_id") == doc).collect()} == set(now.values())
    space.save(state)
    assert space.catalog.table("documents").first().relative_path == "garden/ground.md"
    text = (tmp_path / "garden/ground.md").read_text()
    (tmp_path / "garden/ground.md").write_text("# Before\n\nIntro.\n\n" + text.replace("rot slowly", "rot fast"))
    again = {r.title: r.section_id for r in space.load().sections.where(F.col("document_id") == doc).collect()}
    assert {k: again[k] for k in now if k in again} == {k: v for k, v in now.items() if k in again} and len(again) == len(now) + 1


def test_approximate_neighbours_recall(spark):
    rnd = np.random.RandomState(5)
    centres = rnd.randn(20, 16)
    rows = [(str(i), (centres[i % 20] + rnd.randn(16) / 6).tolist()) for i in range(1000)]
    v = spark.createDataFrame(rows, "section_id string, vector array<double>")
    ids = lambda df: {r.section_id for r in df.collect()}
    found = [len(ids(vector.nearest(v, q, 10)) & ids(vector.nearest_approximate(v, q, 10))) for q in (rows[k][1] for k in (0, 77, 403, 810, 999))]
    assert sum(found) >= 45


def test_debounce(spark, tmp_path):
    assert feed.fixed_windows([0, 100, 299, 300, 700]) == [(0, 3), (300, 1), (700, 1)]
    rows = [(1, datetime(2024, 1, 1, 0, 0, 0, 1000 * ms)) for ms in (0, 100, 299, 300, 700)]
    events = spark.createDataFrame(rows, "user long, ts timestamp")
    assert sorted(r.events for r in feed.debounce(events, "user").collect()) == [1, 1, 3]
    noise = spark.createDataFrame([("modify", "a/b.md"), ("access", "a/b.md"), ("modify", "a/.b.md.swp"), ("modify", "recovery/x.md")], "kind string, path string")
    assert noise.where(feed.relevant(F.col("kind"), F.col("path"))).count() == 1


def test_reload_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "x").mkdir()
    (folder / "a.md").write_text("# A\n\nbody\n")
    (folder / "x/a.md").write_text("# Another\n")
    c = catalog.Catalog(spark, f"file://{tmp_path}/cat")
    sink = feed.reload_into(c, workspace.sections_of)
    for step in range(2):
        q = feed.read_files(spark, str(folder)).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        (folder / "b.md").write_text("# B\n")
    assert sorted(r.title for r in c.table("sections").where("level = 1").collect()) == ["A", "Another", "B"]
    feed.reload_incremental(c, workspace.sections_of, spark.createDataFrame([("a.md", "# A2\n", datetime(2030, 1, 1))], "relative_path string, markdown string, ts timestamp"), spark.createDataFrame([("b.md",)], "relative_path string"))
    assert sorted(r.title for r in c.table("sections").where("level = 1").collect()) == ["A2", "Another"]


def test_ids():
    a, b = ids.new_id("section"), ids.new_id("section")
    assert a.startswith("sec-") and len(a) == 26 and a[:10] <= b[:10]
    assert json.dumps(a)


def test_positions_are_those_of_the_text(spark):
    """Every span of the postings holds its term, counted in bytes; camelCase parts share their word's number."""
    content = "Ärger mit getHttpResponse,日本 und XMLParser.  Ärger mit\nnaïve 🚀 get"
    made = spark.createDataFrame([("s", "d", "p.md", "Das getHttp Ä", content), ("t", "d", "p.md", None, None)], "section_id string, document_id string, relative_path string, title string, content string")
    own = search.FullTextIndex.build(made)
    texts = {"title": "Das getHttp Ä".encode(), "content": content.encode()}
    rows = own.postings.collect()
    assert {(r.section_id, r.len_title, r.len_content) for r in own.headers.collect()} == {("s", 5, 15), ("t", 1, 1)}
    for r in rows:
        for f in texts:
            assert len(r[f]) == r[f"tf_{f}"] and all(texts[f][h.start : h.end].decode().lower() == r.term for h in r[f])
    numbers = {r.term: [(h.run, h.word) for h in r.content] for r in rows}
    assert numbers["http"] == [(2, False)] and numbers["gethttpresponse"] == [(2, True)] and numbers["get"] == [(2, False), (9, True)]
    assert [(h.start, h.end) for h in search.phrase_hits(own, ("ärger", "mit")).orderBy("start").collect()] == [(0, 10), (50, 60)]
    assert search.phrase_hits(own, ("mit", "naïve")).count() == 0  # a line end is no space


def test_phrases_go_on_in_words(spark):
    rows = [("a", "roof theatre of the"), ("b", "roof theatre"), ("c", "of  the"), ("d", "of the"), ("e", "the of")]
    made = spark.createDataFrame([(k, k, f"{k}.md", "", t) for k, t in rows], "section_id string, document_id string, relative_path string, title string, content string")
    found = search.phrase_hits(search.FullTextIndex.build(made), ("of", "the"))
    assert {(r.section_id, r.start, r.end) for r in found.collect()} == {("a", 2, 8), ("a", 13, 19), ("d", 0, 6)}


def test_phrases_as_substrings(spark):
    """As phrase_search's SQL says: also where a word of the phrase stands nowhere by itself."""
    rows = [("a", "roof theatre of the"), ("b", "roof theatre"), ("c", "of  the"), ("d", "of the"), ("e", "of therth"), ("f", "of. the")]
    made = spark.createDataFrame([(k, k, f"{k}.md", "", t) for k, t in rows], "section_id string, document_id string, relative_path string, title string, content string")
    found = search.search(search.FullTextIndex.build(made), '"of the"', alone=False)
    assert {(r.section_id, r.score) for r in found.collect()} == {(k, 2.0) for k, t in rows if "of the" in t}


@pytest.fixture(scope="module")
def many(spark):
    """Two thousand sections in about sixty blocks; one word is nearly everywhere, some are in a few documents only."""
    import random

    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(2000):
        own = r.choices(words, weights=[1 / (k + 1) for k in range(300)], k=r.randint(5, 60)) + (["rare"] * r.randint(1, 9) if i % 400 == 0 else [])
        rows.append((f"s{i:04}", f"d{i // 4}", f"p{i // 4}.md", r.choice(words), " ".join(own)))
    return search.FullTextIndex.build(spark.createDataFrame(rows, "section_id string, document_id string, relative_path string, title string, content string"), block=32)


@pytest.mark.parametrize("require_all", [True, False])
def test_a_batch_finds_what_single_queries_find(spark, many, require_all):
    texts = ["w3 w17", "rare w1", "w2* w250", "absent", "", "w0 w1 w2 w3"]
    found = search.search_many(many, spark.createDataFrame(list(enumerate(texts)), "query_id long, query string"), 10, require_all).collect()
    for i, t in enumerate(texts):
        want = [(r.section_id, round(r.score, 9)) for r in search.search(many, t, require_all=require_all, max_results=10).collect()]
        assert [(r.section_id, round(r.score, 9)) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == i] == want


def test_blocks_and_ranges_are_passed_over(spark, many):
    """A rare word's few blocks outscore the rest; a term's postings are in a part of the files only."""
    plan = search.plan_blocks(many, spark.createDataFrame([(0, "rare w0"), (1, "w299 w298")], "query_id long, query string"), 3, require_all=False)
    need = {r.query_id: (r.need, r.all) for r in plan.blocks.groupBy("query_id").agg(F.count_if("need").alias("need"), F.count("*").alias("all")).collect()}
    assert need[0][1] > 50 and need[0][0] <= need[0][1] // 5
    ranges, folders = many.ranges_of(F.col("term") == "rare"), {f.split("/range=")[1].split("/")[0] for f in many.postings.inputFiles()}
    held = {r.term: r.ranges for r in many.postings.groupBy("term").agg(F.collect_set("range").alias("ranges")).collect()}
    assert sorted(ranges) == sorted(held["rare"]) and len(ranges) < len(folders)
    plan = many.postings_of(F.col("term") == "rare")._jdf.queryExecution().executedPlan().toString()
    assert "range#" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]


def test_the_build_moves_little(spark, many):
    """Three numbers an occurrence until the postings lie in their ranges, no document beside the section, one shuffle for the blocks."""
    from foliospark.operators import index

    rows = spark.createDataFrame([("s", "d", "p.md", "Ä b", "b bX  b")], "section_id string, document_id string, relative_path string, title string, content string")
    tokens = rows.mapInArrow(index._counted, index._TOKENS)
    spread = tokens.where("term = 'b'").select("hits", index._spread(F.lit(0), F.col("tf_title")).alias("title"), index._spread(F.col("tf_title"), F.col("tf_content")).alias("content"))
    r = spread.first()
    assert r.hits == [1, 3, 7, 0, 0, 6, 1, 2, 4, 2, 6, 6]
    assert [tuple(h) for h in r.title] == [(1, 3, 4, True, True)]
    assert [tuple(h) for h in r.content] == [(0, 0, 1, True, False), (1, 2, 3, False, False), (2, 6, 7, True, False)]
    assert "document_id" not in many.postings.columns
    plan = index.FullTextIndex._blocks(many.postings)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_postings_are_delta_coded(spark, many):
    import pyarrow.parquet as pq

    kinds = set()
    for f in many.postings.inputFiles():
        meta = pq.ParquetFile(f.removeprefix("file:").removeprefix("//")).metadata
        for c in range(meta.row_group(0).num_columns):
            col = meta.row_group(0).column(c)
            if col.path_in_schema.endswith("start"):
                kinds |= set(col.encodings)
    assert kinds & {"DELTA_BINARY_PACKED", "RLE_DICTIONARY"}, kinds


def test_segments_equal_a_new_index(spark):
    """Many replacements, one after another, and the merge after SEGMENTS of them: counts and scores as of a new index."""
    columns = "section_id string, document_id string, relative_path string, title string, content string"
    texts = {f"d{i}": f"common word{i % 3} only{i}" for i in range(6)}
    frame = lambda t: spark.createDataFrame([(f"s-{d}", d, f"{d}.md", d, c) for d, c in t.items()], columns)
    own = search.FullTextIndex.build(frame(texts))
    for step in range(3):
        changed = {f"d{step}": f"common changed{step} word1", f"n{step}": "common new"}
        gone = spark.createDataFrame([(f"d{step}",), (f"d{step + 3}",), ("nobody",)], "document_id string")
        own = own.replace(gone, frame(changed))
        texts = {k: v for k, v in texts.items() if k not in (f"d{step}", f"d{step + 3}")} | changed
    new = search.FullTextIndex.build(frame(texts))
    for q in ("common word1", "changed2", "new*"):
        assert [(r.section_id, round(r.score, 9)) for r in search.search(own, q).collect()] == [(r.section_id, round(r.score, 9)) for r in search.search(new, q).collect()]
    assert sorted(map(tuple, own.terms.collect())) == sorted(map(tuple, new.terms.collect())) and own.n == new.n


def test_debounce_scans_any_key(spark):
    """Several keys, a null one, unsorted times, windows over several batches: as counted by hand."""
    import random

    r = random.Random(4)
    rows = [(r.choice(["a", "b", None, "c"]), datetime(2024, 1, 1) + timedelta(milliseconds=r.randint(0, 200_000))) for _ in range(3000)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    got = {(x.user, x.window_start, x.events) for x in feed.debounce(spark.createDataFrame([*rows, ("a", None)], "user string, ts timestamp"), "user", 700).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    ms = lambda t: int((t - datetime(1970, 1, 1)).total_seconds() * 1000 + 0.5)
    want = {(k, s, n) for k in {k for k, _ in rows} for s, n in feed.fixed_windows(sorted(ms(t) for u, t in rows if u == k), 700)}
    assert got == want


def test_long_texts_with_few_edits_differ_fast():
    import random
    import time

    r = random.Random(1)
    old = [f"line {r.randint(0, 50_000)}" for _ in range(100_000)]
    new = list(old)
    for _ in range(25):
        new[r.randrange(len(new))] = "other"
        new.insert(r.randrange(len(new)), "more")
    began = time.time()
    script = diff.line_diff(old, new)
    assert time.time() - began < 1
    assert [t for k, t in script if k != "Added"] == old and [t for k, t in script if k != "Removed"] == new and sum(k != "Context" for k, _ in script) <= 75


def test_both_ways_of_the_diff_agree(monkeypatch):
    import random

    r = random.Random(2)
    pairs = [([r.choice("abc") for _ in range(r.randint(0, 14))], [r.choice("abcd") for _ in range(r.randint(0, 14))]) for _ in range(500)]
    few = [diff.line_diff(a, b) for a, b in pairs]
    monkeypatch.setattr(diff, "FEW", 0)
    assert few == [diff.line_diff(a, b) for a, b in pairs]


def test_merge_rows(spark):
    rows = [(1, "a\nb\nc\n", "x\nb\nc\n", "a\nb\nz\n"), (2, "a\n", "b\n", "c\n"), (3, None, "n\n", None), (4, "a\n", "a\n", "t\n"), (5, "a\n", "s\n", "s\n")]
    merged, clashes = diff.merge_rows(spark.createDataFrame(rows, "id int, base string, ours string, theirs string"), ["id"])
    assert {r.id: r.text for r in merged.collect()} == {1: "x\nb\nz\n", 3: "n\n", 4: "t\n", 5: "s\n"} and [r.id for r in clashes.collect()] == [2]


@pytest.mark.parametrize("text, at, point", [
    ("one two three", 5, 8), ("one two three", 4, 4), ("one two three", 0, 0), ("one two three", 13, 13), ("one  \n two", 1, 7), ("onetwothree four", 2, 12), ("onetwo", 3, 3),
    ("a\n# Head\nmore words here", 14, 2), ("some words\n\n## Next\nx", 3, 12), ("w " + "x" * 60, 40, 2), ("x" * 120, 60, 60), ("no #heading here", 6, 12),
])
def test_split_points(text, at, point):
    assert edits.split_point(text.encode(), at) == point


def test_splits_near_words(spark):
    text = edits.OPERATIONS["split_near"]("d.md", "# T\n\nÄpfel wachsen auf Bäumen.\n", parse("d.md", "# T\n\nx\n")[1].id, 3, "Rest")
    assert text == "# T\n\nÄpfel\n\n# Rest\n\nwachsen auf Bäumen.\n"
    rows = spark.createDataFrame([(1, "Äpfel wachsen", 1), (2, "Äpfel wachsen", 4), (3, None, 0), (4, "a", 9)], "id int, text string, at int")
    assert {r.id: r.point for r in edits.split_points(rows, ["id"]).collect()} == {1: None, 2: 7, 3: 0, 4: None}


def test_snapshot_store(spark, sections):
    versions = history.new_versions(sections, 1)
    store = history.SnapshotStore.empty(sections).create(sections, versions, "one", 1, "first")
    changed = sections.withColumn("content", F.when(F.col("title") == "Rye", "New.").otherwise(F.col("content")))
    both = store.create(changed, versions.unionByName(history.new_versions(changed.where("title = 'Rye'"), 2)), "two", 2)
    assert (both.snapshots.count(), both.members.count(), both.rows.count()) == (4, 12, 7)
    assert both.snapshots.where("label = 'first' and root_version is not null").count() == 2
    one = both.snapshots.where("seq = 1")
    back, differ = both.restore(changed, one)
    assert {(r.section_id, r.content) for r in back.collect()} == {(r.section_id, r.content) for r in sections.collect()} and [r.title for r in differ.collect()] == ["Rye"]
    assert both.get(one.first().snapshot_id).count() == 1
    with pytest.raises(NotFound):
        both.get("snap-none")


EDIT = "document_id string, seq int, op string, args string"


def ops_of(spark, doc, *ops):
    return spark.createDataFrame([(doc, k, op, json.dumps(args)) for k, (op, args) in enumerate(ops)], EDIT)


def test_metadata_lasts_and_locks_hold(space, spark, tmp_path):
    doc = space.import_document("kitchen/bread.md")
    ids_ = {r.title: r.section_id for r in space.catalog.table("sections").collect()}
    rye, bread = ids_["Rye"], ids_["Bread"]
    count = lambda sec: space.catalog.table("versions").where(F.col("section_id") == sec).count()
    assert space.edit(ops_of(spark, doc, ("set_section_metadata", {"section": rye, "metadata": {"tags": ["dark"], "summary": "sticky", "locked": True}}))).count() == 0
    assert count(rye) == 2 and count(bread) == 1
    assert space.edit(ops_of(spark, doc, ("append_to_section", {"section": bread, "content": "Warm."}))).count() == 0
    row = space.load().sections.where(F.col("section_id") == rye).first()
    assert (row.tags, row.summary, row.locked) == (["dark"], "sticky", True)
    before = next(p for p in tmp_path.rglob("*.md") if "Rye" in p.read_text()).read_text()
    assert space.edit(ops_of(spark, doc, ("update_section", {"section": rye, "content": "x"}))).first().error.startswith("Locked")
    assert next(p for p in tmp_path.rglob("*.md") if "Rye" in p.read_text()).read_text() == before
    space.set_lock(doc, rye, False)
    assert space.edit(ops_of(spark, doc, ("update_section", {"section": rye, "content": "x"}))).count() == 0 and space.load().sections.where("locked").count() == 0
    first = space.catalog.table("versions").where(F.col("section_id") == rye).orderBy("seq").first()
    assert space.switch_version(doc, rye, first.version_id).count() == 0
    assert "Rye dough stays sticky." in next(p for p in tmp_path.rglob("*.md") if "Rye" in p.read_text()).read_text() and count(rye) == 4


def test_lifecycle_leaves_one_row_an_id(space, spark, tmp_path):
    doc = space.import_document("garden/soil.md")
    rows = lambda t: space.catalog.table(t).count() if space.catalog.has(t) else 0
    was = rows("sections"), rows("versions")
    space.unmanage_file(doc)
    assert (rows("documents"), rows("inactive")) == (0, 1) and (rows("sections"), rows("versions")) == was
    assert space.manage(doc) == doc and (rows("documents"), rows("inactive"), rows("sections"), rows("versions")) == (1, 0, *was)
    space.remove_file(doc)
    assert not (tmp_path / "garden/soil.md").exists() and (rows("documents"), rows("inactive")) == (0, 1)
    (tmp_path / "garden/soil.md").write_text("# In the way\n")
    with pytest.raises(Conflict):
        space.restore_file(doc)
    space.restore_file(doc, "garden/back.md")
    assert (rows("documents"), rows("inactive"), rows("sections"), rows("versions")) == (1, 0, *was) and (tmp_path / "garden/back.md").read_text() == FILES[0][1]
    with pytest.raises(NotFound):
        space.restore_file(doc)
    space.unmanage_file(doc, archive_history=False)
    assert (rows("documents"), rows("inactive"), rows("sections"), rows("versions")) == (0, 1, 0, 0)
    with pytest.raises(InvalidInput):
        space.restore_file(doc)


def test_edits_meet_what_changed_outside(space, spark, tmp_path):
    """On a held state: changes elsewhere are merged, changes of the same lines and stale versions are errors; the disk keeps what it has."""
    soil, bread = space.import_document("garden/soil.md"), space.import_document(FILES[1][0])
    at = {r.title: r.section_id for r in space.catalog.table("sections").collect()}
    state = space.hold()
    for path, text in FILES:
        (tmp_path / path).write_text(text.replace("What plants stand in.", "What worms dig.") if path == "garden/soil.md" else text.replace("Rye dough stays sticky.", "Rye is dark."))
    todo = ops_of(spark, soil, ("update_section", {"section": at["Compost"], "content": "Warm heap."})).unionByName(ops_of(spark, bread, ("update_section", {"section": at["Rye"], "content": "Sour."})))
    errors = {r.relative_path: r.error for r in space.edit(todo, state=state).collect()}
    assert list(errors) == [FILES[1][0]] and "same place" in errors[FILES[1][0]]
    text = (tmp_path / "garden/soil.md").read_text()
    assert "What worms dig." in text and "Warm heap." in text and "Rye is dark." in (tmp_path / FILES[1][0]).read_text()
    assert {r.title: r.section_id for r in space.catalog.table("sections").collect() if r.title in at} == at
    now = space.catalog.table("versions").where(F.col("section_id") == at["Compost"]).orderBy(F.desc("seq")).first().version_id
    expect = lambda v: space.edit(ops_of(spark, soil, ("append_to_section", {"section": at["Compost"], "content": "More."})).withColumn("expected_version", F.lit(v)))
    assert "expected ver-old" in expect("ver-old").first().error and "More." not in (tmp_path / "garden/soil.md").read_text()
    assert expect(now).count() == 0 and "More." in (tmp_path / "garden/soil.md").read_text()


def test_children_and_deletes(spark):
    text = "# A\n\na\n\n## B\n\nb\n\n### C\n\nc\n\n## D\n\nd\n\n# E\n\ne\n"
    s = workspace.sections_of(spark.createDataFrame([("t.md", text), ("u.md", "# A\n")], "relative_path string, markdown string")).cache()
    one = s.where("relative_path = 't.md' and title = 'A'")
    assert [r.title for r in tree.children(s, one).orderBy("ordinal").collect()] == ["B", "D"]
    left, gone = tree.delete_sections(s, s.where("title = 'B' or level = 0"))
    assert sorted(r.title for r in gone.collect()) == ["B", "C"]
    assert {(r.relative_path, r.title, r.ordinal) for r in left.collect()} == {("t.md", "t", 0), ("t.md", "A", 0), ("t.md", "D", 0), ("t.md", "E", 1), ("u.md", "u", 0), ("u.md", "A", 0)}


def test_restoring_many_of_one_path(spark):
    columns = "document_id string, relative_path string, managed boolean"
    documents = spark.createDataFrame([("d1", "a.md", True)], columns)
    archived = spark.createDataFrame([("d2", "b.md", True, True), ("d3", "b.md", True, True), ("d4", "a.md", True, True), ("d5", "c.md", True, False)], columns + ", archived_history boolean")
    active, inactive = catalog.restore_files(documents, archived, archived.select("document_id"))
    assert sorted(r.document_id for r in active.collect()) == ["d1", "d2"] and sorted(r.document_id for r in inactive.collect()) == ["d3", "d4", "d5"]
