"""Neighbour graphs, segments, encoders, the embedding cache, embedding in the background."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.errors import InvalidInput, StorageError
from foliospark.operators import embedding, semantic
from foliospark.operators.embedding import EmbeddingCache, Embeddings, hashed_encoder
from foliospark.operators.semantic import SemanticIndex

VECTORS = "id string, vector array<float>, model string"


def nearest(rows, q, k):
    own = sorted((float(np.sqrt(((np.array(v, np.float64) - q) ** 2).sum())), i) for i, v in rows.items())
    return [i for _, i in own[:k]]


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(1)
    centres = r.normal(size=(30, 16))
    rows = {f"v{i:04}": (centres[i % 30] + r.normal(size=16) * 0.3).astype(np.float32) for i in range(1200)}
    queries = [(j, (centres[j] + r.normal(size=16) * 0.3).astype(np.float32)) for j in range(25)]
    return rows, queries


def frame(spark, rows, model="m"):
    return spark.createDataFrame([(i, [float(x) for x in v], model) for i, v in rows.items()], VECTORS)


def asked(spark, queries):
    return spark.createDataFrame([(j, [float(x) for x in v], "m") for j, v in queries], "query_id long, vector array<float>, model string")


def recall(found, rows, queries, k=10):
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.id)
    return np.mean([len(got.get(j, set()) & set(nearest(rows, v.astype(np.float64), k))) / k for j, v in queries])


@pytest.mark.parametrize("way", ["broadcast", "shuffle"])
def test_recall_over_several_cells(spark, data, monkeypatch, way):
    rows, queries = data
    if way == "shuffle":
        monkeypatch.setattr(semantic, "BROADCAST", 1000)
    index = SemanticIndex.build(frame(spark, rows), cell=300)
    assert index.sizes == ((1200, 4),)
    found = index.search(asked(spark, queries)).cache()
    assert recall(found, rows, queries) >= 0.9
    one = found.where("query_id = 3").orderBy("rank").collect()
    assert [r["rank"] for r in one] == list(range(1, 11)) and [r.distance for r in one] == sorted(r.distance for r in one) and one[0].score == 1 / (1 + one[0].distance)


def test_the_beam_leaves_most_vectors_alone(data):
    r = np.random.default_rng(2)
    centres = r.normal(size=(100, 32))
    vectors = centres[r.integers(0, 100, 6000)] + r.normal(size=(6000, 32)) * 0.2
    edges, norms, visited, hits = semantic.neighbour_graph(vectors), (vectors * vectors).sum(1), [], []
    for q in vectors[:40] + r.normal(size=(40, 32)) * 0.1:
        at, _ = semantic.beam(vectors, norms, edges, np.ones(6000, bool), q, 10, 100, visited)
        hits.append(len(set(at) & set(np.argsort(((vectors - q) ** 2).sum(1))[:10])) / 10)
    assert np.mean(visited) < 6000 / 4 and np.mean(hits) >= 0.9



@pytest.mark.parametrize("kind", ["spread", "copies"])
def test_a_cells_beam_is_as_wide_as_its_vectors_need(kind):
    """Vectors without clusters, whose near ones are hardly nearer than others, and vectors that many ids share."""
    import pandas as pd

    r = np.random.default_rng(4)
    vectors = r.normal(size=(8000, 64)) if kind == "spread" else r.normal(size=(100, 64))[np.arange(3000) % 100]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    ids = [f"{i:04}" for i in range(len(vectors))]
    row = semantic._build((0, 64), pd.DataFrame({"id": ids, "model": "m", "vector": list(vectors)})).iloc[0].to_dict() | {"dead": None}
    queries = np.stack([vectors[r.integers(0, len(vectors), 500)].mean(0) for _ in range(30)])
    found = semantic._search(row, np.arange(30), queries, 10, semantic.LEAST_EF).groupby("query_id")["id"].agg(set)
    held = vectors.astype(np.float32).astype(np.float64)
    exact = [{ids[i] for i in np.lexsort((np.arange(len(ids)), np.sqrt(((held - q) ** 2).sum(1))))[:10]} for q in queries]
    assert np.mean([len(found[j] & exact[j]) / 10 for j in range(30)]) >= 0.95


def test_segments_equal_a_rebuild(spark, data):
    """Removed, replaced and added vectors; an exhaustive beam makes both exact. Changes beyond a quarter merge the segments."""
    rows, queries = data
    index = SemanticIndex.build(frame(spark, rows), cell=300)
    gone = list(rows)[:40]
    fresh = {f"v{i:04}": rows[f"v{i + 500:04}"] + np.float32(0.01) for i in range(40, 80)} | {f"n{i}": rows[f"v{i:04}"] for i in range(20)}
    changed = index.replace(spark.createDataFrame([(i,) for i in gone], "id string"), frame(spark, fresh), cell=300)
    now = {k: v for k, v in rows.items() if k not in gone} | fresh
    assert len(changed.sizes) == 2 and changed.living().count() == len(now)
    key = lambda f: sorted((r.query_id, r["rank"], r.id) for r in f.collect())
    assert key(changed.search(asked(spark, queries), ef=5000)) == key(SemanticIndex.build(frame(spark, now), cell=300).search(asked(spark, queries), ef=5000))
    again = changed.replace(spark.createDataFrame([("n3",)], "id string"))
    assert recall(again.search(asked(spark, queries), ef=5000), {k: v for k, v in now.items() if k != "n3"}, queries) == 1.0
    merged = again.replace(spark.createDataFrame([(f"v{i:04}",) for i in range(600, 1100)], "id string"), cell=300)
    assert len(merged.sizes) == 1 and merged.gone is None and merged.sizes[0][0] == len(now) - 1 - 500


def test_vectors_of_other_lengths_models_and_filters(spark):
    rows = spark.createDataFrame([("a", [0.0, 0.0], "m"), ("b", [1.0, 0.0], "x"), ("c", [3.0, 0.0], None), ("d", [1.0], "m"), ("e", None, "m"), ("f", [], "m"), (None, [0.0, 0.0], "m")], VECTORS)
    index = SemanticIndex.build(rows)
    q = spark.createDataFrame([(1, [0.0, 0.0], "m"), (2, [0.0], "m"), (3, [], "m"), (4, [0.0, 0.0, 0.0], "m")], "query_id long, vector array<float>, model string")
    assert {(r.query_id, r.id, r.distance) for r in index.search(q, 2).collect()} == {(1, "a", 0.0), (1, "b", 1.0), (2, "d", 1.0)}
    assert {(r.query_id, r.id) for r in index.search(q, 2, same_model=True).collect()} == {(1, "a"), (2, "d")}
    paths = spark.createDataFrame([("a", "x/1.md"), ("b", "y/2.md"), ("c", "y/3.md"), ("d", "y/4.md")], "id string, relative_path string")
    kept = index.search(q, 2, sections=paths, where=F.col("relative_path").startswith("y/"))
    assert {(r.query_id, r.id) for r in kept.collect()} == {(1, "b"), (2, "d")}  # the filter comes after the top two
    assert SemanticIndex.build(rows.where("false")).search(q).count() == 0


def test_the_encoder_is_loaded_once_a_task(spark, tmp_path):
    marks = str(tmp_path)

    def load():
        import os
        import uuid

        open(os.path.join(marks, uuid.uuid4().hex), "w").close()
        return hashed_encoder(8)

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    texts = spark.range(100).select(F.concat(F.lit("Text "), F.col("id").cast("string")).alias("t")).repartition(1)
    assert [len(r.v) for r in texts.select(embedding.encoder(load)(F.col("t")).alias("v")).collect()] == [8] * 100
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(list(tmp_path.iterdir())) == 1


def test_cache_round_trip(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "cache"))
    assert cache.entries().count() == 0 and cache.stats().first().entries == 0
    r = np.random.default_rng(3)
    rows = [(f"s{i}", "h1", m, [float(np.float32(x)) for x in np.round(r.normal(size=256), 1)]) for i in range(200) for m in ("m1", "m2")]
    make = lambda rows: spark.createDataFrame(rows, "section_id string, content_hash string, model string, vector array<float>")
    cache.put(make(rows))
    table = lambda: sorted((x.section_id, x.content_hash, x.model, tuple(x.vector)) for x in cache.entries().collect())
    assert table() == sorted((s, h, m, tuple(v)) for s, h, m, v in rows)
    stats = cache.stats().first()
    assert (stats.entries, stats.models, stats.raw_bytes) == (400, 2, 400 * 256 * 4) and stats.ratio > 1
    before = {f for f in cache.rows().inputFiles()}
    cache.put(make([("s5", "h1", "m1", [1.0]), ("s5", "h2", "m1", [2.0]), ("new", "h1", "m3", [3.0])]))
    after = {f for f in cache.rows().inputFiles()}
    assert len(before - after) == 1 and len(after - before) == 2  # one range of m1 was replaced, one of m3 is new
    want = {(s, h, m): tuple(v) for s, h, m, v in rows} | {("s5", "h1", "m1"): (1.0,), ("s5", "h2", "m1"): (2.0,), ("new", "h1", "m3"): (3.0,)}
    assert {x[:3]: x[3] for x in table()} == want
    assert {x.vector[0] for x in cache.get(make([("s5", "h2", "m1", None), ("s5", "h9", "m1", None)])).collect()} == {2.0}
    cache.remove(make([("s5", None, None, None), ("new", None, None, None)]))
    assert {x[:3] for x in table()} == {k for k in want if k[0] not in ("s5", "new")} and cache.load("m3").where("section_id is not null").count() == 0
    cache.clear()
    assert cache.entries().count() == 0 and cache.stats().first().raw_bytes == 0


def test_embedding_goes_on_after_a_failure(spark, tmp_path):
    """The second of four batches fails; run again, only what is missing is encoded, and only then the index is open."""
    source, mark = str(tmp_path / "source"), tmp_path / "broken"
    for i in range(4):
        spark.createDataFrame([(f"s{i}{j}", f"T{i}", f"text {i} {j}") for j in range(5)], "section_id string, title string, content string").coalesce(1).write.mode("append").parquet(source)
    mark.write_text("x")
    flag, log = str(mark), str(tmp_path / "log")

    def load():
        import os

        def encode(texts):
            if os.path.exists(flag) and any(t.startswith("T2") for t in texts):
                raise RuntimeError("the model is gone")
            with open(log, "a") as f:
                f.write("".join(t.replace("\n", " ") + "\n" for t in texts))
            return hashed_encoder(8)(texts)

        return encode

    job = Embeddings(spark, source, str(tmp_path / "state"), "hashed", load)
    sections = spark.read.parquet(source)
    with pytest.raises(StorageError):
        job.index(sections)
    with pytest.raises(Exception, match="the model is gone"):
        job.catch_up(files=1)
    assert not job.ready() and job.cache.entries().count() < 20
    mark.unlink()
    job.catch_up(files=1)
    assert job.ready() and job.cache.entries().count() == 20 and job.index(sections).sizes == ((20, 1),)
    encoded = open(log).read().split("\n")[:-1]
    assert len(encoded) == len(set(encoded)) == 20
    spark.createDataFrame([("s00", "T0", "changed"), ("s01", "T0", "text 0 1")], "section_id string, title string, content string").write.mode("append").parquet(source)
    job.catch_up()
    assert job.cache.entries().count() == 21 and open(log).read().endswith("T0 changed\n")


def test_search_by_text(spark):
    texts = [("a", "Bread", "dough rises"), ("b", "Soil", "worms dig"), ("c", "Rye", "dough is sticky")]
    cacheless = spark.createDataFrame(texts, "id string, title string, content string").select("id", embedding.encoder(hashed_encoder)(F.concat_ws("\n", "title", "content")).alias("vector"))
    index = SemanticIndex.build(cacheless)
    q = spark.createDataFrame([(1, "rye dough is sticky"), (2, "worms dig soil")], "query_id long, query string")
    found = embedding.search_texts(index, q, "hashed", hashed_encoder, k=1)
    assert {(r.query_id, r.id, r.distance) for r in found.collect()} == {(1, "c", 0.0), (2, "b", 0.0)}
    with pytest.raises(InvalidInput):
        embedding.search_texts(index, q, "hashed", None)
