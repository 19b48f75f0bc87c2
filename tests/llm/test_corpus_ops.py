"""Source divergence, collocations, WARC archives: against their SQL in DuckDB on small tables, and exact round trips."""

import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import zstandard

from foliospark.errors import StorageError
from foliospark.llm import collocations, divergence, warc
from foliospark.llm.common import slices

COLUMNS = "doc_id long, text string, lang string, source string, term string, n long"


def texts(n=260, seed=3):
    """Few words, so that many are frequent; ties, repeated rows, nulls, empty texts, a language without frequent terms, one very long text."""
    r = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Über", "ÜBER", "naïve", "Don't", "x2y", "日本語"]
    out = []
    for i in range(n):
        own = r.choices(words, weights=[60 / (k + 1) for k in range(len(words))], k=r.randint(0, 40))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(own))
            own[at:at] = r.choice([["new", "york", "city"], ["New", "York"], ["in", "spite", "of", "it"], ["a", "a", "a"]])
        text = "".join(w + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "! "]) for w in own)
        out.append((i, text, r.choice(["en", "en", "en", "de", None]), r.choice(["a", "b", "b", "c", None, "ünder"]), "x", i))
    out += [out[5]] * 7 + [(None, "wa wb", "en", "a", None, None), (900, None, "en", "only", None, None), (901, "", "fr", "a", None, None), (902, "tous", "fr", "b", None, None), (903, None, None, None, None, None)]
    out.append((904, "new york city wa wb. " * 120_000, "en", "a", None, None))
    return out


def same(df, sql, name, rows, columns, types):
    con = duckdb.connect()
    con.register(name, pa.Table.from_pylist([dict(zip(columns, r, strict=True)) for r in rows], schema=pa.schema(types)))
    want = con.sql(sql).to_arrow_table().to_pylist()
    got = [r.asDict() for r in df.collect()]
    key = lambda r: repr(sorted(r.items()))
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


DOC_TYPES = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64())]
DOC_NAMES = [n for n, _ in DOC_TYPES]


@pytest.mark.parametrize("tile", [1024, 2])
def test_divergence_like_sql(spark, monkeypatch, tile):
    monkeypatch.setattr(divergence, "TILE", tile)
    rows = texts()
    got = same(divergence.divergence(spark.createDataFrame(rows, COLUMNS).repartition(3)), divergence.ORACLE_SQL, "documents", rows, DOC_NAMES, DOC_TYPES)
    assert {r["part"] for r in got} == {"pair", "term"} and {r["value"] for r in got if r["lang"] == "fr"} == {0}


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], COLUMNS)).count() == 0
    alone = divergence.divergence(spark.createDataFrame([(1, "a b c", "en", "s", None, None)], COLUMNS))
    assert alone.count() == 0


def test_runs_do_not_depend_on_chunks(monkeypatch):
    rows = [(i, (lang or "").encode(), (source or "").encode(), (text or "").encode()) for i, text, lang, source, *_ in texts()[:200]]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.binary(), pa.binary(), pa.binary()], strict=True)], ["doc_id", "lang", "source", "text"])
    sums = []
    for most in (50, 2_000_000):
        monkeypatch.setattr(divergence, "CHUNK_TERMS", most)
        f = pd.concat([pd.DataFrame(b.to_pydict()) for b in divergence._chunks(iter([batch]))])
        sums.append(f.groupby(["lang", "term", "source"])[["df", "n"]].sum())
    assert sums[0].equals(sums[1]) and len(sums[0]) > 100


def test_products_beyond_64_bits():
    import numpy as np

    n, of, terms = 5_000_000_000_000_000, 7_000_000_000_000_001, 12_345
    assert divergence.smoothed(np.array([n]), np.array([of]), terms).tolist() == [1 + 10**9 * (n + 5) // (of + 5 * terms)]


def test_collocations_like_sql(spark):
    rows = texts(900)
    got = same(collocations.collocations(spark.createDataFrame(rows, COLUMNS).repartition(3)), collocations.ORACLE_SQL, "documents", rows, DOC_NAMES, DOC_TYPES)
    phrases = {(r["lang"], r["phrase"]) for r in got}
    assert ("en", "york city wa") not in phrases and ("en", "new york city wa") in phrases and {r["lang"] for r in got} == {"en", "de", "und"}


def test_collocation_words_are_split_without_a_match_for_each():
    """Bytes of any kind split as the definition says: separators stay as one mark, spaces and tabs go, only A-Z change."""
    import re

    rnd = random.Random(12)
    for _ in range(5000):
        text = bytes(rnd.choice(b"aAzZ09 \t.,;:!?\n\x0b\x0c\r\x00\x1c\x85\xc3\xa9\xff[@`{") for _ in range(rnd.randint(0, 30)))
        pieces = [re.findall(rb"[^ \t]+", piece) for piece in re.split(rb"[.,;:!?\x0a-\x0d]", text.lower())]
        assert collocations.tokens(text) == [w for i, piece in enumerate(pieces) for w in ([b"\n"] if i else []) + piece]
    ids = np.array([rnd.randint(0, 3) for _ in range(500)])
    for k in (1, 2, 3, 4):
        at, n = collocations.distinct_phrases(ids, np.arange(496), k)
        phrases = [tuple(ids[i : i + k]) for i in range(496)]
        assert {phrases[i]: c for i, c in zip(at, n, strict=True)} == dict(Counter(phrases)) and len(at) == len(set(phrases))


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], COLUMNS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, "a b", "en", "s", None, None)], COLUMNS)).count() == 0


@pytest.mark.parametrize("chunk", [40, 7, 2_000_000])
def test_phrases_across_chunks(monkeypatch, chunk):
    """A long text that is cut into chunks gives the phrases of the whole."""
    monkeypatch.setattr(collocations, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(collocations, "slices", lambda text, gap: slices(text, gap, 5))
    text = b"a b c a b, c a b c d a b. " * 30
    batch = pa.RecordBatch.from_pydict({"lang": pa.array([b"en", b"en"], pa.binary()), "text": pa.array([text, b"a b"], pa.binary())})
    found = {}
    for b in collocations._pass(2, None, _Fixed(True), _Fixed(False))(iter([batch])):
        for p, n in zip(b.column("phrase").to_pylist(), b.column("n").to_pylist(), strict=True):
            if p is not None:
                found[p] = found.get(p, 0) + n
    want = {}
    for piece in [p for t in (text, b"a b") for p in t.replace(b",", b".").split(b".")]:
        w = piece.split()
        for x in zip(w, w[1:]):
            want[b" ".join(x)] = want.get(b" ".join(x), 0) + 1
    assert found == want


class _Fixed:
    """A broadcast filter or bitmap that lets everything through."""

    def __init__(self, words):
        import numpy as np

        self.value = np.full(1 << 10, -1, np.int64).view(np.uint64) if words else np.full(1 << collocations.BUCKET_BITS - 3, 255, np.uint8)


PAGES = "page_id long, url string, html string, digest string, first long"


def pages():
    r = random.Random(5)
    out = [(i, f"http://h{i % 5}.example/a b\n{i}", r.choice(["<p>" + "short" * r.randint(0, 30), f"<html>page {i} " + "ü body " * r.randint(1, 300), "same" * 25, "less" * 24 + "123", None]), "d", 1) for i in range(120)]
    return out + [(3, out[3][1], out[3][2], None, None), (500, None, "copy" * 50, None, None), (500, None, "copy" * 50, None, None), (None, None, "copy" * 50, None, None), (None, None, "only null " * 20, None, None), (None, None, "only null " * 20, None, None), (600, "u", "x" * 3_000_000, None, None)]


@pytest.mark.parametrize("size", [64 << 20, 20_000])
def test_archives_come_back(spark, tmp_path, size):
    rows = pages()
    warc.write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"), size)
    got = warc.read_archives(spark, str(tmp_path / "w"), with_payload=True).toPandas()
    text = {(r["page_id"] if r["page_id"] == r["page_id"] else None, r["payload_digest"]): None for _, r in got.iterrows()}
    assert len(got) == len(rows) and len(text) == len({(p, h or "") for p, _, h, *_ in rows})
    first = {}
    for p, _, h, *_ in rows:
        key = (h or "").encode()
        first[key] = min(first.get(key, float("inf")), p if p is not None else float("inf"))
    want, seen = [], set()
    for p, _, h, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (h or "").encode()
        again = len(raw) >= 100 and raw in seen
        seen.add(raw)
        want.append((p, len(raw), "revisit" if again else "response", first[raw] if again and first[raw] != float("inf") else None, None if again else raw))
    clean = lambda x: None if x is None or x != x else int(x)
    have = [(clean(p), int(n), k, clean(f), b if b is None else bytes(b)) for p, n, k, f, b in got[["page_id", "payload_bytes", "record_type", "refers_to", "payload"]].itertuples(index=False)]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_a_record_can_be_read_alone(spark, tmp_path):
    """A reader takes the dictionary from the head of the file and one frame from its place."""
    warc.write_archives(spark.createDataFrame(pages(), PAGES), str(tmp_path / "w"))
    row = warc.read_archives(spark, str(tmp_path / "w"), with_payload=True).where("page_id = 600").first()
    raw = open(row["archive"].removeprefix("file:"), "rb").read()
    assert raw[:4] == warc.DICTIONARY_MAGIC
    dictionary = zstandard.ZstdCompressionDict(raw[8 : 8 + int.from_bytes(raw[4:8], "little")])
    one = zstandard.ZstdDecompressor(dict_data=dictionary).decompress(raw[row["offset"] : row["offset"] + row["length"]], max_output_size=4_000_000)
    assert one.startswith(b"WARC/1.1\r\nWARC-Type: response") and one.endswith(b"x\r\n\r\n") and dictionary.dict_id() != 0
    fields, http, payload = warc.parsed(one)
    assert payload == b"x" * 3_000_000 and int(http["content-length"]) == len(payload) and fields["warc-target-uri"] == "u"


def test_archives_of_few_or_no_pages(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0
    warc.write_archives(spark.createDataFrame([(1, "u\r\nWARC-Type: resource", None, None, None)], PAGES), str(tmp_path / "one"))
    got = warc.read_archives(spark, str(tmp_path / "one")).first()
    assert (got["page_id"], got["payload_bytes"], got["record_type"], got["url"]) == (1, 0, "response", "u%0D%0AWARC-Type:%20resource")


def test_broken_archives_are_errors():
    frames = list(warc.frames(iter([warc.record(1, "u", b"abc" * 50, "00", 0, None)] * 3)))
    with pytest.raises(StorageError):
        list(warc.unpacked(b"".join(frames)[:-3]))
    with pytest.raises(StorageError):
        warc.parsed(warc.record(1, "u", b"abc", "00", 0, None)[:-1])


@pytest.mark.parametrize("name, sql", [("op11_source_divergence", divergence.ORACLE_SQL), ("op12_phrase_collocations", collocations.ORACLE_SQL), ("op13_warc_archives", warc.ORACLE_SQL)])
def test_queries_over_given_tables(spark, name, sql):
    from foliospark.llm import queries

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.sql(sql).to_arrow_table().to_pylist()
    got = [r.asDict() for r in queries.QUERIES[name](spark, folder).collect()]
    key = lambda r: repr(sorted(r.items()))
    assert sorted(got, key=key) == sorted(want, key=key)
