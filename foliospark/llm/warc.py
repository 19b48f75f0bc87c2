"""WARC archives of web pages, compressed record by record with a Zstandard dictionary that each archive carries.

Method: the records of an archive come sorted by page_id; the first TRAIN_BYTES of them train a dictionary, which stands uncompressed in a
skippable frame (magic 0x184D2A5D) at the head of the file; then every record is a Zstandard frame of its own, so that a reader can
start at any record. A record whose payload an earlier page has already is a revisit: it keeps the headers and refers to that
page's response.

Where it runs: equal payloads are found by SHA-256 on (digest, page_id) alone; the pages are shuffled once, by page_id and
digest, into as many partitions as archives of ``archive_bytes`` need. Each partition is one file, written by Spark's own text
writer and its commit protocol: any file system that Spark knows will do, and a retried task leaves no second file. The
writer's line separator is an empty skippable frame, which Zstandard readers pass over. Reading is a scan of binary files, one at a time in a task, so an archive must fit a task's
memory several times; a page must fit into a task's memory too.

Cases: null html is an empty payload; a null page_id sorts behind all others and comes back as null; rows with equal page_id and payload of
at least LEAST_PAYLOAD bytes are one response and revisits of the same page_id; a null url becomes a urn of the page; spaces and control
characters of a url are percent-encoded; too few records for a training give an archive without a dictionary; an empty
table gives no records; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StorageError
from ..storage import shared_folder, stored
from .common import arrow_batches, table

LEAST_PAYLOAD = 100
ARCHIVE_BYTES, TRAIN_BYTES, DICTIONARY_BYTES, LEVEL = 64 << 20, 4 << 20, 64 << 10, 3
#: pages has no date of capture.
DATE = "1970-01-01T00:00:00Z"
DICTIONARY_MAGIC = (0x184D2A5D).to_bytes(4, "little")
#: An empty skippable frame; its bytes are ASCII, as a line separator's must be.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uri(url: str | None, page: int | None) -> str:
    return f"urn:x-page:{page}" if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record_id(page: int | None, digest: str, copy: int) -> str:
    return f"<urn:x-page:{'' if page is None else page}:{digest[:32]}:{copy}>"


def _page_of(record_id: str) -> int | None:
    page = record_id.strip("<>").split(":")[2]
    return int(page) if page else None


def record(page: int | None, url: str | None, payload: bytes, digest: str, copy: int, refers: tuple[int | None] | None, date: str = DATE) -> bytes:
    """A response, or a revisit where ``refers`` holds the page_id of the response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {_record_id(page, digest, copy)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url, page)}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response",
    ]
    if refers:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers[0], digest, 0)}", f"WARC-Refers-To-Date: {date}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def trained(records: list[bytes], size: int = DICTIONARY_BYTES):
    """A dictionary of the records, or None where there is too little to learn from."""
    import zstandard

    for samples in (records, [r[i : i + 1024] for r in records for i in range(0, len(r), 1024)]):
        try:
            return zstandard.train_dictionary(min(size, max(1024, sum(map(len, records)) // 8)), samples)
        except zstandard.ZstdError:
            continue
    return None


def frames(records: Iterator[bytes], train_bytes: int = TRAIN_BYTES, level: int = LEVEL) -> Iterator[bytes]:
    """The frames of an archive: its dictionary, then one for each record."""
    import zstandard

    first, size = [], 0
    for r in records:
        first.append(r)
        size += len(r)
        if size >= train_bytes:
            break
    if not first:
        return
    dictionary = trained(first)
    if dictionary is not None:
        raw = dictionary.as_bytes()
        yield DICTIONARY_MAGIC + len(raw).to_bytes(4, "little") + raw
    packer = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
    for r in first:
        yield packer.compress(r)
    first.clear()
    for r in records:
        yield packer.compress(r)


def _archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[bytes]:
        before, copy = None, 0
        for b in batches:
            for page, url, html, digest, revisit, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "revisit", "first")), strict=True):
                copy = copy + 1 if (page, digest) == before else 0
                before = (page, digest)
                again = revisit or copy > 0 and len(html) >= LEAST_PAYLOAD
                yield record(page, url, html, digest, copy, ((first if revisit else page),) if again else None)

    out, size = [], 0
    for f in frames(records()):
        out.append(f)
        size += len(f)
        if size >= 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of all pages in the folder ``path``, one a partition."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    keys = stored(rows.select("page_id", "digest", F.octet_length("html").cast("long").alias("size")), "pages")
    total = keys.agg(F.sum("size")).first()[0] or 0
    shared = keys.where(F.col("size") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    again = keys.join(shared, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first").distinct()
    key = F.concat_ws(":", "digest", F.col("page_id").cast("string")).alias("key")  # never null, so that the join keeps the partitioning
    dealt = rows.withColumn("key", key).repartition(max(1, -(-total // archive_bytes)), "key")
    held = dealt.join(again.select(key, "first", F.lit(True).alias("revisit")), "key", "left").select(*dealt.columns, F.coalesce("revisit", F.lit(False)).alias("revisit"), "first").sortWithinPartitions("page_id", "digest")
    with arrow_batches(spark):
        held.mapInArrow(_archive, "frame binary").select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR).text(path)


def unpacked(archive: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of each record of an archive; skippable frames but the dictionary's are passed over."""
    import zstandard

    view, at, reader = memoryview(archive), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        if view[at + 1 : at + 4] == b"*M\x18" and view[at] & 0xF0 == 0x50:
            size = int.from_bytes(view[at + 4 : at + 8], "little")
            if view[at : at + 4] == DICTIONARY_MAGIC:
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8 : at + 8 + size])))
            at += 8 + size
            continue
        one, out, end = reader.decompressobj(), [], at
        while not one.eof:
            if end >= len(view):
                raise StorageError("an archive ends inside a record")
            out.append(one.decompress(view[end : end + (16 << 10)]))
            end = min(end + (16 << 10), len(view))
        end -= len(one.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The fields of a record, those of its HTTP block, and the payload."""

    def split(block: bytes) -> tuple[dict[str, str], bytes]:
        head, _, rest = block.partition(b"\r\n\r\n")
        return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}, rest

    fields, rest = split(raw)
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise StorageError(f"record {fields.get('warc-record-id')} has another length than it says")
    http, payload = split(rest[:size])
    return fields, http, payload


_READ = "archive string, offset long, length long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def _records(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows, size = [], 0
                for offset, length, raw in unpacked(content.as_buffer()):
                    fields, http, payload = parsed(raw)
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise StorageError(f"the payload of {fields['warc-record-id']} is not what its digest says")
                    refers = _page_of(fields["warc-refers-to"]) if kind == "revisit" else None
                    rows.append((path, offset, length, _page_of(fields["warc-record-id"]), fields["warc-target-uri"], kind, int(http["content-length"]), digest, refers, *[payload if kind == "response" else None] * with_payload))
                    size += len(raw)
                    if size >= 8 << 20:
                        yield from _batch(rows, with_payload)
                        rows, size = [], 0
                yield from _batch(rows, with_payload)

    return run


def _batch(rows: list[tuple], with_payload: bool) -> Iterator[pa.RecordBatch]:
    if rows:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]
        names = [x.split()[0] for x in _READ.split(", ")] + ["payload"] * with_payload
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """archive, offset, length, page_id, url, record_type, payload_bytes, payload_digest, refers_to of each record, and payload on demand; digests are verified."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_records(with_payload), _READ + ", payload binary" * with_payload)


def op13_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    with arrow_batches(spark, 1):  # an archive at a time
        read = stored(read_archives(spark, path).drop("archive", "offset", "length", "url"), "warc-records")
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id::BIGINT AS page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
