"""A folder of Markdown files as tables, and tables as files."""

from __future__ import annotations

import fnmatch
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schema
from ..errors import InvalidInput
from ..functions.text import document_name, is_markdown_path, sha256
from ..ids import derived_id
from . import folder
from .markdown import rows_of


def relative_to(path, root: str):
    """A file's path below a root, whatever the schemes of the two are."""
    base = root.rstrip("/").split("://")[-1]
    base = ("/" + base.lstrip("/")) if "://" not in root or root.startswith("file:") else base[base.find("/") :] if "/" in base else ""
    plain = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    quoted = "".join("\\" + c if not c.isalnum() else c for c in re.sub("/+", "/", base))
    return F.regexp_replace(F.regexp_replace(plain, "^/+", "/"), f"^{quoted}/", "")


def discover(spark: SparkSession, root: str, rules: str = "") -> DataFrame:
    """(relative_path, markdown) of the Markdown files under root, less reserved folders, ignored paths and, on a local disk, symbolic links.

    Tasks list and read them where Arrow reaches the folder; Spark's own reader, for other file systems, lists all files on the driver.
    """
    found = folder.listed(spark, root) if _there(spark, root) else None
    if found is not None:
        found = found.where(is_markdown_path(F.col("relative_path")))
        found = found.where(~ignored(F.col("relative_path"), rules)) if rules else found
        return folder.contents(found, root).select("relative_path", F.col("content").cast("string").alias("markdown"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dD]").load(root)
    own = files.select(relative_to(F.col("path"), root).alias("relative_path"), F.col("content").cast("string").alias("markdown")).where(is_markdown_path(F.col("relative_path")))
    links = _links(root)
    if links:
        own = own.where(~F.exists(F.array(*[F.lit(x) for x in links]), lambda x: (F.col("relative_path") == x) | F.col("relative_path").startswith(F.concat(x, F.lit("/")))))
    return own.where(~ignored(F.col("relative_path"), rules)) if rules else own


def _there(spark: SparkSession, root: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _links(root: str) -> list[str]:
    """Symbolic links below a folder of the driver's own disk; other file systems have none."""
    if "://" in root and not root.startswith("file:"):
        return []
    top = re.sub(r"^file:/*", "/", root)
    return sorted(os.path.relpath(os.path.join(d, n), top) for d, folders, names in os.walk(top) for n in folders + names if os.path.islink(os.path.join(d, n)))


def parse_rules(text: str) -> list[tuple[str, bool]]:
    """(pattern, negated) in order; blank lines and # comments are left out, a leading / is dropped."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            negated = line.startswith("!")
            out.append((line[negated:].lstrip("/").rstrip("/"), negated))
    return out


def ignored(path, rules: str):
    """The last matching rule decides; a pattern without a separator matches any component of the path."""
    def as_regex(p: str) -> str:
        return fnmatch.translate(p).replace(r"\Z", "$").replace(r"\z", "$").replace("(?s:", "(?:").replace("(?>", "(?:")

    out = F.lit(False)
    for pattern, negated in parse_rules(rules):
        if "/" in pattern:
            hit = path.rlike("^" + as_regex(pattern).rstrip("$") + "(?:/.*)?$")
        else:
            hit = _any_part(path, "^" + as_regex(pattern))
        out = F.when(hit, F.lit(not negated)).otherwise(out)
    return out


def _any_part(path, regex: str):
    return F.exists(F.split(path, "/", -1), lambda c: c.rlike(regex))


#: Characters of the texts that a Python worker has results of at a time.
PORTION = 1 << 20


def arrow_portions(batch: pa.RecordBatch, column: str, size: int = PORTION) -> Iterator[list[tuple]]:
    """A batch's rows in turn, in runs whose texts have about ``size`` bytes: only one run at a time becomes Python objects, the rest stays Arrow's."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    place = (np.cumsum(lengths) - lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(lengths)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield list(zip(*(c.to_pylist() for c in batch.slice(a, b - a).columns), strict=True))


def portions(f: pd.DataFrame, column: str, size: int = PORTION) -> Iterator[pd.DataFrame]:
    """A frame in turn, in runs of rows whose texts have about ``size`` characters: what is made of them stays small, however large an Arrow batch is."""
    lengths = f[column].str.len().fillna(0).to_numpy()
    place = (np.cumsum(lengths) - lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1), len(f)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield f.iloc[a:b]


def sections_of(files: DataFrame) -> DataFrame:
    """The sections table of (relative_path, markdown) rows: a map over the files, no shuffle.

    Files may have ``ids`` (of their sections, in order) and ``metadata`` (section id to JSON with tags, summary, locked).
    """
    def rows(path, text, ids, meta):
        return rows_of(path, text or "", ids, {k: json.loads(v) for k, v in dict(meta if meta is not None else {}).items()})

    def parse_all(batches):
        for b in batches:
            for own in arrow_portions(b, "markdown"):
                yield pa.RecordBatch.from_pylist([r for file in own for r in rows(*file)], schema=made)

    made = to_arrow_schema(schema.SECTIONS)
    extra = {"ids": "array<string>", "metadata": "map<string,string>"}
    own = files.select("relative_path", "markdown", *[(F.col(c) if c in files.columns else F.lit(None).cast(k)).alias(c) for c, k in extra.items()])
    return own.mapInArrow(parse_all, schema.SECTIONS)


def documents_of(files: DataFrame, sections: DataFrame) -> DataFrame:
    """The documents table; the title is the first level-1 title that isn't empty, else the name."""
    top = sections.groupBy("relative_path").agg(
        F.min_by("section_id", "pos").alias("root"), F.min("document_id").alias("document_id"),
        F.min_by(F.when((F.col("level") == 1) & (F.col("title") != ""), F.col("title")), F.when((F.col("level") == 1) & (F.col("title") != ""), F.col("pos"))).alias("h1"),
    )
    named = files.select("relative_path", document_name(F.col("relative_path")).alias("name"), sha256(F.col("markdown")).alias("content_hash"))
    return named.join(top, "relative_path").select(
        "document_id", "relative_path", "name", F.coalesce("h1", "name").alias("title"), "root", F.lit(False).alias("managed"), "content_hash"
    )


def check_path(path: str) -> str:
    """Only plain components, no backslash."""
    if not path or "\\" in path or path.startswith("/") or any(p in ("", ".", "..") for p in path.split("/")):
        raise InvalidInput(f"not a plain relative path: {path!r}")
    return path


def export(rendered: DataFrame, folder: str) -> None:
    """Writes (relative_path, markdown) rows, a folder for each path, as text; paths that leave the folder fail the job."""
    plain = F.when(is_markdown_path(F.col("relative_path")), F.col("relative_path")).otherwise(F.raise_error(F.concat(F.lit("not a plain relative path: "), F.col("relative_path"))))
    rendered.select(plain.alias("relative_path"), F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("relative_path").text(folder)


def html_to_markdown(html):
    """Heading elements of a page as # lines and other text as paragraphs; tags go."""
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    for level in range(1, 7):
        body = F.regexp_replace(body, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}\s*>", "\n\n" + "#" * level + " $1\n\n")
    body = F.regexp_replace(body, r"(?is)</?(p|div|li|ul|ol|br|tr|table|section|article|body|head|title)\b[^>]*>", "\n\n")
    body = F.regexp_replace(body, r"(?s)<[^>]*>", "")
    return F.regexp_replace(F.regexp_replace(body, r"[ \t]*\n[ \t]*", "\n"), r"\n{3,}", "\n\n")


#: Documents of a synthetic file, at most.
FILE_DOCS = 100


def synthetic_sections(docs: DataFrame) -> DataFrame:
    """Section trees from plain documents, without a parser: a file for each source, language and range of FILE_DOCS ids.

    The root (level 0), a level-1 section with the source as title, and under it ``Doc <id>`` with the text. Files stay
    small however many documents there are; null sources and languages are called none.
    """
    named = docs.withColumns({c: F.coalesce(c, F.lit("none")) for c in ("source", "lang")})
    path = F.concat("source", F.lit("/"), "lang", F.lit("-"), F.expr(f"cast(doc_id div {FILE_DOCS} as string)"), F.lit(".md"))
    files = named.withColumn("relative_path", path)
    base = files.select("relative_path", "source", "lang").distinct()
    doc = lambda: derived_id("document", F.col("relative_path"))
    sid = lambda *p: derived_id("section", F.col("relative_path"), *p)
    top = lambda own, up, title, level: F.struct(own.alias("section_id"), up.alias("parent_id"), title.alias("title"), F.lit(level).alias("level"))
    tops = base.select("relative_path", F.explode(F.array(
        top(sid(F.lit("0")), F.lit(None).cast("string"), F.col("lang"), 0), top(sid(F.lit("1")), sid(F.lit("0")), F.col("source"), 1),
    )).alias("s")).select("s.section_id", doc().alias("document_id"), "relative_path", "s.parent_id", "s.title", "s.level", F.lit("").alias("content"), F.lit(0).alias("ordinal"))
    place = F.row_number().over(Window.partitionBy("relative_path").orderBy("doc_id")) - 1
    h2 = files.select(
        sid(F.lit("2"), F.col("doc_id").cast("string")).alias("section_id"), doc().alias("document_id"), "relative_path", sid(F.lit("1")).alias("parent_id"),
        F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.lit(2).alias("level"), F.coalesce("text", F.lit("")).alias("content"), place.alias("ordinal"),
    )
    return tops.unionByName(h2)
