"""Navigation of section trees: table of contents, subtrees, lookups, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NotFound


def list_documents(documents: DataFrame) -> DataFrame:
    return documents.orderBy("relative_path")


def get_document(documents: DataFrame, document_id: str) -> DataFrame:
    return _some(documents.where(F.col("document_id") == document_id), f"document {document_id}")


def get_document_by_name(documents: DataFrame, name: str) -> DataFrame:
    """By display name; the first path, if several documents have it."""
    return _some(documents.where(F.col("name") == name).orderBy("relative_path").limit(1), f"document {name}")


def _some(found: DataFrame, what: str) -> DataFrame:
    if found.isEmpty():
        raise NotFound(what)
    return found


def document_location(documents: DataFrame, current: DataFrame) -> DataFrame:
    """Folder, file name, managed flag, hash, and whether the file is as the catalog (document_id, content_hash) has it."""
    known = current.select("document_id", F.col("content_hash").alias("known_hash"))
    return documents.join(known, "document_id", "left").select(
        "document_id", "relative_path", F.regexp_extract("relative_path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("relative_path", r"([^/]*)$", 1).alias("filename"),
        F.col("known_hash").isNotNull().alias("managed"), "content_hash", F.coalesce(F.col("known_hash") == F.col("content_hash"), F.lit(False)).alias("source_matches_metadata"),
    )


def table_of_contents(sections: DataFrame, document_id: str | None = None) -> DataFrame:
    """Rows in reading order, without the synthetic roots; depth 1 is the top."""
    own = sections if document_id is None else sections.where(F.col("document_id") == document_id)
    return own.where("level > 0").select("document_id", "relative_path", "section_id", "parent_id", "title", "level", F.size("ancestry").alias("depth"), "sort_key").orderBy("document_id", "sort_key")


def get_section(sections: DataFrame, document_id: str, section_id: str) -> DataFrame:
    return _some(sections.where((F.col("document_id") == document_id) & (F.col("section_id") == section_id)), f"section {section_id}")


def get_sections(sections: DataFrame, document_id: str, ids: list[str]) -> DataFrame:
    """In the order asked for; fails if one is missing."""
    wanted = sections.sparkSession.createDataFrame(list(enumerate(ids)), "place int, section_id string")
    own = sections.where(F.col("document_id") == document_id)
    missing = [r[0] for r in wanted.join(own, "section_id", "left_anti").select("section_id").limit(5).collect()]
    if missing:
        raise NotFound("sections " + ", ".join(missing))
    return wanted.join(own, "section_id").orderBy("place").drop("place")


def children(sections: DataFrame, parents: DataFrame) -> DataFrame:
    """The direct children of many sections (section_id), with the parent's id in parent_id; ``ordinal`` is their order."""
    wanted = parents.select(F.col("section_id").alias("parent_id")).distinct()
    return sections.join(wanted, "parent_id", "left_semi")


def delete_sections(sections: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes) without the sections of ``gone`` (section_id) and all under them; the siblings behind close up. Roots stay."""
    ids = gone.select("section_id").distinct()
    named = sections.where("parent_id is not null").select(F.col("section_id").alias("own"), F.explode("path").alias("section_id"))
    lost = named.join(ids.join(sections.where("parent_id is not null").select("section_id"), "section_id"), "section_id").select(F.col("own").alias("section_id")).distinct()
    left = sections.join(lost, "section_id", "left_anti")
    turn = F.row_number().over(Window.partitionBy("document_id", "parent_id").orderBy("ordinal")) - 1  # one parent's children
    return left.withColumn("ordinal", turn.cast("int")), sections.join(lost, "section_id", "left_semi")


def section_tree(sections: DataFrame, section_id: str | DataFrame, depth: int | None = None) -> DataFrame:
    """A section and what is under it, to a depth (0: itself; None: all), from the path column: no recursion.

    With a frame of ids (section_id), the trees of all of them at once; ``top`` names each row's.
    """
    if isinstance(section_id, str):
        at = F.array_position("path", section_id)
        own = sections.where(at > 0).withColumns({"top": F.lit(section_id), "depth": (F.size("path") - at).cast("int")})
    else:
        places = sections.select("*", F.posexplode("path").alias("at", "top"))
        own = places.join(section_id.select(F.col("section_id").alias("top")).distinct(), "top").withColumn("depth", F.size("path") - 1 - F.col("at")).drop("at")
    return (own if depth is None else own.where(F.col("depth") <= depth)).orderBy("document_id", "sort_key")


def section_info(sections: DataFrame) -> DataFrame:
    """A summary of each section, with the number of its children."""
    children = sections.where("parent_id is not null").groupBy(F.col("parent_id").alias("section_id")).agg(F.count("*").alias("child_count"))
    return sections.join(children, "section_id", "left").select("document_id", "section_id", "title", "level", F.coalesce("child_count", F.lit(0)).cast("long").alias("child_count"))


def heading_line(anchors: bool = True):
    head = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("title"))
    return F.when(F.col("anchor").isNotNull() & F.lit(anchors), F.concat(head, F.lit(" {#"), F.col("anchor"), F.lit("}"))).otherwise(head)


def render_documents(sections: DataFrame, anchors: bool = True) -> DataFrame:
    """(document_id, relative_path, markdown): each document's canonical text, by an ordered aggregate."""
    body = F.regexp_replace("content", r"\s+$", "")
    blocks = F.array_compact(F.array(F.when(F.col("level") > 0, heading_line(anchors)), F.when(body != "", body)))
    own = sections.select("document_id", "relative_path", "sort_key", F.array_join(blocks, "\n\n").alias("block")).where("block != ''")
    all_blocks = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sort_key", "block"))), lambda x: x["block"]), "\n\n")
    return own.groupBy("document_id", "relative_path").agg(F.concat(all_blocks, F.lit("\n")).alias("markdown"))


def render_section(sections: DataFrame, section_id: str, include_children: bool = False) -> DataFrame:
    """Heading and content, with descendants if wanted; anchors are left out."""
    return render_documents(section_tree(sections, section_id, None if include_children else 0), anchors=False)
