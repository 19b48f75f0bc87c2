"""Versions, snapshots, recent changes, concurrency checks and validation, as append-only tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Conflict, Locked, NotFound
from ..ids import derived_id
from ..storage import stored
from .diff import diff_texts
from .tree import render_documents


def section_versions(versions: DataFrame, section_id: str) -> DataFrame:
    """Oldest first."""
    return versions.where(F.col("section_id") == section_id).orderBy("seq")


def latest_versions(versions: DataFrame) -> DataFrame:
    """The newest version of each section: a partial aggregate, no window."""
    cols = [c for c in versions.columns if c not in ("section_id", "seq")]
    top = versions.groupBy("section_id").agg(F.max_by(F.struct("seq", *cols), "seq").alias("v"))
    return top.select("section_id", "v.*")


def get_version(versions: DataFrame, section_id: str, version_id: str) -> DataFrame:
    found = versions.where((F.col("section_id") == section_id) & (F.col("version_id") == version_id))
    if found.isEmpty():
        raise NotFound(f"version {version_id} of {section_id}")
    return found


def new_versions(changed: DataFrame, seq: int, author: str | None = None, summary: str | None = None) -> DataFrame:
    """Version rows of changed sections (section_id, title, content) at a commit number."""
    number = F.lit(seq).cast("long")
    return changed.select(
        derived_id("version", F.col("section_id"), number.cast("string")).alias("version_id"), "section_id", "title", "content",
        F.lit(author).cast("string").alias("author"), F.lit(summary).cast("string").alias("change_summary"), number.alias("seq"),
    )


def switch_version(versions: DataFrame, section_id: str, version_id: str, seq: int) -> DataFrame:
    """A new version with an older one's title and content; metadata stays as it is."""
    return new_versions(get_version(versions, section_id, version_id), seq, summary=f"restore {version_id}")


def diff_versions(versions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Hunk lines of (section_id, from_version, to_version) pairs, contents only."""
    side = lambda name, new: versions.select("section_id", F.col("version_id").alias(name), F.col("content").alias(new))
    both = pairs.join(side("from_version", "old"), ["section_id", "from_version"]).join(side("to_version", "new"), ["section_id", "to_version"])
    return diff_texts(both, ["section_id", "from_version", "to_version"])


def conflicts(current: DataFrame, expected: DataFrame) -> DataFrame:
    """(section_id, conflict): whether the current version is not the expected one; a missing section conflicts."""
    now = current.select("section_id", F.col("version_id").alias("_now"))
    return expected.join(now, "section_id", "left").select("section_id", (~F.col("expected_version").eqNullSafe(F.col("_now"))).alias("conflict"))


def require_versions(current: DataFrame, expected: DataFrame) -> None:
    bad = [r[0] for r in conflicts(current, expected).where("conflict").select("section_id").limit(5).collect()]
    if bad:
        raise Conflict("changed meanwhile: " + ", ".join(bad))


def require_unlocked(sections: DataFrame, ids: list[str]) -> None:
    bad = [r[0] for r in sections.where(F.col("section_id").isin(ids) & F.col("locked")).select("section_id").limit(5).collect()]
    if bad:
        raise Locked("locked: " + ", ".join(bad))


def set_lock(sections: DataFrame, section_id: str, locked: bool) -> DataFrame:
    return sections.withColumn("locked", F.when(F.col("section_id") == section_id, F.lit(locked)).otherwise(F.col("locked")))


def set_metadata(sections: DataFrame, section_id: str, **values) -> DataFrame:
    """Replaces anchor, tags, summary, locked of one section; the others stay."""
    for name, value in values.items():
        new = F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)
        sections = sections.withColumn(name, F.when(F.col("section_id") == section_id, new).otherwise(F.col(name)))
    return sections


def create_snapshot(sections: DataFrame, snapshot_id: str) -> DataFrame:
    """snapshot_sections rows: the captured tree."""
    return sections.withColumn("snapshot_id", F.lit(snapshot_id))


def list_snapshots(snapshots: DataFrame, document_id: str) -> DataFrame:
    return snapshots.where(F.col("document_id") == document_id).orderBy("created_at", "snapshot_id")


def restore_snapshot(snapshot_sections: DataFrame, snapshot_id: str) -> DataFrame:
    return snapshot_sections.where(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")


def diff_snapshots(snapshot_sections: DataFrame, old_id: str, new_id: str) -> DataFrame:
    """Both trees rendered, then diffed by lines, for each document."""
    side = lambda i, name: render_documents(restore_snapshot(snapshot_sections, i)).select("document_id", F.col("markdown").alias(name))
    return diff_texts(side(old_id, "old").join(side(new_id, "new"), "document_id", "full_outer"), ["document_id"])


#: Where a section stands in its text: follows from the texts before it, so it is not part of a stored row.
SPANS = ("heading_start", "content_start", "content_end")


def _row_hash(sections: DataFrame):
    return F.sha2(F.to_json(F.struct(*sorted(c for c in sections.columns if c not in SPANS))), 256)


@dataclass(frozen=True)
class SnapshotStore:
    """Snapshots as commits: snapshots (snapshot_id, document_id, label, root_version, created_at, seq), members (snapshot_id, document_id, section_id, version_id, row_hash), and rows (row_hash and a section's columns), each different row once."""

    snapshots: DataFrame
    members: DataFrame
    rows: DataFrame

    @classmethod
    def empty(cls, sections: DataFrame) -> SnapshotStore:
        none = sections.sparkSession.createDataFrame
        return cls(
            none([], "snapshot_id string, document_id string, label string, root_version string, created_at timestamp, seq long"),
            none([], "snapshot_id string, document_id string, section_id string, version_id string, row_hash string"),
            sections.drop(*SPANS).limit(0).withColumn("row_hash", F.lit("")),
        )

    def create(self, sections: DataFrame, versions: DataFrame, name: str, seq: int, label: str | None = None) -> SnapshotStore:
        """A snapshot of each document among the sections: its id is derived from the name and the document. Rows that an earlier snapshot has are not stored again."""
        own = sections.withColumn("row_hash", _row_hash(sections)).drop(*SPANS).withColumn("snapshot_id", derived_id("snapshot", F.lit(name), F.col("document_id")))
        now = latest_versions(versions).select("section_id", "version_id")
        named = own.join(now, "section_id", "left")
        members = stored(named.select("snapshot_id", "document_id", "section_id", "version_id", "row_hash"), "members")
        roots = named.where(F.col("parent_id").isNull()).select("snapshot_id", "document_id", F.lit(label).cast("string").alias("label"), F.col("version_id").alias("root_version"), F.current_timestamp().alias("created_at"), F.lit(seq).cast("long").alias("seq"))
        new = own.drop("snapshot_id").dropDuplicates(["row_hash"]).join(self.rows.select("row_hash"), "row_hash", "left_anti")
        return SnapshotStore(self.snapshots.unionByName(stored(roots, "snapshots")), self.members.unionByName(members), self.rows.unionByName(stored(new, "rows")))

    def sections(self, snapshots: DataFrame) -> DataFrame:
        """The sections of snapshots (snapshot_id), with that column."""
        return self.members.join(snapshots.select("snapshot_id").distinct(), "snapshot_id").select("snapshot_id", "row_hash").join(self.rows, "row_hash").drop("row_hash")

    def restore(self, sections: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(the sections with those of the snapshots in place of their documents', the sections among them that change): one snapshot a document.

        Their places in the text are null until the text is parsed again.
        """
        back = self.sections(snapshots).drop("snapshot_id").withColumns({c: F.lit(None).cast("long") for c in SPANS if c in sections.columns}).select(*sections.columns)
        rest = sections.join(back.select("document_id").distinct(), "document_id", "left_anti")
        hashed = lambda df: df.select("section_id", _row_hash(sections).alias("row_hash"))
        differ = hashed(back).join(hashed(sections), ["section_id", "row_hash"], "left_anti").select("section_id")
        return rest.unionByName(back), back.join(differ, "section_id", "left_semi")

    def get(self, snapshot_id: str) -> DataFrame:
        found = self.snapshots.where(F.col("snapshot_id") == snapshot_id)
        if found.isEmpty():
            raise NotFound(f"snapshot {snapshot_id}")
        return found


def recent_changes(versions: DataFrame, snapshots: DataFrame, limit: int | None = None) -> DataFrame:
    """Section versions and snapshots of all documents, newest first; ties by id."""
    both = versions.select(F.lit("SectionUpdated").alias("kind"), F.col("version_id").alias("id"), F.col("section_id").alias("subject"), "seq").unionByName(
        snapshots.select(F.lit("SnapshotCreated").alias("kind"), F.col("snapshot_id").alias("id"), F.col("document_id").alias("subject"), "seq")
    )
    out = both.orderBy(F.desc("seq"), "id")
    return out if limit is None else out.limit(limit)


def validate(documents: DataFrame, current: DataFrame, section_records: DataFrame, versions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Diagnostics: a file that differs from the catalog, a current version or a snapshot's root version without a row."""
    note = lambda df, severity, subject, what: df.select("document_id", F.lit(severity).alias("severity"), F.col(subject).alias("subject"), F.lit(what).alias("message"))
    files = documents.join(current.select("document_id", F.col("content_hash").alias("_known")), "document_id").where(F.col("content_hash") != F.col("_known"))
    known = versions.select("version_id")
    lost = section_records.join(known, F.col("current_version") == F.col("version_id"), "left_anti")
    roots = snapshots.where("root_version is not null").join(known, F.col("root_version") == F.col("version_id"), "left_anti")
    return (
        note(files, "Warning", "document_id", "the file differs from the catalog")
        .unionByName(note(lost, "Error", "section_id", "the current version is missing"))
        .unionByName(note(roots, "Warning", "snapshot_id", "the root version is missing"))
    )


def delete_document(document_id: str, tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """Tables (with a document_id column) without the document, and the rows dropped from each."""
    gone = F.col("document_id") == document_id
    return {k: t.where(~gone) for k, t in tables.items()}, {k: t.where(gone).count() for k, t in tables.items()}


def normalize_document(documents: DataFrame) -> DataFrame:
    """Declared but never changes anything, as is repair_document."""
    return documents.select("document_id", F.lit(False).alias("changed"))


repair_document = normalize_document
