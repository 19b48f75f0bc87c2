"""Explicit schemas of the tables."""

from pyspark.sql import types as T

METADATA = T.StructType().add("anchor", "string").add("tags", T.ArrayType(T.StringType())).add("summary", "string").add("locked", "boolean")

FILES = T.StructType().add("relative_path", "string").add("markdown", "string")

DOCUMENTS = (
    T.StructType().add("document_id", "string").add("relative_path", "string").add("name", "string").add("title", "string")
    .add("root", "string").add("managed", "boolean").add("content_hash", "string")
)

#: A section's place in its tree: path holds the ids from the root to it, sort_key the ordinals, zero-padded.
SECTIONS = (
    T.StructType().add("section_id", "string").add("document_id", "string").add("relative_path", "string").add("parent_id", "string")
    .add("title", "string").add("level", "integer").add("content", "string").add("ordinal", "integer").add("pos", "integer")
    .add("path", T.ArrayType(T.StringType())).add("ancestry", T.ArrayType(T.StringType())).add("sort_key", "string")
    .add("anchor", "string").add("tags", T.ArrayType(T.StringType())).add("summary", "string").add("locked", "boolean")
    .add("heading_start", "long").add("content_start", "long").add("content_end", "long")
)

VERSIONS = (
    T.StructType().add("version_id", "string").add("section_id", "string").add("title", "string").add("content", "string")
    .add("metadata", METADATA).add("created_at", "timestamp").add("author", "string").add("change_summary", "string").add("seq", "long")
)

SNAPSHOTS = T.StructType().add("snapshot_id", "string").add("document_id", "string").add("root_version", "string").add("label", "string").add("created_at", "timestamp").add("change_summary", "string")

EMBEDDING_CACHE = T.StructType().add("section_id", "string").add("content_hash", "string").add("model", "string").add("vector", T.ArrayType(T.FloatType())).add("cached_at", "timestamp")

DIFF_LINES = (
    T.StructType().add("hunk", "integer").add("old_start", "long").add("old_lines", "long").add("new_start", "long").add("new_lines", "long")
    .add("kind", "string").add("text", "string")
)
