"""Column functions on text: tokens, hashes, paths, line ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[a-zA-Z0-9\p{IsAlphabetic}\p{N}]+"
#: Where a token has parts.
HUMP = r"\p{IsLowercase}\p{IsUppercase}|\p{IsUppercase}\p{IsUppercase}\p{IsLowercase}"
#: Between a lower-case letter and an upper-case one, and before the last of several upper-case letters if a lower-case one follows.
CAMEL = r"(?<=\p{IsLowercase})(?=\p{IsUppercase})|(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase})"


def camel_parts(token: Column) -> Column:
    return F.split(token, CAMEL, -1)


def tokens(text: Column) -> Column:
    """Lower-case tokens; a camelCase token is followed by its parts that differ from it."""
    def expand(t):
        parts = F.transform(camel_parts(t), F.lower)
        return F.when(F.size(parts) > 1, F.concat(F.array(F.lower(t)), F.filter(parts, lambda p: p != F.lower(t)))).otherwise(F.array(F.lower(t)))

    return F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0), expand))


def token_rows(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """(*keep, term): a row for each of the ``tokens`` of a column; only tokens with capitals inside are looked at again."""
    raw = rows.select(*keep, F.explode(F.regexp_extract_all(F.col(text), F.lit(TOKEN), 0)).alias("token")).withColumn("low", F.lower("token"))
    split = (F.col("token") != F.col("low")) & F.col("token").rlike(HUMP)
    parts = F.filter(F.transform(camel_parts(F.col("token")), F.lower), lambda p: p != F.col("low"))
    return raw.select(*keep, F.explode(F.when(split, F.concat(F.array("low"), parts)).otherwise(F.array("low"))).alias("term"))


def sha256(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def path_prefix(prefix: str) -> str:
    return prefix.replace("\\", "/").rstrip("/")


def under(path: Column, prefix: str) -> Column:
    """Equal to the prefix or in the folder of that name; ``_`` and ``%`` are plain characters."""
    p = path_prefix(prefix)
    return (path == p) | path.startswith(p + "/")


def document_name(path: Column) -> Column:
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.when(stem == "", F.lit("document")).otherwise(stem)


def is_markdown_path(path: Column) -> Column:
    """A relative path of a Markdown file outside the reserved folders."""
    parts = F.split(path, "/", -1)
    reserved = F.exists(parts, lambda p: p.isin(".git", ".foliospark", "..", ".", ""))
    return F.lower(path).endswith(".md") & ~reserved & ~F.contains(path, F.lit("\\"))


def keep_line_ends(new: Column, old: Column) -> Column:
    """CRLF throughout if the old text has any, else as it is."""
    return F.when(F.contains(old, F.lit("\r\n")), F.regexp_replace(new, r"(?<!\r)\n", "\r\n")).otherwise(new)


def ltrim_all(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+", "")


def rtrim_all(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def appended(old: Column, new: Column) -> Column:
    """Existing text without trailing space, a blank line, and the new text without leading space."""
    base = rtrim_all(old)
    return F.concat(base, F.when(base == "", "").otherwise("\n\n"), ltrim_all(new))
