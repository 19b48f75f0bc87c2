"""Table functions for SQL: ``register(spark)``, then for example

    SELECT f.relative_path, s.title FROM files f, LATERAL markdown_sections(f.relative_path, f.markdown) s
    SELECT key AS lang, term, count(*) FROM table_tokens(TABLE(SELECT lang, text FROM documents)) WHERE word GROUP BY ALL
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from ..operators.diff import hunks, lines_of
from ..operators.index import _RUN, parts_of
from ..sources.markdown import rows_of
from ..sources.workspace import arrow_portions

_SECTION = ("section_id", "parent_id", "title", "level", "content", "ordinal", "pos", "anchor", "ancestry", "heading_start", "content_start", "content_end")


@udtf(returnType="section_id string, parent_id string, title string, level int, content string, ordinal int, pos int, anchor string, ancestry array<string>, heading_start long, content_start long, content_end long", useArrow=True)
class MarkdownSections:
    """The sections of a text, the synthetic root first; a null text has only the root."""

    def eval(self, relative_path: str, markdown: str):
        for r in rows_of(relative_path or "", markdown or ""):
            yield tuple(r[c] for c in _SECTION)


_TOKENS = pa.schema([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("run", pa.int32()), ("word", pa.bool_())])


@cache
def _chars() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point, whether words have it, and whether it is a lower-case or an upper-case letter; once a worker."""
    every = "".join(map(chr, range(0xD800))) + "\x00" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))  # surrogates are no characters

    def having(pattern):
        out = np.zeros(len(every) + 2, bool)  # with room behind a text's end
        for m in pattern.finditer(every):
            out[m.start() : m.end()] = True
        return out

    return having(_RUN), having(regex.compile(r"\p{Lowercase}+")), having(regex.compile(r"\p{Uppercase}+"))


def text_tokens(text: str) -> pa.RecordBatch:
    """What ``TextTokens`` gives for a text: places are found in arrays, and only words with capitals inside are looked at again."""
    in_word, lower, upper = _chars()
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    edges = np.flatnonzero(np.diff(in_word[codes].view(np.int8), prepend=0, append=0))
    first, last = edges[::2], edges[1::2]
    words = [text[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    terms, runs, starts, ends = [w.lower() for w in words], np.arange(len(words), dtype=np.int32), first, last
    low, up = lower[codes], upper[codes]
    humps = np.flatnonzero(low[:-1] & up[1:] | np.append(up[:-2] & up[1:-1] & low[2:], np.zeros(min(len(codes) - 1, 1), bool))) if len(codes) > 1 else first[:0]
    inside = np.unique(np.searchsorted(first, humps, "right") - 1)
    parts = [(part, k, first[k] + a, first[k] + b) for k in inside[inside >= 0].tolist() for part, a, b in parts_of(words[k])]
    word = np.ones(len(words), bool)
    if parts:
        more, of, begin, end = zip(*parts, strict=True)
        runs = np.append(runs, np.array(of, np.int32))
        order = np.argsort(runs, kind="stable")  # parts follow their word
        terms += more
        terms = [terms[i] for i in order.tolist()]
        runs, starts, ends, word = runs[order], np.append(starts, begin)[order], np.append(ends, end)[order], np.append(word, np.zeros(len(parts), bool))[order]
    if not text.isascii():
        places = np.append(0, np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)))
        starts, ends = places[starts], places[ends]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip((terms, starts, ends, runs, word), _TOKENS.types, strict=True)], schema=_TOKENS)


@udtf(returnType="term string, start long, end long, run int, word boolean", useArrow=True)
class TextTokens:
    """The tokens of a text with their byte spans and their word's number; parts of camelCase words follow it. None for null."""

    def eval(self, text: str):
        yield from zip(*text_tokens(text or "").to_pydict().values(), strict=True)


@arrow_udtf(returnType="key string, term string, start long, end long, run int, word boolean")
class TableTokens:
    """The tokens of a table's texts as ``TextTokens`` has them: of rows (key, text), by position; whole batches, where a lateral function takes a row at a time."""

    def eval(self, rows: pa.RecordBatch):
        named = pa.RecordBatch.from_arrays([rows.column(0).cast(pa.string()), rows.column(1)], ["key", "text"])
        for own in arrow_portions(named, "text"):
            found = [(key, text_tokens(text)) for key, text in own if text]
            keys = [pa.repeat(pa.scalar(key, pa.string()), tokens.num_rows) for key, tokens in found]
            if found:
                tokens = pa.concat_batches([tokens for _, tokens in found])
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(keys), *tokens.columns], ["key", *_TOKENS.names])


@udtf(returnType="hunk int, old_start long, old_lines long, new_start long, new_lines long, kind string, text string", useArrow=True)
class TextDiff:
    """The lines of the hunks that turn one text into another; null is the empty text."""

    def eval(self, old: str, new: str):
        for n, h in enumerate(hunks(lines_of(old), lines_of(new))):
            for kind, text in h["lines"]:
                yield n, h["old_start"], h["old_lines"], h["new_start"], h["new_lines"], kind, text


FUNCTIONS = {"markdown_sections": MarkdownSections, "text_tokens": TextTokens, "table_tokens": TableTokens, "text_diff": TextDiff}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
