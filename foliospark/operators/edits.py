"""Edits of documents' Markdown: contents and structure.

An edit is a row (document_id, seq, op, args as JSON). ``apply_edits`` joins each document's edits, as one list, to its text and
applies them in turn where the row is: a batch of edits over many documents is one join, and no group is held. The functions below work on one document's text; after a structural edit the tree is that of the rendered text.

Sections keep their ids over every edit: a text carries them (``Marked``), structural edits move ids with their sections, and
after a content edit that adds or swallows headings the trees are aligned by level and title. New sections get new ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FolioError, InvalidInput, Locked
from ..sources.markdown import Marked, Section, find, headings, ordered, parse, render, subtree
from ..sources.workspace import arrow_portions


def new_id(path: str, text: str, ids, n: int) -> str:
    """An id that no section of the document has had in this state: derived, since tasks may run again."""
    return "sec-" + hashlib.sha256("\x1f".join([path, text, *ids, str(n)]).encode("utf-8", "surrogatepass")).hexdigest()[:22]


def carried(path: str, before: list[Section], text: str) -> Marked:
    """A new text with the ids of the sections that were there before."""
    after = parse(path, str(text))
    ids = [s.id for s in before]
    if len(after) != len(before):
        shape = lambda x: [(s.level, s.title) for s in x]
        kept: list[str | None] = [None] * len(after)
        for a, b, n in SequenceMatcher(None, shape(before), shape(after), autojunk=False).get_matching_blocks():
            kept[b : b + n] = ids[a : a + n]
        kept[0] = ids[0]
        ids = [k or new_id(path, text, ids, n) for n, k in enumerate(kept)]
    return Marked(text, ids)


def _line_ends(old: str, new: str) -> str:
    return re.sub(r"(?<!\r)\n", "\r\n", new) if "\r\n" in old else new


def _splice(path: str, text: str, s: Section, body: str) -> str:
    """The text with a section's body replaced: one blank line around a body, none for an empty one."""
    start, end = (0, headings(text)[0].start if headings(text) else len(text)) if s.span is None else s.span[1:]
    body = body.strip("\r\n")
    before, after = text[:start], text[end:]
    middle = ("\n" if s.span else "") + body + "\n" + ("\n" if after else "") if body else ("\n" if s.span and after else "")
    if before and not before.endswith("\n"):
        before += "\n"
    return carried(path, parse(path, text), _line_ends(text, before + middle + after))


def update_section(path: str, text: str, section: str, content: str) -> str:
    return _splice(path, text, find(parse(path, text), section), content)


def append_to_section(path: str, text: str, section: str, content: str) -> str:
    s = find(parse(path, text), section)
    old = s.content.rstrip()
    return _splice(path, text, s, old + ("\n\n" if old else "") + content.lstrip())


def prepend_to_section(path: str, text: str, section: str, content: str) -> str:
    s = find(parse(path, text), section)
    new = content.rstrip()
    return _splice(path, text, s, new + ("\n\n" if s.content.lstrip() and new else "") + s.content.lstrip())


def rename_section(path: str, text: str, section: str, title: str) -> str:
    """Replaces the heading's text and keeps its anchor; setext headings keep their underline."""
    s = find(parse(path, text), section)
    if s.span is None:
        raise InvalidInput("the root has no heading")
    if not title.strip() or "\n" in title:
        raise InvalidInput("a title is one line of text")
    head = text[s.span[0] : s.span[1]]
    end = head[len(head.rstrip("\r\n")) :]
    anchor = f" {{#{s.anchor}}}" if s.anchor else ""
    lines = head.rstrip("\r\n").splitlines()
    if re.match(r" {0,3}#{1,6}(?:[ \t]|$)", lines[-1]) and len(lines) == 1:
        new = "#" * s.level + " " + title.strip() + anchor
    else:
        new = title.strip() + anchor + ("\r\n" if "\r\n" in head else "\n") + lines[-1]
    return carried(path, parse(path, text), text[: s.span[0]] + new + end + text[s.span[1] :])


def set_anchor(path: str, text: str, section: str, anchor: str | None) -> str:
    """Sets or drops the {#anchor} of a heading."""
    s = find(parse(path, text), section)
    if s.span is None:
        raise InvalidInput("the root has no heading")
    if anchor is not None and not re.fullmatch(r"[^\s{}]+", anchor):
        raise InvalidInput(f"not an anchor: {anchor!r}")
    head = text[s.span[0] : s.span[1]]
    lines = head.splitlines(keepends=True)
    at = 0 if len(lines) == 1 or re.match(r" {0,3}#{1,6}(?:[ \t]|$)", lines[0]) else len(lines) - 2  # before a setext underline
    line = lines[at].rstrip("\r\n")
    end = lines[at][len(line) :]
    lines[at] = re.sub(r"[ \t]*\{#[^{}]*\}[ \t]*$", "", line) + (f" {{#{anchor}}}" if anchor else "") + end
    return carried(path, parse(path, text), text[: s.span[0]] + "".join(lines) + text[s.span[1] :])


def replace_range(path: str, text: str, section: str, start: int, end: int, content: str) -> str:
    """Byte offsets into the section's content; both must lie between characters."""
    s = find(parse(path, text), section)
    raw = s.content.encode()
    if not 0 <= start <= end <= len(raw) or any(i < len(raw) and raw[i] & 0xC0 == 0x80 for i in (start, end)):
        raise InvalidInput("the range is not within the content or cuts a character")
    return _splice(path, text, s, (raw[:start] + content.encode() + raw[end:]).decode())


_PATCHES = {
    "replacecontent": lambda p, t, s, a: update_section(p, t, s, a["content"]),
    "appendcontent": lambda p, t, s, a: append_to_section(p, t, s, a["content"]),
    "append": lambda p, t, s, a: append_to_section(p, t, s, a["content"]),
    "prependcontent": lambda p, t, s, a: prepend_to_section(p, t, s, a["content"]),
    "prepend": lambda p, t, s, a: prepend_to_section(p, t, s, a["content"]),
    "replacerange": lambda p, t, s, a: replace_range(p, t, s, int(a["start"]), int(a["end"]), a["content"]),
    "rename": lambda p, t, s, a: rename_section(p, t, s, a.get("title") or a.get("new_title")),
    "setmetadata": lambda p, t, s, a: set_anchor(p, t, s, a["metadata"]["anchor"]) if "anchor" in a["metadata"] else t,
}


def patch_op(patch: dict) -> tuple[str, dict]:
    """From {"Variant": {...}} or {"type": ...}; names ignore case, _ and -."""
    if "type" in patch:
        name, args = patch["type"], {k: v for k, v in patch.items() if k != "type"}
    elif len(patch) == 1:
        name, args = next(iter(patch.items()))
    else:
        raise InvalidInput(f"not a patch: {patch}")
    name = re.sub("[_-]", "", name).lower()
    if name not in _PATCHES:
        raise InvalidInput(f"unknown patch {name}")
    return name, args


def metadata_of(op: str, args: dict) -> dict:
    """The metadata (tags, summary, locked and others) that an edit sets, by section; anchors stand in the text."""
    out: dict[str, dict] = {}
    patches = args.get("patches", []) if op == "patch_section" else [{"setmetadata": args}] if op == "set_section_metadata" else []
    for name, own in map(patch_op, patches):
        if name == "setmetadata":
            out.setdefault(args["section"], {}).update({k: v for k, v in own["metadata"].items() if k != "anchor"})
    return out


def set_section_metadata(path: str, text: str, section: str, metadata: dict) -> str:
    find(parse(path, text), section)
    return set_anchor(path, text, section, metadata["anchor"]) if "anchor" in metadata else text


def patch_section(path: str, text: str, section: str, patches: list[dict]) -> str:
    find(parse(path, text), section)
    for p in patches:
        name, args = patch_op(p)
        text = _PATCHES[name](path, text, section, args)
    return text


class Tree:
    """A document's tree under structural edits."""

    def __init__(self, path: str, text: str):
        self.path, self.text, self.sections = path, text, parse(path, text)
        self.by = {s.id: s for s in self.sections}
        self.root = self.sections[0]

    def get(self, sec: str) -> Section:
        return find(self.sections, sec)

    def markdown(self) -> str:
        now = ordered(list(self.by.values()))
        return carried(self.path, now, _line_ends(self.text, render(now)))

    def place(self, parent: Section, position) -> int:
        """first, last, an index, or {"before": id} / {"after": id}; an unknown sibling means last."""
        n = len(parent.children)
        if position in (None, "last"):
            return n
        if position == "first":
            return 0
        if isinstance(position, int):
            return max(0, min(position, n))
        if not isinstance(position, dict) or len(position) != 1 or next(iter(position)) not in ("before", "after"):
            raise InvalidInput(f"not a position: {position!r}")
        (side, sibling), = position.items()
        if sibling not in parent.children:
            return n
        return parent.children.index(sibling) + (side == "after")

    def add(self, parent: Section, title: str, content: str, at: int, level: int | None = None) -> Section:
        level = min(parent.level + 1, 6) if level is None else level
        s = Section(new_id(self.path, self.text, [x.id for x in self.sections], len(self.by)), parent.id, title, level, content)
        self.by[s.id] = s
        self.sections.append(s)
        parent.children.insert(at, s.id)
        return s

    def parent_of(self, s: Section) -> Section:
        if s.parent is None:
            raise InvalidInput("the root can't be moved or have siblings")
        return self.by[s.parent]

    def shift(self, s: Section, level: int) -> None:
        """A new level for a section; its descendants follow, to 6 at most."""
        s.level = level
        for c in s.children:
            self.shift(self.by[c], min(level + 1, 6))

    def detach(self, s: Section) -> None:
        self.parent_of(s).children.remove(s.id)

    def attach(self, s: Section, parent: Section, at: int) -> None:
        s.parent = parent.id
        parent.children.insert(at, s.id)


def create_section(path, text, title, content="", parent=None, position=None) -> str:
    t = Tree(path, text)
    up = t.root if parent is None else t.get(parent)
    t.add(up, title, content, t.place(up, position))
    return t.markdown()


def insert_section(path, text, sibling, title, content="", after=False) -> str:
    t = Tree(path, text)
    s = t.get(sibling)
    up = t.parent_of(s)
    t.add(up, title, content, up.children.index(s.id) + after, s.level)
    return t.markdown()


def remove_section(path, text, section, remove_children=False) -> str:
    """With its descendants, or with its children taking its place at their own levels."""
    t = Tree(path, text)
    s = t.get(section)
    up = t.parent_of(s)
    at = up.children.index(s.id)
    t.detach(s)
    if not remove_children:
        for k, c in enumerate(s.children):
            t.attach(t.by[c], up, at + k)
    for gone in subtree(list(t.by.values()), s.id) if remove_children else [s.id]:
        del t.by[gone]
    return t.markdown()


def reorder_sections(path, text, order, parent=None) -> str:
    t = Tree(path, text)
    up = t.root if parent is None else t.get(parent)
    if sorted(order) != sorted(up.children):
        raise InvalidInput("the order must hold each child once")
    up.children = list(order)
    return t.markdown()


def move_section(path, text, section, parent=None, position=None) -> str:
    t = Tree(path, text)
    s = t.get(section)
    up = t.root if parent is None else t.get(parent)
    t.parent_of(s)
    if up.id in subtree(t.sections, s.id):
        raise InvalidInput("a section can't go under itself")
    t.detach(s)
    t.attach(s, up, t.place(up, position))
    t.shift(s, min(up.level + 1, 6))
    return t.markdown()


def promote_section(path, text, section) -> str:
    """Becomes the sibling right after its parent."""
    t = Tree(path, text)
    s = t.get(section)
    up = t.parent_of(s)
    if s.level <= 1 or up.parent is None:
        raise InvalidInput("the section is at the top")
    grand = t.by[up.parent]
    t.detach(s)
    t.attach(s, grand, grand.children.index(up.id) + 1)
    t.shift(s, s.level - 1)
    return t.markdown()


def demote_section(path, text, section) -> str:
    """Becomes the last child of the sibling before it."""
    t = Tree(path, text)
    s = t.get(section)
    up = t.parent_of(s)
    at = up.children.index(s.id)
    if s.level >= 6 or not at:
        raise InvalidInput("there is no sibling before it, or no level below")
    above = t.by[up.children[at - 1]]
    t.detach(s)
    t.attach(s, above, len(above.children))
    t.shift(s, s.level + 1)
    return t.markdown()


def split_section(path, text, section, split_at: int, title: str) -> str:
    """At a byte offset of the content; the rest becomes a sibling of the same level, children stay."""
    t = Tree(path, text)
    s = t.get(section)
    raw = s.content.encode()
    if not 0 <= split_at <= len(raw) or (split_at < len(raw) and raw[split_at] & 0xC0 == 0x80):
        raise InvalidInput("the offset is not within the content or cuts a character")
    up = t.parent_of(s)
    s.content = raw[:split_at].decode().rstrip()
    t.add(up, title, raw[split_at:].decode().lstrip(), up.children.index(s.id) + 1, s.level)
    return t.markdown()


#: How far a split looks for a heading, and for white space, in bytes; and what is white space there.
HEADING_REACH, WORD_REACH, _BLANK = 200, 50, b" \t\n\x0c\r"


def split_point(raw: bytes, at: int) -> int:
    """Where a text parts near a byte offset: at the next line that begins with #, else the last one before, else behind white space near a word."""
    n = len(raw)
    if at in (0, n):
        return at
    opens = lambda i: (i == 0 or raw[i - 1] == 10) and i + 1 < n and raw[i] == 35
    for reach in (range(at, min(at + HEADING_REACH, n)), range(at - 1, max(at - HEADING_REACH, 0) - 1, -1)):
        found = next((i for i in reach if opens(i)), None)
        if found is not None:
            return found
    if raw[at] in _BLANK or raw[at - 1] in _BLANK:
        return at
    for reach in (range(at, min(at + WORD_REACH, n)), range(at - 1, max(at - WORD_REACH, 0) - 1, -1)):
        found = next((i for i in reach if raw[i] in _BLANK), None)
        if found is not None:
            return n - len(raw[found:].lstrip(_BLANK))
    return at


def split_points(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, point) of (keys, text, at) rows: where each text would be split near a byte offset; null if that is no place between characters."""
    def run(frames):
        for f in frames:
            out = []
            for text, at in zip(f["text"], f["at"], strict=True):
                raw = (text or "").encode()
                out.append(split_point(raw, int(at)) if 0 <= at <= len(raw) and not (at < len(raw) and raw[int(at)] & 0xC0 == 0x80) else None)
            yield f[keys].assign(point=pd.array(out, dtype="Int64"))

    kinds = dict(rows.dtypes)
    return rows.select(*keys, "text", "at").mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", point long")


def split_near(path, text, section, split_at: int, title: str) -> str:
    """The older split: as split_section, at a heading or between words near the offset."""
    raw = find(parse(path, text), section).content.encode()
    if not 0 <= split_at <= len(raw) or (split_at < len(raw) and raw[split_at] & 0xC0 == 0x80):
        raise InvalidInput("the offset is not within the content or cuts a character")
    return split_section(path, text, section, split_point(raw, split_at), title)


OPERATIONS: dict[str, Callable[..., str]] = {
    f.__name__: f
    for f in (
        update_section, append_to_section, prepend_to_section, rename_section, replace_range, patch_section, create_section, insert_section,
        remove_section, reorder_sections, move_section, promote_section, demote_section, split_section, split_near, set_section_metadata,
    )
}


#: The columns of edited documents, as Arrow has them.
EDITED = {"relative_path": pa.string(), "markdown": pa.string(), "ids": pa.list_(pa.string()), "metadata": pa.map_(pa.string(), pa.string()), "error": pa.string()}


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(relative_path, markdown, ids, metadata, error) after the edits (relative_path, seq, op, args).

    Edits of a document are all made or, at the first error, none. Files may
    have ``ids`` (of their sections, in order; else ids are derived from place), ``metadata`` (section id to JSON) and
    ``locked`` (ids that no edit may name).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own in arrow_portions(b, "markdown"):
                made = zip(*(edited(*row) for row in own), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(made, EDITED.values(), strict=True)], list(EDITED))

    def edited(path, before, ids, known, locked, todo) -> tuple:
        if todo is None:
            return path, before, ids, known, None
        known = dict(known or {})
        start = Marked(before, ids if ids is not None else [s.id for s in parse(path, before)])
        text, error, meta = start, None, dict(known)
        try:
            for _, op, raw in (e.values() for e in todo):
                args = json.loads(raw)
                if op not in OPERATIONS:
                    raise InvalidInput(f"unknown operation {op}")
                for name in ("section", "sibling"):
                    if locked is not None and args.get(name) in set(locked):
                        raise Locked(f"locked: {args[name]}")
                text = OPERATIONS[op](path, text, **args)
                if not isinstance(text, Marked):
                    text = carried(path, parse(path, start), text)
                for sec, new in metadata_of(op, args).items():
                    meta[sec] = json.dumps(json.loads(meta.get(sec, "{}")) | new, sort_keys=True)
        except (FolioError, TypeError, ValueError, KeyError, AttributeError, IndexError) as e:
            text, error, meta = start, f"{getattr(e, 'code', 'InvalidInput')}: {e}", known
        return path, str(text), list(text.ids), list(meta.items()), error

    kinds = {"ids": "array<string>", "metadata": "map<string,string>", "locked": "array<string>"}
    own = files.select("relative_path", "markdown", *[(F.col(c) if c in files.columns else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()])
    todo = edits.groupBy(F.col("relative_path").alias("_path")).agg(F.sort_array(F.collect_list(F.struct("seq", "op", "args"))).alias("todo"))  # one document's edits
    both = own.join(todo, F.col("relative_path") == F.col("_path"), "left").drop("_path")
    both = both.select("relative_path", "markdown", "ids", "metadata", "locked", "todo")
    return both.mapInArrow(run, "relative_path string, markdown string, ids array<string>, metadata map<string,string>, error string")


def changed_sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sections of the new tree that are new or differ in place, parent, level, title, content or metadata."""
    fields = ["ordinal", "parent_id", "level", "title", "content", *[c for c in ("anchor", "tags", "summary", "locked") if c in old.columns and c in new.columns]]
    before = old.select("section_id", F.struct(*fields).alias("_old"))
    both = new.join(before, "section_id", "left")
    return both.where(F.col("_old").isNull() | ~F.struct(*fields).eqNullSafe(F.col("_old"))).drop("_old")


def check_versions(edits: DataFrame, current: DataFrame, key: str = "relative_path") -> tuple[DataFrame, DataFrame]:
    """The edits of documents whose expectations hold, and the conflicts (key, section_id, expected_version, version_id).

    Edits with an ``expected_version`` need it to be the current version (section_id, version_id) of the section in their args;
    one that isn't stops all edits of its document, as an error does.
    """
    asked = edits.where("expected_version is not null").select(key, F.get_json_object("args", "$.section").alias("section_id"), "expected_version")
    found = asked.join(current.select("section_id", "version_id"), "section_id", "left")
    stale = found.where(~F.col("expected_version").eqNullSafe(F.col("version_id"))).select(key, "section_id", "expected_version", "version_id")
    return edits.join(stale.select(key).distinct(), key, "left_anti"), stale
