"""Markdown text to section trees and back.

Headings are found as CommonMark has them: ATX and setext, also in list items and block quotes, outside code blocks (fenced
or indented) and HTML blocks; ``{#id}`` at a heading's end is its anchor. Titles are the text that inline parsing leaves:
escapes and entities resolved, code and link texts kept, emphasis marks and tags dropped. Reference links are not resolved.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import lru_cache
from html.entities import html5

from ..errors import InvalidInput

_ATX = re.compile(r"(#{1,6})(?:[ \t]+(.*?))?[ \t]*$")
_CLOSE = re.compile(r"(?:^|[ \t]+)#+$")
_ANCHOR = re.compile(r"[ \t]*\{#([^\s{}]+)[^{}]*\}[ \t]*$")
_SETEXT = re.compile(r"(=+|-+)[ \t]*$")
_FENCE = re.compile(r"(`{3,}|~{3,})(.*)$")
_RULE = re.compile(r"(?:(?:-[ \t]*){3,}|(?:_[ \t]*){3,}|(?:\*[ \t]*){3,})$")
_ITEM = re.compile(r"([-+*]|(\d{1,9})[.)])(?=[ \t]|$)")
#: How the HTML blocks of CommonMark begin, and what ends those that a blank line doesn't.
_HTML_UNTIL = (
    (re.compile(r"<(?:script|pre|style|textarea)(?=[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
)
_HTML_TAGS = (
    "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|"
    "footer|form|frame|frameset|h1|h2|h3|h4|h5|h6|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|"
    "param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
)
_HTML_BLOCK = re.compile(rf"</?(?:{_HTML_TAGS})(?=[\s>]|/>|$)", re.I)
_ATTRIBUTE = r"(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)"
_TAG = rf"(?:<[A-Za-z][A-Za-z0-9-]*{_ATTRIBUTE}*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)"
_HTML_ALONE = re.compile(_TAG + r"[ \t]*$")
_INLINE_HTML = re.compile(_TAG + r"|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9.-]+)>")
_ENTITY = re.compile(r"&(?:#(\d{1,7})|#[xX]([0-9A-Fa-f]{1,6})|([A-Za-z][A-Za-z0-9]*));")
_TARGET = re.compile(r"\(\s*(?:<[^<>\n]*>|[^\s()<]*(?:\([^\s()]*\)[^\s()]*)*)?(?:\s+(?:\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\)))?\s*\)")
_PUNCTUATION = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


@dataclass
class Heading:
    level: int
    title: str
    anchor: str | None
    start: int  # of the heading, in characters
    body: int  # after its line


@dataclass
class Section:
    """A node of a document's tree."""

    id: str
    parent: str | None
    title: str
    level: int
    content: str
    anchor: str | None = None
    tags: list[str] = field(default_factory=list)
    children: list[str] = field(default_factory=list)
    ordinal: int = 0
    span: tuple[int, int, int] | None = None  # heading start, content start and end, in characters


def _entity(m: re.Match) -> str:
    if m[3]:
        return html5.get(m[3] + ";", m[0])
    code = int(m[1]) if m[1] else int(m[2], 16)
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def _bracket_end(raw: str, at: int) -> int:
    """Where the bracket that opens at ``at`` closes, or -1."""
    depth, i = 0, at
    while i < len(raw):
        c = raw[i]
        if c == "\\":
            i += 1
        elif c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
            if not depth:
                return i
        i += 1
    return -1


def _runs(raw: str) -> list:
    """Text pieces, and runs of emphasis marks as [mark, count, can open, can close]."""
    out: list = []
    i = 0
    while i < len(raw):
        c, m = raw[i], None
        if c == "\\" and i + 1 < len(raw) and (raw[i + 1] in _PUNCTUATION or raw[i + 1] == "\n"):
            out.append(raw[i + 1])
            i += 2
        elif c == "`":
            n = len(raw[i:]) - len(raw[i:].lstrip("`"))
            m = re.search(rf"(?<!`)`{{{n}}}(?!`)", raw[i + n :])
            if m:
                code = raw[i + n : i + n + m.start()].replace("\n", " ")
                out.append(code[1:-1] if code.strip() and code[0] == code[-1] == " " else code)
            else:
                out.append("`" * n)
            i += n + (m.end() if m else 0)
        elif c == "<" and (m := _AUTOLINK.match(raw, i)):
            out.append(m[1])
            i = m.end()
        elif c == "<" and (m := _INLINE_HTML.match(raw, i)):
            i = m.end()
        elif c == "&" and (m := _ENTITY.match(raw, i)):
            out.append(_entity(m))
            i = m.end()
        elif c in "[!" and raw.startswith("[", i + (c == "!")) and (end := _bracket_end(raw, i + (c == "!"))) > 0 and (m := _TARGET.match(raw, end + 1)):
            out.append(_inline(raw[i + (c == "!") + 1 : end]))
            i = m.end()
        elif c in "*_":
            n = len(raw[i:]) - len(raw[i:].lstrip(c))
            before, after = raw[i - 1 : i] or " ", raw[i + n : i + n + 1] or " "
            space = lambda x: x.isspace()
            mark = lambda x: not x.isalnum() and not x.isspace()
            left = not space(after) and (not mark(after) or space(before) or mark(before))
            right = not space(before) and (not mark(before) or space(after) or mark(after))
            opens, closes = (left, right) if c == "*" else (left and (not right or mark(before)), right and (not left or mark(after)))
            out.append([c, n, opens, closes])
            i += n
        else:
            out.append(c)
            i += 1
    return out


def _inline(raw: str) -> str:
    """The text of inline Markdown: matched emphasis marks go, others stay."""
    pieces = _runs(raw)
    marks = [p for p in pieces if isinstance(p, list)]
    whole = [p[1] for p in marks]
    for k, closer in enumerate(marks):
        while closer[3] and closer[1]:
            opener = None
            for j in range(k - 1, -1, -1):
                o = marks[j]
                thirds = (o[3] or closer[2]) and (whole[j] + whole[k]) % 3 == 0 and (whole[j] % 3 or whole[k] % 3)
                if o[0] == closer[0] and o[2] and o[1] and not thirds:
                    opener = j
                    break
            if opener is None:
                break
            n = 2 if closer[1] > 1 and marks[opener][1] > 1 else 1
            marks[opener][1] -= n
            closer[1] -= n
            for between in marks[opener + 1 : k]:
                between[2] = False
    return "".join(p if isinstance(p, str) else p[0] * p[1] for p in pieces)


def plain_title(raw: str) -> str:
    """A heading's text, on one line."""
    return re.sub(r"[ \t]*\n[ \t]*", " ", _inline(raw)).strip()


def _indent(line: str, at: int, column: int = 0) -> tuple[int, int]:
    """Columns and characters of the white space at a place; a tab goes to the next multiple of four."""
    width, i = column, at
    while i < len(line) and line[i] in " \t":
        width += 4 - width % 4 if line[i] == "\t" else 1
        i += 1
    return width - column, i - at


def _items(line: str, at: int, paragraph: bool) -> tuple[list[int], int]:
    """The block quotes (0) and list items (columns of their content) that begin at a place, and where they end."""
    opened: list[int] = []
    while True:
        width, n = _indent(line, at)
        if width > 3:
            return opened, at
        if line.startswith(">", at + n):
            at += n + 1
            at += line[at : at + 1] in (" ", "\t")
            opened.append(0)
        elif (m := _ITEM.match(line, at + n)) and not _RULE.match(line, at + n):
            rest = line[m.end() :].strip()
            if paragraph and not opened and (not rest or m[2] and int(m[2]) != 1):
                return opened, at
            gap, chars = _indent(line, m.end())
            own = m.end() - at - n
            gap, chars = (gap, chars) if rest and gap < 5 else (1, min(chars, 1))
            opened.append(width + own + gap)
            at = m.end() + chars
        else:
            return opened, at


@lru_cache(maxsize=8)
def headings(text: str) -> list[Heading]:
    out: list[Heading] = []
    holders: list[int] = []  # open block quotes (0) and list items (columns)
    at, fence, html, paragraph = 0, None, None, None  # paragraph: start of the open one
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        bare = line.rstrip("\r\n")
        start, at = at, at + len(line)
        pos, same = 0, 0
        for h in holders:
            width, n = _indent(bare, pos)
            if h == 0 and width < 4 and bare.startswith(">", pos + n):
                pos += n + 1
                pos += bare[pos : pos + 1] in (" ", "\t")
            elif h and not bare[pos:].strip():
                pos = len(bare)
            elif h and width >= h:
                taken = 0
                while taken < h:
                    taken += 4 - taken % 4 if bare[pos] == "\t" else 1
                    pos += 1
            else:
                break
            same += 1
        if same < len(holders):
            if fence or html:
                fence = html = None
                holders = holders[:same]
        rest = bare[pos:]
        if fence:
            m = _FENCE.match(rest.lstrip(" "))
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = None
            continue
        if html:
            if not rest.strip() if html == "blank" else html.search(rest):
                html = None
            continue
        if not rest.strip():
            paragraph = None
            holders = [h for k, h in enumerate(holders) if k < same]
            continue
        opened, pos = _items(bare, pos, paragraph is not None and same == len(holders))
        width, n = _indent(bare, pos)
        rest = bare[pos + n :]
        if width < 4:
            first = start + pos + n if holders[:same] or opened else start
            if m := _ATX.match(rest):
                raw = _CLOSE.sub("", m[2] or "")
                anchor = _ANCHOR.search(raw)
                out.append(Heading(len(m[1]), plain_title(_ANCHOR.sub("", raw)), anchor and anchor[1], first, at))
                holders, paragraph = holders[:same] + opened, None
                continue
            if (m := _FENCE.match(rest)) and not (m[1][0] == "`" and "`" in m[2]):
                holders, paragraph, fence = holders[:same] + opened, None, m[1]
                continue
            ends = next((end for begin, end in _HTML_UNTIL if begin.match(rest)), None)
            if ends is None and (_HTML_BLOCK.match(rest) or (paragraph is None or opened) and _HTML_ALONE.match(rest)):
                ends = "blank"
            if ends is not None:
                holders, paragraph = holders[:same] + opened, None
                html = None if ends != "blank" and ends.search(rest[2:]) else ends
                continue
            if paragraph is not None and not opened and same == len(holders) and (m := _SETEXT.match(rest)):
                raw = "\n".join(re.sub(r"^(?:[ \t]*>)*[ \t]*", "", x) if k and holders else x.strip() for k, x in enumerate(text[paragraph:start].splitlines()))
                anchor = _ANCHOR.search(raw)
                out.append(Heading(1 if m[1][0] == "=" else 2, plain_title(_ANCHOR.sub("", raw)), anchor and anchor[1], paragraph, at))
                paragraph = None
                continue
            if _RULE.match(rest):
                holders, paragraph = holders[:same] + opened, None
                continue
        if paragraph is not None and not opened:
            continue  # the paragraph goes on, also where its containers' marks are left out
        holders = holders[:same] + opened
        paragraph = None if width > 3 or not rest else start + pos + n if holders else start
    return out


def section_id(path: str, pos: int) -> str:
    return "sec-" + hashlib.sha256(f"{path}\x1f{pos}".encode()).hexdigest()[:22]


def document_id(path: str) -> str:
    return "doc-" + hashlib.sha256(path.encode()).hexdigest()[:22]


def name_of(path: str) -> str:
    stem = re.sub(r"\.[^./]*$", "", path.rsplit("/", 1)[-1])
    return stem or "document"


class Marked(str):
    """A document's text with the ids of its sections, in document order; the root's is first."""

    ids: tuple[str, ...]

    def __new__(cls, text: str, ids):
        own = super().__new__(cls, text)
        own.ids = tuple(ids)
        return own


def parse(path: str, text: str) -> list[Section]:
    """The sections in document order; the first is the synthetic root, which holds the preamble.

    Ids are those of a Marked text, else derived from path and place.
    """
    found = headings(text)
    ids = text.ids if isinstance(text, Marked) and len(text.ids) == len(found) + 1 else [section_id(path, k) for k in range(len(found) + 1)]
    first = found[0].start if found else len(text)
    out = [Section(ids[0], None, name_of(path), 0, text[:first].rstrip("\r\n"))]
    stack = [out[0]]
    for i, h in enumerate(found):
        end = found[i + 1].start if i + 1 < len(found) else len(text)
        while stack[-1].level >= h.level:
            stack.pop()
        s = Section(ids[i + 1], stack[-1].id, h.title, h.level, text[h.body : end].strip("\r\n"), h.anchor, ordinal=len(stack[-1].children), span=(h.start, h.body, end))
        stack[-1].children.append(s.id)
        out.append(s)
        stack.append(s)
    return out


def title_of(sections: list[Section]) -> str:
    return next((s.title for s in sections if s.level == 1 and s.title), sections[0].title)


def ordered(sections: list[Section]) -> list[Section]:
    """Depth first from the root; what the root doesn't reach is left out."""
    by = {s.id: s for s in sections}
    out, stack = [], [next(s for s in sections if s.parent is None)]
    while stack:
        s = stack.pop()
        out.append(s)
        stack += [by[c] for c in reversed(s.children)]
    return out


def render(sections: list[Section], top: str | None = None) -> str:
    """Canonical Markdown: blocks parted by a blank line, anchors kept, contents right-trimmed."""
    blocks = []
    for s in ordered(sections):
        if s.parent is not None:
            blocks.append("#" * s.level + " " + s.title + (f" {{#{s.anchor}}}" if s.anchor else ""))
        if body := s.content.rstrip():
            blocks.append(body)
    return "\n\n".join(blocks) + "\n" if blocks else ""


def subtree(sections: list[Section], top: str) -> list[str]:
    by = {s.id: s for s in sections}
    out, stack = [], [top]
    while stack:
        out.append(s := stack.pop())
        stack += reversed(by[s].children)
    return out


def find(sections: list[Section], sec: str) -> Section:
    for s in sections:
        if s.id == sec:
            return s
    raise InvalidInput(f"no section {sec}")


def rows_of(path: str, text: str, ids=None, known: dict | None = None) -> list[dict]:
    """Rows of the sections table, with the ids and metadata (id to tags, summary, locked) known for the text."""
    sections = parse(path, text if ids is None else Marked(text, ids))
    known = known or {}
    by = {s.id: s for s in sections}
    at = {i: i for s in sections if s.span for i in s.span}
    if not text.isascii():
        done = n = 0
        for i in sorted(at):
            n += len(text[done:i].encode("utf-8", "surrogatepass"))
            done, at[i] = i, n
    doc = document_id(path)
    out = []
    for pos, s in enumerate(sections):
        up, chain = s, []
        while up is not None:
            chain.append(up)
            up = by.get(up.parent)
        chain.reverse()
        span = [None] * 3 if s.span is None else [at[i] for i in s.span]
        out.append({
            "section_id": s.id, "document_id": doc, "relative_path": path, "parent_id": s.parent, "title": s.title, "level": s.level,
            "content": s.content, "ordinal": s.ordinal, "pos": pos, "path": [c.id for c in chain], "ancestry": [c.title for c in chain[1:]],
            "sort_key": "/".join(f"{c.ordinal:010d}" for c in chain[1:]), "anchor": s.anchor, "tags": known.get(s.id, {}).get("tags") or [],
            "summary": known.get(s.id, {}).get("summary"), "locked": bool(known.get(s.id, {}).get("locked")),
            "heading_start": span[0], "content_start": span[1], "content_end": span[2],
        })
    return out
