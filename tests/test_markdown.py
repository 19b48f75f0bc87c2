import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.errors import InvalidInput
from foliospark.operators import edits
from foliospark.sources.markdown import Marked, parse, render, rows_of, section_id

DOC = "# Dough\n\n## Grist\n\nGrist.\n\n## Water\n\nWater.\n\n## Yeast\n\nYeast.\n"


def shape(text):
    return [(s.level, s.title, s.content) for s in parse("a.md", text)]


@pytest.mark.parametrize("text, levels, titles", [
    ("# Boats\n\nAll of them.\n\n## Sail\n\nWind.\n\n### Mast\n\nWood.\n\n## Oar\n\nArms.\n", [0, 1, 2, 3, 2], ["a", "Boats", "Sail", "Mast", "Oar"]),
    ("# Shop\n\n~~~sh\n# a comment\n~~~\n", [0, 1], ["a", "Shop"]),
    ("# Closed #\n\nx\n\n## Also closed ####\n\ny\n\n## Not closed#\n", [0, 1, 2, 2], ["a", "Closed", "Also closed", "Not closed#"]),
    ("Harbour\n===\n\nQuay.\n\nTwo lines\nof title\n---\n\nz\n", [0, 1, 2], ["a", "Harbour", "Two lines of title"]),
    ("# 港の朝\n\n船。\n\n## Čerstvý chléb\n\nžluťoučký\n\n## 🐟 Fish\n\n🦀\n", [0, 1, 2, 2], ["a", "港の朝", "Čerstvý chléb", "🐟 Fish"]),
    ("# a \\* b \\# c\n\n## R&amp;D &copy; &#65;&#x42; &nosuch;\n", [0, 1, 2], ["a", "a * b # c", "R&D © AB &nosuch;"]),
    ("<div>\n# inside\n</div>\n\n# outside\n", [0, 1], ["a", "outside"]),
    ("<p>word</p>\n# still in the block\n\n# out\n", [0, 1], ["a", "out"]),
    ("text <b>\n# heading\n", [0, 1], ["a", "heading"]),
    ("<span>\n# inside a block of one tag\n\n# out\n", [0, 1], ["a", "out"]),
    ("- item\n===\n\n# after\n", [0, 1], ["a", "after"]),
    ("- # in a list\n\n> ## in a quote\n", [0, 1, 2], ["a", "in a list", "in a quote"]),
    ("para\n    # not code but no heading\n", [0], ["a"]),
    ("# `code *x*` and *soft* __hard__ snake_case_name\n", [0, 1], ["a", "code *x* and soft hard snake_case_name"]),
    ("# [text](<http://x y> \"t\") ![alt *a*](u) <https://e.org>\n", [0, 1], ["a", "text alt a https://e.org"]),
    ("    # code\n\n<!--\n# hidden\n-->\n\n# Shown {#id}\n", [0, 1], ["a", "Shown"]),
    ("", [0], ["a"]),
])
def test_headings(text, levels, titles):
    got = parse("a.md", text)
    assert [s.level for s in got] == levels and [s.title for s in got] == titles


def test_tree_and_spans():
    got = parse("a.md", "# Mill\n\nBy the weir.\n\n### Stones\n\nFrench burr.\n")
    assert got[2].parent == got[1].id and got[2].level == 3 and got[2].content == "French burr."
    rows = rows_of("x/ü.md", "# Ä\n\nö\n\n## B\n\nb\n")
    assert rows[2]["ancestry"] == ["Ä", "B"] and rows[2]["heading_start"] == len("# Ä\n\nö\n\n".encode())
    assert [r["content"] for r in rows_of("a.md", "# Mill\n\n## Sluice\n\n## Wheel\n\nOak.\n")] == ["", "", "", "Oak."]


def sid(n):
    return section_id("a.md", n)


@pytest.mark.parametrize("op, args, expected", [
    ("update_section", {"section": sid(2), "content": "New."}, DOC.replace("Grist.", "New.")),
    ("update_section", {"section": sid(4), "content": "New."}, DOC.replace("Yeast.\n", "New.\n")),
    ("append_to_section", {"section": sid(2), "content": "More."}, DOC.replace("Grist.", "Grist.\n\nMore.")),
    ("rename_section", {"section": sid(2), "title": "Renamed"}, DOC.replace("## Grist", "## Renamed")),
    ("create_section", {"title": "New", "content": "Body."}, DOC + "\n# New\n\nBody.\n"),
    ("create_section", {"title": "New", "content": "Body.", "parent": sid(1)}, DOC + "\n## New\n\nBody.\n"),
    ("remove_section", {"section": sid(3), "remove_children": True}, DOC.replace("## Water\n\nWater.\n\n", "")),
    ("reorder_sections", {"parent": sid(1), "order": [sid(4), sid(2), sid(3)]}, "# Dough\n\n## Yeast\n\nYeast.\n\n## Grist\n\nGrist.\n\n## Water\n\nWater.\n"),
    ("insert_section", {"sibling": sid(3), "title": "New", "content": "x"}, DOC.replace("## Water", "## New\n\nx\n\n## Water")),
    ("insert_section", {"sibling": sid(3), "title": "New", "content": "x", "after": True}, DOC.replace("## Yeast", "## New\n\nx\n\n## Yeast")),
    ("demote_section", {"section": sid(3)}, DOC.replace("## Water", "### Water")),
    ("promote_section", {"section": sid(4)}, DOC.replace("## Yeast", "# Yeast")),
    ("move_section", {"section": sid(4), "parent": sid(2)}, "# Dough\n\n## Grist\n\nGrist.\n\n### Yeast\n\nYeast.\n\n## Water\n\nWater.\n"),
    ("split_section", {"section": sid(2), "split_at": 2, "title": "Part"}, DOC.replace("Grist.\n", "Gr\n\n## Part\n\nist.\n")),
    ("patch_section", {"section": sid(2), "patches": [{"Rename": {"title": "A"}}, {"type": "append", "content": "b"}, {"replace_range": {"start": 0, "end": 5, "content": "Last"}}]},
     DOC.replace("## Grist\n\nGrist.", "## A\n\nLast.\n\nb")),
])
def test_edits(op, args, expected):
    assert edits.OPERATIONS[op]("a.md", DOC, **args) == expected


def test_edit_errors():
    with pytest.raises(InvalidInput):
        edits.move_section("a.md", DOC, sid(1), parent=sid(2))
    with pytest.raises(InvalidInput):
        edits.split_section("a.md", "# A\n\né\n", sid(1), 1, "x")
    with pytest.raises(InvalidInput):
        edits.promote_section("a.md", DOC, sid(1))
    with pytest.raises(InvalidInput):
        edits.reorder_sections("a.md", DOC, [sid(2)], parent=sid(1))
    with pytest.raises(InvalidInput):
        edits.update_section("a.md", DOC, "sec-none", "x")


def test_line_ends_and_anchors_stay():
    text = "# Doc {#top}\r\n\r\n## A {#a}\r\n\r\nbody\r\n"
    got = edits.update_section("a.md", text, sid(2), "one\ntwo")
    assert got == "# Doc {#top}\r\n\r\n## A {#a}\r\n\r\none\r\ntwo\r\n"
    assert "{#a}" in edits.rename_section("a.md", text, sid(2), "B") and "{#top}" in edits.create_section("a.md", text, "N")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["# A", "## B", "### C", "text", "", "```", "x\n---", "> q", "- i", "    c"]), max_size=14))
def test_render_is_stable(lines):
    once = render(parse("a.md", "\n".join(lines)))
    tree = [(s.level, s.title) for s in parse("a.md", once)]
    again = render(parse("a.md", once))
    assert [(s.level, s.title) for s in parse("a.md", again)] == tree and again == once


def test_apply_edits_is_all_or_nothing(spark):
    import json

    files = spark.createDataFrame([("a.md", DOC), ("b.md", "# B\n")], "relative_path string, markdown string")
    todo = spark.createDataFrame(
        [("a.md", 0, "rename_section", json.dumps({"section": sid(2), "title": "X"})), ("a.md", 1, "update_section", json.dumps({"section": "none", "content": ""}))],
        "relative_path string, seq int, op string, args string",
    )
    got = {r.relative_path: r for r in edits.apply_edits(files, todo).collect()}
    assert got["a.md"].markdown == DOC and "no section" in got["a.md"].error and got["b.md"].error is None
    ok = {r.relative_path: r for r in edits.apply_edits(files, todo.where("seq = 0")).collect()}
    assert "## X" in ok["a.md"].markdown


def test_ids_stay_with_their_sections():
    start = Marked(DOC, [f"s{k}" for k in range(5)])
    names = lambda text: {s.title: s.id for s in parse("a.md", text)}
    for op, args in (
        ("insert_section", {"sibling": "s2", "title": "New"}), ("create_section", {"title": "New", "content": "## With\n\nits own", "position": "first"}), ("move_section", {"section": "s4", "parent": "s2"}),
        ("promote_section", {"section": "s3"}), ("demote_section", {"section": "s3"}), ("split_section", {"section": "s3", "split_at": 2, "title": "Rest"}), ("reorder_sections", {"parent": "s1", "order": ["s4", "s2", "s3"]}),
        ("remove_section", {"section": "s1"}), ("update_section", {"section": "s2", "content": "x\n\n## Extra\n\ny"}), ("update_section", {"section": "s2", "content": "plain"}), ("set_section_metadata", {"section": "s2", "metadata": {"anchor": "a"}}),
    ):
        got = names(edits.OPERATIONS[op]("a.md", start, **args))
        assert {k: v for k, v in got.items() if k in names(start)} == {k: v for k, v in names(start).items() if k in got}, op
        assert len(set(got.values())) == len(got) and all(v not in names(start).values() for k, v in got.items() if k not in names(start)), op
    renamed = names(edits.rename_section("a.md", start, "s2", "Other"))
    assert renamed["Other"] == "s2" and renamed["Yeast"] == "s4"
    assert "## Grist {#a}" in edits.set_anchor("a.md", start, "s2", "a") and "{#" not in edits.set_anchor("a.md", edits.set_anchor("a.md", start, "s2", "a"), "s2", None)


def test_bad_arguments_leave_the_other_documents_alone(spark):
    files = spark.createDataFrame([(f"{k}.md", "# A\n") for k in range(4)], "relative_path string, markdown string")
    todo = spark.createDataFrame([("0.md", 0, "create_section", "{"), ("1.md", 0, "create_section", '{"title": "x", "position": "middle"}'), ("2.md", 0, "patch_section", '{"section": 3}')], "relative_path string, seq int, op string, args string")
    got = {r.relative_path: r for r in edits.apply_edits(files, todo).collect()}
    assert all(got[f"{k}.md"].error.startswith("InvalidInput") and got[f"{k}.md"].markdown == "# A\n" for k in range(3)) and got["3.md"].error is None
