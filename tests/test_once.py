"""Costly steps are done once: what a row needs is not computed again at each use, nor a document parsed or rendered again."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillspan.functions import markdown
from quillspan.functions.jstext import resolve_path_col
from quillspan.operators import checks, drift, nodes
from quillspan.plans import more, queries

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_front_matter_is_read_once_a_row(spark):
    texts = ["---\nname: a\ndescription: >-\n  one\n  two\nx: 1\n---\nbody", '---\nname: b\ndescription: "' + "w " * 150 + '"\n---\n', "no front matter", None, "---\nname: c\n---\n"]
    docs = spark.createDataFrame([(f"/c/{n}/S.md", t) for n, t in zip("abcde", texts)], "path string, text string")
    staged = drift.staged(docs)
    assert _plan(staged).count("regexp_extract(text") <= 2  # one for the field, one for what replaces it
    rows = {r["path"][3]: r for r in staged.collect()}
    assert [rows[n]["ok"] for n in "abcde"] == [True, True, False, False, False]
    assert (rows["a"]["before"], rows["a"]["text"]) == (7, '---\nname: a\ndescription: "one two"\nx: 1\n---\nbody')
    assert (rows["b"]["before"], rows["b"]["after"]) == (300, 198) and (rows["c"]["text"], rows["d"]["text"]) == (texts[2], None)
    gate = drift.contract_gate(docs)
    assert _plan(gate.groupBy(F.coalesce("detail", F.lit("ok"))).count()).count("regexp_extract(text") == 1
    assert {r["subject"][3]: r["detail"] for r in gate.collect()} == {"a": None, "b": None, "c": "name differs from folder", "d": "name differs from folder", "e": "name differs from folder"}


def test_corpus_is_rendered_once(spark):
    """The findings' plan reads what was written down; nothing in it renders documents again."""
    plan = _plan(queries._findings(spark, SF))
    assert "l_orderkey" not in plan and "o_custkey" not in plan
    assert "aggregate(split(" not in plan  # paths are resolved before, not again by each reader of the targets


def test_headings_are_looked_at_once(spark):
    """The three checks of headings come from one pass; a heading may break several rules."""
    docs = spark.createDataFrame([("d", "# A\n\n### B\n\n# A\n\n# A\n\n#### B\n"), ("e", "# A\n\n## B\n")], "doc_id string, text string")
    found = checks.heading_findings(checks.parsed_for(docs, "headings"))
    assert _plan(found).count("MapInArrow") == 1
    rows = sorted((r["doc_id"], r["line"], r["_rank"], r["check"]) for r in found.collect())
    assert rows == [("d", 3, 0, "heading-skip"), ("d", 5, 1, "heading-multiple-h1"), ("d", 5, 2, "heading-duplicate"), ("d", 7, 1, "heading-multiple-h1"), ("d", 7, 2, "heading-duplicate"), ("d", 9, 0, "heading-skip")]


def test_texts_without_address_stay_in_the_parser():
    """Fewer rows leave the parser; those that do are the same, numbers and places included."""
    text = "﻿# A\n\n| a | b |\n|---|---|\n| x | http://x.y/z |\n\nplain\nwww.a.b *c*\n- [ ] task\n\n[r]: /u\n\n![i](u) [r] é\n"
    whole, less = markdown.Sheet(), markdown.Sheet(None, checks.ADDRESS_MARKS, ("node_id",))
    whole.add(text)
    less.add(text)
    names = ("node_id", "parent_id", "depth_in_tree", "child_ix", "child_count", "type", "ancestor_types", "start_line", "start_col", "value", "url", "alt", "identifier", "text_content")
    rows = lambda sheet: list(zip(*map(sheet.column, names), strict=True))
    kept = [r for r in rows(whole) if r[5] != "text" or any(m in r[9] for m in checks.ADDRESS_MARKS)]
    assert rows(less) == kept and len(kept) < len(rows(whole))
    assert {r[9] for r in kept if r[5] == "text"} == {"http://x.y/z", "plain\nwww.a.b "}


def test_plain_lines_are_taken_as_all_others(monkeypatch):
    """The short way for usual lines gives the nodes of the long one, also among lists, code, tables and HTML."""
    parts = ["# a", "## b ##", "#x", "text", "| a | b |", "|---|---|", "| x |", "- i", "> q", "```", "    code", "<div>", "[x]: /u", "===", "1. n", "", "", "*e* [x]", " z", "9"]
    texts = ["\n".join(parts[(i * k + i * i // 3) % len(parts)] for i in range(k % 11 + 2)) for k in range(1, 400)]
    short = [markdown.flatten(t) for t in texts]
    monkeypatch.setattr(markdown.Blocks, "plain", lambda *_: False)
    assert short == [markdown.flatten(t) for t in texts]


def _node_rows(text: str, marks: tuple | None, types: frozenset | None = None, outside: tuple = ()) -> list[tuple]:
    sheet = markdown.Sheet(types, marks, outside=outside)
    sheet.add(text)
    return list(zip(*map(sheet.column, markdown.FIELDS), strict=True))


LINKISH_PARTS = ["see ", "[a](b)", "[a]( b )", "[a](<b>)", "[](x)", "![](x.png)", "![i](http://x.y/i.png)", "[t][r]", "[t][ ]", "![t][R s]", "[t][]", "[r]", "<http://a.b/c>", "<x:y z>", "<i>", "!", "*", "**b**", "`c`", "\\", "\\[", " www.a.b ", "http://q", "(x)", ")", "]", "[", "_", "~~", "\U0001f600", "é", "[http://l](u(v))", "[a](b \"t\")", "[a](" + "u" * 2048 + ")", "[a](" + "u" * 2049 + ")", "\u00a0", "\n", "# ", "| ", " |", "|\n| --- | --- |\n| ", "|x||", "- ", "- [ ] ", "> ", "\n\n", "\n\n[r]: /u\n\n", "\t", "\r\n", "\ufeff"]


def test_quick_ways_give_the_nodes_of_the_long_ones(monkeypatch):
    """Links, references and rows that are read in one go, against the parser without these ways: all nodes but unmarked texts and cells."""
    draw = random.Random(7)
    texts = ["".join(draw.choices(LINKISH_PARTS, k=draw.randint(1, 9))) for _ in range(4000)]
    texts += ["| " + draw.choice(["a", "[a](b)", "\u00a0", ""]) + " | b |\n" + draw.choice(["|---|---|", "|:-|-:|", "|---|"]) + "\n" + "".join(draw.choices(["| 1 | 2 |", "|1|", "||", "| x | y | z |", "\n", "x", " ", "| www.a |", "\\|", "|\t|"], k=5)) for _ in range(1500)]
    rows = frozenset(("heading", "link", "image", "linkReference", "imageReference", "definition", "tableRow", "text", "html", "root", "paragraph"))
    quick = [(_node_rows(t, checks.ADDRESS_MARKS), _node_rows(t, checks.ADDRESS_MARKS, rows), _node_rows(t, checks.ADDRESS_MARKS, rows, checks.LINKISH)) for t in texts]
    used = []
    found = markdown.quick_parts
    monkeypatch.setattr(markdown, "quick_parts", lambda source, at: used.append(found(source, at)))  # gives None
    monkeypatch.setattr(markdown.Blocks, "short", lambda *_: None)
    kind, value, above = map(markdown.FIELDS.index, ("type", "value", "ancestor_types"))
    for text, (every, some, free) in zip(texts, quick, strict=True):
        whole = _node_rows(text, None)
        kept = [r for r in whole if r[kind] != "text" or any(m in r[value] for m in checks.ADDRESS_MARKS)]
        assert every == kept, text
        assert some == [r for r in kept if r[kind] in rows], text
        assert free == [r for r in some if r[kind] != "text" or not set(r[above]) & set(checks.LINKISH)], text
        markdown.tree_of(text, markdown.re.compile("://"))
    assert sum(p is not None for p in used) > 300 and sum(p is None for p in used) > 300


def test_usual_links_and_rows_take_the_quick_way(monkeypatch):
    """Findings queries parse millions of such lines: no inline parser and no cell is made for them."""
    text = "# Order 1\n\nStatus O for [customer](../c/1.md#c).\n\nSee [terms][t1].\n\n![item](https://x.y/1.png)\n\nSource <https://x.y/o> here.\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n"
    sheet = markdown.Sheet(frozenset(("link", "image", "linkReference", "tableRow", "text")), checks.ADDRESS_MARKS)
    monkeypatch.setattr(markdown, "Inlines", None)
    monkeypatch.setattr(markdown, "table_row", None)
    sheet.add(text)
    assert sheet.column("type") == ["link", "linkReference", "image", "link", "text", "tableRow", "tableRow"]


def test_units_are_counted_for_long_texts_only(spark):
    """The guards cost a pass over the bytes' number; what they refuse is the same."""
    sizes = {"a": "x" * 524288, "b": "x" * 524289, "c": "é" * 524288, "d": "é" * 524289, "e": "\U0001f600" * 262144, "f": "\U0001f600" * 262145, "g": "a\0", "h": None}
    status = nodes.with_status(spark.createDataFrame(list(sizes.items()), "doc_id string, text string"))
    assert "octet_length(text" in _plan(status.select("scan_status"))  # asked before the text is encoded to count its units
    got = {r["doc_id"]: r["scan_status"] for r in status.collect()}
    assert got == {"a": "scanned", "b": "too-large", "c": "scanned", "d": "too-large", "e": "scanned", "f": "too-large", "g": "unreadable", "h": "unscanned"}


def test_references_are_settled_in_one_pass(spark):
    """Uses and definitions meet in one shuffle; the last definition speaks, at the first one's place in the order."""
    docs = spark.createDataFrame([("d", "[a][b] [c][D] [q][r]\n\n[d]: /1\n\n[X]: /2\n\n[x]: /3\n\n![i][no]\n"), ("e", "[r]: /u\n")], "doc_id string, text string")
    found = checks.reference_findings(checks.parsed_for(docs, "references").persist())
    rows = sorted((r["doc_id"], r["line"], r["check"], r["message"].split("'")[1], r["_node"]) for r in found.collect())
    assert [r[:4] for r in rows] == [("d", 1, "ref-undefined", "[b]"), ("d", 1, "ref-undefined", "[r]"), ("d", 7, "def-orphan", "[x]"), ("d", 9, "ref-undefined", "[no]"), ("e", 1, "def-orphan", "[r]")]
    full = checks.parsed_for(docs, "references").where("type = 'definition' and label = 'X'").first()["node_id"]
    assert rows[2][4] == full
    assert "Join" not in _plan(found)


USUAL = ["# A", "## A ##", "## b c", "### ", "#x", "plain", "*e*", "see [a](b)", "[a](#a)", "[a](#a-1)", "[a](#A)", "[b](#b%20c) [b](#b-c)", "[x](../c/d.md#a) and [x](/abs) [y](e.md#zz)", "![](i.png)", "![ ](http://x/y)", "![alt](http://x/y)", "![alt](no.png)", "![alt](#a)", "see [t][r1] and [u][R1]", "![][r1]", "![i][r2]", "[r1]: /u", "[R1]: #a 't'", "[r2]: c.md", "[ ]: x", "[r1]", "[q][]", "go http://x.y/z.", "<http://a.b/c> www.q.r", "| a | b |\n| --- | --- |", "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 1 | 2 | 3 |\n| 1 |", "| a |\n|---|\n| 1 | 2 |\n| 1 |\n| x | y | z |", "| a | b |\n| --- |\n| 1 |", "| a |\n|---|\n| http://x.y | 2 |", "| a |\n|---|\ntext | 2 |", "two\nlines", "- i", "```\n# z\n\n[a](#q)\n```", "> q", "<div id=\"a\">", "é [a](#é)", "# é", "===", "", "\nx", " z", "a\r"]


def _usual_texts(n: int) -> list[str]:
    draw = random.Random(11)
    return ["\n\n".join(draw.choices(USUAL[: 33 if i % 4 else None], k=draw.randint(1, 9))) + draw.choice(["", "\n", "\n\n"]) for i in range(n)]


def test_texts_read_in_one_go_give_the_nodes_of_the_long_way(monkeypatch):
    """Fields and rows are the same, with no target left out."""
    wanted = frozenset(t for need in checks.NEEDS.values() for t in need[0])
    names, quick = markdown.QUICK_FIELDS, 0
    for text in _usual_texts(4000):
        short, full = (markdown.Sheet(wanted, checks.ADDRESS_MARKS, names, None, checks.LINKISH) for _ in range(2))
        full.quick = None
        short.add(text)
        full.add(text)
        rows = lambda sheet: list(zip(sheet.numbers(), *map(sheet.column, names), strict=True))
        assert rows(short) == rows(full), text
        quick += bool(short.quick_rows)
    assert quick > 800


def test_nodes_left_out_are_those_of_no_finding(spark):
    """Findings of all nodes and of those that are left are the same."""
    docs = spark.createDataFrame([(f"/c/{i}.md", f"/c/{'d' if i == 1 else i}.md", t) for i, t in enumerate(_usual_texts(1200))], "doc_id string, path string, text string").repartition(4).persist()
    manifest = docs.select("path").unionByName(spark.createDataFrame([("/c/c.md",), ("/c/b",)], "path string"))
    fields = tuple(dict.fromkeys((*checks.PLACE, *(f for need in checks.NEEDS.values() for f in need[1]))))
    types = tuple(dict.fromkeys(t for need in checks.NEEDS.values() for t in need[0]))
    whole = nodes.parse_nodes(docs, types=types, fields=fields, marks=checks.ADDRESS_MARKS, outside=checks.LINKISH).persist()
    less = checks.parsed_for(docs).persist()
    found = [sorted(map(tuple, checks.check_documents(docs, nodes=n, manifest=manifest).collect()), key=repr) for n in (whole, less)]
    assert found[0] == found[1] and len({r[1] for r in found[0]}) == 10
    assert less.count() < whole.count()


def test_orders_are_read_in_one_go(monkeypatch):
    """What the findings' queries parse millions of takes no tree, and of its nodes only those that a check may use get a row."""
    text = "# Order 1\n\n## Details\n\nStatus O for [customer](../c/1.md#c).\n\nJump to [details](#details).\n\nSee [terms][t1].\n\n![item](https://x.y/1.png)\n\nSource <https://x.y/o> here.\n\n[t1]: https://x.y/t\n\n(none)\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n"
    monkeypatch.setattr(markdown, "tree_of", None)
    sheet = markdown.Sheet(frozenset(t for need in checks.NEEDS.values() for t in need[0]), checks.ADDRESS_MARKS, markdown.QUICK_FIELDS, None, checks.LINKISH, checks.EXTERNAL)
    sheet.add(text)
    assert list(zip(sheet.column("type"), sheet.column("start_line"), sheet.column("url"))) == [("root", 1, None), ("heading", 1, None), ("heading", 3, None), ("link", 5, "../c/1.md#c")]
    assert sheet.column("heading_depth") == [None] * 4


def test_paths_without_dots_are_joined(spark):
    """The short way of resolving gives what looking at every part does, here as os.path does it."""
    import posixpath

    folders = ["/a", "/a/b", "", "/", "/a/../b", "/a//b", "/a/.b", "/a/b.c"]
    rels = ["x.md", "../x.md", "../../x", "./x", "a/b/c.md", "a//b", "../a/b", "../a/../b", "..", "../", "../.x", "a/", ".x", "...", "/r/s", "../../../../x", "..x/y", "a b/\u00e9", "a\n", "x/."]
    rows = [(f, r) for f in folders for r in rels]
    got = spark.createDataFrame(rows, "f string, r string").select("f", "r", resolve_path_col(F.col("f"), F.col("r")).alias("p")).collect()
    assert len(got) == len(rows)
    for f, r, p in got:
        assert p == posixpath.normpath("/" + (r if r.startswith("/") else f"{f}/{r}")).replace("//", "/"), (f, r)


def test_outcomes_need_no_messages(spark, monkeypatch):
    """The findings that outcomes are told of are written down with the columns that are asked for, without order or text."""
    written, kept = [], more.settled
    monkeypatch.setattr(more, "settled", lambda df, what: written.append((what, df.columns, _plan(df))) or kept(df, what))
    rows = {r["outcome"]: r["n"] for r in more.r10(spark, SF).collect()}
    assert set(rows) == {"fixed", "skipped", "none"}
    [(what, columns, plan)] = written
    assert (what, columns) == ("findings", ["doc_id", "check", "line"]) and "in prose" not in plan


def test_lines_are_read_without_attributes(monkeypatch):
    """Texts of usual parts make no parts of lines with attributes, of which most get no row; no row is made to be taken out again."""
    monkeypatch.setattr(markdown, "quick_parts", None)
    sheet = markdown.Sheet(frozenset(t for need in checks.NEEDS.values() for t in need[0]), checks.ADDRESS_MARKS, markdown.QUICK_FIELDS, None, checks.LINKISH, checks.EXTERNAL)
    sheet.add("# A\n\nsee [x][t1] ![](http://i/j) www.q <http://a.b/c>\n\n[t1]: https://x.y/t\n\n[b](#a) [c](#d)\n")
    rows = list(zip(*map(sheet.column, ("node_id", "type", "start_line", "start_col", "url", "alt", "text_content")), strict=True))
    assert rows == [(0, "root", 1, 1, None, None, None), (1, "heading", 1, 1, None, None, "A"), (8, "image", 3, 13, "http://i/j", "", ""), (9, "text", 3, 28, None, None, " www.q "), (17, "link", 7, 9, "#d", None, None)]


def test_targets_meet_paths_in_one_pass(spark, monkeypatch):
    """Nodes carry their document's path: targets meet the manifest and the linked documents once, and are written down with what is known of them."""
    written, kept = {}, checks.settled
    monkeypatch.setattr(checks, "settled", lambda df, what: written.update({what: df}) or kept(df, what))
    texts = {"/c/a.md": "# A\n\n[l](#a) [m](#no) [n](b.md#B) [o](b.md#x) [p](gone.md#y) [q](b.md) [r](d.md#z)\n", "/c/b.md": "# B\n", "/c/d.md": "\0"}
    docs = spark.createDataFrame([(i, *row) for i, row in enumerate(texts.items())], "doc_id int, path string, text string")
    found = checks.check_documents(docs, manifest=docs.select("path"))
    assert sorted((r["doc_id"], r["check"], r["column"]) for r in found.collect()) == [(0, "anchor-missing", 9), (0, "anchor-missing", 18), (0, "anchor-missing", 30), (0, "file-missing", 42), (2, "doc-unreadable", 1)]
    assert "path" in written["nodes"].columns and set(written) == {"nodes", "targets", "anchors"}
    assert _plan(written["targets"]).partition("== Initial Plan ==")[0].count("Join") == 2
    asked = {r["column"]: (r["kind"], r["exists"], r["target_id"]) for r in written["targets"].withColumnRenamed("start_col", "column").collect()}
    assert asked == {9: ("local", None, 0), 18: ("relative", True, 1), 30: ("relative", True, 1), 42: ("relative", None, None), 57: ("relative", True, None), 67: ("relative", True, None)}


def test_lines_are_scanned_from_mark_to_mark(monkeypatch):
    """A line's text is not searched character by character, and a link to a heading as it is written needs no anchors of all headings."""
    monkeypatch.setattr(markdown, "QUICK", None)
    monkeypatch.setattr(markdown, "own_anchors", None)
    sheet = markdown.Sheet(frozenset(t for need in checks.NEEDS.values() for t in need[0]), checks.ADDRESS_MARKS, markdown.QUICK_FIELDS, None, checks.LINKISH, checks.EXTERNAL)
    sheet.add("# A b\n\n## Details\n\nto [d](#details) or [e](f.md) (g).\n")
    assert list(zip(sheet.column("type"), sheet.column("start_col"))) == [("root", 1), ("heading", 1), ("heading", 1), ("link", 21)]
