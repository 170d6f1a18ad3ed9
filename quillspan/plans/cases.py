"""Small Markdown texts with the nodes they must give, by inventory id, rendered once per customer; written from the syntax rules, not from the parser.

A case is a text and its nodes (type, line, column, detail) without the root; {k} stands for the customer's key. Detail is what
says most of a node: a heading's depth and text, a code block's language and value, a list's kind, start and spacing, an item's
box, a target, an identifier, else the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Case = tuple[str, tuple[tuple[str, int, int, str], ...]]

CASES: dict[str, tuple[Case, ...]] = {
    "p02_tabs": (
        ("-\tfoo {k}\n\n\tbar", (("list", 1, 1, "bullet loose"), ("listItem", 1, 1, "-"), ("paragraph", 1, 3, ""), ("text", 1, 3, "foo {k}"), ("paragraph", 3, 2, ""), ("text", 3, 2, "bar"))),
        ("\tcode {k}", (("code", 1, 2, "|code {k}"),)),
    ),
    "p03_containers": (
        ("> a{k}\n> b\n\n- c\n\n  d{k}", (("blockquote", 1, 1, ""), ("paragraph", 1, 3, ""), ("text", 1, 3, "a{k}\nb"), ("list", 4, 1, "bullet loose"), ("listItem", 4, 1, "-"), ("paragraph", 4, 3, ""), ("text", 4, 3, "c"), ("paragraph", 6, 3, ""), ("text", 6, 3, "d{k}"))),
    ),
    "p04_fences": (
        ("~~~js x\n  in {k}\n~~~\n\n```\nopen {k}", (("code", 1, 1, "js|  in {k}"), ("code", 5, 1, "|open {k}"))),
        ("  ```\n    a{k}\n  b\n ```", (("code", 1, 3, "|  a{k}\nb"),)),
        ("````\n```\n{k}\n````\nafter", (("code", 1, 1, "|```\n{k}"), ("paragraph", 5, 1, ""), ("text", 5, 1, "after"))),
    ),
    "p05_html_blocks": (
        (
            "<script>\nx{k}\n</script>\n\n<!-- {k}\n\n-->\n\n<?p {k}?>\n\n<!D {k}>\n\n<![CDATA[{k}]]>\n\n<div>\n{k}\n\n<x-y>\n{k}",
            (("html", 1, 1, "<script>\nx{k}\n</script>"), ("html", 5, 1, "<!-- {k}\n\n-->"), ("html", 9, 1, "<?p {k}?>"), ("html", 11, 1, "<!D {k}>"), ("html", 13, 1, "<![CDATA[{k}]]>"), ("html", 15, 1, "<div>\n{k}"), ("html", 18, 1, "<x-y>\n{k}")),
        ),
    ),
    "p06_indented_code": (("    a{k}\n\n      b\n\ntext\n    not code", (("code", 1, 5, "|a{k}\n\n  b"), ("paragraph", 5, 1, ""), ("text", 5, 1, "text\nnot code"))),),
    "p07_lazy_lines": (
        ("> a{k}\nlazy\n\n- b\nlazy too\n# h", (("blockquote", 1, 1, ""), ("paragraph", 1, 3, ""), ("text", 1, 3, "a{k}\nlazy"), ("list", 4, 1, "bullet tight"), ("listItem", 4, 1, "-"), ("paragraph", 4, 3, ""), ("text", 4, 3, "b\nlazy too"), ("heading", 6, 1, "1 h"), ("text", 6, 3, "h"))),
    ),
    "p08_quotes": (
        ("> > a{k}\n> b\n\n>c", (("blockquote", 1, 1, ""), ("blockquote", 1, 3, ""), ("paragraph", 1, 5, ""), ("text", 1, 5, "a{k}\nb"), ("blockquote", 4, 1, ""), ("paragraph", 4, 2, ""), ("text", 4, 2, "c"))),
    ),
    "p09_item_markers": (
        ("7) a{k}\n8) b\n\n1234567890. no", (("list", 1, 1, "ordered 7 tight"), ("listItem", 1, 1, "-"), ("paragraph", 1, 4, ""), ("text", 1, 4, "a{k}"), ("listItem", 2, 1, "-"), ("paragraph", 2, 4, ""), ("text", 2, 4, "b"), ("paragraph", 4, 1, ""), ("text", 4, 1, "1234567890. no"))),
        ("-{k}\n\n-      x", (("paragraph", 1, 1, ""), ("text", 1, 1, "-{k}"), ("list", 3, 1, "bullet tight"), ("listItem", 3, 1, "-"), ("code", 3, 7, "| x"))),
    ),
    "p10_lists_split": (
        ("- a{k}\n+ b\n\npara\n2. no\n\n* * *", (("list", 1, 1, "bullet tight"), ("listItem", 1, 1, "-"), ("paragraph", 1, 3, ""), ("text", 1, 3, "a{k}"), ("list", 2, 1, "bullet tight"), ("listItem", 2, 1, "-"), ("paragraph", 2, 3, ""), ("text", 2, 3, "b"), ("paragraph", 4, 1, ""), ("text", 4, 1, "para\n2. no"), ("thematicBreak", 7, 1, ""))),
    ),
    "p11_loose_and_tight": (
        ("- a{k}\n\n- b\n\n<!-- -->\n\n- c\n- d", (("list", 1, 1, "bullet loose"), ("listItem", 1, 1, "-"), ("paragraph", 1, 3, ""), ("text", 1, 3, "a{k}"), ("listItem", 3, 1, "-"), ("paragraph", 3, 3, ""), ("text", 3, 3, "b"), ("html", 5, 1, "<!-- -->"), ("list", 7, 1, "bullet tight"), ("listItem", 7, 1, "-"), ("paragraph", 7, 3, ""), ("text", 7, 3, "c"), ("listItem", 8, 1, "-"), ("paragraph", 8, 3, ""), ("text", 8, 3, "d"))),
    ),
    "p12_setext": (
        ("Title {k}\n===\n\nSub\ntwo {k}\n---\n\n> q\n---", (("heading", 1, 1, "1 Title {k}"), ("text", 1, 1, "Title {k}"), ("heading", 4, 1, "2 Sub\ntwo {k}"), ("text", 4, 1, "Sub\ntwo {k}"), ("blockquote", 8, 1, ""), ("paragraph", 8, 3, ""), ("text", 8, 3, "q"), ("thematicBreak", 9, 1, ""))),
    ),
    "p14_thematic_breaks": (("***\n\n---{k}\n\n_ _ _", (("thematicBreak", 1, 1, ""), ("paragraph", 3, 1, ""), ("text", 3, 1, "---{k}"), ("thematicBreak", 5, 1, ""))),),
    "p20_task_items": (
        ("- [x] a{k}\n- [ ] b\n- (x) c", (("list", 1, 1, "bullet tight"), ("listItem", 1, 1, "x"), ("paragraph", 1, 3, ""), ("text", 1, 7, "a{k}"), ("listItem", 2, 1, "o"), ("paragraph", 2, 3, ""), ("text", 2, 7, "b"), ("listItem", 3, 1, "-"), ("paragraph", 3, 3, ""), ("text", 3, 3, "(x) c"))),
    ),
    "p22_escapes": (("\\*a\\* \\q\\\nb{k}", (("paragraph", 1, 1, ""), ("text", 1, 1, "*a* \\q"), ("break", 1, 9, ""), ("text", 2, 1, "b{k}"))),),
    "p23_breaks": (("a  \nb {k}\nc", (("paragraph", 1, 1, ""), ("text", 1, 1, "a"), ("break", 1, 4, ""), ("text", 2, 1, "b {k}\nc"))),),
    "p24_code_spans": (("`` a`b `` and `x {k}", (("paragraph", 1, 1, ""), ("inlineCode", 1, 1, "a`b"), ("text", 1, 10, " and `x {k}"))), ("` `` `{k}", (("paragraph", 1, 1, ""), ("inlineCode", 1, 1, "``"), ("text", 1, 7, "{k}")))),
    "p26_mail_links": (("<me@x.org> {k}", (("paragraph", 1, 1, ""), ("link", 1, 1, "mailto:me@x.org"), ("text", 1, 2, "me@x.org"), ("text", 1, 11, " {k}"))), ("<http://y.z/{k}>", (("paragraph", 1, 1, ""), ("link", 1, 1, "http://y.z/{k}"), ("text", 1, 2, "http://y.z/{k}")))),
    "p27_inline_html": (
        ("a <b c='1'>x</b> <!-- y --> {k}", (("paragraph", 1, 1, ""), ("text", 1, 1, "a "), ("html", 1, 3, "<b c='1'>"), ("text", 1, 12, "x"), ("html", 1, 13, "</b>"), ("text", 1, 17, " "), ("html", 1, 18, "<!-- y -->"), ("text", 1, 28, " {k}"))),
    ),
    "p31_links_do_not_nest": (("# [a [b](u{k}) c](v) ![d [e](w)](x)", (("heading", 1, 1, "1 [a b c](v) d e"), ("link", 1, 6, "u{k}"), ("image", 1, "+19", "x"))),),
    "p32_flanking": (("# a_b_c *d*e _f_ {k}", (("heading", 1, 1, "1 a_b_c de f {k}"), ("emphasis", 1, 9, ""), ("emphasis", 1, 14, ""))), ("# a * b* _ c_ {k}", (("heading", 1, 1, "1 a * b* _ c_ {k}"),))),
    "p33_emphasis": (
        ("# ***a*** **b *c*** ~~d~~ {k}", (("heading", 1, 1, "1 a b c d {k}"), ("emphasis", 1, 3, ""), ("strong", 1, 4, ""), ("strong", 1, 11, ""), ("emphasis", 1, 15, ""), ("delete", 1, 21, ""))),
        ("# *foo**bar* **x*y {k}", (("heading", 1, 1, "1 foo**bar **x*y {k}"), ("emphasis", 1, 3, ""))),
    ),
    "j07_shortcuts_need_definitions": (("# [x] [y] [z][] [q][y] {k}\n\n[y]: /u{k}\n[Y]: /v", (("heading", 1, 1, "1 [x] y z q {k}"), ("linkReference", 1, 7, "y"), ("linkReference", 1, 11, "z"), ("linkReference", 1, 17, "y"), ("definition", 3, 1, "y"), ("definition", 4, 1, "y"))),),
}
#: Where runs and brackets that stay text are nodes of their own: the heading shows all text.
WITHOUT_TEXT = ("p31_links_do_not_nest", "p32_flanking", "p33_emphasis", "j07_shortcuts_need_definitions")


def docs(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(doc_id, text): each case of ``name`` for each customer."""
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(text).alias("t")) for i, (text, _) in enumerate(CASES[name])])
    each = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("k"), F.inline(rows))
    return each.select(F.concat_ws("/", F.lit(name), "i", "k").alias("doc_id"), F.replace("t", F.lit("{k}"), F.col("k")).alias("text"))


def detail() -> Column:
    kind = F.col("type")
    spacing = F.when(F.col("spread"), "loose").otherwise("tight")
    return (
        F.when(kind == "heading", F.concat_ws(" ", F.col("heading_depth").cast("string"), "text_content"))
        .when(kind == "code", F.concat(F.coalesce("lang", F.lit("")), F.lit("|"), F.col("value")))
        .when(kind == "list", F.when(F.col("ordered"), F.concat_ws(" ", F.lit("ordered"), F.col("list_start").cast("string"), spacing)).otherwise(F.concat_ws(" ", F.lit("bullet"), spacing)))
        .when(kind == "listItem", F.when(F.col("checked"), "x").when(~F.col("checked"), "o").otherwise("-"))
        .when(kind.isin("link", "image"), F.col("url")).when(kind.isin("linkReference", "definition"), F.col("identifier"))
        .otherwise(F.coalesce("value", F.lit("")))
    )


FIELDS = ("type", "start_line", "start_col", "heading_depth", "ordered", "list_start", "spread", "checked", "lang", "value", "url", "identifier", "text_content")


def oracle(name: str) -> str:
    """The expected nodes in SQL; a column "+n" is n plus the digits of the key."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = []
    for i, (_, nodes) in enumerate(CASES[name]):
        for kind, line, col, shown in nodes:
            place = f"{int(col)}, 1" if isinstance(col, str) else f"{col}, 0"
            rows.append(f"({i}, {quoted(kind)}, {line}, {place}, {quoted(shown)})")
    return f"""SELECT '{name}/' || i || '/' || c_custkey AS doc_id, type, line::INT AS line, (col + wide * length(c_custkey::VARCHAR))::INT AS "column", replace(detail, '{{k}}', c_custkey::VARCHAR) AS detail
FROM customer, (VALUES {', '.join(rows)}) v(i, type, line, col, wide, detail)"""
