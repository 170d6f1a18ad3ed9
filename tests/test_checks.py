from pyspark.sql import functions as F

from quillspan.operators import checks, nodes
from quillspan.plans.render import manifest_of
from quillspan.sources import files

DEFECTS = """# Title

### Skipped

# Second

[bad](#nowhere) and [case](#Title)

[gone](./gone.md) [other](other.md#lost) ![](pic.png)

| a | b |
|---|---|
| 1 | 2 | 3 |
| 1 |

[x][undefined] https://bare.example/a_b. `https://code.example`

[idle]: https://idle.example

## Twice

## Twice

[ok](#twice-1) [id](#mark) [dir](sub/) [enc](other.md#caf%C3%A9) [up](/root.md) [m](mailto:a@b) <a id="mark">
"""


def run(spark, rows, extra=()):
    docs = spark.createDataFrame(rows, "doc_id string, path string, text string")
    manifest = manifest_of(docs).unionByName(spark.createDataFrame([(p, False) for p in extra] or [("/none", True)], "path string, is_dir boolean"))
    found = checks.check_documents(docs, nodes.parse_nodes(docs).persist(), manifest).persist()
    return {d: [(r["check"], r["line"]) for r in found.where(F.col("doc_id") == d).orderBy("seq").collect()] for d, *_ in rows}, found, docs


def test_planted_defects(spark):
    rows = [("a", "/d/a.md", DEFECTS), ("o", "/d/other.md", "# Café\n\n## x"), ("n", None, "[dead](./gone.md) [bad](#nope)")]
    got, found, docs = run(spark, rows, ["/d/pic.png", "/d/sub"])
    assert got["a"] == [
        ("heading-skip", 3), ("heading-multiple-h1", 5), ("anchor-missing", 7), ("anchor-missing", 7), ("file-missing", 9), ("anchor-missing", 9),
        ("image-alt-missing", 9), ("table-ragged", 13), ("ref-undefined", 16), ("bare-url", 16), ("def-orphan", 18), ("heading-duplicate", 22),
    ]
    assert got["o"] == [] and got["n"] == [("anchor-missing", 1)]
    lines = {r.value for r in files.text_lines(found).collect()}
    assert "a:3:1 [heading-skip] heading level jumps h1 -> h3 (skipped h2)" in lines
    assert "a:16:16 [bare-url] bare URL 'https://bare.example/a' in prose — wrap it as a markdown link (<https://bare.example/a> or [text](https://bare.example/a))" in lines
    assert files.summary(docs, found).first().value == "13 finding(s) across 3 file(s)"
    report = {r.file: r.value for r in files.json_reports(docs, found).collect()}
    assert '"suspected":true' in report["/d/a.md"] and report["/d/other.md"] == '{"file":"/d/other.md","findings":[]}'


def test_guards_and_linked_refusals(spark):
    rows = [("big", "/d/big.md", "x" * 600_000), ("nul", "/d/nul.md", "# a\0"), ("null", "/d/null.md", None), ("l", "/d/l.md", "[a](big.md#x) [b](nul.md#x)"), ("e", "/d/e.md", "")]
    got, _, docs = run(spark, rows)
    assert got == {"big": [("doc-too-large", 1)], "nul": [("doc-unreadable", 1)], "null": [], "l": [], "e": []}
    status = {r.doc_id: r.scan_status for r in nodes.with_status(docs).collect()}
    assert status == {"big": "too-large", "nul": "unreadable", "null": "unscanned", "l": "scanned", "e": "scanned"}


def test_heading_slugs_and_parents(spark):
    text = "# S\n\n## dup\n\n## dup\n\n[0](#dup) [1](#dup-1) [2](#dup-3)\n\n# T\n\n## dup\n\n### \n\n#### \n"
    got, _, _ = run(spark, [("a", None, text)])
    assert got["a"] == [("heading-duplicate", 5), ("anchor-missing", 7), ("heading-multiple-h1", 9)]


def test_definitions_last_wins_and_order_is_by_first(spark):
    _, found, _ = run(spark, [("a", None, "[b]: /1\n[a]: /2\n[b]: /3\n")])
    assert [(r.line, r.message) for r in found.orderBy("seq").collect()] == [(2, "definition '[a]' is never referenced"), (3, "definition '[b]' is never referenced")]


def test_wrapped_url_and_comments(spark):
    got, _, _ = run(spark, [("a", None, "one\ntwo www.x.y\n\n[m](#k) [n](#z)\n\n<!-- <a id='k'> --><i name=\"z\" data-id='q'>\n")])
    assert got["a"] == [("bare-url", 2), ("anchor-missing", 4)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id string, path string, text string")
    assert checks.check_documents(docs, nodes.parse_nodes(docs).persist(), manifest_of(docs)).count() == 0


def test_counts_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(str(i), f"/d/{i}.md", DEFECTS) for i in range(20)], "doc_id string, path string, text string")
    counts = [checks.check_documents(d, nodes.parse_nodes(d).persist(), manifest_of(d)).count() for d in (docs.coalesce(1), docs.repartition(7))]
    assert counts[0] == counts[1] > 0


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes(b"# a\xff\n")
    (tmp_path / "sub" / "b.MARKDOWN").write_text("b")
    (tmp_path / "c.py").write_text("c")
    docs = files.read_documents(spark, str(tmp_path))
    assert sorted((r.path.rsplit("/", 1)[1], r.text) for r in docs.collect()) == [("a.md", "# a�\n"), ("b.MARKDOWN", "b")]
    listed = spark.createDataFrame([(f"{tmp_path}/a.md",), ("/gone.md",)], "path string")
    assert [r.path for r in files.unreadable(listed, docs).collect()] == ["/gone.md"]
    assert sorted(r.rel_path for r in files.file_tree(spark, str(tmp_path), exclude=r"\.py$").collect()) == ["a.md", "sub/b.MARKDOWN"]


def test_parse_is_dealt_over_the_cluster(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("# T "), "id", F.lit("\n\n"), F.repeat(F.lit("word "), F.lit(100))).alias("text")).coalesce(1)
    found = nodes.parse_nodes(rows, types=("heading",), fields=("start_line", "text_content"))
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 1000 and sum(sizes) == 3000
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert nodes.parse_nodes(rows.limit(0)).count() == 0 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_pruned_tables_give_the_same_findings(spark):
    docs = spark.createDataFrame([("a", "/r/a.md", DEFECTS), ("b", "/r/other.md", "## caf\u00e9 x\n"), ("c", None, None)], "doc_id string, path string, text string")
    manifest = manifest_of(docs)
    full = checks.check_documents(docs, nodes.parse_nodes(docs), manifest).collect()
    assert sorted(map(str, full)) == sorted(map(str, checks.check_documents(docs, manifest=manifest).collect())) and len(full) > 10


def test_settled_tables_are_released(spark):
    from quillspan.operators import store

    kept = store.settled(spark.range(5).toDF("x"))
    path = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    import os

    assert kept.count() == 5 and os.path.isdir(path)
    store.release(spark)
    assert not os.path.isdir(path)
