"""Queries over the driver's tables, by inventory id, with SQL that finds the same rows without parsing Markdown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jstext import label_key_col, resolve_path_col, safe_decode_col, slug_col
from ..operators import checks, config, drift, nodes, reports
from ..operators.store import settled, shared_path
from ..sources import files
from ..streaming import sessions
from . import render

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _public(findings: DataFrame) -> DataFrame:
    return findings.select(*checks.COLUMNS)


def _orders(spark: SparkSession, sf_dir: str, *families: str) -> DataFrame:
    """Nodes of the orders' documents, as far as the checks of ``families`` need them."""
    return checks.parsed_for(render.order_docs(spark, sf_dir), *families)


# ---- the checks, by what the rendering rules plant -----------------------------------------------------------------------

DOC = "'/corpus/orders/' || o_orderkey || '.md'"


def _rule(check: str, where: str, line: str, column: str, message: str, suspected: str = "NULL::BOOLEAN", source: str = "orders") -> str:
    return f"SELECT {DOC} AS doc_id, '{check}' AS \"check\", ({line})::INT AS line, ({column})::INT AS \"column\", {message} AS message, {suspected} AS suspected FROM {source} WHERE {where}"


ALT = "'image has empty alt — intentional for purely decorative images (WCAG 1.1.1); a content image needs a description (MD045)'"
URL = "'https://example.com/o/' || o_orderkey"
RULES = {
    "heading-skip": _rule("heading-skip", "o_orderkey % 4 = 0", "3", "1", "'heading level jumps h1 -> h3 (skipped h2)'"),
    "heading-multiple-h1": _rule("heading-multiple-h1", "o_orderkey % 14 = 0", "23", "1", "'more than one top-level (h1) heading in this document'"),
    "heading-duplicate": _rule("heading-duplicate", "o_orderkey % 12 = 0", "21", "1", "'duplicate heading \"Notes\" under the same parent (first at line 19) — a plain #notes link reaches only the first heading in the document to claim that slug, which may be neither one of these two (an earlier heading with different text can claim it first)'"),
    "image-alt-missing": _rule("image-alt-missing", "o_orderkey % 10 = 0", "11", "1", ALT, "true"),
    "file-missing": _rule("file-missing", "o_custkey % 7 = 0", "5", "13 + length(o_orderstatus)", "'relative target ''../customers/' || o_custkey || '.md'' not found (resolved: /corpus/customers/' || o_custkey || '.md)'"),
    "anchor-cross": _rule("anchor-missing", "o_custkey % 7 <> 0 AND o_orderkey % 6 = 0", "5", "13 + length(o_orderstatus)", "'anchor ''#customer-x'' in ../customers/' || o_custkey || '.md matches no heading or HTML id'"),
    "anchor-local": _rule("anchor-missing", "o_orderkey % 5 = 0", "7", "9", "'anchor ''#Details'' exists only as ''#details'' — GitHub anchors are lowercase (case mismatch)'"),
    "ref-undefined": _rule("ref-undefined", "o_orderkey % 8 = 0", "9", "5", "'reference ''[t' || o_orderkey || ']'' has no matching definition — it renders as literal bracket text'"),
    "def-orphan": _rule("def-orphan", "o_orderkey % 9 = 0", "17", "1", "'definition ''[spare]'' is never referenced'"),
    "bare-url": _rule("bare-url", "o_orderkey % 11 = 0", "13", "8", f"'bare URL ''' || {URL} || ''' in prose — wrap it as a markdown link (<' || {URL} || '> or [text](' || {URL} || '))'"),
    "table-ragged": _rule("table-ragged", "(o_orderkey + rn) % 5 = 0", "26 + rn", "1", "'row has 4 cells but the header has 3 — GitHub silently drops the extra cell(s)'", source="(SELECT l_orderkey AS o_orderkey, row_number() OVER (PARTITION BY l_orderkey) AS rn FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))"),
}
EVERY = " UNION ALL ".join(RULES.values())


@query("w01_heading_skip", RULES["heading-skip"])
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _public(checks.heading_findings(_orders(spark, sf_dir, "headings")).where("check = 'heading-skip'"))


@query("w02_heading_multiple_h1", RULES["heading-multiple-h1"])
def w02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _public(checks.heading_findings(_orders(spark, sf_dir, "headings")).where("check = 'heading-multiple-h1'"))


@query("w04_heading_duplicate", RULES["heading-duplicate"])
def w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _public(checks.heading_findings(_orders(spark, sf_dir, "headings")).where("check = 'heading-duplicate'"))


@query("c_image_alt_missing", RULES["image-alt-missing"])
def image_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _public(checks.image_findings(_orders(spark, sf_dir, "images")))


@query("j01_ref_undefined", RULES["ref-undefined"])
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _public(checks.reference_findings(settled(_orders(spark, sf_dir, "references"), "nodes")).where("check = 'ref-undefined'"))


@query("j02_def_orphan", RULES["def-orphan"])
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _public(checks.reference_findings(settled(_orders(spark, sf_dir, "references"), "nodes")).where("check = 'def-orphan'"))


@query("j04_anchor_local", RULES["anchor-local"])
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render.order_docs(spark, sf_dir)
    found = settled(checks.parsed_for(docs, "targets"), "nodes")
    return _public(checks.target_findings(found, docs.withColumn("path", F.lit(None).cast("string")), None))


def _corpus_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render.corpus(spark, sf_dir)
    return _public(checks.target_findings(settled(checks.parsed_for(docs, "targets"), "nodes"), docs, render.manifest_of(docs)))


@query("j05_file_missing", RULES["file-missing"])
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus_targets(spark, sf_dir).where("check = 'file-missing'")


@query("j06_anchor_across_documents", f"{RULES['anchor-cross']} UNION ALL {RULES['anchor-local']}")
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus_targets(spark, sf_dir).where("check = 'anchor-missing'")


@query("j08_table_ragged", RULES["table-ragged"])
def j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _public(checks.table_findings(_orders(spark, sf_dir, "tables")))


@query("j09_bare_url", RULES["bare-url"])
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _public(checks.url_findings(_orders(spark, sf_dir, "urls")))


def _checked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The corpus and its findings. It is read for its size, its states, its paths and its nodes, so it is rendered once and written down."""
    docs = settled(render.corpus(spark, sf_dir), "docs")
    return docs, checks.check_documents(docs, manifest=render.manifest_of(docs))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir)[1]


@query("u01_all_findings", f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, \"column\")::INT AS seq FROM ({EVERY})")
def u01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir)


@query("a01_counts_by_check", f"SELECT \"check\", count(*) AS findings, count(*) FILTER (WHERE suspected) AS suspected, count(DISTINCT doc_id) AS documents FROM ({EVERY}) GROUP BY 1")
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts_by_check(_findings(spark, sf_dir))


@query("s07_summary", f"WITH f AS (SELECT count(*) AS findings FROM ({EVERY})), d AS (SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer WHERE c_custkey % 7 <> 0) AS files) SELECT findings, files, findings || ' finding(s) across ' || files || ' file(s)' AS value FROM f, d")
def s07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.summary(*_checked(spark, sf_dir))


@query("s07_text_lines", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, \"column\")::INT AS seq, doc_id || ':' || line || ':' || \"column\" || ' [' || \"check\" || '] ' || message AS value FROM ({EVERY})")
def s07_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.text_lines(_findings(spark, sf_dir))


@query("s06_report_sizes", f"WITH d AS (SELECT {DOC} AS file FROM orders UNION ALL SELECT '/corpus/customers/' || c_custkey || '.md' FROM customer WHERE c_custkey % 7 <> 0), f AS (SELECT doc_id, count(*) AS n, string_agg(\"check\", ',' ORDER BY line, \"column\") AS checks FROM ({EVERY}) GROUP BY 1) SELECT file, coalesce(n, 0)::INT AS findings, coalesce(checks, '') AS checks FROM d LEFT JOIN f ON doc_id = file")
def s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = files.json_reports(*_checked(spark, sf_dir))
    found = F.from_json(F.get_json_object("value", "$.findings"), "array<struct<check:string,line:int>>")
    return out.select("file", F.size(found).alias("findings"), F.array_join(F.transform(found, lambda x: x["check"]), ",").alias("checks"))


# A severity for the reports' sake: an input by rule, not a judgement.
_SEVERITY = "CASE length(doc_id) % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END"
_RANKED = f"SELECT *, {_SEVERITY} AS severity, length(doc_id) % 4 AS s FROM ({EVERY})"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).drop("seq").withColumn("severity", F.expr(_SEVERITY))


@query("o03_report_and_overflow", f"SELECT doc_id, least(count(*), 3)::BIGINT AS reported, greatest(count(*) - 3, 0)::BIGINT AS left_out FROM ({EVERY}) GROUP BY 1")
def o03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.overflow(_judged(spark, sf_dir), 3).select("doc_id", F.col("reported").cast("long").alias("reported"), F.col("left_out").cast("long").alias("left_out"))


@query("o02_ranked", f"SELECT doc_id, \"check\", line, \"column\", message, suspected, severity, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, line, \"column\", \"check\", message)::INT AS rank FROM ({_RANKED}) QUALIFY rank <= 2")
def o02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.reported(_judged(spark, sf_dir), 2)


@query("o04_top_fixes", f"SELECT doc_id, \"check\", line, \"column\", message, suspected, severity FROM ({_RANKED}) ORDER BY s DESC, doc_id, line, \"column\", \"check\", message LIMIT 3")
def o04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_fixes(_judged(spark, sf_dir))


@query("o05_severity_floor", f"SELECT severity, count(*) AS n FROM ({_RANKED}) WHERE s >= 2 GROUP BY 1")
def o05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.at_or_above(_judged(spark, sf_dir), "high").groupBy("severity").agg(F.count("*").alias("n"))


@query("a08_severity_by_verdict", f"SELECT severity, count(*) FILTER (WHERE suspected IS NULL) AS \"CONFIRMED\", count(*) FILTER (WHERE suspected) AS \"PLAUSIBLE\", 0::BIGINT AS \"REFUTED\" FROM ({_RANKED}) GROUP BY 1")
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.severity_by_verdict(reports.with_verdict(_judged(spark, sf_dir)))


@query("o06_lists", f"SELECT CASE WHEN suspected THEN 'SUSPECTED' ELSE 'CONFIRMED' END AS list, count(*) AS n FROM ({EVERY}) GROUP BY 1")
def o06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.with_verdict(_judged(spark, sf_dir)).groupBy("list").agg(F.count("*").alias("n"))


# ---- nodes, anchors, headings --------------------------------------------------------------------------------------------

_NATION = "SELECT '/corpus/nations/' || c_nationkey || '.md' AS doc_id, c_mktsegment AS seg, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1 AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)"


@query("w05_a02_anchors", f"SELECT doc_id, lower(replace(seg, ' ', '-')) || CASE WHEN n = 0 THEN '' ELSE '-' || n END AS anchor FROM ({_NATION}) UNION SELECT '/corpus/nations/' || n_nationkey || '.md', lower(replace(n_name, ' ', '-')) FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.anchors(settled(checks.parsed_for(render.nation_docs(spark, sf_dir), "targets"), "nodes"))


@query("w03_siblings", f"SELECT doc_id, (1 + 2 * k)::INT AS start_line, (n + 1)::INT AS sibling, (min(1 + 2 * k) OVER (PARTITION BY doc_id, seg))::INT AS first_line FROM ({_NATION}) UNION ALL SELECT DISTINCT doc_id, 1, 1, 1 FROM ({_NATION})")
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.headings(checks.parsed_for(render.nation_docs(spark, sf_dir), "headings", whole=True)).select("doc_id", "start_line", "sibling", "first_line")


@query("p_node_counts", "WITH i AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE (l_orderkey + rn) % 5 = 0) AS wide FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey) AS rn FROM lineitem) GROUP BY 1) SELECT sum(coalesce(n, 0) + 1)::BIGINT AS table_rows, sum(3 + 3 * coalesce(n, 0) + coalesce(wide, 0))::BIGINT AS cells, count(*) FILTER (WHERE o_orderkey % 10 <> -1) AS images, (count(*) FILTER (WHERE o_orderkey % 8 <> 0) + count(*) FILTER (WHERE o_orderkey % 9 = 0))::BIGINT AS definitions FROM orders LEFT JOIN (SELECT * FROM i) ON l_orderkey = o_orderkey")
def p_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda t: F.count_if(F.col("type") == t)
    found = nodes.parse_nodes(render.order_docs(spark, sf_dir), types=("tableRow", "tableCell", "image", "definition"), fields=("type",))
    return found.agg(of("tableRow").alias("table_rows"), of("tableCell").alias("cells"), of("image").alias("images"), of("definition").alias("definitions"))


@query("p_documents_nodes", "SELECT doc_id, 1::BIGINT AS roots FROM documents")
def p_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes.parse_nodes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), types=("root",), fields=("type",))
    return found.groupBy("doc_id").agg(F.count_if(F.col("type") == "root").alias("roots"))


@query("p01_lines", "SELECT doc_id, (len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END)::INT AS lines FROM documents")
def p01(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    parts = F.split("text", "\n", -1)
    return d.select("doc_id", (F.size(parts) - F.when(F.col("text").endswith("\n"), 1).otherwise(0)).alias("lines"))


# Astral characters beyond U+FFFF take two UTF-16 units: they have four bytes in UTF-8.
@query("f01_units_and_status", "SELECT doc_id, (length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')))::BIGINT AS units, CASE WHEN text IS NULL THEN 'unscanned' ELSE 'scanned' END AS scan_status FROM documents")
def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return nodes.with_status(d.select("doc_id", "text")).select("doc_id", "units", "scan_status")


# ---- scalar functions ------------------------------------------------------------------------------------------------------


@query("x01_slugs", "SELECT doc_id, line::INT AS line, replace(regexp_replace(lower(trim(t)), '[^\\p{L}\\p{M}\\p{N} _-]', '', 'g'), ' ', '-') AS slug FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents)")
def x01(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "t")).select("doc_id", "line", slug_col(F.col("t")).alias("slug"))


@query("x03_labels", "SELECT p_partkey, lower(p_name || ' ' || p_brand) AS label FROM part")
def x03(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", label_key_col(F.concat(F.lit(" \t"), "p_name", F.lit("\r\n \t"), "p_brand", F.lit("\n"))).alias("label"))


@query("x06_decode", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || ' é+' WHEN 1 THEN c_name || '%zz' WHEN 2 THEN c_name || '%E0' ELSE c_name || '+' END AS decoded FROM customer")
def x06(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    raw = F.concat("c_name", F.when(k == 0, "%20%C3%A9+").when(k == 1, "%zz").when(k == 2, "%E0").otherwise("+"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", safe_decode_col(raw).alias("decoded"))


@query("x11_resolve", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '/corpus/' || c_nationkey || '/x.md' WHEN 1 THEN '/corpus/docs/y' ELSE '/z/' || c_custkey END AS resolved FROM customer")
def x11(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n, c = F.col("c_custkey") % 3, F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")
    rel = F.when(k == 0, F.concat(F.lit("../"), n, F.lit("/./x.md"))).when(k == 1, F.lit("a/.//../y/")).otherwise(F.concat(F.lit("/q/../z/"), c))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", resolve_path_col(F.lit("/corpus/docs"), rel).alias("resolved"))


@query("x15_hash", "WITH RECURSIVE h(c, s, i, v) AS (SELECT c_custkey, c_name, 0, 5381::BIGINT FROM customer UNION ALL SELECT c, s, i + 1, (v * 33 + ascii(s[i + 1])) % 4294967296 FROM h WHERE i < length(s)), d(c, v, out) AS (SELECT c, v, '' FROM h WHERE i = length(s) UNION ALL SELECT c, v // 36, substr('0123456789abcdefghijklmnopqrstuvwxyz', (v % 36 + 1)::INT, 1) || out FROM d WHERE v > 0) SELECT c AS c_custkey, out AS key FROM d WHERE v = 0")
def x15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", sessions.hash_key(F.col("c_name")).alias("key"))


@query("x21_x23_front_matter", "SELECT p_partkey, p_name AS name, CASE p_partkey % 3 WHEN 0 THEN p_type || ' ' || p_brand WHEN 1 THEN p_type ELSE p_brand END AS description, length(CASE p_partkey % 3 WHEN 0 THEN p_type || ' ' || p_brand WHEN 1 THEN p_type ELSE p_brand END)::BIGINT AS size FROM part")
def x21(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    d = F.when(k == 0, F.concat(F.lit("description: >-\n  "), "p_type", F.lit("\n   "), "p_brand", F.lit("\n"))).when(k == 1, F.concat(F.lit('description: "'), "p_type", F.lit('"\n'))).otherwise(F.concat(F.lit("description:  "), "p_brand", F.lit(" \n")))
    text = F.concat(F.lit("---\nname: "), "p_name", F.lit("\n"), d, F.lit("other: 1\n---\nbody\n"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("t", text)
    return p.select("p_partkey", drift.front_field(F.col("t"), "name").alias("name"), drift.front_field(F.col("t"), "description").alias("description"), drift.description_length(F.col("t")).alias("size"))


@query("x23_trim", "SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE rtrim(CASE WHEN strpos(reverse(c), ' ') BETWEEN 1 AND 196 THEN c[:197 - strpos(reverse(c), ' ')] ELSE c END, ' ' || chr(9)) || '...' END AS short FROM (SELECT doc_id, t, t[:197] AS c FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents))")
def x23(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", drift.trim_description(F.replace("text", F.lit("\n"), F.lit(" "))).alias("short"))


# ---- configuration ---------------------------------------------------------------------------------------------------------

#: By customer: what the global file and the project's file say.
_GLOBAL = ("NULL", "'{\"suiteMode\": \"off\", \"disabledCanaries\": [\"all\"]}'", "'// c\n{\"suiteMode\": \"manual\" /* x */, \"docLeak\": false}'", "'{\"suiteMode\": \"AUTO\", \"updateMode\": \"remind\"}'", "'{\"suiteMode\": \"yes\", \"updateCheckDays\": 30}'")
_PROJECT = ("NULL", "'{\"suiteMode\": \"off\", \"disabledCanaries\": [\"doc-rot\", \"all\"]}'", "'{\"suiteMode\": \"Manual\", \"updateMode\": \"auto\"}'", "'{\"suiteMode\": \"auto\", \"docLeak\": \"false\", \"updateCheckDays\": 1.5}'", "'{\"suiteMode\": null, \"docLeak\": true}'", "'{\"suiteMode\": \" auto \", \"updateCheckDays\": 7}'", "'{\"suiteMode\": 3, \"disabledCanaries\": []'")


def _raw_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda texts: "CASE " + " ".join(f"WHEN c_custkey % {len(texts)} = {i} THEN {t}" for i, t in enumerate(texts)) + " END"
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    project = F.col("c_custkey").cast("string").alias("project")
    top = c.select(project, F.lit("global").alias("layer"), F.lit(0).alias("candidate_rank"), F.expr(pick(_GLOBAL)).alias("raw"))
    return top.unionByName(c.select(project, F.lit("project").alias("layer"), F.lit(1).alias("candidate_rank"), F.expr(pick(_PROJECT)).alias("raw"))).unionByName(
        c.select(project, F.lit("project").alias("layer"), F.lit(3).alias("candidate_rank"), F.lit('{"language": "th"}').alias("raw")).where("project % 7 <> 0")
    )


_CONFIG_SQL = """
WITH m AS (
  SELECT c_custkey::VARCHAR AS project, c_custkey % 5 AS g, c_custkey % 7 AS p FROM customer
  WHERE c_custkey % 5 <> 0 OR c_custkey % 7 <> 0
), x AS (
  SELECT *, CASE g WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS gi, CASE p WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 END AS pi FROM m
)
SELECT project,
  (['off', 'manual', 'auto'])[CASE WHEN pi IS NOT NULL AND pi <= gi THEN pi ELSE gi END] AS "suiteMode",
  CASE WHEN p = 0 THEN (g <> 2) WHEN p = 3 THEN true WHEN p = 4 THEN (g <> 2) ELSE (g <> 2) END AS "docLeak",
  CASE WHEN g = 3 THEN 'remind' ELSE 'ask' END AS "updateMode",
  CASE WHEN p = 5 THEN 7 WHEN p = 3 THEN 14 WHEN g = 4 THEN 30 ELSE 14 END::INT AS "updateCheckDays",
  CASE WHEN g = 1 AND p = 1 THEN 'all,doc-rot' WHEN g = 1 THEN 'all' WHEN p = 1 THEN 'doc-rot,all' ELSE '' END AS disabled
FROM x
"""


@query("k03_effective_config", _CONFIG_SQL)
def k03(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = config.effective(_raw_config(spark, sf_dir))
    return e.select("project", "suiteMode", "docLeak", "updateMode", "updateCheckDays", F.array_join("disabledCanaries", ",").alias("disabled"))


@query("x19_config_errors", """
SELECT c_custkey::VARCHAR AS project, 'global' AS layer, 'suiteMode' AS key, '''suiteMode'' must be one of: auto, manual, off' AS error FROM customer WHERE c_custkey % 5 = 4
UNION ALL SELECT c_custkey::VARCHAR, 'project', 'suiteMode', '''suiteMode'' must be one of: auto, manual, off' FROM customer WHERE c_custkey % 7 IN (4, 5)
UNION ALL SELECT c_custkey::VARCHAR, 'project', 'docLeak', '''docLeak'' must be a boolean' FROM customer WHERE c_custkey % 7 = 3
UNION ALL SELECT c_custkey::VARCHAR, 'project', 'updateCheckDays', '''updateCheckDays'' must be an integer' FROM customer WHERE c_custkey % 7 = 3
UNION ALL SELECT c_custkey::VARCHAR, 'project', NULL, 'config must be a JSON object' FROM customer WHERE c_custkey % 7 = 6
""")
def x19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.config_errors(_raw_config(spark, sf_dir))


@query("t07_offers", f"""
WITH e AS ({_CONFIG_SQL}), c(rank, canary) AS (VALUES (0, 'doc-structure'), (1, 'doc-grounding'), (2, 'doc-standard'), (3, 'doc-rot'), (4, 'doc-consistency'), (5, 'doc-quality'), (6, 'doc-leak'))
SELECT project, canary, rank::INT AS rank FROM e, c
WHERE "suiteMode" = 'auto' AND NOT list_contains(string_split(disabled, ','), 'all') AND NOT list_contains(string_split(disabled, ','), canary) AND (canary <> 'doc-leak' OR "docLeak")
""")
def t07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.offers(config.effective(_raw_config(spark, sf_dir)))


@query("r11_suite_state", f"SELECT \"suiteMode\" AS value, count(*) AS projects FROM ({_CONFIG_SQL}) GROUP BY 1")
def r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = reports.suite_state(config.effective(_raw_config(spark, sf_dir)))
    return state.where("setting = 'suiteMode'").groupBy("value").agg(F.count("*").alias("projects"))


@query("k07_factory_gaps", "SELECT n_nationkey::VARCHAR AS project, CASE n_nationkey % 3 WHEN 1 THEN 'language' ELSE 'updateCheckDays' END AS key, CASE n_nationkey % 3 WHEN 1 THEN 'missing' ELSE 'differs' END AS problem FROM nation WHERE n_nationkey % 3 <> 0")
def k07(spark: SparkSession, sf_dir: str) -> DataFrame:
    import json

    full = {k.name: list(k.default) if k.type == "strings" else k.default for k in config.SCHEMA}
    texts = [full, {k: v for k, v in full.items() if k != "language"}, {**full, "updateCheckDays": 15}]
    pick = F.element_at(F.array(*[F.lit(json.dumps(t)) for t in texts]), (F.col("n_nationkey") % 3 + 1).cast("int"))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return config.factory_gaps(n.select(F.col("n_nationkey").cast("string").alias("project"), F.lit("project").alias("layer"), F.lit(0).alias("candidate_rank"), pick.alias("raw")))


@query("w09_project_root", "SELECT DISTINCT '/home/u/' || c_nationkey || '/a/' || (c_custkey % 5) AS start, CASE WHEN c_nationkey % 2 = 0 THEN '/home/u/' || c_nationkey ELSE '/home/u/' || c_nationkey || '/a/' || (c_custkey % 5) END AS root FROM customer")
def w09(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_nationkey").cast("string")
    dirs = c.select(F.concat(F.lit("/home/u/"), n, F.lit("/a/"), (F.col("c_custkey") % 5).cast("string")).alias("start")).distinct()
    marks = c.where("c_nationkey % 2 = 0").select(F.concat(F.lit("/home/u/"), n).alias("dir")).unionByName(spark.createDataFrame([("/home/u",), ("/home",)], "dir string"))
    return config.project_roots(dirs, marks, "/home/u")


# ---- sessions ----------------------------------------------------------------------------------------------------------------


def _hook_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as payloads: view edits a document, click code, signup the record, purchase a temporary file; error is a stop."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    sid = F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.dayofmonth("ts") / 7).cast("string"))
    name = F.concat(F.lit("notes/"), (F.col("event_id") % 3).cast("string"))
    path = F.when(F.col("event_type") == "view", F.concat(name, F.lit(".md"))).when(F.col("event_type") == "click", F.concat(name, F.lit(".py"))).when(F.col("event_type") == "signup", "x/MEMORY.md").otherwise(F.concat(F.lit("/tmp/"), name, F.lit(".md")))
    edit = F.to_json(F.struct(sid.alias("session_id"), F.lit("/w").alias("cwd"), F.struct(path.alias("file_path")).alias("tool_input")))
    stop = F.to_json(F.struct(sid.alias("conversationId"), F.lit(False).alias("stop_hook_active")))
    is_stop = F.col("event_type") == "error"
    return e.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"), F.when(is_stop, "stop").otherwise("edit").alias("kind"), F.when(is_stop, stop).otherwise(edit).alias("payload"))


_SESSIONS_SQL = """
WITH e AS (
  SELECT user_id || '-' || (day(ts) // 7) AS sid, epoch_us(ts) AS seq, event_type AS t, event_id % 3 AS f FROM events WHERE event_type IN ('view', 'signup', 'error')
), b AS (
  SELECT *, coalesce(sum(CASE WHEN t = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS batch,
         max(CASE WHEN t = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY seq) AS rec FROM e
)
SELECT sid, max(seq) FILTER (WHERE t = 'error') AS seq, max(rec) FILTER (WHERE t = 'error') = 0 AS drift, count(DISTINCT f) FILTER (WHERE t = 'view') AS docs
FROM b GROUP BY sid, batch HAVING count(*) FILTER (WHERE t = 'error') > 0 AND count(*) FILTER (WHERE t = 'view') > 0
"""


@query("t03_sessions_replayed", _SESSIONS_SQL)
def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.replay(sessions.classify(_hook_events(spark, sf_dir)))


@query("t01_sessions_streamed", _SESSIONS_SQL)
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by Structured Streaming: the log as a file source, RocksDB state, all there is, then read back."""
    base = shared_path(spark, "sessions")
    log = _hook_events(spark, sf_dir)
    log.write.parquet(f"{base}/log")
    stream = spark.readStream.schema(log.schema).parquet(f"{base}/log")
    run = sessions.track(sessions.classify(stream)).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(sessions.OUTPUT).parquet(f"{base}/out")


@query("t09_once_per_session", "SELECT count(DISTINCT user_id || '-' || (day(ts) // 7)) AS sessions FROM events")
def t09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.once_per_session(_hook_events(spark, sf_dir)).agg(F.count("*").alias("sessions"))


# ---- drift and gates ---------------------------------------------------------------------------------------------------------


def _trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    name = F.concat(F.lit("docs/"), k.cast("string"), F.when(k % 2 == 0, ".md").otherwise(".bin"))
    source = p.where("p_partkey % 10 <> 3").select(name.alias("rel_path"), F.encode(F.concat("p_name", F.lit("\nend\n")), "UTF-8").alias("content"))
    end = F.when(k % 10 == 4, "\r\nend\n").when(k % 10 == 5, "\r\nend\n").when(k % 10 == 6, "\rend\n").otherwise("\nend\n")
    dist = p.where("p_partkey % 10 <> 7").select(name.alias("rel_path"), F.encode(F.concat("p_name", end), "UTF-8").alias("content"))
    return source, dist


@query("j11_tree_drift", "SELECT 'docs/' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.md' ELSE '.bin' END AS rel_path, CASE p_partkey % 10 WHEN 3 THEN 'orphan' WHEN 7 THEN 'missing' ELSE 'stale' END AS drift FROM part WHERE p_partkey % 10 IN (3, 5, 6, 7)")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.tree_drift(*_trees(spark, sf_dir))


@query("j12_list_drift", "SELECT p_brand AS name, 'listed' AS side FROM part WHERE p_partkey % 3 = 0 EXCEPT ALL SELECT p_brand, 'listed' FROM part WHERE p_partkey % 3 = 1 UNION ALL (SELECT p_brand, 'there' FROM part WHERE p_partkey % 3 = 1 EXCEPT ALL SELECT p_brand, 'there' FROM part WHERE p_partkey % 3 = 0)")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumnRenamed("p_brand", "name")
    return drift.list_drift(p.where("p_partkey % 3 = 0"), p.where("p_partkey % 3 = 1"))


@query("g01_required_files", "SELECT 'required' AS gate, CASE WHEN ok THEN 1 ELSE 0 END AS ok, count(*) AS n FROM (SELECT c_custkey % 7 <> 0 AS ok FROM customer) GROUP BY ALL")
def g01(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    want = c.select(F.concat(F.lit("/corpus/customers/"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("path"))
    gate = drift.required_files(render.manifest_of(render.customer_docs(spark, sf_dir)), want)
    return gate.groupBy("gate", F.col("ok").cast("int").alias("ok")).agg(F.count("*").alias("n"))


@query("g06_manifest_gate", "SELECT CASE p_partkey % 5 WHEN 0 THEN 'version is not semantic' WHEN 1 THEN 'no licence' WHEN 2 THEN 'description is not text' WHEN 3 THEN 'not JSON' ELSE 'ok' END AS detail, count(*) AS n FROM part GROUP BY 1")
def g06(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey") % 5
    text = F.to_json(F.struct(F.col("p_name").alias("name"), F.when(k == 0, "1.2").otherwise("1.2.3").alias("version"), F.when(k != 1, "MIT").alias("license"), F.when(k != 2, F.col("p_type")).alias("description")))
    gate = drift.manifest_gate(p.select(F.col("p_partkey").cast("string").alias("path"), F.when(k == 3, "{").otherwise(text).alias("text")))
    return gate.groupBy(F.coalesce("detail", F.lit("ok")).alias("detail")).agg(F.count("*").alias("n"))


# ---- candidates ----------------------------------------------------------------------------------------------------------------


@query("r6_email_marks", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+')) AS m FROM documents) GROUP BY 1")
def r6(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return reports.line_marks(d).where("mark = 'email'").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("j14_contradictions", "WITH v AS (SELECT c_mktsegment AS term, c_nationkey AS v, min(c_custkey) AS d FROM customer GROUP BY ALL) SELECT a.term, a.v AS value_a, a.d AS site, b.v AS value_b, b.d AS cited FROM v a JOIN v b USING (term) WHERE a.v <> b.v AND a.d < b.d")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return reports.contradictions(c.select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("term"), F.col("c_nationkey").alias("value")))


from . import more  # noqa: E402, F401  more queries register themselves
