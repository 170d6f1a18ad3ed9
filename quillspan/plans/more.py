"""More queries over the driver's tables: parser cases, sources and scopes, sessions, updates, gates, marks, the SQL surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql as sql_functions
from ..functions.jstext import unescape_col
from ..operators import checks, config, drift, nodes, reports
from ..operators.store import settled, shared_path
from ..sources import files
from ..streaming import sessions
from . import cases, queries, render
from .queries import query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


# ---- the parser, case by case --------------------------------------------------------------------------------------------


def _case_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = nodes.parse_nodes(cases.docs(spark, sf_dir, name), fields=cases.FIELDS).where("type <> 'root'")
        found = found.where("type <> 'text'") if name in cases.WITHOUT_TEXT else found
        return found.select("doc_id", "type", F.col("start_line").alias("line"), F.col("start_col").alias("column"), cases.detail().alias("detail"))

    return run


for _name in cases.CASES:
    query(_name, cases.oracle(_name))(_case_query(_name))


@query("w06_first_definition_wins", "SELECT c_custkey, '/a' || c_custkey AS url FROM customer")
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reference leads to where its identifier is defined twice."""
    docs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("[x]: /a"), _text("c_custkey"), F.lit("\n[X]: /b\n\n[x]")).alias("text"))
    found = settled(nodes.parse_nodes(docs, types=("definition", "linkReference"), fields=("node_id", "type", "identifier", "url")), "nodes")
    first = found.where("type = 'definition'").groupBy("doc_id", "identifier").agg(F.min_by("url", "node_id").alias("url"))
    return found.where("type = 'linkReference'").select("doc_id", "identifier").join(first, ["doc_id", "identifier"]).select(F.col("doc_id").alias("c_custkey"), "url")


@query("j03_last_definition_is_checked", "SELECT c_custkey, 2 + c_custkey % 3 AS line, '[' || CASE c_custkey % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'x' ELSE 'X' END || ']' AS label FROM customer")
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identifier that is defined several times and never used is reported at its last definition."""
    k = F.col("c_custkey") % 3
    body = F.when(k == 0, "[x]: /a\n[X]: /b").when(k == 1, "[X]: /a\n[x]: /b\n[x]: /c").otherwise("[x]: /a\n[x]: /b\n[x]: /c\n[X]: /d")
    docs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), body.alias("text"))
    found = checks.reference_findings(settled(checks.parsed_for(docs, "references"), "nodes"))
    return found.select(F.col("doc_id").alias("c_custkey"), F.col("line").cast("long").alias("line"), F.regexp_extract("message", r"\[[xX]\]", 0).alias("label"))


# ---- guards ----------------------------------------------------------------------------------------------------------------

_GUARDED = "c_custkey % 6"


def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By customer: a text over the size limit, a NUL at the start, a NUL just within and just beyond the reach, one that astral characters push beyond it, and a plain one or none."""
    k = F.expr(_GUARDED)
    fill = lambda n: F.repeat(F.lit("a"), F.lit(n))
    text = (
        F.when((k == 0) & (F.col("c_custkey") <= 60), F.repeat(F.lit("x"), F.lit(nodes.LARGEST + 1) + F.col("c_custkey").cast("int"))).when(k == 1, F.concat(F.lit("a\0"), F.col("c_name")))
        .when(k == 2, F.concat(fill(7999), F.lit("\0"))).when(k == 3, F.concat(fill(8000), F.lit("\0"))).when(k == 4, F.concat(F.repeat(F.lit("😀"), F.lit(3)), fill(7994), F.lit("\0")))
        .when(F.col("c_custkey") % 12 == 5, F.lit(None)).otherwise("plain")
    )
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(None).cast("string").alias("path"), text.alias("text"))


_STATUS = f"CASE WHEN {_GUARDED} = 0 AND c_custkey <= 60 THEN 'too-large' WHEN {_GUARDED} IN (1, 2) THEN 'unreadable' WHEN c_custkey % 12 = 5 THEN 'unscanned' ELSE 'scanned' END"


@query("f01_f02_guard_findings", f"SELECT c_custkey AS doc_id, CASE s WHEN 'too-large' THEN 'doc-too-large' ELSE 'doc-unreadable' END AS \"check\", 1 AS line, 1 AS \"column\", CASE s WHEN 'too-large' THEN 'document is 0.5 MB (> 0.5 MB) — too large for a structural scan; split it into smaller docs' ELSE 'document contains a NUL byte in its first 8000 characters — likely binary or corrupted, not scannable as markdown' END AS message FROM (SELECT c_custkey, {_STATUS} AS s FROM customer) WHERE s IN ('too-large', 'unreadable')")
def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_documents(_guarded(spark, sf_dir)).select("doc_id", "check", "line", "column", "message")


@query("r13_scan_report", f"SELECT {_STATUS} AS scan_status, count(*) AS documents FROM customer GROUP BY 1")
def r13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scan_report(nodes.with_status(_guarded(spark, sf_dir)))


# ---- sources and scopes ----------------------------------------------------------------------------------------------------


def _written(spark: SparkSession, sf_dir: str) -> str:
    """A folder of files: a text file per nation in a folder of its own, some with extensions that are not documents'."""
    base = shared_path(spark, "files")
    n = _table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), _text("n_nationkey")).alias("name"), F.concat(F.lit("# "), "n_name", F.lit("\nregion "), _text("n_regionkey")).alias("value"), (F.col("n_nationkey") % 5 == 0).alias("odd"))
    n.where("not odd").drop("odd").write.partitionBy("name").text(f"{base}/texts")
    n.where("odd").drop("odd").write.partitionBy("name").json(f"{base}/others")
    return base


_NATION_FILES = "SELECT 'n' || n_nationkey AS name, '# ' || n_name || chr(10) || 'region ' || n_regionkey || chr(10) AS text FROM nation WHERE n_nationkey % 5 <> 0"


@query("s01_s11_s12_read_documents", _NATION_FILES)
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by extension, in folders below the one that is named."""
    docs = files.read_documents(spark, _written(spark, sf_dir))
    return docs.select(F.regexp_extract("path", r"name=(n\d+)", 1).alias("name"), "text")


@query("s03_unreadable_listed", f"SELECT name, true AS read, NULL::VARCHAR AS error FROM ({_NATION_FILES}) UNION ALL SELECT 'n' || n_nationkey, false, 'FAIL /none/n' || n_nationkey || '.md: not readable' FROM nation WHERE n_nationkey % 5 = 0")
def s03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of files of which some are not there: the rest is read, and each failure is a row."""
    base = _written(spark, sf_dir)
    there = [r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(f"{base}/texts").select("path").collect()]  # one per nation
    gone = [f"/none/n{r['n_nationkey']}.md" for r in _table(spark, sf_dir, "nation").where("n_nationkey % 5 = 0").collect()]
    docs, errors = files.read_listed(spark, there + gone)
    read = docs.select(F.regexp_extract("path", r"name=(n\d+)", 1).alias("name"), F.lit(True).alias("read"), F.lit(None).cast("string").alias("error"))
    lost = errors.where("path like '/none/%'")
    return read.unionByName(lost.select(F.regexp_extract("path", r"(n\d+)\.md$", 1).alias("name"), F.lit(False).alias("read"), "error"))


@query("s11_scope_questions", "SELECT c_nationkey AS scope, kind, count(*) AS documents, count(*) > m AS ask FROM customer, (VALUES ('semantic', 20), ('structure', 50)) k(kind, m) GROUP BY c_nationkey, kind, m")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.explode(F.array(*map(F.lit, files.ASK_BEYOND)))
    return files.scope_questions(_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scope"), kinds.alias("kind"), F.col("c_custkey").alias("doc_id")))


@query("s13_copy_plan", "SELECT 'docs/' || p_partkey || '.md' AS rel_path, '/to/docs/' || p_partkey || '.md' AS to_path, strlen(p_name)::BIGINT AS bytes FROM part WHERE p_partkey % 4 <> 0")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    tree = _table(spark, sf_dir, "part").select(F.concat(F.lit("docs/"), k.cast("string"), F.when(k % 4 == 0, ".test.md").otherwise(".md")).alias("rel_path"), F.encode("p_name", "UTF-8").alias("content"))
    return files.copy_plan(tree, "/to/", exclude=r"\.test\.")


_SID = "user_id || '-' || (day(ts) // 7)"


@query("s14_touched_documents", f"SELECT DISTINCT {_SID} AS sid, 'doc' || (event_id % 3) AS doc_id FROM events WHERE event_type = 'view' AND event_id % 3 <> 2")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame([(f"doc{i}", f"/w/notes/{i}.md", "x") for i in (0, 1)], "doc_id string, path string, text string")
    return files.touched(docs, sessions.classify(queries._hook_events(spark, sf_dir))).select("sid", "doc_id")


# ---- scalar functions ------------------------------------------------------------------------------------------------------


@query("x02_unescape", "SELECT p_partkey, p_name || '*' || p_brand || '\\q[' AS plain FROM part")
def x02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", unescape_col(F.concat("p_name", F.lit("\\*"), "p_brand", F.lit("\\q\\["))).alias("plain"))


@query("x07_x08_html_anchors", "SELECT c_custkey AS doc_id, unnest(CASE c_custkey % 4 WHEN 0 THEN ['a' || c_custkey] WHEN 1 THEN ['b' || c_custkey, 'n'] WHEN 2 THEN ['left'] ELSE ['late'] END) AS anchor FROM customer")
def x08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and names of tags, in both kinds of quotes; not those of data attributes, nor what stands in comments, nested ones too."""
    k, c = F.col("c_custkey") % 4, _text("c_custkey")
    text = (
        F.when(k == 0, F.concat(F.lit('<div id="a'), c, F.lit('" data-id="no">\n</div>'))).when(k == 1, F.concat(F.lit("x <a name = 'n'></a> <b id='b"), c, F.lit("'>y</b>")))
        .when(k == 2, '<div>\n<!-- <i id="gone"> --><p id="left">\n</div>').otherwise('<div>\n<!-<!-- x -->- <i id="gone"> --><p id="late">\n</div>')
    )
    docs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text"))
    return checks.anchors(settled(checks.parsed_for(docs, "targets"), "nodes"))


_BAGS = [f"{bag}.{name}" for bag in sessions.BAGS for name in sessions.NAMES]


@query("x13_edited_paths", "SELECT c_custkey, CASE WHEN c_custkey % 17 = 15 THEN 'second' WHEN c_custkey % 17 = 16 THEN NULL ELSE '/p/' || c_custkey END AS path FROM customer")
def x13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fifteen places of an edited path; an empty one is passed over, and other types are none."""
    c, k = _text("c_custkey"), F.col("c_custkey") % 17
    text = F.when(k == 15, '{"tool_input": {"file_path": "", "path": "second"}}').otherwise('{"tool_input": {"file_path": 3}}')
    for i, place in enumerate(_BAGS):
        opened = "".join(f'{{"{part}": ' for part in place.split("."))
        text = F.when(k == i, F.concat(F.lit(opened + '"/p/'), c, F.lit('"' + "}" * (place.count(".") + 1)))).otherwise(text)
    return _table(spark, sf_dir, "customer").select("c_custkey", sessions.edited_path(F.try_parse_json(text)).alias("path"))


@query("x17_forbidden_keys", "SELECT c_custkey::VARCHAR AS project, 'odd' AS key FROM customer WHERE c_custkey % 3 = 0")
def x17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown keys are reported, those that could touch a prototype are dropped without a word."""
    raw = F.when(F.col("c_custkey") % 3 == 0, '{"odd": 1, "__proto__": {"x": 1}}').otherwise('{"constructor": 1, "prototype": 2, "__proto__": 3}')
    found = config.config_errors(_table(spark, sf_dir, "customer").select(_text("c_custkey").alias("project"), F.lit("project").alias("layer"), F.lit(0).alias("candidate_rank"), raw.alias("raw")))
    return found.select("project", "key")


def _contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 7 == 1, "other").otherwise(F.concat(F.lit("c"), k.cast("string")))
    described = F.when(k % 7 == 2, "").when(k % 7 == 3, F.repeat(F.lit("d"), F.lit(1025))).when(k % 7 == 4, F.concat(F.repeat(F.lit("w "), F.lit(150)), "p_name")).otherwise(F.col("p_name"))
    line = F.when(k % 7 == 2, "").otherwise(F.concat(F.lit('description: "'), described, F.lit('"\n')))
    text = F.concat(F.lit("---\nname: "), name, F.lit("\n"), line, F.lit("x: 1\n---\nbody "), F.when(k % 7 == 5, "").otherwise("report at example.org/issues"), F.lit("\nversion "), F.when(k % 7 == 6, "1.2.0").otherwise("1.2.3"), F.lit("\n"))
    return _table(spark, sf_dir, "part").select(F.concat(F.lit("/c/c"), k.cast("string"), F.lit("/S.md")).alias("path"), text.alias("text"))


@query("x24_g12_staged", "SELECT '/c/c' || p_partkey || '/S.md' AS path, p_partkey % 7 <> 2 AS ok, CASE p_partkey % 7 WHEN 2 THEN NULL WHEN 3 THEN 1025 WHEN 4 THEN 300 + length(p_name) ELSE length(p_name) END::BIGINT AS before, CASE p_partkey % 7 WHEN 2 THEN NULL WHEN 3 THEN 'description: \"' || repeat('d', 197) || '...\"' WHEN 4 THEN 'description: \"' || repeat('w ', 97) || 'w...\"' ELSE 'description: \"' || p_name || '\"' END AS line FROM part")
def x24(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drift.staged(_contracts(spark, sf_dir))
    return rows.select("path", "ok", "before", F.nullif(F.regexp_extract("text", r"(?m)^description: .*$", 0), F.lit("")).alias("line"))


@query("g12_staging_counts", "SELECT count(*) FILTER (WHERE p_partkey % 7 <> 2) AS staged, count(*) FILTER (WHERE p_partkey % 7 = 2) AS failed FROM part")
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.staging_counts(drift.staged(_contracts(spark, sf_dir)))


@query("x27_language_lines", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'Answer in language ''' || CASE c_custkey % 3 WHEN 1 THEN 'th' ELSE 'ja' END || '''. Leave code, file names and technical words as they are.' END AS line FROM customer")
def x27(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    return _table(spark, sf_dir, "customer").select("c_custkey", reports.language_line(F.when(k == 0, "auto").when(k == 1, "th").otherwise("ja")).alias("line"))


# ---- configuration ---------------------------------------------------------------------------------------------------------


@query("k01_candidate_paths", "SELECT c_custkey::VARCHAR AS project, CASE c_custkey % 5 WHEN 0 THEN '/p/' || c_custkey || '/.agents/group/app.json' WHEN 1 THEN '/p/' || c_custkey || '/.app.json' WHEN 2 THEN '/p/' || c_custkey || '/.gemini/group/app.json' ELSE '/p/' || c_custkey || '/.claude/group/app.json' END AS path, c_custkey % 5 <> 4 AS found FROM customer")
def k01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By customer: files at the second and the last candidate, only at the last, at the third, at the first and the third, or at none."""
    c = _table(spark, sf_dir, "customer").select(F.concat(F.lit("/p/"), _text("c_custkey")).alias("root"), _text("c_custkey").alias("project"), (F.col("c_custkey") % 5).alias("k"))
    at = F.when(F.col("k") == 0, F.array(F.lit(2), F.lit(4))).when(F.col("k") == 1, F.array(F.lit(4))).when(F.col("k") == 2, F.array(F.lit(3))).when(F.col("k") == 3, F.array(F.lit(1), F.lit(3))).otherwise(F.expr("array()").cast("array<int>"))
    there = c.select(F.explode(F.transform(at, lambda i: F.element_at(config.candidates(F.col("root"), "app", "group"), i))).alias("path"))
    return config.chosen_path(c.select("project", "root"), there, "app", "group")


@query("k02_global_path", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '/h/.claude/.app.json' WHEN 1 THEN '/o' || c_custkey || '/.app.json' WHEN 2 THEN '/h/.claude/.app.json' ELSE '/first/.app.json' END AS path FROM customer")
def k02(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    told = F.when(k == 1, F.concat(F.lit("/o"), _text("c_custkey"))).when(k == 2, " ,/second").when(k == 3, " /first , /second")
    return _table(spark, sf_dir, "customer").select("c_custkey", config.global_path(told, F.lit("/h"), "app").alias("path"))


# ---- sessions and updates --------------------------------------------------------------------------------------------------


@query("f08_t06_t10_t11_events", """
SELECT event_id AS seq, CASE event_id % 8 WHEN 0 THEN 'doc' WHEN 1 THEN 'record' WHEN 2 THEN 'doc' ELSE 'stop' END AS what, 's' || user_id AS sid,
  CASE event_id % 8 WHEN 0 THEN '/w/a.md' WHEN 1 THEN '/w2/x/MEMORY.md' WHEN 2 THEN '/here/b.rst' END AS path
FROM events WHERE event_id % 8 IN (0, 1, 2, 7)
""")
def f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders from three places; ids that are not allowed, re-entrant stops, temporary files and broken payloads are no events."""
    k, u = F.col("event_id") % 8, F.concat(F.lit("s"), _text("user_id"))
    text = (
        F.when(k == 0, F.concat(F.lit('{"session_id": "'), u, F.lit('", "workspacePaths": ["/w"], "cwd": "/c", "tool_input": {"path": "a.md"}}')))
        .when(k == 1, F.concat(F.lit('\ufeff{"conversationId": "'), u, F.lit('", "session_id": "no", "cwd": "/w2", "toolCall": {"args": {"file": "x/MEMORY.md"}}}')))
        .when(k == 2, F.concat(F.lit('{"sessionId": "'), u, F.lit('", "tool_input": {"path": "./c/../b.rst"}}')))
        .when(k == 3, F.concat(F.lit('{"session_id": "../'), u, F.lit('", "tool_input": {"path": "/a.md"}}')))
        .when(k == 4, F.concat(F.lit('{"session_id": "'), u, F.lit('", "stop_hook_active": true}')))
        .when(k == 5, F.concat(F.lit('{"session_id": "'), u, F.lit('", "tool_input": {"path": "/tmp/a.md"}}')))
        .when(k == 6, "{not json").otherwise(F.concat(F.lit('{"session_id": "'), u, F.lit('", "stop_hook_active": false}')))
    )
    kind = F.when(k.isin(4, 7), "stop").otherwise("edit")
    log = _table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), kind.alias("kind"), text.alias("payload"))
    return sessions.classify(log, cwd="/here").select("seq", "what", "sid", "path")


def _session_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, project (by user) and whether the project keeps a record."""
    e = _table(spark, sf_dir, "events").select(F.concat_ws("-", _text("user_id"), F.floor(F.dayofmonth("ts") / 7).cast("string")).alias("sid"), (F.col("user_id") % 4).alias("k")).distinct()
    return e.select("sid", F.concat(F.lit("p"), _text("k")).alias("project"), (F.col("k") != 3).alias("keeps_record"))


def _settings(spark: SparkSession) -> DataFrame:
    rows = [("p0", "auto", True, []), ("p1", "off", True, []), ("p2", "manual", True, ["conductor"]), ("p3", "auto", True, ["doc-rot"])]
    return spark.createDataFrame(rows, "project string, suiteMode string, docsDriftNudge boolean, disabledCanaries array<string>")


@query("s10_t05_responses", f"SELECT sid, seq, CASE WHEN drift AND u <> 3 THEN 'message' ELSE '{{}}' END AS said FROM (SELECT *, split_part(sid, '-', 1)::BIGINT % 4 AS u FROM ({queries._SESSIONS_SQL})) WHERE u <> 1")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A silenced project prints nothing; manual mode and a silenced conductor do not silence stops; a project without a record file gets {}."""
    stops = sessions.replay(sessions.classify(queries._hook_events(spark, sf_dir)))
    out = sessions.responses(stops, _settings(spark), _session_projects(spark, sf_dir))
    return out.select("sid", "seq", F.when(F.get_json_object("output", "$.systemMessage") == sessions.NOTE, "message").otherwise(F.col("output")).alias("said"))


@query("s10_streamed_sink", f"SELECT CASE WHEN drift THEN 'message' ELSE '{{}}' END AS said, count(*) AS n FROM ({queries._SESSIONS_SQL}) GROUP BY 1")
def s10_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of the stream, written by it as text and read back."""
    base = shared_path(spark, "answers")
    log = queries._hook_events(spark, sf_dir)
    log.write.parquet(f"{base}/log")
    stops = sessions.track(sessions.classify(spark.readStream.schema(log.schema).parquet(f"{base}/log")))
    sessions.write_responses(sessions.responses(stops), f"{base}/out", f"{base}/state").awaitTermination()
    said = F.when(F.get_json_object("value", "$.systemMessage") == sessions.NOTE, "message").otherwise(F.col("value"))
    return spark.read.schema("value string").text(f"{base}/out").groupBy(said.alias("said")).agg(F.count("*").alias("n"))


@query("s10_injected_steps", "SELECT 'p' || c_custkey AS project, '{\"injectSteps\":[{\"ephemeralMessage\":\"one\\ntwo ' || c_custkey || '\"}]}' AS output FROM customer WHERE c_custkey % 3 <> 0")
def s10_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0 or c_custkey % 2 = 0").select(F.concat(F.lit("p"), _text("c_custkey")).alias("project"), (F.col("c_custkey") % 3).alias("k"), _text("c_custkey").alias("c"))
    lines = F.array(F.struct(F.lit(2).alias("rank"), F.when(F.col("k") != 0, F.concat(F.lit("two "), "c")).alias("line")), F.struct(F.lit(1).alias("rank"), F.when(F.col("k") != 0, "one").alias("line")))
    return sessions.injected(c.select("project", F.inline(lines)))


def _starts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Starts of machines (users) in projects; odd users have a stamp from before, of their first day."""
    e, u = _table(spark, sf_dir, "events"), F.col("user_id")
    old = F.when(u % 2 == 1, F.unix_millis(F.date_trunc("day", F.col("ts").cast("timestamp")) - F.expr("INTERVAL 1 DAY")))
    starts = e.select(u.cast("string").alias("machine"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.concat(F.lit("p"), (u % 4).cast("string")).alias("project"), old.alias("old_ms"))
    settings = spark.createDataFrame([("p0", "ask", 2), ("p1", "remind", 1), ("p2", "off", 1), ("p3", "auto", 3)], "project string, updateMode string, updateCheckDays int")
    return starts, settings


_DUE = """
WITH RECURSIVE s AS (
  SELECT user_id, epoch_us(ts) // 1000 AS t, CASE WHEN user_id % 2 = 1 THEN epoch_us(date_trunc('day', ts)) // 1000 - 86400000 END AS old, (CASE user_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 3 END) * 86400000 AS span
  FROM events WHERE user_id % 4 <> 2
), f(user_id, t) AS (
  SELECT user_id, min(t) FROM s WHERE old IS NULL OR t - old >= span GROUP BY 1
  UNION ALL
  SELECT user_id, t FROM (SELECT s.user_id, min(s.t) AS t FROM f JOIN s USING (user_id) WHERE s.t - f.t >= s.span GROUP BY 1)
)
SELECT user_id::VARCHAR AS machine, t AS ts_ms FROM f
"""


@query("t08_due_updates", _DUE)
def t08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.due_updates(*_starts(spark, sf_dir))


@query("t08_due_updates_streamed", _DUE)
def t08_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = shared_path(spark, "updates")
    starts, settings = _starts(spark, sf_dir)
    starts.write.parquet(f"{base}/log")
    stream = spark.readStream.schema(starts.schema).parquet(f"{base}/log")
    fired = sessions.track_updates(sessions.asking(stream, settings))
    fired.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("machine string, ts_ms long").parquet(f"{base}/out")


@query("r12_update_state", f"WITH d AS ({_DUE}) SELECT u::VARCHAR || '/' || (u % 4) AS project, coalesce(strftime(make_timestamp(max(ts_ms) * 1000), '%Y-%m-%d %H:%M:%S'), 'never') AS last_check, CASE u % 4 WHEN 0 THEN 'ask' WHEN 1 THEN 'remind' WHEN 2 THEN 'off' ELSE 'auto' END AS update_mode FROM (SELECT DISTINCT user_id AS u FROM events) LEFT JOIN d ON machine = u::VARCHAR GROUP BY u")
def r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts, settings = _starts(spark, sf_dir)
    who = starts.select("machine", "project").distinct().join(settings.select("project", "updateMode"), "project")
    rows = who.select(F.concat_ws("/", "machine", F.substr("project", F.lit(2))).alias("project"), "machine", "updateMode")
    return reports.update_state(rows, sessions.last_stamps(sessions.due_updates(starts, settings)))


# ---- gates -------------------------------------------------------------------------------------------------------------------


def _counts(gate: DataFrame) -> DataFrame:
    return gate.groupBy("gate", F.coalesce("detail", F.lit("ok")).alias("detail")).agg(F.count("*").alias("n"))


@query("g03_contract_gate", "SELECT 'contract' AS gate, CASE p_partkey % 7 WHEN 1 THEN 'name differs from folder' WHEN 2 THEN 'no description' WHEN 3 THEN 'description too long' WHEN 5 THEN 'no report line' ELSE 'ok' END AS detail, count(*) AS n FROM part GROUP BY ALL")
def g03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(drift.contract_gate(_contracts(spark, sf_dir), "example.org/issues"))


@query("g04_length_gate", "SELECT 'command' AS gate, CASE p_partkey % 7 WHEN 3 THEN 'description of 1025 characters' ELSE 'ok' END AS detail, count(*) AS n FROM part GROUP BY ALL")
def g04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(drift.length_gate(_contracts(spark, sf_dir)))


@query("g02_g05_mention_gate", "SELECT 'wiring' AS gate, CASE WHEN p_partkey % 7 = 5 THEN 'not mentioned' ELSE 'ok' END AS detail, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'wiring', 'no such file', 1")
def g05(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _contracts(spark, sf_dir)
    wanted = docs.select("path", F.lit("example.org/issues").alias("mention")).unionByName(spark.createDataFrame([("/gone", "x")], "path string, mention string"))
    return _counts(drift.mention_gate(docs, wanted))


@query("g02_listing_gate", "SELECT 'listing' AS gate, CASE p_partkey % 4 WHEN 0 THEN 'source differs' WHEN 1 THEN 'states a version' WHEN 2 THEN 'not JSON' ELSE 'ok' END AS detail, count(*) AS n FROM part GROUP BY ALL")
def g02(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, '{"plugins": [{"source": "./x"}]}').when(k == 1, '{"plugins": [{"source": "./dist", "version": "1"}]}').when(k == 2, "{").otherwise('{"plugins": [{"source": "./dist"}]}')
    return _counts(drift.listing_gate(_table(spark, sf_dir, "part").select(_text("p_partkey").alias("path"), text.alias("text")), "./dist"))


@query("g07_a09_version_pins", "SELECT 'version' AS gate, ok, count(*) AS n FROM (SELECT p_partkey % 7 <> 6 AS ok FROM part UNION ALL SELECT false) GROUP BY ok")
def g07(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _contracts(spark, sf_dir)
    gate = drift.version_gate(docs, "version ", "1.2.3").unionByName(drift.version_gate(docs, "never written", "1.2.3"))
    return gate.groupBy("gate", "ok").agg(F.count("*").alias("n"))


@query("g10_smoke_gate", f"WITH f AS (SELECT doc_id, count(*) AS n FROM ({queries.EVERY}) GROUP BY 1), d AS (SELECT {queries.DOC} AS doc_id, o_orderkey % 2 AS k FROM orders) SELECT CASE WHEN k = 0 THEN coalesce(n, 0) = 0 ELSE coalesce(n, 0) >= 2 END AS ok, count(*) AS fixtures FROM d LEFT JOIN f USING (doc_id) GROUP BY 1")
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even orders taken for clean fixtures, odd ones for such with two defects or more."""
    k = F.col("o_orderkey")
    wanted = _table(spark, sf_dir, "orders").select(F.concat(F.lit("/corpus/orders/"), k.cast("string"), F.lit(".md")).alias("doc_id"), F.when(k % 2 == 0, 0).otherwise(2).alias("least"), F.when(k % 2 == 0, 0).alias("most"))
    return drift.smoke_gate(queries._findings(spark, sf_dir), wanted).groupBy("ok").agg(F.count("*").alias("fixtures"))


@query("a06_verdicts", "SELECT 'required' AS gate, count(*) AS checked, count(*) FILTER (WHERE c_custkey % 7 = 0) AS failed, CASE WHEN count(*) FILTER (WHERE c_custkey % 7 = 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM customer UNION ALL SELECT 'command', count(*), 0, 'PASS' FROM part WHERE p_partkey % 7 = 0")
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = _table(spark, sf_dir, "customer").select(F.concat(F.lit("/corpus/customers/"), _text("c_custkey"), F.lit(".md")).alias("path"))
    files_there = drift.required_files(render.manifest_of(render.customer_docs(spark, sf_dir)), want)
    return drift.verdict(files_there.unionByName(drift.length_gate(_contracts(spark, sf_dir).where("path rlike 'never' or cast(regexp_extract(path, '(\\\\d+)/S', 1) as int) % 7 = 0"))))


# ---- reports and marks -------------------------------------------------------------------------------------------------------


@query("a07_scan_statistics", "SELECT c_mktsegment AS canary, CASE c_custkey % 2 WHEN 0 THEN 'quick' ELSE 'full' END AS tier, count(*) AS scans, sum(c_custkey % 5)::BIGINT AS confirmed, sum(c_custkey % 3)::BIGINT AS suspected, sum(c_custkey % 2)::BIGINT AS fixed FROM customer GROUP BY ALL")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return reports.scan_statistics(_table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("canary"), F.when(k % 2 == 0, "quick").otherwise("full").alias("tier"), (k % 5).alias("confirmed"), (k % 3).alias("suspected"), (k % 2).alias("fixed")))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line per kind of mark, by part."""
    k, p = F.col("p_partkey"), _text("p_partkey")
    lines = F.array(
        F.concat(F.lit("adds 2 + "), p, F.lit(" = "), F.when(k % 2 == 0, k + 2).otherwise(k + 3).cast("string")),
        F.concat(F.lit("at v1."), (k % 4).cast("string"), F.lit(".7 now")), F.when(k % 3 == 0, "![b](https://x.example/badge/1.svg)").otherwise("none"), F.when(k % 4 == 0, "FIXME and not yet").otherwise("done"),
        F.when(k % 5 == 0, "cafe\u0301 au lait").otherwise("caf\u00e9 au lait"), F.when(k % 6 == 0, 'a "straight" and \u201ccurly\u201d').otherwise('only "straight"'), F.when(k % 7 == 0, "wait... what\u2026").otherwise("wait"),
    )
    return _table(spark, sf_dir, "part").select(k.alias("doc_id"), F.array_join(lines, "\n").alias("text"))


@query("r1_r3_r5_line_marks", "SELECT p_partkey AS doc_id, mark, line FROM part, (VALUES ('sum', 1, 2, 1), ('version', 1, 1, 2), ('badge', 3, 3, 3), ('todo', 4, 4, 4), ('todo', 4, 4, 4), ('decomposed', 5, 5, 5), ('dots-for-ellipsis', 7, 7, 7)) m(mark, step, kind, line) WHERE CASE mark WHEN 'sum' THEN p_partkey % 2 = 1 ELSE p_partkey % step = 0 END")
def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.line_marks(_marked(spark, sf_dir)).select("doc_id", "mark", "line")


@query("r3_stale_versions", "SELECT p_partkey AS doc_id, 2 AS line, '1.' || (p_partkey % 4) || '.7' AS found, '1.2.10' AS current FROM part WHERE p_partkey % 4 <= 2")
def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _marked(spark, sf_dir)
    return reports.stale_versions(docs, docs.select("doc_id", F.lit("1.2.10").alias("version"))).select("doc_id", "line", "found", "current")


@query("r5_mixed_marks", "SELECT p_partkey AS doc_id, 'quotes' AS mark, 2::INT AS straight, 2::INT AS curly FROM part WHERE p_partkey % 6 = 0 UNION ALL SELECT p_partkey, 'ellipses', 1, 1 FROM part WHERE p_partkey % 7 = 0")
def r5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.mixed_marks(_marked(spark, sf_dir)).select("doc_id", "mark", F.col("straight").cast("int").alias("straight"), F.col("curly").cast("int").alias("curly"))


@query("r2_missing_sections", "SELECT c_custkey AS doc_id, unnest(CASE c_custkey % 3 WHEN 0 THEN ['license'] WHEN 1 THEN ['license', 'usage'] ELSE [] END) AS section FROM customer")
def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    docs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(k == 0, "# Usage\n\nx").when(k == 1, "# Other\n").otherwise("# Usage\n\n## LICENSE\n").alias("text"))
    found = nodes.parse_nodes(docs, types=("root", "heading"), fields=("type", "text_content"))
    return reports.missing_sections(found, spark.createDataFrame([("Usage",), ("License",), (None,)], "section string"))


@query("r2_empty_sections", "SELECT c_custkey AS doc_id, unnest(CASE c_custkey % 2 WHEN 0 THEN [3, 7] ELSE [7] END) AS line FROM customer")
def r2_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("c_custkey") % 2 == 0, "## A\n\n").otherwise("## A\ntext\n")
    docs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("# T\n\n"), body, F.lit("## B\n\n### C\n")).alias("text"))
    found = nodes.parse_nodes(docs, fields=("node_id", "type", "depth_in_tree", "heading_depth", "start_line", "text_content"))
    return reports.empty_sections(found).select("doc_id", "line")


@query("r4_statements", "WITH f AS (SELECT p_brand AS term, p_size AS value, p_partkey AS doc_id FROM part) SELECT DISTINCT f.* FROM f WHERE term IN (SELECT term FROM f GROUP BY term HAVING count(DISTINCT value) > 1)")
def r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.statements(_table(spark, sf_dir, "part").select(F.col("p_brand").alias("term"), F.col("p_size").alias("value"), F.col("p_partkey").alias("doc_id")))


@query("r4_disagreements", "SELECT term, count(*) AS value_count, sum(n)::BIGINT AS documents FROM (SELECT p_brand AS term, p_size, count(DISTINCT p_partkey) AS n FROM part GROUP BY ALL) GROUP BY 1 HAVING count(*) > 1")
def r4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.disagreements(_table(spark, sf_dir, "part").select(F.col("p_brand").alias("term"), F.col("p_size").alias("value"), F.col("p_partkey").alias("doc_id")))


@query("r8_report_rows", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, \"column\", \"check\", message)::INT AS number, doc_id || ':' || line AS place, \"check\", NULL::VARCHAR AS severity, message AS finding, NULL::VARCHAR AS fix FROM ({queries.EVERY})")
def r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_rows(queries._findings(spark, sf_dir).drop("seq"), "doc-structure")


@query("r10_outcomes", f"SELECT CASE WHEN \"check\" = 'bare-url' THEN 'fixed' WHEN \"check\" = 'def-orphan' THEN 'skipped' ELSE 'none' END AS outcome, count(*) AS n FROM ({queries.EVERY}) GROUP BY 1")
def r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = settled(queries._findings(spark, sf_dir).select("doc_id", "check", "line"), "findings")  # no message is made, no order asked for
    word = F.when(F.col("check") == "bare-url", "fixed").when(F.col("check") == "def-orphan", "skipped").otherwise("unknown word")
    out = reports.with_outcome(found, found.select("doc_id", "check", "line", word.alias("outcome")))
    return out.groupBy(F.coalesce("outcome", F.lit("none")).alias("outcome")).agg(F.count("*").alias("n"))


# ---- the SQL surface ---------------------------------------------------------------------------------------------------------


@query("sql_md_slug", "SELECT p_partkey, replace(lower(p_name || ' ' || p_brand), ' ', '-') AS slug FROM (SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9_ -]', '', 'g') AS p_name, regexp_replace(p_brand, '[^A-Za-z0-9_ -]', '', 'g') AS p_brand FROM part)")
def sql_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql_functions.register(spark)
    return _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" "), "p_brand", F.lit("!")).alias("t")).selectExpr("p_partkey", "md_slug(t) AS slug")


@query("sql_md_parse", "SELECT n_nationkey AS doc_id, 'heading' AS type, 1 AS start_line, n_name AS text_content FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT n_nationkey, 'inlineCode', 3, 'c' FROM nation WHERE n_nationkey % 5 <> 0")
def sql_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function refuses what the scan refuses: here a NUL near the start."""
    sql_functions.register(spark)
    nul = F.when(F.col("n_nationkey") % 5 == 0, "\0").otherwise("")
    _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit("# "), "n_name", nul, F.lit("\n\n`c`")).alias("text")).createOrReplaceTempView("md_nation_docs")
    return spark.sql("SELECT d.doc_id, n.type, n.start_line, n.text_content FROM md_nation_docs d, LATERAL md_parse(d.text) n WHERE n.type IN ('heading', 'inlineCode')")


@query("sql_md_findings", "SELECT n_nationkey AS doc_id, 'heading-skip' AS \"check\", 3 AS line FROM nation WHERE n_nationkey % 2 = 0")
def sql_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("n_nationkey") % 2 == 0, "### c").otherwise("## b")
    _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit("# "), "n_name", F.lit("\n\n"), body).alias("text")).createOrReplaceTempView("md_nation_texts")
    return sql_functions.md_findings(spark, "md_nation_texts").select("doc_id", "check", "line")
