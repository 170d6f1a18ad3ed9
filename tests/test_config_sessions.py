import json

import pytest

from quillspan.operators import config, drift, reports
from quillspan.streaming import sessions


def effective(spark, top, own):
    rows = [("p", layer, 0, raw) for layer, raw in (("global", top), ("project", own)) if raw is not None] or [("p", "project", 0, "{}")]
    return config.effective(spark.createDataFrame(rows, "project string, layer string, candidate_rank int, raw string")).first()


@pytest.mark.parametrize(
    ("top", "own", "key", "want"),
    [
        ('{"suiteMode": "off"}', '{"suiteMode": "auto"}', "suiteMode", "off"),
        ('{"suiteMode": "off"}', '{"suiteMode": " auto "}', "suiteMode", "off"),
        ('{"suiteMode": "off"}', '{"suiteMode": null}', "suiteMode", "off"),
        ('{"suiteMode": "off"}', '{"suiteMode": "AUTO"}', "suiteMode", "off"),
        ('{"suiteMode": "auto"}', '{"suiteMode": "Off"}', "suiteMode", "off"),
        (None, '{"updateMode": "auto"}', "updateMode", "ask"),
        (None, '{"updateMode": "remind"}', "updateMode", "remind"),
        ('{"disabledCanaries": ["All"]}', '{"disabledCanaries": []}', "disabledCanaries", ["all"]),
        ('{"disabledCanaries": ["a"]}', '{"disabledCanaries": ["b", "a"]}', "disabledCanaries", ["a", "b"]),
        ('{"disabledCanaries": ["a"]}', '{"disabledCanaries": [1]}', "disabledCanaries", []),
        # A text "false" passes the clamp as a text, so the boolean reads as its default: kept on purpose.
        ('{"docLeak": false}', '{"docLeak": "false"}', "docLeak", True),
        ('{"docLeak": false}', '{"docLeak": true}', "docLeak", False),
        (None, '﻿// note\n{"updateCheckDays": 400, /* x */ "language": "TH"}', "updateCheckDays", 14),
        (None, '{"language": "TH", "u": "// no comment"}', "language", "th"),
        (None, "[1]", "quickVsFull", "quick"),
        (None, "{oops", "severityFloor", "low"),
    ],
)
def test_clamps(spark, top, own, key, want):
    assert effective(spark, top, own)[key] == want


def event(seq, kind, **payload):
    return (seq, kind, json.dumps(payload))


def edit(seq, sid, path, **more):
    return event(seq, "edit", session_id=sid, cwd="/w", tool_input={"file_path": path}, **more)


CASES = [
    ("note", [edit(1, "s", "a.md"), event(2, "stop", session_id="s"), event(3, "stop", session_id="s")], [(2, True, 1)]),
    ("record kept", [edit(1, "s", "MEMORY.md"), edit(2, "s", "a.md"), event(3, "stop", session_id="s"), edit(4, "s", "b.md"), event(5, "stop", session_id="s")], [(3, False, 1), (5, False, 1)]),
    ("code only", [edit(1, "s", "a.py"), event(2, "stop", session_id="s")], []),
    ("temporary", [edit(1, "s", "/tmp/a.md"), edit(2, "s", "../tmp/x/b.md"), event(3, "stop", session_id="s")], []),
    ("bad id", [edit(1, "../s", "a.md"), event(2, "stop", session_id="../s")], []),
    ("again", [edit(1, "s", "a.md"), edit(2, "s", "./a.md"), edit(3, "s", "/w/b.RST"), event(4, "stop", session_id="s", stop_hook_active=True), event(5, "stop", sessionId="s")], [(5, True, 2)]),
    ("shapes", [event(1, "edit", conversationId="s", workspacePaths=["/q"], toolCall={"args": {"path": "n.org"}}), (2, "edit", "{bad"), event(3, "stop", conversationId="s")], [(3, True, 1)]),
    ("dotfile", [edit(1, "s", ".md"), event(2, "stop", session_id="s")], []),
]


@pytest.mark.parametrize(("rows", "want"), [c[1:] for c in CASES], ids=[c[0] for c in CASES])
def test_sessions_replayed(spark, rows, want):
    log = spark.createDataFrame(rows, "seq long, kind string, payload string")
    got = sessions.replay(sessions.classify(log)).orderBy("seq").collect()
    assert [(r.seq, r.drift, r.docs) for r in got] == want


def test_stream_over_batches_equals_replay(spark, tmp_path):
    rows = [(s * 1000 + e[0], e[1], e[2].replace('"s"', f'"s{s}"')) for s, case in enumerate(CASES) for e in case[1]]
    log = spark.createDataFrame(rows, "seq long, kind string, payload string")
    for i, part in enumerate(sorted({r[0] % 1000 for r in rows})):
        log.where(f"seq % 1000 = {part}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 3).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run = sessions.track(sessions.classify(stream)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.read.schema(sessions.OUTPUT).parquet(f"{tmp_path}/out")
    assert got.count() > 0
    want = {(r.sid, r.drift) for r in sessions.replay(sessions.classify(log)).collect()}
    assert {(r.sid, r.drift) for r in got.collect()} == want


def test_responses_and_updates(spark):
    stops = spark.createDataFrame([("s", 1, True, 1), ("t", 2, False, 1)], sessions.OUTPUT)
    assert [json.loads(r.output).get("systemMessage") for r in sessions.responses(stops).orderBy("seq").collect()] == [sessions.NOTE, None]
    settings = spark.createDataFrame([("p", "ask", 2), ("q", "off", 2)], "project string, updateMode string, updateCheckDays int")
    day = 86_400_000
    starts = spark.createDataFrame([("m", t * day, p) for t, p in ((1, "p"), (2, "p"), (3, "p"), (4, "p"), (5, "p"), (9, "q"))], "machine string, ts_ms long, project string")
    assert sorted(r.ts_ms // day for r in sessions.due_updates(starts, settings).collect()) == [1, 3, 5]
    key = spark.createDataFrame([("abc",), ("",)], "t string").select(sessions.hash_key(__import__("pyspark.sql.functions", fromlist=["col"]).col("t")).alias("k")).collect()
    assert [r.k for r in key] == ["3772q3", None]


def test_front_matter_and_descriptions(spark):
    from pyspark.sql import functions as F

    text = "---\nname: 'x y'\ndescription: >-\n  one\n   two\nwhen_to_use: abc\n---\nbody"
    t = spark.createDataFrame([(text,), ("no front",)], "t string")
    got = t.select(drift.front_field(F.col("t"), "name").alias("n"), drift.front_field(F.col("t"), "description").alias("d"), drift.description_length(F.col("t")).alias("l"), drift.replace_description(F.col("t"), F.lit('a "b" \\')).alias("r")).collect()
    assert (got[0].n, got[0].d, got[0].l) == ("x y", "one two", 10)
    assert got[0].r == '---\nname: \'x y\'\ndescription: "a \\"b\\" \\\\"\nwhen_to_use: abc\n---\nbody' and got[1].r == "no front" and got[1].n is None
    long = "word " * 60
    cut = spark.createDataFrame([(long,), ("x" * 300,)], "t string").select(drift.trim_description(F.col("t")).alias("s")).collect()
    assert cut[0].s == ("word " * 39).rstrip() + "..." and len(cut[0].s) <= 200 and cut[1].s == "x" * 197 + "..."


def test_tree_drift_and_gates(spark):
    schema = "rel_path string, content binary"
    source = spark.createDataFrame([("a.md", b"x\r\ny"), ("b.md", b"x"), ("c.md", b"x\ry"), ("d.bin", b"x\r\n"), ("t.test.js", b"")], schema)
    dist = spark.createDataFrame([("a.md", b"x\ny"), ("c.md", b"x\ny"), ("d.bin", b"x\n"), ("z/q.md", b"")], schema)
    got = drift.tree_drift(source, dist, exclude=r"\.test\.", tops=("a.md", "c.md", "d.bin"))
    assert sorted(map(tuple, got.collect())) == [("b.md", "missing"), ("c.md", "stale"), ("d.bin", "stale"), ("z", "orphan-top"), ("z/q.md", "orphan")]
    docs = spark.createDataFrame([("/s/x/S.md", "---\nname: x\ndescription: d\n---\nv1.2.3 pinned"), ("/s/y/S.md", "---\nname: z\n---\n")], "path string, text string")
    gates = drift.contract_gate(docs).unionByName(drift.version_gate(docs, "pinned", "1.2.3")).unionByName(drift.version_gate(docs, "absent", "1"))
    assert sorted((r.gate, r.checked, r.failed, r.verdict) for r in drift.verdict(gates).collect()) == [("contract", 2, 1, "FAIL"), ("version", 2, 1, "FAIL")]


def test_marks_and_sections(spark):
    from quillspan.operators.nodes import parse_nodes

    docs = spark.createDataFrame([("d", "# A\n\n## Empty\n\n## Usage\n\nTODO v1.2.3  x me@ex.org 2 + 2 = 5, 1 + 1 = 2")], "doc_id string, text string")
    marks = {(r.canary, r.mark, r.found) for r in reports.line_marks(docs).collect()}
    assert marks == {("doc-rot", "todo", "TODO"), ("doc-rot", "version", "v1.2.3"), ("doc-quality", "doubled-space", "3  x"), ("doc-leak", "email", "me***"), ("doc-grounding", "sum", "2 + 2 = 5")}
    found = parse_nodes(docs)
    assert [r.text for r in reports.empty_sections(found).collect()] == ["Empty"]
    need = spark.createDataFrame([("Usage",), ("License",)], "section string")
    assert [r.section for r in reports.missing_sections(found, need).collect()] == ["license"]
    with pytest.raises(ValueError):
        reports.missing_sections(found, spark.range(reports.MOST_SECTIONS + 1).selectExpr("cast(id AS string) AS section"))


def test_contradictions_of_every_two_values(spark):
    facts = spark.createDataFrame([(1, "t", "v1"), (2, "t", "v2"), (3, "t", "v3"), (4, "t", "v1"), (0, "t", None), (5, "u", "x"), (6, "u", "x"), (7, None, "y")], "doc_id long, term string, value string")
    got = {(r.term, r.value_a, r.site, r.value_b, r.cited) for r in reports.contradictions(facts).collect()}
    assert got == {("t", "v1", 1, "v2", 2), ("t", "v1", 1, "v3", 3), ("t", "v2", 2, "v3", 3)}
    assert {(r.value, r.doc_id) for r in reports.statements(facts).collect()} == {("v1", 1), ("v1", 4), ("v2", 2), ("v3", 3)}
    assert [tuple(r) for r in reports.disagreements(facts).collect()] == [("t", 3, 4)]


def test_updates_as_a_stream_over_batches(spark, tmp_path):
    day = sessions.DAY_MS
    rows = [("m", t * day, 2, None) for t in (1, 2, 3, 4, 5)] + [("n", t * day, 3, 2 * day) for t in (3, 4, 5, 6, 9)]
    schema = "machine string, ts_ms long, updateCheckDays long, old_ms long"
    for i in range(1, 10):
        spark.createDataFrame([r for r in rows if r[1] == i * day] or [], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run = sessions.track_updates(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted((r.machine, r.ts_ms // day) for r in spark.read.schema("machine string, ts_ms long").parquet(f"{tmp_path}/out").collect())
    assert got == [("m", 1), ("m", 3), ("m", 5), ("n", 5), ("n", 9)]


def test_global_file_is_the_one_of_least_rank(spark):
    raw = spark.createDataFrame([(None, "global", 2, '{"updateCheckDays": 3}'), (None, "global", 1, '{"updateCheckDays": 5}'), ("p", "project", 0, "{}")], "project string, layer string, candidate_rank int, raw string")
    assert [r.updateCheckDays for r in config.effective(raw).collect()] == [5]
