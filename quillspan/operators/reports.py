"""Reports over findings: floors, ranks, lists, counts; offers at a session's start; candidates for judgement.

Severity and verdicts are inputs, given by whoever judges; nothing here derives them. Candidate marks of the last part are this
library's own patterns: each is SUSPECTED, and none says that something is wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values.
SEVERITIES = ("low", "medium", "high", "critical")
REPORT_LIMIT, TOP = 32, 3
MOST_SECTIONS = 10_000
#: name, gate (a configuration key) or none.
CANARIES = (("doc-structure", None), ("doc-grounding", None), ("doc-standard", None), ("doc-rot", None), ("doc-consistency", None), ("doc-quality", None), ("doc-leak", "docLeak"))


def rank_of(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower(severity))


def at_or_above(findings: DataFrame, floor: str) -> DataFrame:
    """Findings of a severity of ``floor`` or more; those without a severity stay."""
    return findings.where(F.col("severity").isNull() | (rank_of(F.col("severity")) >= SEVERITIES.index(floor) + 1))


def ranked(findings: DataFrame) -> DataFrame:
    """rank within a document: most severe first, then by place."""
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.coalesce(rank_of(F.col("severity")), F.lit(0))), "line", "column", "check", "message")
    return findings.withColumn("rank", F.row_number().over(w))


def reported(findings: DataFrame, limit: int = REPORT_LIMIT) -> DataFrame:
    """The first ``limit`` of each document's ranked findings."""
    return ranked(findings).where(F.col("rank") <= limit)


def overflow(findings: DataFrame, limit: int = REPORT_LIMIT) -> DataFrame:
    """(doc_id, reported, left_out)."""
    return findings.groupBy("doc_id").agg(F.least(F.count("*"), F.lit(limit)).alias("reported"), F.greatest(F.count("*") - limit, F.lit(0)).alias("left_out"))


def top_fixes(findings: DataFrame, n: int = TOP) -> DataFrame:
    return findings.orderBy(F.desc(F.coalesce(rank_of(F.col("severity")), F.lit(0))), "doc_id", "line", "column", "check", "message").limit(n)


def with_verdict(findings: DataFrame) -> DataFrame:
    """list: CONFIRMED or SUSPECTED; verdict: PLAUSIBLE for suspected ones and all of doc-leak."""
    doubt = F.coalesce("suspected", F.lit(False))
    leak = F.col("canary") == "doc-leak" if "canary" in findings.columns else F.lit(False)
    return findings.withColumn("list", F.when(doubt, "SUSPECTED").otherwise("CONFIRMED")).withColumn("verdict", F.when(doubt | leak, "PLAUSIBLE").otherwise("CONFIRMED"))


def counts_by_check(findings: DataFrame) -> DataFrame:
    return findings.groupBy("check").agg(F.count("*").alias("findings"), F.count_if(F.coalesce("suspected", F.lit(False))).alias("suspected"), F.countDistinct("doc_id").alias("documents"))


def scan_statistics(scans: DataFrame) -> DataFrame:
    """scans(canary, tier, confirmed, suspected, fixed): totals by canary and tier."""
    return scans.groupBy("canary", "tier").agg(F.count("*").alias("scans"), F.sum("confirmed").alias("confirmed"), F.sum("suspected").alias("suspected"), F.sum("fixed").alias("fixed"))


def severity_by_verdict(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").pivot("verdict", ["CONFIRMED", "PLAUSIBLE", "REFUTED"]).count().na.fill(0)


def canary_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, g) for i, (n, g) in enumerate(CANARIES)], "rank int, canary string, gate string")


def offers(settings: DataFrame) -> DataFrame:
    """(project, canary, rank) offered at a start: in auto mode, all that are not disabled and whose gate is on; none if silenced."""
    on = settings.where("suiteMode = 'auto' and not arrays_overlap(disabledCanaries, array('conductor', 'all'))")
    table = canary_table(settings.sparkSession)  # seven rows
    met = on.crossJoin(F.broadcast(table)).where(~F.array_contains("disabledCanaries", F.col("canary")) & (F.col("gate").isNull() | F.col("docLeak")))
    return met.select("project", "canary", "rank")


def language_line(language: Column) -> Column:
    """What a session is told about its language; nothing where that is left to it."""
    return F.when(language != "auto", F.concat(F.lit("Answer in language '"), language, F.lit("'. Leave code, file names and technical words as they are.")))


#: What may become of a finding after a round of fixes.
OUTCOMES = ("fixed", "skipped", "no_change_needed")


def with_outcome(findings: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``findings`` with the outcome that outcomes(doc_id, check, line, outcome) tell; unknown words and untold ones are null."""
    told = outcomes.where(F.col("outcome").isin(*OUTCOMES)).groupBy("doc_id", "check", "line").agg(F.min_by("outcome", F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("outcome"))).alias("outcome"))
    return findings.join(told, ["doc_id", "check", "line"], "left")


#: The columns of each canary's report, after the number.
REPORT_COLUMNS = {
    "doc-structure": ("place", "check", "severity", "finding", "fix"), "doc-grounding": ("place", "claim", "source", "verdict", "severity", "fix"),
    "doc-standard": ("path", "gap", "source", "severity", "fix"), "doc-rot": ("place", "marker", "evidence", "severity", "fix"),
    "doc-consistency": ("place", "other_place", "class", "disagreement", "severity"), "doc-quality": ("place", "axis", "finding", "severity", "fix"),
    "doc-leak": ("place", "class", "excerpt", "stake", "action"),
}


def report_rows(findings: DataFrame, canary: str) -> DataFrame:
    """A canary's report: number, then its columns. What ``findings(doc_id, line, check, message, ...)`` do not have is null: a judge fills it in.

    Numbers run within a document, most severe first."""
    rows = findings if "severity" in findings.columns else findings.withColumn("severity", F.lit(None).cast("string"))
    known = {"place": F.concat_ws(":", F.col("doc_id").cast("string"), F.col("line").cast("string")), "path": F.col("doc_id").cast("string"), "finding": F.col("message"), "evidence": F.col("message"), "gap": F.col("message"), "marker": F.col("check"), "axis": F.col("check"), "class": F.col("check")}
    pick = lambda c: known[c] if c in known else F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    return ranked(rows).select("doc_id", F.col("rank").alias("number"), *[pick(c).alias(c) for c in REPORT_COLUMNS[canary]])


def update_state(projects: DataFrame, stamps: DataFrame) -> DataFrame:
    """(project, last_check, update_mode) of projects(project, machine, updateMode): the machine's last stamp(machine, last_ms) as a UTC time, or never."""
    met = projects.join(stamps.select("machine", "last_ms"), "machine", "left")
    when = F.date_format(F.timestamp_millis("last_ms"), "yyyy-MM-dd HH:mm:ss")
    return met.select("project", F.coalesce(when, F.lit("never")).alias("last_check"), F.col("updateMode").alias("update_mode"))


def scan_report(docs: DataFrame) -> DataFrame:
    """(scan_status, documents): what was scanned, what was refused, and what could not be read, which is never called clean."""
    return docs.groupBy("scan_status").agg(F.count("*").alias("documents"))


def suite_state(settings: DataFrame) -> DataFrame:
    """(project, setting, value): the effective configuration as rows."""
    names = [c for c in settings.columns if c != "project"]
    text = [F.struct(F.lit(n).alias("setting"), (F.array_join(n, ",") if n == "disabledCanaries" else F.col(n).cast("string")).alias("value")) for n in names]
    return settings.select("project", F.inline(F.array(*text)))


# ---- candidates (this library's own) ------------------------------------------------------------------------------------

MARKS = (
    ("doc-rot", "todo", r"\b(?:TODO|FIXME|XXX)\b|(?i)\b(?:coming soon|not yet)\b"), ("doc-rot", "badge", r"!\[[^\]]*\]\([^)\s]*(?:badge|shields)[^)]*\)"), ("doc-rot", "version", r"\bv?\d+\.\d+\.\d+\b"), ("doc-rot", "date", r"\b(?:19|20)\d\d-[01]\d-[0-3]\d\b"),
    ("doc-leak", "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("doc-leak", "host", r"\b(?:[a-z0-9-]+\.)+(?:internal|local|corp|lan)\b"), ("doc-leak", "phone", r"\+\d[\d ().-]{7,}\d"),
    ("doc-quality", "doubled-space", r"\S {2,}\S"), ("doc-quality", "dots-for-ellipsis", r"\.\.\.+"), ("doc-quality", "decomposed", r"\p{L}\p{Mn}+"), ("doc-grounding", "sum", r"\b\d+ ?\+ ?\d+ ?= ?\d+\b"),
)


#: Combining marks that compose with Latin letters: grave, acute, circumflex, tilde, macron, breve, dot, diaeresis, ring, caron, dot below, cedilla, ogonek.
COMBINING = "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u030a\u030c\u0323\u0327\u0328"


def composable(found: Column) -> Column:
    """Whether a letter with marks has a composed form: the database's rule as far as it goes for Latin, Greek and Cyrillic letters."""
    return found.rlike(rf"^[A-Za-z\u00c0-\u024f\u0370-\u04ff][{COMBINING}]")


def mixed_marks(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, straight, curly): documents that write quotation marks, or ellipses, in two ways. Each is SUSPECTED."""
    count = lambda p: F.regexp_count("text", F.lit(p))
    pairs = F.array(
        F.struct(F.lit("quotes").alias("mark"), count('"').alias("straight"), count("[\u201c\u201d\u201e]").alias("curly")),
        F.struct(F.lit("apostrophes").alias("mark"), count(r"(?<=\p{L})'(?=\p{L})").alias("straight"), count("(?<=\\p{L})\u2019(?=\\p{L})").alias("curly")),
        F.struct(F.lit("ellipses").alias("mark"), count(r"\.\.\.").alias("straight"), count("\u2026").alias("curly")),
    )
    return docs.where("text is not null").select("doc_id", F.inline(pairs)).where("straight > 0 and curly > 0").withColumn("suspected", F.lit(True))


def stale_versions(docs: DataFrame, current: DataFrame) -> DataFrame:
    """(doc_id, line, found, current): versions in a text that are older than its project's, current(doc_id, version). Each is SUSPECTED.

    Versions are compared part by part, as numbers."""
    parts = lambda v: F.transform(F.split(F.regexp_extract(v, r"^\d+\.\d+\.\d+", 0), r"\."), lambda x: x.cast("long"))
    marks = line_marks(docs).where("mark = 'version'").withColumn("version_found", F.regexp_replace("found", "^v", ""))
    met = marks.join(current.select("doc_id", "version"), "doc_id")
    return met.where(parts(F.col("version_found")) < parts(F.col("version"))).select("doc_id", "line", F.col("version_found").alias("found"), F.col("version").alias("current"), F.lit(True).alias("suspected"))


def line_marks(docs: DataFrame) -> DataFrame:
    """(doc_id, canary, mark, line, found, suspected): matches of the patterns, line by line; found is redacted for doc-leak."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", r"\r?\n", -1)).alias("i", "t"))
    rows = F.array(*[F.struct(F.lit(c).alias("canary"), F.lit(m).alias("mark"), F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias("all")) for c, m, p in MARKS])
    each = lines.select("doc_id", (F.col("i") + 1).alias("line"), F.inline(rows)).where(F.size("all") > 0).select("doc_id", "line", "canary", "mark", F.explode("all").alias("found"))
    # Decomposed letters count where a composed form exists, as NFC would change them.
    each = each.where((F.col("mark") != "decomposed") | composable(F.col("found")))
    shown = F.when(F.col("canary") == "doc-leak", F.concat(F.substring("found", 1, 2), F.lit("***"))).otherwise(F.col("found"))
    wrong = F.split(F.regexp_replace("found", " ", ""), "[+=]")
    right = (F.get(wrong, F.lit(0)).try_cast("long") + F.get(wrong, F.lit(1)).try_cast("long")) == F.get(wrong, F.lit(2)).try_cast("long")
    each = each.where((F.col("mark") != "sum") | ~right)
    return each.select("doc_id", "canary", "mark", "line", shown.alias("found"), F.lit(True).alias("suspected"))


def empty_sections(nodes: DataFrame) -> DataFrame:
    """(doc_id, line, text): headings with nothing but another heading of the same or a higher rank, or the end, after them."""
    blocks = nodes.where("depth_in_tree = 1").select("doc_id", "node_id", "type", "heading_depth", "start_line", "text_content")
    w = Window.partitionBy("doc_id").orderBy("node_id")
    after = blocks.withColumn("next_type", F.lead("type").over(w)).withColumn("next_depth", F.lead("heading_depth").over(w))
    bare = F.col("next_type").isNull() | ((F.col("next_type") == "heading") & (F.col("next_depth") <= F.col("heading_depth")))
    return after.where((F.col("type") == "heading") & bare).select("doc_id", F.col("start_line").alias("line"), F.col("text_content").alias("text"))


def missing_sections(nodes: DataFrame, required: DataFrame) -> DataFrame:
    """(doc_id, section) of required(section) that no heading of a document has.

    A document lists what it has of the required sections, one row, and the rest is the difference: no pair of a document and a
    section is made but those that are missing. The list of required sections goes to every task; it is counted, and beyond
    MOST_SECTIONS the call fails rather than leave some unchecked."""
    wanted = required.select(F.lower("section").alias("section")).where("section is not null").distinct()
    names = sorted(r["section"] for r in wanted.limit(MOST_SECTIONS + 1).collect())
    if len(names) > MOST_SECTIONS:
        raise ValueError(f"more than {MOST_SECTIONS} required sections")
    every = F.array(*map(F.lit, names)).cast("array<string>")
    heads = nodes.where(F.col("type").isin("root", "heading")).select("doc_id", F.when(F.col("type") == "heading", F.lower("text_content")).alias("section"))
    have = heads.groupBy("doc_id").agg(F.collect_set(F.when(F.array_contains(every, F.col("section")), F.col("section"))).alias("have"))
    return have.select("doc_id", F.explode(F.array_except(every, "have")).alias("section"))


def contradictions(facts: DataFrame) -> DataFrame:
    """facts(doc_id, term, value): (term, value_a, site, value_b, cited) for every two values of a term that differ.

    The first document with a value speaks for it, so a term gives as many rows as pairs of its different values, however many
    documents state them; ``statements`` tells all documents of each value. The earlier document is the site. Null values state nothing."""
    first = facts.where("value is not null and term is not null").groupBy("term", "value").agg(F.min("doc_id").alias("doc"))
    a = first.select("term", F.col("value").alias("value_a"), F.col("doc").alias("site"))
    b = first.select("term", F.col("value").alias("value_b"), F.col("doc").alias("cited"))
    later = (F.col("site") < F.col("cited")) | ((F.col("site") == F.col("cited")) & (F.col("value_a") < F.col("value_b")))
    return a.join(b, "term").where((F.col("value_a") != F.col("value_b")) & later).select("term", "value_a", "site", "value_b", "cited")


def disagreements(facts: DataFrame) -> DataFrame:
    """(term, value_count, documents) of terms with more than one value: what to expect of ``contradictions``, in one row per term."""
    by = facts.where("value is not null and term is not null").groupBy("term", "value").agg(F.count_distinct("doc_id").alias("n"))
    return by.groupBy("term").agg(F.count("*").alias("value_count"), F.sum("n").alias("documents")).where("value_count > 1")


def statements(facts: DataFrame) -> DataFrame:
    """(term, value, doc_id): which documents state each value of a term that has more than one."""
    told = facts.where("value is not null and term is not null").select("term", "value", "doc_id").distinct()
    several = told.groupBy("term").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo <> hi").select("term")
    return told.join(several, "term").select("term", "value", "doc_id")
