"""Trees and gates: what differs between two file trees, front matter and its limits, and assertions over a snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jstext import WS, WS_CLASS, trim_col, utf16_length_col

#: Files compared without regard to CR LF, and limits of descriptions.
TEXT_EXTENSIONS = (".js", ".json", ".md", ".mjs")
DESCRIPTION_LIMIT, SHORT_LIMIT = 1024, 200
SEMVER = r"^\d+\.\d+\.\d+(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?\z"


def suffix(path: Column) -> Column:
    return F.regexp_extract(F.element_at(F.split(path, "/", -1), -1), r"^.+(\.[^.]*)$", 1)


def same_content(a: Column, b: Column, path: Column) -> Column:
    """Equal bytes; for text files CR LF counts as LF, while a lone CR is content. Bytes are compared one to one."""
    plain = lambda c: F.replace(F.decode(c, "ISO-8859-1"), F.lit("\r\n"), F.lit("\n"))
    return (a == b) | (suffix(path).isin(*TEXT_EXTENSIONS) & (plain(a) == plain(b)))


def tree_drift(source: DataFrame, dist: DataFrame, *, exclude: str | None = None, tops: tuple[str, ...] | None = None) -> DataFrame:
    """(rel_path, drift) of two trees(rel_path, content): missing, stale, orphan, or orphan-top for top entries not in ``tops``."""
    if exclude:
        source, dist = source.where(~F.col("rel_path").rlike(exclude)), dist.where(~F.col("rel_path").rlike(exclude))
    both = source.select("rel_path", F.col("content").alias("a"), F.lit(1).alias("in_a")).join(dist.select("rel_path", F.col("content").alias("b"), F.lit(1).alias("in_b")), "rel_path", "full_outer")
    kind = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "orphan").when(~F.coalesce(same_content(F.col("a"), F.col("b"), F.col("rel_path")), F.lit(True)), "stale")
    out = both.select("rel_path", kind.alias("drift")).where("drift is not null")
    if tops is not None:
        top = F.substring_index("rel_path", "/", 1)
        extra = dist.select(top.alias("rel_path")).distinct().where(~F.col("rel_path").isin(*tops)).select("rel_path", F.lit("orphan-top").alias("drift"))
        out = out.unionByName(extra)
    return out


def list_drift(listed: DataFrame, there: DataFrame) -> DataFrame:
    """(name, side): in one list but not the other, counting repeats."""
    return listed.select("name").exceptAll(there.select("name")).withColumn("side", F.lit("listed")).unionByName(there.select("name").exceptAll(listed.select("name")).withColumn("side", F.lit("there")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` names it: as plain columns each use would compute it again, below branches and lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def front_matter(text: Column) -> Column:
    return F.regexp_extract(text, r"^---\r?\n([\s\S]*?)\r?\n---", 1)


def front_lines(text: Column) -> Column:
    """The lines of the front matter; without one, an empty line."""
    return F.split(front_matter(text), r"\r?\n", -1)


def line_of(lines: Column, key: str) -> Column:
    """Where a field begins, from 1; 0 where it is absent."""
    return F.array_position(F.transform(lines, lambda x: x.startswith(f"{key}:")), True).cast("int")


def block_end(below: Column) -> Column:
    """The first line, from 1, that is not indented; 0 if all are."""
    return F.array_position(F.transform(below, lambda x: x.rlike(rf"^[{WS_CLASS}]+[^{WS_CLASS}]")), False).cast("int")


def field_of(lines: Column, key: str) -> Column:
    """A field of front_lines: bare, quoted, or a block whose indented lines are joined by spaces; null where it is absent."""

    def block(below: Column) -> Column:
        return let(block_end(below), lambda ended: F.array_join(F.transform(F.when(ended > 0, F.slice(below, F.lit(1), ended - 1)).otherwise(below), trim_col), " "))

    def value(at: Column) -> Column:
        below = F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0)))
        quoted = lambda own: own.rlike(r"""^(?:"[\s\S]*"|'[\s\S]*')\z""") & (F.char_length(own) > 1)
        read = lambda own: F.when(own.rlike(r"^[>|][-+]?\z"), let(below, block)).when(quoted(own), F.substr(own, F.lit(2), F.char_length(own) - 2)).otherwise(own)
        return F.when(at > 0, let(trim_col(F.substr(F.element_at(lines, at), F.lit(len(key) + 2))), read))

    return let(line_of(lines, key), value)


def front_field(text: Column, key: str) -> Column:
    """field_of the front matter of ``text``."""
    return let(front_lines(text), lambda lines: field_of(lines, key))


def described_length(lines: Column) -> Column:
    return utf16_length_col(F.coalesce(field_of(lines, "description"), F.lit(""))) + utf16_length_col(F.coalesce(field_of(lines, "when_to_use"), F.lit("")))


def description_length(text: Column) -> Column:
    return let(front_lines(text), described_length)


def trim_description(text: Column, limit: int = SHORT_LIMIT) -> Column:
    """At most ``limit`` characters: cut at the last space that leaves room for the dots."""

    def kept(cut: Column) -> Column:
        return let(F.instr(F.reverse(cut), F.lit(" ")), lambda back: F.when((back > 0) & (back < limit - 3), F.substr(cut, F.lit(1), F.lit(limit - 3) - back)).otherwise(cut))

    return let(text, lambda t: F.when(utf16_length_col(t) <= limit, t).otherwise(F.concat(F.rtrim(let(F.substring(t, 1, limit - 3), kept), F.lit(WS)), F.lit("..."))))


def replace_description(text: Column, value: Column) -> Column:
    """The front matter's description as one quoted line."""
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    tail = F.regexp_replace(text, r"^---\r?\n[\s\S]*?\r?\n---", "")

    def replaced(lines: Column, at: Column) -> Column:
        below = F.slice(lines, at + 1, F.size(lines) - at)
        block = trim_col(F.substr(F.element_at(lines, at), F.lit(13))).rlike(r"^[>|][-+]?\z")
        left = lambda under: let(block_end(under), lambda ended: F.when(ended > 0, F.slice(under, ended, F.size(under) - ended + 1)).otherwise(F.slice(under, 1, 0)))
        rest = F.when(~block, below).otherwise(let(below, left))
        new = F.concat(F.slice(lines, F.lit(1), at - 1), F.array(F.concat(F.lit('description: "'), escaped, F.lit('"'))), rest)
        return F.when(at > 0, F.concat(F.lit("---\n"), F.array_join(new, "\n"), F.lit("\n---"), tail)).otherwise(text)

    return let(front_lines(text), lambda lines: let(line_of(lines, "description"), lambda at: replaced(lines, at)))


def required_files(manifest: DataFrame, required: DataFrame) -> DataFrame:
    """(gate, subject, ok, detail) for each required path."""
    met = required.select("path").distinct().join(manifest.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    ok = F.coalesce("there", F.lit(False))
    return met.select(F.lit("required").alias("gate"), F.col("path").alias("subject"), ok.alias("ok"), F.when(~ok, "missing").alias("detail"))


def contract_gate(docs: DataFrame, report_line: str | None = None) -> DataFrame:
    """Contracts docs(path, text): the front matter's name is the folder's, the description is there and within its limit, and the text says where to report problems (``report_line``)."""
    folder = F.element_at(F.split("path", "/", -1), -2)

    def judged(lines: Column) -> Column:
        detail = F.when(~field_of(lines, "name").eqNullSafe(folder), "name differs from folder").when(F.coalesce(field_of(lines, "description"), F.lit("")) == "", "no description").when(described_length(lines) > DESCRIPTION_LIMIT, "description too long")
        return detail if report_line is None else detail.when(~F.col("text").contains(report_line), "no report line")

    rows = docs.select(F.col("path").alias("subject"), let(front_lines(F.col("text")), judged).alias("detail"))
    return rows.select(F.lit("contract").alias("gate"), "subject", F.col("detail").isNull().alias("ok"), "detail")


def manifest_gate(manifests: DataFrame) -> DataFrame:
    """Manifests(path, text) in JSON: a name, a semantic version, a licence, and a description that is text within its limit."""
    v = F.try_parse_json("text")
    get = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    described = F.schema_of_variant(F.variant_get(v, "$.description", "variant")) == "STRING"
    detail = (
        F.when(v.isNull(), "not JSON").when(F.coalesce(get("name"), F.lit("")) == "", "no name").when(~F.coalesce(get("version").rlike(SEMVER), F.lit(False)), "version is not semantic")
        .when(F.coalesce(get("license"), F.lit("")) == "", "no licence").when(~F.coalesce(described, F.lit(False)), "description is not text").when(utf16_length_col(get("description")) > DESCRIPTION_LIMIT, "description too long")
    )
    return manifests.select(F.lit("manifest").alias("gate"), F.col("path").alias("subject"), detail.isNull().alias("ok"), detail.alias("detail"))


def length_gate(docs: DataFrame) -> DataFrame:
    """Commands docs(path, text): description and when_to_use within their limit together; neither need be there."""
    size = description_length(F.col("text"))
    ok = size <= DESCRIPTION_LIMIT
    return docs.select(F.lit("command").alias("gate"), F.col("path").alias("subject"), ok.alias("ok"), F.when(~ok, F.format_string("description of %d characters", size)).alias("detail"))


def mention_gate(docs: DataFrame, wanted: DataFrame, gate: str = "wiring") -> DataFrame:
    """Each of wanted(path, mention) must stand in the text of docs(path, text): hooks that are wired, an engine called by its relative path."""
    met = wanted.select("path", "mention").join(docs.select("path", "text"), "path", "left")
    ok = F.coalesce(F.contains("text", "mention"), F.lit(False))
    return met.select(F.lit(gate).alias("gate"), F.concat_ws(" ", "path", "mention").alias("subject"), ok.alias("ok"), F.when(F.col("text").isNull(), "no such file").when(~ok, "not mentioned").alias("detail"))


def listing_gate(listings: DataFrame, source: str) -> DataFrame:
    """Listings(path, text) in JSON: the first plugin comes from ``source`` and states no version, which has its home in the manifest."""
    v = F.try_parse_json("text")
    first = lambda k: F.try_variant_get(v, f"$.plugins[0].{k}", "string")
    version = F.variant_get(v, "$.plugins[0].version", "variant")
    detail = F.when(v.isNull(), "not JSON").when(~F.coalesce(first("source") == source, F.lit(False)), "source differs").when(version.isNotNull(), "states a version")
    return listings.select(F.lit("listing").alias("gate"), F.col("path").alias("subject"), detail.isNull().alias("ok"), detail.alias("detail"))


def smoke_gate(findings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Fixtures wanted(doc_id, least, most): the number of findings of each is within its bounds (most null: no upper bound)."""
    counts = findings.groupBy("doc_id").agg(F.count("*").alias("n"))
    met = wanted.join(counts, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ok = (F.col("n") >= F.col("least")) & (F.col("most").isNull() | (F.col("n") <= F.col("most")))
    return met.select(F.lit("smoke").alias("gate"), F.col("doc_id").cast("string").alias("subject"), ok.alias("ok"), F.when(~ok, F.format_string("%d findings", "n")).alias("detail"))


def staged(docs: DataFrame, limit: int = SHORT_LIMIT) -> DataFrame:
    """(path, ok, before, after, text) of contracts docs(path, text): the description cut to ``limit``; a contract without one fails and keeps its text."""
    text = F.col("text")

    def cut(description: Column) -> Column:
        rest = lambda short: F.struct(description.isNotNull().alias("ok"), utf16_length_col(description).alias("before"), utf16_length_col(short).alias("after"), F.when(description.isNotNull(), replace_description(text, short)).otherwise(text).alias("text"))
        return let(trim_description(description, limit), rest)

    return docs.select("path", let(front_field(text, "description"), cut).alias("_cut")).select("path", "_cut.*")


def staging_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("ok").alias("staged"), F.count_if(~F.col("ok")).alias("failed"))


def version_gate(docs: DataFrame, marker: str, version: str) -> DataFrame:
    """Lines of docs(path, text) that hold ``marker`` must quote ``version``; a corpus without such lines fails."""
    lines = docs.select("path", F.posexplode(F.split("text", r"\r?\n", -1)).alias("i", "line")).where(F.col("line").contains(marker))
    pins = lines.select(F.lit("version").alias("gate"), F.concat_ws(":", "path", (F.col("i") + 1).cast("string")).alias("subject"), F.col("line").contains(version).alias("ok"), F.lit(None).cast("string").alias("detail"))
    none = pins.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("version").alias("gate"), F.lit("*").alias("subject"), F.lit(False).alias("ok"), F.lit("no version line").alias("detail"))
    return pins.unionByName(none)


def verdict(gates: DataFrame) -> DataFrame:
    """(gate, checked, failed, verdict)."""
    return gates.groupBy("gate").agg(F.count("*").alias("checked"), F.count_if(~F.col("ok")).alias("failed")).withColumn("verdict", F.when(F.col("failed") == 0, "PASS").otherwise("FAIL"))
