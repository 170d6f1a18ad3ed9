"""Layered configuration: a global and a project layer, consent-bearing keys clamped to the safer value, reads clamped to the schema.

Input ``raw(project, layer, candidate_rank, raw)``: layer 'global' or 'project', the text of a commented-JSON file; the least rank
of a project's layer counts. A missing, malformed or non-object file is the empty object. Values keep their JSON type (variant):
a key counts by presence, so an explicit null is present and invalid.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jstext import WS


@dataclass(frozen=True)
class Key:
    name: str
    type: str  # bool, int, number, enum, strings
    default: object
    values: tuple[str, ...] = ()
    low: int | None = None
    high: int | None = None


#: Keys, types, defaults and bounds.
SCHEMA = (
    Key("suiteMode", "enum", "auto", ("auto", "manual", "off")),
    Key("language", "enum", "auto", ("auto", "th", "en", "ja", "zh", "es")),
    Key("disabledCanaries", "strings", ()),
    Key("severityFloor", "enum", "low", ("low", "medium", "high", "critical")),
    Key("quickVsFull", "enum", "quick", ("quick", "full")),
    Key("docLeak", "bool", True),
    Key("publicMode", "bool", False),
    Key("docsDriftNudge", "bool", True),
    Key("updateMode", "enum", "ask", ("ask", "auto", "remind", "off")),
    Key("updateCheckDays", "int", 14, low=1, high=365),
)
#: From safest to loudest.
SAFER = {"suiteMode": ("off", "manual", "auto"), "updateMode": ("off", "remind", "ask", "auto"), "docLeak": ("false", "true")}
UNITED = ("disabledCanaries",)
BY_NAME = {k.name: k for k in SCHEMA}
FORBIDDEN = ("__proto__", "constructor", "prototype")
#: Fixed value: strings, kept, or comments.
COMMENTS = r'("(?:\\[^\n\r\u2028\u2029]|[^"\\])*")|//[^\n\r\u2028\u2029]*|/\*[\s\S]*?\*/'


def strip_comments(text: Column) -> Column:
    """Comments off, strings kept; a byte-order mark off the front."""
    return F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), COMMENTS, "$1")


def parsed(text: Column) -> Column:
    v = F.try_parse_json(strip_comments(F.coalesce(text, F.lit("{}"))))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v).otherwise(F.parse_json(F.lit("{}")))


def value(config: Column, name: str) -> Column:
    """(kind, text, items) of a key: kind absent, null, bool, number, string, array or object; text as a script would print it."""
    v = F.variant_get(config, f"$.{name}", "variant")
    shape = F.schema_of_variant(v)
    kind = (
        F.when(v.isNull(), "absent").when(F.is_variant_null(v), "null").when(shape == "BOOLEAN", "bool").when(shape == "STRING", "string")
        .when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object").otherwise("number")
    )
    strings = shape.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.try_variant_get(config, f"$.{name}", "string").rlike(r"\bnull\b(?=[,\]])")
    items = F.when(strings, F.try_variant_get(config, f"$.{name}", "array<string>"))
    text = F.when(kind == "null", "null").when(kind == "array", F.array_join(items, ",")).otherwise(F.try_variant_get(config, f"$.{name}", "string"))
    return F.struct(kind.alias("kind"), text.alias("text"), items.alias("items"))


def default_value(key: Key) -> Column:
    kind = {"bool": "bool", "int": "number", "number": "number", "enum": "string", "strings": "array"}[key.type]
    text = str(key.default).lower() if key.type == "bool" else ",".join(key.default) if key.type == "strings" else str(key.default)
    items = F.array(*map(F.lit, key.default)).cast("array<string>") if key.type == "strings" else F.lit(None).cast("array<string>")
    return F.struct(F.lit(kind).alias("kind"), F.lit(text).alias("text"), items.alias("items"))


def fault(key: Key, v: Column) -> Column:
    """What is wrong with a value, or null."""
    kind, text = v["kind"], v["text"]
    if key.type == "bool":
        return F.when(kind != "bool", "must be a boolean")
    if key.type == "enum":
        good = (kind == "string") & F.lower(text).isin(*key.values)
        return F.when(~good, f"must be one of: {', '.join(key.values)}")
    if key.type == "strings":
        return F.when((kind != "array") | v["items"].isNull(), "must be an array of strings")
    number = text.try_cast("double")
    out = F.when(kind != "number", "must be a finite number")
    if key.type == "int":
        out = out.when(number != F.floor(number), "must be an integer")
    if key.low is not None:
        out = out.when(number < key.low, f"must be >= {key.low}")
    if key.high is not None:
        out = out.when(number > key.high, f"must be <= {key.high}")
    return out


def clamp(key: Key, top: Column, own: Column) -> Column:
    """The safer of the global value and the project's, which may tighten but not loosen it."""
    order = F.array(*map(F.lit, SAFER[key.name]))
    fallback = SAFER[key.name].index(str(key.default).lower()) + 1
    effective = F.when(top["kind"] == "absent", default_value(key)).otherwise(top)
    found = F.array_position(order, F.lower(F.coalesce(effective["text"], F.lit(""))))
    ceiling = F.when(found == 0, fallback).otherwise(found)
    asked = F.array_position(order, F.lower(F.coalesce(own["text"], F.lit(""))))
    canonical = F.struct(F.lit("string").alias("kind"), F.element_at(order, ceiling.cast("int")).alias("text"), F.lit(None).cast("array<string>").alias("items"))
    return F.when(own["kind"] == "absent", top).when((asked > 0) & (asked <= ceiling), own).when(found == 0, canonical).otherwise(effective)


def unite(top: Column, own: Column) -> Column:
    both = F.struct(F.lit("array").alias("kind"), F.lit("").alias("text"), F.array_union(top["items"], own["items"]).alias("items"))
    lists = (top["kind"] == "array") & (own["kind"] == "array")
    return F.when(lists & top["items"].isNotNull() & own["items"].isNotNull(), both).when(own["kind"] != "absent", own).otherwise(top)


def overlay(key: Key, top: Column, own: Column) -> Column:
    if key.name in SAFER:
        return clamp(key, top, own)
    return unite(top, own) if key.name in UNITED else F.when(own["kind"] != "absent", own).otherwise(top)


def read(key: Key, v: Column) -> Column:
    """The typed value: as given if valid, with enums and strings in lower case, else the default."""
    good = (v["kind"] != "absent") & fault(key, v).isNull()
    if key.type == "bool":
        return F.when(good, v["text"] == "true").otherwise(F.lit(key.default))
    if key.type == "enum":
        return F.when(good, F.lower(v["text"])).otherwise(F.lit(key.default))
    if key.type == "strings":
        return F.when(good, F.transform(v["items"], F.lower)).otherwise(F.array(*map(F.lit, key.default)).cast("array<string>"))
    return F.when(good, v["text"].try_cast("double").cast("int" if key.type == "int" else "double")).otherwise(F.lit(key.default))


def once(df: DataFrame, *cols) -> DataFrame:
    """select() whose results are computed once per row: a generator stands between them and what reads them, so they are not repeated in it."""
    return df.select(F.explode(F.array(F.struct(*cols))).alias("_row")).select("_row.*")


def first_candidates(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("raw").isNotNull()).groupBy("project", "layer").agg(F.min_by("raw", "candidate_rank").alias("raw"))


def merged(raw: DataFrame) -> DataFrame:
    """(project, merged key structs): both layers of each project; one shuffle by project. A global row with a null project is for all."""
    files = first_candidates(raw)
    shared = files.where("layer = 'global' and project is null").select(F.col("raw").alias("_all"))  # first_candidates leaves one row of it
    wide = files.where("project is not null").groupBy("project").agg(F.max(F.when(F.col("layer") == "global", F.col("raw"))).alias("g"), F.max(F.when(F.col("layer") == "project", F.col("raw"))).alias("p"))
    wide = wide.join(F.broadcast(shared), F.lit(True), "left")
    both = wide.select("project", parsed(F.coalesce("g", "_all")).alias("_g"), parsed(F.col("p")).alias("_p"))
    values = once(both, "project", *[c for k in SCHEMA for c in (value(F.col("_g"), k.name).alias(f"g_{k.name}"), value(F.col("_p"), k.name).alias(f"p_{k.name}"))])
    return once(values, "project", *[overlay(k, F.col(f"g_{k.name}"), F.col(f"p_{k.name}")).alias(k.name) for k in SCHEMA])


def effective(raw: DataFrame) -> DataFrame:
    """(project, typed keys): what a reader of the configuration sees."""
    m = merged(raw)
    return m.select("project", *[read(k, F.col(k.name)).alias(k.name) for k in SCHEMA])


def config_errors(raw: DataFrame) -> DataFrame:
    """(project, layer, key, error) of each file's keys; unknown keys are reported, forbidden ones ignored."""
    files = first_candidates(raw).select("project", "layer", F.try_parse_json(strip_comments(F.col("raw"))).alias("v"))
    shape = F.schema_of_variant("v")
    files = files.withColumn("ok", F.coalesce(shape.startswith("OBJECT"), F.lit(False)))
    broken = files.where("not ok").select("project", "layer", F.lit(None).cast("string").alias("key"), F.lit("config must be a JSON object").alias("error"))
    keys = files.where("ok").withColumn("key", F.explode(F.json_object_keys(F.to_json("v")))).where(~F.col("key").isin(*FORBIDDEN))
    error = F.concat(F.lit("'"), F.col("key"), F.lit("' not in schema"))
    for k in SCHEMA:
        error = F.when(F.col("key") == k.name, F.concat(F.lit(f"'{k.name}' "), fault(k, value(F.col("v"), k.name)))).otherwise(error)
    return broken.unionByName(keys.select("project", "layer", "key", error.alias("error")).where("error is not null"))


def factory_gaps(raw: DataFrame) -> DataFrame:
    """(project, key, problem): where a project's file does not state each key at its default; problem missing or differs."""
    files = first_candidates(raw).where("layer = 'project'").select("project", parsed(F.col("raw")).alias("v"))
    pairs = [F.struct(F.lit(k.name).alias("key"), value(F.col("v"), k.name).alias("own"), default_value(k).alias("default")) for k in SCHEMA]
    rows = files.select("project", F.inline(F.array(*pairs)))
    problem = F.when(F.col("own.kind") == "absent", "missing").when(~F.col("own").eqNullSafe(F.col("default")), "differs")
    return rows.select("project", "key", problem.alias("problem")).where("problem is not null")


#: Folders of a project that may hold its file, by rank.
FOLDERS = (".claude", ".agents", ".gemini")


def candidates(root: Column, app: str, group: str) -> Column:
    """Where a project's file may be, by rank: under ``group`` in each of FOLDERS, then the old hidden file in the root."""
    tails = [f"/{d}/{group}/{app}.json" for d in FOLDERS] + [f"/.{app}.json"]
    return F.array(*[F.concat(root, F.lit(tail)) for tail in tails])


def chosen_path(roots: DataFrame, existing: DataFrame, app: str, group: str) -> DataFrame:
    """(project, path, found) for roots(project, root): the first candidate in ``existing(path)``, or the first of all where none is there."""
    ranked = roots.select("project", F.posexplode(candidates(F.col("root"), app, group)).alias("rank", "path"))
    met = ranked.join(existing.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    best = met.groupBy("project").agg(F.min_by("path", F.struct(F.col("there").isNull(), "rank")).alias("path"), F.coalesce(F.bool_or("there"), F.lit(False)).alias("found"))
    return best.select("project", "path", "found")


def global_path(override: Column, home: Column, app: str) -> Column:
    """The machine's own file: in the first folder of a comma-separated override if that is not empty, else in the first of FOLDERS at home."""
    told = F.btrim(F.substring_index(F.coalesce(override, F.lit("")), ",", 1), F.lit(WS))
    return F.concat(F.when(told != "", told).otherwise(F.concat(home, F.lit(f"/{FOLDERS[0]}"))), F.lit(f"/.{app}.json"))


def project_roots(dirs: DataFrame, markers: DataFrame, home: str) -> DataFrame:
    """(start, root): for each start(dir), the nearest folder at or above it that is in ``markers(dir)``, not above home; else itself."""
    parts = F.split("start", "/", -1)
    above = dirs.select("start", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("dir"))
    above = above.where(~F.lit(home).startswith(F.concat(F.col("dir"), F.lit("/"))) & (F.col("dir") != home) & (F.col("dir") != ""))
    hit = above.join(markers.select("dir").distinct(), "dir", "left_semi").groupBy("start").agg(F.max_by("dir", F.length("dir")).alias("root"))
    return dirs.join(hit, "start", "left").select("start", F.coalesce("root", "start").alias("root"))
