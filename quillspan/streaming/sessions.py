"""Session events as a keyed stream: documents edited, the record kept, and a note at a stop when one lacks the other.

Events are JSON payloads of several shapes with a sequence number. A session's state is a map of edited documents, emptied by
each stop, and a flag for an edit of the record file, never emptied. Within a micro-batch rows are put in order of sequence.
Malformed payloads, ids outside [A-Za-z0-9_-]+, edits under the temporary folder and re-entrant stops are no events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.jstext import WS, resolve_path_col

#: Fixed values.
DOC_EXTENSIONS = (".md", ".mdx", ".markdown", ".rst", ".txt", ".adoc", ".asciidoc", ".org")
RECORD = "memory.md"
NOTE = "Documentation changed in this session, but its record file was not updated. Update it before you end, or report the drift if it is not yours to write."
BAGS = ("tool_input", "toolInput", "toolCall.args")
NAMES = ("file_path", "filePath", "path", "filename", "file")


def text_at(payload: Column, path: str) -> Column:
    """A non-empty JSON string at a path; other types are null."""
    v = F.variant_get(payload, path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.nullif(F.variant_get(v, "$", "string"), F.lit("")))


def edited_path(payload: Column) -> Column:
    return F.coalesce(*[text_at(payload, f"$.{bag}.{name}") for bag in BAGS for name in NAMES])


def session_id(payload: Column) -> Column:
    return F.coalesce(*[text_at(payload, f"$.{k}") for k in ("conversationId", "session_id", "sessionId")])


def workspace(payload: Column, default: str) -> Column:
    return F.coalesce(text_at(payload, "$.workspacePaths[0]"), text_at(payload, "$.cwd"), F.lit(default))


def extension(name: Column) -> Column:
    """From the last dot of a base name, lower case; none for a name whose only dot is its first character."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))


def classify(events: DataFrame, *, temp_dir: str = "/tmp", cwd: str = "/") -> DataFrame:
    """``events(seq, kind, payload)`` to (sid, seq, what, path): what is doc, record or stop; other events are left out."""
    v = F.try_parse_json(F.btrim("payload", F.lit(WS)))
    e = events.withColumn("_v", v).where("_v is not null").withColumn("sid", session_id(F.col("_v"))).where(F.col("sid").rlike(r"^[A-Za-z0-9_-]+\z"))
    edit = e.withColumn("_e", F.when(F.col("kind") == "edit", edited_path(F.col("_v")))).withColumn("_w", workspace(F.col("_v"), cwd))
    # a generator between, so that the searches of the payload are not repeated wherever their results are read
    edit = edit.select(F.explode(F.array(F.struct("sid", "seq", "kind", "_v", "_e", "_w"))).alias("_r")).select("_r.*")
    edit = edit.select("sid", "seq", "kind", "_v", F.explode(F.array(F.when(F.col("_e").isNotNull(), resolve_path_col(F.col("_w"), F.col("_e"))))).alias("path"))
    name = F.element_at(F.split("path", "/", -1), -1)
    under = (F.col("path") == temp_dir) | F.col("path").startswith(temp_dir + "/")
    active = F.variant_get("_v", "$.stop_hook_active", "variant")
    truthy = active.isNotNull() & ~F.is_variant_null(active) & ~F.coalesce(F.variant_get(active, "$", "string"), F.lit("x")).isin("false", "0", "")
    what = (
        F.when((F.col("kind") == "stop") & ~truthy, "stop").when(F.col("path").isNull() | under, None)
        .when(F.lower(name) == RECORD, "record").when(extension(name).isin(*DOC_EXTENSIONS), "doc")
    )
    return edit.withColumn("what", what).where("what is not null").select("sid", "seq", "what", "path")


class Sessions(StatefulProcessor):
    """Emits a row per stop that closes a batch of edits: drift says whether the note is due, docs how many were edited.

    ttl_ms: how long state of a session that is not heard of is kept; None: for ever."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        path, seq, yes = (T.StructType([T.StructField(n, t)]) for n, t in (("path", T.StringType()), ("seq", T.LongType()), ("yes", T.BooleanType())))
        self.docs = handle.getMapState("docs", path, seq, self.ttl_ms)
        self.recorded = handle.getValueState("recorded", yes, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        docs = {k[0] for k in self.docs.keys()}
        recorded, new, cleared, out = bool(self.recorded.exists()), {}, False, []
        for seq, what, path in zip(events["seq"], events["what"], events["path"], strict=True):
            if what == "record":
                recorded = True
            elif what == "doc":
                if path not in docs:
                    docs.add(path)
                    new[path] = int(seq)
            elif docs:
                out.append((key[0], int(seq), not recorded, len(docs)))
                docs, new, cleared = set(), {}, True
        if cleared:
            self.docs.clear()
        for path, seq in new.items():
            self.docs.updateValue((path,), (seq,))
        if recorded and not self.recorded.exists():
            self.recorded.update((True,))
        yield pd.DataFrame(out, columns=["sid", "seq", "drift", "docs"])

    def close(self) -> None:
        pass


OUTPUT = "sid string, seq long, drift boolean, docs long"


def track(classified: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The stream of stops of a classified stream of events, on the RocksDB state store."""
    classified.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return classified.groupBy("sid").transformWithStateInPandas(statefulProcessor=Sessions(ttl_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="None" if ttl_ms is None else "ProcessingTime")


def responses(stops: DataFrame, settings: DataFrame | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """What is printed at a stop: {} or a message; nothing where the settings silence it, though the stop has closed its batch all the same.

    ``settings``: effective configuration by project; ``sessions(sid, project, keeps_record)``. Without them all are on."""
    if sessions is not None:
        stops = stops.join(sessions, "sid", "left")
    if settings is not None:
        loud = settings.where("suiteMode <> 'off' and docsDriftNudge and not array_contains(disabledCanaries, 'all')")
        stops = stops.join(loud.select("project"), "project", "left_semi")
    keeps = F.coalesce("keeps_record", F.lit(True)) if "keeps_record" in stops.columns else F.lit(True)
    body = F.when(F.col("drift") & keeps, F.to_json(F.struct(F.lit(NOTE).alias("systemMessage")))).otherwise("{}")
    return stops.withColumn("output", body)


def injected(lines: DataFrame) -> DataFrame:
    """(project, output) of lines(project, rank, line): the lines of a session's start as one injected step; projects without a line print nothing."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n")
    rows = lines.where("line is not null").groupBy("project").agg(text.alias("text"))
    return rows.select("project", F.to_json(F.struct(F.array(F.struct(F.col("text").alias("ephemeralMessage"))).alias("injectSteps"))).alias("output"))


def write_responses(outputs: DataFrame, path: str, checkpoint: str):
    """The stream of outputs as text files, a line each: the query, started on what there is."""
    return outputs.select(F.col("output").alias("value")).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def replay(classified: DataFrame) -> DataFrame:
    """The same stops from a finished log, by windows: a stop counts if a document was edited since the stop before."""
    from pyspark.sql import Window

    order = Window.partitionBy("sid").orderBy("seq")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    e = classified.withColumn("batch", F.coalesce(F.sum(F.when(F.col("what") == "stop", 1).otherwise(0)).over(past), F.lit(0)))
    e = e.withColumn("recorded", F.max((F.col("what") == "record").cast("int")).over(order))
    docs = e.groupBy("sid", "batch").agg(F.countDistinct(F.when(F.col("what") == "doc", F.col("path"))).alias("docs"), F.max(F.when(F.col("what") == "stop", F.struct("seq", "recorded"))).alias("stop"))
    return docs.where("docs > 0 and stop is not null").select("sid", F.col("stop.seq").alias("seq"), (F.col("stop.recorded") == 0).alias("drift"), "docs")


def once_per_session(events: DataFrame) -> DataFrame:
    """The first event of each session key: conversation id, session id or transcript path, hashed; events without a key are dropped."""
    v = F.try_parse_json("payload")
    keys = ("conversationId", "session_id", "sessionId", "transcript_path", "transcriptPath")
    keyed = events.withColumn("_v", v).withColumn("session_key", hash_key(F.coalesce(*[text_at(F.col("_v"), f"$.{k}") for k in keys]))).where("session_key is not null").drop("_v")
    return keyed.dropDuplicates(["session_key"])


def hash_key(text: Column) -> Column:
    """A short name for any text: h = 33 h + unit over UTF-16 units from 5381, modulo 2^32, in base 36."""
    units = F.hex(F.encode(text, "UTF-16BE"))
    steps = F.sequence(F.lit(0), (F.char_length(units) / 4 - 1).cast("int"))
    code = lambda i: F.conv(F.substr(units, (i * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("long")
    hashed = F.aggregate(steps, F.lit(5381).cast("long"), lambda h, i: F.pmod(h * 33 + code(i), F.lit(1 << 32)))
    return F.when(text.isNull() | (text == ""), F.lit(None)).otherwise(F.lower(F.conv(hashed.cast("string"), 10, 36)))


class UpdateChecks(StatefulProcessor):
    """Emits the starts at which an update check is due: none yet, or the last as old as the settings ask. A check that fires moves the stamp first.

    State: one number per machine. ``old_ms`` of a row is a stamp from before this state was kept; it counts until a stamp is here."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stamp = handle.getValueState("stamp", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, out = self.stamp.get()[0] if self.stamp.exists() else None, []
        kept = last
        for part in sorted_parts(rows):
            for now, days, old in zip(part["ts_ms"], part["updateCheckDays"], part["old_ms"], strict=True):
                known = last if last is not None else None if pd.isna(old) else int(old)
                if not known or now - known >= days * DAY_MS:
                    last = int(now)
                    out.append((key[0], last))
        if last is not None and last != kept:
            self.stamp.update((last,))
        yield pd.DataFrame(out, columns=["machine", "ts_ms"])

    def close(self) -> None:
        pass


DAY_MS = 86_400_000


def sorted_parts(rows: Iterator[pd.DataFrame]) -> list[pd.DataFrame]:
    """A key's rows of one micro-batch in order of time; three numbers each."""
    return [pd.concat(list(rows)).sort_values("ts_ms", kind="stable")]


def asking(starts: DataFrame, settings: DataFrame) -> DataFrame:
    """starts(machine, ts_ms, project, and maybe old_ms) of projects that want updates and offer anything at their start."""
    on = settings.where("updateMode <> 'off'")
    if {"suiteMode", "disabledCanaries"} <= set(settings.columns):
        on = on.where("suiteMode <> 'off' and not arrays_overlap(disabledCanaries, array('conductor', 'all'))")
    s = starts if "old_ms" in starts.columns else starts.withColumn("old_ms", F.lit(None).cast("long"))
    return s.join(on.select("project", F.col("updateCheckDays").cast("long").alias("updateCheckDays")), "project").select("machine", "ts_ms", "updateCheckDays", "old_ms")


def track_updates(asked: DataFrame) -> DataFrame:
    """(machine, ts_ms) of the stream of ``asking`` rows at which a check fires, on keyed state."""
    asked.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return asked.groupBy("machine").transformWithStateInPandas(statefulProcessor=UpdateChecks(), outputStructType="machine string, ts_ms long", outputMode="Append", timeMode="None")


def due_updates(starts: DataFrame, settings: DataFrame) -> DataFrame:
    """The same from a finished log of starts: a sorted pass over a machine's starts that remembers one number, in Arrow batches. No array of a machine's history is made."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, last = None, None
        for batch in batches:
            out = []
            for m, now, days, old in zip(batch["machine"], batch["ts_ms"], batch["updateCheckDays"], batch["old_ms"], strict=True):
                if m != machine:
                    machine, last = m, None
                known = last if last is not None else None if pd.isna(old) else int(old)
                if not known or now - known >= days * DAY_MS:
                    last = int(now)
                    out.append((m, last))
            yield pd.DataFrame(out, columns=["machine", "ts_ms"])

    return asking(starts, settings).repartition("machine").sortWithinPartitions("machine", "ts_ms").mapInPandas(run, "machine string, ts_ms long")


def last_stamps(fired: DataFrame) -> DataFrame:
    return fired.groupBy("machine").agg(F.max("ts_ms").alias("last_ms"))
