"""Files in and reports out: documents by path or pattern, unreadable ones kept apart, findings as JSON or text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.sessions import DOC_EXTENSIONS, extension

MARKDOWN_EXTENSIONS = (".md", ".mdx", ".markdown")


def read_documents(spark: SparkSession, paths: str | list[str], *, extensions: tuple[str, ...] | None = DOC_EXTENSIONS, recursive: bool = True) -> DataFrame:
    """(doc_id, path, text) of files; invalid UTF-8 becomes replacement characters. The extension filter is on paths, before any read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(paths)
    path = F.regexp_replace("path", "^file:/*", "/")
    rows = found.select(path.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    if extensions is not None:
        rows = rows.where(extension(F.element_at(F.split("path", "/", -1), -1)).isin(*extensions))
    return rows.select(F.col("path").alias("doc_id"), "path", "text")


def read_listed(spark: SparkSession, paths: list[str], **options) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of a list of files: what cannot be read is a row (path, error), and the rest of the scan goes on.

    Paths that are not there are told apart before the read, which would fail as a whole; files that fail while they are read are skipped by it."""
    files, system = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    listed = spark.createDataFrame([(p.removeprefix("file:"),) for p in paths], "path string")
    there = [p for p in paths if files(p).getFileSystem(system).exists(files(p))]
    docs = read_documents(spark, there, **options) if there else spark.createDataFrame([], "doc_id string, path string, text string")
    return docs, unreadable(listed, docs)


#: The numbers of documents beyond which a scan asks first, by what it covers.
ASK_BEYOND = {"semantic": 20, "structure": 50}


def scope_questions(scopes: DataFrame) -> DataFrame:
    """(scope, kind, documents, ask) of scopes(scope, kind, doc_id): whether a scan of that many documents asks first."""
    limit = F.create_map(*[F.lit(x) for pair in ASK_BEYOND.items() for x in pair])[F.col("kind")]
    return scopes.groupBy("scope", "kind").agg(F.countDistinct("doc_id").alias("documents")).withColumn("ask", F.col("documents") > limit)


def touched(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(sid, doc_id, path, text): the documents that a session has edited, of edits(sid, what, path) as sessions.classify gives them."""
    return edits.where("what = 'doc'").select("sid", "path").distinct().join(docs.select("doc_id", "path", "text"), "path")


def copy_plan(tree: DataFrame, target: str, *, exclude: str | None = None) -> DataFrame:
    """(rel_path, to_path, bytes): what a copy of tree(rel_path, content) would write. A plan only: files are copied by file systems, not by Spark."""
    rows = tree.where(~F.col("rel_path").rlike(exclude)) if exclude else tree
    return rows.select("rel_path", F.concat(F.lit(target.rstrip("/") + "/"), "rel_path").alias("to_path"), F.octet_length("content").cast("long").alias("bytes"))


def unreadable(listed: DataFrame, docs: DataFrame) -> DataFrame:
    """The paths of ``listed(path)`` that were not read, with a message each; the rest of a scan goes on."""
    return listed.join(docs.select("path"), "path", "left_anti").select("path", F.concat(F.lit("FAIL "), "path", F.lit(": not readable")).alias("error"))


def file_tree(spark: SparkSession, root: str, *, exclude: str | None = None) -> DataFrame:
    """(rel_path, content) of all files under a folder, without those whose relative path matches ``exclude``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = F.lit(root.rstrip("/") + "/")
    rel = F.substr(F.regexp_replace("path", "^file:/*", "/"), F.char_length(prefix) + 1)
    rows = found.select(rel.alias("rel_path"), "content")
    return rows.where(~F.col("rel_path").rlike(exclude)) if exclude else rows


def file_reports(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """(file, findings): a row per document with its findings in order; one shuffle by doc_id."""
    item = F.struct("seq", "check", "line", "column", "message", "suspected")
    lists = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("_f"))
    met = docs.select("doc_id", F.coalesce("path", F.col("doc_id").cast("string")).alias("file")).join(lists, "doc_id", "left")
    return met.select("file", F.coalesce(F.transform("_f", lambda x: x.dropFields("seq")), F.expr("cast(array() as array<struct<check:string,line:int,column:int,message:string,suspected:boolean>>)")).alias("findings"))


def json_reports(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """(file, value): a document's report as JSON; ``suspected`` appears only where it is set."""
    return file_reports(docs, findings).select("file", F.to_json(F.struct("file", "findings")).alias("value"))


def text_lines(findings: DataFrame) -> DataFrame:
    """(doc_id, seq, value): file:line:column [check] message."""
    return findings.select("doc_id", "seq", F.format_string("%s:%d:%d [%s] %s", F.col("doc_id").cast("string"), "line", "column", "check", "message").alias("value"))


def summary(docs: DataFrame, findings: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(findings, files, value): the totals; files that could not be read count as files."""
    files = docs.select("doc_id").agg(F.count("*").alias("files"))
    if failed is not None:
        files = files.crossJoin(failed.agg(F.count("*").alias("bad"))).select((F.col("files") + F.col("bad")).alias("files"))  # a row each
    both = findings.agg(F.count("*").alias("findings")).crossJoin(files)
    return both.withColumn("value", F.format_string("%d finding(s) across %d file(s)", "findings", "files"))
