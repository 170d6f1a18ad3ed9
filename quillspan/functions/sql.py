"""The library in SQL: md_slug(text), the table function md_parse(text), and findings of a view."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ..operators import checks, nodes
from .jstext import WS_CLASS
from .markdown import FIELDS, flatten

_SCHEMA = T.StructType([T.StructField(f, nodes.field_type(f)) for f in FIELDS])


@udtf(returnType=_SCHEMA)
class ParseMarkdown:
    """A row per node; nothing for null, and nothing for what the scan refuses: texts that are too large, or have a NUL near their start.

    For tables of documents nodes.parse_nodes is the fast way: it works in Arrow batches."""

    def eval(self, text: str) -> Iterator[tuple]:
        if text is not None and not nodes.refused(text):
            yield from flatten(text)


def register(spark: SparkSession) -> None:
    """md_slug is an SQL function of built-in expressions (as slug_col), so it stays in the JVM and is optimised with its query."""
    trimmed = f"regexp_replace(text, r'^[{WS_CLASS}]+|[{WS_CLASS}]+$', '')"
    kept = rf"regexp_replace(lower({trimmed}), r'[^\p{{L}}\p{{M}}\p{{N}}{WS_CLASS}_-]', '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION md_slug(text STRING) RETURNS STRING RETURN regexp_replace({kept}, r'[{WS_CLASS}]', '-')")
    spark.udtf.register("md_parse", ParseMarkdown)


def md_findings(spark: SparkSession, view: str, manifest: str | None = None) -> DataFrame:
    """Findings of a view of (doc_id, text) and maybe path; ``manifest``: a view of (path)."""
    docs = spark.table(view)
    if "path" not in docs.columns:
        docs = docs.withColumn("path", F.lit(None).cast("string"))
    return checks.check_documents(docs, manifest=spark.table(manifest) if manifest else None)
