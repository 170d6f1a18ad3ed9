"""Line dedup: drop lines that many documents share.

Method: explode normalised lines, hash them, count distinct documents per hash, drop lines over the threshold, and
reassemble by position. Native Spark expressions throughout.

Defined cases: a null or empty text is one empty line. A null doc_id counts as one document that is below all others.
Rows that repeat a doc_id count once for it, and each loses lines by its own text. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import fingerprint, settle, table, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "\t\n\x0b\x0c\r "


def line_key(line: Column) -> Column:
    """ASCII blanks stripped at both ends, A-Z lowered. lower() is used where it cannot touch anything else."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def drop_repeated_lines(docs: DataFrame, *, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, kept_text, n_lines, n_dropped): a line whose key is in ``min_docs`` documents or more stays only in the largest doc_id.

    Only hashes, ids and positions are exploded and shuffled. Counting is in two levels, (key, doc) then (key), so
    a line that a third of all documents hold is pre-aggregated; the join back to the lines can be split by AQE.
    The texts are shuffled once, to meet their dropped positions.
    """
    base = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    h1, h2 = fingerprint(F.col("_text"))
    keys = F.transform(F.split("_text", "\n", -1), lambda line: line_key(line))
    keyed = base.select("_id", h1.alias("_t1"), h2.alias("_t2"), F.posexplode(keys).alias("_pos", "_key")).where(F.char_length("_key") >= min_chars)
    k1, k2 = fingerprint(F.col("_key"))
    lines = settle(keyed.select("_id", "_t1", "_t2", "_pos", k1.alias("_k1"), k2.alias("_k2")))

    shared = settle(
        lines.groupBy("_k1", "_k2", "_id").agg(F.lit(1).alias("_one"))
        .groupBy("_k1", "_k2").agg(F.count("*").alias("_docs"), F.max("_id").alias("_last"))
        .where(F.col("_docs") >= min_docs).select("_k1", "_k2", "_last")
    )
    dropped = (
        lines.join(shared, ["_k1", "_k2"]).where(~F.col("_id").eqNullSafe(F.col("_last")))
        .groupBy("_id", "_t1", "_t2").agg(F.collect_set("_pos").alias("_gone"))
        .select(F.col("_id").alias("_did"), F.col("_t1").alias("_d1"), F.col("_t2").alias("_d2"), "_gone")
    )
    marked = base.withColumn("_t1", h1).withColumn("_t2", h2)
    met = marked.join(dropped, (F.col("_t1") == F.col("_d1")) & (F.col("_t2") == F.col("_d2")) & F.col("_id").eqNullSafe(F.col("_did")), "left")
    split = met.select("_id", "_text", F.split("_text", "\n", -1).alias("_lines"), "_gone")
    kept = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone")), lambda i: F.element_at("_lines", i + 1)), "\n")
    )
    return split.select(
        F.col("_id").alias("doc_id"), F.col("_text").alias("text"), kept.alias("kept_text"),
        F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), shared AS (
  SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.pos, l.line, s.k IS NOT NULL AND l.doc_id <> s.last AS gone FROM lines l LEFT JOIN shared s ON l.k = s.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
