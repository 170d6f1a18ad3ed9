"""Markdown corpora rendered from the driver's tables, with defects planted by rule, so other engines can tell every finding without parsing.

orders: a document per order with fixed line slots. customers: what orders link to. nations: repeated headings.
The tables have no paths; a rendered document's path doubles as its doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _when(k: Column, step: int, defect: str | Column, good: str | Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(k % step == 0, lit(defect)).otherwise(lit(good))


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, text. Rules and slots are those of FIXTURES.md, section 3.1."""
    orders, items = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    rank = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    rows = items.withColumn("rn", F.row_number().over(rank)).select("l_orderkey", "rn", F.concat(F.lit("| "), F.col("l_partkey").cast("string"), F.lit(" | "), F.col("l_suppkey").cast("string"), F.lit(" | "), F.col("rn").cast("string"), F.when((F.col("l_orderkey") + F.col("rn")) % 5 == 0, " | x |").otherwise(" |")).alias("row"))
    rows = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "row"))), lambda x: x["row"]), "\n").alias("rows"))
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    c = F.col("o_custkey").cast("string")
    lines = [
        F.concat(F.lit("# Order "), key), _when(k, 4, "### Details", "## Details"),
        F.concat(F.lit("Status "), "o_orderstatus", F.lit(" for [customer](../customers/"), c, F.lit(".md#customer-"), _when(k, 6, "x", c), F.lit(").")),
        _when(k, 5, "Jump to [details](#Details).", "Jump to [details](#details)."),
        F.concat(F.lit("See [terms][t"), key, F.lit("].")),
        _when(k, 10, "![](https://img.example/0.png)", F.concat(F.lit("![item](https://img.example/"), key, F.lit(".png)"))),
        F.concat(_when(k, 11, "Source https://example.com/o/", "Source <https://example.com/o/"), key, _when(k, 11, " here.", "> here.")),
        _when(k, 8, "(no terms)", F.concat(F.lit("[t"), key, F.lit("]: https://example.com/t/"), key)),
        _when(k, 9, "[spare]: https://example.com/s", "(none)"),
        F.lit("## Notes"), _when(k, 12, "## Notes", "## More"), _when(k, 14, "# Again", "Text."),
        F.concat(F.lit("| part | supplier | n |\n| --- | --- | --- |\n"), F.coalesce("rows", F.lit(""))),
    ]
    # the table begins on line 25, so its slot has no blank line before it but that of line 24
    docs = orders.join(rows, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    path = F.concat(F.lit("/corpus/orders/"), key, F.lit(".md"))
    return docs.select(path.alias("doc_id"), path.alias("path"), F.concat(F.array_join(F.array(*lines), "\n\n"), F.lit("\n")).alias("text"))


def customer_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey").cast("string")
    path = F.concat(F.lit("/corpus/customers/"), c, F.lit(".md"))
    return _table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(path.alias("doc_id"), path.alias("path"), F.concat(F.lit("# Customer "), c, F.lit("\n")).alias("text"))


def nation_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_mktsegment"))).alias("cs"))
    body = F.array_join(F.transform("cs", lambda x: F.concat(F.lit("## "), x["c_mktsegment"], F.lit("\n"))), "\n")
    path = F.concat(F.lit("/corpus/nations/"), F.col("n_nationkey").cast("string"), F.lit(".md"))
    docs = _table(spark, sf_dir, "nation").join(parts, F.col("n_nationkey") == F.col("c_nationkey"))
    return docs.select(path.alias("doc_id"), path.alias("path"), F.concat(F.lit("# "), "n_name", F.lit("\n\n"), body).alias("text"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_docs(spark, sf_dir).unionByName(customer_docs(spark, sf_dir))


def manifest_of(docs: DataFrame) -> DataFrame:
    """(path, is_dir): the documents and every folder above them. Folders are made distinct before they are exploded further."""
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    dirs = docs.where("path is not null").select(folder.alias("dir")).distinct()
    parts = F.split("dir", "/", -1)
    above = dirs.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("path"))
    above = above.select(F.when(F.col("path") == "", "/").otherwise(F.col("path")).alias("path"), F.lit(True).alias("is_dir")).distinct()
    return docs.where("path is not null").select("path", F.lit(False).alias("is_dir")).unionByName(above)
