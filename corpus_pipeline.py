"""From raw documents to balanced training shards: each stage is one of the operators, written as Parquet and read again.

Stages: documents that the toxicity classifier rejects go; one document of each near-duplicate class stays; documents with a
passage of the benchmark go; sources are mixed to their target weights by Poisson replication; rows are dealt to shards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import decontaminate, mixing, order_minhash, sharding, toxicity
from quillspan.llm.base import fresh_path, table

#: No stage but the mixing can be said in SQL: the first learns, the second samples hashes, the last iterates.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under their language's threshold. It learns from the labelled documents of its input outside the held-out fold."""
    classifier = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), keep=toxicity.fold(F.col("_id")) != 2)
    scored = toxicity.score_texts(docs, classifier)
    return scored.where(F.col("_score") < toxicity.threshold_of(F.col("lang"), classifier)).drop("_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"), carry=tuple(docs.columns))
    return found.where(F.size("_spans") == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated as drawn, shuffled."""
    return mixing.poisson_mix(docs, mixing.source_rates(docs)).select(*docs.columns)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with shard and slot. Rows are numbered once and written down: a second scan may split the files, so number the rows, otherwise."""
    path = fresh_path(spark, "pipeline-rows")
    docs.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    numbered = spark.read.parquet(path)
    dealt = sharding.shard_rows(numbered, row_col="_row").select("_row", "shard", "slot")
    return numbered.join(dealt, "_row").select(*docs.columns, "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
