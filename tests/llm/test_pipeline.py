import zlib

import corpus_pipeline
from quillspan.llm import decontaminate, order_minhash
from quillspan.llm.base import table

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
    columns = table(spark, SF, "documents").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert all(seen[n].columns == columns for n in list(seen)[:-1]) and seen["sharding"].columns == [*columns, "shard", "slot"]
    first = {r.doc_id for r in table(spark, SF, "documents").collect()}
    assert {r.doc_id for r in seen["toxicity"].collect()} <= first
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and seen["toxicity"].count() > 0.7 * len(first)
    texts = [r.text for r in seen["near_duplicates"].collect()]
    assert len(texts) == len(set(texts))
    assert order_minhash.near_duplicates(seen["near_duplicates"]).select("class_id").distinct().count() == len(texts)
    left = decontaminate.find_items(seen["decontamination"], table(spark, SF, "benchmark"))
    assert left.where("size(_spans) > 0").count() == 0
    assert seen["decontamination"].count() == decontaminate.find_items(seen["near_duplicates"], table(spark, SF, "benchmark")).where("size(_spans) = 0").count()
    assert seen["sharding"].count() == seen["mixing"].count() > 0
    counts = [r["count"] for r in seen["sharding"].groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1


def test_shards_do_not_depend_on_how_files_are_split(spark, tmp_path):
    spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id % 3000) AS text").repartition(16).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    dealt = corpus_pipeline.deal_shards(spark, docs, SF)
    name = "spark.sql.files.maxPartitionBytes"
    told = spark.conf.get(name)
    spark.conf.set(name, "4k")  # as executors that come or go change the splits between two plans
    try:
        rows = dealt.collect()
    finally:
        spark.conf.set(name, told)
    assert sorted(r.doc_id for r in rows) == list(range(4000))
    assert len({(r.shard, r.slot) for r in rows}) == 4000
