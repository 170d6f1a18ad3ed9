from quillspan.functions import sql


def test_sql_surface(spark):
    sql.register(spark)
    spark.createDataFrame([("a", "# T x\n\n# U"), ("b", None)], "doc_id string, text string").createOrReplaceTempView("md_docs")
    assert spark.sql("SELECT md_slug('A b!') AS s").first().s == "a-b"
    got = spark.sql("SELECT d.doc_id, n.type, n.start_line FROM md_docs d, LATERAL md_parse(d.text) n WHERE n.type = 'heading' ORDER BY 3").collect()
    assert [tuple(r) for r in got] == [("a", "heading", 1), ("a", "heading", 3)]
    assert [r.check for r in sql.md_findings(spark, "md_docs").collect()] == ["heading-multiple-h1"]
