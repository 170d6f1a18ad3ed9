import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def same_as_sql(spark):
    """Rows of a query against its SQL in DuckDB on the same tables, without regard to order."""
    duckdb = pytest.importorskip("duckdb")

    def check(query, sql, sf_dir=SF):
        con = duckdb.connect()
        for name in os.listdir(sf_dir):
            con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
        want = con.sql(sql)
        columns = sorted(want.columns)
        frame = query(spark, sf_dir)
        assert sorted(frame.columns) == columns
        key = lambda row: tuple(round(x, 9) if isinstance(x, float) else x for x in row)
        got = sorted((key(r) for r in frame.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
        expected = sorted((key(r) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
        assert got, "an empty result proves nothing"
        assert got == expected

    return check
