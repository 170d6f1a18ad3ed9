"""Tables that several queries read, written once to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, what: str) -> str:
    """A path that nothing has used, in the folder of spark.checkpoint.dir; in a temporary folder only where that is unset, as in tests."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.gettempdir()}"
    path = f"{told.rstrip('/')}/quillspan-{what}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def settled(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` as Parquet, read back: survives lost executors, is computed once, and later readers prune its columns and row groups."""
    path = shared_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes what this application has settled; results that read it must have been used by then."""
    context = spark.sparkContext
    for path in _WRITTEN.pop(context.applicationId, []):
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
