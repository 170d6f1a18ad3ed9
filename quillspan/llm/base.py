"""What the operators of this subpackage share.

Conventions that hold for all of them:

* input columns are copied to private names first, so extra columns of any name do no harm;
* a null text is the empty text;
* a document is a row. Rows that repeat a doc_id are judged each by its own text;
* intermediate tables that are read twice go through ``settle``.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; one of our own only where that is unset."""
    context = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not told:
        jvm_dir = context._jsc.sc().getCheckpointDir()
        told = jvm_dir.get() if jvm_dir.isDefined() else None
    if not told:
        told = tempfile.mkdtemp(prefix="quillspan-shared-")
        atexit.register(shutil.rmtree, told, True)
        context.setCheckpointDir(told)
    elif not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(told)
    return told


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and cut its lineage there: survives lost executors, never recomputed."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files and checkpoints that nothing refers to any more, rather than when the driver's heap happens to fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fingerprint(*cols: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds: 128 bits, enough to stand for a text among 10^15."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)]


def u52(*parts: Column) -> Column:
    """A fraction in [0, 1) with 52 bits from md5, the same in other SQL engines."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


#: Rows that go to Python at once. Texts may be very long: few rows bound a batch's memory.
ROWS_PER_BATCH = 400


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ROWS_PER_BATCH rows at most, for this session's later queries too; a smaller setting is kept."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    told = int(spark.conf.get(name, "10000"))
    if told <= 0 or told > ROWS_PER_BATCH:
        spark.conf.set(name, str(ROWS_PER_BATCH))
