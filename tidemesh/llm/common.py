"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc
import re
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The URI of the folder that the cluster shares: spark.checkpoint.dir, or the context's checkpoint folder. One must be
    set; a path without a scheme is on the cluster's default file system, as Spark itself takes it."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = context._jvm.org.apache.hadoop.fs.Path(found)
    whole = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", whole)


#: Folders of the tables that are deleted where the innermost open scratch ends; None outside of any.
_made: ContextVar[list[str] | None] = ContextVar("_made", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are saved inside are deleted at its end, but for those to keep; nothing that is used later may read them."""
    paths: list[str] = []
    outer = _made.set(paths)
    try:
        yield
    finally:
        _made.reset(outer)
        delete(spark, *paths)
        swept(spark)


def swept(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffles of frames that are gone; twice, as Python tells the JVM of them meanwhile."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.java.lang.System.gc()
        time.sleep(0.2)


def delete(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of the shared folder, on whatever file system it is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def place(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A new folder's path for a table; without keep it is deleted where the innermost open scratch ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not keep and (made := _made.get()) is not None:
        made.append(path)
    return path


def saved(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """df written once as a table in the shared folder and read again: it cuts the lineage and survives lost executors.

    With keep, or outside of a scratch, the table stays until the folder is cleared, as returned frames may read it.
    """
    path = place(df.sparkSession, label, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 256, size: str = "16m") -> None:
    """Bounds the rows and bytes of an Arrow batch, as single texts can be very long.

    Spark has these as settings of a session only, read when a query starts, so they stay for its later queries.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def buckets_for(rows: int, per_bucket: int = 20_000) -> int:
    """A power of two of buckets that hold about per_bucket rows each, 4096 at most times what rows need."""
    n = 1
    while n * per_bucket < rows:
        n *= 2
    return n


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
