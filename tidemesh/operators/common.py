"""What several operators share: tables in the shared folder that cut the lineage of driver rounds."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir)."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once to the cluster's shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_scene(df: DataFrame) -> DataFrame:
    """df dealt by scene: steps keyed by scene and more need no other shuffle, nor do joins with what is dealt alike.

    The partitions are as many as spark.sql.shuffle.partitions says, and aren't merged by their bytes, which say nothing
    of the pixels that are made of their rows. Joins of pixels carry merge hints as well, for the same reason.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "scene_id")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]
