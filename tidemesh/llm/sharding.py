"""Sharding by jump consistent hashing: stable keys go to shards without a ring table.

Adding a shard moves only the rows that the new shard takes. All work is DataFrame functions on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemesh.llm.common import saved, table


def jump_shard(key: Column, n_shards: int) -> Column:
    """The shard, 0 to n_shards - 1, of a key.

    The walk of jump consistent hashing: from bucket b the next jump lands on floor((b + 1) / u), with u uniform in
    (0, 1] and drawn from (key, b) alone; the last bucket below n_shards is the shard. A jump moves forward by one at
    least, so n_shards steps always suffice. A null key is a key like any other.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))

    def step(state: Column, _: Column) -> Column:
        inside = state["next"] < n_shards
        at = F.when(inside, state["next"]).otherwise(state["at"])
        draw = (F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0null")), at), 33) + 1) / F.lit(float(1 << 31))
        return F.struct(at.alias("at"), F.when(inside, F.floor((at + 1) / draw)).otherwise(state["next"]).alias("next"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n_shards)), start, step, lambda s: s["at"]).cast("int")


def shard_documents(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    size: UTF-8 bytes plus 16, 16 for a null text; text_crc32: 0 for a null or empty text. Repeated rows stay rows of
    their own and share a shard. Slots count a shard's rows from 0 without gaps: each input partition numbers its own
    rows of a shard, after the rows of the partitions before it, so no shard is ever gathered in one task. An empty
    table gives no rows; other columns are not read.
    """
    octets = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(octets) + 16).cast("long").alias("size"),
        F.crc32(octets).alias("text_crc32"),
        jump_shard(F.col(key), n_shards).alias("shard"),
        jump_shard(F.col(key), n_shards + 1).alias("grown_shard"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("nth"),
    )
    rows = saved(rows, "shards")
    lot = F.shiftright(F.col("nth").bitwiseAND((1 << 33) - 1), 13)  # a large partition counts in lots of 8,192 rows
    rows = rows.withColumn("lot", lot)
    counts = rows.groupBy("part", "lot", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part", "lot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "lot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part", "lot", "shard").orderBy("nth")
    return rows.join(starts, ["part", "lot", "shard"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.row_number().over(inside) - 1).cast("long").alias("slot"),
        "grown_shard",
    )


def op5_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 40)
