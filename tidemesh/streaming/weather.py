"""The weather feed as a stream: cleaned, without repeats, as hourly means and newest readings per site."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemesh.operators.weather import FIELDS, sanitise


def clean_feed(feed: DataFrame, late: str = "2 hours") -> DataFrame:
    """The feed (site_id, obs_ts, FIELDS) sanitised; a site's repeated reading counts once within the watermark."""
    return sanitise(feed.withWatermark("obs_ts", late).dropDuplicatesWithinWatermark(["site_id", "obs_ts"]))


def hourly_feed(feed: DataFrame, late: str = "2 hours") -> DataFrame:
    """site_id, hour_start, n, the hour's means and its newest reading, told once the watermark has passed the hour.

    Readings that come later than the watermark allows are dropped.
    """
    grouped = clean_feed(feed, late).groupBy(F.window("obs_ts", "1 hour").alias("w"), "site_id")
    newest = F.max_by(F.struct(*FIELDS), F.struct("obs_ts", *FIELDS)).alias("newest")
    return grouped.agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in FIELDS), newest).select("site_id", F.col("w.start").alias("hour_start"), "n", *FIELDS, "newest")


SITES = "site_id long, newest_ts timestamp, precipitation double, wind_speed_10m double, wind_direction_10m double, n long, late long, repeated long"


def fold_batch(rows: DataFrame, k: int, folder: str, late: str) -> None:
    """Takes micro-batch k of the feed into the tables under folder (see replay).

    It reads what batch k - 1 left and overwrites only its own tables, so a batch that failed midway can be run again.
    """
    spark = rows.sparkSession
    was, now = (lambda name: f"{folder}/{name}-{(k - 1) % 2}"), (lambda name: f"{folder}/{name}-{k % 2}")
    put = lambda df, path: df.write.mode("overwrite").parquet(path)
    sites = spark.read.schema(SITES).parquet(was("sites")) if k else spark.createDataFrame([], SITES)
    recent = spark.read.parquet(was("recent")) if k else spark.createDataFrame([], "site_id long, obs_ts timestamp")
    edge = F.col("newest_ts") - F.expr(f"INTERVAL {late}")

    clean = sanitise(rows.where("site_id IS NOT NULL AND obs_ts IS NOT NULL").select(F.col("site_id").cast("long").alias("site_id"), "obs_ts", *FIELDS))
    told = clean.join(sites.select("site_id", "newest_ts"), "site_id", "left").withColumn("_late", F.coalesce(F.col("obs_ts") < edge, F.lit(False)))
    put(told.select("site_id", "obs_ts", F.struct(*FIELDS).alias("r"), "_late"), now("batch"))
    told = spark.read.parquet(now("batch"))
    once = told.where("NOT _late").groupBy("site_id", "obs_ts").agg(F.min("r").alias("r"))
    put(once.join(recent, ["site_id", "obs_ts"], "left_anti").select("site_id", "obs_ts", "r"), now("fresh"))
    fresh = spark.read.parquet(now("fresh"))
    put(fresh.groupBy("site_id", F.date_trunc("hour", "obs_ts").alias("hour_start")).agg(F.count("*").alias("n"), *(F.sum(f"r.{c}").alias(c) for c in FIELDS)), f"{folder}/hours/batch={k}")

    came = told.groupBy("site_id").agg(F.count("*").alias("_all"), F.count_if("_late").alias("_l"))
    new = fresh.groupBy("site_id").agg(F.count("*").alias("_n"), F.max(F.struct("obs_ts", "r")).alias("_b"))
    both = sites.join(came.join(new, "site_id", "left"), "site_id", "full").na.fill(0, ["n", "late", "repeated", "_all", "_l", "_n"])
    newer = F.coalesce(F.col("_b.obs_ts") > F.col("newest_ts"), F.col("_b").isNotNull())
    value = lambda c, b: F.when(newer, F.col(b)).otherwise(F.col(c)).alias(c)
    put(both.select("site_id", value("newest_ts", "_b.obs_ts"), *(value(c, f"_b.r.{c}") for c in FIELDS), (F.col("n") + F.col("_n")).alias("n"), (F.col("late") + F.col("_l")).alias("late"), (F.col("repeated") + F.col("_all") - F.col("_l") - F.col("_n")).alias("repeated"), F.lit(k).cast("long").alias("batch")), now("sites"))
    kept = recent.union(fresh.select("site_id", "obs_ts")).join(spark.read.schema(SITES).parquet(now("sites")).select("site_id", "newest_ts"), "site_id")
    put(kept.where(F.col("obs_ts") >= edge).select("site_id", "obs_ts"), now("recent"))


def replay(feed: DataFrame, folder: str, late: str = "2 hours") -> None:
    """Takes all files that a streaming feed (site_id, obs_ts, FIELDS) has into tables under folder, then ends.

    The next call goes on with files that came since, or with the batch that failed. Readings more than late older than
    their site's newest of earlier batches are counted as late and left out; of readings of one site and time the first
    batch's counts, within a batch the least, the others are counted as repeated; those without a site or time don't
    count. Work per batch grows with its readings, the sites and their last `late` hours, not with what came before. All
    is summed in tasks before it is shuffled, so a site with many readings is no hot spot.
    """
    stream = feed.writeStream.foreachBatch(lambda rows, k: fold_batch(rows, k, folder, late)).option("checkpointLocation", f"{folder}/progress")
    stream.trigger(availableNow=True).start().awaitTermination()


def replayed_hours(spark: SparkSession, folder: str) -> DataFrame:
    """site_id, hour_start, n and the hour's means of what replay has taken in, hours that are still open among them."""
    parts = spark.read.schema("site_id long, hour_start timestamp, n long, " + ", ".join(f"{c} double" for c in FIELDS)).parquet(f"{folder}/hours")
    return parts.groupBy("site_id", "hour_start").agg(F.sum("n").alias("n"), *((F.sum(c) / F.sum("n")).alias(c) for c in FIELDS))


def replayed_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Each site's newest reading, and its numbers of readings, late ones and repeated ones (SITES)."""
    both = spark.read.schema(f"{SITES}, batch long").parquet(f"{folder}/sites-*")
    return both.where(F.col("batch") == both.agg(F.max("batch")).first()[0]).drop("batch")
