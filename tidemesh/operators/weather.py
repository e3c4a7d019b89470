"""Weather readings: cleaning, the current value per site, flags and presets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemesh import defaults as D

FIELDS = ("precipitation", "wind_speed_10m", "wind_direction_10m")

# Map presets (name, latitude, longitude, metres per pixel).
PRESETS = (("varanasi", 25.14, 83.11, 100.0), ("kanpur", 26.45, 80.05, 128.0), ("bhopal", 23.37, 78.03, 270.0))


def _finite(c: str) -> Column:
    v = F.col(c).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def sanitise(readings: DataFrame) -> DataFrame:
    """readings with each of FIELDS finite (else 0), bad (names of those that weren't) and status.

    status is success, or partial if any was bad. Strings that are numbers count; booleans, nulls, NaN and infinities
    don't.
    """
    kinds = dict(readings.dtypes)
    clean = {c: F.lit(None).cast("double") if kinds[c] == "boolean" else _finite(c) for c in FIELDS}
    bad = F.filter(F.array(*(F.when(v.isNull(), F.lit(c)) for c, v in clean.items())), lambda x: x.isNotNull())
    told = readings.withColumn("bad", bad)
    told = told.select(*(F.coalesce(clean[c], F.lit(0.0)).alias(c) if c in FIELDS else F.col(c) for c in readings.columns), "bad")
    return told.withColumn("status", F.when(F.size("bad") > 0, "partial").otherwise("success"))


def latest(readings: DataFrame, sites: DataFrame) -> DataFrame:
    """Each site's newest reading, or the calm one with status fallback where it has none; repeats count once."""
    value = F.struct(*FIELDS, "status")
    newest = sanitise(readings).groupBy("site_id").agg(F.max_by(value, F.struct("obs_ts", *FIELDS)).alias("r"))
    joined = sites.join(newest, "site_id", "left")
    told = [F.coalesce(f"r.{c}", F.lit(D.CALM[c])).alias(c) for c in FIELDS]
    return joined.select(*sites.columns, *told, F.coalesce("r.status", F.lit("fallback")).alias("status"))


def hourly(readings: DataFrame) -> DataFrame:
    """site_id, hour_start and the hour's mean readings and count."""
    means = [F.avg(c).alias(c) for c in FIELDS]
    grouped = sanitise(readings).groupBy("site_id", F.window("obs_ts", "1 hour").alias("w"))
    return grouped.agg(*means, F.count("*").alias("n")).select("site_id", F.col("w.start").alias("hour_start"), *FIELDS, "n")


def flags(weather: DataFrame) -> DataFrame:
    """weather with too_windy and too_wet, both strict."""
    return weather.withColumn("too_windy", F.col("wind_speed_10m") > D.WIND_LIMIT).withColumn("too_wet", F.col("precipitation") > D.RAIN_LIMIT)


def with_presets(maps: DataFrame, presets: DataFrame) -> DataFrame:
    """maps (path, lat, lon) with what is missing of lat and lon from the preset of the lower-cased file stem.

    presets is a table of names; where neither has a value the default place counts.
    """
    stem = F.lower(F.regexp_extract("path", r"([^/\\]*?)(\.[^./\\]*)?$", 1))
    known = presets.select(F.lower("name").alias("_stem"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    joined = maps.withColumn("stem", stem).join(known, F.col("stem") == F.col("_stem"), "left")
    joined = joined.withColumn("lat", F.coalesce("lat", "_lat", F.lit(D.DEFAULT_LAT))).withColumn("lon", F.coalesce("lon", "_lon", F.lit(D.DEFAULT_LON)))
    return joined.drop("_stem", "_lat", "_lon")
