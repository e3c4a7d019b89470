"""File sources and sinks: map images, weather files, georeferenced rasters, side files and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemesh import defaults as D

WEATHER_SCHEMA = "precipitation double, wind_speed_10m double, wind_direction_10m double"


def read_images(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(pixels, rejects): pixels has path, x, y, b, g, r of every image that can be decoded; rejects has the paths of
    the files that can't. Grey images have equal channels; a fourth channel is left out."""
    image = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")
    n = F.col("nChannels")
    cell = image.select(F.col("origin").alias("path"), "height", "width", n, "data", F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)).alias("i"))
    byte = lambda k: F.conv(F.hex(F.substr("data", F.col("i") * n + F.least(F.lit(k), n - 1) + 1, F.lit(1))), 16, 10).cast("int")
    pixels = cell.select("path", (F.col("i") % F.col("width")).cast("int").alias("x"), F.expr("cast(i div width AS int)").alias("y"), byte(0).alias("b"), byte(1).alias("g"), byte(2).alias("r"))
    every = spark.read.format("binaryFile").load(folder).select("path")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    rejects = every.withColumn("_p", plain(F.col("path"))).join(image.select(plain(F.col("origin")).alias("_p")), "_p", "left_anti").select("path")
    return pixels, rejects


def read_weather(spark: SparkSession, path: str, scenes: DataFrame) -> DataFrame:
    """scenes with the reading of the file of their name (scene name = file stem); those without one are calm."""
    rows = spark.read.schema(WEATHER_SCHEMA).option("multiLine", True).json(path).select("*", F.regexp_extract(F.input_file_name(), r"([^/]*?)\.[^./]*$", 1).alias("name"))
    joined = scenes.join(rows, "name", "left")
    return joined.select(*scenes.columns, *(F.coalesce(c, F.lit(D.CALM[c])).alias(c) for c in ("precipitation", "wind_speed_10m", "wind_direction_10m")))


def downscale(pixels: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """scene_id, x, y, b, g, r of scenes wider than `most`, scaled to that width by area; others stay as they are.

    Each source pixel gives its share to the one to four target pixels that it overlaps.
    """
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.col("width"))
    told = pixels.join(sizes.select("scene_id", scale.alias("s"), F.greatest(F.lit(1), F.rint(F.col("width") * scale)).cast("int").alias("nw"), F.greatest(F.lit(1), F.rint(F.col("height") * scale)).cast("int").alias("nh"), "width", "height"), "scene_id")

    def cells(c: str, size: str, new: str) -> Column:
        a, b = F.col(c) * F.col(new) / F.col(size), (F.col(c) + 1) * F.col(new) / F.col(size)
        first, last = F.floor(a + 1e-9).cast("int"), F.least(F.col(new) - 1, F.ceil(b - 1e-9).cast("int") - 1)
        return F.transform(F.sequence(first, F.greatest(first, last)), lambda k: F.struct(k.alias("k"), (F.least(b, (k + 1).cast("double")) - F.greatest(a, k.cast("double"))).alias("w")))

    parts = told.withColumn("cx", F.explode(cells("x", "width", "nw"))).withColumn("cy", F.explode(cells("y", "height", "nh")))
    weight = F.col("cx.w") * F.col("cy.w")
    sums = parts.groupBy("scene_id", F.col("cx.k").alias("x"), F.col("cy.k").alias("y"))
    return sums.agg(*(F.rint(F.sum(F.col(c) * weight) / F.sum(weight)).cast("int").alias(c) for c in "bgr"))


def geo_references(refs: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references, rejects) of rasters (scene_id, width, height, a..f, crs), matched with the scenes' sizes.

    A reference gives lat, lon of the centre and m_per_px, the distance of two neighbour pixels there. Rejected: not
    EPSG:4326, a singular transform, a side below 2 pixels, a corner outside the world, another size than the scene.
    """
    from tidemesh.functions.geodesy import affine

    place = lambda x, y: affine(x, y, *(F.col(k) for k in "abcdef"))
    told = refs.join(sizes.select("scene_id", F.col("width").alias("_w"), F.col("height").alias("_h")), "scene_id")
    told = told.withColumn("_m", place((F.col("width") - 1) / 2, (F.col("height") - 1) / 2)).withColumn("_n", place((F.col("width") - 1) / 2 + 1, (F.col("height") - 1) / 2))
    corners = [place(F.lit(0.0) if a == 0 else F.col("width") - 1.0, F.lit(0.0) if b == 0 else F.col("height") - 1.0) for a in (0, 1) for b in (0, 1)]
    outside = F.lit(False)
    for c in corners:
        outside = outside | (F.abs(c["x"]) > 180) | (F.abs(c["y"]) > 90)
    error = (
        F.when(F.coalesce(F.col("crs") != "EPSG:4326", F.lit(True)), "crs")
        .when((F.col("width") < 2) | (F.col("height") < 2), "size")
        .when(F.abs(F.col("a") * F.col("e") - F.col("b") * F.col("d")) < 1e-15, "singular")
        .when(outside, "range")
        .when((F.col("width") != F.col("_w")) | (F.col("height") != F.col("_h")), "scene size")
    )
    dlat, dlon = F.radians(F.col("_n.y") - F.col("_m.y")), F.radians(F.col("_n.x") - F.col("_m.x"))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians("_m.y")) * F.cos(F.radians("_n.y")) * F.pow(F.sin(dlon / 2), 2)
    told = told.withColumn("error", error).withColumn("m_per_px", 2 * 6371008.8 * F.asin(F.sqrt(h)))
    good = told.where("error IS NULL").select("scene_id", "width", "height", F.col("_m.y").alias("lat"), F.col("_m.x").alias("lon"), "m_per_px")
    return good, told.where("error IS NOT NULL").select("scene_id", "error")


def write_side_files(points: DataFrame, scenes: DataFrame, path: str, run_id: str) -> None:
    """One JSON row per route under path/run_id=...: its points in order, drop and reload indices, home, and place."""
    ordered = F.sort_array(F.collect_list(F.struct("seq", "x", "y", "kind")))
    told = points.groupBy("scene_id", "base_id").agg(ordered.alias("p")).join(scenes.select("scene_id", "lat", "lon", "m_per_px"), "scene_id")
    at = lambda kind: F.transform(F.filter("p", lambda q: q["kind"] == kind), lambda q: q["seq"])
    xy = lambda q: F.array(q["x"], q["y"])
    rows = told.select("scene_id", "base_id", F.transform("p", xy).alias("full_path"), at("drop").alias("drop_indices"), at("reload").alias("reload_indices"), xy(F.col("p")[0]).alias("home"), F.array("lat", "lon").alias("geo_center"), F.col("m_per_px").alias("meters_per_pixel"))
    rows.write.mode("errorifexists").json(f"{path}/run_id={run_id}")


def write_summaries(summaries: DataFrame, path: str, run_id: str) -> None:
    """One JSON row per scene; a run's folder is never reused."""
    summaries.write.mode("errorifexists").json(f"{path}/run_id={run_id}")
