"""Flood masks as sparse pixel tables (scene_id, x, y): thresholds, morphology and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemesh import defaults as D
from tidemesh.functions.colour import in_band
from tidemesh.operators.regions import layers, merged, run_pixels, runs

PIXEL = ["scene_id", "x", "y"]


def ellipse(rx: int, ry: int | None = None) -> list[tuple[int, int]]:
    """Offsets of an ellipse: row dy reaches rint(rx * sqrt(1 - (dy / ry)^2)) each way."""
    ry = rx if ry is None else ry
    half = {dy: round(rx * (1 - (dy / ry) ** 2) ** 0.5) if ry else rx for dy in range(-ry, ry + 1)}
    return [(dx, dy) for dy, w in half.items() for dx in range(-w, w + 1)]


def square(r: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def inside(df: DataFrame, width: int | str, height: int | str) -> DataFrame:
    return df.where(f"x >= 0 AND y >= 0 AND x < {width} AND y < {height}")


def boundary(mask: DataFrame) -> DataFrame:
    """Pixels of a mask with a 4-neighbour that isn't in it (outside the image counts as not in it).

    One window sort per direction: a pixel's neighbour in its row or column is the next in order.
    """
    from pyspark.sql import Window

    row, column = Window.partitionBy("scene_id", "y").orderBy("x"), Window.partitionBy("scene_id", "x").orderBy("y")
    near = lambda f, c, w, d: F.coalesce(f(c).over(w) == F.col(c) + d, F.lit(False))
    told = mask.withColumn("_r", near(F.lead, "x", row, 1) & near(F.lag, "x", row, -1))
    told = told.withColumn("_c", near(F.lead, "y", column, 1) & near(F.lag, "y", column, -1))
    return told.where("NOT (_r AND _c)").drop("_r", "_c")


def _spread(body: DataFrame, offsets: list[tuple[int, int]], width: int, height: int) -> DataFrame:
    """Runs (scene_id, y, x1, x2) grown by offsets, clipped to the image: the fewest runs."""
    rows = {dy: [dx for dx, at in offsets if at == dy] for _, dy in offsets}
    ends = F.explode(F.array(*(F.struct(F.lit(dy).alias("y"), F.lit(min(xs)).alias("x1"), F.lit(max(xs)).alias("x2")) for dy, xs in sorted(rows.items()))))
    grown = body.select("scene_id", "y", "x1", "x2", ends.alias("o")).select("scene_id", (F.col("y") + F.col("o.y")).alias("y"), F.greatest(F.col("x1") + F.col("o.x1"), F.lit(0)).alias("x1"), F.least(F.col("x2") + F.col("o.x2"), F.lit(width - 1)).alias("x2"))
    return merged(grown.where(f"x1 <= x2 AND y >= 0 AND y < {height}"))


def _worn(body: DataFrame, r: int, width: int, height: int) -> DataFrame:
    """The runs of pixels whose square neighbourhood of radius r is all in the runs of a mask (see runs).

    Along rows a run loses r pixels at each end that isn't the image's; a pixel then stays if as many of the rows that
    see it hold it as there are.
    """
    own = body.select("scene_id", "y", F.greatest("x1", F.lit(0)).alias("x1"), F.least("x2", F.lit(width - 1)).alias("x2")).where(f"y >= 0 AND y < {height}")
    left, right = F.when(F.col("x1") > 0, F.col("x1") + r).otherwise(F.col("x1")), F.when(F.col("x2") < width - 1, F.col("x2") - r).otherwise(F.col("x2"))
    own = own.select("scene_id", "y", left.alias("x1"), right.alias("x2")).where("x1 <= x2")
    low, high = F.greatest(F.col("y") - r, F.lit(0)), F.least(F.col("y") + r, F.lit(height - 1))
    seen = layers(own.select("scene_id", F.explode(F.sequence(low, high)).alias("y"), "x1", "x2"), F.lit(1))
    return merged(seen.where(F.col("n") == high - low + 1).drop("n"))


def dilate(mask: DataFrame, offsets: list[tuple[int, int]], width: int, height: int) -> DataFrame:
    """The mask grown by offsets, clipped to the image.

    A run of pixels grows to one range a row of the element, which is exact for the row-convex elements of this module;
    ranges are merged before pixels are made. An empty mask stays empty.
    """
    return run_pixels(_spread(runs(mask), offsets, width, height))


def erode(mask: DataFrame, r: int, width: int, height: int) -> DataFrame:
    """Pixels whose square neighbourhood of radius r is all in the mask; outside the image counts as in it. Runs are worn,
    not pixels."""
    return run_pixels(_worn(runs(mask), r, width, height))


def close_open(mask: DataFrame, r: int, width: int, height: int) -> DataFrame:
    """Closing and then opening with a square of radius r: specks and pinholes go. Pixels are made at the end."""
    closed = _worn(_spread(runs(mask), square(r), width, height), r, width, height)
    return run_pixels(_spread(_worn(closed, r, width, height), square(r), width, height))


def sample_thresholds(pixels: DataFrame, samples: DataFrame, radius: int = 5) -> DataFrame:
    """Per scene: h_lo, h_hi, s_lo, s_hi, v_lo, v_hi and wrap from the patches round its sample points.

    A patch is clipped to the image. Hue opens by 20, saturation and value by 30; wrap means red at either end. A scene's
    samples are few, so pixels meet them by scene, and those in two patches may count twice.
    """
    at = samples.select("scene_id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    near = (F.abs(F.col("x") - F.col("_x")) <= radius) & (F.abs(F.col("y") - F.col("_y")) <= radius)
    patch = pixels.join(at.hint("shuffle_hash"), "scene_id").where(near)
    span = [f(c).alias(f"{c}_{k}") for c in "hsv" for k, f in (("lo", F.min), ("hi", F.max))]
    ends = patch.groupBy("scene_id").agg(*span)
    low = lambda c, d: F.greatest(F.lit(0), F.col(f"{c}_lo") - d).cast("int").alias(f"{c}_lo")
    high = lambda c, d, m: F.least(F.lit(m), F.col(f"{c}_hi") + d).cast("int").alias(f"{c}_hi")
    told = ends.select("scene_id", low("h", 20), high("h", 20, 179), low("s", 30), high("s", 30, 255), low("v", 30), high("v", 30, 255))
    return told.withColumn("wrap", (F.col("h_lo") <= 10) | (F.col("h_hi") >= 170))


def threshold(pixels: DataFrame, limits: DataFrame) -> DataFrame:
    """The pixels between their scene's limits: one row of limits a scene, joined by scene."""
    joined = pixels.join(limits.hint("shuffle_hash"), "scene_id")
    c = F.col
    return joined.where(in_band(c("h"), c("s"), c("v"), (c("h_lo"), c("s_lo"), c("v_lo")), (c("h_hi"), c("s_hi"), c("v_hi")), c("wrap"))).select(*PIXEL)


def normalise(values: DataFrame) -> DataFrame:
    """scene_id, x, y, value scaled to 0..255 by the scene's least and largest; a flat scene is scaled by 255."""
    ends = values.groupBy("scene_id").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("value") - F.col("_lo")) * 255.0 / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0))).otherwise(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col("value") * 255.0)))
    return values.join(ends.hint("shuffle_hash"), "scene_id").select("scene_id", "x", "y", F.rint(scaled).cast("int").alias("value"))


def coverage(mask: DataFrame, scenes: DataFrame, most: float | None = None) -> DataFrame:
    """scene_id, flooded, share and status (ok, dry, too_much, implausible) of every scene.

    dry: nothing to deliver. too_much: above the user's limit, where one is given. implausible: outside
    MIN_COVERAGE to MAX_COVERAGE, ends included.
    """
    counts = mask.groupBy("scene_id").agg(F.count("*").alias("flooded"))
    told = scenes.join(counts, "scene_id", "left").withColumn("flooded", F.coalesce("flooded", F.lit(0)))
    share = F.col("flooded") / (F.col("width") * F.col("height"))
    status = F.when(F.col("flooded") == 0, "dry")
    if most is not None:
        status = status.when(share > most, "too_much")
    return told.select("scene_id", "flooded", share.alias("share"), status.when(~share.between(D.MIN_COVERAGE, D.MAX_COVERAGE), "implausible").otherwise("ok").alias("status"))


def block_occupancy(mask: DataFrame, factor: int, width: int, height: int) -> DataFrame:
    """scene_id, cx, cy of the factor x factor cells that hold a flooded pixel.

    Above factor 3 the mask grows by a 3x3 square first. Partial blocks at the right and bottom are left out; an image
    smaller than one block has cells of one pixel.
    """
    if width < factor or height < factor:
        factor = 1
    grown = dilate(mask, square(1), width, height) if factor > 3 else mask
    cells = grown.selectExpr("scene_id", f"cast(x div {factor} AS int) AS cx", f"cast(y div {factor} AS int) AS cy")
    return cells.where(f"cx < {width // factor} AND cy < {height // factor}").distinct()


def dominant_hue(pixels: DataFrame) -> DataFrame:
    """scene_id, hue, weight: the hue whose neighbourhood of 6 each way (circular) holds most saturated pixels."""
    counts = pixels.where("s >= 150 AND v >= 100").groupBy("scene_id", "h").agg(F.count("*").alias("n"))
    near = counts.select("scene_id", F.explode(F.transform(F.sequence(F.lit(-6), F.lit(6)), lambda k: F.pmod(F.col("h") + k, F.lit(180)))).alias("hue"), "n")
    sums = near.groupBy("scene_id", "hue").agg(F.sum("n").alias("weight"))
    return sums.groupBy("scene_id").agg(F.max_by(F.struct("hue", "weight"), F.struct("weight", -F.col("hue"))).alias("b")).select("scene_id", F.col("b.hue").cast("int").alias("hue"), "b.weight")
