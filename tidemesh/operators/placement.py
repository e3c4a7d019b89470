"""Drop points near flooded regions: candidate bands, picks by size, and sample points of an overlay's colour."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemesh import defaults as D
from tidemesh.functions.flight import segment_distance
from tidemesh.operators.common import stored
from tidemesh.operators.regions import BAND, clearance, gaps, run_roots, runs
from tidemesh.operators.routes import line_pixels

TIERS = (5.0, 3.5, 2.0, 0.5)
REGION = ["scene_id", "region_id"]


def band_radius(width: int, height: int) -> int:
    """How far from a region its drop points may lie."""
    return max(5, min(35, math.ceil(0.04 * max(width, height))))


def square_sums(image: np.ndarray, top: int, rows: int, height: int, r: int) -> np.ndarray:
    """Pixels of an image in the squares of radius r round each pixel of its rows from `top`, mirrored at its borders.

    image holds `rows` rows from `top` on, with up to r more on either side where the whole image of `height` rows has
    them; the edge itself isn't repeated, and an image smaller than r is mirrored once.
    """
    def mirrored(first: int, n: int, size: int, start: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(first - r, first + n + r)
        at = np.where(at < 0, -at, np.where(at > size - 1, 2 * (size - 1) - at, at))
        return np.clip(at - start, 0, None), (at >= 0) & (at < size)

    width = image.shape[1]
    y, in_y = mirrored(top, rows, height, max(0, top - r))
    x, in_x = mirrored(0, width, width, 0)
    wide = image[np.minimum(y, len(image) - 1)][:, np.minimum(x, width - 1)] * (in_y[:, None] & in_x)
    sums = np.zeros((wide.shape[0] + 1, wide.shape[1] + 1), np.int64)
    sums[1:, 1:] = wide.cumsum(0, dtype=np.int64).cumsum(1)
    side = 2 * r + 1
    return sums[side:, side:] - sums[:-side, side:] - sums[side:, :-side] + sums[:-side, :-side]


def local_density(overlay: DataFrame, width: int, height: int, r: int = 5) -> DataFrame:
    """overlay (scene_id, x, y) with density: the overlay's share of the square of radius r round each pixel.

    The image is mirrored at its borders (without repeating the edge). A task sums squares over one band of BAND rows of a
    scene, which gets the overlay's runs of r rows more on either side; no pixel is sent to another.
    """
    def fold(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        top = int(key[1]) * BAND
        rows, first = min(BAND, height - top), max(0, top - r)
        marks = np.zeros((min(height, top + rows + r) - first, width + 1), np.int32)
        at = own["y"].to_numpy(np.int64) - first
        np.add.at(marks, (at, own["x1"].to_numpy(np.int64)), 1)
        np.add.at(marks, (at, own["x2"].to_numpy(np.int64) + 1), -1)
        image = (marks.cumsum(1)[:, :width] > 0).astype(np.int32)
        y, x = np.nonzero(image[top - first : top - first + rows])
        n = square_sums(image, top, rows, height, r)[y, x]
        return pd.DataFrame({"scene_id": key[0], "x": x, "y": y + top, "density": n / (2 * r + 1) ** 2})

    band = lambda y: F.floor(y / BAND).cast("int")
    own = runs(overlay).select("scene_id", F.col("y").cast("int").alias("y"), F.greatest("x1", F.lit(0)).cast("int").alias("x1"), F.least("x2", F.lit(width - 1)).cast("int").alias("x2")).where(f"x1 <= x2 AND y >= 0 AND y < {height}")
    sent = own.withColumn("band", F.explode(F.sequence(band(F.greatest(F.col("y") - r, F.lit(0))), band(F.least(F.col("y") + r, F.lit(height - 1))))))
    return sent.groupBy("scene_id", "band").applyInPandas(fold, f"scene_id {dict(overlay.dtypes)['scene_id']}, x int, y int, density double")


def sample_points(density: DataFrame, n: int = 3, apart: float = 40.0) -> DataFrame:
    """scene_id, pick, x, y: per scene the n pixels with a density nearest 0.5, each `apart` from those before.

    Ties go to the first in rows. A round picks in all scenes.
    """
    left, out = stored(density, "density"), None
    for k in range(n):
        best = left.groupBy("scene_id").agg(F.min(F.struct(F.abs(F.col("density") - 0.5).alias("d"), "y", "x")).alias("b"))
        now = stored(best.select("scene_id", F.lit(k).alias("pick"), "b.x", "b.y"), "pick")
        out = now if out is None else out.union(now)
        near = now.select("scene_id", F.col("x").alias("_x"), F.col("y").alias("_y"))
        left = left.join(near, "scene_id").where(F.hypot((F.col("x") - F.col("_x")).cast("double"), (F.col("y") - F.col("_y")).cast("double")) >= apart).drop("_x", "_y")
    return out


def hull_outline(hulls: DataFrame) -> DataFrame:
    """scene_id, region_id, x, y: the pixels on the sides of each hull, its corners included."""
    ring = hulls.select("scene_id", F.col("region_id").alias("base_id"), F.posexplode(F.concat("hull", F.slice("hull", 1, 1))).alias("seq", "p")).select("scene_id", "base_id", "seq", "p.x", "p.y")
    return line_pixels(ring).union(ring.select("scene_id", "base_id", "x", "y")).distinct().withColumnRenamed("base_id", "region_id")


def dry_components(mask: DataFrame, width: int, height: int) -> DataFrame:
    """scene_id, x, y, component, size of the dry pixels of scenes with flood; pixels that touch at corners are joined."""
    dry = gaps(runs(mask), width, height).where(F.col("y").between(0, height - 1))
    dry = dry.withColumn("x1", F.greatest("x1", F.lit(0))).withColumn("x2", F.least("x2", F.lit(width - 1))).where("x1 <= x2")
    dry = stored(dry, "dry")
    told = stored(run_roots(dry, 1), "dry-roots")
    sizes = told.groupBy("scene_id", "root").agg(F.sum(F.col("x2") - F.col("x1") + 1).alias("size"))
    return told.join(sizes, ["scene_id", "root"]).select("scene_id", F.explode(F.sequence("x1", "x2")).alias("x"), "y", F.col("root").alias("component"), "size")


def or_corners(candidates: DataFrame, hulls: DataFrame) -> DataFrame:
    """candidates (scene_id, region_id, x, y, clearance), and the hull's corners, at no clearance, of regions without any."""
    bare = hulls.join(candidates.select(*REGION).distinct(), REGION, "left_anti")
    corners = bare.select(*REGION, F.explode("hull").alias("p")).select(*REGION, "p.x", "p.y", F.lit(0.0).alias("clearance"))
    return candidates.select(*REGION, "x", "y", "clearance").union(corners)


def candidate_band(labels: DataFrame, mask: DataFrame, width: int, height: int) -> DataFrame:
    """scene_id, region_id, x, y, clearance: dry pixels within the band of a region, of its best clearance tier.

    labels are a region's pixels, or its hull's outline (see hull_outline), as rows are taken from end to end; the band is a square dilation of them, sent out
    from each row's run ends so that a run gives a row per line of the band. Tiers are TIERS; a region without any
    keeps all its dry pixels.
    """
    r = band_radius(width, height)
    row = labels.groupBy(*REGION, "y").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    rows = row.select(*REGION, F.explode(F.sequence(F.greatest(F.col("y") - r, F.lit(0)), F.least(F.col("y") + r, F.lit(height - 1)))).alias("y"), F.greatest(F.col("a") - r, F.lit(0)).alias("a"), F.least(F.col("b") + r, F.lit(width - 1)).alias("b"))
    spans = rows.groupBy(*REGION, "y").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    cells = spans.select(*REGION, F.explode(F.sequence("a", "b")).alias("x"), "y").join(mask, ["scene_id", "x", "y"], "left_anti")
    told = clearance(cells, mask, 8)
    tier = F.lit(0)
    for k, t in enumerate(reversed(TIERS), 1):
        tier = F.when(F.col("clearance") >= t, k).otherwise(tier)
    told = told.withColumn("_t", tier).withColumn("_best", F.max("_t").over(Window.partitionBy(*REGION)))
    return told.where("_t >= _best").select(*REGION, "x", "y", "clearance")


def main_component(candidates: DataFrame, components: DataFrame) -> DataFrame:
    """The candidates whose dry component is at least half as large as the largest among their region's candidates.

    components has scene_id, x, y, size for dry pixels.
    """
    told = candidates.join(components.select("scene_id", "x", "y", F.col("size").alias("_s")), ["scene_id", "x", "y"])
    told = told.withColumn("_m", F.max("_s").over(Window.partitionBy(*REGION)))
    return told.where("_s * 2 >= _m").drop("_s", "_m")


def connected_to_home(drops: DataFrame, homes: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded) drops (scene_id, drop_id, x, y) by whether they share the component of their scene's home.

    components has scene_id, x, y and component; a drop or home on no component is excluded, with its reason.
    """
    c = components.select("scene_id", "x", "y", "component")
    own = drops.join(c, ["scene_id", "x", "y"], "left")
    home = homes.join(c, ["scene_id", "x", "y"], "left").select("scene_id", F.col("component").alias("_home"))
    told = own.join(home, "scene_id", "left")
    reason = F.when(F.col("_home").isNull(), "home is not on free ground").when(F.col("component").isNull(), "drop is not on free ground").when(F.col("component") != F.col("_home"), "cut off from home")
    told = told.withColumn("reason", reason)
    return told.where("reason IS NULL").select(*drops.columns), told.where("reason IS NOT NULL").select(*drops.columns, "reason")


def nearest_to_line(candidates: DataFrame, centres: DataFrame) -> DataFrame:
    """scene_id, region_id, x, y: each region's candidate nearest the polyline through its scene's region centres.

    centres has scene_id, region_id, cx, cy; the line follows region_id. A scene's line is one array; ties go to the
    first in rows. A scene with one region measures to its centre.
    """
    line = centres.groupBy("scene_id").agg(F.sort_array(F.collect_list(F.struct("region_id", "cx", "cy"))).alias("ps"))
    told = candidates.join(line, "scene_id")
    pairs = F.arrays_zip(F.col("ps").alias("a"), F.when(F.size("ps") > 1, F.slice("ps", 2, F.size("ps"))).otherwise(F.col("ps")).alias("b"))
    distance = F.array_min(F.transform(F.filter(pairs, lambda s: s["b"].isNotNull()), lambda s: segment_distance(F.col("x"), F.col("y"), s["a"]["cx"], s["a"]["cy"], s["b"]["cx"], s["b"]["cy"])))
    best = told.groupBy(*REGION).agg(F.min(F.struct(F.round(distance, 9).alias("d"), "y", "x")).alias("b"))
    return best.select(*REGION, "b.x", "b.y")


def perimeter_stations(hulls: DataFrame, counts: DataFrame) -> DataFrame:
    """scene_id, region_id, k, sx, sy, spacing: n points at equal steps along each hull, and the spacing aimed at.

    counts has scene_id, region_id, n_drops. spacing is at least MIN_DROP_SPACING, else the smaller of two thirds of a
    step and 0.45 of the hull's diagonal.
    """
    told = hulls.join(counts.select(*REGION, "n_drops"), REGION).where("size(hull) >= 2")
    edges = told.selectExpr(*REGION, "n_drops", "hull", "inline(transform(hull, (p, i) -> named_struct('i', i, 'ax', p.x, 'ay', p.y, 'bx', element_at(hull, (i + 1) % size(hull) + 1).x, 'by', element_at(hull, (i + 1) % size(hull) + 1).y)))")
    edges = edges.withColumn("len", F.hypot((F.col("bx") - F.col("ax")).cast("double"), (F.col("by") - F.col("ay")).cast("double")))
    around = Window.partitionBy(*REGION)
    edges = edges.withColumn("total", F.sum("len").over(around)).withColumn("at", F.coalesce(F.sum("len").over(around.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    box = [f(c).over(around) for c in ("ax", "ay") for f in (F.max, F.min)]
    diagonal = F.hypot((box[0] - box[1]).cast("double"), (box[2] - box[3]).cast("double"))
    edges = edges.withColumn("spacing", F.greatest(F.lit(D.MIN_DROP_SPACING), F.least(F.col("total") / (1.5 * F.col("n_drops")), 0.45 * diagonal)))
    stations = edges.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n_drops") - 1))).withColumn("s", F.col("k") * F.col("total") / F.col("n_drops"))
    inside = stations.where("s >= at AND s < at + len")
    share = (F.col("s") - F.col("at")) / F.col("len")
    return inside.select(*REGION, "k", (F.col("ax") + share * (F.col("bx") - F.col("ax"))).alias("sx"), (F.col("ay") + share * (F.col("by") - F.col("ay"))).alias("sy"), "spacing")


def pick_at_stations(candidates: DataFrame, stations: DataFrame, most: int = D.MAX_DROPS) -> DataFrame:
    """scene_id, region_id, k, x, y: for each station the nearest candidate that keeps its distance to earlier picks.

    Distance tiers are the spacing, 0.8 and 0.6 of it, and MIN_DROP_SPACING; the best tier with a candidate counts,
    and a station without any is left out. A round picks one station of every region.
    """
    out = None
    for k in range(most):
        at = candidates.join(stations.where(F.col("k") == k), REGION)
        if out is not None:
            chosen = out.groupBy(*REGION).agg(F.collect_list(F.struct("x", "y")).alias("_c"))
            at = at.join(chosen, REGION, "left")
            gap = F.array_min(F.transform("_c", lambda c: F.hypot((F.col("x") - c["x"]).cast("double"), (F.col("y") - c["y"]).cast("double"))))
            gap = F.coalesce(gap, F.lit(float("inf")))
        else:
            gap = F.lit(float("inf"))
        s = F.col("spacing")
        tier = F.when(gap >= s, 0).when(gap >= 0.8 * s, 1).when(gap >= 0.6 * s, 2).when(gap >= D.MIN_DROP_SPACING, 3)
        away = F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))
        best = at.withColumn("tier", tier).where("tier IS NOT NULL").groupBy(*REGION).agg(F.min(F.struct("tier", F.round(away, 9).alias("d"), "y", "x")).alias("b"))
        now = stored(best.select(*REGION, F.lit(k).alias("k"), "b.x", "b.y"), "station")
        out = now if out is None else out.union(now)
    return out
