"""Flood regions: connected components of sparse masks, their areas, boxes, centres and hulls, all scenes at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemesh import defaults as D
from tidemesh.functions.flight import drop_count
from tidemesh.operators.common import stored


#: Rows of a scene whose runs one task joins.
BAND = 256
#: Rows of a scene whose points one task measures.
ROWS = 32


def runs(mask: DataFrame, keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """keys, run_id, y, x1, x2: the maximal horizontal runs of a mask (gaps and islands, one sort per row; a pixel may come
    twice)."""
    row = Window.partitionBy(*keys, "y").orderBy("x")
    islands = mask.select(*keys, "x", "y").withColumn("_i", F.col("x") - F.dense_rank().over(row))
    out = islands.groupBy(*keys, "y", "_i").agg(F.min("x").alias("x1"), F.max("x").alias("x2"))
    return out.select(*keys, (F.col("y").cast("long") * (1 << 20) + F.col("x1")).alias("run_id"), "y", "x1", "x2")


def merged(parts: DataFrame, keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """keys, y, x1, x2: the fewest runs that cover the same pixels as runs that may overlap or touch."""
    row = Window.partitionBy(*keys, "y").orderBy("x1", "x2")
    before = F.max("x2").over(row.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_first", F.coalesce(before + 1 < F.col("x1"), F.lit(True)).cast("int"))
    numbered = parts.withColumn("_i", F.sum("_first").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "y", "_i").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2")).drop("_i")


def layers(parts: DataFrame, weight: Column, keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """keys, y, x1, x2, n: runs that don't overlap, with the sum of the weights of the parts (keys, y, x1, x2) that cover
    them, where there is one. Weights are whole numbers; a row's parts are swept from end to end."""
    row = Window.partitionBy(*keys, "y").orderBy("x")
    ends = F.explode(F.array(F.struct(F.col("x1").alias("x"), weight.alias("d")), F.struct((F.col("x2") + 1).alias("x"), (-weight).alias("d"))))
    told = parts.select(*keys, "y", ends.alias("e")).select(*keys, "y", "e.x", "e.d")
    told = told.withColumn("n", F.sum("d").over(row)).withColumn("_next", F.lead("x").over(row)).where((F.col("n") != 0) & (F.col("_next") > F.col("x")))
    return told.select(*keys, "y", F.col("x").alias("x1"), (F.col("_next") - 1).alias("x2"), "n")


def run_pixels(parts: DataFrame) -> DataFrame:
    """scene_id, x, y of runs."""
    return parts.select("scene_id", F.explode(F.sequence(F.col("x1").cast("int"), F.col("x2").cast("int"))).alias("x"), F.col("y").cast("int").alias("y"))


def label(mask: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, runs): 8-connected component of every pixel, and of every run; region_id is the least run_id."""
    told = run_roots(runs(mask), 1).select("scene_id", F.col("root").alias("region_id"), "y", "x1", "x2")
    return told.select("scene_id", "region_id", F.explode(F.sequence("x1", "x2")).alias("x"), "y"), told


def band_roots(y: np.ndarray, x1: np.ndarray, x2: np.ndarray, reach: int) -> np.ndarray:
    """The place of the first run that each run is joined to, of runs in order of (y, x1).

    The runs of the next row that a run touches lie next to each other, so two searches find them all. Each root hooks
    to the least it touches, and hooks are followed to their ends, until no touching runs have different roots.
    """
    row, far = y.astype(np.int64) << 32, np.int64(1) << 32
    low = np.searchsorted(row + x2, row + far + np.maximum(x1 - reach, -1), "left")
    high = np.searchsorted(row + x1, row + far + x2 + reach, "right")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(y)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    root = np.arange(len(y))
    while True:
        p, q = root[a], root[b]
        apart = p != q
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (root[root] != root).any():
            root = root[root]


def run_roots(r: DataFrame, reach: int) -> DataFrame:
    """r (scene_id, run_id, y, x1, x2) with root, the least run_id of its component: reach 1 joins runs that touch at
    corners, 0 only those that share a side.

    Two levels: a task joins the runs of one band of BAND rows of a scene; then only the bands' roots that meet at a
    border are contracted, in rounds that hook each to its least neighbour and follow hooks to their ends.
    """
    kinds = ", ".join(f"{c} {t}" for c, t in r.dtypes)

    def fold(runs: pd.DataFrame) -> pd.DataFrame:
        runs = runs.sort_values("run_id")
        root = band_roots(*(runs[c].to_numpy() for c in ("y", "x1", "x2")), reach)
        return runs.assign(root=runs["run_id"].to_numpy()[root])

    row = F.col("y") + 1  # an image's frame lies in the band of its first rows
    banded = stored(r.groupBy("scene_id", F.floor(row / BAND).alias("band")).applyInPandas(lambda key, runs: fold(runs), f"{kinds}, root long"), "bands")
    upper = banded.where(F.pmod(row, F.lit(BAND)) == BAND - 1).select("scene_id", F.col("root").alias("a"), (F.col("y") + 1).alias("y"), (F.col("x1") - reach).alias("l"), (F.col("x2") + reach).alias("h"))
    lower = banded.where(F.pmod(row, F.lit(BAND)) == 0).select("scene_id", "y", "x1", "x2", F.col("root").alias("b"))
    left = stored(upper.join(lower, ["scene_id", "y"]).where("x1 <= h AND x2 >= l").select("scene_id", "a", "b").distinct(), "borders")
    top = None
    while not left.isEmpty():
        both = left.union(left.select("scene_id", "b", "a"))
        hook = stored(both.groupBy("scene_id", F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("to")), "hooks")
        while True:
            up = hook.select("scene_id", F.col("node").alias("to"), F.col("to").alias("far"))
            jumped = stored(hook.join(up, ["scene_id", "to"]).select("scene_id", "node", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")), "jumps")
            hook = jumped.select("scene_id", "node", "to")
            if jumped.where("moved").isEmpty():
                break
        if top is None:
            top = hook
        else:
            up = hook.select("scene_id", F.col("node").alias("to"), F.col("to").alias("far"))
            top = stored(top.join(up, ["scene_id", "to"], "left").select("scene_id", "node", F.coalesce("far", "to").alias("to")), "tops")
        a, b = hook.select("scene_id", F.col("node").alias("a"), F.col("to").alias("a2")), hook.select("scene_id", F.col("node").alias("b"), F.col("to").alias("b2"))
        left = stored(left.join(a, ["scene_id", "a"]).join(b, ["scene_id", "b"]).where("a2 <> b2").select("scene_id", F.col("a2").alias("a"), F.col("b2").alias("b")).distinct(), "borders")
    if top is None:
        return banded
    named = top.select("scene_id", F.col("node").alias("root"), "to")
    return banded.join(named, ["scene_id", "root"], "left").select(*r.columns, F.coalesce("to", "root").alias("root"))


def gaps(r: DataFrame, width: int, height: int) -> DataFrame:
    """The dry runs (scene_id, run_id, y, x1, x2) between a mask's runs, in an image with a dry frame round it."""
    at = Window.partitionBy("scene_id", "y").orderBy("x1")
    before = r.select("scene_id", "y", (F.coalesce(F.lag("x2").over(at), F.lit(-2)) + 1).alias("g1"), (F.col("x1") - 1).alias("g2"))
    after = r.groupBy("scene_id", "y").agg((F.max("x2") + 1).alias("g1")).select("scene_id", "y", "g1", F.lit(width).alias("g2"))
    rows = r.select("scene_id").distinct().select("scene_id", F.explode(F.sequence(F.lit(-1), F.lit(height))).alias("y"))
    bare = rows.join(r.select("scene_id", "y").distinct(), ["scene_id", "y"], "left_anti").select("scene_id", "y", F.lit(-1).alias("g1"), F.lit(width).alias("g2"))
    out = before.union(after).union(bare).where("g1 <= g2")
    return out.select("scene_id", (F.col("y").cast("long") * (1 << 20) + F.col("g1")).alias("run_id"), "y", F.col("g1").alias("x1"), F.col("g2").alias("x2"))


def filled_runs(mask: DataFrame, width: int, height: int) -> DataFrame:
    """The runs of the mask with its holes: dry ground that no path over sides of pixels joins to the image's border."""
    outside = -(1 << 20) - 1  # the frame's first run has the least number of all
    wet = stored(runs(mask), "runs")
    holes = run_roots(gaps(wet, width, height), 0).where(F.col("root") != outside)
    out = merged(wet.select("scene_id", "y", "x1", "x2").union(holes.select("scene_id", "y", "x1", "x2")))
    return out.select("scene_id", (F.col("y").cast("long") * (1 << 20) + F.col("x1")).alias("run_id"), "y", "x1", "x2")


def external_runs(mask: DataFrame, width: int, height: int) -> DataFrame:
    """scene_id, region_id, y, x1, x2: the runs of the mask's outermost regions with all that they enclose; regions in
    holes are part of those round them."""
    return run_roots(filled_runs(mask, width, height), 1).select("scene_id", F.col("root").alias("region_id"), "y", "x1", "x2")


def external(mask: DataFrame, width: int, height: int) -> DataFrame:
    """scene_id, region_id, x, y of the outermost regions (see external_runs)."""
    return external_runs(mask, width, height).select("scene_id", "region_id", F.explode(F.sequence("x1", "x2")).alias("x"), "y")


def components(regions: DataFrame) -> DataFrame:
    """scene_id, region_id, size and box of every component, of its pixels (x, y) or its runs (y, x1, x2)."""
    left, right = ("x1", "x2") if "x1" in regions.columns else ("x", "x")
    size = F.sum(F.col(right) - F.col(left) + 1).cast("long")
    return regions.groupBy("scene_id", "region_id").agg(size.alias("size"), F.min(left).alias("min_x"), F.max(right).alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def polygon_area(labels: DataFrame) -> DataFrame:
    """scene_id, region_id, area and centre of the polygons through pixel centres.

    Each pixel touches four 2x2 squares: a square with four pixels of a region counts 1, with three 0.5 at the mean of
    the three. Specks and lines have area 0 and no centre.
    """
    corner = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0) for dy in (-1, 0))))
    quads = labels.select("scene_id", "region_id", "x", "y", corner.alias("o")).groupBy("scene_id", "region_id", (F.col("x") + F.col("o.dx")).alias("qx"), (F.col("y") + F.col("o.dy")).alias("qy"))
    counted = quads.agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    part = F.when(F.col("n") == 4, 1.0).when(F.col("n") == 3, 0.5).otherwise(0.0)
    sums = counted.groupBy("scene_id", "region_id").agg(F.sum(part).alias("area"), F.sum(part * F.col("sx") / F.col("n")).alias("mx"), F.sum(part * F.col("sy") / F.col("n")).alias("my"))
    centre = lambda c: F.when(F.col("area") > 0, F.floor(F.col(c) / F.col("area") + 1e-9).cast("int"))
    return sums.select("scene_id", "region_id", "area", centre("mx").alias("cx"), centre("my").alias("cy"))


def hull_area(hulls: DataFrame) -> DataFrame:
    """scene_id, region_id and the area of each hull (see hulls)."""
    twice = """aggregate(transform(hull, (p, i) -> cast(p.x AS long) * element_at(hull, (i + 1) % size(hull) + 1).y
      - cast(p.y AS long) * element_at(hull, (i + 1) % size(hull) + 1).x), cast(0 AS long), (a, b) -> a + b)"""
    return hulls.selectExpr("scene_id", "region_id", f"abs({twice}) / 2.0 AS hull_area")


def large_regions(labels: DataFrame, least: float = D.MIN_AREA) -> DataFrame:
    """Regions (see external) with area of `least` or more: size, box, area, centre, and drop points by the hull's area."""
    areas = polygon_area(labels).where(F.col("area") >= least)
    own = labels.join(areas.select("scene_id", "region_id"), ["scene_id", "region_id"], "left_semi")
    told = areas.join(components(labels), ["scene_id", "region_id"]).join(hull_area(hulls(own)), ["scene_id", "region_id"])
    return told.withColumn("n_drops", drop_count(F.col("hull_area")))


def hulls(labels: DataFrame) -> DataFrame:
    """scene_id, region_id and hull: the convex hull's corners from the least (x, y), counter-clockwise on a y-up plane.

    A region first shrinks to the ends of its columns; the monotone chain folds over those, sorted, in one array.
    """
    ends = labels.groupBy("scene_id", "region_id", "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    points = ends.select("scene_id", "region_id", F.explode(F.array_distinct(F.array(F.struct("x", F.col("lo").alias("y")), F.struct("x", F.col("hi").alias("y"))))).alias("p"))
    arrays = points.groupBy("scene_id", "region_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    fold = """
      aggregate({points}, cast(array() AS array<struct<x:int,y:int>>), (h, p) -> concat(
        aggregate(sequence(1, size(h) + 1), h, (s, i) -> if(size(s) >= 2 AND
          cast(element_at(s, -1).x - element_at(s, -2).x AS long) * (p.y - element_at(s, -2).y)
          - cast(element_at(s, -1).y - element_at(s, -2).y AS long) * (p.x - element_at(s, -2).x) <= 0,
          slice(s, 1, size(s) - 1), s)),
        array(p)))"""
    cast = arrays.selectExpr("scene_id", "region_id", "transform(ps, p -> named_struct('x', cast(p.x AS int), 'y', cast(p.y AS int))) AS ps")
    both = cast.selectExpr("scene_id", "region_id", "ps", f"{fold.format(points='ps')} AS low", f"{fold.format(points='reverse(ps)')} AS high")
    return both.selectExpr("scene_id", "region_id", "if(size(ps) < 3, ps, concat(slice(low, 1, size(low) - 1), slice(high, 1, size(high) - 1))) AS hull")


def clearance(points: DataFrame, mask: DataFrame, most: int) -> DataFrame:
    """points (scene_id, x, y, ...) with clearance: the distance to the nearest flooded pixel, capped at most.

    Points and pixels meet in tiles of `most` pixels: a point looks into its own tile and the eight round it, so the
    join has an equality key, and only pixels of a mask's boundary are looked at.
    """
    from tidemesh.operators.masks import boundary

    tile = lambda c: F.floor(F.col(c) / most)
    edge = boundary(mask.select("scene_id", "x", "y")).select("scene_id", F.col("x").alias("fx"), F.col("y").alias("fy")).withColumn("tx", F.floor(F.col("fx") / most)).withColumn("ty", F.floor(F.col("fy") / most))
    spots = points.select("scene_id", "x", "y").distinct()
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    asked = spots.withColumn("o", F.explode(around)).select("scene_id", "x", "y", (tile("x") + F.col("o.a")).alias("tx"), (tile("y") + F.col("o.b")).alias("ty"))
    square = (F.col("fx") - F.col("x")) * (F.col("fx") - F.col("x")) + (F.col("fy") - F.col("y")) * (F.col("fy") - F.col("y"))
    near = asked.join(edge.hint("merge"), ["scene_id", "tx", "ty"]).groupBy("scene_id", "x", "y").agg(F.min(square).alias("_d2"))
    wet = mask.select("scene_id", "x", "y", F.lit(0).cast("long").alias("_wet"))
    told = spots.join(near.hint("merge"), ["scene_id", "x", "y"], "left").join(wet.hint("merge"), ["scene_id", "x", "y"], "left")
    told = told.withColumn("clearance", F.when(F.col("_wet").isNotNull(), 0.0).otherwise(F.least(F.lit(float(most)), F.sqrt(F.coalesce(F.col("_d2"), F.lit(most * most)).cast("double")))))
    return points.join(told.select("scene_id", "x", "y", "clearance").hint("merge"), ["scene_id", "x", "y"])


def column_runs(mask: DataFrame, keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """keys, x, y1, y2, lo, hi: the vertical runs of a mask, and the rows lo to hi to which the run is the nearest of its
    column (halfway rows go to the upper run; null: no other run on that side). One sort by column."""
    column = Window.partitionBy(*keys, "x")
    marked = mask.select(*keys, "x", "y", (F.col("y") - F.dense_rank().over(column.orderBy("y"))).alias("_i"))
    told = marked.groupBy(*keys, "x", "_i").agg(F.min("y").alias("y1"), F.max("y").alias("y2"))
    order = column.orderBy("y1")
    lo, hi = F.floor((F.lag("y2").over(order) + F.col("y1")) / 2) + 1, F.floor((F.col("y2") + F.lead("y1").over(order)) / 2)
    return told.select(*keys, "x", "y1", "y2", lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def row_minima(y: np.ndarray, x: np.ndarray, ey: np.ndarray, ex: np.ndarray, eg: np.ndarray) -> np.ndarray:
    """The least (x - ex)^2 + eg over the entries of each point's row, -1 where its row has none.

    Points and entries are in order of (row, x). Along a row the best entry never moves left, so points are solved by
    halving: each looks only between the entries that its solved neighbours on either side took.
    """
    first, last = np.searchsorted(ey, y, "left"), np.searchsorted(ey, y, "right") - 1
    row = np.searchsorted(y, y, "left")
    rank, size = np.arange(len(y)) - row, np.searchsorted(y, y, "right") - row
    best, least = np.zeros(len(y), np.int64), np.full(len(y), -1, np.int64)
    step = 1 << int(size.max(initial=0)).bit_length()
    while step:
        at = np.flatnonzero(((rank + 1) % (2 * step) == step) & (first <= last))
        left, right = at - step, at + step
        low = np.where(rank[at] >= step, best[np.maximum(left, 0)], first[at])
        high = np.where(rank[at] + step < size[at], best[np.minimum(right, len(y) - 1)], last[at])
        n = high - low + 1
        starts = np.cumsum(n) - n
        if len(at):
            entry = np.arange(n.sum()) - np.repeat(starts - low, n)
            cost = (np.repeat(x[at], n) - ex[entry]) ** 2 + eg[entry]
            least[at] = np.minimum.reduceat(cost, starts)
            best[at] = np.minimum.reduceat(np.where(cost == np.repeat(least[at], n), entry, len(ex)), starts)
        step >>= 1
    return least


def distances(points: DataFrame, mask: DataFrame, most: int, keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """keys, x, y, distance of each different point to the nearest pixel of the mask with its keys, exact and at most most.

    Points without one are left out. Two passes: columns shrink to runs that know their rows; then a task takes ROWS rows
    of a scene, each with one entry a column, and finds the least sums along them. A task holds ROWS times the image's
    width, whatever the mask; the bands of a run outside the points' rows are not made.
    """
    band = lambda c: F.floor(c / ROWS).cast("int")
    spots = points.select(*keys, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct().withColumn("band", band(F.col("y")))
    span = spots.groupBy(*keys).agg(F.min("band").alias("_b1"), F.max("band").alias("_b2"))
    low, high = F.greatest("lo", F.col("y1") - most), F.least("hi", F.col("y2") + most)
    told = column_runs(mask, keys).withColumn("lo", low).withColumn("hi", high).join(span.hint("merge"), list(keys))
    told = told.withColumn("_b1", F.greatest("_b1", band(F.col("lo")))).withColumn("_b2", F.least("_b2", band(F.col("hi")))).where("_b1 <= _b2")
    parts = told.select(*keys, F.explode(F.sequence("_b1", "_b2")).alias("band"), "x", "y1", "y2", "lo", "hi")
    kinds = ", ".join(f"{c} {t}" for c, t in spots.dtypes if c in keys)

    def fold(asked: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or runs.empty:
            return asked.iloc[:0].drop(columns="band").assign(square=np.int64(0))
        asked = asked.sort_values(["y", "x"])
        top = int(asked["band"].iloc[0]) * ROWS
        x, y1, y2, lo, hi = (runs[c].to_numpy(np.int64) for c in ("x", "y1", "y2", "lo", "hi"))
        lo, hi = np.maximum(lo, top), np.minimum(hi, top + ROWS - 1)
        n = np.maximum(hi - lo + 1, 0)
        ey = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)
        ex, gap = np.repeat(x, n), np.maximum(np.maximum(np.repeat(y1, n) - ey, ey - np.repeat(y2, n)), 0)
        order = np.lexsort((ex, ey))
        least = row_minima(asked["y"].to_numpy(np.int64), asked["x"].to_numpy(np.int64), ey[order], ex[order], (gap * gap)[order])
        told = asked.drop(columns="band").assign(square=least)
        return told[(least >= 0) & (least <= most * most)]

    found = spots.groupBy(*keys, "band").cogroup(parts.groupBy(*keys, "band")).applyInPandas(fold, f"{kinds}, x int, y int, square long")
    return found.select(*keys, "x", "y", F.sqrt(F.col("square").cast("double")).alias("distance"))


def exact_clearance(points: DataFrame, mask: DataFrame, most: int) -> DataFrame:
    """As clearance, but without its cap up to a distance of most; points with nothing within most have null."""
    told = distances(points, mask, most).withColumnRenamed("distance", "clearance")
    return points.join(told, ["scene_id", "x", "y"], "left")


def dry_edge(mask: DataFrame, width: int, height: int) -> DataFrame:
    """The dry pixels of the image with a flooded one at a side."""
    from tidemesh.operators.masks import PIXEL, boundary, inside

    beside = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1)))))
    near = boundary(mask.select(*PIXEL)).select(*PIXEL, beside.alias("o")).select("scene_id", (F.col("x") + F.col("o.a")).alias("x"), (F.col("y") + F.col("o.b")).alias("y"))
    return inside(near, width, height).distinct().join(mask.select(*PIXEL).hint("merge"), PIXEL, "left_anti")


def signed_distance(points: DataFrame, mask: DataFrame, width: int, height: int) -> DataFrame:
    """points (scene_id, x, y, ...) with signed_distance: to the nearest flooded pixel, or less than 0, on flooded ground,
    to the nearest dry one. Null where the scene has no pixel of the other kind."""
    wet = mask.select("scene_id", "x", "y").distinct()
    sides = points.select("scene_id", "x", "y").distinct().join(wet.withColumn("wet", F.lit(True)).hint("merge"), ["scene_id", "x", "y"], "left").na.fill(False, ["wet"])
    other = wet.withColumn("wet", F.lit(False)).unionByName(dry_edge(wet, width, height).withColumn("wet", F.lit(True)))
    far = distances(sides.select("scene_id", "wet", "x", "y"), other, width + height, ("scene_id", "wet"))
    signed = F.when(F.col("wet"), -F.col("distance")).otherwise(F.col("distance"))
    return points.join(far.select("scene_id", "x", "y", signed.alias("signed_distance")), ["scene_id", "x", "y"], "left")
