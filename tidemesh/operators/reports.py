"""Reports on plans: stage counts, leg states, territories, exclusions and map sanity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemesh.operators.grid import nearest_source


def leg_status(legs: DataFrame, cells: DataFrame) -> DataFrame:
    """legs with status: same_cell, routed, or fallback with its reason.

    legs has scene_id, base_id, leg, and start and goal cells (sx, sy, gx, gy); cells the free cells with component.
    """
    c = cells.select("scene_id", "cx", "cy", "component")
    told = legs.join(c.select("scene_id", F.col("cx").alias("sx"), F.col("cy").alias("sy"), F.col("component").alias("_s")), ["scene_id", "sx", "sy"], "left")
    told = told.join(c.select("scene_id", F.col("cx").alias("gx"), F.col("cy").alias("gy"), F.col("component").alias("_g")), ["scene_id", "gx", "gy"], "left")
    same = (F.col("sx") == F.col("gx")) & (F.col("sy") == F.col("gy"))
    reason = F.when(F.col("_s").isNull(), "start blocked").when(F.col("_g").isNull(), "goal blocked").when(F.col("_s") != F.col("_g"), "not connected")
    status = F.when(same & F.col("_s").isNotNull(), "same_cell").when(reason.isNull(), "routed").otherwise("fallback")
    return told.withColumn("status", status).withColumn("reason", F.when(F.col("status") == "fallback", reason)).drop("_s", "_g")


def leg_counts(legs: DataFrame) -> DataFrame:
    """scene_id, base_id and the number of legs of each status."""
    return legs.groupBy("scene_id", "base_id").pivot("status", ["same_cell", "routed", "fallback"]).count().na.fill(0)


def attach_routed(legs: DataFrame, by_leg: DataFrame, by_drop: DataFrame) -> DataFrame:
    """legs (scene_id, base_id, from_id, to_id, straight_m) with distance_m: of the leg, else of its drop, else straight."""
    told = legs.join(by_leg.select("scene_id", "base_id", "from_id", "to_id", F.col("distance_m").alias("_leg")), ["scene_id", "base_id", "from_id", "to_id"], "left")
    told = told.join(by_drop.select("scene_id", "base_id", F.col("drop_id").alias("to_id"), F.col("distance_m").alias("_drop")), ["scene_id", "base_id", "to_id"], "left")
    return told.withColumn("distance_m", F.coalesce("_leg", "_drop", "straight_m")).drop("_leg", "_drop")


def territories(sources: DataFrame, free: DataFrame) -> DataFrame:
    """scene_id, cx, cy, base_id: the base whose sources (scene_id, source_id, cx, cy) are nearest, ties to the smaller."""
    return nearest_source(sources, free).select("scene_id", "cx", "cy", F.col("source_id").alias("base_id"))


def territory_violations(territory: DataFrame, drops: DataFrame) -> DataFrame:
    """Assigned drops (scene_id, drop_id, base_id, cx, cy) whose cell belongs to another base, or to none (-1)."""
    told = drops.join(territory.withColumnRenamed("base_id", "owner").hint("merge"), ["scene_id", "cx", "cy"], "left")
    return told.withColumn("owner", F.coalesce("owner", F.lit(-1))).where("owner <> base_id").select("scene_id", "drop_id", "base_id", "owner")


def not_planned(assigned: DataFrame, routes: DataFrame) -> DataFrame:
    """Assigned drops whose base has no route."""
    return assigned.join(routes.select("scene_id", "base_id").distinct(), ["scene_id", "base_id"], "left_anti").select("scene_id", "drop_id", "base_id", F.lit("base has no route").alias("reason"))


def stage_counts(drops: DataFrame, reached: DataFrame, assigned: DataFrame, delivered: DataFrame) -> DataFrame:
    """scene_id (null: all) and how many drops stand, are coverable, assigned and delivered (a rollup over scenes)."""
    flag = lambda df, name: df.select("scene_id", "drop_id").distinct().withColumn(name, F.lit(1))
    told = drops.select("scene_id", "drop_id")
    for df, name in ((reached, "coverable"), (assigned, "assigned"), (delivered, "delivered")):
        told = told.join(flag(df, name), ["scene_id", "drop_id"], "left")
    return told.rollup("scene_id").agg(F.count("*").alias("drops"), *(F.count(c).alias(c) for c in ("coverable", "assigned", "delivered")))


def outcomes(summary: DataFrame, crossings: DataFrame) -> DataFrame:
    """scene_id and outcome: none, single, multi_k, or unresolved where routes still cross.

    summary has scene_id, mode and n_bases.
    """
    left = crossings.groupBy("scene_id").agg(F.count("*").alias("_c"))
    told = summary.join(left, "scene_id", "left")
    name = F.when(F.coalesce(F.col("_c"), F.lit(0)) > 0, "unresolved").when(F.col("mode") == "multi", F.concat(F.lit("multi_"), F.col("n_bases"))).otherwise(F.col("mode"))
    return told.select("scene_id", name.alias("outcome"))


def near_regions(drops: DataFrame, boundary: DataFrame, most: int = 25) -> DataFrame:
    """The drops within `most` pixels of a region's boundary pixel; both sides meet in tiles of that size."""
    tile = lambda c: F.floor(F.col(c) / most)
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    asked = drops.withColumn("o", F.explode(around)).withColumn("tx", tile("x") + F.col("o.a")).withColumn("ty", tile("y") + F.col("o.b"))
    stock = boundary.select("scene_id", F.col("x").alias("_x"), F.col("y").alias("_y")).withColumn("tx", F.floor(F.col("_x") / most)).withColumn("ty", F.floor(F.col("_y") / most))
    near = (F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y")) <= most * most
    return asked.join(stock.hint("merge"), ["scene_id", "tx", "ty"]).where(near).select(*drops.columns).distinct()


def shared_points(drops: DataFrame) -> DataFrame:
    """scene_id, x, y, drop_ids of the points that several drops share."""
    return drops.groupBy("scene_id", "x", "y").agg(F.sort_array(F.collect_set("drop_id")).alias("drop_ids")).where("size(drop_ids) > 1")


def leg_of_segment(segments: DataFrame, stops: DataFrame) -> DataFrame:
    """segments (scene_id, base_id, seg) with leg: the last stop at or before the segment; the first leg is 0.

    stops has scene_id, base_id, leg, seq (the point where a leg starts).
    """
    from pyspark.sql import Window

    both = segments.select("scene_id", "base_id", F.col("seg").alias("at"), F.lit(1).alias("k"), F.lit(None).cast("int").alias("leg")).union(stops.select("scene_id", "base_id", F.col("seq").alias("at"), F.lit(0).alias("k"), F.col("leg").cast("int")))
    w = Window.partitionBy("scene_id", "base_id").orderBy("at", "k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("leg", F.coalesce(F.max("leg").over(w), F.lit(0))).where("k = 1").select("scene_id", "base_id", F.col("at").alias("seg"), "leg")


def map_sanity(pixels: DataFrame) -> DataFrame:
    """scene_id, dominant, correlation, unchanged and ok for two rasters of a scene.

    pixels has b, g, r and b2, g2, r2. ok: no colour of the second above half, grey values correlated 0.5 or more.
    """
    grey = lambda s: F.col(f"b{s}") * 0.114 + F.col(f"g{s}") * 0.587 + F.col(f"r{s}") * 0.299
    top = pixels.groupBy("scene_id", "b2", "g2", "r2").agg(F.count("*").alias("n")).groupBy("scene_id").agg((F.max("n") / F.sum("n")).alias("dominant"))
    same = ((F.col("b") == F.col("b2")) & (F.col("g") == F.col("g2")) & (F.col("r") == F.col("r2"))).cast("int")
    told = pixels.groupBy("scene_id").agg(F.corr(grey(""), grey("2")).alias("correlation"), F.avg(same).alias("unchanged")).join(top, "scene_id")
    return told.withColumn("ok", (F.col("dominant") <= 0.5) & (F.coalesce(F.col("correlation"), F.lit(0.0)) >= 0.5))


def within_reach(moved: DataFrame, reached: DataFrame) -> DataFrame:
    """scene_id, base_id, sortie, fits: whether another base reaches all drops of a sortie.

    moved has scene_id, base_id (the other base), sortie, drop_id; reached scene_id, cand_id, drop_id.
    """
    hit = reached.select("scene_id", F.col("cand_id").alias("base_id"), "drop_id", F.lit(1).alias("_h"))
    told = moved.join(hit, ["scene_id", "base_id", "drop_id"], "left")
    return told.groupBy("scene_id", "base_id", "sortie").agg((F.count("*") == F.count("_h")).alias("fits"))


def conflict_cells(points: DataFrame, legs: DataFrame, width: int, height: int) -> DataFrame:
    """scene_id, leg, cx, cy, exact: the cells that a leg must leave when it gives way, and those beside them.

    points has scene_id, leg, cx, cy of the other routes' shared points; legs scene_id, leg and the cells sx, sy, gx, gy
    where a leg starts and ends, which are never given up. exact marks the points' own cells.
    """
    near = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    cells = points.select("scene_id", "leg", F.col("cx").alias("_x"), F.col("cy").alias("_y"), F.explode(near).alias("o"))
    cells = cells.select("scene_id", "leg", (F.col("_x") + F.col("o.a")).alias("cx"), (F.col("_y") + F.col("o.b")).alias("cy"), ((F.col("o.a") == 0) & (F.col("o.b") == 0)).alias("exact"))
    inside = cells.where(F.col("cx").between(0, width - 1) & F.col("cy").between(0, height - 1)).groupBy("scene_id", "leg", "cx", "cy").agg(F.bool_or("exact").alias("exact"))
    told = inside.join(legs, ["scene_id", "leg"])
    end = lambda x, y: (F.col("cx") == F.col(x)) & (F.col("cy") == F.col(y))
    return told.where(~(end("sx", "sy") | end("gx", "gy"))).select("scene_id", "leg", "cx", "cy", "exact")
