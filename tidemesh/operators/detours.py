"""Detours: a leg that crosses another base's route bends round it; one leg of a scene gives way in a round.

Routes are point tables (see routes); the points of a detour have the kind `bend` and are no stops. Spark deals the legs
that cross by scene and brings them the scene's wet pixels; a group holds the crossing legs of one pair of bases.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemesh import defaults as D
from tidemesh.operators.common import stored
from tidemesh.operators.legs import Ground, image_at
from tidemesh.operators.routes import ROUTE, over_limit, sorties, touching

POINT = [*ROUTE, "seq", "x", "y", "kind"]
LEG = ["scene_id", "side", "base_id", "other", "leg"]
PATH = "scene_id long, side int, base_id long, other long, leg long, xs array<int>, ys array<int>"


def with_legs(points: DataFrame) -> DataFrame:
    """points with leg: the number (from 0) of the last stop at or before each point."""
    at = Window.partitionBy(*ROUTE).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("leg", F.sum((F.col("kind") != "bend").cast("int")).over(at) - 1)


def leg_lines(points: DataFrame) -> DataFrame:
    """scene_id, base_id, leg, line (its points with seq, both stops included), home (the route's first point) and px, the
    length of the route before the leg."""
    at = Window.partitionBy(*ROUTE).orderBy("seq")
    step = F.hypot((F.col("x") - F.lag("x").over(at)).cast("double"), (F.col("y") - F.lag("y").over(at)).cast("double"))
    told = with_legs(points).withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("_px", F.sum("_step").over(at))
    lines = told.groupBy(*ROUTE, "leg").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("ps"), F.min("_px").alias("px"))
    along = Window.partitionBy(*ROUTE).orderBy("leg")
    lines = lines.withColumn("goal", F.lead(F.col("ps")[0]).over(along)).withColumn("home", F.first(F.col("ps")[0]).over(along))
    return lines.where("goal IS NOT NULL").select(*ROUTE, "leg", F.concat("ps", F.array("goal")).alias("line"), "home", "px")


def crossing_legs(points: DataFrame, crossed: DataFrame) -> DataFrame:
    """The legs of both bases of each crossing, with the other base's legs that they cross (avoid).

    scene_id, side (0: base_a gives way, 1: base_b), base_id, other, leg, rank (its first crossing), line, home, px, avoid.
    """
    pair = F.struct("seg_a", "seg_b").alias("rank")
    a = crossed.select("scene_id", F.lit(0).alias("side"), F.col("base_a").alias("base_id"), F.col("base_b").alias("other"), F.col("seg_a").alias("seq"), F.col("seg_b").alias("_seq"), pair)
    b = crossed.select("scene_id", F.lit(1).alias("side"), F.col("base_b").alias("base_id"), F.col("base_a").alias("other"), F.col("seg_b").alias("seq"), F.col("seg_a").alias("_seq"), pair)
    numbered, lines = with_legs(points).select(*ROUTE, "seq", "leg"), leg_lines(points)
    told = a.union(b).join(numbered, [*ROUTE, "seq"]).join(numbered.select("scene_id", F.col("base_id").alias("other"), F.col("seq").alias("_seq"), F.col("leg").alias("_leg")), ["scene_id", "other", "_seq"])
    met = told.groupBy(*LEG, "_leg").agg(F.min("rank").alias("rank"))
    met = met.join(lines.select("scene_id", F.col("base_id").alias("other"), F.col("leg").alias("_leg"), F.col("line").alias("_line")), ["scene_id", "other", "_leg"])
    return met.groupBy(*LEG).agg(F.min("rank").alias("rank"), F.collect_list("_line").alias("avoid")).join(lines, [*ROUTE, "leg"])


def way_round(start: tuple[int, int], goal: tuple[int, int], home: tuple[int, int], avoid: list[list[tuple[int, int]]], ground: Ground) -> list[tuple[int, int]] | None:
    """The points between start and goal of a dry path that keeps a cell's distance to the lines, or else keeps off their
    cells; None without."""
    anchor, _ = ground.located(home, None)
    known = set(ground.costs(anchor)) if anchor else None
    (s, s_moved), (g, g_moved) = ground.located(start, known), ground.located(goal, known)
    if s is None or g is None or s == g or s not in ground.costs(g):
        return None
    taken = set()
    for line in avoid:
        for p, q in zip(line[:-1], line[1:], strict=True):
            share = np.linspace(0, 1, max(2, math.ceil(math.dist(p, q) / 2)))
            taken |= {ground.cell((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1]))) for t in share}
    free = ground.free
    for margin in (1, 0):
        ground.free = free.copy()
        for x, y in taken:
            ground.free[max(0, y - margin) : y + margin + 1, max(0, x - margin) : x + margin + 1] = False
        for x, y in (s, g):
            ground.free[y, x] = free[y, x]
        costs = ground.costs(g)
        if s in costs:
            cells = ground.path(s, costs)
            between = [ground.centre(c) for c in cells[0 if s_moved else 1 : len(cells) if g_moved else -1]]
            return None if ground.flooded([start, *between, goal]) else between
    return None


def ways(asked: DataFrame, wet: DataFrame, width: int, height: int, m_per_px: float, factor: int) -> DataFrame:
    """The legs (see crossing_legs) that have a way round, with its points xs, ys; ground is that of the arrival by a
    straight line."""
    spans = asked.select(F.col("scene_id").alias("scene")).distinct().join(wet.select(F.col("scene_id").alias("scene"), "x", "y", "t_from", "t_to").hint("merge"), "scene")

    def run(key: tuple, legs: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in legs.itertuples(index=False):
            line = [(p["x"], p["y"]) for p in r.line]
            hours = (r.px + math.dist(line[0], line[-1])) * m_per_px / D.SPEED_MPS / 3600
            avoid = [[(p["x"], p["y"]) for p in other] for other in r.avoid]
            got = way_round(line[0], line[-1], (r.home["x"], r.home["y"]), avoid, Ground(image_at(own, hours, width, height), factor))
            if got is not None:
                rows.append((r.scene_id, r.side, r.base_id, r.other, r.leg, [p[0] for p in got], [p[1] for p in got]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PATH.split(", ")])

    lean = asked.select(*LEG, "line", "home", "px", "avoid")
    return lean.groupBy("scene_id").cogroup(spans.groupBy("scene")).applyInPandas(run, PATH)


def detours(points: DataFrame, crossed: DataFrame, wet: DataFrame, wind: DataFrame, width: int, height: int, m_per_px: float, factor: int = 5, reserve: float = D.RESERVE) -> DataFrame:
    """The new route, as points, of the base that gives way in each scene of crossed where one can.

    crossed holds the crossings of one pair of bases a scene; base_a gives way before base_b, and a base's legs are tried
    by their first crossings. A detour counts if it is dry, leaves the reserve in every sortie, lessens the pair's
    crossings and meets no third base. wet has scene_id, x, y, t_from, t_to; scenes without a detour have no rows.
    """
    own = stored(points.join(crossed.select("scene_id").distinct(), "scene_id", "left_semi").select(*POINT), "crossing-routes")
    asked = stored(crossing_legs(own, crossed), "crossing-legs")
    number = F.row_number().over(Window.partitionBy("scene_id").orderBy("side", "rank")).cast("long")
    found = ways(asked, wet, width, height, m_per_px, factor).join(asked.select(*LEG, "rank", F.col("line")[0]["seq"].alias("_seq")), LEG)
    found = stored(found.withColumn("way", number), "ways")
    kept = found.select(*ROUTE, "way", F.col("leg").alias("_leg")).join(with_legs(own), ROUTE).where("kind <> 'bend' OR leg <> _leg")
    kept = kept.select("scene_id", "way", "seq", F.lit(-1).alias("pos"), "x", "y", "kind")
    bends = found.select("scene_id", "way", F.col("_seq").alias("seq"), F.posexplode(F.arrays_zip("xs", "ys"))).select("scene_id", "way", "seq", "pos", F.col("col.xs").alias("x"), F.col("col.ys").alias("y"), F.lit("bend").alias("kind"))
    seq = F.row_number().over(Window.partitionBy("scene_id", "way").orderBy("seq", "pos")) - 1
    tried = stored(kept.union(bends).select("scene_id", F.col("way").alias("base_id"), seq.alias("seq"), "x", "y", "kind"), "tried")
    dear = over_limit(sorties(tried, wind, m_per_px), reserve).select("scene_id", F.col("base_id").alias("way")).distinct()
    hits = touching(tried, own).withColumnRenamed("base_a", "way").join(found.select("scene_id", "way", "base_id", "other"), ["scene_id", "way"]).where("base_b <> base_id")
    hits = hits.groupBy("scene_id", "way").agg(F.count_if(F.col("base_b") == F.col("other")).alias("_now"), F.count_if(F.col("base_b") != F.col("other")).alias("_third"))
    told = found.join(dear, ["scene_id", "way"], "left_anti").join(hits, ["scene_id", "way"], "left").join(crossed.groupBy("scene_id").agg(F.count("*").alias("_before")), "scene_id")
    good = told.where("coalesce(_now, 0) < _before AND coalesce(_third, 0) = 0").groupBy("scene_id").agg(F.min(F.struct("way", "base_id")).alias("b"))
    return tried.withColumnRenamed("base_id", "way").join(good.select("scene_id", "b.way", "b.base_id"), ["scene_id", "way"]).select(*POINT)
