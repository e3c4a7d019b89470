"""Repair of crossing routes: sorties move to the other base, a leg bends, or a base moves a little; rounds over all scenes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemesh import defaults as D
from tidemesh.operators.common import stored
from tidemesh.operators.regions import clearance
from tidemesh.operators.routes import crossings, touching
from tidemesh.operators.sites import apart, reach


def first_pairs(crossed: DataFrame) -> DataFrame:
    """The crossings of each scene's first pair of bases."""
    first = crossed.groupBy("scene_id").agg(F.min(F.struct("base_a", "base_b")).alias("p")).select("scene_id", "p.base_a", "p.base_b")
    return crossed.join(first, ["scene_id", "base_a", "base_b"])


def movable(crossed: DataFrame, points: DataFrame, assigned: DataFrame, drops: DataFrame, reached: DataFrame) -> DataFrame:
    """scene_id, source, target, drop_ids: per scene the smallest sortie on a crossing that the other base can take.

    Drops that share a point move together. Ties go to the smaller drop ids, then the smaller source.
    """
    at = Window.partitionBy("scene_id", "base_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    told = points.withColumn("sortie", F.coalesce(F.sum((F.col("kind") == "reload").cast("int")).over(at), F.lit(0)))
    a = crossed.select("scene_id", F.col("base_a").alias("source"), F.col("base_b").alias("target"), F.col("seg_a").alias("seq"))
    b = crossed.select("scene_id", F.col("base_b").alias("source"), F.col("base_a").alias("target"), F.col("seg_b").alias("seq"))
    hit = a.union(b).join(told.select("scene_id", F.col("base_id").alias("source"), "seq", "sortie"), ["scene_id", "source", "seq"]).select("scene_id", "source", "target", "sortie").distinct()
    own = drops.join(assigned.select("scene_id", "drop_id", F.col("base_id").alias("source")), ["scene_id", "drop_id"])
    stops = told.where("kind = 'drop'").select("scene_id", F.col("base_id").alias("source"), "sortie", "x", "y").distinct()
    moved = hit.join(stops, ["scene_id", "source", "sortie"]).join(own, ["scene_id", "source", "x", "y"]).select("scene_id", "source", "target", "sortie", "drop_id").distinct()
    able = moved.join(reached.select("scene_id", F.col("cand_id").alias("target"), "drop_id", F.lit(1).alias("_r")), ["scene_id", "target", "drop_id"], "left")
    whole = able.groupBy("scene_id", "source", "target", "sortie").agg(F.count("*").alias("n"), F.count("_r").alias("m"), F.sort_array(F.collect_list("drop_id")).alias("drop_ids")).where("n = m")
    return whole.groupBy("scene_id").agg(F.min(F.struct("n", "drop_ids", "source", "target")).alias("b")).select("scene_id", "b.source", "b.target", "b.drop_ids")


def nudges(sites: DataFrame, others: DataFrame, drops: DataFrame, mask: DataFrame, wind: DataFrame, m_per_px: float, width: int, height: int, most: int = 50, step: int = 5, separation: float = D.SEPARATION) -> DataFrame:
    """scene_id, cand_id, x, y, moved2: places near each site that are clear, apart, and reach all its drops.

    sites has scene_id, cand_id, x, y; others the other bases; drops scene_id, base_id, drop_id, x, y. Nearest first by
    moved2, the squared move.
    """
    ring = F.sequence(F.lit(-most), F.lit(most), F.lit(step))
    spots = sites.select("scene_id", "cand_id", F.col("x").alias("hx"), F.col("y").alias("hy"), F.explode(ring).alias("dx")).withColumn("dy", F.explode(ring))
    spots = spots.where(f"(dx <> 0 OR dy <> 0) AND dx * dx + dy * dy <= {most * most}").selectExpr("scene_id", "cand_id", "cast(hx + dx AS int) AS x", "cast(hy + dy AS int) AS y", "dx * dx + dy * dy AS moved2").where(f"x BETWEEN 0 AND {width - 1} AND y BETWEEN 0 AND {height - 1}")
    clear = clearance(spots, mask, int(D.CLEARANCE) + 1).where(F.col("clearance") >= D.CLEARANCE).drop("clearance")
    clear = stored(apart(clear, others, separation).withColumn("spot_id", F.monotonically_increasing_id()), "spots")
    # a place that reaches a base's farthest drop reaches all, so a place is one pair, however many drops there are
    mine = drops.groupBy("scene_id", F.col("base_id").alias("cand_id")).agg(F.collect_list(F.struct("x", "y")).alias("ps"))
    away = F.transform("ps", lambda p: F.hypot((p["x"] - F.col("x")).cast("double"), (p["y"] - F.col("y")).cast("double")))
    pairs = clear.join(mine.hint("merge"), ["scene_id", "cand_id"]).select("scene_id", F.col("spot_id").alias("cand_id"), F.lit(0).alias("drop_id"), (F.array_max(away) * m_per_px).alias("distance_m"))
    able = reach(clear, drops, wind, m_per_px, distances=pairs).select("scene_id", F.col("cand_id").alias("spot_id"))
    return clear.join(able.hint("merge"), ["scene_id", "spot_id"], "left_semi").drop("spot_id")


def moved_bases(crossed: DataFrame, points: DataFrame, assigned: DataFrame, drops: DataFrame, homes: DataFrame, replan: Callable[[DataFrame, DataFrame], DataFrame], nudge: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(homes, routes) of the base that moves in each scene of crossed where one can: scene_id, base_id, x, y, and points.

    crossed holds the crossings of one pair of bases a scene; base_a moves before base_b, each to its nearest place (ties
    to the smaller x, then y) from where its new route meets no other base's. nudge maps sites, the other bases and
    the sites' drops to places (see nudges).
    """
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("base_a").alias("base_id")), F.struct(F.lit(1).alias("side"), F.col("base_b").alias("base_id"))))
    pair = stored(crossed.select("scene_id", sides.alias("o")).select("scene_id", "o.side", "o.base_id").distinct(), "pair")
    keys = pair.select("scene_id", "base_id")
    as_site = lambda df: df.select("scene_id", F.col("base_id").alias("cand_id"), "x", "y")
    standing = homes.join(points.select("scene_id", "base_id").distinct(), ["scene_id", "base_id"], "left_semi")
    mine = stored(assigned.join(keys, ["scene_id", "base_id"]).join(drops.select("scene_id", "drop_id", "x", "y"), ["scene_id", "drop_id"]), "mine")
    spots = nudge(as_site(homes.join(keys, ["scene_id", "base_id"])), as_site(standing), mine)
    number = F.row_number().over(Window.partitionBy("scene_id").orderBy("side", "moved2", "x", "y")).cast("long")
    spots = spots.select("scene_id", F.col("cand_id").alias("base_id"), "x", "y", "moved2").join(pair, ["scene_id", "base_id"])
    spots = stored(spots.withColumn("spot", number), "spots")
    stops = mine.join(spots.select("scene_id", "base_id", "spot"), ["scene_id", "base_id"]).select("scene_id", "drop_id", F.col("spot").alias("base_id"))
    tried = stored(replan(stops, spots.select("scene_id", F.col("spot").alias("base_id"), "x", "y")), "tried").withColumnRenamed("base_id", "spot")
    hits = touching(tried.withColumnRenamed("spot", "base_id"), points).withColumnRenamed("base_a", "spot")
    bad = hits.join(spots.select("scene_id", "spot", "base_id"), ["scene_id", "spot"]).where("base_b <> base_id").select("scene_id", "spot")
    good = spots.join(tried.select("scene_id", "spot").distinct(), ["scene_id", "spot"], "left_semi").join(bad, ["scene_id", "spot"], "left_anti")
    best = stored(good.groupBy("scene_id").agg(F.min(F.struct("spot", "base_id", "x", "y")).alias("b")).select("scene_id", "b.*"), "moved")
    return best.select("scene_id", "base_id", "x", "y"), tried.join(best.select("scene_id", "spot", "base_id"), ["scene_id", "spot"]).select(*points.columns)


def repair(assigned: DataFrame, drops: DataFrame, reached: DataFrame, replan: Callable[..., DataFrame], rounds: int = 5, homes: DataFrame | None = None, reroute: Callable[[DataFrame, DataFrame], DataFrame] | None = None, nudge: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] | None = None, reach_of: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assigned, routes, unresolved) after at most `rounds` rounds of taking routes off each other.

    A round takes each scene's first crossing pair: a sortie moves to the other base where that reaches it; else, with
    reroute (points and crossings to new routes, see detours), a leg bends; else, with homes and nudge, a base moves, and
    reach_of gives what it reaches from there. Scenes where nothing helps stay as they are. replan maps an assignment,
    and homes (scene_id, base_id, x, y) where they are given, to route points. unresolved are the crossings left.
    """
    plan = lambda a: (replan(a) if homes is None else replan(a, homes)).select(*columns)
    columns = ["scene_id", "base_id", "seq", "x", "y", "kind"]
    both = ["scene_id", "base_id"]
    assigned = stored(assigned.select("scene_id", "drop_id", "base_id"), "assigned")
    points, stuck = stored(plan(assigned), "routes"), None
    for _ in range(rounds):
        open_ = crossings(points)
        crossed = stored(first_pairs(open_ if stuck is None else open_.join(stuck, "scene_id", "left_anti")), "crossed")
        if crossed.isEmpty():
            break
        moves = stored(movable(crossed, points, assigned, drops, reached), "moves")
        told = assigned.join(moves.select("scene_id", "target", F.explode("drop_ids").alias("drop_id")), ["scene_id", "drop_id"], "left")
        assigned = stored(told.select("scene_id", "drop_id", F.coalesce("target", "base_id").alias("base_id")), "assigned")
        touched = stored(moves.select("scene_id", F.explode(F.array("source", "target")).alias("base_id")), "touched")
        changed = stored(plan(assigned.join(touched, both, "left_semi")), "fresh")
        left = stored(crossed.join(moves.select("scene_id"), "scene_id", "left_anti"), "left")
        if reroute is not None and not left.isEmpty():
            bent = stored(reroute(points, left).select(*columns), "bent")
            changed, touched = changed.union(bent), touched.union(bent.select(*both).distinct())
            left = stored(left.join(bent.select("scene_id").distinct(), "scene_id", "left_anti"), "left")
        if nudge is not None and homes is not None and not left.isEmpty():
            moved, fresh = moved_bases(left, points, assigned, drops, homes, replan, nudge)
            homes = stored(homes.select(*both, "x", "y").join(moved, both, "left_anti").union(moved), "homes")
            if reach_of is not None:
                sites = moved.select("scene_id", F.col("base_id").alias("cand_id"), "x", "y")
                old = reached.join(sites, ["scene_id", "cand_id"], "left_anti").select("scene_id", "cand_id", "drop_id")
                reached = stored(old.union(reach_of(sites).select("scene_id", "cand_id", "drop_id")), "reach")
            changed, touched = changed.union(fresh.select(*columns)), touched.union(moved.select(*both))
            left = stored(left.join(moved.select("scene_id"), "scene_id", "left_anti"), "left")
        gone = left.select("scene_id").distinct()
        stuck = gone if stuck is None else stuck.union(gone)
        points = stored(points.join(touched, both, "left_anti").union(changed), "routes")
    return assigned, points, crossings(points)
