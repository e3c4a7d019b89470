"""Reach, assignment and choice of launch sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemesh import defaults as D
from tidemesh.functions.flight import leg_battery, wind_mps
from tidemesh.operators.common import stored


def reach(candidates: DataFrame, drops: DataFrame, wind: DataFrame, m_per_px: float, distances: DataFrame | None = None, reserve: float = D.RESERVE) -> DataFrame:
    """scene_id, cand_id, drop_id, distance_m of the drops that a candidate serves alone, there and back.

    wind has scene_id and wind_speed_10m (km/h), which blows against both legs; a scene without has calm. distances
    (scene_id, cand_id, drop_id, distance_m) gives routed distances, a pair without a row being unreachable; without
    it they are straight. Both sides meet within tiles of the largest range that any battery allows, so far pairs are
    never made.
    """
    speed = wind_mps(F.coalesce(F.col("wind_speed_10m"), F.lit(0.0)))
    need = leg_battery(F.col("distance_m"), F.lit(D.PER_DROP_KG), speed) + leg_battery(F.col("distance_m"), F.lit(0.0), speed)
    if distances is None:
        most = (1 - reserve) * D.ENDURANCE_MIN * 60 * D.SPEED_MPS / 2 / m_per_px
        size = max(1, int(most) + 1)
        tile = lambda c: F.floor(F.col(c) / size)
        own = candidates.select("scene_id", "cand_id", F.col("x").alias("cx"), F.col("y").alias("cy"), F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))).alias("o"), tile("x").alias("tx"), tile("y").alias("ty"))
        own = own.select("scene_id", "cand_id", "cx", "cy", (F.col("tx") + F.col("o.a")).alias("tx"), (F.col("ty") + F.col("o.b")).alias("ty"))
        other = drops.select("scene_id", "drop_id", "x", "y", tile("x").alias("tx"), tile("y").alias("ty"))
        distances = own.join(other, ["scene_id", "tx", "ty"]).select("scene_id", "cand_id", "drop_id", (F.hypot((F.col("x") - F.col("cx")).cast("double"), (F.col("y") - F.col("cy")).cast("double")) * m_per_px).alias("distance_m"))
    told = distances.join(wind.select("scene_id", "wind_speed_10m"), "scene_id", "left")
    return told.where(need <= 1 - reserve).select("scene_id", "cand_id", "drop_id", "distance_m")


def assign(reached: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """scene_id, drop_id, base_id, distance_m: each drop's nearest base that reaches it, ties to the smaller id."""
    if chosen is not None:
        reached = reached.join(chosen.select("scene_id", "cand_id"), ["scene_id", "cand_id"], "left_semi")
    best = reached.groupBy("scene_id", "drop_id").agg(F.min(F.struct("distance_m", "cand_id")).alias("b"))
    return best.select("scene_id", "drop_id", F.col("b.cand_id").alias("base_id"), F.col("b.distance_m").alias("distance_m"))


def reach_summary(reached: DataFrame, drops: DataFrame) -> DataFrame:
    """scene_id, n_drops, coverable, best_single (most drops of one candidate) and mode (none, single, multi)."""
    single = reached.groupBy("scene_id", "cand_id").agg(F.count("*").alias("n")).groupBy("scene_id").agg(F.max("n").alias("best_single"))
    some = reached.select("scene_id", "drop_id").distinct().groupBy("scene_id").agg(F.count("*").alias("coverable"))
    told = drops.groupBy("scene_id").agg(F.count("*").alias("n_drops")).join(some, "scene_id", "left").join(single, "scene_id", "left")
    told = told.withColumn("coverable", F.coalesce("coverable", F.lit(0))).withColumn("best_single", F.coalesce("best_single", F.lit(0)))
    return told.withColumn("mode", F.when(F.col("coverable") == 0, "none").when(F.col("best_single") == F.col("coverable"), "single").otherwise("multi"))


def apart(sites: DataFrame, chosen: DataFrame, least: float = D.SEPARATION) -> DataFrame:
    """The sites that lie `least` pixels or more from every other chosen site of their scene (chosen are few)."""
    others = chosen.select("scene_id", F.col("cand_id").alias("_id"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    near = (F.col("cand_id") != F.col("_id")) & (F.hypot((F.col("x") - F.col("_x")).cast("double"), (F.col("y") - F.col("_y")).cast("double")) < least)
    return sites.join(others, (sites["scene_id"] == others["scene_id"]) & near, "left_anti")


def greedy_bases(candidates: DataFrame, reached: DataFrame, most: int = D.MAX_BASES, separation: float = D.SEPARATION, chosen: DataFrame | None = None) -> DataFrame:
    """scene_id, rank, cand_id, x, y, gain: greedy cover of all scenes at once, `most` rounds.

    chosen (scene_id, cand_id, x, y) are bases that stand already: they take their places, drops and ranks, and what is
    returned is added to them.

    A round takes in every scene the separated candidate that serves most uncovered drops, then the least total
    distance to them, then the smallest id; scenes without such a candidate are done.
    """
    open_drops, left = stored(reached, "reach"), candidates.select("scene_id", "cand_id", "x", "y")
    picked = room = None
    if chosen is not None:
        room = chosen.groupBy("scene_id").agg(F.count("*").cast("int").alias("_n"))
        taken = open_drops.join(chosen.select("scene_id", "cand_id"), ["scene_id", "cand_id"], "left_semi").select("scene_id", "drop_id").distinct()
        open_drops = stored(open_drops.join(taken, ["scene_id", "drop_id"], "left_anti"), "open")
        left = stored(apart(left.join(chosen.select("scene_id", "cand_id"), ["scene_id", "cand_id"], "left_anti"), chosen, separation), "left")
    for rank in range(most):
        gain = open_drops.groupBy("scene_id", "cand_id").agg(F.count("*").alias("gain"), F.sum("distance_m").alias("cost"))
        ranked = left.join(gain, ["scene_id", "cand_id"])
        best = ranked.groupBy("scene_id").agg(F.max_by(F.struct("cand_id", "x", "y", "gain"), F.struct("gain", -F.round("cost", 6), -F.col("cand_id"))).alias("b"))
        best = best.select("scene_id", F.lit(rank).alias("rank"), "b.*")
        if room is not None:
            best = best.join(room, "scene_id", "left").withColumn("rank", F.col("rank") + F.coalesce("_n", F.lit(0))).where(F.col("rank") < most).drop("_n")
        now = stored(best, "picked")
        if now.isEmpty():
            break
        picked = now if picked is None else picked.union(now)
        served = open_drops.join(now.select("scene_id", "cand_id"), ["scene_id", "cand_id"], "left_semi").select("scene_id", "drop_id")
        open_drops = stored(open_drops.join(served, ["scene_id", "drop_id"], "left_anti"), "open")
        fresh = left.join(now.select("scene_id", "cand_id"), ["scene_id", "cand_id"], "left_anti")
        left = stored(apart(fresh, now, separation), "left")
    return picked if picked is not None else left.select("scene_id", F.lit(0).alias("rank"), "cand_id", "x", "y", F.lit(0).cast("long").alias("gain")).limit(0)


def unserved(drops: DataFrame, reached: DataFrame, assigned: DataFrame, n_bases: DataFrame, most: int = D.MAX_BASES) -> DataFrame:
    """scene_id, drop_id, reason of every drop without a base: battery, base cap or separation."""
    some = reached.select("scene_id", "drop_id").distinct().withColumn("_r", F.lit(True))
    told = drops.join(assigned, ["scene_id", "drop_id"], "left_anti").join(some, ["scene_id", "drop_id"], "left").join(n_bases, "scene_id", "left")
    reason = F.when(F.col("_r").isNull(), "battery").when(F.coalesce(F.col("n_bases"), F.lit(0)) >= most, "base cap").otherwise("separation")
    return told.select("scene_id", "drop_id", reason.alias("reason"))


def least_separation(chosen: DataFrame) -> DataFrame:
    """scene_id, separation: the least distance between two chosen sites; scenes with one have no row."""
    a, b = chosen.alias("a"), chosen.alias("b")
    pairs = a.join(b, (F.col("a.scene_id") == F.col("b.scene_id")) & (F.col("a.cand_id") < F.col("b.cand_id")))
    return pairs.groupBy(F.col("a.scene_id").alias("scene_id")).agg(F.min(F.hypot((F.col("a.x") - F.col("b.x")).cast("double"), (F.col("a.y") - F.col("b.y")).cast("double"))).alias("separation"))


def home_of(drops: DataFrame, width: int, height: int) -> DataFrame:
    """scene_id, drop_id, x, y of the drop nearest the image's centre, ties to the smaller id."""
    d2 = (F.col("x") - width // 2) * (F.col("x") - width // 2) + (F.col("y") - height // 2) * (F.col("y") - height // 2)
    return drops.groupBy("scene_id").agg(F.min_by(F.struct("drop_id", "x", "y"), F.struct(d2, "drop_id")).alias("b")).select("scene_id", "b.*")


def visit_order(stops: DataFrame, home: DataFrame) -> DataFrame:
    """scene_id, base_id, seq, drop_id, x, y: nearest neighbour first from home, ties to the smaller id.

    stops has scene_id, base_id, drop_id, x, y; home scene_id, base_id, x, y. A base's stops (some dozens) are one
    array that SQL's aggregate() walks.
    """
    arrays = stops.groupBy("scene_id", "base_id").agg(F.sort_array(F.collect_list(F.struct("drop_id", "x", "y"))).alias("ps"))
    joined = arrays.join(home.select("scene_id", "base_id", F.col("x").alias("hx"), F.col("y").alias("hy")), ["scene_id", "base_id"])
    walked = joined.selectExpr(
        "scene_id", "base_id",
        """aggregate(sequence(1, size(ps)),
             named_struct('x', hx, 'y', hy, 'left', ps, 'done', cast(array() AS array<struct<drop_id:bigint,x:int,y:int>>)),
             (s, i) -> aggregate(array(array_min(transform(s.left, p -> named_struct('d', (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y), 'drop_id', p.drop_id, 'x', p.x, 'y', p.y)))),
               s, (t, n) -> named_struct('x', n.x, 'y', n.y, 'left', filter(t.left, p -> p.drop_id <> n.drop_id),
                 'done', concat(t.done, array(named_struct('drop_id', n.drop_id, 'x', n.x, 'y', n.y))))),
             s -> s.done) AS done""",
    )
    return walked.select("scene_id", "base_id", F.posexplode("done")).select("scene_id", "base_id", (F.col("pos") + 1).alias("seq"), "col.drop_id", "col.x", "col.y")


def batches(order: DataFrame, per_load: int) -> DataFrame:
    """order with load: the sortie (from 0) of each stop by payload alone."""
    at = Window.partitionBy("scene_id", "base_id").orderBy("seq")
    return order.withColumn("load", ((F.row_number().over(at) - 1) / per_load).cast("int"))
