"""Choice of launch sites by the cost of the sorties they would fly, and re-placement of chosen sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemesh import defaults as D
from tidemesh.functions.flight import drops_per_load, headwind, leg_battery, wind_mps
from tidemesh.operators.common import let, stored
from tidemesh.operators.sites import apart, assign, greedy_bases


def nearest_order(ps: Column, x: Column, y: Column) -> Column:
    """The array ps (structs with x, y) from (x, y) on, always to the nearest of those left, the first of equals."""
    square = lambda p, s: (p["x"] - s["x"]) * (p["x"] - s["x"]) + (p["y"] - s["y"]) * (p["y"] - s["y"])
    start = F.struct(ps.alias("left"), x.alias("x"), y.alias("y"), F.filter(ps, lambda _: F.lit(False)).alias("order"))

    def step(s: Column, _: Column) -> Column:
        nearest = F.array_min(F.transform(s["left"], lambda p, i: F.struct(square(p, s).alias("d"), i.alias("i"), p.alias("p"))))
        return let(nearest, lambda b: F.struct(F.filter(s["left"], lambda _, i: i != b["i"]).alias("left"), b["p"]["x"].alias("x"), b["p"]["y"].alias("y"), F.concat(s["order"], F.array(b["p"])).alias("order")))

    return F.aggregate(ps, start, step, lambda s: s["order"])


def sortie_totals(order: Column, x: Column, y: Column, wind: Column, wind_from: Column, scale: float, reserve: float = D.RESERVE) -> Column:
    """Struct (metres, battery, worst, unserved) of flying to the stops of an array in its order, from (x, y) and back.

    A sortie takes the next stop if with it and the way back it leaves the reserve; else it closes and the next starts
    with that stop. A stop that fails alone counts as unserved, at two of its legs. Each stop taken adds its load to all
    legs before it, so the state holds the way out, its metres and what closing now would take; no sortie is flown twice.
    """
    kg, none = F.lit(D.PER_DROP_KG), F.lit(0.0)

    def flown(ax: Column, ay: Column, bx: Column, by: Column, load: Column) -> tuple[Column, Column]:
        dx, dy = (bx - ax).cast("double"), (by - ay).cast("double")
        metres = F.hypot(dx, dy) * scale
        return metres, leg_battery(metres, load, headwind(dx, dy, wind, wind_from))

    def step(s: Column, p: Column) -> Column:
        direct, alone = flown(x, y, p["x"], p["y"], kg)
        _, home = flown(p["x"], p["y"], x, y, none)
        leg, used = flown(s["x"], s["y"], p["x"], p["y"], kg)
        more = s["out"] + leg_battery(s["long"], kg, none) - leg_battery(s["long"], none, none) + used
        flights = F.struct(direct.alias("direct"), alone.alias("alone"), home.alias("home"), leg.alias("leg"), more.alias("more"))

        def told(v: Column) -> Column:
            joins = (s["n"] > 0) & (s["n"] < drops_per_load()) & (v["more"] + v["home"] <= 1 - reserve)
            fits = v["alone"] + v["home"] <= 1 - reserve
            pick = lambda joined, first, lost: F.when(joins, joined).when(fits, first).otherwise(lost)
            back = v["alone"] + v["home"]
            return F.struct(
                pick(v["more"], v["alone"], none).alias("out"), pick(s["long"] + v["leg"], v["direct"], none).alias("long"), pick(s["n"] + 1, F.lit(1), F.lit(0)).alias("n"),
                p["x"].alias("x"), p["y"].alias("y"),
                pick(v["more"] + v["home"], back, none).alias("shut"), pick(s["long"] + v["leg"] + v["direct"], 2 * v["direct"], none).alias("far"),
                (s["metres"] + pick(none, s["far"], s["far"] + 2 * v["direct"])).alias("metres"),
                (s["battery"] + pick(none, s["shut"], s["shut"] + back)).alias("battery"),
                F.greatest(s["worst"], pick(none, s["shut"], F.greatest(s["shut"], back))).alias("worst"),
                (s["unserved"] + pick(F.lit(0), F.lit(0), F.lit(1))).alias("unserved"),
            )

        return let(flights, told)

    zero = F.struct(none.alias("out"), none.alias("long"), F.lit(0).alias("n"), x.alias("x"), y.alias("y"), *(none.alias(c) for c in ("shut", "far", "metres", "battery", "worst")), F.lit(0).alias("unserved"))
    return F.aggregate(order, zero, step, lambda s: F.struct((s["metres"] + s["far"]).alias("metres"), (s["battery"] + s["shut"]).alias("battery"), F.greatest(s["worst"], s["shut"]).alias("worst"), s["unserved"].cast("long").alias("unserved")))


def score_sites(pairs: DataFrame, drops: DataFrame, wind: DataFrame, m_per_px: float) -> DataFrame:
    """pairs (scene_id, group_id, cand_id, x, y) with cost, hours, worst and unserved of serving the group's drops in
    nearest-neighbour order; cost is hours plus battery of all sorties.

    drops has scene_id, group_id, drop_id, x, y: a group is what one site serves, some dozens. wind has scene_id,
    wind_speed_10m and wind_direction_10m. A pair is one row of work, so tasks share them evenly; both folds stay on the
    JVM, and the groups are joined after their drops are gathered.
    """
    place = lambda c: F.col(c).cast("long").alias(c)
    groups = drops.groupBy("scene_id", "group_id").agg(F.sort_array(F.collect_list(F.struct("drop_id", place("x"), place("y")))).alias("ps"))
    told = pairs.join(groups, ["scene_id", "group_id"]).join(wind.select("scene_id", "wind_speed_10m", "wind_direction_10m"), "scene_id", "left")
    home = F.col("x").cast("long"), F.col("y").cast("long")
    speed = wind_mps(F.coalesce("wind_speed_10m", F.lit(0.0)))
    told = told.withColumn("_o", nearest_order(F.col("ps"), *home))
    told = told.withColumn("_t", sortie_totals(F.col("_o"), *home, speed, F.coalesce("wind_direction_10m", F.lit(0.0)), m_per_px))
    hours = F.col("_t.metres") / D.SPEED_MPS / 3600
    return told.select("scene_id", "group_id", "cand_id", "x", "y", (hours + F.col("_t.battery")).alias("cost"), hours.alias("hours"), F.col("_t.worst").alias("worst"), F.col("_t.unserved").alias("unserved"))


def ranked_sites(scored: DataFrame) -> DataFrame:
    """The pairs that serve all their drops, ranked by cost, then position."""
    order = Window.partitionBy("scene_id", "group_id").orderBy(F.round("cost", 9), "x", "y")
    return scored.where("unserved = 0").withColumn("rank", F.row_number().over(order))


def replaced(chosen: DataFrame, reached: DataFrame, place: DataFrame, drops: DataFrame, wind: DataFrame, m_per_px: float, most: int, separation: float, rounds: int) -> DataFrame:
    """chosen (scene_id, rank, cand_id, x, y) after rounds in which each base, in the order of ranks, takes the cheapest
    site that reaches all its drops and keeps its distance. Drops are assigned once a round."""
    for _ in range(rounds):
        before = chosen
        owned = assign(reached, chosen).join(chosen.select("scene_id", F.col("cand_id").alias("base_id"), "rank"), ["scene_id", "base_id"])
        owned = stored(owned.join(drops, ["scene_id", "drop_id"]).select("scene_id", "rank", F.lit(0).alias("group_id"), "drop_id", "x", "y"), "owned")
        for rank in range(most):
            mine = owned.where(F.col("rank") == rank).drop("rank")
            if mine.isEmpty():
                continue
            base, others = chosen.where(F.col("rank") == rank), chosen.where(F.col("rank") != rank)
            need = mine.groupBy("scene_id").agg(F.count("*").alias("need"))
            fits = reached.join(mine.select("scene_id", "drop_id"), ["scene_id", "drop_id"], "left_semi").groupBy("scene_id", "cand_id").agg(F.count("*").alias("n")).join(need, "scene_id").where("n = need").select("scene_id", "cand_id")
            open_sites = apart(place.join(fits, ["scene_id", "cand_id"]).join(others.select("scene_id", "cand_id"), ["scene_id", "cand_id"], "left_anti"), others, separation)
            best = ranked_sites(score_sites(open_sites.withColumn("group_id", F.lit(0)), mine, wind, m_per_px)).where("rank = 1").select("scene_id", F.lit(rank).alias("rank"), "cand_id", "x", "y")
            best = stored(best, "best")
            chosen = stored(others.union(base.join(best.select("scene_id"), "scene_id", "left_anti")).union(best), "chosen")
        if chosen.exceptAll(before).isEmpty():
            break
    return chosen


def select_bases(candidates: DataFrame, drops: DataFrame, reached: DataFrame, wind: DataFrame, m_per_px: float, most: int = D.MAX_BASES, separation: float = D.SEPARATION, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(bases, assigned): scene_id, rank, cand_id, x, y, and scene_id, drop_id, base_id, distance_m.

    Where one site reaches all that any site reaches, the cheapest such site is the only base. Elsewhere the greedy
    cover is re-placed: base by base, the cheapest site that reaches all the base's drops and keeps its distance takes
    its place, then drops are assigned anew, until nothing changes or for `rounds` rounds. Bases without drops go; while
    drops are open and the bases of a scene still change, its freed places are filled greedily and re-placed again.
    """
    reached = stored(reached, "reach")
    coverable = reached.select("scene_id", "drop_id").distinct().groupBy("scene_id").agg(F.count("*").alias("all"))
    full = reached.groupBy("scene_id", "cand_id").agg(F.count("*").alias("n")).join(coverable, "scene_id").where("n = all").select("scene_id", "cand_id")
    place = candidates.select("scene_id", "cand_id", "x", "y")
    covered = reached.select("scene_id", "drop_id").distinct().join(drops, ["scene_id", "drop_id"]).select("scene_id", F.lit(0).alias("group_id"), "drop_id", "x", "y")
    whole = place.join(full, ["scene_id", "cand_id"]).withColumn("group_id", F.lit(0))
    single = stored(ranked_sites(score_sites(whole, covered, wind, m_per_px)).where("rank = 1").select("scene_id", F.lit(0).alias("rank"), "cand_id", "x", "y"), "single")
    several = stored(reached.join(single.select("scene_id"), "scene_id", "left_anti"), "several")
    site = ["scene_id", "rank", "cand_id", "x", "y"]
    live, chosen, done = several, None, None
    for _ in range(most):
        before = chosen
        more = greedy_bases(place.join(live.select("scene_id").distinct(), "scene_id", "left_semi"), live, most, separation, before).select(*site)
        chosen = stored(more if before is None else before.union(more), "chosen")
        chosen = replaced(chosen, live, place, drops, wind, m_per_px, most, separation, rounds)
        used = assign(live, chosen).select("scene_id", F.col("base_id").alias("cand_id")).distinct()
        kept = chosen.join(used, ["scene_id", "cand_id"], "left_semi")
        chosen = stored(kept.withColumn("rank", F.row_number().over(Window.partitionBy("scene_id").orderBy("rank")) - 1).select(*site), "chosen")
        served = live.join(chosen.select("scene_id", "cand_id"), ["scene_id", "cand_id"], "left_semi").select("scene_id", "drop_id").distinct()
        again = live.join(served, ["scene_id", "drop_id"], "left_anti").select("scene_id").distinct()
        if before is not None:
            again = again.join(chosen.exceptAll(before).union(before.exceptAll(chosen)).select("scene_id").distinct(), "scene_id", "left_semi")
        again = stored(again, "again")
        ended = chosen.join(again, "scene_id", "left_anti")
        done = ended if done is None else done.union(ended)
        chosen, live = chosen.join(again, "scene_id", "left_semi"), live.join(again, "scene_id", "left_semi")
        if again.isEmpty():
            break
    chosen = stored(done.union(chosen), "chosen")
    bases = single.union(chosen)
    assigned = stored(assign(reached, bases), "assigned")
    return bases.join(assigned.select("scene_id", F.col("base_id").alias("cand_id")).distinct(), ["scene_id", "cand_id"], "left_semi").select("scene_id", "rank", "cand_id", "x", "y"), assigned
