"""Detours, moved bases, freed places and hull bands on small cases."""

import math
import random

import costs
import pytest
from pyspark.sql import functions as F

from tidemesh import defaults as D
from tidemesh.operators import detours, placement, regions, repair, routes, selection, sites

W, H = 200, 160
SITE = "scene_id long, cand_id long, x int, y int"
WIND = "scene_id long, wind_speed_10m double, wind_direction_10m double"


@pytest.fixture
def crossing(spark):
    """Two bases that serve a drop each on lines that cross, in three scenes; neither reaches the other's drop."""
    drops = spark.createDataFrame([(s, d, x, y) for s in (1, 2, 3) for d, x, y in ((1, 180, 80), (2, 100, 140))], "scene_id long, drop_id long, x int, y int")
    homes = spark.createDataFrame([(s, b, x, y) for s in (1, 2, 3) for b, x, y in ((1, 20, 80), (2, 100, 20))], "scene_id long, base_id long, x int, y int")
    start = spark.createDataFrame([(s, k, k) for s in (1, 2, 3) for k in (1, 2)], "scene_id long, drop_id long, base_id long")
    reached = spark.createDataFrame([(s, k, k) for s in (1, 2, 3) for k in (1, 2)], "scene_id long, cand_id long, drop_id long")
    wind = spark.createDataFrame([(s, 0.0, 0.0) for s in (1, 2, 3)], WIND)

    def replan(assigned, homes):
        return routes.closed_routes(sites.visit_order(drops.join(assigned, ["scene_id", "drop_id"]), homes), homes, 4)

    return drops, homes, start, reached, wind, replan


def test_legs_bend_round_a_route(spark, crossing):
    drops, homes, start, reached, wind, replan = crossing
    # base 1 has no dry way round in scenes 2 and 3, base 2 none in scene 2
    shut = [(s, x, y) for s in (2, 3) for x in range(95, 106) for y in (*range(16), *range(144, H))] + [(2, x, y) for y in range(75, 86) for x in (*range(16), *range(184, W))]
    wet = spark.createDataFrame([(*p, 0.0, 9.0) for p in [(1, 0, 0), *shut]], "scene_id long, x int, y int, t_from double, t_to double")
    turn = lambda p, c: detours.detours(p, c, wet, wind, W, H, 2.0)
    assert routes.crossings(replan(start, homes)).groupBy("scene_id").count().collect()[0][1] == 4
    _, points, left = repair.repair(start, drops, reached, replan, homes=homes, reroute=turn)
    assert {r["scene_id"] for r in left.collect()} == {2} and left.count() == 4
    bends = points.where("kind = 'bend'")
    assert {(r["scene_id"], r["base_id"]) for r in bends.collect()} == {(1, 1), (3, 2)}
    stops = [(r["x"], r["y"], r["kind"]) for r in points.where("scene_id = 1 AND base_id = 1 AND kind <> 'bend'").orderBy("seq").collect()]
    assert stops == [(20, 80, "home"), (180, 80, "drop"), (20, 80, "home")]
    assert routes.over_limit(routes.sorties(points, wind, 2.0)).count() == 0


def test_detours_of_nothing(spark, crossing):
    _, homes, start, _, wind, replan = crossing
    points = replan(start, homes)
    wet = spark.createDataFrame([], "scene_id long, x int, y int, t_from double, t_to double")
    assert detours.detours(points, routes.crossings(points).where("false"), wet, wind, W, H, 2.0).count() == 0


def test_a_base_moves_to_the_nearest_place(spark):
    drops = spark.createDataFrame([(1, 1, 100, 50), (1, 2, 75, 90)], "scene_id long, drop_id long, x int, y int")
    homes = spark.createDataFrame([(1, 1, 50, 50), (1, 2, 75, 48)], "scene_id long, base_id long, x int, y int")
    start = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "scene_id long, drop_id long, base_id long")
    reached = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "scene_id long, cand_id long, drop_id long")
    mask = spark.createDataFrame([(1, W - 1, H - 1)], "scene_id long, x int, y int")
    wind = spark.createDataFrame([(1, 0.0, 0.0)], WIND)
    replan = lambda a, h: routes.closed_routes(sites.visit_order(drops.join(a, ["scene_id", "drop_id"]), h), h, 4)
    nudge = lambda s, o, m: repair.nudges(s, o, m, mask, wind, 2.0, W, H, separation=20.0)
    _, points, left = repair.repair(start, drops, reached, replan, homes=homes, nudge=nudge, reach_of=lambda s: sites.reach(s, drops, wind, 2.0))
    assert left.count() == 0
    assert {(r["base_id"], r["x"], r["y"]) for r in points.where("kind = 'home'").collect()} == {(1, 50, 45), (2, 75, 48)}


def plain_bases(cands, drops, most, apart, rounds=3):
    """Chosen sites of one scene by the rules of select_bases, over dictionaries of points."""
    reach = {c: {d for d, q in drops.items() if 2 * math.dist(p, q) <= LIMIT} for c, p in cands.items()}
    every = set().union(*reach.values())
    cost = lambda c, ds: round(costs.sortie_cost(cands[c], [drops[d] for d in sorted(ds)], 0.0, 0.0, 2.0)[0], 9)
    serves = lambda c, ds: costs.sortie_cost(cands[c], [drops[d] for d in sorted(ds)], 0.0, 0.0, 2.0)[3] == 0
    best = lambda cs, ds: min((c for c in cs if serves(c, ds)), key=lambda c: (cost(c, ds), cands[c]), default=None)
    whole = best([c for c in cands if reach[c] == every], every) if every else None
    if whole is not None or not every:
        return set() if whole is None else {whole}
    clear = lambda c, others: all(math.dist(cands[c], cands[o]) >= apart for o in others)

    def owners(chosen):
        out = {c: set() for c in chosen}
        for d in every:
            near = [(math.dist(cands[c], drops[d]), c) for c in chosen if d in reach[c]]
            if near:
                out[min(near)[1]].add(d)
        return out

    chosen = []
    for _ in range(most):
        before = list(chosen)
        open_ = every - set().union(*(reach[c] for c in chosen), set())
        while open_ and len(chosen) < most:
            able = [c for c in cands if c not in chosen and clear(c, chosen) and reach[c] & open_]
            if not able:
                break
            pick = max(able, key=lambda c: (len(reach[c] & open_), -round(sum(2 * math.dist(cands[c], drops[d]) for d in reach[c] & open_), 6), -c))
            chosen.append(pick)
            open_ -= reach[pick]
        for _ in range(rounds):
            start, own = list(chosen), owners(chosen)
            for k in range(len(chosen)):
                mine, others = own[start[k]], chosen[:k] + chosen[k + 1 :]
                found = best([c for c in cands if c not in others and mine <= reach[c] and clear(c, others)], mine) if mine else None
                chosen[k] = chosen[k] if found is None else found
            if chosen == start:
                break
        own = owners(chosen)
        chosen = [c for c in chosen if own[c]]
        if every <= set().union(*own.values()) or chosen == before:
            break
    return set(chosen)


#: Metres that a drop may lie away: the reserve's battery, out loaded and back empty.
LIMIT = (1 - D.RESERVE) * D.ENDURANCE_MIN * 60 * D.SPEED_MPS / (2 + D.PER_DROP_KG * D.PAYLOAD_FACTOR)


def test_select_bases_against_plain_choice(spark):
    rng = random.Random(5)
    cands, drops = {}, {}
    for s in range(12):
        cands[s] = {c: (rng.randrange(1200), rng.randrange(500)) for c in range(9)}
        drops[s] = {d: (rng.randrange(1200), rng.randrange(500)) for d in range(14)}
    flat = lambda t: [(s, k, *p) for s, own in t.items() for k, p in own.items()]
    c = spark.createDataFrame(flat(cands), SITE)
    d = spark.createDataFrame(flat(drops), "scene_id long, drop_id long, x int, y int")
    wind = spark.createDataFrame([(s, 0.0, 0.0) for s in cands], WIND)
    bases, assigned = selection.select_bases(c, d, sites.reach(c, d, wind, 2.0), wind, 2.0, most=3, separation=150.0)
    got = {s: set() for s in cands}
    for r in bases.collect():
        got[r["scene_id"]].add(r["cand_id"])
    assert got == {s: plain_bases(cands[s], drops[s], 3, 150.0) for s in cands}


def test_greedy_fills_freed_places(spark):
    c = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 10, 0), (1, 3, 300, 0), (2, 1, 0, 0), (2, 2, 300, 0)], SITE)
    reached = spark.createDataFrame([(1, 1, 1, 5.0), (1, 2, 2, 5.0), (1, 3, 2, 9.0), (2, 1, 1, 1.0), (2, 2, 2, 1.0)], "scene_id long, cand_id long, drop_id long, distance_m double")
    standing = spark.createDataFrame([(1, 1, 0, 0), (2, 1, 0, 0), (2, 3, 50, 50)], SITE)
    got = sites.greedy_bases(c, reached, 2, 100.0, standing).collect()
    assert [(r["scene_id"], r["rank"], r["cand_id"]) for r in got] == [(1, 1, 3)]  # 2 is too near, scene 2 has no room


def test_band_goes_round_the_hull_and_keeps_off_islands(spark):
    ell = [(x, y) for x in range(40, 121) for y in range(40, 101) if x < 60 or y > 80]  # its hull holds dry ground
    ring = [(x, y) for x in range(60, 79) for y in range(60, 79) if max(abs(x - 69), abs(y - 69)) in (8, 9)]  # round an island
    mask = spark.createDataFrame([(1, x, y) for x, y in {*ell, *ring}], "scene_id long, x int, y int")
    labels = spark.createDataFrame([(1, 1, x, y) for x, y in ell], "scene_id long, region_id long, x int, y int")
    hulls = regions.hulls(labels)
    outline = placement.hull_outline(hulls)
    rows = {r["y"]: (r["a"], r["b"]) for r in outline.groupBy("y").agg(F.min("x").alias("a"), F.max("x").alias("b")).collect()}
    assert rows[40] == (40, 59) and rows[100] == (40, 120) and set(rows) == set(range(40, 101))
    dry = placement.dry_components(mask, W, H)
    sizes = {(r["x"], r["y"]): r["size"] for r in dry.where("(x = 69 AND y = 69) OR (x = 0 AND y = 0)").collect()}
    assert sizes[69, 69] == 15 * 15 and dry.count() == W * H - mask.count() and sizes[0, 0] == dry.count() - 225
    band = placement.candidate_band(outline, mask, W, H)
    assert band.where("x = 69 AND y = 69").count() == 1
    kept = placement.main_component(band, dry)
    assert kept.where("x = 69 AND y = 69").count() == 0 and kept.count() > 0
    assert placement.or_corners(kept, hulls).count() == kept.count()
    bare = placement.or_corners(kept.where("false"), hulls)
    assert bare.count() == len(hulls.first()["hull"]) and {r["clearance"] for r in bare.collect()} == {0.0}
