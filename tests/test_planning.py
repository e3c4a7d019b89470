"""Stop plans, site choice, placement and repair on small cases."""

import math
import random

import costs
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemesh.operators import placement, planning, regions, repair, reports, routes, selection, sites
from tidemesh.operators import grid, masks
from tidemesh.plans import queries
from tidemesh.sources import fixtures as X

ORDER = "scene_id long, base_id long, seq int, drop_id long, x int, y int"


def plan(spark, places, wet=None, scale=1.0, **more):
    order = spark.createDataFrame([(1, 1, k + 1, k, x, y) for k, (x, y) in enumerate(places)], ORDER)
    homes = spark.createDataFrame([(1, 1, 0, 0)], "scene_id long, base_id long, x int, y int")
    wind = spark.createDataFrame([(1, 0.0)], "scene_id long, wind_speed_10m double")
    spans = spark.createDataFrame(wet, "scene_id long, x int, y int, t_from double, t_to double") if wet else None
    return [(r["kind"], r["drop_id"], r["battery"], r["reason"]) for r in planning.stop_plan(order, homes, wind, spans, scale, **more).orderBy("seq").collect()]


def test_payload_closes_a_sortie(spark):
    got = plan(spark, [(k, 1) for k in range(5)], capacity=0.5)
    assert [k for k, *_ in got] == ["home", "drop", "drop", "reload", "via", "drop", "drop", "reload", "via", "drop", "home"]


def test_battery_closes_or_rejects(spark):
    far = plan(spark, [(700, 0), (0, 700), (900, 0)])
    assert [k for k, *_ in far] == ["home", "drop", "reload", "via", "drop", "home", "reject"] and far[-1][3] == "battery"
    left = [b for k, _, b, _ in far if k in ("home", "reload")]
    assert all(b is None or b >= 0.2 - 1e-9 for b in left)


def test_flooded_stops_are_promoted_or_rejected(spark):
    wet = [(1, 100, 0, 0.0, 9.0), (1, 0, 300, 0.02, 9.0)]  # flooded after a direct flight, before one by way of the others
    got = plan(spark, [(50, 0), (100, 0), (0, 300)], wet, first_hour=0.01)
    assert [(k, d) for k, d, _, _ in got if k in ("drop", "reject")] == [("drop", 2), ("drop", 0), ("reject", 1)]


def test_refine_ends_in_each_way(spark):
    start = spark.createDataFrame([(1, b, 0, b, 0, "home") for b in (1, 2, 3)], "scene_id long, base_id long, seq int, x int, y int, kind string")
    step = lambda r: r.withColumn("x", F.when(F.col("base_id") == 1, F.col("x")).when(F.col("base_id") == 2, 5 - F.col("x")).otherwise(F.col("x") + 1))
    done, outcomes = planning.refine(start, step, 4)
    assert {r["base_id"]: (r["outcome"], r["rounds"]) for r in outcomes.collect()} == {1: ("converged", 1), 2: ("cycle", 2), 3: ("iteration_cap", 4)}
    assert done.count() == 3
    caps = spark.createDataFrame([(1, 3, 2)], "scene_id long, base_id long, cap int")
    assert {r["base_id"]: (r["outcome"], r["rounds"]) for r in planning.refine(start, step, 4, caps)[1].collect()}[3] == ("iteration_cap", 2)


def test_sortie_cost_by_hand():
    cost, hours, worst, unserved = costs.sortie_cost((0, 0), [(100, 0), (200, 0)], 0.0, 0.0, 1.0)
    battery = (100 / 5 / 60 * (1 + 0.5 * 0.08) + 100 / 5 / 60 * (1 + 0.25 * 0.08) + 200 / 5 / 60) / 7
    assert hours == pytest.approx(400 / 5 / 3600) and worst == pytest.approx(battery) and cost == pytest.approx(hours + battery) and unserved == 0
    assert costs.sortie_cost((0, 0), [(2000, 0)], 0.0, 0.0, 1.0)[3] == 1
    east = costs.sortie_cost((0, 0), [(100, 0)], 10.0, 90.0, 1.0)[2]
    assert east > costs.sortie_cost((0, 0), [(100, 0)], 0.0, 90.0, 1.0)[2]


def test_select_bases_single_and_several(spark):
    cands = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 10, 0), (2, 1, 0, 0), (2, 2, 900, 0)], "scene_id long, cand_id long, x int, y int")
    drops = spark.createDataFrame([(1, 1, 12, 0), (1, 2, 20, 0), (2, 1, 10, 0), (2, 2, 890, 0)], "scene_id long, drop_id long, x int, y int")
    wind = spark.createDataFrame([(s, 0.0, 0.0) for s in (1, 2)], "scene_id long, wind_speed_10m double, wind_direction_10m double")
    bases, assigned = selection.select_bases(cands, drops, sites.reach(cands, drops, wind, 2.0), wind, 2.0)
    assert sorted((r["scene_id"], r["cand_id"]) for r in bases.collect()) == [(1, 2), (2, 1), (2, 2)]
    assert assigned.count() == 4


def test_crossing_is_repaired_by_moving_a_drop(spark):
    drops = spark.createDataFrame([(1, 1, 100, 100), (1, 2, 100, 0)], "scene_id long, drop_id long, x int, y int")
    homes = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 0, 100)], "scene_id long, base_id long, x int, y int")
    start = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "scene_id long, drop_id long, base_id long")
    reached = spark.createDataFrame([(1, b, d, 1.0) for b in (1, 2) for d in (1, 2)], "scene_id long, cand_id long, drop_id long, distance_m double")
    replan = lambda a: routes.closed_routes(sites.visit_order(drops.join(a, ["scene_id", "drop_id"]), homes), homes, 4)
    assert routes.crossings(replan(start)).count() > 0
    assigned, points, left = repair.repair(start, drops, reached, replan)
    assert left.count() == 0 and assigned.select("drop_id").distinct().count() == 2


def test_drop_points_keep_apart_and_dry(spark):
    block = spark.createDataFrame([(1, x, y) for x in range(60, 140) for y in range(50, 110)], "scene_id long, x int, y int")
    labels = block.withColumn("region_id", F.lit(1))
    band = placement.candidate_band(labels, block, 200, 160)
    assert band.join(block, ["scene_id", "x", "y"], "left_semi").count() == 0 and band.agg(F.min("clearance")).first()[0] >= 5
    counts = spark.createDataFrame([(1, 1, 3)], "scene_id long, region_id int, n_drops int")
    stations = placement.perimeter_stations(regions.hulls(labels), counts)
    got = [(r["x"], r["y"]) for r in placement.pick_at_stations(band, stations).collect()]
    assert len(got) == 3 and min(math.dist(a, b) for i, a in enumerate(got) for b in got[:i]) >= 50


def test_reports(spark):
    cells = spark.createDataFrame([(1, 0, 0, 7), (1, 1, 0, 7), (1, 5, 5, 8)], "scene_id long, cx int, cy int, component int")
    legs = spark.createDataFrame([(1, 1, 0, 0, 0, 0, 0), (1, 1, 1, 0, 0, 1, 0), (1, 1, 2, 0, 0, 5, 5), (1, 1, 3, 0, 0, 9, 9)], "scene_id long, base_id long, leg int, sx int, sy int, gx int, gy int")
    told = reports.leg_status(legs, cells)
    assert {r["leg"]: (r["status"], r["reason"]) for r in told.collect()} == {0: ("same_cell", None), 1: ("routed", None), 2: ("fallback", "not connected"), 3: ("fallback", "goal blocked")}
    row = reports.leg_counts(told).first()
    assert (row["same_cell"], row["routed"], row["fallback"]) == (1, 1, 2)
    stops = spark.createDataFrame([(1, 1, 0, 0), (1, 1, 1, 3), (1, 1, 2, 6)], "scene_id long, base_id long, leg int, seq int")
    segs = spark.createDataFrame([(1, 1, s) for s in (0, 2, 3, 5, 9)], "scene_id long, base_id long, seg int")
    assert {r["seg"]: r["leg"] for r in reports.leg_of_segment(segs, stops).collect()} == {0: 0, 2: 0, 3: 1, 5: 1, 9: 2}
    drops = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 5, 5), (1, 3, 9, 9)], "scene_id long, drop_id long, x int, y int")
    ground = spark.createDataFrame([(1, 0, 0, 7), (1, 1, 0, 7), (1, 5, 5, 8)], "scene_id long, x int, y int, component int")
    kept, out = placement.connected_to_home(drops, spark.createDataFrame([(1, 1, 0)], "scene_id long, x int, y int"), ground)
    assert [r["drop_id"] for r in kept.collect()] == [1] and {r["drop_id"]: r["reason"] for r in out.collect()} == {2: "cut off from home", 3: "drop is not on free ground"}


def test_sortie_folds_equal_sorties_flown_one_by_one(spark):
    rng = random.Random(12)
    drops, pairs, winds = {}, [], {}
    for s, (n, reach) in enumerate([(1, 50), (7, 300), (40, 60), (45, 200), (12, 900), (6, 2500), (33, 0), (70, 15)]):
        drops[s] = [(rng.randrange(-reach, reach + 1), rng.randrange(-reach, reach + 1)) for _ in range(n)]
        drops[s] += drops[s][: n // 4]  # ties and repeated places
        pairs += [(s, 0, 10 * s + k, *p) for k, p in enumerate([(0, 0), drops[s][0], (rng.randrange(50), -20)])]
        winds[s] = (rng.choice([0.0, 11.0, 40.0]), rng.choice([0.0, 100.0, 270.0])) if s % 3 else None
    rows = [(s, 0, k, *p) for s, ps in drops.items() for k, p in enumerate(ps)]
    wind = spark.createDataFrame([(s, *w) for s, w in winds.items() if w], "scene_id long, wind_speed_10m double, wind_direction_10m double")
    told = selection.score_sites(spark.createDataFrame(pairs, "scene_id long, group_id int, cand_id long, x int, y int"), spark.createDataFrame(rows, "scene_id long, group_id int, drop_id long, x int, y int"), wind, 3.0)
    assert "Python" not in told._jdf.queryExecution().toString() and "InPandas" not in told._jdf.queryExecution().toString()
    got = {r["cand_id"]: r for r in told.collect()}
    assert len(got) == len(pairs)
    failed = 0
    for s, _, c, x, y in pairs:
        kmh, side = winds[s] or (0.0, 0.0)
        cost, hours, worst, unserved = costs.sortie_cost((x, y), drops[s], kmh / 3.6, side, 3.0)
        failed += unserved
        assert (got[c]["unserved"], got[c]["cost"], got[c]["hours"], got[c]["worst"]) == (unserved, pytest.approx(cost), pytest.approx(hours), pytest.approx(worst))
    assert failed > 0


def test_sites_are_ranked_over_all_drops(spark):
    sf = "/root/testdata/sf0.001"
    told = {(r["scene_id"], r["cand_id"]): r for r in queries.w11_ranked_sites(spark, sf).collect()}
    drops = {}
    for r in X.drops(spark, sf).orderBy("drop_id").collect():
        drops.setdefault(r["scene_id"], []).append((r["x"], r["y"]))
    homes = [r for r in X.candidates(spark, sf).collect() if r["scene_id"] in drops]
    assert len(told) == len(homes) > 0
    winds = {r["scene_id"] for r in X.scenes(spark, sf).collect()}
    for r in homes:
        wind = (30 / 3.6, 270.0) if r["scene_id"] in winds else (0.0, 0.0)
        cost, _, worst, unserved = costs.sortie_cost((r["x"], r["y"]), drops[r["scene_id"]], *wind, X.M_PER_PX)
        row = told[r["scene_id"], r["cand_id"]]
        assert row["unserved"] == unserved and abs(row["worst"] - worst) < 1e-5 and abs(row["cost"] - cost) < 1e-4 and (row["rank"] is None) == (unserved > 0)


def test_territories_go_as_far_as_free_cells(spark):
    sf = "/root/testdata/sf0.001"
    told = {r["scene_id"]: r for r in queries.w13_territories(spark, sf).collect()}
    free, starts, stuck = {}, {}, {}
    for r in grid.free_cells(masks.block_occupancy(X.mask(spark, sf), 5, 200, 160), X.scenes(spark, sf), 5).collect():
        free.setdefault(r["scene_id"], set()).add((r["cx"], r["cy"]))
    cell = lambda r: (min(r["x"] // 5, 39), min(r["y"] // 5, 31))
    for r in X.candidates(spark, sf).collect():
        starts.setdefault(r["scene_id"], set()).add(cell(r))
    for r in sites.assign(queries.straight_reach(spark, sf)).join(X.drops(spark, sf), ["scene_id", "drop_id"]).collect():
        starts[r["scene_id"]].add(cell(r))
        stuck[r["scene_id"]] = stuck.get(r["scene_id"], 0) + (cell(r) not in free.get(r["scene_id"], set()))
    assert told
    for scene, row in told.items():
        seen = todo = starts[scene] & free[scene]
        while todo:
            todo = {(x + a, y + b) for x, y in todo for a in (-1, 0, 1) for b in (-1, 0, 1)} & free[scene] - seen
            seen = seen | todo
        assert (row["cells"], row["unreachable"]) == (len(seen), stuck.get(scene, 0))


def test_full_routes_fly_round_what_is_wet_then(spark):
    from tidemesh.operators import legs

    width, height, inf = 60, 40, math.inf
    wall = [(1, 30, y, 0.0, inf) for y in range(0, 30)] + [(2, 30, y, 0.0, 0.05) for y in range(0, 30)] + [(3, 30, y, 0.0, inf) for y in range(40)] + [(4, 50, 10, 0.0, inf)]
    wet = spark.createDataFrame(wall, "scene_id long, x int, y int, t_from double, t_to double")
    stops = [(s, 1, k, x, 10) for s in (1, 2, 3) for k, x in enumerate((10, 50, 10))] + [(4, 1, 0, 10, 10), (4, 1, 1, 52, 11), (5, 1, 0, 3, 3)]
    points = spark.createDataFrame(stops, "scene_id long, base_id long, seq int, x int, y int").withColumn("t_from", F.lit("clash"))
    got = {(r["scene_id"], r["leg"]): r for r in legs.full_routes(points, wet, width, height, 100.0).collect()}
    assert set(got) == {(s, k) for s in (1, 2, 3) for k in (0, 1)} | {(4, 0)}
    assert all(got[(1, k)]["status"] == "routed" and got[(1, k)]["route_flooded_px"] == 0 and got[(1, k)]["distance_m"] > 5000 for k in (0, 1))
    assert got[(2, 0)]["distance_m"] == pytest.approx(4000, abs=300)  # the wall is dry again when it arrives
    assert all((got[(3, k)]["status"], got[(3, k)]["reason"], got[(3, k)]["flooded_px"]) == ("fallback", "not connected", 1) for k in (0, 1))
    assert got[(4, 0)]["status"] == "routed" and got[(4, 0)]["xs"][-1] == 52 and got[(4, 0)]["route_flooded_px"] == 0
    assert got[(1, 1)]["arrival_h"] == pytest.approx((got[(1, 0)]["distance_m"] + 4000) / 18000)


def test_paths_are_shortest():
    from tidemesh.operators import legs

    rng = random.Random(9)
    image = np.zeros((60, 80), bool)
    for _ in range(40):
        image[rng.randrange(60), rng.randrange(80)] = True
    ground = legs.Ground(image, 5)
    cells = [(x, y) for y in range(12) for x in range(16) if ground.free[y, x]]
    goal = cells[0]
    far = dict.fromkeys(cells, math.inf) | {goal: 0.0}
    for _ in cells:  # relax every step until nothing is left to relax
        for x, y in cells:
            for dx, dy in ((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b):
                if (x + dx, y + dy) in far:
                    far[(x, y)] = min(far[(x, y)], far[(x + dx, y + dy)] + math.hypot(dx, dy))
    costs = ground.costs(goal)
    assert costs == {c: pytest.approx(d) for c, d in far.items() if d < math.inf}
    for c in costs:
        path = ground.path(c, costs)
        assert path[0] == c and path[-1] == goal and sum(math.dist(a, b) for a, b in zip(path, path[1:])) == pytest.approx(costs[c])
    assert legs.ring_order(1) == [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1)] and len(legs.ring_order(4)) == 81
