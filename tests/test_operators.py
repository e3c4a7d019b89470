"""Hand-worked cases and plain re-computations of the flood-relief operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemesh import defaults as D
from tidemesh.functions import colour, flight, geodesy
from tidemesh.operators import grid, masks, mission, regions, routes, sites, spread, timeline, weather
from tidemesh.sources import files


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def mask_of(spark, pixels, scene=1):
    return spark.createDataFrame([(scene, x, y) for x, y in pixels], "scene_id long, x int, y int")


def pixels_of(df):
    return {(r["x"], r["y"]) for r in df.collect()}


def test_flight_model(spark):
    row = one(spark, flight.headwind(F.lit(10.0), F.lit(0.0), F.lit(10.0), F.lit(90.0)), flight.headwind(F.lit(-10.0), F.lit(0.0), F.lit(10.0), F.lit(90.0)), flight.headwind(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(90.0)), flight.leg_battery(F.lit(2100.0), F.lit(0.0), F.lit(0.0)), flight.wind_mps(F.lit(-3.0)), flight.segment_distance(F.lit(3.0), F.lit(4.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    assert row[0] == pytest.approx(10) and row[1] == pytest.approx(0) and row[2] == 0 and row[3] == pytest.approx(1.0) and row[4] == 0 and row[5] == pytest.approx(5)
    assert flight.drops_per_load() == 32 and flight.drops_per_load(1, 5) == 1


def test_latlon(spark):
    at = lambda *v: geodesy.pixel_to_latlon(*map(F.lit, v))
    row = one(spark, at(100, 80, 100, 80, 25.0, 82.0, 8.0), at(0, 0, 0, 0, 0.0, 180.0, 0.0), at(0, 0, 0, 0, 90.0, 0.0, 1.0), at(5000, 0, 0, 0, 0.0, 180.0, 100.0), at(0, 0, 0, 0, float("nan"), 0.0, 1.0), at(0, -10**6, 0, 0, 10.0, 0.0, 100.0))
    assert (row[0]["lat"], row[0]["lon"], row[0]["error"]) == (25.0, 82.0, None)
    assert [r["error"] for r in row[1:3]] == ["scale", "reference"] and row[3]["lon"] < -175 and row[4]["error"] == "not finite" and row[5]["error"] == "pole"


def test_colours(spark):
    import colorsys

    rng = random.Random(1)
    rows = [tuple(rng.randrange(256) for _ in range(3)) for _ in range(300)] + [(0, 0, 0), (255, 255, 255), (0, 0, 255)]
    got = spark.createDataFrame(rows, "b int, g int, r int").select("*", colour.bgr_to_hsv(F.col("b"), F.col("g"), F.col("r")).alias("c")).collect()
    for r in got:
        h, s, v = colorsys.rgb_to_hsv(r["r"] / 255, r["g"] / 255, r["b"] / 255)
        assert abs((r["c"]["h"] - h * 180 + 90) % 180 - 90) <= 0.51 and abs(r["c"]["s"] - s * 255) <= 0.51 and r["c"]["v"] == round(v * 255)


def test_dilation_of_a_boundary_is_exact(spark):
    rng = random.Random(2)
    for k in range(4):
        pixels = {(rng.randrange(14), rng.randrange(12)) for _ in range(50)}
        offsets = masks.ellipse(k) if k % 2 else masks.square(k)
        want = {(x + a, y + b) for x, y in pixels for a, b in offsets if 0 <= x + a < 14 and 0 <= y + b < 12}
        assert pixels_of(masks.dilate(mask_of(spark, pixels), offsets, 14, 12)) == want
        inner = {(x, y) for x, y in pixels if all((a, b) in pixels for a in range(max(0, x - 1), min(14, x + 2)) for b in range(max(0, y - 1), min(12, y + 2)))}
        assert pixels_of(masks.erode(mask_of(spark, pixels), 1, 14, 12)) == inner


def test_spread_and_frames(spark):
    block = [(x, y) for x in range(20, 25) for y in range(20, 25)]
    wx = lambda rain, wind: spark.createDataFrame([(1, rain, wind, 270.0)], "scene_id long, precipitation double, wind_speed_10m double, wind_direction_10m double")
    grown = pixels_of(spread.spread_step(mask_of(spark, block), wx(10.0, 30.0), 1.0, 60, 60))
    disc = {(x + a, y + b) for x, y in block for a, b in masks.ellipse(2)}
    assert grown == disc | {(x + 3, y) for x, y in disc}
    for wind, lost in ((60.0, 5), (30.0, 0)):
        frames = spread.forecast(mask_of(spark, block), wx(0.0, wind), 1.0, 60, 60)
        assert spread.lost_pixels(frames).where("hour = 0.5").count() == lost
    hours = lambda h: [round(x[0], 6) for x in spread.frame_plan(h)]
    sub = [0.0, 0.083333, 0.166667]
    assert hours(2) == [*sub, 0.5, 1.0, 2.0] and hours(0.3) == sub and hours(0.05) == [0.0, 0.05] and hours(2.5) == [*sub, 0.5, 1.0, 2.0, 2.5]
    chain = spread.hourly_chain(mask_of(spark, block), 1.5, lambda m, h: m.withColumn("x", F.col("x") + int(2 * h)))
    assert {(r["hour"], r["m"]) for r in chain.groupBy("hour").agg(F.min("x").alias("m")).collect()} == {(0.0, 20), (1.0, 22), (1.5, 23)}


def flood_fill(pixels):
    left, out = set(pixels), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            part.add((x, y))
            near = {(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        out.append(part)
    return out


def test_components_equal_a_flood_fill(spark):
    rng = random.Random(3)
    pixels = {(rng.randrange(40), rng.randrange(30)) for _ in range(420)}
    labels, _ = regions.label(mask_of(spark, pixels))
    got = {}
    for r in labels.collect():
        got.setdefault(r["region_id"], set()).add((r["x"], r["y"]))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, flood_fill(pixels)))


def test_region_areas(spark):
    shapes = {1: [(x, y) for x in range(3) for y in range(3)], 2: [(1, 0), (0, 1), (1, 1), (2, 1), (1, 2)], 3: [(0, 0), (0, 1), (1, 1)], 4: [(5, 5)]}
    rows = [(s, 7, x, y) for s, ps in shapes.items() for x, y in ps]
    labels = spark.createDataFrame(rows, "scene_id long, region_id long, x int, y int")
    assert {r["scene_id"]: r["area"] for r in regions.polygon_area(labels).collect()} == {1: 4.0, 2: 2.0, 3: 0.5, 4: 0.0}
    hull = {r["scene_id"]: [(p["x"], p["y"]) for p in r["hull"]] for r in regions.hulls(labels).collect()}
    assert set(hull[1]) == {(0, 0), (2, 0), (2, 2), (0, 2)} and set(hull[2]) == {(1, 0), (2, 1), (1, 2), (0, 1)} and hull[4] == [(5, 5)]


def test_regions_are_filled(spark):
    frame = {(x, y) for x in range(5, 25) for y in range(5, 25) if min(x - 5, 24 - x, y - 5, 24 - y) < 2}
    pixels = frame | {(14, 14), (15, 14)} | {(30, 3), (31, 2), (32, 3), (31, 4)} | {(0, 20), (1, 19), (0, 18)}
    labels = regions.external(mask_of(spark, pixels), 40, 30)
    areas = sorted(r["area"] for r in regions.polygon_area(labels).collect())
    assert areas == [0.0, 2.0, 361.0]  # the border closes no hole
    large = regions.large_regions(labels).collect()
    assert [(r["area"], r["size"], r["hull_area"], r["n_drops"]) for r in large] == [(361.0, 400, 361.0, 1)]


def test_exact_clearance_has_no_cap(spark):
    points = spark.createDataFrame([(1, 0, 0), (1, 90, 3), (2, 5, 5)], "scene_id long, x int, y int")
    got = {(r["scene_id"], r["x"]): r["clearance"] for r in regions.exact_clearance(points, mask_of(spark, {(89, 3), (60, 80)}), 200).collect()}
    assert got == {(1, 0): pytest.approx(math.hypot(89, 3)), (1, 90): 1.0, (2, 5): None}


def test_distances_are_exact_over_bands_and_keys(spark):
    rng = random.Random(9)
    mask = [(s, w, rng.randrange(-3, 60), rng.randrange(-40, 150)) for s, w in ((1, True), (1, False), (2, True)) for _ in range(40)]
    mask += [(2, True, 7, y) for y in range(20, 75)] + mask[:5]  # a tall run over three bands, and repeated rows
    asked = [(s, w, rng.randrange(-10, 70), rng.randrange(-50, 160)) for s, w in ((1, True), (1, False), (2, True), (3, True)) for _ in range(150)]
    kinds = "scene_id long, w boolean, x int, y int"
    got = {tuple(r)[:4]: r["distance"] for r in regions.distances(spark.createDataFrame(asked + asked[:9], kinds), spark.createDataFrame(mask, kinds), 300, ("scene_id", "w")).collect()}
    for s, w, x, y in asked:
        near = [math.hypot(x - a, y - b) for t, v, a, b in mask if (t, v) == (s, w)]
        assert (s, w, x, y) not in got if not near else got[(s, w, x, y)] == pytest.approx(min(near))
    short = regions.distances(spark.createDataFrame(asked, kinds), spark.createDataFrame(mask, kinds), 6, ("scene_id", "w")).collect()
    assert {tuple(r)[:4] for r in short} == {k for k, d in got.items() if d <= 6}
    assert regions.distances(spark.createDataFrame(asked, kinds), spark.createDataFrame([], kinds), 9, ("scene_id", "w")).count() == 0


def test_signed_distance(spark):
    pixels = {(x, y) for x in range(4, 12) for y in range(0, 9)} - {(6, 3)}
    every = [(x, y) for x in range(20) for y in range(15)]
    points = spark.createDataFrame([(1, x, y, "a") for x, y in every] + [(2, 3, 3, "b")], "scene_id long, x int, y int, name string")
    full = spark.createDataFrame([(3, x, y) for x, y in every], "scene_id long, x int, y int")
    got = regions.signed_distance(points.union(full.limit(2).withColumn("name", F.lit("c"))), mask_of(spark, pixels).union(full), 20, 15).collect()
    assert len(got) == len(every) + 3
    for r in got:
        if r["scene_id"] != 1:
            assert r["signed_distance"] is None
            continue
        own = (r["x"], r["y"]) in pixels
        near = min(math.hypot(r["x"] - a, r["y"] - b) for a, b in every if ((a, b) in pixels) != own)
        assert r["signed_distance"] == pytest.approx(-near if own else near)


def test_point_list(spark):
    from tidemesh.functions import geodesy

    rows = spark.createDataFrame([("1,2;3.5,4.5; -1 , 0.4 ",), (None,), ("",), ("7",), ("a,1;2,2,9",)], "t string").select(geodesy.point_list(F.col("t")).alias("p")).collect()
    assert [[p and (p["x"], p["y"]) for p in r["p"]] for r in rows] == [[(1, 2), (4, 4), (-1, 0)], [], [], [None], [None, (2, 2)]]


def test_clearance(spark):
    rng = random.Random(4)
    pixels = {(rng.randrange(50), rng.randrange(50)) for _ in range(30)}
    points = spark.createDataFrame([(1, x, y) for x in range(0, 50, 7) for y in range(0, 50, 7)], "scene_id long, x int, y int")
    for r in regions.clearance(points, mask_of(spark, pixels), 9).collect():
        assert r["clearance"] == pytest.approx(min(9, min(math.hypot(r["x"] - a, r["y"] - b) for a, b in pixels)))


def test_visit_order_is_greedy(spark):
    rng = random.Random(5)
    rows = [(1, b, d, rng.randrange(60), rng.randrange(60)) for b in range(6) for d in range(b * 4)]
    stops = spark.createDataFrame(rows, "scene_id long, base_id long, drop_id long, x int, y int")
    homes = spark.createDataFrame([(1, b, 30, 30) for b in range(6)], "scene_id long, base_id long, x int, y int")
    got = {}
    for r in sites.visit_order(stops, homes).orderBy("base_id", "seq").collect():
        got.setdefault(r["base_id"], []).append(r["drop_id"])
    for b in range(1, 6):
        at, left, want = (30, 30), {d: (x, y) for _, k, d, x, y in rows if k == b}, []
        while left:
            d = min(left, key=lambda d: ((left[d][0] - at[0]) ** 2 + (left[d][1] - at[1]) ** 2, d))
            at = left.pop(d)
            want.append(d)
        assert got[b] == want


def test_crossings(spark):
    def pair(a, b):
        rows = [(1, 0, i, *p) for i, p in enumerate(a)] + [(1, 1, i, *p) for i, p in enumerate(b)]
        return routes.crossings(spark.createDataFrame(rows, "scene_id long, base_id long, seq int, x int, y int")).count()

    assert pair([(0, 0), (10, 10)], [(10, 10), (20, 0)]) == 1
    assert pair([(0, 0), (100, 0)], [(50, 0), (200, 0)]) == 1
    assert pair([(0, 0), (100, 0)], [(0, 1), (100, 1)]) == 0
    assert pair([(0, 0), (100, 100), (100, 100)], [(0, 100), (100, 0)]) == 1


def test_batches_and_closed_routes(spark):
    order = spark.createDataFrame([(1, 1, k + 1, k, k, 0) for k in range(70)], "scene_id long, base_id long, seq int, drop_id long, x int, y int")
    homes = spark.createDataFrame([(1, 1, 0, 5)], "scene_id long, base_id long, x int, y int")
    assert [r["count"] for r in sites.batches(order, flight.drops_per_load()).groupBy("load").count().orderBy("load").collect()] == [32, 32, 6]
    points = routes.closed_routes(order, homes, 32)
    assert points.count() == 70 + 2 + 4 and mission.bad_reloads(points).count() == 0
    calm = spark.createDataFrame([(1, 0.0)], "scene_id long, wind_speed_10m double")
    report = routes.sorties(points, calm, 1.0).orderBy("sortie").collect()
    assert [r["drops"] for r in report] == [32, 32, 6]
    first = [(k, 0) for k in range(32)]
    path, load, total = [(0, 5), *first, (0, 5)], 32, 0.0
    for a, b in zip(path, path[1:]):
        total += math.dist(a, b) / 5 / 60 * (1 + load * 0.25 * 0.08) / 7
        load = max(0, load - 1)
    assert report[0]["battery"] == pytest.approx(total)


def test_mission_round_trip(spark, tmp_path):
    order = spark.createDataFrame([(1, 1, k + 1, k, 10 * k, 20) for k in range(5)], "scene_id long, base_id long, seq int, drop_id long, x int, y int")
    homes = spark.createDataFrame([(1, 1, 50, 50)], "scene_id long, base_id long, x int, y int")
    scenes = spark.createDataFrame([(1, 200, 160, 25.0, 82.0, 8.0)], "scene_id long, width int, height int, lat double, lon double, m_per_px double")
    told = mission.items(routes.closed_routes(order, homes, 3), scenes)
    assert mission.problems(mission.lines(told).withColumn("mission_id", F.lit(1))).count() == 0
    mission.write_missions(told, f"file://{tmp_path}", "r1")
    back = spark.read.text(f"file://{tmp_path}/run_id=r1")
    assert back.count() == told.count() + 1 and back.where("value = 'QGC WPL 110'").count() == 1
    with pytest.raises(Exception):
        mission.write_missions(told, f"file://{tmp_path}", "r1")


def test_sanitise_and_fallback(spark):
    rows = [(1, 1.0, "x", None), (2, float("inf"), "3.5", 90.0)]
    got = weather.sanitise(spark.createDataFrame(rows, "site_id long, precipitation double, wind_speed_10m string, wind_direction_10m double")).orderBy("site_id").collect()
    assert [(r["precipitation"], r["wind_speed_10m"], r["wind_direction_10m"], r["bad"], r["status"]) for r in got] == [(1.0, 0.0, 0.0, ["wind_speed_10m", "wind_direction_10m"], "partial"), (0.0, 3.5, 90.0, ["precipitation"], "partial")]


def dijkstra(free, source, most):
    import heapq

    best, todo = {source: 0.0}, [(0.0, source)]
    while todo:
        d, (x, y) = heapq.heappop(todo)
        if d > best[(x, y)]:
            continue
        for a, b in grid.STEPS:
            n, c = (x + a, y + b), d + (math.sqrt(2) if a and b else 1)
            if n in free and c <= most + 1e-9 and c < best.get(n, math.inf) - 1e-12:
                best[n] = c
                heapq.heappush(todo, (c, n))
    return best


def test_distance_field_and_path(spark):
    rng = random.Random(6)
    free = {(x, y) for x in range(12) for y in range(10) if rng.random() > 0.25} | {(0, 0)}
    cells = spark.createDataFrame([(1, x, y) for x, y in free], "scene_id long, cx int, cy int")
    sources = spark.createDataFrame([(1, 5, 0, 0), (1, 6, 20, 20)], "scene_id long, source_id long, cx int, cy int")
    field = grid.distance_field(sources, cells, 9.0)
    got = {(r["cx"], r["cy"]): r["n_straight"] + r["n_diag"] * math.sqrt(2) for r in field.collect()}
    want = dijkstra(free, (0, 0), 9.0)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in got)
    far = max(got, key=lambda k: (got[k], k))
    goals = spark.createDataFrame([(1, 5, 1, *far)], "scene_id long, source_id long, goal_id long, cx int, cy int")
    path = [(r["cx"], r["cy"]) for r in grid.path_cells(field, goals).orderBy("step").collect()]
    assert path[0] == far and path[-1] == (0, 0)
    assert sum(math.dist(a, b) for a, b in zip(path, path[1:])) == pytest.approx(got[far])


def test_wet_intervals(spark):
    frames = spark.createDataFrame([(1, 0.0, 5, 5), (1, 1.0, 5, 5), (1, 1.0, 6, 5), (1, 1.0, 7, 5), (1, 2.0, 7, 5)], "scene_id long, hour double, x int, y int")
    area = spark.createDataFrame([(1, x, y) for x in range(12) for y in range(10)], "scene_id long, x int, y int")
    wet = {(r["x"], r["y"]): (r["t_from"], r["t_to"]) for r in timeline.wet_intervals(frames, area).collect()}
    assert wet[(5, 5)][0] == 0.0 and 1.0 < wet[(5, 5)][1] < 2.0 and 0 < wet[(6, 5)][0] < 1 and wet[(7, 5)][1] == math.inf
    points = spark.createDataFrame([(1, 5, 5, 0.5), (1, 7, 5, 0.2), (1, 7, 5, 9.0), (1, -1, 0, 0.0)], "scene_id long, x int, y int, t double")
    got = {(r["x"], r["t"]): r["flooded"] for r in timeline.flooded_at(points, wet=timeline.wet_intervals(frames, area), width=12, height=10).collect()}
    assert got == {(5, 0.5): True, (7, 0.2): False, (7, 9.0): True, (-1, 0.0): True}


def test_fronts_far_apart_and_frames_without_a_front(spark):
    area = spark.createDataFrame([(s, x, y) for s in (1, 2) for x in range(60) for y in range(3)], "scene_id long, x int, y int")
    frames = spark.createDataFrame([(1, 0.0, 0, y) for y in range(3)] + [(1, 1.0, x, y) for x in range(50) for y in range(3)] + [(2, 1.0, 7, 1)], "scene_id long, hour double, x int, y int")
    hours = spark.createDataFrame([(s, h) for s in (1, 2) for h in (0.0, 1.0)], "scene_id long, hour double")
    wet = {(r["scene_id"], r["x"], r["y"]): r["t_from"] for r in timeline.wet_intervals(frames, area, hours).collect()}
    assert all(wet[(1, x, 1)] == pytest.approx(x / 50) for x in range(50)) and wet[(2, 7, 1)] == 0.5 and len(wet) == 151


def test_downscale_keeps_means(spark):
    px = spark.createDataFrame([(1, x, y, x * 10, y * 10, 7) for x in range(8) for y in range(4)], "scene_id long, x int, y int, b int, g int, r int")
    sizes = spark.createDataFrame([(1, 8, 4)], "scene_id long, width int, height int")
    got = {(r["x"], r["y"]): (r["b"], r["g"], r["r"]) for r in files.downscale(px, sizes, 4).collect()}
    assert len(got) == 8 and got[(0, 0)] == (5, 5, 7) and got[(3, 1)] == (65, 25, 7)


def test_geo_references(spark):
    rows = [(1, 100, 80, 0.001, 0.0, 82.0, 0.0, -0.001, 25.0, "EPSG:4326"), (2, 100, 80, 0.0, 0.0, 82.0, 0.0, 0.0, 25.0, "EPSG:4326"), (3, 100, 80, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, "EPSG:3857"), (4, 90, 80, 0.001, 0.0, 82.0, 0.0, -0.001, 25.0, "EPSG:4326")]
    refs = spark.createDataFrame(rows, "scene_id long, width int, height int, a double, b double, c double, d double, e double, f double, crs string")
    sizes = spark.createDataFrame([(i, 100, 80) for i in range(1, 5)], "scene_id long, width int, height int")
    good, bad = files.geo_references(refs, sizes)
    row = good.collect()
    assert len(row) == 1 and row[0]["lat"] == pytest.approx(24.96) and 95 < row[0]["m_per_px"] < 105
    assert {r["scene_id"]: r["error"] for r in bad.collect()} == {2: "singular", 3: "crs", 4: "scene size"}


def test_weather_stream_equals_batch(spark, tmp_path):
    from tidemesh.streaming.weather import hourly_feed

    rows = [(s, f"2024-01-01 0{h}:{m:02d}:00", float(m), float(h), 10.0) for s in (1, 2) for h in range(5) for m in (5, 20, 50)]
    batch = spark.createDataFrame(rows, "site_id long, t string, precipitation double, wind_speed_10m double, wind_direction_10m double").select("site_id", F.to_timestamp("t").alias("obs_ts"), "precipitation", "wind_speed_10m", "wind_direction_10m")
    batch.union(batch.limit(3)).coalesce(1).write.parquet(f"file://{tmp_path}/feed")
    feed = spark.readStream.schema(batch.schema).parquet(f"file://{tmp_path}/feed")
    query = hourly_feed(feed).writeStream.format("memory").queryName("hours").option("checkpointLocation", f"file://{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    got = {(r["site_id"], str(r["hour_start"])): (r["n"], r["precipitation"]) for r in spark.table("hours").collect()}
    want = {(r["site_id"], str(r["hour_start"])): (r["n"], r["precipitation"]) for r in weather.hourly(batch).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert D.RESERVE == 0.2


@pytest.mark.parametrize("band", [1, 3, 256])
def test_regions_across_bands(spark, monkeypatch, band):
    monkeypatch.setattr(regions, "BAND", band)
    rng = random.Random(band)
    pixels = {(s, x, y) for s in (1, 2) for x in range(30) for y in range(26) if rng.random() < 0.42}
    pixels |= {(3, x, y) for x in range(20) for y in range(24) if (x % 4 == 0 and y < 23) or y == 0 or (y == 23 and x in (5, 9))}  # a comb

    def walked(cells, near):
        out, left = {}, set(cells)
        while left:
            todo = [min(left, key=lambda c: (c[1], c[0]))]
            first = todo[0]
            left.discard(first)
            while todo:
                x, y = todo.pop()
                out[x, y] = first
                for n in [(x + a, y + b) for a, b in near if (x + a, y + b) in left]:
                    left.discard(n)
                    todo.append(n)
        return out

    mask = spark.createDataFrame(sorted(pixels), "scene_id long, x int, y int")
    sides, corners = [(0, 1), (1, 0), (0, -1), (-1, 0)], [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    got = {(r["scene_id"], r["x"], r["y"]): r["region_id"] for r in regions.external(mask, 30, 26).collect()}
    sizes = {(r["scene_id"], r["region_id"]): (r["size"], r["min_x"], r["max_y"]) for r in regions.components(regions.external_runs(mask, 30, 26)).collect()}
    for s in (1, 2, 3):
        wet = {(x, y) for t, x, y in pixels if t == s}
        dry = walked({(x, y) for x in range(-1, 31) for y in range(-1, 27)} - wet, sides)
        whole = wet | {c for c, first in dry.items() if first != (-1, -1)}
        want = walked(whole, corners)
        assert {k[1:]: v for k, v in got.items() if k[0] == s} == {c: f[1] * (1 << 20) + f[0] for c, f in want.items()}
        for f in set(want.values()):
            own = [c for c, g in want.items() if g == f]
            assert sizes[s, f[1] * (1 << 20) + f[0]] == (len(own), min(x for x, _ in own), max(y for _, y in own))
