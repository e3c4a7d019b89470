"""Plans and results of pixel steps that must hold as tables grow: what is broadcast, what is shuffled, and brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemesh import defaults as D
from tidemesh.operators import grid, masks, placement, regions, repair, routes, sites, spread, timeline
from tidemesh.plans import queries as Q
from tidemesh.plans import registry
from tidemesh.sources import fixtures as X

SF = "/root/testdata/sf0.001"
W, H = X.WIDTH, X.HEIGHT


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def told(spark, pixels, scene=1):
    return spark.createDataFrame([(scene, x, y) for x, y in sorted(pixels)], "scene_id long, x int, y int")


def pixels_of(df):
    return {(r["x"], r["y"]) for r in df.collect()}


def broadcasts(text):
    """Joins by pixel, tile or cell that broadcast a side."""
    return re.findall(r"Broadcast\w*Join \[scene_id#\d+L, (?:[xyt]|[tc][xy])\w*#.*", text)


def pixel_shuffles(text):
    return re.findall(r"Exchange hashpartitioning\(scene_id#\d+L, [xyh]\w*#.*", text)


def random_frames(spark):
    """Random pixels of three frames of two scenes, the second without its middle frame."""
    rng = random.Random(7)
    frames = {(s, t): {(rng.randrange(12), rng.randrange(9)) for _ in range(50)} for s in (1, 2) for t in (0.0, 0.5, 1.0) if (s, t) != (2, 0.5)}
    return spark.createDataFrame([(s, t, x, y) for (s, t), ps in frames.items() for x, y in ps], "scene_id long, hour double, x int, y int"), frames


@pytest.mark.parametrize("name", ["p1_bgr_to_hsv", "a1_dominant_hue", "a11_map_sanity", "a3_sample_thresholds", "p3_threshold_mask"])
def test_scene_pixels_are_neither_broadcast_nor_shuffled(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert not broadcasts(text) and not pixel_shuffles(text)


def test_flooded_ground_is_not_broadcast(spark):
    points = spark.createDataFrame([(1, 4, 0, 0, 0), (1, 4, 1, 50, 20)], "scene_id long, base_id long, seq int, x int, y int")
    assert not broadcasts(plan(routes.flooded_under(points, X.mask(spark, SF))))


def test_near_regions_broadcast_no_boundary(spark):
    assert not broadcasts(plan(registry.QUERIES["j15_near_regions"](spark, SF)))


def test_clearance_broadcasts_no_mask(spark):
    assert not broadcasts(plan(regions.clearance(X.candidates(spark, SF), X.mask(spark, SF), 16)))


def test_located_points_broadcast_no_mask(spark):
    mask, scenes = X.mask(spark, SF), X.scenes(spark, SF)
    free = grid.free_cells(masks.block_occupancy(mask, 5, W, H), scenes, 5)
    assert not broadcasts(plan(free))
    assert not broadcasts(plan(grid.located(X.drops(spark, SF).withColumnRenamed("drop_id", "id"), free, mask, scenes, 5)))


@pytest.mark.parametrize("name", ["j1_dilate", "j2_erode", "j3_close_open", "a2_local_density"])
def test_morphology_shuffles_no_pixels(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert not pixel_shuffles(text) and "Broadcast" not in text


def test_steps_of_a_forecast_keep_runs_and_broadcast_no_mask(spark):
    mask, weather = X.mask(spark, SF), Q._scene_weather(spark, SF)
    assert "BuildLeft" not in plan(spread.spread_step(mask, weather, 1.0, W, H))
    frames = spread.forecast_runs(mask, weather, 1.0, W, H).cache()
    want = spread.forecast(mask, weather, 1.0, W, H)
    assert spread.frame_pixels(frames).exceptAll(want).isEmpty() and want.exceptAll(spread.frame_pixels(frames)).isEmpty()
    assert frames.count() < want.count() / 4


def test_erosion_and_closing_by_runs(spark):
    rng = random.Random(5)
    w, h = 17, 13
    square = lambda r: [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1)]
    seen = lambda x, y, r: [(x + a, y + b) for a, b in square(r) if 0 <= x + a < w and 0 <= y + b < h]
    worn = lambda s, r: {p for p in s if all(q in s for q in seen(*p, r))}
    grown = lambda s, r: {q for p in s for q in seen(*p, r)}
    for r in (1, 2):
        own = {(x, y) for x in range(w) for y in range(h) if rng.random() < 0.93}
        twice = told(spark, own).union(told(spark, own))
        assert pixels_of(masks.erode(twice, r, w, h)) == worn(own, r)
        few = {(x, y) for x in range(w) for y in range(h) if rng.random() < 0.5}
        assert pixels_of(masks.close_open(told(spark, few), r, w, h)) == grown(worn(worn(grown(few, r), r), r), r)


def test_density_over_bands_is_that_of_the_mirrored_image(spark):
    rng = np.random.default_rng(3)
    for h, w in ((600, 9), (7, 40), (3, 2)):
        image = rng.random((h, w)) < 0.4
        own = {(int(x), int(y)) for y, x in zip(*np.nonzero(image), strict=True)}
        got = {(r["x"], r["y"]): r["density"] for r in placement.local_density(told(spark, own), w, h).collect()}
        at = lambda v, n: v if 0 <= v < n else -v if v < 0 else 2 * (n - 1) - v
        hit = lambda x, y: 0 <= x < w and 0 <= y < h and bool(image[y, x])
        some = own if len(own) < 200 else random.Random(1).sample(sorted(own), 200)
        assert set(got) == own
        for x, y in some:
            assert got[x, y] == sum(hit(at(x + a, w), at(y + b, h)) for a in range(-5, 6) for b in range(-5, 6)) / 121


def test_lost_pixels_of_runs(spark):
    df, frames = random_frames(spark)
    after = {(1, 0.0): (1, 0.5), (1, 0.5): (1, 1.0), (2, 0.0): (2, 1.0)}
    want = {(*a, x, y) for a, b in after.items() for x, y in frames[a] - frames[b]}
    assert {tuple(r) for r in spread.lost_pixels(df).select("scene_id", "hour", "x", "y").collect()} == want
    parts = regions.runs(df, ("scene_id", "hour")).drop("run_id")
    assert {tuple(r) for r in spread.frame_pixels(spread.lost_pixels(parts)).collect()} == want


def test_blends_of_runs(spark):
    df, frames = random_frames(spark)
    times = timeline.bracket(spark.createDataFrame([(s, t) for s in (1, 2) for t in (0.5, 0.7, 3.0)], "scene_id long, t double"), df.select("scene_id", "hour").distinct())
    grey = {}
    for s, t, a, b, alpha, source in times.select("scene_id", "t", "lower", "upper", "alpha", "source").collect():
        alpha = alpha if source == "interpolated" else 0.0
        for p in frames[s, a] | frames[s, b]:
            v = np.rint(255 * ((1 - alpha) * (p in frames[s, a]) + alpha * (p in frames[s, b])))
            if v:
                grey[s, t, *p] = int(v)
    for own in (df, regions.runs(df, ("scene_id", "hour")).drop("run_id")):
        assert {tuple(r)[:4]: r["value"] for r in timeline.soft_blend(own, times).collect()} == grey


def test_waves_over_wide_and_shifted_grounds(spark):
    rng = random.Random(11)
    cells = {(x, y) for x in range(-3, 140) for y in range(-2, 5) if rng.random() < 0.8} | {(0, 0), (100, 2)}
    free = spark.createDataFrame([(1, x, y) for x, y in cells] + [(2, 5, 5)], "scene_id long, cx int, cy int")
    starts = [(1, 7, 0, 0), (1, 8, 100, 2), (1, 9, 500, 0), (3, 1, 0, 0)]
    field = grid.distance_field(spark.createDataFrame(starts, "scene_id long, source_id long, cx int, cy int"), free, 30.0)
    assert not re.findall(r"Exchange hashpartitioning\(scene_id#\d+L, \w+#", plan(field))
    got = {(r["source_id"], r["cx"], r["cy"]): r["n_straight"] + r["n_diag"] * math.sqrt(2) for r in field.collect()}
    want = {}
    for _, source, x, y in starts[:2]:
        left, best = [(x, y)], {(x, y): 0.0}
        while left:
            ahead = {}
            for at in left:
                for dx, dy in grid.STEPS:
                    to, d = (at[0] + dx, at[1] + dy), best[at] + math.hypot(dx, dy)
                    if to in cells and d <= 30 and d < best.get(to, 99) - 1e-9:
                        best[to] = ahead[to] = d
            left = list(ahead)
        want |= {(source, *p): d for p, d in best.items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_places_reach_all_drops_by_the_farthest(spark):
    sites_ = spark.createDataFrame([(1, 1, 50, 50), (1, 2, 150, 100)], "scene_id long, cand_id long, x int, y int")
    drops = spark.createDataFrame([(1, 1, 10, 5, 5), (1, 1, 11, 95, 60), (1, 2, 12, 190, 150)], "scene_id long, base_id long, drop_id long, x int, y int")
    wind = spark.createDataFrame([(1, 10.0)], "scene_id long, wind_speed_10m double")
    mask, scale = told(spark, {(60, 60), (140, 90)}), 55.0
    places = repair.nudges(sites_, sites_, drops, mask, wind, scale, W, H, separation=30.0)
    assert not re.search(r"Broadcast\w*Join \[scene_id#\d+L, (spot|cand)_id", plan(places))
    got = {(r["cand_id"], r["x"], r["y"]) for r in places.collect()}
    ring = [(c, x + a, y + b) for c, x, y in ((1, 50, 50), (2, 150, 100)) for a in range(-50, 51, 5) for b in range(-50, 51, 5) if (a or b) and a * a + b * b <= 2500 and 0 <= x + a < W and 0 <= y + b < H]
    spots = spark.createDataFrame([(1, c, k, x, y) for k, (c, x, y) in enumerate(ring)], "scene_id long, cand_id long, k long, x int, y int")
    clear = sites.apart(regions.clearance(spots, mask, 9).where(F.col("clearance") >= D.CLEARANCE), sites_, 30.0)
    near = sites.reach(spots.select("scene_id", F.col("k").alias("cand_id"), "x", "y"), drops, wind, scale).groupBy("cand_id").agg(F.collect_set("drop_id").alias("ds")).collect()
    reached = {r["cand_id"]: set(r["ds"]) for r in near}
    own = {1: {10, 11}, 2: {12}}
    want = {(r["cand_id"], r["x"], r["y"]) for r in clear.collect() if own[r["cand_id"]] <= reached.get(r["k"], set())}
    assert got == want and 0 < len(got) < len(ring)
