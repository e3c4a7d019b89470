"""Hour-by-hour flood forecasts: rain grows a mask, wind pushes it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemesh import defaults as D
from tidemesh.operators.common import by_scene, stored
from tidemesh.operators.masks import PIXEL
from tidemesh.operators.regions import layers, merged, run_pixels, runs

SUB_HOURS = (1 / 12, 1 / 6, 0.5, 1.0)


def reach_and_shift(hours: Column) -> tuple[Column, Column, Column]:
    """(radius, dx, dy) of a spread step: the radius is the growth's whole part, one more if a soft edge passes half."""
    growth = F.greatest(F.lit(0.0), F.col("precipitation")) / D.RAIN_PER_PX * hours
    whole = F.floor(growth)
    radius = (whole + F.when(F.rint(255 * (growth - whole)) >= 128, 1).otherwise(0)).cast("int")
    push = F.greatest(F.lit(0.0), F.col("wind_speed_10m")) / D.WIND_PER_PX * hours
    toward = F.radians(F.col("wind_direction_10m") + 180)
    return radius, F.rint(F.sin(toward) * push).cast("int"), F.rint(-F.cos(toward) * push).cast("int")


def grown(body: DataFrame, weather: DataFrame, hours: float, width: int, height: int) -> DataFrame:
    """The runs (scene_id, y, x1, x2) of a mask after one step (see spread_step): the fewest that cover it.

    A run grows to one range a row of the disc; ranges are merged, then taken once in their place and once shifted. The
    range of a run's own row holds the run itself, whatever the weather says. Both sides of the join go by scene, as estimates of a mask's size say nothing.
    """
    radius, dx, dy = reach_and_shift(F.lit(float(hours)))
    most = int((width * width + height * height) ** 0.5) + 1
    told = weather.select("scene_id", F.least(radius, F.lit(most)).alias("r"), dx.alias("sx"), dy.alias("sy"))
    rows = body.select("scene_id", "y", "x1", "x2").join(told.hint("merge"), "scene_id", "left").na.fill(0, ["r", "sx", "sy"])
    rows = rows.withColumn("oy", F.explode(F.sequence(-F.col("r"), F.col("r"))))
    half = F.rint(F.sqrt((F.col("r") * F.col("r") - F.col("oy") * F.col("oy")).cast("double"))).cast("int")
    shift = ("scene_id", "sx", "sy")
    whole = merged(rows.select(*shift, (F.col("y") + F.col("oy")).alias("y"), (F.col("x1") - half).alias("x1"), (F.col("x2") + half).alias("x2")), shift)
    shifts = F.array_distinct(F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")), F.struct(F.col("sx").alias("x"), F.col("sy").alias("y"))))
    every = whole.select("scene_id", "y", "x1", "x2", F.explode(shifts).alias("s"))
    every = every.select("scene_id", (F.col("y") + F.col("s.y")).alias("y"), F.greatest(F.col("x1") + F.col("s.x"), F.lit(0)).alias("x1"), F.least(F.col("x2") + F.col("s.x"), F.lit(width - 1)).alias("x2"))
    return merged(every.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x1") <= F.col("x2"))))


def spread_step(mask: DataFrame, weather: DataFrame, hours: float, width: int, height: int) -> DataFrame:
    """The mask after one step: itself, its growth, and the growth shifted downwind, clipped to the image.

    weather has one row a scene; scenes without one don't change. A growth as large as the image's diagonal floods
    all. Runs grow and are merged before pixels are made, so each pixel is made once.
    """
    return run_pixels(grown(runs(mask), weather, hours, width, height))


def frame_plan(horizon: float) -> list[tuple[float, float | None, float]]:
    """(hour, hour it grows from, step) of every frame of a horizon; hour 0 is the mask itself.

    Sub-hours up to the first hour grow from the source, whole hours from 2 on from the hour before, a fraction at
    the end from the last whole hour. A horizon below every sub-hour has a frame of its own.
    """
    plan: list[tuple[float, float | None, float]] = [(0.0, None, 0.0)]
    plan += [(h, 0.0, h) for h in SUB_HOURS if h <= min(1.0, horizon) + 1e-9]
    if horizon > 0 and len(plan) == 1:
        plan.append((horizon, 0.0, horizon))
    whole = int(horizon + 1e-9)
    plan += [(float(h), float(h - 1), 1.0) for h in range(2, whole + 1)]
    if whole >= 1 and horizon - whole > 1e-9:
        plan.append((horizon, float(whole), horizon - whole))
    return plan


def forecast_runs(mask: DataFrame, weather: DataFrame, horizon: float, width: int, height: int) -> DataFrame:
    """scene_id, hour, y, x1, x2: the runs of all frames of a horizon, for all scenes at once; each frame is written once,
    as runs, which are a small share of its pixels."""
    frames: dict[float, DataFrame] = {}
    for hour, base, step in frame_plan(horizon):
        frame = runs(mask).select("scene_id", "y", "x1", "x2") if base is None else grown(frames[base], weather, step, width, height)
        frames[hour] = stored(frame, "frame")
    out = None
    for hour, frame in frames.items():
        told = frame.select("scene_id", F.lit(float(hour)).alias("hour"), F.col("y").cast("int").alias("y"), F.col("x1").cast("int").alias("x1"), F.col("x2").cast("int").alias("x2"))
        out = told if out is None else out.union(told)
    return out


def frame_pixels(frames: DataFrame) -> DataFrame:
    """scene_id, hour, x, y of the runs of frames."""
    return frames.select("scene_id", "hour", F.explode(F.sequence("x1", "x2")).alias("x"), "y")


def forecast(mask: DataFrame, weather: DataFrame, horizon: float, width: int, height: int) -> DataFrame:
    """scene_id, hour, x, y: all frames of a horizon, for all scenes at once (see forecast_runs)."""
    return frame_pixels(forecast_runs(mask, weather, horizon, width, height))


def hourly_chain(mask: DataFrame, horizon: float, predictor: Callable[[DataFrame, float], DataFrame]) -> DataFrame:
    """scene_id, hour, x, y with a predictor of the caller's (mask, hours) -> mask, one hour from the last.

    A horizon that isn't whole has its last frame computed from the source.
    """
    whole = int(horizon + 1e-9)
    frame, out = mask.select(*PIXEL), mask.select("scene_id", F.lit(0.0).alias("hour"), "x", "y")
    for hour in range(1, whole + 1):
        frame = stored(predictor(frame, 1.0).select(*PIXEL), "hour")
        out = out.union(frame.select("scene_id", F.lit(float(hour)).alias("hour"), "x", "y"))
    if horizon - whole > 1e-9:
        out = out.union(predictor(mask.select(*PIXEL), horizon).select("scene_id", F.lit(float(horizon)).alias("hour"), "x", "y"))
    return out


def lost_pixels(frames: DataFrame) -> DataFrame:
    """Pixels of a frame that the next one doesn't hold, as sub-hour frames need not be nested.

    frames has the pixels (x, y) of each hour, or its runs (y, x1, x2; see forecast_runs), and so has the result. Runs that
    lie in a frame alone are told along each row, so that no pixel of one frame meets those of another.
    """
    from pyspark.sql import Window

    in_runs, key = "x1" in frames.columns, ("scene_id", "hour")
    step = Window.partitionBy("scene_id").orderBy("hour")
    hours = frames.select(*key).distinct().select(*key, F.lead("hour").over(step).alias("next"), F.lag("hour").over(step).alias("before"))
    asked = hours.groupBy("scene_id").agg(F.collect_list(F.struct("hour", "next", "before")).alias("_h"))
    own = by_scene(frames if in_runs else runs(frames, key)).join(asked.hint("shuffle_hash"), "scene_id")
    own = own.withColumn("_s", F.filter("_h", lambda h: h["hour"] == F.col("hour"))[0])
    # a frame has weight 1 in its own step, and 2 in that of the frame before it
    steps = F.array(F.struct(F.when(F.col("_s.next").isNotNull(), F.col("hour")).alias("hour"), F.lit(1).alias("n")), F.struct(F.col("_s.before").alias("hour"), F.lit(2).alias("n")))
    sent = own.select("scene_id", F.explode(steps).alias("t"), "y", "x1", "x2").select("scene_id", "t.hour", "t.n", "y", "x1", "x2").where("hour IS NOT NULL")
    lost = merged(layers(sent, F.col("n"), key).where("n = 1").drop("n"), key)
    return lost if in_runs else frame_pixels(lost)
