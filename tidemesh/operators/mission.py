"""Mission items: expansion of routes, checks of mission texts, and the text sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemesh import defaults as D
from tidemesh.functions.geodesy import pixel_to_latlon

# The mission format's header, commands and limits.
HEADER = "QGC WPL 110"
WAYPOINT, LOITER, RETURN, LAND, TAKEOFF, SERVO = 16, 19, 20, 21, 22, 183
COMMANDS = (WAYPOINT, LOITER, RETURN, LAND, TAKEOFF, SERVO)
FIELDS = ("seq", "current", "frame", "command", "p1", "p2", "p3", "p4", "lat", "lon", "alt", "autocontinue")


def items(points: DataFrame, scenes: DataFrame, altitude: int = D.ALTITUDE, drop_altitude: int = D.DROP_ALTITUDE) -> DataFrame:
    """scene_id, base_id and FIELDS: the mission of every route.

    A mission is home (frame 0), take-off, a waypoint for each point after the first, then return and landing. An
    interior drop adds loiter, descent, release and climb; a reload adds landing and take-off. Points whose position
    can't be told in degrees give null positions, which the checks report.
    """
    route = Window.partitionBy("scene_id", "base_id")
    told = points.withColumn("_first", F.min("seq").over(route)).withColumn("_last", F.max("seq").over(route)).join(scenes, "scene_id")
    told = told.withColumn("_p", pixel_to_latlon(F.col("x"), F.col("y"), F.col("width") / 2, F.col("height") / 2, F.col("lat"), F.col("lon"), F.col("m_per_px")))

    def item(frame: int, command: int, alt: float, at: bool = True, p1: float = 0.0, p2: float = 0.0):
        where = (F.col("_p.lat"), F.col("_p.lon")) if at else (F.lit(0.0), F.lit(0.0))
        cells = [F.lit(frame), F.lit(command), F.lit(p1), F.lit(p2), F.lit(0.0), F.lit(0.0), *where, F.lit(float(alt)), F.lit(1)]
        return F.struct(*(c.alias(k) for c, k in zip(cells, FIELDS[2:], strict=True)))

    first, last = F.col("seq") == F.col("_first"), F.col("seq") == F.col("_last")
    start = F.when(first, F.array(item(0, WAYPOINT, 0), item(3, TAKEOFF, altitude)))
    way = F.when(~first, F.array(item(3, WAYPOINT, altitude)))
    drop = F.when(~first & ~last & (F.col("kind") == "drop"), F.array(item(3, LOITER, altitude, p1=float(D.LOITER_S)), item(3, WAYPOINT, drop_altitude), item(3, SERVO, 0, False, float(D.SERVO_CHANNEL), float(D.SERVO_PWM)), item(3, WAYPOINT, altitude)))
    reload = F.when(F.col("kind") == "reload", F.array(item(3, LAND, 0), item(3, TAKEOFF, altitude)))
    end = F.when(last, F.array(item(3, RETURN, 0, False), item(3, LAND, 0)))
    none = F.filter(F.array(item(0, 0, 0)), lambda x: F.lit(False))
    every = F.concat(*(F.coalesce(a, none) for a in (start, way, drop, reload, end)))
    rows = told.select("scene_id", "base_id", F.col("seq").alias("_seq"), F.posexplode(every))
    number = F.row_number().over(route.orderBy("_seq", "pos")) - 1
    return rows.select("scene_id", "base_id", number.alias("seq"), (number == 0).cast("int").alias("current"), "col.*")


def lines(missions: DataFrame) -> DataFrame:
    """scene_id, base_id, line_no, line: the texts of missions, header first."""
    short = lambda c: F.regexp_replace(F.format_string("%.6f", F.col(c)), r"\.?0+$", "")
    cells = ["seq", "current", "frame", "command", *(short(c) for c in ("p1", "p2", "p3", "p4")), F.col("lat").cast("string"), F.col("lon").cast("string"), short("alt"), "autocontinue"]
    told = missions.select("scene_id", "base_id", (F.col("seq") + 1).alias("line_no"), F.concat_ws("\t", *cells).alias("line"))
    heads = missions.select("scene_id", "base_id").distinct().select("scene_id", "base_id", F.lit(0).alias("line_no"), F.lit(HEADER).alias("line"))
    return heads.union(told)


def write_missions(missions: DataFrame, path: str, run_id: str) -> None:
    """Writes every mission as text under path/run_id=.../scene_id=.../base_id=..., after all its items passed.

    A run's folder is never reused: an existing one is an error.
    """
    bad = problems(lines(missions).withColumn("mission_id", F.struct("scene_id", "base_id")))
    if not bad.isEmpty():
        raise ValueError(f"mission items break rules: {bad.first()}")
    told = lines(missions).repartition("scene_id", "base_id").sortWithinPartitions("scene_id", "base_id", "line_no")
    told.select("line", "scene_id", "base_id").write.mode("errorifexists").partitionBy("scene_id", "base_id").text(f"{path}/run_id={run_id}")


def problems(texts: DataFrame) -> DataFrame:
    """mission_id, line_no, problem: one row for each rule that a line breaks.

    texts has mission_id, line_no (0: the header) and line. Lines that aren't 12 numbers are told that only.
    """
    f = F.split("line", "\t")
    number = lambda i: F.get(f, F.lit(i)).try_cast("double")
    told = texts.select("mission_id", "line_no", "line", F.size(f).alias("n"), *(number(i).alias(name) for i, name in enumerate(FIELDS)))
    c, all_numbers = F.col, F.lit(True)
    for name in FIELDS:
        all_numbers = all_numbers & c(name).isNotNull() & ~F.isnan(name)
    known = c("command").isin([float(x) for x in COMMANDS])
    placed = c("command").isin(float(WAYPOINT), float(LOITER), float(LAND), float(TAKEOFF))
    rules = {
        "seq": c("seq") != c("line_no") - 1,
        "current": c("current") != (c("line_no") == 1).cast("double"),
        "frame": ~c("frame").isin(0.0, 3.0),
        "command": ~known,
        "position": placed & ((F.abs("lat") > 90) | (F.abs("lon") > 180) | ((c("lat") == 0) & (c("lon") == 0))),
        "autocontinue": c("autocontinue") != 1,
        "servo": (c("command") == SERVO) & ((c("p1") < 1) | (c("p2") < 800) | (c("p2") > 2200)),
    }
    body = F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())))
    text = F.array()
    found = F.when(c("line_no") == 0, F.when(c("line") != HEADER, F.array(F.lit("header"))).otherwise(text)).when(c("n") != 12, F.array(F.lit("fields"))).when(~all_numbers, F.array(F.lit("number"))).otherwise(body)
    return told.select("mission_id", "line_no", F.explode(found).alias("problem"))


def bad_reloads(points: DataFrame) -> DataFrame:
    """Reload points that aren't interior, or not at their route's first point."""
    route = Window.partitionBy("scene_id", "base_id")
    told = points.withColumn("_a", F.min("seq").over(route)).withColumn("_b", F.max("seq").over(route)).withColumn("_h", F.min_by(F.struct("x", "y"), "seq").over(route))
    return told.where("kind = 'reload' AND (seq <= _a OR seq >= _b OR x <> _h.x OR y <> _h.y)").select(*points.columns)
