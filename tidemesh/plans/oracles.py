"""DuckDB SQL that states the results of the flood-relief queries, over the same derived views."""

from __future__ import annotations

from tidemesh import defaults as D
from tidemesh.operators import grid, masks, mission, spread, weather
from tidemesh.sources.fixtures import HEIGHT as H
from tidemesh.sources.fixtures import M_PER_PX as M
from tidemesh.sources.fixtures import WIDTH as W
from tidemesh.sources.fixtures import with_views

_COUNT = "SELECT scene_id, count(*) AS n, sum(x * 1000 + y)::BIGINT AS checksum FROM {} GROUP BY scene_id"
_IMAGE = f"x BETWEEN 0 AND {W - 1} AND y BETWEEN 0 AND {H - 1}"


def _fine(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN NULL ELSE {c} END"


_NEWEST = """newest AS (
  SELECT site_id, coalesce(p, 0) AS precipitation, coalesce(s, 0) AS wind_speed_10m, coalesce(d, 0) AS wind_direction_10m,
         CASE WHEN p IS NULL OR s IS NULL OR d IS NULL THEN 'partial' ELSE 'success' END AS status
  FROM (SELECT site_id, precipitation AS p, wind_speed_10m AS s, wind_direction_10m AS d, row_number() OVER (PARTITION BY site_id ORDER BY obs_ts DESC) AS k FROM weather_obs) WHERE k = 1)"""
_WEATHER = f"""{_NEWEST}, wx AS (
  SELECT w.scene_id, n.precipitation, n.wind_speed_10m, n.wind_direction_10m
  FROM (SELECT scene_id, min(site_id) AS site_id FROM weather_obs GROUP BY scene_id) w JOIN newest n USING (site_id))"""


def _offsets(offsets: list[tuple[int, int]]) -> str:
    return "(VALUES " + ", ".join(f"({a}, {b})" for a, b in offsets) + ") o(dx, dy)"


def _dilated(mask: str, offsets: list[tuple[int, int]]) -> str:
    return f"SELECT DISTINCT scene_id, x, y FROM (SELECT scene_id, x + dx AS x, y + dy AS y FROM {mask}, {_offsets(offsets)}) WHERE {_IMAGE}"


def _eroded(mask: str, r: int) -> str:
    full = f"(least(x + {r}, {W - 1}) - greatest(x - {r}, 0) + 1) * (least(y + {r}, {H - 1}) - greatest(y - {r}, 0) + 1)"
    return f"SELECT scene_id, x, y FROM (SELECT scene_id, x + dx AS x, y + dy AS y FROM {mask}, {_offsets(masks.square(r))}) WHERE {_IMAGE} GROUP BY scene_id, x, y HAVING count(*) = {full}"


def _step(mask: str, hours: float) -> str:
    """One spread step, pixel by pixel from the definition (no boundary, no runs)."""
    growth = f"(greatest(0, precipitation) / {D.RAIN_PER_PX}::DOUBLE * {hours!r}::DOUBLE)"
    push = f"(greatest(0, wind_speed_10m) / {D.WIND_PER_PX}::DOUBLE * {hours!r}::DOUBLE)"
    return f"""SELECT DISTINCT scene_id, x::INT AS x, y::INT AS y FROM (
      WITH told AS (SELECT scene_id, (floor({growth}) + (round_even(255 * ({growth} - floor({growth})), 0) >= 128)::INT)::INT AS r,
                           round_even(sin(radians(wind_direction_10m + 180)) * {push}, 0)::INT AS sx, round_even(-cos(radians(wind_direction_10m + 180)) * {push}, 0)::INT AS sy FROM wx),
      disc AS (SELECT m.scene_id, m.x + dx AS x, m.y + dy AS y, sx, sy FROM {mask} m JOIN told USING (scene_id),
                 (SELECT unnest(range(-8, 9)) AS dx) a, (SELECT unnest(range(-8, 9)) AS dy) b
               WHERE abs(dy) <= r AND abs(dx) <= round_even(sqrt(greatest(0, r * r - dy * dy)), 0))
      SELECT scene_id, x, y FROM disc UNION ALL SELECT scene_id, x + sx, y + sy FROM disc UNION ALL SELECT scene_id, x, y FROM {mask}) WHERE {_IMAGE}"""


def _frames(horizon: float) -> tuple[str, str]:
    """(common table expressions, union of all frames)."""
    names, parts, union = {}, [], []
    for i, (hour, base, step) in enumerate(spread.frame_plan(horizon)):
        names[hour] = f"f{i}"
        parts.append(f"f{i} AS MATERIALIZED ({'SELECT scene_id, x, y FROM mask' if base is None else _step(names[base], step)})")
        union.append(f"SELECT scene_id, {hour!r}::DOUBLE AS hour, x, y FROM f{i}")
    return ", ".join(parts), " UNION ALL ".join(union)


# Holes are dry runs that no dry run of the frame round the image reaches; regions are classes of the filled mask's runs.
_RUNS = "SELECT scene_id, y::INT AS y, min(x)::INT AS x1, max(x)::INT AS x2 FROM (SELECT scene_id, x, y, x - row_number() OVER (PARTITION BY scene_id, y ORDER BY x) AS g FROM {}) GROUP BY scene_id, y, g"
_REGIONS = f"""wet AS MATERIALIZED ({_RUNS.format("mask")}), gap AS MATERIALIZED (SELECT * FROM (
    SELECT w.scene_id, w.y, coalesce(lag(w.x2) OVER k, -2) + 1 AS x1, w.x1 - 1 AS x2 FROM wet w WINDOW k AS (PARTITION BY w.scene_id, w.y ORDER BY w.x1)
    UNION ALL SELECT w.scene_id, w.y, max(w.x2) + 1, {W} FROM wet w GROUP BY w.scene_id, w.y
    UNION ALL SELECT s.scene_id, r.y, -1, {W} FROM (SELECT DISTINCT scene_id FROM mask) s, (SELECT unnest(range(-1, {H} + 1))::INT AS y) r WHERE NOT EXISTS (SELECT 1 FROM wet w WHERE w.scene_id = s.scene_id AND w.y = r.y)) WHERE x1 <= x2), outside AS (
    SELECT * FROM gap WHERE y = -1 UNION SELECT g.* FROM outside o JOIN gap g ON g.scene_id = o.scene_id AND (g.y = o.y + 1 OR g.y = o.y - 1) AND g.x1 <= o.x2 AND g.x2 >= o.x1), whole AS MATERIALIZED (
    SELECT scene_id, x, y FROM mask UNION SELECT scene_id, unnest(range(x1, x2 + 1)) AS x, y FROM (SELECT * FROM gap EXCEPT SELECT * FROM outside)), run AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY scene_id, y, x1) AS id, * FROM ({_RUNS.format("whole")})), edge AS MATERIALIZED (
    SELECT a.id AS a, b.id AS b FROM run a JOIN run b ON a.scene_id = b.scene_id AND (b.y = a.y + 1 OR b.y = a.y - 1) AND b.x1 <= a.x2 + 1 AND b.x2 >= a.x1 - 1), reach AS (
    SELECT id AS a, id AS b FROM run UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b), px AS MATERIALIZED (
    SELECT scene_id, region, unnest(range(x1, x2 + 1)) AS x, y FROM run JOIN (SELECT a AS id, min(b) AS region FROM reach GROUP BY a) USING (id))"""

# The overlay's share of an 11 x 11 square: sums along rows of the mirrored image, then along columns.
_DENSITY = f"""img AS (SELECT scene_id, unnest(list_distinct([x] || CASE WHEN x BETWEEN 1 AND 5 THEN [-x] ELSE [] END || CASE WHEN x BETWEEN {W - 6} AND {W - 2} THEN [{2 * (W - 1)} - x] ELSE [] END)) AS x, y FROM mask), im2 AS (
        SELECT scene_id, x, unnest(list_distinct([y] || CASE WHEN y BETWEEN 1 AND 5 THEN [-y] ELSE [] END || CASE WHEN y BETWEEN {H - 6} AND {H - 2} THEN [{2 * (H - 1)} - y] ELSE [] END)) AS y FROM img), along AS (
        SELECT scene_id, x + o AS x, y, count(*) AS n FROM im2, (SELECT unnest(range(-5, 6)) AS o) GROUP BY ALL), square AS (
        SELECT scene_id, x, y + o AS y, sum(n) AS n FROM along, (SELECT unnest(range(-5, 6)) AS o) GROUP BY ALL), d AS MATERIALIZED (
        SELECT scene_id, x, y, n / 121.0::DOUBLE AS d FROM mask JOIN square USING (scene_id, x, y))"""
_PICK = "SELECT scene_id, {}::INT AS pick, x, y FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY e, y, x) AS r FROM k WHERE {}) WHERE r = 1"
_APART = "NOT EXISTS (SELECT 1 FROM {0} WHERE {0}.scene_id = k.scene_id AND sqrt((k.x - {0}.x) * (k.x - {0}.x) + (k.y - {0}.y) * (k.y - {0}.y)) < 40)"

_SAMPLE = "smp AS (SELECT scene_id, x AS sx, y AS sy FROM (SELECT scene_id, x, y, row_number() OVER (PARTITION BY scene_id ORDER BY (x * 31 + y * 17) % 101, x, y) AS k FROM mask) WHERE k = 1)"
_LIMITS = f"""{_SAMPLE}, ends AS (
  SELECT p.scene_id, min(h) AS a, max(h) AS b, min(s) AS c, max(s) AS d, min(v) AS e, max(v) AS f FROM pixels_hsv p JOIN smp USING (scene_id)
  WHERE p.x BETWEEN sx - 5 AND sx + 5 AND p.y BETWEEN sy - 5 AND sy + 5 GROUP BY p.scene_id), limits AS (
  SELECT scene_id, greatest(0, a - 20)::INT AS h_lo, least(179, b + 20)::INT AS h_hi, greatest(0, c - 30)::INT AS s_lo, least(255, d + 30)::INT AS s_hi,
         greatest(0, e - 30)::INT AS v_lo, least(255, f + 30)::INT AS v_hi, greatest(0, a - 20) <= 10 OR least(179, b + 20) >= 170 AS wrap FROM ends)"""

_B, _G, _R = "((x * 13 + y * 7) % 256)", "((x * 5 + y * 11 + scene_id) % 256)", "s"
_MINUTES = f"(distance_m / {D.SPEED_MPS}::DOUBLE / 60)"
_WIND = f"({30.0}::DOUBLE / 3.6)"
_NEED = f"({_MINUTES} * (1 + {D.PER_DROP_KG}::DOUBLE * {D.PAYLOAD_FACTOR}::DOUBLE + {_WIND} * {D.WIND_FACTOR}::DOUBLE) / {D.ENDURANCE_MIN}::DOUBLE + {_MINUTES} * (1 + {_WIND} * {D.WIND_FACTOR}::DOUBLE) / {D.ENDURANCE_MIN}::DOUBLE)"
_REACH = f"""reached AS MATERIALIZED (SELECT * FROM (
  SELECT c.scene_id, cand_id, drop_id, sqrt((d.x - c.x) * (d.x - c.x) + (d.y - c.y) * (d.y - c.y)) * {M}::DOUBLE AS distance_m
  FROM candidates c JOIN drops d USING (scene_id)) WHERE {_NEED} <= 1 - {D.RESERVE}::DOUBLE)"""
_ASSIGN = "assigned AS MATERIALIZED (SELECT scene_id, drop_id, cand_id AS base_id, distance_m FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, drop_id ORDER BY distance_m, cand_id) AS k FROM reached) WHERE k = 1)"
_REACH = _REACH.replace(f"{30.0}::DOUBLE / 3.6", "CASE WHEN scene_id IN (SELECT scene_id FROM scenes) THEN 30.0::DOUBLE ELSE 0 END / 3.6")

# Greedy nearest neighbour, a row per stop: the next one is the nearest that isn't on the list yet.
_ORDER = f"""{_REACH}, {_ASSIGN}, stops AS MATERIALIZED (
  SELECT d.scene_id, base_id, list({{'drop_id': drop_id, 'x': d.x, 'y': d.y}} ORDER BY drop_id) AS ps FROM drops d JOIN assigned USING (scene_id, drop_id) GROUP BY ALL), walk AS (
  SELECT scene_id, base_id, 0 AS seq, NULL::BIGINT AS drop_id, c.x, c.y, ps FROM stops JOIN candidates c USING (scene_id) WHERE c.cand_id = base_id
  UNION ALL
  SELECT scene_id, base_id, seq + 1, n.drop_id, n.x, n.y, list_filter(ps, lambda p: p.drop_id <> n.drop_id) FROM (
    SELECT *, list_sort([{{'d': (p.x - x) * (p.x - x) + (p.y - y) * (p.y - y), 'drop_id': p.drop_id, 'x': p.x, 'y': p.y}} FOR p IN ps])[1] AS n FROM walk WHERE len(ps) > 0)), visit AS MATERIALIZED (
  SELECT scene_id, base_id, seq, drop_id, x, y FROM walk WHERE seq > 0)"""
_ROUTE = f"""{_ORDER}, ends AS (SELECT scene_id, base_id, max(seq) AS n FROM visit GROUP BY ALL), parts AS (
  SELECT scene_id, base_id, seq AS a, 1 AS b, x, y, 'drop' AS kind FROM visit
  UNION ALL SELECT e.scene_id, base_id, 0, 0, c.x, c.y, 'home' FROM ends e JOIN candidates c ON c.scene_id = e.scene_id AND c.cand_id = base_id
  UNION ALL SELECT e.scene_id, base_id, n, 2, c.x, c.y, 'home' FROM ends e JOIN candidates c ON c.scene_id = e.scene_id AND c.cand_id = base_id
  UNION ALL SELECT e.scene_id, base_id, v.seq, k, c.x, c.y, CASE k WHEN 2 THEN 'reload' ELSE 'via' END FROM ends e JOIN visit v USING (scene_id, base_id) JOIN candidates c ON c.scene_id = e.scene_id AND c.cand_id = base_id, (VALUES (2), (3)) t(k) WHERE v.seq % 4 = 0 AND v.seq < n), route AS MATERIALIZED (
  SELECT scene_id, base_id, (row_number() OVER (PARTITION BY scene_id, base_id ORDER BY a, b) - 1)::INT AS seq, x, y, kind FROM parts)"""
_SEGMENTS = "segs AS MATERIALIZED (SELECT * FROM (SELECT scene_id, base_id, seq AS seg, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS bz FROM route WINDOW w AS (PARTITION BY scene_id, base_id ORDER BY seq)) WHERE bx IS NOT NULL AND (ax <> bx OR ay <> bz))"


def _turn(o: str, p: str, q: str) -> str:
    return f"sign(({p}x - {o}x) * ({q}y - {o}y) - ({p}y - {o}y) * ({q}x - {o}x))"


_LAT = f"(s.lat + ({H / 2} - y) * {M}::DOUBLE / {D.METRES_PER_DEGREE}::DOUBLE)"
_LON = f"(s.lon + (x - {W / 2}) * {M}::DOUBLE / ({D.METRES_PER_DEGREE}::DOUBLE * cos(radians(s.lat))))"
_ITEM = "{a} AS a, {b} AS b, {frame} AS frame, {command} AS command, {p1}::DOUBLE AS p1, {p2}::DOUBLE AS p2, 0::DOUBLE AS p3, 0::DOUBLE AS p4, {lat} AS lat, {lon} AS lon, {alt}::DOUBLE AS alt"


def _items(where: str, cells: list[tuple], group: int) -> str:
    out = []
    for i, (frame, command, p1, p2, at, alt) in enumerate(cells):
        out.append("SELECT scene_id, base_id, " + _ITEM.format(a="seq", b=group * 10 + i, frame=frame, command=command, p1=p1, p2=p2, lat="lat" if at else "0::DOUBLE", lon="lon" if at else "0::DOUBLE", alt=alt) + f" FROM told WHERE {where}")
    return " UNION ALL ".join(out)


_ITEMS = " UNION ALL ".join([
    _items("seq = 0", [(0, 16, 0, 0, True, 0), (3, 22, 0, 0, True, D.ALTITUDE)], 0),
    _items("seq > 0", [(3, 16, 0, 0, True, D.ALTITUDE)], 1),
    _items("seq > 0 AND seq < last AND kind = 'drop'", [(3, 19, D.LOITER_S, 0, True, D.ALTITUDE), (3, 16, 0, 0, True, D.DROP_ALTITUDE), (3, 183, D.SERVO_CHANNEL, D.SERVO_PWM, False, 0), (3, 16, 0, 0, True, D.ALTITUDE)], 2),
    _items("kind = 'reload'", [(3, 21, 0, 0, True, 0), (3, 22, 0, 0, True, D.ALTITUDE)], 3),
    _items("seq = last", [(3, 20, 0, 0, False, 0), (3, 21, 0, 0, True, 0)], 4),
])

_F2, _F2_ALL = _frames(2.5)
_F1, _F1_ALL = _frames(1.0)
_PRESETS = ", ".join(f"('{n}', {la}::DOUBLE, {lo}::DOUBLE)" for n, la, lo, _ in weather.PRESETS)
_COMMANDS = ", ".join(map(str, mission.COMMANDS))

_CLOSED = f"m1 AS MATERIALIZED ({_dilated('mask', masks.square(2))}), m2 AS MATERIALIZED ({_eroded('m1', 2)}), m3 AS MATERIALIZED ({_eroded('m2', 2)}), m4 AS ({_dilated('m3', masks.square(2))})"

ORACLES = {
    "s3_latest_weather": with_views("weather_obs", f"""{_NEWEST}
        SELECT s.site_id, coalesce(precipitation, 0) AS precipitation, coalesce(wind_speed_10m, 0) AS wind_speed_10m, coalesce(wind_direction_10m, 0) AS wind_direction_10m, coalesce(status, 'fallback') AS status
        FROM (SELECT DISTINCT site_id FROM weather_obs UNION SELECT unnest([-3, -2, -1])) s LEFT JOIN newest USING (site_id)"""),
    "s4_region_presets": f"""SELECT c_custkey AS map_id, stem, coalesce(CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 90 END, lat, {D.DEFAULT_LAT})::DOUBLE AS lat, coalesce(lon, {D.DEFAULT_LON})::DOUBLE AS lon
        FROM (SELECT c_custkey, ['varanasi', 'kanpur', 'bhopal.v2', 'other'][(c_custkey % 4 + 1)::INT] AS stem FROM customer) LEFT JOIN (VALUES {_PRESETS}) p(name, lat, lon) ON stem = name""",
    "p1_bgr_to_hsv": with_views("pixels_hsv", f"""t AS (SELECT scene_id, {_B} AS b, {_G} AS g, {_R} AS r FROM pixels_hsv), u AS (
        SELECT *, greatest(b, g, r) AS v, (greatest(b, g, r) - least(b, g, r))::DOUBLE AS d FROM t), q AS (
        SELECT *, CASE WHEN d = 0 THEN 0 WHEN v = r THEN 60 * (g - b) / d WHEN v = g THEN 120 + 60 * (b - r) / d ELSE 240 + 60 * (r - g) / d END AS a FROM u), w AS (
        SELECT scene_id, v, CASE WHEN v = 0 THEN 0 ELSE round_even(255 * d / v, 0)::INT END AS s, round_even((CASE WHEN a < 0 THEN a + 360 ELSE a END) / 2, 0)::INT AS h FROM q)
        SELECT scene_id, sum(CASE WHEN h = 180 THEN 0 ELSE h END)::BIGINT AS sum_h, sum(s)::BIGINT AS sum_s, sum(v)::BIGINT AS sum_v, count(*) AS n FROM w GROUP BY scene_id"""),
    "a3_sample_thresholds": with_views("pixels_hsv", f"{_LIMITS} SELECT * FROM limits"),
    "p3_threshold_mask": with_views("pixels_hsv", f"""{_LIMITS}, hit AS (SELECT scene_id, x, y FROM pixels_hsv JOIN limits USING (scene_id)
        WHERE (CASE WHEN wrap THEN h BETWEEN 0 AND 10 OR h BETWEEN 170 AND 179 ELSE h BETWEEN h_lo AND h_hi END) AND s BETWEEN s_lo AND s_hi AND v BETWEEN v_lo AND v_hi) {_COUNT.format('hit')}"""),
    "p4_normalise": with_views("pixels_hsv", """SELECT scene_id, sum(z)::BIGINT AS total, max(z) AS top FROM (
        SELECT scene_id, round_even((s - min(s) OVER w) * 255.0::DOUBLE / (max(s) OVER w - min(s) OVER w), 0)::INT AS z FROM pixels_hsv WINDOW w AS (PARTITION BY scene_id)) GROUP BY scene_id"""),
    "p5_sanitise": with_views("weather_obs", f"""t AS (SELECT precipitation AS p, CASE WHEN wind_speed_10m IN (13, 14) THEN NULL ELSE wind_speed_10m END AS s, wind_direction_10m AS d FROM weather_obs)
        SELECT CASE WHEN p IS NULL OR s IS NULL OR d IS NULL THEN 'partial' ELSE 'success' END AS status, coalesce(s, 0) > {D.WIND_LIMIT} AS too_windy, coalesce(p, 0) > {D.RAIN_LIMIT} AS too_wet,
               count(*) AS n, round(sum(coalesce(p, 0)), 4) AS rain, sum(coalesce(s, 0)) AS wind, sum((p IS NULL)::INT + (s IS NULL)::INT + (d IS NULL)::INT)::BIGINT AS bad FROM t GROUP BY ALL"""),
    "t1_hourly_weather": with_views("weather_obs", """SELECT site_id, date_trunc('hour', obs_ts) AS hour_start, count(*) AS n, round(avg(coalesce(precipitation, 0)), 6) AS precipitation,
        round(avg(coalesce(wind_speed_10m, 0)), 6) AS wind_speed_10m, round(avg(coalesce(wind_direction_10m, 0)), 6) AS wind_direction_10m FROM weather_obs GROUP BY ALL"""),
    "t1_weather_stream": with_views("weather_obs", """SELECT site_id, date_trunc('hour', obs_ts) AS hour_start, count(*) AS n, round(avg(coalesce(precipitation, 0)), 6) AS precipitation,
        round(avg(coalesce(wind_speed_10m, 0)), 6) AS wind_speed_10m, round(avg(coalesce(wind_direction_10m, 0)), 6) AS wind_direction_10m FROM weather_obs GROUP BY ALL"""),
    "t1_stream_sites": with_views("weather_obs", """SELECT site_id, max(obs_ts) AS newest_ts, arg_max(coalesce(precipitation, 0), obs_ts)::DOUBLE AS precipitation, arg_max(wind_speed_10m, obs_ts)::DOUBLE AS wind_speed_10m,
        arg_max(wind_direction_10m, obs_ts)::DOUBLE AS wind_direction_10m, count(*) AS n, 0::BIGINT AS late, (count(*) - count(DISTINCT obs_ts))::BIGINT AS repeated FROM weather_obs GROUP BY site_id"""),
    "p7_pixel_to_latlon": with_views("drops scenes", f"""t AS (SELECT d.scene_id, drop_id, {_LAT} AS lat, {_LON.replace('s.lon', '179.995::DOUBLE')} AS lon, drop_id % 50 = 7 AS bad FROM drops d JOIN scenes s USING (scene_id))
        SELECT scene_id, drop_id, CASE WHEN NOT bad THEN round(lat, 6) END AS lat, CASE WHEN NOT bad THEN round(CASE WHEN lon > 180 THEN lon - 360 ELSE lon END, 6) END AS lon, CASE WHEN bad THEN 'scale' END AS error FROM t"""),
    "p10_leg_costs": with_views("drops weather_obs", f"""{_WEATHER}, t AS (
        SELECT scene_id, drop_id, (x - {W // 2})::DOUBLE AS dx, (y - {H // 2})::DOUBLE AS dy, wind_speed_10m / 3.6 AS w, wind_direction_10m AS f FROM drops JOIN wx USING (scene_id)), u AS (
        SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE greatest(0, w * cos(radians(f - degrees(atan2(dx, -dy))))) END AS against FROM t)
        SELECT scene_id, drop_id, round(against, 6) AS headwind, round(sqrt(dx * dx + dy * dy) * {M}::DOUBLE / {D.SPEED_MPS}::DOUBLE / 60 * (1 + {D.PER_DROP_KG}::DOUBLE * {D.PAYLOAD_FACTOR}::DOUBLE + against * {D.WIND_FACTOR}::DOUBLE) / {D.ENDURANCE_MIN}::DOUBLE, 6) AS battery FROM u"""),
    "p12_segment_distance": with_views("drops candidates", """k AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY cand_id) AS k FROM candidates), s AS (
        SELECT a.scene_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bz FROM k a JOIN k b USING (scene_id) WHERE a.k = 1 AND b.k = 2), t AS (
        SELECT d.scene_id, drop_id, x, y, ax, ay, bx - ax AS dx, bz - ay AS dy, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (bz - ay))::DOUBLE / ((bx - ax) * (bx - ax) + (bz - ay) * (bz - ay)))) AS t FROM drops d JOIN s USING (scene_id))
        SELECT scene_id, drop_id, round(sqrt(pow(x - (ax + t * dx), 2) + pow(y - (ay + t * dy), 2)), 6) AS distance FROM t"""),
    "p13_cells": with_views("drops", f"SELECT scene_id, drop_id, least({W // 3 - 1}, x // 3)::INT AS cx, least({H // 3 - 1}, y // 3)::INT AS cy, (least({W // 3 - 1}, x // 3) * 3 + 1)::INT AS px, (least({H // 3 - 1}, y // 3) * 3 + 1)::INT AS py FROM drops"),
    "p15_coverage": with_views("mask scenes", f"""t AS (SELECT scene_id, count(m.x) AS flooded, count(m.x) / ({W} * {H}) AS share FROM scenes LEFT JOIN mask m USING (scene_id) GROUP BY scene_id)
        SELECT scene_id, flooded, round(share, 6) AS share, CASE WHEN flooded = 0 THEN 'dry' WHEN share > 0.24 THEN 'too_much' WHEN share NOT BETWEEN {D.MIN_COVERAGE} AND {D.MAX_COVERAGE} THEN 'implausible' ELSE 'ok' END AS status FROM t"""),
    "p17_clear_candidates": with_views("candidates mask", f"""t AS (SELECT c.scene_id, cand_id, sqrt(min((m.x - c.x) * (m.x - c.x) + (m.y - c.y) * (m.y - c.y))) AS d FROM candidates c LEFT JOIN mask m USING (scene_id) GROUP BY ALL)
        SELECT scene_id, cand_id, round(least(16, coalesce(d, 16)), 6)::DOUBLE AS clearance FROM t WHERE coalesce(d, 16) >= {D.CLEARANCE}"""),
    "j1_dilate": with_views("mask", f"grown AS ({_dilated('mask', masks.ellipse(3))}) {_COUNT.format('grown')}"),
    "j2_erode": with_views("mask", f"shrunk AS ({_eroded('mask', 2)}) {_COUNT.format('shrunk')}"),
    "j3_close_open": with_views("mask", f"{_CLOSED} {_COUNT.format('m4')}"),
    "r4_spread": with_views("mask weather_obs", f"{_WEATHER}, f AS ({_step('mask', 1.0)}) {_COUNT.format('f')}"),
    "r5_forecast": with_views("mask weather_obs", f"{_WEATHER}, {_F2} SELECT scene_id, round(hour, 4) AS hour, count(*) AS n, sum(x * 1000 + y)::BIGINT AS checksum FROM ({_F2_ALL}) GROUP BY ALL"),
    "j4_bracket": with_views("drops scenes", """t AS (SELECT scene_id, drop_id, drop_id % 30 / 10.0::DOUBLE - 0.2::DOUBLE AS t FROM drops WHERE scene_id IN (SELECT scene_id FROM scenes)), b AS (
        SELECT *, CASE WHEN t < 0.5 - 1e-9 THEN 0.0 WHEN t < 1 - 1e-9 THEN 0.5 WHEN t < 2 - 1e-9 THEN 1.0 ELSE 2.0 END::DOUBLE AS lo FROM t), c AS (
        SELECT *, abs(t - lo) <= 1e-9 AS exact, CASE lo WHEN 0 THEN 0.5 WHEN 0.5 THEN 1.0 ELSE 2.0 END::DOUBLE AS up FROM b)
        SELECT scene_id, drop_id, round(t, 6) AS t, lo AS lower, CASE WHEN exact OR t < 0 OR lo = 2 THEN lo ELSE up END AS upper,
               CASE WHEN exact OR t < 0 THEN 0 WHEN lo = 2 THEN 1 ELSE round((t - lo) / (up - lo), 6) END::DOUBLE AS alpha,
               CASE WHEN exact THEN 'frame' WHEN t < 0 THEN 'first' WHEN lo = 2 THEN 'frame_clamped' ELSE 'interpolated' END AS source FROM c"""),
    "a1_dominant_hue": with_views("pixels_hsv", """c AS (SELECT scene_id, h, count(*) AS n FROM pixels_hsv WHERE s >= 150 AND v >= 100 GROUP BY ALL), w AS (
        SELECT scene_id, ((h + k + 180) % 180)::INT AS hue, sum(n)::BIGINT AS weight FROM c, (SELECT unnest(range(-6, 7)) AS k) GROUP BY ALL)
        SELECT scene_id, hue, weight FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY weight DESC, hue) AS r FROM w) WHERE r = 1"""),
    "a4_blocks": with_views("mask", f"""g AS ({_dilated('mask', masks.square(1))}), c AS (SELECT DISTINCT scene_id, x // 5 AS cx, y // 5 AS cy FROM g)
        SELECT scene_id, count(*) AS n, sum(cx * 1000 + cy)::BIGINT AS checksum FROM c WHERE cx < {W // 5} AND cy < {H // 5} GROUP BY scene_id"""),
    "j8_reach": with_views("candidates drops scenes", f"{_REACH} SELECT scene_id, cand_id, drop_id, round(distance_m, 6) AS distance_m FROM reached"),
    "w2_assignment": with_views("candidates drops scenes", f"{_REACH}, {_ASSIGN} SELECT scene_id, drop_id, base_id, round(distance_m, 6) AS distance_m FROM assigned"),
    "a7_reach_summary": with_views("candidates drops scenes", f"""{_REACH}, {_ASSIGN}, one AS (SELECT scene_id, max(n) AS best FROM (SELECT scene_id, cand_id, count(*) AS n FROM reached GROUP BY ALL) GROUP BY scene_id), a AS (
        SELECT scene_id, count(*) AS n, round(avg(distance_m), 6) AS m FROM assigned GROUP BY scene_id)
        SELECT d.scene_id, d.n AS n_drops, coalesce(a.n, 0) AS coverable, coalesce(best, 0) AS best_single, CASE WHEN a.n IS NULL THEN 'none' WHEN best = a.n THEN 'single' ELSE 'multi' END AS mode, a.n AS assigned, m AS mean_m
        FROM (SELECT scene_id, count(*) AS n FROM drops GROUP BY scene_id) d LEFT JOIN one USING (scene_id) LEFT JOIN a USING (scene_id)"""),
    "w1_home": with_views("drops", f"SELECT scene_id, drop_id, x, y FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY (x - {W // 2}) * (x - {W // 2}) + (y - {H // 2}) * (y - {H // 2}), drop_id) AS k FROM drops) WHERE k = 1"),
    "a10_least_separation": with_views("candidates", "SELECT a.scene_id, round(sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS separation FROM candidates a JOIN candidates b ON a.scene_id = b.scene_id AND a.cand_id < b.cand_id GROUP BY a.scene_id"),
    "w3_visit_order": with_views("candidates drops scenes", f"{_ORDER} SELECT scene_id, base_id, seq, drop_id, x, y, ((seq - 1) // 32)::INT AS load FROM visit", True),
    "a14_route_lengths": with_views("candidates drops scenes", f"{_ROUTE}, {_SEGMENTS} SELECT scene_id, base_id, round(sum(sqrt((bx - ax) * (bx - ax) + (bz - ay) * (bz - ay))), 6) AS length_px FROM segs GROUP BY ALL", True),
    "w10_sortie_ranges": with_views("candidates drops scenes", f"""{_ROUTE}, n AS (SELECT *, coalesce(sum((kind = 'reload')::INT) OVER (PARTITION BY scene_id, base_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sortie FROM route)
        SELECT scene_id, base_id, sortie, min(seq) AS first_seq, max(CASE WHEN kind = 'drop' THEN seq END) AS last_drop_seq, max(seq) AS end_seq FROM n GROUP BY ALL HAVING last_drop_seq IS NOT NULL""", True),
    "a6_sortie_battery": with_views("candidates drops scenes", f"""{_ROUTE}, n AS (SELECT *, coalesce(sum((kind = 'reload')::INT) OVER (PARTITION BY scene_id, base_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sortie,
          coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) * {M}::DOUBLE, 0) AS metres FROM route WINDOW w AS (PARTITION BY scene_id, base_id ORDER BY seq)), k AS (
        SELECT *, sum((kind = 'drop')::INT) OVER (PARTITION BY scene_id, base_id, sortie ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * {D.PER_DROP_KG}::DOUBLE AS kg FROM n), s AS (
        SELECT k.scene_id, base_id, sortie, count(*) FILTER (kind = 'drop') AS drops, sum(metres / {D.SPEED_MPS}::DOUBLE / 60 * (1 + kg * {D.PAYLOAD_FACTOR}::DOUBLE + CASE WHEN sc.scene_id IS NULL THEN 0 ELSE 30.0::DOUBLE / 3.6 END * {D.WIND_FACTOR}::DOUBLE) / {D.ENDURANCE_MIN}::DOUBLE) AS battery FROM k LEFT JOIN scenes sc USING (scene_id) GROUP BY ALL)
        SELECT scene_id, base_id, sortie, drops, round(battery, 6) AS battery, battery > {1 - D.RESERVE + 1e-9!r} AS over FROM s WHERE drops > 0""", True),
    "j9_crossings": with_views("candidates drops scenes", f"""{_ROUTE}, {_SEGMENTS}, p AS (SELECT a.scene_id, a.base_id AS base_a, a.seg AS seg_a, b.base_id AS base_b, b.seg AS seg_b, a.ax AS pax, a.ay AS pay, a.bx AS pbx, a.bz AS pby, b.ax AS qax, b.ay AS qay, b.bx AS qbx, b.bz AS qby
          FROM segs a JOIN segs b ON a.scene_id = b.scene_id AND a.base_id < b.base_id)
        SELECT scene_id, base_a, seg_a, base_b, seg_b FROM p WHERE {_turn('pa', 'pb', 'qa')} * {_turn('pa', 'pb', 'qb')} <= 0 AND {_turn('qa', 'qb', 'pa')} * {_turn('qa', 'qb', 'pb')} <= 0
          AND least(pax, pbx) <= greatest(qax, qbx) AND least(qax, qbx) <= greatest(pax, pbx) AND least(pay, pby) <= greatest(qay, qby) AND least(qay, qby) <= greatest(pay, pby)""", True),
    "j10_flooded_under": with_views("candidates drops scenes mask", f"""{_ROUTE}, {_SEGMENTS}, z AS (SELECT *, greatest(abs(bx - ax), abs(bz - ay)) AS n FROM segs), l AS (
          SELECT DISTINCT scene_id, base_id, (ax + floor((bx - ax) * k / n::DOUBLE + 0.5))::INT AS x, (ay + floor((bz - ay) * k / n::DOUBLE + 0.5))::INT AS y FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM z))
        SELECT l.scene_id, base_id, count(*) AS flooded_px FROM l JOIN mask USING (scene_id, x, y) GROUP BY ALL""", True),
    "q3_mission_items": with_views("candidates drops scenes", f"""{_ROUTE}, told AS MATERIALIZED (SELECT r.*, max(seq) OVER (PARTITION BY r.scene_id, base_id) AS last, {_LAT} AS lat, {_LON} AS lon FROM route r JOIN scenes s USING (scene_id)), every AS ({_ITEMS}), k AS (
          SELECT *, (row_number() OVER (PARTITION BY scene_id, base_id ORDER BY a, b) - 1)::INT AS seq FROM every)
        SELECT scene_id, base_id, seq, (seq = 0)::INT AS current, frame, command, p1, p2, p3, p4, round(lat, 7) AS lat, round(lon, 7) AS lon, alt, 1 AS autocontinue FROM k""", True),
    "q1_mission_checks": with_views("mission_raw", f"""f AS (SELECT mission_id, line_no, line, string_split(line, chr(9)) AS c FROM mission_raw), b AS (SELECT *, TRY_CAST(c[1] AS DOUBLE) AS seq, TRY_CAST(c[2] AS DOUBLE) AS cur, TRY_CAST(c[3] AS DOUBLE) AS frame, TRY_CAST(c[4] AS DOUBLE) AS cmd, TRY_CAST(c[9] AS DOUBLE) AS lat, TRY_CAST(c[10] AS DOUBLE) AS lon, TRY_CAST(c[12] AS DOUBLE) AS auto FROM f WHERE line_no > 0)
        SELECT mission_id, line_no, 'header' AS problem FROM f WHERE line_no = 0 AND line <> '{mission.HEADER}'
        UNION ALL SELECT mission_id, line_no, 'seq' FROM b WHERE seq <> line_no - 1 UNION ALL SELECT mission_id, line_no, 'current' FROM b WHERE cur <> (line_no = 1)::INT
        UNION ALL SELECT mission_id, line_no, 'frame' FROM b WHERE frame NOT IN (0, 3) UNION ALL SELECT mission_id, line_no, 'command' FROM b WHERE cmd NOT IN ({_COMMANDS})
        UNION ALL SELECT mission_id, line_no, 'position' FROM b WHERE cmd IN (16, 19, 21, 22) AND (abs(lat) > 90 OR abs(lon) > 180 OR (lat = 0 AND lon = 0)) UNION ALL SELECT mission_id, line_no, 'autocontinue' FROM b WHERE auto <> 1"""),
    "a2_local_density": with_views("mask", f"{_DENSITY} SELECT scene_id, count(*) AS n, round(sum(d), 4) AS total, round(min(d), 6) AS least FROM d GROUP BY scene_id"),
    "w4_sample_points": with_views("mask", f"""{_DENSITY}, k AS (SELECT scene_id, x, y, abs(d - 0.5) AS e FROM d), p0 AS ({_PICK.format(0, "TRUE")}), p1 AS ({_PICK.format(1, _APART.format("p0"))}), p2 AS ({_PICK.format(2, _APART.format("p0") + " AND " + _APART.format("p1"))})
        SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2"""),
    "r1_components": with_views("mask", f"{_REGIONS} SELECT scene_id, count(*) AS size, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM px GROUP BY scene_id, region", True),
    "r2_large_regions": with_views("mask", f"""{_REGIONS}, quad AS (SELECT scene_id, region, x + dx AS qx, y + dy AS qy, count(*) AS n, sum(x) AS sx, sum(y) AS sy FROM px, (VALUES (0, 0), (-1, 0), (0, -1), (-1, -1)) o(dx, dy) GROUP BY ALL), area AS MATERIALIZED (
        SELECT scene_id, region, sum(CASE n WHEN 4 THEN 1.0::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0 END) AS area, sum(CASE n WHEN 4 THEN sx / 4.0::DOUBLE WHEN 3 THEN sx / 6.0::DOUBLE ELSE 0 END) AS mx, sum(CASE n WHEN 4 THEN sy / 4.0::DOUBLE WHEN 3 THEN sy / 6.0::DOUBLE ELSE 0 END) AS my FROM quad GROUP BY ALL HAVING area >= {D.MIN_AREA}::DOUBLE), pts AS MATERIALIZED (
        SELECT DISTINCT scene_id, region, x, unnest([min(y), max(y)]) AS y FROM px JOIN area USING (scene_id, region) GROUP BY scene_id, region, x), side AS (
        SELECT p.scene_id, p.region, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM pts p JOIN pts q ON p.scene_id = q.scene_id AND p.region = q.region AND (p.x <> q.x OR p.y <> q.y)), hull AS (
        SELECT s.scene_id, s.region, px * qy - py * qx AS twice FROM side s JOIN pts r USING (scene_id, region) GROUP BY s.scene_id, s.region, px, py, qx, qy
        HAVING bool_and((qx - px) * (r.y - py) - (qy - py) * (r.x - px) >= 0) AND NOT bool_or((qx - px) * (r.y - py) - (qy - py) * (r.x - px) = 0 AND (r.x - px) * (r.x - qx) + (r.y - py) * (r.y - qy) > 0)), held AS (
        SELECT scene_id, region, abs(sum(twice)) / 2.0::DOUBLE AS hull_area FROM hull GROUP BY ALL), box AS (SELECT scene_id, region, count(*) AS size, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM px GROUP BY ALL)
        SELECT scene_id, area, floor(mx / area + 1e-9)::INT AS cx, floor(my / area + 1e-9)::INT AS cy, size, min_x, max_x, min_y, max_y, least({D.MAX_DROPS}, 1 + {" + ".join(f"(hull_area >= {a})::INT" for a in D.DROP_AREAS)})::INT AS n_drops
        FROM area JOIN held USING (scene_id, region) JOIN box USING (scene_id, region)""", True),
    "r7_signed_distance": with_views("drops mask scenes", f"""px AS MATERIALIZED (SELECT s.scene_id, x, y, (m.scene_id IS NOT NULL) AS wet FROM scenes s CROSS JOIN (SELECT unnest(range(0, {W}))::INT AS x) a
        CROSS JOIN (SELECT unnest(range(0, {H}))::INT AS y) b LEFT JOIN mask m USING (scene_id, x, y)), d AS (
        SELECT d.*, coalesce(p.wet, false) AS wet FROM drops d LEFT JOIN px p USING (scene_id, x, y)), t AS (
        SELECT d.scene_id, drop_id, d.wet, sqrt(min((p.x - d.x) * (p.x - d.x) + (p.y - d.y) * (p.y - d.y))) AS far FROM d LEFT JOIN px p ON p.scene_id = d.scene_id AND p.wet <> d.wet GROUP BY ALL)
        SELECT scene_id, drop_id, round(CASE WHEN wet THEN -far ELSE far END, 6)::DOUBLE AS signed_distance FROM t"""),
    "r9_flooded_at_arrival": with_views("mask weather_obs drops pixels_hsv", f"""{_WEATHER}, {_F1}, a AS MATERIALIZED ({_F1_ALL}), hs AS (SELECT scene_id, hour, lead(hour) OVER (PARTITION BY scene_id ORDER BY hour) AS next FROM (SELECT DISTINCT scene_id, hour FROM a)), t AS MATERIALIZED (
        SELECT d.scene_id, drop_id, x, y, drop_id % 11 / 8.0::DOUBLE + 0.03::DOUBLE AS t, hour, next FROM drops d LEFT JOIN hs ON hs.scene_id = d.scene_id AND hour <= drop_id % 11 / 8.0::DOUBLE + 0.03::DOUBLE AND (next IS NULL OR next > drop_id % 11 / 8.0::DOUBLE + 0.03::DOUBLE)), w AS (
        SELECT t.*, (a.x IS NOT NULL) AS w0, (b.x IS NOT NULL) AS w1 FROM t LEFT JOIN a ON a.scene_id = t.scene_id AND a.hour = t.hour AND a.x = t.x AND a.y = t.y LEFT JOIN a b ON b.scene_id = t.scene_id AND b.hour = t.next AND b.x = t.x AND b.y = t.y), c AS MATERIALIZED (
        SELECT * FROM w WHERE w0 <> w1 AND next IS NOT NULL), e AS (SELECT scene_id, drop_id, x, y, hour AS at, w0 AS wet FROM c UNION ALL SELECT scene_id, drop_id, x, y, next, w1 FROM c), px AS MATERIALIZED (
        SELECT h.scene_id, h.hour, p.x, p.y, (a.x IS NOT NULL) AS wet FROM hs h JOIN pixels_hsv p USING (scene_id) LEFT JOIN a ON a.scene_id = h.scene_id AND a.hour = h.hour AND a.x = p.x AND a.y = p.y), far AS (
        SELECT e.scene_id, e.drop_id, e.at, sqrt(min((e.x - p.x) * (e.x - p.x) + (e.y - p.y) * (e.y - p.y))) AS d FROM e JOIN px p ON p.scene_id = e.scene_id AND p.hour = e.at AND p.wet <> e.wet GROUP BY ALL)
        SELECT w.scene_id, w.drop_id, CASE WHEN w.next IS NULL OR w0 = w1 THEN w0 WHEN w0 THEN t < w.hour + (w.next - w.hour) * f.d / (f.d + g.d) ELSE t >= w.hour + (w.next - w.hour) * f.d / (f.d + g.d) END AS flooded
        FROM w LEFT JOIN far f ON f.scene_id = w.scene_id AND f.drop_id = w.drop_id AND f.at = w.hour LEFT JOIN far g ON g.scene_id = w.scene_id AND g.drop_id = w.drop_id AND g.at = w.next"""),
    "r10_soft_blend": with_views("mask weather_obs", f"""{_WEATHER}, {_F1}, a AS MATERIALIZED ({_F1_ALL}), v AS (SELECT scene_id, 0.5::DOUBLE AS t, x, y, 255 AS value FROM a WHERE hour = 0.5 UNION ALL
        SELECT scene_id, 0.7::DOUBLE, x, y, round_even(255 * sum(CASE hour WHEN 0.5 THEN 1 - (0.7::DOUBLE - 0.5::DOUBLE) / 0.5::DOUBLE ELSE (0.7::DOUBLE - 0.5::DOUBLE) / 0.5::DOUBLE END), 0)::INT FROM a WHERE hour IN (0.5, 1.0) GROUP BY ALL)
        SELECT scene_id, t, count(*) AS n, sum(value)::BIGINT AS total, min(value) AS least FROM v WHERE value > 0 GROUP BY ALL"""),
    "p14_point_lists": with_views("drops", """h AS (SELECT drop_id, x * 7 % 200 + CASE WHEN x % 3 = 0 THEN 0.5 ELSE 0 END AS a, y * 7 % 200 + CASE WHEN y % 3 = 0 THEN 0.5 ELSE 0 END AS b FROM drops)
        SELECT drop_id, 0::BIGINT AS k, round_even(a, 0)::INT AS x, round_even(b, 0)::INT AS y FROM h UNION ALL
        SELECT drop_id, 1, CASE WHEN drop_id % 4 > 0 THEN round_even(b, 0)::INT END, CASE WHEN drop_id % 4 > 0 THEN round_even(a, 0)::INT END FROM h"""),
    "u5_conflict_cells": with_views("drops", f"""c AS (SELECT scene_id, drop_id AS leg, least(x // 5, {W // 5 - 1})::INT AS gx, least(y // 5, {H // 5 - 1})::INT AS gy FROM drops), b AS (
        SELECT scene_id, leg - 1 AS leg, gx + dx AS cx, gy + dy AS cy, dx = 0 AND dy = 0 AS exact FROM c, {_offsets(masks.square(1))}), m AS (
        SELECT scene_id, leg, cx, cy, bool_or(exact) AS exact FROM b WHERE cx BETWEEN 0 AND {W // 5 - 1} AND cy BETWEEN 0 AND {H // 5 - 1} GROUP BY ALL)
        SELECT m.scene_id, m.leg, cx, cy, exact FROM m JOIN c ON c.scene_id = m.scene_id AND c.leg = m.leg WHERE NOT (cx = gx AND cy = gy) AND NOT (cx = {W // 10} AND cy = {H // 10})"""),
    "j13_shared_points": with_views("drops", "SELECT scene_id, (x // 25)::BIGINT AS x, (y // 25)::BIGINT AS y, count(*)::INT AS n, min(drop_id) AS first FROM drops GROUP BY scene_id, x // 25, y // 25 HAVING count(*) > 1"),
    "j15_near_regions": with_views("drops mask", "SELECT DISTINCT d.scene_id, drop_id FROM drops d JOIN mask m ON d.scene_id = m.scene_id AND (m.x - d.x) * (m.x - d.x) + (m.y - d.y) * (m.y - d.y) <= 625"),
    "a8_stage_counts": with_views("candidates drops scenes", f"""{_REACH}, {_ASSIGN} SELECT scene_id, count(*) AS drops, count(a.drop_id) AS coverable, count(a.drop_id) AS assigned, count(CASE WHEN distance_m < 400 THEN 1 END) AS delivered
        FROM drops LEFT JOIN assigned a USING (scene_id, drop_id) GROUP BY ROLLUP (scene_id)"""),
    "a11_map_sanity": with_views("pixels_hsv", """t AS (SELECT scene_id, s AS b, v AS g, h AS r, CASE WHEN x < 60 THEN 9 ELSE s END AS b2, CASE WHEN x < 60 THEN 9 ELSE v END AS g2, CASE WHEN x < 60 THEN 9 ELSE h END AS r2 FROM pixels_hsv), c AS (
        SELECT scene_id, max(n) / sum(n) AS dominant FROM (SELECT scene_id, b2, g2, r2, count(*) AS n FROM t GROUP BY ALL) GROUP BY scene_id), k AS (
        SELECT scene_id, corr(b * 0.114::DOUBLE + g * 0.587::DOUBLE + r * 0.299::DOUBLE, b2 * 0.114::DOUBLE + g2 * 0.587::DOUBLE + r2 * 0.299::DOUBLE) AS correlation, avg((b = b2 AND g = g2 AND r = r2)::INT) AS unchanged FROM t GROUP BY scene_id)
        SELECT scene_id, round(dominant, 6)::DOUBLE AS dominant, round(correlation, 6) AS correlation, round(unchanged, 6) AS unchanged, dominant <= 0.5 AND coalesce(correlation, 0) >= 0.5 AS ok FROM c JOIN k USING (scene_id)"""),
    "u4_within_reach": with_views("candidates drops scenes", f"""{_REACH}, {_ASSIGN}, m AS (SELECT scene_id, scene_id * 4 + (base_id + 1) % 4 AS base_id, base_id AS sortie, drop_id FROM assigned)
        SELECT m.scene_id, m.base_id, sortie, count(*) = count(r.drop_id) AS fits FROM m LEFT JOIN reached r ON r.scene_id = m.scene_id AND r.cand_id = m.base_id AND r.drop_id = m.drop_id GROUP BY ALL"""),
    "p6_weather_flags": with_views("weather_obs", f"{_WEATHER} SELECT scene_id, wind_speed_10m > {D.WIND_LIMIT} AS too_windy, precipitation > {D.RAIN_LIMIT} AS too_wet FROM wx"),
    "u2_lost_pixels": with_views("mask weather_obs", f"""{_WEATHER}, {_F1}, a AS ({_F1_ALL}), n AS (SELECT scene_id, hour, lead(hour) OVER (PARTITION BY scene_id ORDER BY hour) AS next FROM (SELECT DISTINCT scene_id, hour FROM a))
        SELECT a.scene_id, round(a.hour, 4) AS hour, count(*) AS n FROM a JOIN n ON n.scene_id = a.scene_id AND n.hour = a.hour AND next IS NOT NULL LEFT JOIN a b ON b.scene_id = a.scene_id AND b.hour = next AND b.x = a.x AND b.y = a.y WHERE b.x IS NULL GROUP BY ALL"""),
}

ORACLES["a13_not_planned"] = with_views("candidates drops scenes", f"{_REACH}, {_ASSIGN} SELECT scene_id, drop_id, base_id, 'base has no route' AS reason FROM assigned WHERE base_id % 4 = 3")
ORACLES["j14_legs_of_segments"] = with_views("candidates drops scenes", f"{_ROUTE} SELECT scene_id, base_id, seq AS seg, coalesce(sum((kind = 'drop')::INT) OVER (PARTITION BY scene_id, base_id ORDER BY seq), 0)::INT AS leg FROM route", True)
ORACLES["p8_original_points"] = with_views("drops", "SELECT drop_id, round((x + 0.5::DOUBLE) / (1 / 3.0::DOUBLE) - 0.5::DOUBLE, 6) AS x, round((y + 0.5::DOUBLE) / (1 / 3.0::DOUBLE) - 0.5::DOUBLE, 6) AS y FROM drops")


def _greedy(rounds: int, separation: float) -> str:
    """Greedy cover, a round after the other: what earlier picks serve doesn't count, and sites near them are out."""
    parts = ["picked0 AS MATERIALIZED (SELECT NULL::BIGINT AS scene_id, 0 AS rank, NULL::BIGINT AS cand_id, NULL::INT AS x, NULL::INT AS y, 0::BIGINT AS gain WHERE false)"]
    for k in range(rounds):
        parts.append(f"""picked{k + 1} AS MATERIALIZED (SELECT * FROM picked{k} UNION ALL SELECT scene_id, {k}, cand_id, x, y, gain FROM (
          SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY gain DESC, cost, cand_id) AS r FROM (SELECT c.scene_id, c.cand_id, c.x, c.y, count(*) AS gain, round(sum(distance_m), 6) AS cost FROM candidates c JOIN reached r USING (scene_id, cand_id)
          WHERE NOT EXISTS (SELECT 1 FROM picked{k} p JOIN reached q ON q.scene_id = p.scene_id AND q.cand_id = p.cand_id WHERE q.scene_id = r.scene_id AND q.drop_id = r.drop_id)
            AND NOT EXISTS (SELECT 1 FROM picked{k} p WHERE p.scene_id = c.scene_id AND (p.cand_id = c.cand_id OR sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) < {separation}))
          GROUP BY c.scene_id, c.cand_id, c.x, c.y)) WHERE r = 1)""")
    return ", ".join(parts)


_BASES = f"{_REACH}, {_greedy(D.MAX_BASES, 60.0)}"
ORACLES["f1_greedy_bases"] = with_views("candidates drops scenes", f"{_BASES} SELECT scene_id, rank, cand_id, x, y, gain FROM picked{D.MAX_BASES}")
ORACLES["u3_unserved"] = with_views("candidates drops scenes", f"""{_BASES}, n AS (SELECT scene_id, count(*) AS n FROM picked{D.MAX_BASES} GROUP BY scene_id), served AS (SELECT DISTINCT r.scene_id, r.drop_id FROM reached r JOIN picked{D.MAX_BASES} USING (scene_id, cand_id))
  SELECT d.scene_id, d.drop_id, CASE WHEN r.drop_id IS NULL THEN 'battery' WHEN coalesce(n, 0) >= {D.MAX_BASES} THEN 'base cap' ELSE 'separation' END AS reason
  FROM drops d LEFT JOIN (SELECT DISTINCT scene_id, drop_id FROM reached) r USING (scene_id, drop_id) LEFT JOIN n USING (scene_id) WHERE NOT EXISTS (SELECT 1 FROM served s WHERE s.scene_id = d.scene_id AND s.drop_id = d.drop_id)""")
ORACLES["q4_over_limit"] = "SELECT scene_id, base_id, sortie, battery FROM (" + ORACLES["a6_sortie_battery"] + ") WHERE over"
#: The same crossings, with each drop served from the last site that reaches it.
ORACLES["j9_crossings_far"] = ORACLES["j9_crossings"].replace(_ASSIGN, "assigned AS MATERIALIZED (SELECT scene_id, drop_id, max(cand_id) AS base_id FROM reached GROUP BY ALL)")

_CX, _CY = W // 5, H // 5
_MOVES = "(VALUES (0, 0, 0, 0), " + ", ".join(f"({a}, {b}, {int(not (a and b))}, {int(bool(a and b))})" for a, b in grid.STEPS) + ") m(dx, dy, s, g)"
_FREE = f"""grown AS ({_dilated('mask', masks.square(1))}), blocked AS (SELECT DISTINCT scene_id, x // 5 AS cx, y // 5 AS cy FROM grown), free AS MATERIALIZED (
  FROM (SELECT scene_id, cx, cy FROM scenes, (SELECT unnest(range(0, {_CX}))::INT AS cx), (SELECT unnest(range(0, {_CY}))::INT AS cy)) ANTI JOIN blocked USING (scene_id, cx, cy))"""
_CELL = f"least({_CX - 1}, x // 5)::INT AS cx, least({_CY - 1}, y // 5)::INT AS cy"
# A point on a blocked cell goes to the first free one of the ring whose centre a dry line reaches.
_LOCATED = f"""{_FREE}, points AS (SELECT 0 AS side, scene_id, cand_id AS id, x, y FROM candidates UNION ALL SELECT 1, scene_id, drop_id, x, y FROM drops), own AS MATERIALIZED (
  SELECT side, scene_id, id, x, y, {_CELL} FROM points SEMI JOIN scenes USING (scene_id)), ring(k, dx, dy) AS (VALUES {", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(grid.ring_order(4)) if k)}), stuck AS (
  FROM own ANTI JOIN free USING (scene_id, cx, cy)), near AS MATERIALIZED (
  SELECT o.side, o.scene_id, o.id, o.x, o.y, k, f.cx, f.cy, f.cx * 5 + 2 AS qx, f.cy * 5 + 2 AS qy FROM stuck o CROSS JOIN ring JOIN free f ON f.scene_id = o.scene_id AND f.cx = o.cx + dx AND f.cy = o.cy + dy), line AS (
  SELECT *, unnest(range(0, n + 1)) / n::DOUBLE AS t FROM (SELECT *, greatest(abs(qx - x), abs(qy - y), 1) AS n FROM near)), wet AS (
  SELECT DISTINCT side, l.scene_id, id, k FROM line l JOIN mask m ON m.scene_id = l.scene_id AND m.x = floor(l.x + (qx - l.x) * t + 0.5) AND m.y = floor(l.y + (qy - l.y) * t + 0.5)), moved AS (
  SELECT side, scene_id, id, min({{'k': k, 'cx': cx, 'cy': cy}}) AS b FROM near ANTI JOIN wet USING (side, scene_id, id, k) GROUP BY ALL), located AS MATERIALIZED (
  SELECT side, scene_id, id, cx, cy, false AS snapped FROM own SEMI JOIN free USING (scene_id, cx, cy)
  UNION ALL SELECT side, scene_id, id, b.cx, b.cy, true FROM stuck LEFT JOIN moved USING (side, scene_id, id))"""


def _walk(start: str, key: str, least: str, more: str, rounds: int) -> str:
    """Best paths of up to so many steps: every round, all cells offer their paths to their neighbours and themselves."""
    return f"""walk AS (
  SELECT {key}, {least}, 0 AS k FROM ({start}) SEMI JOIN free USING (scene_id, cx, cy) GROUP BY ALL
  UNION ALL SELECT {key}, {least}, k + 1 AS k FROM (
    SELECT scene_id, w.b.source_id AS source_id, w.cx + dx AS cx, w.cy + dy AS cy, w.b.ns + s AS ns, w.b.nd + g AS nd, k FROM walk w, {_MOVES} WHERE k < {rounds})
  SEMI JOIN free USING (scene_id, cx, cy) WHERE {more} GROUP BY {key}, k), field AS MATERIALIZED (SELECT * FROM walk WHERE k = {rounds})"""


_LEAST = "min({'d': ns + nd * sqrt(2), 'source_id': source_id, 'ns': ns, 'nd': nd}) AS b"
_MOST = (1 - D.RESERVE) * D.ENDURANCE_MIN * 60 * D.SPEED_MPS / 2 / (5 * M)
_ROUTED = f"""{_LOCATED}, {_walk("SELECT scene_id, cx, cy, id AS source_id, 0 AS ns, 0 AS nd FROM located WHERE side = 0", "scene_id, source_id, cx, cy", _LEAST, f"ns + nd * sqrt(2) <= {_MOST!r}::DOUBLE", int(_MOST))}, reached AS MATERIALIZED (SELECT * FROM (
  SELECT f.scene_id, f.source_id AS cand_id, l.id AS drop_id, b.d * {5 * M}::DOUBLE AS distance_m FROM field f JOIN located l ON l.side = 1 AND l.scene_id = f.scene_id AND l.cx = f.cx AND l.cy = f.cy)
  WHERE {_NEED} <= 1 - {D.RESERVE}::DOUBLE)""".replace(f"{30.0}::DOUBLE / 3.6", "CASE WHEN scene_id IN (SELECT scene_id FROM scenes) THEN 30.0::DOUBLE ELSE 0 END / 3.6")
_VIEWS = "candidates drops mask scenes"
ORACLES["f3_located"] = with_views(_VIEWS, f"{_LOCATED} SELECT scene_id, id AS drop_id, cx, cy, snapped FROM located WHERE side = 1", True)
ORACLES["f5_routed_reach"] = with_views(_VIEWS, f"{_ROUTED} SELECT scene_id, cand_id, drop_id, round(distance_m, 6) AS distance_m FROM reached", True)
ORACLES["w2_routed_assignment"] = with_views(_VIEWS, f"{_ROUTED}, {_ASSIGN} SELECT scene_id, drop_id, base_id, round(distance_m, 6) AS distance_m FROM assigned", True)
ORACLES["f1_routed_bases"] = with_views(_VIEWS, f"{_BASES.replace(_REACH, _ROUTED)} SELECT scene_id, rank, cand_id, x, y, gain FROM picked{D.MAX_BASES}", True)
_SITES = f"SELECT scene_id, {_CELL}, cand_id AS source_id, 0 AS ns, 0 AS nd FROM candidates"
_FIELD = f"""{_FREE}, {_walk(_SITES, "scene_id, source_id, cx, cy", _LEAST, "ns + nd * sqrt(2) <= 20", 20)}"""
ORACLES["f4_distance_field"] = with_views(_VIEWS, f"{_FIELD} SELECT scene_id, source_id, count(*) AS cells, sum(b.ns)::BIGINT AS straight, sum(b.nd)::BIGINT AS diagonal FROM field GROUP BY ALL", True)
ORACLES["f6_paths"] = with_views(_VIEWS, f"""{_FIELD}, back AS MATERIALIZED (
  SELECT a.scene_id, a.source_id, a.cx, a.cy, min({{'t': round(n.b.d + sqrt(abs(n.cx - a.cx) + abs(n.cy - a.cy)), 9), 'py': n.cy, 'px': n.cx}}) AS p FROM field a CROSS JOIN {_MOVES}
  JOIN field n ON n.scene_id = a.scene_id AND n.source_id = a.source_id AND n.cx = a.cx + dx AND n.cy = a.cy + dy AND n.b.d < a.b.d GROUP BY ALL), path AS (
  SELECT f.scene_id, f.source_id, drop_id AS goal_id, 0 AS step, f.cx, f.cy FROM (SELECT scene_id, drop_id, {_CELL} FROM drops) d JOIN field f USING (scene_id, cx, cy)
  UNION ALL SELECT scene_id, source_id, goal_id, step + 1, p.px, p.py FROM path JOIN back USING (scene_id, source_id, cx, cy))
  SELECT scene_id, source_id, goal_id, step, cx, cy FROM path""", True)
ORACLES["w13_territories"] = with_views(_VIEWS, f"""{_REACH}, {_ASSIGN}, {_FREE}, mine AS MATERIALIZED (SELECT scene_id, drop_id, base_id, {_CELL} FROM assigned JOIN drops USING (scene_id, drop_id)),
  {_walk(f"{_SITES} UNION ALL SELECT scene_id, cx, cy, base_id, 0, 0 FROM mine", "scene_id, cx, cy", _LEAST, "true", 150)}, bad AS (
  SELECT m.scene_id, count(*) FILTER (b.source_id <> base_id) AS violations, count(*) FILTER (b IS NULL) AS unreachable FROM mine m LEFT JOIN field USING (scene_id, cx, cy) GROUP BY m.scene_id)
  SELECT scene_id, cells, bases, checksum, coalesce(violations, 0) AS violations, coalesce(unreachable, 0) AS unreachable FROM (
    SELECT scene_id, count(*) AS cells, count(DISTINCT b.source_id) AS bases, sum((cx * 100 + cy) * b.source_id)::BIGINT AS checksum FROM field GROUP BY scene_id) LEFT JOIN bad USING (scene_id)""", True)
ORACLES["a12_outcomes"] = f"""WITH x AS ({ORACLES["j9_crossings_far"]}), s AS ({ORACLES["a7_reach_summary"]}), n AS (
  SELECT scene_id, count(DISTINCT b) AS n FROM (SELECT scene_id, drop_id, max(cand_id) AS b FROM ({ORACLES["j8_reach"]}) GROUP BY ALL) GROUP BY scene_id)
  SELECT s.scene_id, CASE WHEN s.scene_id IN (SELECT scene_id FROM x) THEN 'unresolved' WHEN mode = 'multi' THEN 'multi_' || n ELSE mode END AS outcome FROM s LEFT JOIN n USING (scene_id)"""
