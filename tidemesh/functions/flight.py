"""Column functions of the flight model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemesh import defaults as D


def wind_mps(kmh: Column) -> Column:
    """Wind speed in m/s from km/h, 0 at least."""
    return F.greatest(F.lit(0.0), kmh) / 3.6


def headwind(dx: Column, dy: Column, wind: Column, wind_from: Column) -> Column:
    """The part of a wind (any unit, from wind_from degrees) against a leg of pixels (y grows southward), 0 at least."""
    heading = F.pmod(F.degrees(F.atan2(dx, -dy)), F.lit(360.0))
    against = F.greatest(F.lit(0.0), wind * F.cos(F.radians(wind_from - heading)))
    return F.when((dx == 0) & (dy == 0), 0.0).otherwise(against)


def leg_battery(metres: Column, kg: Column, wind: Column, speed: float = D.SPEED_MPS) -> Column:
    """The share of a battery that a leg takes; wind is the headwind in m/s."""
    minutes = F.greatest(F.lit(0.0), metres) / max(speed, 0.1) / 60
    return minutes * (1 + kg * D.PAYLOAD_FACTOR + wind * D.WIND_FACTOR) / D.ENDURANCE_MIN


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment; to its point where it has no length."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(square, F.lit(0)))))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def drops_per_load(capacity: float = D.CAPACITY_KG, per_drop: float = D.PER_DROP_KG) -> int:
    """Drops that one sortie carries: 1 at least."""
    return max(1, int(capacity // per_drop))


def drop_count(area: Column) -> Column:
    """Drop points of a region, by its hull's area."""
    n = sum(((area >= a).cast("int") for a in D.DROP_AREAS), F.lit(1))
    return F.least(F.lit(D.MAX_DROPS), n)


def cell_of(v: Column, factor: int, cells: Column) -> Column:
    """The grid cell of a pixel coordinate, clamped into the grid."""
    return F.greatest(F.lit(0), F.least(cells - 1, F.floor(v / factor))).cast("int")


def cell_centre(c: Column, factor: int) -> Column:
    return c * factor + factor // 2
