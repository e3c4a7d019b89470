"""Column functions between pixels and degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemesh import defaults as D


def _finite(*columns: Column) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return ok


def pixel_to_latlon(px: Column, py: Column, cx: Column, cy: Column, lat0: Column, lon0: Column, mpp: Column) -> Column:
    """struct(lat, lon, error): north is up, and longitude wraps only outside -180 to 180.

    error names the first rule that fails, and lat and lon are null then.
    """
    px, py, cx, cy, lat0, lon0, mpp = (c.cast("double") for c in (px, py, cx, cy, lat0, lon0, mpp))
    lat = lat0 + (cy - py) * mpp / D.METRES_PER_DEGREE
    dlon = (px - cx) * mpp / (D.METRES_PER_DEGREE * F.cos(F.radians(lat0)))
    lon = lon0 + dlon
    wrapped = F.when((lon >= -180) & (lon <= 180), lon).otherwise(F.pmod(lon + 180, F.lit(360.0)) - 180)
    error = (
        F.when(~_finite(px, py, cx, cy, lat0, lon0, mpp), "not finite")
        .when(mpp <= 0, "scale")
        .when((F.abs(lat0) >= 90) | (F.abs(lon0) > 180), "reference")
        .when(F.abs(dlon) >= 180, "too wide")
        .when(F.abs(lat) > 90, "pole")
    )
    keep = lambda c: F.when(error.isNull(), c)
    return F.struct(keep(lat).alias("lat"), keep(wrapped).alias("lon"), error.alias("error"))


def display_to_original(v: Column, scale: Column) -> Column:
    """A coordinate on a downscaled display, on the original image."""
    return (v + 0.5) / scale - 0.5


def affine(px: Column, py: Column, a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    """struct(x, y): the world position of a pixel's centre."""
    x, y = px + 0.5, py + 0.5
    return F.struct((a * x + b * y + c).alias("x"), (d * x + e * y + f).alias("y"))


def point_list(text: Column) -> Column:
    """The points (x, y) of a text like `x,y;x,y`, rounded to the nearest even where a half is between; null: none.

    Parts without two numbers give null points, so that a caller sees them.
    """
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.trim(p) != "")
    number = lambda p, i: F.rint(F.try_element_at(F.split(p, ","), F.lit(i)).try_cast("double")).cast("int")
    return F.transform(parts, lambda p: F.when(number(p, 1).isNotNull() & number(p, 2).isNotNull(), F.struct(number(p, 1).alias("x"), number(p, 2).alias("y"))))
