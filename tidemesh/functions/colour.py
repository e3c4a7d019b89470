"""Column functions of colours: hue 0 to 179, saturation and value 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bgr_to_hsv(b: Column, g: Column, r: Column) -> Column:
    """struct(h, s, v)."""
    v, low = F.greatest(b, g, r), F.least(b, g, r)
    span = (v - low).cast("double")
    degrees = F.when(span == 0, 0.0).when(v == r, 60 * (g - b) / F.nullif(span, F.lit(0.0))).when(v == g, 120 + 60 * (b - r) / F.nullif(span, F.lit(0.0))).otherwise(240 + 60 * (r - g) / F.nullif(span, F.lit(0.0)))
    hue = F.rint(F.when(degrees < 0, degrees + 360).otherwise(degrees) / 2).cast("int")
    saturation = F.when(v == 0, 0).otherwise(F.rint(255 * span / F.nullif(v, F.lit(0))).cast("int"))
    return F.struct(F.when(hue == 180, 0).otherwise(hue).alias("h"), saturation.alias("s"), v.cast("int").alias("v"))


def in_band(h: Column, s: Column, v: Column, low: tuple[Column, Column, Column], high: tuple[Column, Column, Column], wrap: Column) -> Column:
    """Whether a colour lies between thresholds, ends included; with wrap, hues 0 to 10 or 170 to 179 count instead."""
    hue = F.when(wrap, h.between(0, 10) | h.between(170, 179)).otherwise(h.between(low[0], high[0]))
    return hue & s.between(low[1], high[1]) & v.between(low[2], high[2])
