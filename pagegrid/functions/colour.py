"""Colour spaces as column expressions; channels are 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear(c: Column) -> Column:
    """sRGB byte to linear light."""
    s = c / 255.0
    return F.when(s > 0.04045, F.pow((s + 0.055) / 1.055, F.lit(2.4))).otherwise(s / 12.92)


def cube_root(t: Column) -> Column:
    return F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise(7.787 * t + 16.0 / 116.0)


def with_lab(rgb: DataFrame) -> DataFrame:
    """Adds L, A, B: CIE Lab of sRGB under D65 as bytes (L by 255/100, a and b moved up by 128).

    Each step is a projection of its own, so that no expression is written out many times.
    """
    r, g, b = (F.col(f"_{c}") for c in "rgb")
    # fixed values: sRGB to XYZ, divided by the white point
    xyz = {"_x": (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456, "_y": 0.212671 * r + 0.715160 * g + 0.072169 * b, "_z": (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754}
    out = rgb.withColumns({f"_{c}": linear(F.col(c)) for c in "rgb"}).withColumns(xyz).withColumns({c: cube_root(F.col(c)) for c in xyz})
    x, y, z = (F.col(c) for c in xyz)
    return out.withColumns({"L": (116.0 * y - 16.0) * 2.55, "A": 500.0 * (x - y) + 128.0, "B": 200.0 * (y - z) + 128.0}).drop("_r", "_g", "_b", *xyz)


def with_hsv(rgb: DataFrame) -> DataFrame:
    """Adds H in half degrees (0 to 180), S and V 0 to 255."""
    r, g, b, high, span = (F.col(c) for c in ("r", "g", "b", "V", "_span"))
    turn = F.when(span == 0, 0.0).when(high == r, 60.0 * (g - b) / span).when(high == g, 120.0 + 60.0 * (b - r) / span).otherwise(240.0 + 60.0 * (r - g) / span)
    out = rgb.withColumn("V", F.greatest("r", "g", "b")).withColumn("_span", (high - F.least("r", "g", "b")).cast("double")).withColumn("_turn", turn)
    hue = F.when(F.col("_turn") < 0, F.col("_turn") + 360.0).otherwise(F.col("_turn")) / 2.0
    return out.withColumns({"H": hue, "S": F.when(high == 0, 0.0).otherwise(span * 255.0 / high)}).drop("_span", "_turn")


def in_range(channels: tuple[Column, Column, Column], lo: tuple, hi: tuple) -> Column:
    h, s, v = (c.between(a, b) for c, a, b in zip(channels, lo, hi, strict=True))
    return h & s & v


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum((F.pow(p - q, F.lit(2.0)) for p, q in zip(a, b, strict=True)), F.lit(0.0)))
