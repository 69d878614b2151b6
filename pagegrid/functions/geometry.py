"""Rectangle algebra as column expressions. Rectangles are structs or columns x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(r: Column) -> Column:
    return r["w"] * r["h"]


def intersection_area(a: Column, b: Column) -> Column:
    """0 where the rectangles only touch or are apart."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = intersection_area(a, b)
    whole = area(a) + area(b) - both
    return F.when(whole > 0, both / whole).otherwise(F.lit(0.0))


def overlap_of_smaller(a: Column, b: Column) -> Column:
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection_area(a, b) / least).otherwise(F.lit(0.0))


def union_box(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    right, bottom = F.greatest(a["x"] + a["w"], b["x"] + b["w"]), F.greatest(a["y"] + a["h"], b["y"] + b["h"])
    return F.struct(x.alias("x"), y.alias("y"), (right - x).alias("w"), (bottom - y).alias("h"))


def rect() -> Column:
    return F.struct("x", "y", "w", "h")


def px_to_pt(px: Column, width_px: Column, width_pt: Column) -> Column:
    """Only the x ratio scales, for both axes."""
    return px / (width_px / width_pt)


def pt_to_px(pt: Column, width_px: Column, width_pt: Column, mode: str = "trunc") -> Column:
    scaled = pt * (width_px / width_pt)
    return (F.bround(scaled) if mode == "round" else scaled).cast("int")


def gray(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def segment_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.degrees(F.atan2(F.abs(y2 - y1), F.abs(x2 - x1)))
