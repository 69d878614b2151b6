"""Edits of panels by hand, presets and configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What the presets set; other settings keep their defaults.
PRESETS = [
    ("Franco-Belge", 51, 5, 40, 0.50, True, 20, False, 200.0),
    ("Manga", 51, 4, 35, 0.45, True, 24, True, 200.0),
    ("Newspaper", 41, 6, 40, 0.50, False, 16, False, 150.0),
]
CONFIG = "preset string, adaptive_block int, adaptive_c int, min_rect_px int, min_fill_ratio double, filter_title_rows boolean, max_panels_per_page int, reading_rtl boolean, detection_dpi double"


def presets_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, CONFIG)


def config_table(saved: DataFrame) -> DataFrame:
    """Configurations from a column `json`: keys that are not settings go, missing settings are null."""
    return saved.withColumn("_c", F.from_json("json", CONFIG)).select(*[c for c in saved.columns if c != "json"], "_c.*")


def apply_preset(rects: DataFrame, config: DataFrame, on: str) -> DataFrame:
    """rects at least as large as their configuration asks, at most as many per page, the largest first.

    config has one row per value of `on` and is broadcast: presets are three.
    """
    fit = rects.join(F.broadcast(config), on).filter(F.least("w", "h") >= F.col("min_rect_px"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc(F.col("w") * F.col("h")), "rect_id"))
    return fit.withColumn("_r", rank).filter("_r <= max_panels_per_page").select(*rects.columns)


def apply_edits(rects: DataFrame, edits: DataFrame, least: float = 10.0, least_new: float = 20.0) -> DataFrame:
    """Rectangles after edits (page_id, rect_id, seq, handle, dx, dy), each rectangle's by seq.

    handle: move, delete, or any of left, right, top, bottom joined by _ (top_left). A dragged
    rectangle is brought to positive sides, and a drag that would leave a side under `least` counts
    for nothing. A rectangle without a detected one is new: its first edit has handle new, with its
    corner in x, y and its sides in dx, dy, and it goes if a side is under least_new. To undo, leave
    the last edits out: the result is always replayed from the detected rectangles.
    """
    start = rects.select("page_id", "rect_id", F.struct("x", "y", "w", "h").alias("box"))
    done = edits.groupBy("page_id", "rect_id").agg(F.array_sort(F.collect_list(F.struct("seq", "handle", "x", "y", "dx", "dy"))).alias("edits"))
    both = start.join(done, ["page_id", "rect_id"], "full")
    none = F.lit(None).cast("struct<x:double,y:double,w:double,h:double>")

    def box(x: Column, y: Column, w: Column, h: Column) -> Column:
        return F.struct(F.least(x, x + w).alias("x"), F.least(y, y + h).alias("y"), F.abs(w).alias("w"), F.abs(h).alias("h"))

    def step(b: Column, e: Column) -> Column:
        has = lambda side: e["handle"].contains(side)
        pull = lambda side, d: F.when(has(side), d).otherwise(0.0)
        left, top, right, bottom = pull("left", e["dx"]), pull("top", e["dy"]), pull("right", e["dx"]), pull("bottom", e["dy"])
        moved = box(b["x"] + F.when(e["handle"] == "move", e["dx"]).otherwise(left), b["y"] + F.when(e["handle"] == "move", e["dy"]).otherwise(top), b["w"] - left + right, b["h"] - top + bottom)
        drawn = box(e["x"], e["y"], e["dx"], e["dy"])
        kept = F.when(F.least(moved["w"], moved["h"]) >= least, moved).otherwise(b)
        new = F.when(F.least(drawn["w"], drawn["h"]) >= least_new, drawn).otherwise(none)
        return F.when(e["handle"] == "new", new).when(e["handle"] == "delete", none).when(b.isNotNull(), kept).otherwise(none)

    after = F.when(F.col("edits").isNull(), F.col("box")).otherwise(F.aggregate("edits", F.col("box"), step))
    return both.withColumn("box", after).filter("box is not null").select("page_id", "rect_id", "box.*")
