"""Layout templates: a catalogue of page divisions, how well each fits a page, and refinement with the best."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrid.operators.rects import scored_layouts

# The catalogue's layouts as shares of the page (x, y, w, h), in catalogue order.
TEMPLATES = [
    ("splash", [(0.02, 0.02, 0.96, 0.96)]),
    ("2_horizontal", [(0.02, 0.02, 0.96, 0.47), (0.02, 0.51, 0.96, 0.47)]),
    ("2_vertical", [(0.02, 0.02, 0.47, 0.96), (0.51, 0.02, 0.47, 0.96)]),
    ("3_horizontal", [(0.02, 0.02, 0.96, 0.30), (0.02, 0.35, 0.96, 0.30), (0.02, 0.68, 0.96, 0.30)]),
    ("3_vertical", [(0.02, 0.02, 0.30, 0.96), (0.34, 0.02, 0.30, 0.96), (0.67, 0.02, 0.30, 0.96)]),
    ("3_top1_bottom2", [(0.02, 0.02, 0.96, 0.47), (0.02, 0.51, 0.47, 0.47), (0.51, 0.51, 0.47, 0.47)]),
    ("3_top2_bottom1", [(0.02, 0.02, 0.47, 0.47), (0.51, 0.02, 0.47, 0.47), (0.02, 0.51, 0.96, 0.47)]),
    ("4_grid", [(0.02, 0.02, 0.47, 0.47), (0.51, 0.02, 0.47, 0.47), (0.02, 0.51, 0.47, 0.47), (0.51, 0.51, 0.47, 0.47)]),
    ("4_horizontal", [(0.02, 0.02, 0.96, 0.22), (0.02, 0.27, 0.96, 0.22), (0.02, 0.52, 0.96, 0.22), (0.02, 0.77, 0.96, 0.21)]),
    ("4_L_shape", [(0.02, 0.02, 0.60, 0.47), (0.64, 0.02, 0.34, 0.47), (0.02, 0.51, 0.34, 0.47), (0.38, 0.51, 0.60, 0.47)]),
    ("5_top2_mid1_bottom2", [(0.02, 0.02, 0.47, 0.30), (0.51, 0.02, 0.47, 0.30), (0.02, 0.35, 0.96, 0.28), (0.02, 0.66, 0.47, 0.32), (0.51, 0.66, 0.47, 0.32)]),
    ("5_top1_mid2_bottom2", [(0.02, 0.02, 0.96, 0.28), (0.02, 0.33, 0.47, 0.30), (0.51, 0.33, 0.47, 0.30), (0.02, 0.66, 0.47, 0.32), (0.51, 0.66, 0.47, 0.32)]),
    ("6_grid_2x3", [(0.02, 0.02, 0.47, 0.30), (0.51, 0.02, 0.47, 0.30), (0.02, 0.35, 0.47, 0.28), (0.51, 0.35, 0.47, 0.28), (0.02, 0.66, 0.47, 0.32), (0.51, 0.66, 0.47, 0.32)]),
    ("6_grid_3x2", [(0.02, 0.02, 0.30, 0.47), (0.34, 0.02, 0.30, 0.47), (0.67, 0.02, 0.30, 0.47), (0.02, 0.51, 0.30, 0.47), (0.34, 0.51, 0.30, 0.47), (0.67, 0.51, 0.30, 0.47)]),
    ("8_grid_2x4", [(0.02, 0.02, 0.47, 0.22), (0.51, 0.02, 0.47, 0.22), (0.02, 0.27, 0.47, 0.22), (0.51, 0.27, 0.47, 0.22), (0.02, 0.52, 0.47, 0.22), (0.51, 0.52, 0.47, 0.22), (0.02, 0.77, 0.47, 0.21), (0.51, 0.77, 0.47, 0.21)]),
    ("9_grid_3x3", [(0.02, 0.02, 0.30, 0.30), (0.34, 0.02, 0.30, 0.30), (0.67, 0.02, 0.30, 0.30), (0.02, 0.35, 0.30, 0.28), (0.34, 0.35, 0.30, 0.28), (0.67, 0.35, 0.30, 0.28), (0.02, 0.66, 0.30, 0.32), (0.34, 0.66, 0.30, 0.32), (0.67, 0.66, 0.30, 0.32)]),
    ("T_shape", [(0.02, 0.02, 0.96, 0.35), (0.02, 0.40, 0.47, 0.58), (0.51, 0.40, 0.47, 0.25), (0.51, 0.68, 0.47, 0.30)]),
    ("staggered", [(0.02, 0.02, 0.55, 0.32), (0.40, 0.20, 0.58, 0.30), (0.02, 0.36, 0.58, 0.30), (0.40, 0.52, 0.58, 0.28), (0.02, 0.68, 0.96, 0.30)]),
]


def templates_table(spark: SparkSession) -> DataFrame:
    """(template, catalogue_no, n, panel, x, y, w, h), one row per panel of a template."""
    rows = [(name, k, len(boxes), i, *box) for k, (name, boxes) in enumerate(TEMPLATES) for i, box in enumerate(boxes)]
    return spark.createDataFrame(rows, "template string, catalogue_no int, n int, panel int, x double, y double, w double, h double")


def template_to_page(templates: DataFrame, page_w: float, page_h: float) -> DataFrame:
    sides = {"x": page_w, "y": page_h, "w": page_w, "h": page_h}
    return templates.withColumns({c: F.col(c) * F.lit(float(size)) for c, size in sides.items()})


def template_masks(grid: int) -> list[dict]:
    """Per template the tiles (numbered row by row) of each panel, of all panels, and of their borders."""
    out = []
    for k, (name, boxes) in enumerate(TEMPLATES):
        panels, border = [], set()
        for x, y, w, h in boxes:
            x0, y0, x1, y1 = int(x * grid), int(y * grid), int((x + w) * grid), int((y + h) * grid)
            panels.append([i * grid + j for i in range(y0, max(y0 + 1, min(y1, grid))) for j in range(x0, max(x0 + 1, min(x1, grid)))])
            x1, y1 = min(x1, grid - 1), min(y1, grid - 1)
            border |= {i * grid + j for i in range(y0, y1 + 1) for j in range(x0, x1 + 1) if i in (y0, y1) or j in (x0, x1)}
        out.append({"template": name, "catalogue_no": k, "n": len(boxes), "panels": panels, "inside": sorted({i for p in panels for i in p}), "border": sorted(border)})
    return out


MASKS = "array<struct<template:string,catalogue_no:int,n:int,panels:array<array<int>>,inside:array<int>,border:array<int>>>"


def score_templates(tiles: DataFrame, grid: int = 20) -> DataFrame:
    """(page_id, template, catalogue_no, n, score): ink inside panels, empty gutters, edges at borders, evenness.

    A page's tiles meet once; the catalogue is a constant of the plan, and every template is scored
    inside the page's row.
    """
    pages = tiles.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ty", "tx", "content", "edge"))).alias("tiles"))
    t = pages.select("page_id", "tiles.content", "tiles.edge", F.explode(F.from_json(F.lit(json.dumps(template_masks(grid))), MASKS)).alias("m")).select("page_id", "content", "edge", "m.*")
    total = lambda index, of: F.aggregate(index, F.lit(0.0), lambda a, i: a + F.get(F.col(of), i))
    mean_of = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)
    t = t.withColumn("shares", F.transform("panels", lambda p: total(p, "content") / F.size(p)))
    t = t.withColumn("mean", mean_of(F.col("shares"))).withColumn("std", F.sqrt(mean_of(F.transform("shares", lambda s: (s - F.col("mean")) * (s - F.col("mean"))))))
    ink = F.aggregate("content", F.lit(0.0), lambda a, x: a + x)
    free = F.lit(grid * grid) - F.size("inside")
    gutter = F.when(free > 0, F.greatest(F.lit(0.0), 1 - (ink - total(F.col("inside"), "content")) / free / 0.15)).otherwise(0.5)
    edges = total(F.col("border"), "edge") / F.size("border")
    even = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), 1 - F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(1.0))).otherwise(0.5)
    score = 0.30 * F.least(F.col("mean") / 0.3, F.lit(1.0)) + 0.30 * gutter + 0.25 * F.least(edges / 0.15, F.lit(1.0)) + 0.15 * even
    return t.select("page_id", "template", "catalogue_no", "n", F.round(score, 9).alias("score"))


def with_best_template(pages: DataFrame, scores: DataFrame, least: float = 0.45) -> DataFrame:
    """pages (page_id, n: panels found) with `template` and `template_score`, null where none reaches `least`.

    Equal scores go by nearness to the number found, then by catalogue order.
    """
    tried = scores.groupBy("page_id").agg(F.collect_list(F.struct("score", "n", "catalogue_no", "template")).alias("_tried"))
    order = lambda t: F.struct((-t["score"]).alias("s"), F.abs(t["n"] - F.coalesce(F.col("n"), t["n"])).alias("off"), t["catalogue_no"].alias("k"), t["template"].alias("template"))
    best = pages.join(tried, "page_id", "left").withColumn("_best", F.array_min(F.transform("_tried", order)))
    found = -F.col("_best.s") >= least
    return best.withColumn("template", F.when(found, F.col("_best.template"))).withColumn("template_score", F.when(found, -F.col("_best.s"))).drop("_best", "_tried")


def refine(boxes: DataFrame, scores: DataFrame, page_w: float, page_h: float, weak: float = 0.60, good: float = 0.50) -> DataFrame:
    """boxes, but those of weak pages replaced by their best template where its own layout is better."""
    pages = with_best_template(scored_layouts(boxes.withColumn("route", F.lit("found")), page_w, page_h), scores)
    catalogue = template_to_page(templates_table(boxes.sparkSession), page_w, page_h)
    types = {c: boxes.schema[c].dataType for c in ("rect_id", "x", "y", "w", "h")}
    catalogue = catalogue.withColumn("rect_id", F.col("panel") + 1).select(F.lit(0).alias("page_id"), F.col("template").alias("route"), *[F.col(c).cast(t).alias(c) for c, t in types.items()])
    worth = scored_layouts(catalogue, page_w, page_h).select(F.col("route").alias("template"), F.col("score").alias("_worth"), F.col("boxes").alias("_new"))
    both = pages.join(F.broadcast(worth), "template", "left")
    swap = F.coalesce((F.col("score") < weak) & (F.col("template_score") >= good) & (F.col("_worth") > F.col("score")), F.lit(False))
    out = both.select("page_id", F.explode(F.when(swap, F.col("_new")).otherwise(F.col("boxes"))).alias("b"))
    return out.select("page_id", "b.rect_id", "b.x", "b.y", "b.w", "b.h")
