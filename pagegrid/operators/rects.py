"""Filters, pair joins, greedy merges, scores and reading order of candidate rectangles.

Frames have page_id, rect_id (unique in its page), x, y, w, h and, where named, route.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from pagegrid.functions.geometry import area, iou, intersection_area, overlap_of_smaller, rect, union_box

BOX = ["x", "y", "w", "h"]


def filter_title_rows(rects: DataFrame, page_w: float, page_h: float) -> DataFrame:
    return rects.filter(~((F.col("y") < 0.15 * page_h) & (F.col("h") < 0.12 * page_h) & (F.col("w") > 0.35 * page_w)))


def filter_by_area(rects: DataFrame, page_w: float, page_h: float, min_pct: float = 0.008, max_pct: float = 0.95) -> DataFrame:
    return rects.filter((F.col("w") * F.col("h") / (page_w * page_h)).between(min_pct, max_pct))


def remove_header_footer(rects: DataFrame, page_h: float) -> DataFrame:
    strip = (F.col("h") < 0.10 * page_h) & ((F.col("y") < 0.06 * page_h) | (F.col("y") + F.col("h") > 0.94 * page_h))
    return rects.filter(~strip)


def box_filter(rects: DataFrame, page_h: float, min_area: float = 10_000, aspect_min: float = 0.2, aspect_max: float = 5.0) -> DataFrame:
    return rects.filter((F.col("w") * F.col("h") >= min_area) & (F.col("w") / F.col("h")).between(aspect_min, aspect_max) & (F.col("y") + F.col("h") >= 0.35 * page_h))


def editorial_boxes(boxes: DataFrame, pages: DataFrame, ink: float = 0.35, low: float = 0.25, wide: float = 0.40) -> DataFrame:
    """boxes (with `ink`) without editorial strips: full of ink, low and wide on their page (width, height)."""
    sized = boxes.join(pages.select("page_id", "width", "height"), "page_id")
    strip = (F.col("ink") > ink) & (F.col("h") < low * F.col("height")) & (F.col("w") > wide * F.col("width"))
    return sized.filter(~strip).select(*boxes.columns)


def rect_metrics(rects: DataFrame, page_w: float, page_h: float) -> DataFrame:
    edge = (F.col("x") <= 0) | (F.col("y") <= 0) | (F.col("x") + F.col("w") >= page_w) | (F.col("y") + F.col("h") >= page_h)
    return rects.select(
        "page_id", "rect_id", (F.col("w") * F.col("h")).alias("area"), (F.col("w") * F.col("h") / (page_w * page_h)).alias("area_pct"), (F.col("w") / F.col("h")).alias("aspect"),
        (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"), edge.alias("touches_border"),
    )


def overlap_pairs(rects: DataFrame) -> DataFrame:
    """Pairs i < j of a page that intersect, with IoU and the share of the smaller one."""
    r = rects.select("page_id", "rect_id", rect().alias("r"))
    a, b = r.select("page_id", F.col("rect_id").alias("i"), F.col("r").alias("a")), r.select("page_id", F.col("rect_id").alias("j"), F.col("r").alias("b"))
    pairs = a.join(b, "page_id").filter("i < j").withColumn("inter", intersection_area(F.col("a"), F.col("b"))).filter("inter > 0")
    return pairs.select("page_id", "i", "j", "inter", iou(F.col("a"), F.col("b")).alias("iou"), overlap_of_smaller(F.col("a"), F.col("b")).alias("of_smaller"))


def ordered_fold(rects: DataFrame, order, init, step, finish=None, carry: list[str] | None = None) -> DataFrame:
    """One array per page in `order`, folded: for rules that depend on the visiting order.

    A page holds tens of rectangles, so arrays stay small while pages spread over the cluster.
    """
    item = F.struct(*order, "rect_id", *BOX, *(carry or []))
    grouped = rects.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    folded = F.aggregate("items", init, step, finish) if finish else F.aggregate("items", init, step)
    return grouped.select("page_id", folded.alias("acc"))


def merge_rects(rects: DataFrame, least: float = 0.25) -> DataFrame:
    """One greedy pass by rect_id: a rectangle joins the first merged box with IoU >= least, which grows."""
    init = F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")

    def step(acc, item):
        box = F.struct(*[item[c].alias(c) for c in BOX])
        at = F.array_position(F.transform(acc, lambda m: iou(m, box) >= least), F.lit(True))
        grown = F.transform(acc, lambda m, i: F.when(i == at - 1, union_box(m, box)).otherwise(m))
        return F.when(at > 0, grown).otherwise(F.concat(acc, F.array(box)))

    folded = ordered_fold(rects, [], init, step)
    return folded.select("page_id", F.posexplode("acc").alias("merged_id", "m")).select("page_id", "merged_id", "m.x", "m.y", "m.w", "m.h")


def nms(rects: DataFrame, most: float = 0.4) -> DataFrame:
    """Largest first; a rectangle goes if it shares more than `most` of the smaller one with one kept."""
    init = F.array().cast("array<struct<rect_id:bigint,x:double,y:double,w:double,h:double>>")

    def step(acc, item):
        own = F.struct(item["rect_id"].cast("long").alias("rect_id"), *[item[c].alias(c) for c in BOX])
        return F.when(F.exists(acc, lambda m: overlap_of_smaller(m, own) > most), acc).otherwise(F.concat(acc, F.array(own)))

    folded = ordered_fold(rects, [(-F.col("w") * F.col("h")).alias("_size")], init, step)
    return folded.select("page_id", F.explode("acc").alias("m")).select("page_id", "m.rect_id", "m.x", "m.y", "m.w", "m.h")


def remove_nested(rects: DataFrame, most: float = 0.85) -> DataFrame:
    """Largest first; a rectangle goes if more than `most` of it lies inside one kept."""
    init = F.array().cast("array<struct<rect_id:bigint,x:double,y:double,w:double,h:double>>")

    def step(acc, item):
        own = F.struct(item["rect_id"].cast("long").alias("rect_id"), *[item[c].alias(c) for c in BOX])
        return F.when(F.exists(acc, lambda m: intersection_area(m, own) > most * area(own)), acc).otherwise(F.concat(acc, F.array(own)))

    folded = ordered_fold(rects, [(-F.col("w") * F.col("h")).alias("_size")], init, step)
    return folded.select("page_id", F.explode("acc").alias("m")).select("page_id", "m.rect_id", "m.x", "m.y", "m.w", "m.h")


def reading_order(rects: DataFrame, row_gap: float = 20.0, rtl: bool = False) -> DataFrame:
    """panel_no from 1: rows are anchored on the top of their first rectangle, then left to right."""
    init = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("row"), F.array().cast("array<struct<row:int,rect_id:bigint,x:double,y:double,w:double,h:double>>").alias("out"))

    def step(acc, item):
        same = acc["anchor"].isNotNull() & (F.abs(item["y"] - acc["anchor"]) < row_gap)
        row = F.when(same, acc["row"]).otherwise(acc["row"] + 1)
        anchor = F.when(same, acc["anchor"]).otherwise(item["y"])
        placed = F.struct(row.alias("row"), item["rect_id"].cast("long").alias("rect_id"), *[item[c].alias(c) for c in BOX])
        return F.struct(anchor.alias("anchor"), row.alias("row"), F.concat(acc["out"], F.array(placed)).alias("out"))

    folded = ordered_fold(rects, [F.col("y").alias("_top"), F.col("x").alias("_left")], init, step, lambda acc: acc["out"])
    flat = folded.select("page_id", F.explode("acc").alias("m")).select("page_id", "m.*")
    across = F.desc("x") if rtl else F.asc("x")
    return flat.withColumn("panel_no", F.row_number().over(Window.partitionBy("page_id").orderBy("row", across, "rect_id")))


def covered_areas(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, sizes: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """Area under at least one box of each page, by elementary strips between its x edges; sizes: the boxes of each page, which lie end to end.

    In each strip the boxes' y intervals merge by a running maximum of their ends. Pages with equally many boxes
    go together, at most `most` boxes at a time. Unknown values are NaN, and such boxes cover nothing.
    """
    out, first = np.zeros(len(sizes)), np.cumsum(sizes) - sizes
    for n in np.unique(sizes[sizes > 0]):
        pages = np.flatnonzero(sizes == n)
        step = max(1, most // n)
        for part in (pages[i : i + step] for i in range(0, len(pages), step)):
            at = first[part][:, None] + np.arange(n)
            at = np.take_along_axis(at, np.argsort(y[at], axis=1), 1)
            left, right, top, end = x[at], x[at] + w[at], y[at], y[at] + h[at]
            edges = np.sort(np.concatenate([left, right], axis=1), axis=1)
            for e, e2 in zip(edges.T[:-1], edges.T[1:], strict=True):
                inside = (left <= e[:, None]) & (right >= e2[:, None])
                reach = np.fmax.accumulate(np.where(inside, end, -np.inf), axis=1)
                before = np.concatenate([np.full((len(part), 1), -np.inf), reach[:, :-1]], axis=1)
                high = np.where(inside, np.fmax(0.0, end - np.fmax(top, before)), 0.0).sum(1)
                out[part] += np.where(high > 0, high * (e2 - e), 0.0)
    return out


def page_boxes() -> Column:
    """The boxes of a group of rows, as covered_area() takes them."""
    return F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in BOX]))


def has_width() -> Column:
    """Whether any row of a group has a width: pages without one have no strips and no coverage."""
    return F.max(F.col("x") + F.col("w") > F.col("x"))


@F.arrow_udf(DoubleType())
def covered_area(boxes: pa.Array) -> pa.Array:
    """Area under at least one of a page's boxes."""
    flat = boxes.flatten()
    x, y, w, h = (np.asarray(flat.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False)) for c in BOX)
    return pa.array(covered_areas(x, y, w, h, np.asarray(boxes.value_lengths())))


def union_coverage(rects: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Share of the page under at least one rectangle. The boxes of a page meet once, in its row."""
    pages = rects.filter("page_id is not null").groupBy("page_id").agg(page_boxes().alias("boxes"), has_width().alias("wide")).filter("wide")
    return pages.select("page_id", (covered_area("boxes") / (page_w * page_h)).alias("coverage"))


def scored_layouts(rects: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """(page_id, route, n, score, boxes): each route's layout of a page as one row with its score.

    One pass: the boxes of a page and route meet once, and their pairs are looked at inside the row.
    """
    boxes = F.array_sort(F.collect_list(F.struct("rect_id", *BOX)))
    size = F.col("w") * F.col("h")
    base = rects.groupBy("page_id", "route").agg(F.count("*").alias("n"), F.sum(size).alias("s"), F.min(size).alias("lo"), F.max(size).alias("hi"), boxes.alias("boxes"))
    much = lambda a, b: F.when(iou(a, b) > 0.15, iou(a, b)).otherwise(0.0)
    after = lambda i: F.slice("boxes", i + 2, F.size("boxes"))
    overlap = F.aggregate(F.transform("boxes", lambda a, i: F.aggregate(after(i), F.lit(0.0), lambda t, b: t + much(a, b))), F.lit(0.0), lambda t, x: t + x)
    # fixed values: how good a number of panels is
    count = F.when(F.col("n").between(3, 8), 1.0).when(F.col("n").between(2, 12), 0.7).when(F.col("n") == 1, 0.3).otherwise(0.4)
    cover = F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("s") / (page_w * page_h)) / 0.75)
    even = F.when(F.col("n") == 1, 0.5).otherwise(F.greatest(F.lit(0.2), F.col("lo") / F.col("hi")))
    clear = F.greatest(F.lit(0.0), 1 - 0.2 * overlap)
    return base.select("page_id", "route", "n", F.round(0.35 * count + 0.30 * cover + 0.15 * even + 0.20 * clear, 9).alias("score"), "boxes")


def score_layout(rects: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Layout score per page and route: count, coverage, evenness and overlap."""
    return scored_layouts(rects, page_w, page_h).drop("boxes")


#: Route priority on ties (fixed order).
ROUTES = ["adaptive", "lsd", "hierarchy", "gutter"]


def select_route(scores: DataFrame) -> DataFrame:
    """Best route of each page; a gutter route with 3-12 rectangles gets 0.06 more, up to 1."""
    bonus = (F.col("route") == "gutter") & F.col("n").between(3, 12)
    final = F.round(F.when(bonus, F.least(F.lit(1.0), F.col("score") + 0.06)).otherwise(F.col("score")), 9)
    order = F.array_position(F.array(*[F.lit(r) for r in ROUTES]), F.col("route"))
    ranked = scores.withColumn("final", final).withColumn("r", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("final"), order)))
    return ranked.filter("r = 1").select("page_id", "route", "n", F.col("final").alias("score"), *[c for c in scores.columns if c == "boxes"])
