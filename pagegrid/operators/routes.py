"""Detection routes from page rasters to boxes, and how their results become one layout.

A route is any function from rasters to boxes (page_id, rect_id, x, y, w, h); ROUTES names the
built-in ones and a caller may pass others. Lengths are pixels of the raster.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrid.operators import arrays as A
from pagegrid.operators import layout as Y
from pagegrid.operators import rects as R
from pagegrid.operators import templates as T

BOXES = ["page_id", "rect_id", "x", "y", "w", "h"]


def _page_share(boxes: DataFrame, rasters: DataFrame) -> DataFrame:
    """boxes with `share`, the part of their page; a page's size comes from its raster."""
    sizes = rasters.select("page_id", (F.col("width") * F.col("height")).alias("_area"))
    return boxes.join(sizes, "page_id").withColumn("share", F.col("w") * F.col("h") / F.col("_area")).drop("_area")


def gutter_route(rasters: DataFrame) -> DataFrame:
    """Cells between bright bands, each row cut by bands of its own."""
    return A.with_id(A.gutter_cells(rasters)).select(*BOXES)


def adaptive_route(rasters: DataFrame, block: int = 51, c: float = 5.0, kernel: int = 1, min_side: int = 5, min_fill: float = 0.55, merge: float = 0.25) -> DataFrame:
    """Local threshold, closing, components, candidate filter, greedy merge."""
    found = A.component_boxes(rasters, lambda g: A.closed(A.local_dark(g, block, c), kernel))
    fine = _page_share(found, rasters).filter(F.col("share").between(0.008, 0.95) & (F.col("fill") >= min_fill) & (F.least("w", "h") >= min_side))
    return R.merge_rects(fine, merge).withColumnRenamed("merged_id", "rect_id").select(*BOXES)


def hierarchy_filter(found: DataFrame, min_share: float = 0.008, max_share: float = 0.85, min_fill: float = 0.40) -> DataFrame:
    """Components with share and fill that may be panels: neither specks nor the page, and box-like."""
    return found.filter(F.col("share").between(min_share, max_share) & (F.col("fill") >= min_fill))


def hierarchy_route(rasters: DataFrame, steep: int = 100, most: int = 16, merge: float = 0.30) -> DataFrame:
    """Outlines: what closed edges enclose, the largest of them, merged and without nested ones."""
    found = A.component_boxes(rasters, lambda g: A.closed(A.closed(A.gradient(g) > steep, 1), 1), A.outlines)
    fine = hierarchy_filter(_page_share(found, rasters))
    rank = F.row_number().over(Y._page().orderBy(F.desc("pixels"), "rect_id"))
    best = fine.withColumn("_r", rank).filter(F.col("_r") <= most)
    return R.remove_nested(R.merge_rects(best, merge).withColumnRenamed("merged_id", "rect_id")).select(*BOXES)


def border_level(gray: np.ndarray, share: float = 0.04, least: int = 2) -> float:
    """Median brightness of the page's border strips."""
    by, bx = (max(least, int(share * n)) for n in gray.shape)
    return float(np.median(np.concatenate([gray[:by].ravel(), gray[-by:].ravel(), gray[:, :bx].ravel(), gray[:, -bx:].ravel()])))


def region_filter(found: DataFrame, min_share: float = 0.005, max_share: float = 0.95, min_fill: float = 0.15) -> DataFrame:
    """Freeform regions: any shape that fills enough of its box."""
    return found.filter(F.col("share").between(min_share, max_share) & (F.col("fill") >= min_fill))


def freeform_route(rasters: DataFrame, delta: float = 12.0, kernel: int = 1) -> DataFrame:
    """What differs from the border's brightness, opened and closed, in regions that merge where they overlap."""
    found = A.component_boxes(rasters, lambda g: A.closed(A.opened(np.abs(g - border_level(g)) >= delta, kernel, kernel), kernel))
    return Y.merge_regions(region_filter(_page_share(found, rasters))).select(*BOXES)


def line_segments(rasters: DataFrame, share: float = 0.92, min_len: int = 9, max_thick: int = 10) -> DataFrame:
    """(page_id, axis, position, lo, hi): long thin components of steep pixels along either axis."""

    def segments(gray: np.ndarray) -> list[tuple]:
        steep = A.gradient(gray)
        mask = steep >= max(1.0, np.quantile(steep, share))
        out = []
        for axis, kx, ky in ((0, min_len // 2, 0), (1, 0, min_len // 2)):
            for x, y, w, h, _ in A.components(A.opened(mask, kx, ky)):
                length, thick = (w, h) if axis == 0 else (h, w)
                if length >= min_len and thick < max(max_thick, 0.01 * max(gray.shape)):
                    at, lo = (y + h / 2, x) if axis == 0 else (x + w / 2, y)
                    out.append((axis, at, lo, lo + length))
        return out

    found = A.per_page(rasters, segments, "page_id long, axis int, position double, lo double, hi double")
    return found.withColumn("axis", F.when(F.col("axis") == 0, "H").otherwise("V"))


def union_segments(*sources: DataFrame, gap: float) -> DataFrame:
    """Segments of several sources, near parallel ones as one."""
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s)
    return Y.merge_parallel(every, gap)


def line_route(rasters: DataFrame, gap: float = 8.0, margin: float = 0.03, min_side: int = 5) -> DataFrame:
    """Cells of the grid that merged interior lines and the page's edges span."""
    lines = union_segments(line_segments(rasters), gap=gap)
    sizes = rasters.select("page_id", "width", "height")
    placed = lines.join(sizes, "page_id").withColumn("_size", F.when(F.col("axis") == "H", F.col("height")).otherwise(F.col("width")))
    placed = placed.filter((F.col("position") > margin * F.col("_size")) & (F.col("position") < (1 - margin) * F.col("_size")))
    cuts = placed.groupBy("page_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("axis") == a, F.col("position")))).alias(a) for a in "HV"])
    grid = cuts.join(sizes, "page_id")

    def steps(at, size, start, length):
        edges = F.concat(F.array(F.lit(0.0)), at, F.array(F.col(size).cast("double")))
        pairs = F.zip_with(F.slice(edges, F.lit(1), F.size(edges) - 1), F.slice(edges, F.lit(2), F.size(edges) - 1), lambda a, b: F.struct(a.alias(start), (b - a).alias(length)))
        return F.filter(pairs, lambda p: p[length] >= min_side)

    cells = grid.select("page_id", F.explode(steps(F.col("H"), "height", "y", "h")).alias("r"), "V", "width")
    cells = cells.select("page_id", "r.*", F.explode(steps(F.col("V"), "width", "x", "w")).alias("c")).select("page_id", "c.x", "y", "c.w", "h")
    return A.with_id(cells).select(*BOXES)


def border_mask_route(rasters: DataFrame, bright: int = 225, kernel: int = 0, min_area: float = 100, editorial_ink: float = 0.35) -> DataFrame:
    """Panels inside bright borders: components of what is not border, boxes and no editorial strips."""
    found = _page_share(A.component_boxes(rasters, lambda g: ~A.dilated(A.closed(g >= bright, kernel), kernel, kernel)), rasters)
    boxes = found.filter((F.col("w") * F.col("h") >= min_area) & (F.col("w") / F.col("h")).between(0.2, 5.0))
    ink = R.editorial_boxes(boxes.withColumn("ink", F.col("fill")), rasters, editorial_ink)
    return Y.reading_order_height(ink.select(*BOXES))


ROUTES: dict[str, Callable[[DataFrame], DataFrame]] = {"adaptive": adaptive_route, "lsd": line_route, "hierarchy": hierarchy_route, "gutter": gutter_route}


def enabled_routes(config: dict[str, bool], routes: dict | None = None) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Routes that the configuration doesn't switch off; a branch that is off is no part of the plan."""
    return {name: f for name, f in (routes or ROUTES).items() if config.get(name, True)}


def union_routes(rasters: DataFrame, routes: dict) -> DataFrame:
    """All boxes with their route."""
    frames = [f(rasters).withColumn("route", F.lit(name)) for name, f in routes.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def core_detection(rasters: DataFrame, width: float, height: float, routes: dict | None = None, scorer: Callable | None = None) -> DataFrame:
    """The boxes of each page's best route. scorer: (boxes, width, height) -> page_id, route, n, score, boxes."""
    boxes = union_routes(rasters, routes or ROUTES)
    best = R.select_route((scorer or R.scored_layouts)(boxes, width, height))
    return best.select("page_id", "route", F.explode("boxes").alias("b")).select("page_id", "route", "b.*")


def multiscale_detection(rasters: DataFrame, width: float, height: float, scales: tuple[float, ...] = (0.6, 1.0, 1.5), **params) -> DataFrame:
    """Core detection at several scales, in the page's own lengths, and what at least two scales agree on."""
    found = None
    for k, s in enumerate(scales):
        part = rasters if s == 1.0 else A.resized(rasters, s)
        boxes = core_detection(part, width * s, height * s, **params).select("page_id", *[(F.col(c) / s).alias(c) for c in "xywh"], F.lit(k).alias("scale_id"))
        found = boxes if found is None else found.unionByName(boxes)
    number = F.row_number().over(Y._page().orderBy("scale_id", "y", "x", "h", "w"))
    return Y.consensus(found.withColumn("rect_id", number), scales=len(scales)).withColumnRenamed("merged_id", "rect_id").select(*BOXES)


def scale_audit(rasters: DataFrame, route: Callable, scales: tuple[float, ...]) -> DataFrame:
    """(page_id, scale, n): how many boxes a route finds at each scale."""
    counts = None
    for s in scales:
        part = route(rasters if s == 1.0 else A.resized(rasters, s)).groupBy("page_id").agg(F.count("*").alias("n")).withColumn("scale", F.lit(float(s)))
        counts = part if counts is None else counts.unionByName(part)
    return counts


def layout_audit(rasters: DataFrame, boxes: DataFrame, dark: int = 225) -> DataFrame:
    """Per page: boxes, their share of the page, the smallest one's, and the page's share of dark pixels."""
    found = _page_share(boxes, rasters).groupBy("page_id").agg(F.count("*").alias("n"), F.round(F.sum("share"), 9).alias("covered"), F.round(F.min("share"), 9).alias("smallest"))
    ink = A.level_shares(rasters, [dark]).select("page_id", F.round(1 - F.col("share"), 9).alias("ink"))
    return ink.join(found, "page_id", "left").fillna(0, ["n"])


def detect_pages(rasters: DataFrame, width: float, height: float, corrected: DataFrame | None = None, rtl: bool = False, row_gap: float = 5.0, **params) -> DataFrame:
    """Panels of each page in reading order: best route, templates where it is weak, filters, saved corrections."""
    boxes = core_detection(rasters, width, height, **params).drop("route")
    boxes = T.refine(boxes, T.score_templates(A.tile_maps(rasters)), width, height)
    fine = Y.suppress_nested(R.filter_by_area(boxes, width, height))
    if corrected is not None:
        fine = fine.join(corrected.select("page_id").distinct(), "page_id", "left_anti").unionByName(corrected.select(*fine.columns))
    return R.reading_order(fine, row_gap=row_gap, rtl=rtl).select("page_id", "panel_no", "x", "y", "w", "h")
