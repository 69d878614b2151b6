"""Corrections, sweeps, navigation and other jobs over a library of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def correction_key(path, page):
    """Store key of a page's corrections: page numbers have four digits or more, never cut."""
    return F.concat(F.substring(F.md5(path), 1, 12), F.lit("_page"), F.when(page.isNotNull(), F.format_string("%04d", page.cast("long"))))


def latest_by_page(actions: DataFrame) -> DataFrame:
    """The last action of each page, by time and then id."""
    last = actions.groupBy("page_id").agg(F.max(F.struct("ts", "event_id", "action", "value")).alias("a"))
    return last.select("page_id", "a.ts", "a.event_id", "a.action", "a.value")


def live_corrections(actions: DataFrame) -> DataFrame:
    """Pages whose last upsert or revert is an upsert: a revert deletes."""
    return latest_by_page(actions.filter(F.col("action").isin("upsert", "revert"))).filter("action = 'upsert'")


def apply_corrections(rects: DataFrame, corrected: DataFrame) -> DataFrame:
    """A page's saved rectangles replace its detected ones."""
    kept = rects.join(corrected.select("page_id").distinct(), "page_id", "left_anti")
    return kept.unionByName(corrected)


def pending_pages(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Pages without a result under their configuration's hash."""
    return pages.join(results.select("page_id", "config_hash").distinct(), ["page_id", "config_hash"], "left_anti")


def neighbour_pages(current: DataFrame, pages: DataFrame, cached: DataFrame) -> DataFrame:
    """The pages before and after that exist and have no result yet."""
    near = current.select(F.explode(F.array(F.col("page_id") + 1, F.col("page_id") - 1)).alias("page_id")).distinct()
    return near.join(pages.select("page_id").distinct(), "page_id", "left_semi").join(cached.select("page_id").distinct(), "page_id", "left_anti")


def hit_test(points: DataFrame, rects: DataFrame) -> DataFrame:
    """Per point (point_id, page_id, px, py) the topmost rectangle that holds it, or null."""
    inside = points.join(rects.select("page_id", "rect_id", "x", "y", "w", "h"), "page_id").filter("px between x and x + w and py between y and y + h")
    top = inside.groupBy("point_id").agg(F.max("rect_id").alias("rect_id"))
    return points.select("point_id", "page_id").join(top, "point_id", "left")


def panel_navigation(ordered: DataFrame, doc: str, page: str, rank: str) -> DataFrame:
    """Next panel crosses to the next page; previous wraps inside its page."""
    through = Window.partitionBy(doc).orderBy(page, rank)
    inside = Window.partitionBy(doc, page).orderBy(rank)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = ordered.withColumn("next_page", F.lead(page).over(through)).withColumn("next_panel", F.lead(rank).over(through))
    return out.withColumn("prev_panel", F.coalesce(F.lag(rank).over(inside), F.last(rank).over(whole)))


def document_offsets(pages: DataFrame, zoom: float = 1.0, spacing: float = 12.0) -> DataFrame:
    """Where each page starts in continuous scroll."""
    before = Window.partitionBy("doc").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("y_offset", F.coalesce(F.sum(F.col("height_pt") * zoom + spacing).over(before), F.lit(0.0)))


def chain_islands(rows: DataFrame, keys: list[str], position: str, gap: float) -> DataFrame:
    """Chains of positions, each within gap of the one before: island id from 1."""
    w = Window.partitionBy(*keys).orderBy(position)
    new = F.when(F.col(position) - F.lag(position).over(w) <= gap, 0).otherwise(1)
    running = Window.partitionBy(*keys).orderBy(position).rangeBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(running)).drop("_new")


def sweep(rects: DataFrame, grid: DataFrame, page_area: float) -> DataFrame:
    """Rectangles kept per page and configuration; grid holds one row per configuration.

    A page's sizes meet once and are compared with every configuration there, so only rectangles are shuffled.
    """
    if len(grid.take(4097)) > 4096:
        raise ValueError("a sweep has at most 4096 configurations")
    size = F.col("w") * F.col("h") / page_area
    by_page = rects.select("page_id", size.alias("_size")).groupBy("page_id").agg(F.collect_list("_size").alias("_sizes"))
    held = F.filter("_sizes", lambda v: (v >= F.col("min_pct")) & (v <= F.col("max_pct")))
    counts = by_page.join(F.broadcast(grid)).select("config_id", "page_id", F.size(held).cast("long").alias("n"))
    return counts.filter("n > 0")
