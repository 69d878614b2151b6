"""Colour backgrounds, thresholds, equalisation, smoothing and components of pixel frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagegrid.functions.colour import distance, with_lab

CHANNELS = ["L", "A", "B"]


def to_lab(rgb: DataFrame) -> DataFrame:
    """Pixels (page_id, y, x, r, g, b) with L, A, B."""
    return with_lab(rgb).select("page_id", "y", "x", *[F.round(c, 6).alias(c) for c in CHANNELS])


def border_background(pixels: DataFrame, width: int, height: int, share: float = 0.04, least: int = 5) -> DataFrame:
    """Median colour of a page's border strips; corners lie in two strips and count twice."""
    bx, by = max(least, int(share * width)), max(least, int(share * height))
    strips = ((F.col("x") < bx) | (F.col("x") >= width - bx)).cast("int") + ((F.col("y") < by) | (F.col("y") >= height - by)).cast("int")
    counted = pixels.withColumn("_n", strips).filter("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return counted.groupBy("page_id").agg(*[F.median(c).alias(f"bg_{c}") for c in CHANNELS])


def background_mask(pixels: DataFrame, background: DataFrame, delta: float = 12.0) -> DataFrame:
    """Pixels with `is_bg`: nearer than delta to their page's background."""
    joined = pixels.join(background, "page_id")
    near = distance([F.col(c) for c in CHANNELS], [F.col(f"bg_{c}") for c in CHANNELS]) < delta
    return joined.select("page_id", "y", "x", near.alias("is_bg"))


def surely_background(light: Column, border: Column, frac: Column) -> Column:
    """Bright and at the border, or holding much of the border."""
    return (frac >= 0.05) & (((light > 140) & (border >= 0.15)) | (border >= 0.40))


def maybe_background(light: Column, frac: Column) -> Column:
    """Large and bright enough to stand in where no cluster is surely background."""
    return (light > 120) & (frac > 0.08)


def background_clusters(clusters: DataFrame) -> DataFrame:
    """Clusters (page_id, cluster_id, L, border, frac) that are background.

    Bright ones at the border, or ones that hold much of the border; where a page has none, its
    largest bright cluster.
    """
    page = Window.partitionBy("page_id")
    marked = clusters.withColumn("_sure", surely_background(F.col("L"), F.col("border"), F.col("frac"))).withColumn("_any", F.max("_sure").over(page))
    marked = marked.withColumn("_spare", maybe_background(F.col("L"), F.col("frac")))
    first = F.row_number().over(page.orderBy(F.desc("_spare"), F.desc("frac"), "cluster_id")) == 1
    return marked.withColumn("_first", first).filter("_sure or (not _any and _spare and _first)").drop("_sure", "_any", "_spare", "_first")


def dominant_background(clusters: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, L, A, B) of the background cluster with most border, else of the brightest one, else white."""
    bg = background_clusters(clusters).groupBy("page_id").agg(F.max(F.struct("border", *CHANNELS)).alias("b"))
    top = clusters.groupBy("page_id").agg(F.max(F.struct(*CHANNELS)).alias("t"))
    both = pages.select("page_id").join(bg, "page_id", "left").join(top, "page_id", "left")
    white = {"L": 255.0, "A": 128.0, "B": 128.0}
    return both.select("page_id", *[F.coalesce(f"b.{c}", f"t.{c}", F.lit(white[c])).alias(c) for c in CHANNELS])


def _box_mean(k: int) -> tuple[Window, Window]:
    return Window.partitionBy("page_id", "y").orderBy("x").rowsBetween(-k, k), Window.partitionBy("page_id", "x").orderBy("y").rowsBetween(-k, k)


def local_threshold(pixels: DataFrame, block: int, c: float = 5.0) -> DataFrame:
    """`dark` where v is at most the mean of its block x block surroundings less c."""
    along, down = _box_mean(block // 2)
    p = pixels.withColumn("s", F.sum("v").over(along)).withColumn("n", F.count("*").over(along))
    p = p.withColumn("s", F.sum("s").over(down)).withColumn("n", F.sum("n").over(down))
    return p.select("page_id", "y", "x", (F.col("v") * F.col("n") <= F.col("s") - c * F.col("n")).alias("dark"))


def tile_equalise(pixels: DataFrame, width: int, height: int, tiles: int = 8, clip: float = 2.0) -> DataFrame:
    """Gray levels by the clipped cumulative histogram of their tile; the excess is spread evenly."""
    p = pixels.withColumn("ty", F.floor(F.col("y") * tiles / height).cast("int")).withColumn("tx", F.floor(F.col("x") * tiles / width).cast("int"))
    n = p.groupBy("page_id", "ty", "tx", "v").agg(F.count("*").alias("n"))
    tile = Window.partitionBy("page_id", "ty", "tx")
    n = n.withColumn("total", F.sum("n").over(tile))
    n = n.withColumn("c", F.least(F.col("n").cast("double"), F.greatest(F.lit(1.0), clip * F.col("total") / 256)))
    run = F.sum("c").over(tile.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    n = n.withColumn("excess", F.col("total") - F.sum("c").over(tile)).withColumn("cdf", run + (F.col("v") + 1) * F.col("excess") / 256)
    table = n.select("page_id", "ty", "tx", "v", F.round(F.col("cdf") * 255 / F.col("total"), 6).alias("out"))
    return p.join(table, ["page_id", "ty", "tx", "v"]).select("page_id", "y", "x", F.col("out").alias("v"))


def smoothing_weights(window: int, order: int) -> np.ndarray:
    """window x window: row r has the weights that give place r of the least-squares polynomial of a window."""
    powers = np.vander(np.arange(window) - window // 2, order + 1, increasing=True)
    return powers @ np.linalg.pinv(powers)


def smooth_profile(prof: DataFrame, window: int = 51, order: int = 3) -> DataFrame:
    """Polynomial smoothing of (page_id, idx, v), idx from 0; the first and last window's polynomials give the ends.

    Profiles shorter than the window keep their values.
    """
    weights = F.lit(smoothing_weights(window, order).ravel())
    pages = prof.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.col("v").cast("double").alias("v")))).alias("_s"))
    pages = pages.select("page_id", F.transform("_s", lambda q: q["v"]).alias("_v"), F.size("_s").alias("_n"), F.posexplode("_s").alias("_i", "_q"))
    start = F.least(F.greatest(F.col("_i") - window // 2, F.lit(0)), F.col("_n") - window)
    terms = F.zip_with(F.slice("_v", start + 1, window), F.slice(weights, (F.col("_i") - start) * window + 1, window), lambda a, b: a * b)
    fitted = F.when(F.col("_n") < window, F.col("_q.v")).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))
    return pages.select("page_id", F.col("_q.idx").alias("idx"), F.round(fitted, 6).alias("smooth"))


def local_peaks(prof: DataFrame, share: float = 0.85) -> DataFrame:
    """Samples above both neighbours and at or above the page's percentile."""
    w = Window.partitionBy("page_id").orderBy("idx")
    top = prof.groupBy("page_id").agg(F.percentile("v", F.lit(share)).alias("p"))
    marked = prof.withColumn("_up", (F.col("v") > F.lag("v").over(w)) & (F.col("v") > F.lead("v").over(w)))
    return marked.filter("_up").join(top, "page_id").filter("v >= p").select("page_id", "idx", "v")


def top_peaks(peaks: DataFrame, most: int = 10) -> DataFrame:
    """The highest peaks, numbered in the order of their positions."""
    page = Window.partitionBy("page_id")
    best = peaks.withColumn("_r", F.row_number().over(page.orderBy(F.desc("v"), "idx"))).filter(F.col("_r") <= most)
    return best.select("page_id", "idx", "v", F.row_number().over(page.orderBy("idx")).alias("peak_no"))


def space_peaks(peaks: DataFrame, apart: int) -> DataFrame:
    """Highest first; a peak goes if a kept one is nearer than `apart`."""
    start = F.array().cast("array<struct<idx:int,v:double>>")

    def step(acc, p):
        own = F.struct(p["idx"].cast("int").alias("idx"), (-p["low"]).cast("double").alias("v"))
        return F.when(F.exists(acc, lambda k: F.abs(k["idx"] - p["idx"]) < apart), acc).otherwise(F.concat(acc, F.array(own)))

    pages = peaks.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("low"), "idx"))).alias("items"))
    return pages.select("page_id", F.explode(F.aggregate("items", start, step)).alias("k")).select("page_id", "k.*")


def prominent(peaks: DataFrame, prof: DataFrame, least: float) -> DataFrame:
    """Peaks that rise at least `least` over the higher of the two valleys before higher ground."""
    samples = prof.groupBy("page_id").agg(F.collect_list(F.struct(F.col("idx").alias("j"), F.col("v").alias("u"))).alias("_s"))
    near = peaks.join(samples, "page_id")
    wall = lambda side: F.transform(F.filter("_s", lambda q: side(q["j"]) & (q["u"] > F.col("v"))), lambda q: q["j"])
    near = near.withColumn("_l", F.array_max(wall(lambda j: j < F.col("idx")))).withColumn("_r", F.array_min(wall(lambda j: j > F.col("idx"))))
    valley = lambda side: F.array_min(F.transform(F.filter("_s", lambda q: side(q["j"])), lambda q: q["u"]))
    lo = valley(lambda j: (j <= F.col("idx")) & (F.col("_l").isNull() | (j > F.col("_l"))))
    hi = valley(lambda j: (j >= F.col("idx")) & (F.col("_r").isNull() | (j < F.col("_r"))))
    return near.select("page_id", "idx", "v", (F.col("v") - F.greatest(lo, hi)).alias("prominence")).filter(F.col("prominence") >= least)


def validate_bands(bands: DataFrame, pixels: DataFrame, mask: Column, axis: str = "y", thick: int = 2, cover: float = 0.45) -> DataFrame:
    """Bands thick enough whose pixels are in the mask for at least `cover`."""
    wide = bands.filter(F.col("hi") - F.col("lo") + 1 >= thick)
    inside = pixels.join(wide, "page_id").filter(F.col(axis).between(F.col("lo"), F.col("hi")))
    return inside.groupBy("page_id", "lo", "hi").agg(F.avg(mask.cast("double")).alias("cover")).filter(F.col("cover") >= cover)


def _join_runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Components of one page's runs (y, lo, hi); runs of neighbouring rows touch within one pixel."""
    runs = pdf.sort_values(["y", "lo"], ignore_index=True)
    parent = list(range(len(runs)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    rows = {y: g for y, g in runs.groupby("y")}
    for y, here in rows.items():
        if (above := rows.get(y - 1)) is None:
            continue
        first = np.searchsorted(above["hi"].to_numpy(), here["lo"].to_numpy() - 1)
        last = np.searchsorted(above["lo"].to_numpy(), here["hi"].to_numpy() + 1, side="right")
        for i, a, b in zip(here.index, first, last, strict=True):
            for j in above.index[a:b]:
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    runs["c"] = [root(i) for i in range(len(runs))]
    runs["size"] = runs["hi"] - runs["lo"] + 1
    out = runs.groupby("c").agg(page_id=("page_id", "first"), x=("lo", "min"), right=("hi", "max"), y=("y", "min"), bottom=("y", "max"), n_pixels=("size", "sum")).reset_index(drop=True)
    out["component"] = np.arange(1, len(out) + 1)
    return out.assign(w=out["right"] - out["x"] + 1, h=out["bottom"] - out["y"] + 1)[["page_id", "component", "x", "y", "w", "h", "n_pixels"]]


def grid_components(mask: DataFrame) -> DataFrame:
    """8-connected components of the pixels (page_id, y, x) of mask, with box and size.

    Runs of each row are built by a window; only a page's runs meet in one task, never its pixels.
    """
    w = Window.partitionBy("page_id", "y").orderBy("x")
    island = F.col("x") - F.row_number().over(w)
    runs = mask.select("page_id", "y", "x").withColumn("_i", island).groupBy("page_id", "y", "_i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    cols = [F.col(c).cast("long").alias(c) for c in ("page_id", "y", "lo", "hi")]
    return runs.select(*cols).groupBy("page_id").applyInPandas(_join_runs, "page_id long, component long, x long, y long, w long, h long, n_pixels long")


def stripe_filter(components: DataFrame, size: int, long: float = 0.20, thin: int = 25, ratio: float = 4.0) -> DataFrame:
    """Components that are long and thin, or stretched and not too short."""
    longest, least = F.greatest("w", "h"), F.least("w", "h")
    return components.filter(((longest >= long * size) & (least <= thin)) | ((longest / least >= ratio) & (longest >= 0.4 * long * size)))
