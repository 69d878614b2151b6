"""Profiles, bands, cells, region sums and stencils over pixels (page_id, y, x, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def profile(pixels: DataFrame, axis: str) -> DataFrame:
    """Mean brightness per row (axis y) or column (axis x)."""
    return pixels.groupBy("page_id", F.col(axis).alias("idx")).agg(F.avg("v").alias("mean_v"))


def profile_threshold(prof: DataFrame, share: float, min_contrast: float = 30.0) -> DataFrame:
    """Per page median + share x (max - median); pages without contrast have no row."""
    stats = prof.groupBy("page_id").agg(F.percentile("mean_v", F.lit(0.5)).alias("median"), F.max("mean_v").alias("high"))
    return stats.filter(F.col("high") - F.col("median") >= min_contrast).select("page_id", (F.col("median") + share * (F.col("high") - F.col("median"))).alias("threshold"))


def bands(indexes: DataFrame, gap: int = 5, min_len: int = 3, keys: list[str] | None = None) -> DataFrame:
    """Islands of idx: a new band where the step from the one before is above gap."""
    keys = keys or ["page_id"]
    w = Window.partitionBy(*keys).orderBy("idx")
    new = F.when(F.col("idx") - F.lag("idx").over(w) <= gap, 0).otherwise(1)
    marked = indexes.select(*keys, "idx").withColumn("new", new).withColumn("band", F.sum("new").over(w))
    out = marked.groupBy(*keys, "band").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    return out.filter(F.col("hi") - F.col("lo") + 1 >= min_len).select(*keys, "lo", "hi")


def profile_bands(pixels: DataFrame, axis: str, share: float = 0.65, gap: int = 5, min_len: int = 3) -> DataFrame:
    prof = profile(pixels, axis)
    bright = prof.join(profile_threshold(prof, share), "page_id").filter("mean_v >= threshold")
    return bands(bright, gap, min_len)


def spans_between(bands_: DataFrame, size: int) -> DataFrame:
    """The stretches (lo, hi exclusive) between consecutive bands and the page's edges."""
    edges = bands_.select("page_id", "lo", F.col("hi").alias("b_hi"))
    w = Window.partitionBy("page_id").orderBy("lo")
    inner = edges.select("page_id", (F.col("b_hi") + 1).alias("from"), F.coalesce(F.lead("lo").over(w), F.lit(size)).alias("to"))
    first = edges.groupBy("page_id").agg(F.min("lo").alias("to")).select("page_id", F.lit(0).alias("from"), "to")
    return first.unionByName(inner).filter("to > from")


def grid_cells(h: DataFrame, v: DataFrame, width: int, height: int, min_side: int = 5) -> DataFrame:
    """Cells between consecutive bands of both directions."""
    rows = spans_between(h, height).select("page_id", F.col("from").alias("y"), (F.col("to") - F.col("from")).alias("h")).filter(F.col("h") >= min_side)
    cols = spans_between(v, width).select("page_id", F.col("from").alias("x"), (F.col("to") - F.col("from")).alias("w")).filter(F.col("w") >= min_side)
    return rows.join(cols, "page_id").select("page_id", "x", "y", "w", "h")


def summed_area(pixels: DataFrame, value) -> DataFrame:
    """Cumulative sums over x, then over y: any rectangle's sum is four lookups."""
    along = Window.partitionBy("page_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("page_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return pixels.withColumn("s", F.sum(value).over(along)).withColumn("s", F.sum("s").over(down)).select("page_id", "y", "x", "s")


def region_sums(rects: DataFrame, pixels: DataFrame, value) -> DataFrame:
    """Sum of value inside each rectangle (page_id, rect_id, x, y, w, h in pixels)."""
    table = summed_area(pixels, value)
    corner = [(F.col("x") + F.col("w") - 1, F.col("y") + F.col("h") - 1, 1), (F.col("x") - 1, F.col("y") + F.col("h") - 1, -1), (F.col("x") + F.col("w") - 1, F.col("y") - 1, -1), (F.col("x") - 1, F.col("y") - 1, 1)]
    asked = rects.select("page_id", "rect_id", F.explode(F.array(*[F.struct(a.cast("int").alias("x"), b.cast("int").alias("y"), F.lit(k).alias("k")) for a, b, k in corner])).alias("c"))
    got = asked.select("page_id", "rect_id", "c.x", "c.y", "c.k").join(table, ["page_id", "y", "x"])
    return got.groupBy("page_id", "rect_id").agg(F.sum(F.col("k") * F.col("s")).alias("total"))


def morphology(pixels: DataFrame, op: str, kx: int, ky: int) -> DataFrame:
    """Erode or dilate with a rectangle of 2k+1 pixels a side: a running min or max on each axis."""
    f = {"erode": F.min, "dilate": F.max}[op]
    along = Window.partitionBy("page_id", "y").orderBy("x").rowsBetween(-kx, kx)
    down = Window.partitionBy("page_id", "x").orderBy("y").rowsBetween(-ky, ky)
    return pixels.withColumn("v", f("v").over(along)).withColumn("v", f("v").over(down)).select("page_id", "y", "x", "v")


def sobel(pixels: DataFrame) -> DataFrame:
    """|gx| + |gy| of the 3x3 Sobel kernels, on pixels with all eight neighbours."""
    along = Window.partitionBy("page_id", "y").orderBy("x")
    down = Window.partitionBy("page_id", "x").orderBy("y")
    before, after = F.lag("v").over(along), F.lead("v").over(along)
    p = pixels.withColumn("dx", after - before).withColumn("sx", before + 2 * F.col("v") + after)
    gx = F.lag("dx").over(down) + 2 * F.col("dx") + F.lead("dx").over(down)
    gy = F.lead("sx").over(down) - F.lag("sx").over(down)
    return p.select("page_id", "y", "x", (F.abs(gx) + F.abs(gy)).alias("g")).filter("g is not null")


def tile_content(pixels: DataFrame, grid: int, width: int, height: int, dark: int = 200) -> DataFrame:
    """Share of dark pixels in each of grid x grid tiles."""
    spark = pixels.sparkSession
    n = spark.range(grid).select(F.col("id").cast("int").alias("i"))
    cut = lambda size, name: n.select(F.col("i").alias(name), F.floor(F.col("i") * size / grid).alias(f"{name}_lo"), F.floor((F.col("i") + 1) * size / grid).alias(f"{name}_hi"))
    p = pixels.join(F.broadcast(cut(height, "ty")), (F.col("y") >= F.col("ty_lo")) & (F.col("y") < F.col("ty_hi"))).join(F.broadcast(cut(width, "tx")), (F.col("x") >= F.col("tx_lo")) & (F.col("x") < F.col("tx_hi")))
    return p.groupBy("page_id", "ty", "tx").agg(F.avg((F.col("v") < dark).cast("double")).alias("content"))
