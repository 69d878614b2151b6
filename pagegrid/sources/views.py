"""Page-layout frames derived from the supplied tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.window import Window

PAGE_W, PAGE_H = 720.0, 910.0
RASTER_W, RASTER_H = 48, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate rectangles: one per line item, its order is the page."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    a, b, c = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("int")
    n = table(spark, sf_dir, "lineitem").withColumn("rect_id", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))
    route = F.when((a + b) % 4 == 0, "adaptive").when((a + b) % 4 == 1, "lsd").when((a + b) % 4 == 2, "hierarchy").otherwise("gutter")
    return n.select(
        F.col("l_orderkey").alias("page_id"), F.col("rect_id"), ((a * 7 + F.col("rect_id") * 131) % 420).cast("double").alias("x"), ((b * 13 + F.col("rect_id") * 97) % 620).cast("double").alias("y"),
        (60 + (a * 3) % 240).cast("double").alias("w"), (40 + c * 5).cast("double").alias("h"), route.alias("route"), (b % 3).cast("int").alias("scale_id"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One brightness profile per embedding."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), F.posexplode("embedding").alias("idx", "e"))
    return e.select("page_id", "idx", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), 200 + F.col("e").cast("double") * 400))).cast("int").alias("v"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster per supplier with gutters at known places, in three layouts."""
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id"), F.explode(F.sequence(F.lit(0), F.lit(RASTER_H - 1))).alias("y"))
    p = p.select("page_id", "y", F.explode(F.sequence(F.lit(0), F.lit(RASTER_W - 1))).alias("x"))
    k = F.col("page_id") % 3
    x, y = F.col("x"), F.col("y")
    white = (x < 2) | (y < 2) | (x > 45) | (y > 61) | y.between(31, 33) | ((k > 0) & (y < 31) & x.between(23, 25)) | ((k == 2) & (y > 33) & x.between(15, 17))
    return p.withColumn("v", F.when(white, 250).otherwise(((F.col("page_id") * 31 + x * 17 + y * 29 + x * y * 7) % 180).cast("int")))


def _painted(spark: SparkSession, sf_dir: str, paint: Callable[[int], dict[str, np.ndarray]], channels: str, most: int = 1 << 20) -> DataFrame:
    """A page per supplier, one row each: its width, height and the channels that paint(page_id) gives, rows end to end.

    Ids are dealt out before they grow to pages, and a batch of pages has about `most` pixels.
    """
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id"))
    ids = ids.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "page_id")
    names, key = channels.split(), ids.schema["page_id"]
    schema = StructType([key, *_parse_datatype_string("width int, height int, " + ", ".join(f"{c} array<smallint>" for c in names)).fields])

    def batch(pages: list[int], planes: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        high, wide = zip(*(p[names[0]].shape for p in planes), strict=True)
        starts = pa.array(np.append(0, np.cumsum(np.multiply(wide, high))), pa.int32())
        lists = [pa.ListArray.from_arrays(starts, pa.array(np.concatenate([p[c].ravel() for p in planes]).astype(np.int16))) for c in names]
        return pa.RecordBatch.from_arrays([pa.array(pages, to_arrow_type(key.dataType)), pa.array(wide, pa.int32()), pa.array(high, pa.int32()), *lists], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]):
        pages, planes, size = [], [], 0
        for page in (i for b in batches for i in b.column(0).to_pylist()):
            planes.append(paint(page))
            pages.append(page)
            size += planes[-1][names[0]].size
            if size >= most:
                yield batch(pages, planes)
                pages, planes, size = [], [], 0
        if pages:
            yield batch(pages, planes)

    return ids.mapInArrow(run, schema)


def _tones(page: int) -> np.ndarray:
    """The raster of pixels() of one page."""
    y, x = np.mgrid[0:RASTER_H, 0:RASTER_W]
    k = page % 3
    white = (x < 2) | (y < 2) | (x > 45) | (y > 61) | ((y > 30) & (y < 34))
    if k > 0:
        white |= (y < 31) & (x > 22) & (x < 26)
    if k == 2:
        white |= (y > 33) & (x > 14) & (x < 18)
    return np.where(white, 250, (page * 31 + x * 17 + y * 29 + x * y * 7) % 180)


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages as pixels(), one row each: gray holds the rows of the page end to end."""
    return _painted(spark, sf_dir, lambda page: {"gray": _tones(page)}, "gray")


def tinted_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of rasters() with channels r, g, b that follow from a pixel's tone and place."""

    def paint(page: int) -> dict[str, np.ndarray]:
        v, (y, x) = _tones(page), np.mgrid[0:RASTER_H, 0:RASTER_W]
        return {"r": v, "g": (v * 3 + x * 5) % 256, "b": (v * 7 + y * 3) % 256}

    return _painted(spark, sf_dir, paint, "r g b")


# colours of the papers and of three panels; the first paper is plain white
PAPERS = [(250, 250, 250), (240, 225, 190), (170, 170, 170), (25, 25, 30)]
INKS = [(150, 40, 40), (120, 120, 120), (40, 60, 140)]
#: 0 is paper, 1 to 3 are panels; on every fifth page the panels are bands that reach the edges.
TONE = (
    "case when page_id % 5 = 4 then case when y < 20 then 1 when y < 22 then 0 when y < 42 then 2 when y < 44 then 0 else 3 end "
    "when x < 2 or y < 2 or x > 45 or y > 61 or y between 31 and 33 or (y < 31 and x between 23 and 25) then 0 "
    "when y > 33 then 3 when x < 24 then 1 else 2 end"
)


def _colour(channel: int, paper: str, tone: str) -> str:
    papers = " ".join(f"when {i} then {c[channel]}" for i, c in enumerate(PAPERS))
    inks = " ".join(f"when {i} then {c[channel]}" for i, c in enumerate(INKS, 1))
    return f"case {tone} {inks} else case {paper} {papers} end end"


def colour_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of four flat colours per supplier, one row each: channels r, g, b hold its rows end to end."""
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id")).repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "page_id")
    tones = "transform(sequence(0, {}), i -> {})".format(RASTER_W * RASTER_H - 1, re.sub(r"\bx\b", f"(i % {RASTER_W})", re.sub(r"\by\b", f"(i div {RASTER_W})", TONE)))
    p = p.withColumn("tones", F.expr(tones)).withColumn("paper", F.expr(f"int(page_id div 5 % {len(PAPERS)})"))
    channels = [F.expr(f"transform(tones, t -> cast({_colour(k, 'paper', 't')} as smallint))").alias(c) for k, c in enumerate("rgb")]
    return p.select("page_id", F.lit(RASTER_W).alias("width"), F.lit(RASTER_H).alias("height"), *channels)


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader commands and corrections from events."""
    names = {"purchase": "upsert", "error": "revert", "signup": "cancel", "view": "detect", "click": "request"}
    action = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")]
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("page_id"), action.alias("action"), "value")


RECTS_SQL = """
select page_id, rect_id, cast((a*7 + rect_id*131) % 420 as double) x, cast((b*13 + rect_id*97) % 620 as double) y,
  cast(60 + (a*3) % 240 as double) w, cast(40 + c*5 as double) h,
  case (a+b)%4 when 0 then 'adaptive' when 1 then 'lsd' when 2 then 'hierarchy' else 'gutter' end route, cast(b % 3 as int) scale_id
from (select l_orderkey page_id, l_partkey a, l_suppkey b, cast(l_quantity as int) c,
  row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_shipdate) rect_id from lineitem)"""
PROFILES_SQL = """
select vec_id page_id, i idx, cast(floor(greatest(0, least(255, 200 + e::double*400))) as int) v
from (select vec_id, unnest(range(len(embedding))) i, unnest(embedding) e from embeddings)"""
PIXELS_SQL = """
select s_suppkey page_id, y::int y, x::int x, case
  when x<2 or y<2 or x>45 or y>61 or (y between 31 and 33) or (s_suppkey%3>0 and y<31 and x between 23 and 25)
    or (s_suppkey%3=2 and y>33 and x between 15 and 17) then 250
  else cast((s_suppkey*31+x*17+y*29+x*y*7)%180 as int) end v
from supplier cross join (select unnest(range(64)) y) cross join (select unnest(range(48)) x)"""
COLOURS_SQL = f"""
select page_id, y, x, {", ".join(f"{_colour(k, 'paper', 'tone')} {c}" for k, c in enumerate("rgb"))}
from (select *, {TONE} tone, page_id // 5 % {len(PAPERS)} paper from (select s_suppkey page_id, y::int y, x::int x
  from supplier cross join (select unnest(range(64)) y) cross join (select unnest(range(48)) x)))"""
ACTIONS_SQL = """
select event_id, ts, user_id page_id, case event_type when 'purchase' then 'upsert' when 'error' then 'revert' when 'signup' then 'cancel' when 'view' then 'detect' when 'click' then 'request' end action, value from events"""

#: The panels that pixels() draws, and the cells between its gutters (which reach to the page's edges).
PANELS_SQL = """
select s_suppkey page_id, row_number() over (partition by s_suppkey order by y, x) panel, x::double x, y::double y, w::double w, h::double h from supplier join (values
  (0, 2, 2, 44, 29), (0, 2, 34, 44, 28), (1, 2, 2, 21, 29), (1, 26, 2, 20, 29), (1, 2, 34, 44, 28),
  (2, 2, 2, 21, 29), (2, 26, 2, 20, 29), (2, 2, 34, 13, 28), (2, 18, 34, 28, 28)) t(k, x, y, w, h) on s_suppkey % 3 = k"""
CELLS_SQL = """
select s_suppkey page_id, x::double x, y::double y, w::double w, h::double h from supplier join (values
  (0, 0, 0, 48, 31), (0, 0, 34, 48, 30), (1, 0, 0, 23, 31), (1, 26, 0, 22, 31), (1, 0, 34, 48, 30),
  (2, 0, 0, 23, 31), (2, 26, 0, 22, 31), (2, 0, 34, 15, 30), (2, 18, 34, 30, 30)) t(k, x, y, w, h) on s_suppkey % 3 = k"""


#: The same panels as (page_id % 3, panel, (x, y, w, h)).
PANELS = [
    (0, 1, (2, 2, 44, 29)), (0, 2, (2, 34, 44, 28)), (1, 1, (2, 2, 21, 29)), (1, 2, (26, 2, 20, 29)), (1, 3, (2, 34, 44, 28)),
    (2, 1, (2, 2, 21, 29)), (2, 2, (26, 2, 20, 29)), (2, 3, (2, 34, 13, 28)), (2, 4, (18, 34, 28, 28)),
]

#: Drawn pages are the rasters of rasters() in one tone of ink, magnified by this and 2 more on odd ids.
MAGNIFIED = 6


def drawn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two sizes (288 x 384 and 384 x 512 pixels): panels of one tone, by page_id % 5 also a soft
    picture without any border (3) and an empty sheet (4).
    """

    def paint(page: int) -> dict[str, np.ndarray]:
        kind, m = page % 5, MAGNIFIED + 2 * (page % 2)
        v = _tones(page)
        if kind == 3:
            v = np.broadcast_to((70 + np.arange(RASTER_H) * 3 // 4)[:, None], v.shape)
        else:
            v = np.where(v < 225, 250 if kind == 4 else 40, 250)
        return {"gray": v.astype(np.int16).repeat(m, 0).repeat(m, 1)}

    return _painted(spark, sf_dir, paint, "gray")
