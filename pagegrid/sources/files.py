"""Page images, panel files, reports and decisions as files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PANELS = "image_path string, image_size struct<width:int,height:int>, num_panels int, panels array<struct<index:int,x:int,y:int,width:int,height:int>>"


def read_pages(spark: SparkSession, path: str, dpi: int = 150) -> DataFrame:
    """Images with their page number (from `*_page_NNN.*`) and size in points; unreadable ones are dropped."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return page_dims(numbered_pages(raw), dpi)


def numbered_pages(images: DataFrame) -> DataFrame:
    """images (with `origin`) and the page number in their file's name, or null."""
    number = F.regexp_extract("origin", r"_page_(\d+)\.[A-Za-z]+$", 1)
    return images.withColumn("page_id", F.when(number != "", number.cast("long")))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; a local master may go without that setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="pagegrid-")
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The same rows, written to a shared folder: for results that are read several times."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def unreadable_pages(spark: SparkSession, path: str) -> DataFrame:
    """`origin` of the images that read_pages drops."""
    return spark.read.format("image").load(path).select("image.origin", "image.nChannels").filter("nChannels < 0").select("origin")


def page_dims(pages: DataFrame, dpi: int = 150) -> DataFrame:
    """Size in points of pages with width and height in pixels."""
    return pages.withColumn("width_pt", F.col("width") * 72.0 / dpi).withColumn("height_pt", F.col("height") * 72.0 / dpi)


def _rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for page, h, w, n, data in zip(pdf["page_id"], pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"], strict=True):
            p = np.frombuffer(data, np.uint8).reshape(h, w, n).astype(float)
            gray = p[..., 0] if n == 1 else p[..., 0] * 0.114 + p[..., 1] * 0.587 + p[..., 2] * 0.299
            for at in range(0, h, 256):
                part = gray[at : at + 256]
                yield pd.DataFrame({"page_id": page, "y": np.arange(at, at + len(part)), "gray": list(part)})


def scanlines(pages: DataFrame) -> DataFrame:
    """One row per image row with its gray values; blocks of 256 rows leave the task at a time."""
    return pages.select("page_id", "height", "width", "nChannels", "data").mapInPandas(_rows_of, "page_id long, y int, gray array<double>")


def pixels_of(lines: DataFrame) -> DataFrame:
    return lines.select("page_id", "y", F.posexplode("gray").alias("x", "v"))


def read_panel_json(spark: SparkSession, path: str) -> DataFrame:
    """Panels of panel files, one row per panel."""
    flat = spark.read.schema(PANELS).option("multiLine", True).json(path).select("image_path", F.explode("panels").alias("p"))
    return flat.select("image_path", F.col("p.index").alias("rect_id"), "p.x", "p.y", F.col("p.width").alias("w"), F.col("p.height").alias("h"))


def write_panel_json(rects: DataFrame, path: str, width: int, height: int, parameters: dict[str, str | float | list] | None = None) -> None:
    """One record for each image_path, panels numbered from 1 in the order of rect_id; parameters: the detection's settings."""
    panel = F.struct(F.col("rect_id").cast("int").alias("index"), *[F.round(a).cast("int").alias(b) for a, b in (("x", "x"), ("y", "y"), ("w", "width"), ("h", "height"))])
    files = rects.groupBy("image_path").agg(F.array_sort(F.collect_list(panel)).alias("p"))
    numbered = F.transform("p", lambda p, i: p.withField("index", (i + 1).cast("int")))
    size = F.struct(F.lit(width).alias("width"), F.lit(height).alias("height"))
    values = {k: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v) for k, v in (parameters or {}).items()}
    settings = [F.struct(*[v.alias(k) for k, v in values.items()]).alias("parameters")] if values else []
    files.select("image_path", size.alias("image_size"), F.size("p").alias("num_panels"), *settings, numbered.alias("panels")).write.mode("overwrite").json(path)


def report_lines(rects: DataFrame, scale: float) -> DataFrame:
    """Text lines of each page: the count, then each panel in pixels and points."""
    one = F.format_string("panel %d px=(%d,%d,%d,%d) pt=(%.2f,%.2f,%.2f,%.2f)", F.col("rect_id").cast("int"), *[F.round(F.col(c) * scale).cast("int") for c in "xywh"], *[F.col(c).cast("double") for c in "xywh"])
    pages = rects.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("rect_id", one.alias("line")))).alias("l"))
    head = F.format_string("panel_count=%d", F.size("l"))
    return pages.select("page_id", F.array_join(F.concat(F.array(head), F.col("l.line")), "\n").alias("value"))


def write_report(rects: DataFrame, path: str, scale: float) -> None:
    report_lines(rects, scale).write.mode("overwrite").partitionBy("page_id").text(path)


def write_decisions(decisions: DataFrame, path: str) -> None:
    """Decision or metric rows, one JSON object for each."""
    decisions.write.mode("overwrite").json(path)
