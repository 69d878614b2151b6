"""Streaming twins of the library jobs over action streams (event_id, ts, page_id, action, value)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagegrid.operators import detection, pages
from pagegrid.operators.corrections import CorrectionStore
from pagegrid.operators.library import latest_by_page
from pagegrid.sources.files import numbered_pages

IMAGE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def latest_tasks(actions: DataFrame) -> DataFrame:
    """Keyed state of the last action of each page; update or complete mode."""
    return latest_by_page(actions)


def open_tasks(actions: DataFrame) -> DataFrame:
    """Pages whose last task command is a request: a later cancel takes it back."""
    return latest_by_page(actions.filter(F.col("action").isin("request", "cancel"))).filter("action = 'request'")


def corrections_state(actions: DataFrame) -> DataFrame:
    """Pages with a live correction: the last upsert or revert decides."""
    return latest_by_page(actions.filter(F.col("action").isin("upsert", "revert"))).filter("action = 'upsert'")


def detection_metrics(actions: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts and mean value per action and window; rows later than `late` are dropped."""
    by = actions.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "action")
    return by.agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select("w.start", "w.end", "action", "n", "mean_value")


def _results(spark: SparkSession, out: str, config_hash: str) -> DataFrame | None:
    """Pages (page_id, run) that have results under a hash; only its folder is listed."""
    try:
        return spark.read.schema("page_id long, run string").parquet(f"{out}/config_hash={config_hash}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # the hash's first batch


def detect_stream(pages: DataFrame, detect: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, config_hash: str) -> StreamingQuery:
    """Runs detect on new pages; results go to {out}/config_hash=.../run=..., a run being one batch of one checkpoint.

    Each hash keeps its own progress under `checkpoint`, so a new configuration sees all pages again. A
    batch that is run again replaces its own results and no others, and pages that have results under
    the hash, from whatever checkpoint, are left out.
    """
    spark = pages.sparkSession
    source = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def batch(df: DataFrame, number: int) -> None:
        run = f"{source}-{number}"
        done = _results(spark, out, config_hash)
        todo = df if done is None else df.join(done.filter(F.col("run") != run).select("page_id").distinct(), "page_id", "left_anti")
        detect(todo).write.mode("overwrite").parquet(f"{out}/config_hash={config_hash}/run={run}")

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/{config_hash}").trigger(availableNow=True).start()


def stream_images(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Images as they are dropped into a folder, with their page number; unreadable ones are left out.

    A file without a number is known by a hash of where it lies.
    """
    raw = spark.readStream.format("image").schema(IMAGE).option("maxFilesPerTrigger", files_at_once).load(folder).select("image.*")
    return numbered_pages(raw.filter("nChannels > 0")).withColumn("page_id", F.coalesce("page_id", F.xxhash64("origin")))


def detect_images(spark: SparkSession, folder: str, out: str, checkpoint: str, **config) -> StreamingQuery:
    """Detects the panels of every image in a folder once, and of those that come later once; config: detect()'s parameters.

    Results (detect()'s rows) lie under the configuration's hash, see detect_stream.
    """
    found = lambda images: detection.detect(pages.from_images(images).drop("factor"), **config)
    name = hashlib.sha256(repr(sorted(config.items())).encode()).hexdigest()[:16]
    return detect_stream(stream_images(spark, folder), found, out, checkpoint, name)


def save_edits(edits: DataFrame, store: CorrectionStore, checkpoint: str) -> StreamingQuery:
    """Appends a stream of edits (path, page, panels, at, seq, deleted) to a store; a batch that is run again replaces itself."""
    source = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def batch(df: DataFrame, number: int) -> None:
        store.save(df.filter("not deleted").drop("deleted"), f"{source}-{number}-saved")
        store.delete(df.filter("deleted").drop("deleted"), f"{source}-{number}-deleted")

    return edits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
