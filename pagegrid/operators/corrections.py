"""A store of corrected panels as a folder of versioned rows: edits and deletions are appended, reads merge them.

Nothing is changed in place, so writers don't wait for each other: each writes a run of its own, and
of a page's versions the last one counts, by its time and then its number, whichever run brought it.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrid.operators.library import correction_key

BOXES = "array<struct<x:double,y:double,w:double,h:double>>"
ROW = f"key string, path string, page int, at timestamp, seq long, deleted boolean, page_width double, page_height double, panels {BOXES}"
VERSION = ["at", "seq"]


class CorrectionStore:
    """Corrections under `folder`, which all executors must see.

    Pages are told apart by (path, page). A saved list may be empty: the page then has no panels,
    which is not the same as having no correction.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _append(self, rows: DataFrame, deleted: bool, run: str | None) -> str:
        run = run or uuid.uuid4().hex
        empty = {"page_width": F.lit(None).cast("double"), "page_height": F.lit(None).cast("double"), "panels": F.array().cast(BOXES), "at": F.current_timestamp(), "seq": F.lit(0).cast("long")}
        given = rows.withColumns({c: v for c, v in empty.items() if c not in rows.columns})
        given = given.withColumns({"deleted": F.lit(deleted), "key": correction_key(F.col("path"), F.col("page")), "panels": F.coalesce("panels", F.array().cast(BOXES))})
        # a run that is written again replaces itself
        given.selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in ROW.split(", ")]).write.mode("overwrite").parquet(f"{self.folder}/run={run}")
        return run

    def save(self, edits: DataFrame, run: str | None = None) -> str:
        """Append edits: path, page, panels, and if given page_width, page_height, at (time of the edit) and seq."""
        return self._append(edits, False, run)

    def delete(self, pages: DataFrame, run: str | None = None) -> str:
        """Append a deletion for each (path, page): what was saved before `at` no longer counts."""
        return self._append(pages.drop("panels"), True, run)

    def history(self) -> DataFrame:
        """Every version that was ever written; a store nobody wrote to has none."""
        try:
            return self.spark.read.option("basePath", self.folder).schema(ROW + ", run string").parquet(f"{self.folder}/run=*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], ROW + ", run string")

    def load(self) -> DataFrame:
        """The last version of each page that is not a deletion: key, path, page, at, seq, page_width, page_height, panels.

        Of two versions with one time and number a deletion counts, then the larger list.
        """
        names = ["path", "page", "at", "seq", "page_width", "page_height", "panels"]
        order = F.struct(*VERSION, "deleted", "panels")
        last = self.history().groupBy("key").agg(F.max_by(F.struct("deleted", *names), order).alias("v")).filter("not v.deleted")
        return last.select("key", *[f"v.{c}" for c in names])

    def exists(self, pages: DataFrame) -> DataFrame:
        """Those of pages (path, page, ...) that have a correction."""
        keyed = pages.withColumn("_key", correction_key(F.col("path"), F.col("page")))
        return keyed.join(self.load().select(F.col("key").alias("_key")), "_key", "left_semi").drop("_key")

    def for_pages(self, pages: DataFrame) -> DataFrame:
        """(page_id, boxes) of pages (page_id, path, page, width, height) with a correction, as detect() takes them.

        Lists saved at another size are scaled to the page's.
        """
        keyed = pages.select("page_id", "width", "height", correction_key(F.col("path"), F.col("page")).alias("key"))
        both = keyed.join(self.load(), "key")
        fx, fy = F.coalesce(F.col("width") / F.col("page_width"), F.lit(1.0)), F.coalesce(F.col("height") / F.col("page_height"), F.lit(1.0))
        scaled = F.transform("panels", lambda b: F.struct((b["x"] * fx).alias("x"), (b["y"] * fy).alias("y"), (b["w"] * fx).alias("w"), (b["h"] * fy).alias("h")))
        return both.select("page_id", scaled.alias("boxes"))

    def compact(self, folder: str) -> CorrectionStore:
        """A new store with the live versions only."""
        self.load().withColumns({"deleted": F.lit(False)}).select(*[c.split()[0] for c in ROW.split(", ")]).write.parquet(f"{folder.rstrip('/')}/run=compact-{uuid.uuid4().hex}")
        return CorrectionStore(self.spark, folder)
