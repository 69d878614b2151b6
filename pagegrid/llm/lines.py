"""Line dedup with levelled sorted runs of line hashes. DataFrame functions only.

Documents arrive in batches, those with the largest ids first. The hashes of a batch's lines are
merge-anti-joined with the runs so far: a hash that no run holds is fresh, and as all later ids
are smaller, the largest id of the batch that has it is its keeper for good. A hash that was met
before only brings its count. Each batch adds a run of its own, in buckets sorted by hash; when a level
holds `fanout` runs they are merged into one run of the next level, so a hash is rewritten once a level.
Runs are merged where they lie: only the new batch is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (
    BLANKS,
    NO_ID,
    ascii_lower,
    boxed,
    content_key,
    drop,
    keep,
    keep_sorted,
    ordered_buckets,
    partitions,
    skewed_lookup,
    unboxed,
)

HASH = ["h1", "h2"]
#: Spark writes no table with more buckets, unless told so.
MOST_BUCKETS = 100_000


class LineRuns:
    """The runs of one corpus in the shared folder: (h1, h2, docs, keeper), keeper null unless fresh.

    A run is a table in buckets by hash, each sorted by it, and all runs have the same buckets. A
    batch is shuffled to them once and then merged with every run as it lies.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets or min(partitions(spark), MOST_BUCKETS)
        self.levels: list[list[DataFrame]] = []

    def _all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    @staticmethod
    def _both(a: DataFrame, b: DataFrame) -> DataFrame:
        """Rows of one hash in two runs add up; one of them at most names the keeper."""
        b = b.select(*HASH, F.col("docs").alias("_docs"), F.col("keeper").alias("_keeper"))
        docs = F.coalesce("docs", F.lit(0)) + F.coalesce("_docs", F.lit(0))
        return a.join(b.hint("merge"), HASH, "full").select(*HASH, docs.alias("docs"), F.coalesce("keeper", "_keeper").alias("keeper"))

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        return reduce(self._both, runs)

    def _kept(self, run: DataFrame) -> DataFrame:
        with ordered_buckets(self.spark):
            return keep_sorted(run, "line-run", HASH, self.buckets)

    def counted(self, batch: DataFrame) -> DataFrame:
        """The batch's hashes beside the runs so far: those that no run holds keep their keeper."""
        found = batch.distinct().repartition(self.buckets, *HASH) if self.buckets != partitions(self.spark) else batch.distinct()
        found = found.groupBy(*HASH).agg(F.count("*").alias("docs"), F.max("id").alias("keeper"))
        for run in self._all():
            # the anti-join and its complement in one pass: who finds a partner is not fresh
            known = run.select(*HASH, F.lit(True).alias("known"))
            found = found.join(known.hint("merge"), HASH, "left").select(*HASH, "docs", F.when(F.col("known").isNull(), F.col("keeper")).alias("keeper"))
        return found

    def add(self, batch: DataFrame) -> DataFrame:
        """batch: (h1, h2, id), ids below those of all batches before. Returns its run."""
        run = self._kept(self.counted(batch))
        self._push(0, run)
        return run

    def _push(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._kept(self._merged(old)))
            drop(*old)

    def totals(self) -> DataFrame:
        """One row per line hash: docs and keeper over all batches."""
        return self._merged(self._all())

    def remove(self) -> None:
        drop(*self._all())


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, rk, hashes): per line a pair of 64-bit hashes of its key, or null for short keys."""
    trimmed = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))
    lowered = F.transform(trimmed, lambda x: F.when(F.char_length(x) >= min_chars, ascii_lower(x)))
    pairs = F.transform(lowered, lambda x: F.when(x.isNotNull(), F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"))))
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), content_key(docs).alias("rk"), pairs.alias("hashes"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int | None = None, fanout: int = 2, batch_rows: int = 50_000_000) -> DataFrame:
    """Drop frequent lines everywhere except in the largest doc_id that holds them.

    docs needs doc_id and text. A line's key is the line without blanks at its ends, A-Z
    lower-cased. Keys of at least min_chars code points that are in at least min_docs documents
    lose all their lines but those of the largest doc_id. Returns the columns of docs, with text
    replaced by the lines that stay (joined by newline), and n_lines, n_dropped, kept_text (the
    same as text, but never null). The result does not depend on batches, which are cut at about
    equal shares of the rows: four, or as many as keep them near batch_rows.

    Defined cases: a null or empty text is one empty line, and a null text stays null. Rows
    with one doc_id count as one document, and rows with a null doc_id together as one document
    below all others. Repeated rows each get their row. Long texts and lines are hashed whole.
    Input columns named n_lines, n_dropped or kept_text are replaced; others may have any name. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    batches = batches or max(4, -(-docs.count() // batch_rows))
    shares = [k / batches for k in range(1, batches)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] if shares else []
    above = sum((F.when(F.col("id") < c, 1).otherwise(0) for c in sorted(set(cuts or []))), F.lit(0))
    hashed = keep(line_hashes(docs, min_chars).withColumn("batch", above.cast("int")), "line-hashes", ["batch"])
    runs = LineRuns(spark, fanout)
    for b in range(len(set(cuts or [])) + 1):
        part = hashed.filter(F.col("batch") == b).select("id", F.explode(F.array_distinct("hashes")).alias("h")).filter("h is not null")
        runs.add(part.select("h.h1", "h.h2", "id"))
    with ordered_buckets(spark):
        frequent = keep(runs.totals().filter(F.col("docs") >= min_docs), "line-frequent")
    runs.remove()
    lines = hashed.select("id", "rk", F.posexplode("hashes").alias("at", "h")).filter("h is not null").select("id", "rk", "at", "h.h1", "h.h2")
    gone = skewed_lookup(lines, frequent, HASH, "docs").filter("id < keeper")
    per_doc = keep(gone.groupBy("id", "rk").agg(F.collect_set("at").alias("gone")), "line-gone")
    drop(frequent, hashed)
    keyed = boxed(docs, ("text",), id=F.coalesce("doc_id", F.lit(NO_ID)), rk=content_key(docs), text=F.col("text"))
    out = keyed.join(per_doc, ["id", "rk"], "left").withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    out = out.withColumn("kept", kept)
    return unboxed(
        out, docs.columns, text=F.when(F.col("text").isNotNull(), F.col("kept")), n_lines=F.size("lines").cast("long"),
        n_dropped=F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long"), kept_text=F.col("kept"),
    )
