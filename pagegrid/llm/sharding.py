"""Uniform sharding by a two-pass external shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import boxed, content_key, drop, keep, new_path, quoted, unboxed


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of 0..n-1: from the end, each place swaps with one at or before it."""
    order = list(range(n))
    picks = rng.integers(0, np.arange(n, 1, -1)) if n > 1 else []
    for i, j in zip(range(n - 1, 0, -1), picks, strict=True):
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def _starts(counts: DataFrame, block: int = 4096) -> DataFrame:
    """(_bucket, _start) from (_bucket, _rows): sums over blocks of buckets first, then inside each block."""
    counts = counts.withColumn("_block", F.floor(F.col("_bucket") / block))
    before = lambda *by: Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_block").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("_block").agg(F.sum("_rows").alias("_rows")).select("_block", F.coalesce(F.sum("_rows").over(before()), F.lit(0)).alias("_base"))
    return counts.join(blocks, "_block").select("_bucket", (F.col("_base") + F.coalesce(F.sum("_rows").over(inside), F.lit(0))).alias("_start"))


def shuffle_to_shards(docs: DataFrame, shards: int = 24, bucket_bytes: int = 32 << 20, seed: int = 5, path: str | None = None) -> DataFrame:
    """Write docs as `shards` Parquet folders whose rows are a uniform permutation of all rows.

    Pass one scatters the rows by a seeded hash of doc_id and content into buckets of about
    bucket_bytes; each bucket is a task of its own, so tasks grow in number and not in size. Pass
    two brings each bucket into an order that depends on its rows only, gives it a seeded
    Fisher-Yates shuffle and cuts the row sequence, bucket after bucket, into shards whose row
    counts differ by one at most (the law `rows`). Returns the written rows: the columns of docs,
    shard and slot (gapless from 0 in each shard).

    Bucket sizes follow from the rows' digests, so offsets cost a scan and a table with one row for
    each bucket, which travels to the bucket as a row of its own. A lost executor repeats its tasks with the
    same result. Where copies of one row would overfill a bucket (the scan shows it), they are
    dealt out by a salt, and the salted table is written first.

    Defined cases: null ids and null texts are kept, repeated rows stay, texts longer than a bucket
    have a bucket nearly to themselves, input columns named shard or slot are replaced and others
    may have any name, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    columns = docs.columns
    rows = boxed(docs, _id=F.col("doc_id"), _tie=content_key(docs), _bytes=F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8)
    stats = rows.agg(F.sum("_bytes").alias("b"), F.count("*").alias("n")).first()
    n, total = stats["n"], stats["b"] or 0
    buckets = max(shards, -(-total // bucket_bytes))

    def sizes(frame: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64(F.lit(seed), "_id", "_tie", *(["_salt"] if "_salt" in frame.columns else [])), F.lit(buckets)).cast("int")
        return frame.withColumn("_bucket", bucket)

    counted = keep(sizes(rows).groupBy("_bucket", "_id", "_tie").agg(F.count("*").alias("_copies"), F.sum("_bytes").alias("_size")), "shard-sizes")
    if counted.filter((F.col("_copies") > 1) & (F.col("_size") > bucket_bytes)).take(1):
        rows = keep(rows.withColumn("_salt", F.monotonically_increasing_id()), "shard-rows")
        counts = sizes(rows).groupBy("_bucket").agg(F.count("*").alias("_rows"))
    else:
        counts = counted.groupBy("_bucket").agg(F.sum("_copies").alias("_rows"))
    scattered = sizes(rows).select("_bucket", "_id", "_tie", "_row", F.lit(None).cast("long").alias("_start"))
    schema = scattered.select("_row", F.lit(0).cast("long").alias("_pos")).schema
    starts = _starts(counts).select(F.col("_bucket").cast("int").alias("_bucket"), "_start")

    def shuffled(batches):
        batches = [x for x in batches if x.num_rows]
        table = pa.Table.from_batches(batches) if batches else None
        for bucket in pc.unique(table["_bucket"]).to_pylist() if batches else []:
            part = table.filter(pc.equal(table["_bucket"], bucket))
            is_start = part["_start"].is_valid()
            start = part.filter(is_start)["_start"][0].as_py()
            part = part.filter(pc.invert(is_start)).select(["_id", "_tie", "_row"])
            m = part.num_rows
            by = part.select(["_id", "_tie"]).append_column("_at", pa.array(np.arange(m))).sort_by([("_id", "ascending"), ("_tie", "ascending")])["_at"]
            mixed = by.take(pa.array(fisher_yates(m, np.random.default_rng([seed, bucket]))))
            yield from part.select(["_row"]).take(mixed).append_column("_pos", pa.array(start + np.arange(m, dtype=np.int64))).to_batches()

    # a bucket's number is its partition's, so no two buckets meet in a task
    both = scattered.unionByName(starts, allowMissingColumns=True).repartitionById(buckets, F.col("_bucket"))
    placed = both.mapInArrow(shuffled, schema)
    shard = F.expr(f"(_pos * {shards}) div {max(n, 1)}").cast("int")
    first = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    placed = placed.withColumn("shard", shard).withColumn("slot", (F.col("_pos") - first).cast("long"))
    placed = unboxed(placed, columns, shard=F.col("shard"), slot=F.col("slot"))
    path = path or new_path(spark, "shards")
    placed.write.partitionBy("shard").parquet(path)
    drop(counted, rows)
    return spark.read.schema(placed.schema).parquet(path).select(*[quoted(c) for c in columns], "shard", "slot")
