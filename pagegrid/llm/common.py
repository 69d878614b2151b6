"""Shared pieces: the shared folder, written intermediates, skew-aware lookups, global positions."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space as the contracts define it: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a missing id where ids are compared: below every real id.
NO_ID = -(2**63)
BUCKET_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only a local master may go without it; there the machine's own temp folder is shared by
    definition.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="pagegrid-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pagegrid/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, partition_by: list[str] | None = None, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    Nothing reads the shuffles of a finished write again, so Spark may delete their files at its end.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._pagegrid_path = path  # type: ignore[attr-defined]
    return out


def keep_sorted(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """Like keep(), as a table in the shared folder whose buckets by `keys` are sorted by them.

    Tables of equal bucket counts join each other, and rows shuffled to as many partitions, without
    being shuffled again; with ordered_buckets() they need no sort either.
    """
    spark = df.sparkSession
    path, table = new_path(spark, name), f"pagegrid_{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.format("parquet").option("compression", "snappy").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.table(table)
    out._pagegrid_path, out._pagegrid_table = path, table  # type: ignore[attr-defined]
    return out


@contextmanager
def ordered_buckets(spark: SparkSession):
    """Plans made inside trust the order of tables that have one file a bucket, as keep_sorted() writes them."""
    before = spark.conf.get(BUCKET_ORDER, "false")
    spark.conf.set(BUCKET_ORDER, "true")
    try:
        yield
    finally:
        spark.conf.set(BUCKET_ORDER, before)


def drop(*dfs: DataFrame) -> None:
    """Delete what keep() wrote, once nothing lazy depends on it any more."""
    for df in dfs:
        if table := getattr(df, "_pagegrid_table", None):
            df.sparkSession.sql(f"drop table if exists {table}")
        if path := getattr(df, "_pagegrid_path", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; lower() is the fast path where a string is pure ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def row_key(*cols: str) -> Column:
    """Tells rows that share an id apart by their content."""
    return F.xxhash64(*[F.col(c) for c in cols])


def content_key(df: DataFrame) -> Column:
    """A digest of a whole row but for its maps, which Spark can't hash."""
    return F.xxhash64(*[F.col(quoted(f.name)) for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def boxed(df: DataFrame, but: tuple[str, ...] = (), **named: Column) -> DataFrame:
    """df's columns as one struct `_row` beside the named ones, so that no name can clash.

    Columns in `but` stay out of the struct: those that a named one carries already, such as a text.
    """
    kept = [F.col(quoted(c)) for c in df.columns if c not in but]
    return df.select((F.struct(*kept) if kept else F.lit(None)).alias("_row"), *[c.alias(n) for n, c in named.items()])


def unboxed(df: DataFrame, columns: list[str], **named: Column) -> DataFrame:
    """The columns kept by boxed(), those of `named` replaced (in place) or added after them."""
    kept = [named[c].alias(c) if c in named else F.col(f"_row.{quoted(c)}").alias(c) for c in columns]
    return df.select(*kept, *[c.alias(n) for n, c in named.items() if n not in columns])


def key_equal(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def skewed_lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "inner", hot: int = 1000) -> DataFrame:
    """Join rows to a keyed table when a few keys may hold a large share of the rows.

    table has one row per key and in column `weight` how many rows hold that key. Keys with at
    least 1/hot of all rows number at most `hot`, so the driver may know them: rows with one of
    their values in the last of `keys` (a selective one, such as a digest) take a broadcast join,
    all others the shuffled one. A filter parts them, and no row meets both joins. keys must not
    be null in rows that should match. how: inner or left.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    least = max(int(total) // hot, 1)
    values = sorted({r[0] for r in table.filter(F.col(weight) > least).select(keys[-1]).take(hot)})
    table = table.drop(weight)
    if not values:
        return rows.join(table, keys, how)
    is_hot = F.coalesce(F.col(keys[-1]).isin(values), F.lit(False))
    near = rows.filter(is_hot).join(F.broadcast(table.filter(is_hot)), keys, how)
    return near.unionByName(rows.filter(~is_hot).join(table.filter(~is_hot), keys, how))


def small_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", most: int = 20_000) -> DataFrame:
    """Null-safe join to a table that is broadcast only if it has at most `most` rows."""
    table = table.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in table.columns if c not in keys])
    if len(table.take(most + 1)) <= most:
        table = F.broadcast(table)
    on = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(table[f"_k{i}"]) for i, k in enumerate(keys)])
    return rows.join(table, on, how).drop(*[f"_k{i}" for i in range(len(keys))])


def positions(df: DataFrame, order: list[Column], name: str, tie: list[Column] | None = None) -> DataFrame:
    """df with `_pos`, the row's place (from 0) in the total order, without a one-task sort.

    Rows are range-partitioned and sorted, numbered inside their partition, and moved up by the
    rows of the partitions before. The table of offsets has one row per partition.
    """
    spark = df.sparkSession
    n = partitions(spark)
    cols = [*order, *(tie or [])]
    ranged = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_mid", F.monotonically_increasing_id())
    kept = keep(ranged, name)
    pid = F.shiftright(F.col("_mid"), 33)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept.groupBy(pid.alias("_pid")).agg(F.count("*").alias("_n")).select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = kept.join(F.broadcast(offsets), pid == F.col("_pid"))
    return out.withColumn("_pos", F.col("_off") + F.col("_mid").bitwiseAND(2**33 - 1)).drop("_mid", "_pid", "_off")
