"""A corpus pipeline: language ID, line dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but
the last return the columns of docs, in their order and under any names, beside the columns that
the stage needs. No stage looks at a part of a text only, and an empty table gives no rows. Stages
but the last keep repeated rows as rows of their own where not said otherwise. A stage boxes a row's
columns first, so that their names meet none of an operator's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrid.llm import common, langid, lines, minhash, mixing, packing

#: Stages with a seed or learned model decide the rows, which SQL can't express.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; those without letters (`und`) go.

    Profiles are learned from the labelled rows of docs. lang of an unlabelled row is set to the
    prediction; a given label stays. Null and empty texts are `und` and go, as does every row
    where no row is labelled; ties go to the smaller language code. A null doc_id, source or n_chars
    stays as it is.
    """
    rows = common.boxed(docs, ("text", "lang"), text=F.col("text"), lang=F.col("lang"))
    found = langid.identify(rows, rows.select("text", "lang")).filter("lang_pred <> 'und'")
    return common.unboxed(found, docs.columns, text=F.col("text"), lang=F.coalesce("lang", "lang_pred"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines go everywhere but in the largest doc_id; documents stay, n_chars is set anew.

    A null text stays null, with a null n_chars; a text that loses all its lines is empty. Rows
    with one doc_id count as one document, and rows with a null doc_id as one below all others.
    """
    out = lines.dedup_lines(common.boxed(docs, ("text", "doc_id"), doc_id=F.col("doc_id"), text=F.col("text")))
    return common.unboxed(out, docs.columns, doc_id=F.col("doc_id"), text=F.col("text"), n_chars=F.char_length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id.

    Texts without words have no copies and stay, and so do rows with a null doc_id. Rows that share
    a doc_id are one document: all of them stay or go.
    """
    gone = minhash.near_duplicates(docs.select("doc_id", "text")).filter("not kept").select("doc_id").distinct()
    return common.unboxed(common.boxed(docs, ("doc_id",), doc_id=F.col("doc_id")).join(gone, "doc_id", "left_anti"), docs.columns, doc_id=F.col("doc_id"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources near their target words: a row for each copy taken, cut to its blocks where partial.

    Texts without words are never taken. A null source is a source of its own, the last one.
    Repeated rows are taken each for itself; a copy keeps all other columns of its row.
    """
    return mixing.mix_documents(docs)


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of rows of similar length: doc_id, length, bucket, padded_length, padding, batch, slot.

    A null text has length 0; a text longer than a batch is a batch of its own; rows with one or no
    doc_id are packed each for itself.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("length_packing", length_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.keep(stage(spark, docs, sf_dir), name)
        common.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
