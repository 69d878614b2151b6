"""Language ID by rank-order profiles of character n-grams and their out-of-place distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Profiles that reach the driver: at most this many languages of `ranks` n-grams each.
MOST_LANGUAGES = 2000


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text with every run of other characters as one 0, and 0 at both ends."""
    cp = np.frombuffer(("\0" + text.lower() + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.flatnonzero(np.bincount(cp))
    letter = np.zeros(int(seen[-1]) + 1, bool)
    letter[seen] = [chr(c).isalpha() for c in seen]
    is_letter = letter[cp]
    stay = is_letter.copy()
    stay[0] = True
    stay[1:] |= is_letter[:-1]
    return np.where(is_letter, cp, 0)[stay].astype(np.int64)


def ngrams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1- to 3-grams with counts; a gram may start or end with the gap, not hold it inside."""
    a, b, c = codes, codes[1:], codes[2:]
    two = (a[:-1] << 21) | b
    three = (a[:-2] << 42) | (b[:-1] << 21) | c
    return np.unique(np.concatenate([a[a > 0], two[(a[:-1] | b) > 0], three[b[:-1] > 0]]), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, ranks: int) -> np.ndarray:
    """The most frequent grams, ties by code."""
    if len(grams) > ranks:
        least = np.partition(counts, len(counts) - ranks)[len(counts) - ranks]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))][:ranks]


def gram_counts(batches):
    """Per partition the n-gram counts of each language."""
    total: dict[str, list] = {}

    def merged(parts):
        g, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return g, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            if text.is_valid and len(codes := letters_of(text.as_py())) > 2:
                parts = total.setdefault(lang.as_py(), [])
                parts.append(ngrams(codes))
                if len(parts) >= 400:
                    total[lang.as_py()] = [merged(parts)]
    for lang, parts in total.items():
        g, n = merged(parts)
        yield pa.record_batch([pa.array([lang] * len(g)), pa.array(g), pa.array(n)], names=["lang", "gram", "n"])


def learn_profiles(labelled: DataFrame, ranks: int = 300) -> dict[str, list[int]]:
    """lang -> its most frequent n-grams in order, from all rows of labelled (text, lang)."""
    counts = labelled.filter("lang is not null and text is not null").select("lang", "text").mapInArrow(gram_counts, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= ranks)
    got = top.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "gram"))), lambda x: x["gram"]).alias("grams")).take(MOST_LANGUAGES + 1)
    if len(got) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return {r["lang"]: list(r["grams"]) for r in got}


def guesses(batches, profiles: dict[str, list[int]], ranks: int):
    langs = sorted(profiles)
    tables = []
    for lang in langs:
        grams = np.array(profiles[lang], np.int64)
        order = np.argsort(grams)
        tables.append((grams[order], order))
    for batch in batches:
        pred, score = [], []
        for text in batch.column("text"):
            codes = letters_of(text.as_py()) if text.is_valid else ()
            if len(codes) <= 2:
                pred.append("und")
                score.append(0.0)
                continue
            top = ranked(*ngrams(codes), ranks)
            place = np.arange(len(top))
            best, least = "und", None
            for lang, (grams, rank) in zip(langs, tables, strict=True):
                at = np.minimum(np.searchsorted(grams, top), len(grams) - 1)
                away = int(np.where(grams[at] == top, np.abs(rank[at] - place), ranks).sum())
                if least is None or away < least:
                    best, least = lang, away
            pred.append(best)
            score.append(0.0 if least is None else 1.0 - least / (len(top) * ranks))
        yield pa.record_batch([*[batch.column(c) for c in batch.schema.names], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning; one with a null id is not held out (nor learned from by op9's filter)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, labelled: DataFrame | None = None, ranks: int = 300) -> DataFrame:
    """docs (with a column text) plus lang_pred and score (0 to 1, 1 is a profile's own order).

    Profiles are learned from all rows of labelled (text, lang). A text's `ranks` most frequent
    1- to 3-grams of lower-cased letters are compared with each profile: a gram costs the
    difference of its places, or `ranks` where the profile lacks it. The least sum wins, ties by
    language code.

    Defined cases: null texts and texts without letters are `und` with score 0, and so is every
    text if nothing was labelled; input columns named lang_pred or score are replaced; repeated
    rows each get their row; long texts are counted whole; an empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score")
    profiles = learn_profiles(docs if labelled is None else labelled, ranks)
    schema = docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return docs.mapInArrow(lambda it: guesses(it, profiles, ranks), schema)
