"""Packing into length buckets that a dynamic program chooses from the exact global histogram."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, positions
from .mixing import word_count


def length_histogram(sized: DataFrame) -> np.ndarray:
    """(rows, sum of lengths, length) for each distinct length, in order of length.

    Distinct lengths number at most the square root of twice the table's words, so the driver
    can hold them: 100,000 of them need 5 billion words.
    """
    got = sized.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").toArrow()
    length, n = (got.column(c).to_numpy().astype(np.int64) for c in ("length", "n"))
    return np.stack([n, n * length, length], 1)


def choose_buckets(hist: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds, at most `buckets`, for which padding every row to its bound costs least.

    A bucket that ends at bin j and begins after bin i costs top[j] * (rows[j] - rows[i]) less the
    words between. For one j that is a choice among lines in top[j], one for each i, whose slopes
    -rows[i] fall while top[j] grows: the lower hull of the lines gives each j its i in constant
    time on average. All numbers are whole, so the program is exact.
    """
    m = len(hist)
    if not m:
        return []
    rows, words = ([0, *np.cumsum(hist[:, k]).tolist()] for k in (0, 1))
    top = hist[:, 2].tolist()
    k = min(buckets, m)
    best: list = [0, *[None] * m]
    choice = np.zeros((k, m + 1), np.int32)
    for b in range(k):
        nxt: list = [0, *[None] * m]
        hull: list[int] = []
        height: list[int] = []
        at = 0
        for j in range(1, m + 1):
            if best[j - 1] is not None:
                i, h = j - 1, best[j - 1] + words[j - 1]
                # the last line is never alone the lowest if the new one passes it before it passes the one below
                while len(hull) > 1 and (h - height[-2]) * (rows[hull[-1]] - rows[hull[-2]]) <= (height[-1] - height[-2]) * (rows[i] - rows[hull[-2]]):
                    hull.pop()
                    height.pop()
                hull.append(i)
                height.append(h)
                at = min(at, len(hull) - 1)
            x = top[j - 1]
            while at + 1 < len(hull) and height[at + 1] - x * rows[hull[at + 1]] < height[at] - x * rows[hull[at]]:
                at += 1
            nxt[j] = height[at] - x * rows[hull[at]] + x * rows[j] - words[j]
            choice[b, j] = hull[at]
        best = nxt
    bounds, j = [], m
    for b in range(k - 1, -1, -1):
        if j == 0:
            break
        bounds.append(top[j - 1])
        j = int(choice[b, j])
    return bounds[::-1]


def pack(docs: DataFrame, buckets: int = 12, batch_words: int = 16_384, seed: int = 11) -> DataFrame:
    """Batches of rows of similar length: rows x padded length stays within batch_words.

    docs needs doc_id and text. Returns doc_id, length (words), bucket (from 0), padded_length
    (its bound), padding, batch (in its bucket, from 0) and slot (in its batch, from 0). Inside a
    bucket, rows stand in seeded order. A row longer than batch_words is a batch of its own.

    Defined cases: null and empty texts have length 0; repeated rows are packed each for itself;
    null ids are packed as well; other columns are not looked at; an empty table gives no rows.
    """
    # written: words are counted once, not in each of the passes below
    sized = keep(docs.select("doc_id", word_count("text").alias("length")), "pack-lengths")
    bounds = choose_buckets(length_histogram(sized), buckets)
    limits = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(0).cast("long"))
    sized = sized.withColumn("bucket", F.size(F.filter(limits, lambda b: b < F.col("length"))))
    placed = positions(sized, [F.col("bucket"), F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id"), F.col("length")], "pack")
    first = placed.groupBy("bucket").agg(F.min("_pos").alias("_first"))
    placed = placed.join(F.broadcast(first), "bucket").withColumn("_at", F.col("_pos") - F.col("_first"))
    padded = F.element_at(limits, F.col("bucket") + 1)
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(batch_words) / F.greatest(padded, F.lit(1).cast("long"))))
    out = placed.withColumn("padded_length", padded).withColumn("_room", room)
    return out.select(
        "doc_id", "length", "bucket", "padded_length", (F.col("padded_length") - F.col("length")).alias("padding"),
        F.floor(F.col("_at") / F.col("_room")).alias("batch"), (F.col("_at") % F.col("_room")).cast("int").alias("slot"),
    )
