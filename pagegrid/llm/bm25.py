"""Exact BM25 top-k with block-max WAND pruning, per shard, merged with global statistics."""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import boxed, drop, keep, quoted
from .kernels import Rolling, bytes_of, ids_of, lower_table, spans

#: A segment is closed at this many bytes of text, documents or postings.
SEGMENT, SEGMENT_DOCS, SEGMENT_POSTINGS = 12 << 20, 1 << 16, 1 << 21
#: Documents whose postings of a term share one upper bound.
BLOCK = 64
#: Queries are searched together up to so many terms, and up to so many pairs of a query and a document of a segment.
ASKED_TERMS, CELLS = 1 << 20, 1 << 20
ROUND = 6
INDEX = "part int, seq int, size long, terms binary, starts binary, docs binary, counts binary, ids binary, lengths binary"


def term_gap() -> np.ndarray:
    """Bytes outside terms: ASCII other than letters and digits."""
    gap = np.ones(256, bool)
    gap[0x80:] = gap[0x30:0x3A] = gap[0x41:0x5B] = gap[0x61:0x7B] = False
    return gap


def terms_of(buf: np.ndarray, offs: np.ndarray, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys (as int64) of the lower-cased terms, and the row of each."""
    starts, ends, row = spans(buf, offs, term_gap())
    return Rolling(lower_table()[buf], cache).of(starts, ends).view(np.int64), row


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... count[i] numbers each, end to end."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def narrowed(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on in the fewest bytes that hold the largest."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)


def widened(buf, n: int) -> np.ndarray:
    """The n numbers that narrowed() wrote."""
    return np.frombuffer(buf, f"u{max(1, len(buf) // max(n, 1))}").astype(np.int64)


def index_segments(batches, text_col: str):
    """Inverted segments: per term its documents and counts; lengths and ids of the documents."""
    cache: dict = {}
    term, doc, tf, ids, lengths = [], [], [], [], []
    size = base = held = seq = 0
    part = TaskContext.get().partitionId()

    def segment():
        t, d, c = np.concatenate(term), np.concatenate(doc), np.concatenate(tf)
        order = np.lexsort((d, t))
        t, d, c = t[order], d[order], c[order]
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
        cols = [t[first], np.append(first, len(t)).astype(np.uint32), narrowed(d), narrowed(c), np.concatenate(ids), np.concatenate(lengths)]
        where = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([sum(x.nbytes for x in cols)], pa.int64())]
        return pa.record_batch([*where, *[pa.array([x.tobytes()], pa.binary()) for x in cols]], names=["part", "seq", "size", "terms", "starts", "docs", "counts", "ids", "lengths"])

    for batch in batches:
        buf_all, offs_all = bytes_of(batch.column(text_col))
        all_ids = ids_of(batch.column("doc_id"), -(2**63))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offs_all, offs_all[a] + (2 << 20), "right")) - 1)
            b = min(b, batch.num_rows, a + SEGMENT_DOCS)
            buf, offs = buf_all[offs_all[a] : offs_all[b]], offs_all[a : b + 1] - offs_all[a]
            t, row = terms_of(buf, offs, cache)
            lengths.append(np.bincount(row, minlength=b - a).astype(np.int64) if len(row) else np.zeros(b - a, np.int64))
            order = np.lexsort((t, row))
            t, row = t[order], row[order]
            first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (row[1:] != row[:-1]))) if len(t) else np.zeros(0, np.int64)
            term.append(t[first])
            doc.append(row[first] + base)
            tf.append(np.diff(np.append(first, len(t))))
            ids.append(all_ids[a:b])
            base += b - a
            size += len(buf)
            held += len(first)
            a = b
            if size >= SEGMENT or base >= SEGMENT_DOCS or held >= SEGMENT_POSTINGS:
                yield segment()
                seq += 1
                term, doc, tf, ids, lengths = [], [], [], [], []
                size = base = held = 0
    if base:
        yield segment()


def document_frequencies(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            terms = np.frombuffer(batch.column("terms")[i].as_buffer(), np.int64)
            starts = np.frombuffer(batch.column("starts")[i].as_buffer(), np.uint32).astype(np.int64)
            for a in range(0, len(terms), 100_000):
                t = terms[a : a + 100_000]
                yield pa.record_batch([pa.array(t), pa.array(np.diff(starts[a : a + len(t) + 1]))], names=["term", "df"])


def query_terms(batches, text_col: str):
    cache: dict = {}
    for batch in batches:
        buf, offs = bytes_of(batch.column(text_col))
        t, row = terms_of(buf, offs, cache)
        pairs = np.unique(np.stack([row, t], 1), axis=0) if len(t) else np.zeros((0, 2), np.int64)
        for a in range(0, len(pairs), 100_000):
            p = pairs[a : a + 100_000]
            yield pa.record_batch([batch.column("qrow").take(pa.array(p[:, 0])), pa.array(p[:, 1])], names=["qrow", "term"])


class Asked:
    """A block of queries: the terms of all, each distinct one once, and each query's k best so far, best first."""

    def __init__(self, qrow: list[int], terms: list[np.ndarray], idf: list[np.ndarray], k: int):
        self.qrow, self.idf = np.array(qrow, np.int64), np.concatenate(idf)
        self.offs = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
        self.terms, self.at = np.unique(np.concatenate(terms), return_inverse=True)
        self.ids, self.scores = np.zeros((len(qrow), k), np.int64), np.full((len(qrow), k), -np.inf)

    def add(self, a: int, b: int, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Documents for queries a to b; ties go to the smaller id."""
        k = self.ids.shape[1]
        query = np.concatenate([np.repeat(np.arange(b - a), k), query])
        ids, scores = np.concatenate([self.ids[a:b].ravel(), ids]), np.concatenate([self.scores[a:b].ravel(), scores])
        o = np.lexsort((ids, -scores, query))
        first = o[np.searchsorted(query[o], np.arange(b - a))[:, None] + np.arange(k)]
        self.ids[a:b], self.scores[a:b] = ids[first], scores[first]


class Segment:
    """One segment with impacts; frequent terms as rows over all documents, with block maxima.

    A term is frequent if it is in one of `often` documents or more. Such lists are long and add
    little, and they are what pruning is about: each block of documents keeps the largest impact
    of each of them, and their rows are read only in blocks that may hold one of the best.
    """

    def __init__(self, row: dict, k1: float, b: float, mean_length: float, often: int = 12):
        self.terms, self.ids, lengths = (np.frombuffer(row[c].as_buffer(), np.int64) for c in ("terms", "ids", "lengths"))
        self.starts = np.frombuffer(row["starts"].as_buffer(), np.uint32).astype(np.int64)
        self.docs, tf = (widened(row[c].as_buffer(), int(self.starts[-1])) for c in ("docs", "counts"))
        norm = k1 * (1 - b + b * lengths / max(mean_length, 1e-9))
        self.impact = tf * (k1 + 1) / (tf + norm[self.docs])
        self.n = len(self.ids)
        counts = np.diff(self.starts)
        frequent = np.flatnonzero(counts * often >= max(self.n, often * BLOCK))
        self.row = np.full(len(self.terms), -1)
        self.row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), self.n))
        for r, t in enumerate(frequent):
            at = slice(self.starts[t], self.starts[t + 1])
            self.dense[r, self.docs[at]] = self.impact[at]
        self.edges = np.arange(0, self.n, BLOCK)
        self.block_max = np.maximum.reduceat(self.dense, self.edges, axis=1) if self.dense.size else np.zeros((len(frequent), len(self.edges)))

    def search(self, asked: Asked) -> None:
        """Put this segment's documents among the best of every query."""
        at = np.minimum(np.searchsorted(self.terms, asked.terms), len(self.terms) - 1)
        at = np.where(self.terms[at] == asked.terms, at, -1)
        step = max(1, CELLS // self.n)
        for a in range(0, len(asked.qrow), step):
            self._search(asked, at, a, min(a + step, len(asked.qrow)))

    def _search(self, asked: Asked, at: np.ndarray, a: int, b: int) -> None:
        """The rarer terms name candidates with sums of their own. A block's bound for a query is the
        largest such sum in it and the block maxima of the frequent terms; only blocks whose bound
        reaches the k-th best score so far have their frequent terms read.
        """
        terms = slice(asked.offs[a], asked.offs[b])
        t, w, q = at[asked.at[terms]], asked.idf[terms], np.repeat(np.arange(b - a), np.diff(asked.offs[a : b + 1]))
        here = t >= 0
        t, w, q = t[here], w[here], q[here]
        if not len(t):
            return
        k, slack, row = asked.ids.shape[1], 10.0**-ROUND, self.row[t]
        sums = self._rare_sums(t[row < 0], w[row < 0], np.searchsorted(q[row < 0], np.arange(b - a + 1)))
        weight = np.zeros((b - a, len(self.dense)))
        weight[q[row >= 0], row[row >= 0]] = w[row >= 0]
        least = np.maximum(asked.scores[a:b, -1], 0.0)
        # the k-th best sum so far can only grow: it is a threshold already
        if self.n > k:
            least = np.maximum(least, np.partition(sums, self.n - k, axis=1)[:, self.n - k])
        bound = np.maximum.reduceat(sums, self.edges, axis=1) + weight @ self.block_max
        live = (bound >= least[:, None] - slack) & (bound > 0)
        for j in np.flatnonzero(live.any(0)):
            docs, some = slice(j * BLOCK, (j + 1) * BLOCK), np.flatnonzero(live[:, j])
            if len(some) == b - a:
                sums[:, docs] += weight @ self.dense[:, docs]
            else:
                sums[some, docs] += weight[some] @ self.dense[:, docs]
        got = np.where(np.repeat(live, BLOCK, axis=1)[:, : self.n], np.round(sums, ROUND), 0.0)
        least = asked.scores[a:b, -1]
        if self.n > k:
            least = np.maximum(least, np.partition(got, self.n - k, axis=1)[:, self.n - k])
        query, doc = np.nonzero((got >= least[:, None]) & (got > 0))
        if len(query):
            asked.add(a, b, query, self.ids[doc], got[query, doc])

    def _rare_sums(self, t: np.ndarray, w: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """A row for each query: what its rarer terms t[offs[i]:offs[i + 1]] add up to in every document."""
        out = np.zeros((len(offs) - 1, self.n))
        start, count = self.starts[t], self.starts[t + 1] - self.starts[t]
        for i, (x, y) in enumerate(zip(offs[:-1], offs[1:], strict=True)):
            post = ranges(start[x:y], count[x:y])
            out[i] = np.bincount(self.docs[post], weights=self.impact[post] * np.repeat(w[x:y], count[x:y]), minlength=self.n)
        return out


def search_shard(batches, k: int, k1: float, b: float, mean: float):
    """One shard: first its segments, which stay as they were written, then all queries, which pass by in blocks.

    For each block of queries one segment after the other is unpacked and searched, so a task holds
    the written bytes of its shard, one unpacked segment and one block.
    """
    segments: list[dict] = []
    qrow, terms, idf, held = [], [], [], 0

    def answers():
        asked = Asked(qrow, terms, idf, k)
        for row in segments:
            Segment(row, k1, b, mean).search(asked)
        some, _ = found = np.nonzero(np.isfinite(asked.scores))
        if len(some):
            yield pa.record_batch([pa.array(x) for x in (asked.qrow[some], asked.ids[found], asked.scores[found])], names=["qrow", "doc_id", "score"])

    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            if row["kind"].as_py() == 0:
                if len(row["terms"].as_buffer()):
                    segments.append(row)
                continue
            qrow.append(row["qrow"].as_py())
            terms.append(np.frombuffer(row["terms"].as_buffer(), np.int64))
            idf.append(np.frombuffer(row["idf"].as_buffer(), np.float64))
            held += len(terms[-1])
            if held >= ASKED_TERMS:
                yield from answers()
                qrow, terms, idf, held = [], [], [], 0
    if qrow:
        yield from answers()


def dealt(sizes: list[int], shards: int) -> list[int]:
    """A shard for each segment: the largest first, each to the shard that holds least."""
    held, out = [(0, s) for s in range(shards)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        least, s = held[0]
        out[i] = s
        heapq.heapreplace(held, (least + sizes[i], s))
    return out


def search(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, shards: int = 12, shard_bytes: int = 96 << 20, text_col: str = "text") -> DataFrame:
    """The k best documents for each query: the columns of queries but its text, rank, doc_id, score.

    docs has doc_id and text, queries any columns and a text; whole texts are indexed and asked.
    Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; a query's
    distinct terms count once. score is BM25 with idf = ln(1 + (N - df + 1/2) / (df + 1/2)) over
    all rows of docs, rounded to 6 digits; ties go to the smaller doc_id. The result is exact:
    bounds only leave out what cannot reach the k-th best score.

    The index is written to the shared folder as segments. A task holds one shard of about
    shard_bytes of the index as it was written and all queries stream past it, so the index is read once whatever the
    number of queries, and each shard reads the queries' terms once. A shard answers with its k
    best for each query. Segments are dealt to shards by their bytes; the driver sees one number for each.

    Defined cases: null and empty texts have no terms, count as rows and answer nothing; documents
    with a null id or score 0 are never answers; rows that share an id answer each for itself; a
    query without answers has no rows; a long text is a segment of its own; empty tables give no
    rows. A doc_id of queries is returned as query_id; columns of queries named query_id, rank or
    score are replaced, other columns of both tables may have any name.
    """
    named = [c for c in queries.columns if c not in (text_col, "rank", "score", "query_id")]
    docs = docs.select("doc_id", F.col(quoted(text_col)).alias("text"))
    segments = keep(docs.filter("doc_id is not null").mapInArrow(lambda it: index_segments(it, "text"), INDEX), "bm25-index", codec="zstd")
    n = docs.count()
    sizes = segments.select("part", "seq", "size").collect()
    shards = max(shards, -(-sum(r["size"] for r in sizes) // shard_bytes))
    asked = keep(boxed(queries, text=F.col(quoted(text_col)), qrow=F.monotonically_increasing_id()), "bm25-queries")
    pairs = asked.select("qrow", "text").mapInArrow(lambda it: query_terms(it, "text"), "qrow long, term long")
    df = segments.select("terms", "starts").mapInArrow(document_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    mean = ((segments.select("lengths").mapInArrow(_sum_lengths, "total long").agg(F.sum("total")).first()[0] or 0) / n) if n else 0.0
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = pairs.join(df, "term").select("qrow", F.struct("term", idf.alias("idf")).alias("x"))
    packed = keep(weighted.groupBy("qrow").agg(F.collect_list("x").alias("x")).mapInArrow(_pack_queries, "qrow long, terms binary, idf binary"), "bm25-query-terms")

    blank = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    places = [(r["part"], r["seq"], s) for r, s in zip(sizes, dealt([r["size"] for r in sizes], shards), strict=True)]
    placed = segments.join(F.broadcast(docs.sparkSession.createDataFrame(places, "part int, seq int, shard int")), ["part", "seq"])
    held = placed.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("qrow"), "terms", *blank("idf"), "starts", "docs", "counts", "ids", "lengths")
    asking = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    asking = asking.select("shard", F.lit(1).alias("kind"), "qrow", "terms", "idf", *blank("starts", "docs", "counts", "ids", "lengths"))
    both = held.unionByName(asking).repartitionById(shards, F.col("shard")).sortWithinPartitions("kind")
    top = both.mapInArrow(partial(search_shard, k=k, k1=k1, b=b, mean=mean), "qrow long, doc_id long, score double")
    rank = F.row_number().over(Window.partitionBy("qrow").orderBy(F.desc("score"), "doc_id"))
    best = keep(top.withColumn("rank", rank).filter(F.col("rank") <= k), "bm25-best")
    drop(segments, packed)
    columns = [F.col(f"_row.{quoted(c)}").alias("query_id" if c == "doc_id" else c) for c in named]
    return asked.join(best, "qrow").select(*columns, "rank", "doc_id", "score")


def _sum_lengths(batches):
    for batch in batches:
        yield pa.record_batch([pa.array([int(np.frombuffer(x.as_buffer(), np.int64).sum()) for x in batch.column("lengths")], pa.int64())], names=["total"])


def _pack_queries(batches):
    for batch in batches:
        terms, idf = [], []
        for x in batch.column("x"):
            v = x.values
            terms.append(np.asarray(v.field("term"), np.int64).tobytes())
            idf.append(np.asarray(v.field("idf"), np.float64).tobytes())
        yield pa.record_batch([batch.column("qrow"), pa.array(terms, pa.binary()), pa.array(idf, pa.binary())], names=["qrow", "terms", "idf"])
