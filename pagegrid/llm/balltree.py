"""Exact ranked search by a sparse ball tree: centroid-radius bounds prune subtrees, whole numbers decide at the leaves."""

from __future__ import annotations

import heapq
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bm25 import query_terms, terms_of
from .common import boxed, drop, keep, positions, quoted
from .kernels import bytes_of, chunks

#: Rows of queries answered in one pass over the documents.
BLOCK = 512
#: Documents and entries of one tree, coordinates of its centroids, documents of one leaf.
TREE, ENTRIES, CENTERS, LEAF = 1 << 13, 1 << 21, 1 << 23, 32
HITS = "doc_id long, n long, terms array<int>, counts array<int>"


def term_counts(batches, vocabulary: np.ndarray):
    """(doc_id, n, terms, counts) for each text with a term: n terms in all, and its terms that some query asks, by their place in the vocabulary."""
    cache: dict = {}
    size = max(len(vocabulary), 1)
    for batch in batches:
        buf_all, offs_all = bytes_of(batch.column("text"))
        for lo, hi in chunks(offs_all, 4 << 20):
            t, row = terms_of(buf_all[offs_all[lo] : offs_all[hi]], offs_all[lo : hi + 1] - offs_all[lo], cache)
            n = np.bincount(row, minlength=hi - lo)
            at = np.minimum(np.searchsorted(vocabulary, t), size - 1)
            asked = vocabulary[at] == t if len(vocabulary) else np.zeros(len(t), bool)
            pair, count = np.unique(row[asked] * size + at[asked], return_counts=True)
            some = np.flatnonzero(n)
            offs = np.append(0, np.cumsum(np.bincount(pair // size, minlength=hi - lo)[some])).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offs), pa.array(x.astype(np.int32))) for x in (pair % size, count)]
            yield pa.record_batch([batch.column("doc_id").take(pa.array(lo + some)), pa.array(n[some]), *lists], names=["doc_id", "n", "terms", "counts"])


def partial_df(batches, size: int):
    """(term, df, docs, words) of a task's rows; term -1 carries the number of documents and of their terms."""
    df, docs, words = np.zeros(size, np.int64), 0, 0
    for batch in batches:
        df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        docs += batch.num_rows
        words += int(batch.column("n").to_numpy().sum())
    term = np.append(-1, np.flatnonzero(df))
    nothing = np.zeros(len(term) - 1, np.int64)
    yield pa.record_batch([pa.array(term), pa.array(np.append(0, df[df > 0])), pa.array(np.append(docs, nothing)), pa.array(np.append(words, nothing))], names=["term", "df", "docs", "words"])


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def length_norm(n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """100 - 75 + (75 * n * docs) div words, in whole numbers of any size."""
    if len(n) and 75 * int(n.max()) * docs >= 1 << 63:
        return np.array([25 + 75 * int(x) * docs // words for x in n], np.int64)
    return 25 + 75 * n * docs // max(words, 1)


class BallTree:
    """Documents (rows of a sparse matrix of whole numbers) in a tree of balls.

    Coordinates are the impacts times the root of the term's weight, so that a query (its counts
    times the same roots) has the score as inner product. A ball's documents go to the nearer of two
    far members, an eighth of them to either at least, so depth is bounded. Node 0 is the root, a
    node's children are children[i] and the next one (0: a leaf), its documents first[i] to last[i].
    A ball over all terms is wide where a query has few, so each coordinate has a radius of its own too.
    """

    def __init__(self, ids: np.ndarray, offs: np.ndarray, term: np.ndarray, impact: np.ndarray, root: np.ndarray):
        self.size = len(root)
        self.term, self.impact, self.offs, self.root = term, impact, offs, root
        self.x = impact * root[term]
        self.norm2 = np.add.reduceat(self.x * self.x, offs[:-1])
        order = np.arange(len(ids))
        ranges, children, node = [(0, len(ids))], [], 0
        while node < len(ranges):
            a, b = ranges[node]
            children.append(0)
            if b - a > LEAF:
                side = self._sides(order[a:b])
                least = max(1, (b - a) // 8)
                nearer = min(max(int((side < 0).sum()), least), b - a - least)
                order[a:b] = order[a:b][np.argpartition(side, nearer - 1)]
                children[node] = len(ranges)
                ranges += [(a, a + nearer), (a + nearer, b)]
            node += 1
        self.first, self.last = np.array(ranges).T
        self.children = np.array(children)
        self._arrange(ids, order)
        self._bounds()

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the rows' entries, where each row's begin)."""
        count = self.offs[rows + 1] - self.offs[rows]
        begin = np.append(0, np.cumsum(count))
        return np.repeat(self.offs[rows] - begin[:-1], count) + np.arange(begin[-1]), begin[:-1]

    def _products(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        at, begin = self._entries(rows)
        return np.add.reduceat(self.x[at] * point[self.term[at]], begin)

    def _point(self, row: int) -> np.ndarray:
        out = np.zeros(self.size)
        part = slice(self.offs[row], self.offs[row + 1])
        out[self.term[part]] = self.x[part]
        return out

    def _sides(self, rows: np.ndarray) -> np.ndarray:
        """Squared distance to one far member less that to another, the same for all runs."""
        one = self._point(rows[0])
        away = self.norm2[rows] - 2 * self._products(rows, one)
        one = self._point(a := rows[np.argmax(away)])
        near = self.norm2[rows] - 2 * self._products(rows, one) + self.norm2[a]
        other = self._point(b := rows[np.argmax(near)])
        return near - (self.norm2[rows] - 2 * self._products(rows, other) + self.norm2[b])

    def _arrange(self, ids: np.ndarray, order: np.ndarray) -> None:
        at, begin = self._entries(order)
        self.term, self.impact, self.x, self.norm2 = self.term[at], self.impact[at], self.x[at], self.norm2[order]
        self.offs, self.ids = np.append(begin, len(at)), ids[order]

    def _bounds(self) -> None:
        """Centroids as rounded numbers, and radii that hold for those numbers: what rounding may take is added.

        Beside the radius of the whole ball, `reach` has the centroid and the radius of each coordinate alone.
        """
        nodes = len(self.first)
        self.center, self.radius, self.reach = np.zeros((nodes, self.size), np.float32), np.zeros(nodes), np.zeros((nodes, self.size), np.float32)
        for node in range(nodes - 1, -1, -1):
            a, b = self.first[node], self.last[node]
            part = slice(self.offs[a], self.offs[b])
            self.center[node] = np.bincount(self.term[part], self.x[part], self.size) / (b - a)
            c = self.center[node].astype(float)
            length2 = float(c @ c)
            product = np.add.reduceat(self.x[part] * c[self.term[part]], self.offs[a:b] - self.offs[a])
            spread = self.norm2[a:b] + length2
            self.radius[node] = math.sqrt(float((spread - 2 * product + 1e-9 * spread).max())) * (1 + 1e-9)
            if k := self.children[node]:
                self.reach[node] = np.maximum(self.reach[k], self.reach[k + 1])
            else:
                most = np.zeros(self.size)
                np.maximum.at(most, self.term[part], self.x[part])
                self.reach[node] = most * (1 + 1e-6)

    def bounds(self, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        """For each node a number that no document below it exceeds, for a query's terms and their counts."""
        point = count * self.root[term]
        ball = self.center[:, term].astype(float) @ point + self.radius * math.sqrt(float(point @ point))
        return np.minimum(ball, self.reach[:, term].astype(float) @ point) * (1 + 1e-9)

    def search(self, bound: np.ndarray, weights: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The k best of `best` (ids, scores) and this tree's documents; weights: per term, count times weight."""
        ids, scores = best
        least = scores[-1] if len(scores) >= k else 1
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= least:
            _, node = heapq.heappop(heap)
            if self.children[node]:
                for child in (self.children[node], self.children[node] + 1):
                    if bound[child] >= least:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            a, b = self.first[node], self.last[node]
            part = slice(self.offs[a], self.offs[b])
            got = np.add.reduceat(self.impact[part] * weights[self.term[part]], self.offs[a:b] - self.offs[a])
            new = got >= least
            if new.any():
                ids, scores = np.append(ids, self.ids[a:b][new]), np.append(scores, got[new])
                o = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[o], scores[o]
                least = scores[-1] if len(scores) >= k else 1
        return ids, scores


def search_trees(batches, asked: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, k: int, docs: int, words: int):
    """(qrow, doc_id, score): a task's k best for each query, over the trees of its rows."""
    root = np.sqrt(weights.astype(float))
    most = min(TREE, max(LEAF, CENTERS // max(len(weights), 1) // 2 * LEAF))
    whole = np.zeros(len(weights), np.int64)
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked)

    def tree(held: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(held).combine_chunks()
        terms, counts = (rows[c].combine_chunks() if rows[c].num_chunks != 1 else rows[c].chunk(0) for c in ("terms", "counts"))
        term, count = terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64)
        size = np.diff(terms.offsets.to_numpy()).astype(np.int64)
        norm = np.repeat(length_norm(rows["n"].to_numpy(), docs, words), size)
        found = BallTree(rows["doc_id"].to_numpy(), np.append(0, np.cumsum(size)), term, 1_000_000_000 * count // (1000 * count + 8 * norm), root)
        for q, (t, c) in enumerate(asked):
            whole[t] = c * weights[t]
            best[q] = found.search(found.bounds(t, c), whole, k, best[q])
            whole[t] = 0

    held, n, entries = [], 0, 0
    for batch in batches:
        step = min(1024, most)
        for a in range(0, batch.num_rows, step):
            held.append(part := batch.slice(a, step))
            n, entries = n + part.num_rows, entries + len(part.column("terms").flatten())
            if n >= most or entries >= ENTRIES:
                tree(held)
                held, n, entries = [], 0, 0
    if n:
        tree(held)
    out = [(np.full(len(i), q, np.int32), i, s) for q, (i, s) in enumerate(best)]
    if out:
        yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query", "doc_id", "score"])


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10, text_col: str = "text") -> DataFrame:
    """The k best documents for each query, by whole-number BM25: the columns of queries but its text, rank, doc_id, score.

    docs has doc_id and a text; queries has any columns and a text. Terms are runs of ASCII
    letters, digits and non-ASCII characters, A-Z lower-cased. With N documents that have a term and L terms in them, a
    term in df of them weighs w = floor(1000 ln((2N + 2) / (2df + 1))), and a document with n terms
    scores the sum, over the query's terms with repeats, of w * (10^9 tf div (1000 tf + 8m)),
    m = 25 + 75nN div L. Scores are exact, ties go to the smaller doc_id, a score of 0 is no answer.

    Queries are answered in blocks of BLOCK rows, each one pass over all documents; the driver and
    the tasks hold the terms of one block. Texts become sparse vectors over the terms that the block
    asks (a projection, which keeps every score and makes balls tighter), written once to the
    shared folder. A task builds trees over its own rows, at most TREE documents each, and searches
    them best-first with the k-th best score it has so far; so documents are never shuffled. Each
    task answers with its k best for each query, and a window with a limit in each task merges them.

    Defined cases: null and empty texts have no terms, answer nothing and count for nothing, and
    such queries get no rows; documents with a null id count but are never answers; rows that share
    an id, of either table, stand each for itself; a long text is one vector; an empty table gives
    no rows. Columns of queries named rank, doc_id or score are replaced, others may have any name.
    """
    spark = docs.sparkSession
    named = [c for c in queries.columns if c not in (text_col, "rank", "doc_id", "score")]
    texts = docs.select("doc_id", F.col(quoted(text_col)).alias("text"))
    rows = boxed(queries, text=F.col(quoted(text_col)))
    asked = keep(positions(rows, [F.hash("text")], "queries").withColumnRenamed("_pos", "qrow"), "queries-numbered")
    blocks = -(-asked.count() // BLOCK)
    answers = None
    for block in range(blocks):
        part = asked.filter(F.col("qrow").between(block * BLOCK, (block + 1) * BLOCK - 1)).select("qrow", "text")
        pairs = part.mapInArrow(partial(query_counts, text_col="text"), "qrow long, term long, count int").toArrow()
        if not pairs.num_rows:
            continue
        vocabulary, place = np.unique(pairs["term"].to_numpy(), return_inverse=True)
        rank, row = np.unique(pairs["qrow"].to_numpy(), return_inverse=True)
        count = pairs["count"].to_numpy().astype(np.int64)
        wanted = [(place[row == i], count[row == i]) for i in range(len(rank))]
        hits = keep(texts.mapInArrow(partial(term_counts, vocabulary=vocabulary), HITS), "hits", codec="zstd")
        sums = hits.mapInArrow(partial(partial_df, size=len(vocabulary)), "term long, df long, docs long, words long")
        got = sums.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "docs", "words")]).toArrow()
        table = dict(zip(got["term"].to_pylist(), zip(*[got[c].to_pylist() for c in ("df", "docs", "words")], strict=True), strict=True))
        _, n, words = table.get(-1, (0, 0, 0))
        weights = np.array([weight(n, table[t][0]) if t in table else 0 for t in range(len(vocabulary))], np.int64)
        useful = hits.filter((F.size("terms") > 0) & F.col("doc_id").isNotNull())
        top = useful.mapInArrow(partial(search_trees, asked=wanted, weights=weights, k=k, docs=n, words=words), "query int, doc_id long, score long")
        place_of = F.array(*[F.lit(int(q)) for q in rank])
        order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
        best = top.withColumn("rank", order).filter(F.col("rank") <= k).select(F.element_at(place_of, F.col("query") + 1).cast("long").alias("qrow"), "rank", "doc_id", "score")
        best = keep(best, "ranked")
        drop(hits)
        answers = best if answers is None else answers.unionByName(best)
    if answers is None:
        answers = spark.createDataFrame([], "qrow long, rank int, doc_id long, score long")
    columns = [F.col(f"_row.{quoted(c)}").alias(c) for c in named]
    return asked.join(answers, "qrow").select(*columns, "rank", "doc_id", "score")


def query_counts(batches, text_col: str):
    """(qrow, term, count), each term of a query once."""
    cache: dict = {}
    for batch in batches:
        t, row = terms_of(*bytes_of(batch.column(text_col)), cache)
        if not len(t):
            continue
        order = np.lexsort((t, row))
        t, row = t[order], row[order]
        first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (row[1:] != row[:-1])))
        yield pa.record_batch([batch.column("qrow").take(pa.array(row[first])), pa.array(t[first]), pa.array(np.diff(np.append(first, len(t))).astype(np.int32))], names=["qrow", "term", "count"])
