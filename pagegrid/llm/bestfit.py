"""Best-fit packing of tokenised documents: large pieces matched in pairs, small ones into the tightest gaps."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bm25 import ranges
from .common import drop, keep, positions, quoted
from .kernels import bytes_of, chunks

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
#: Text handled at a time, and the words a worker remembers with their ids.
CHUNK, MOST_WORDS = 4 << 20, 1 << 20
OTHER, LETTER, MARK, DIGIT, BLANK = range(5)


def byte_classes() -> np.ndarray:
    """ASCII letters, marks, digits and blanks; the apostrophe, controls and all else may act on their neighbours."""
    out = np.full(256, OTHER, np.uint8)
    out[0x41:0x5B] = out[0x61:0x7B] = LETTER
    out[0x21:0x30] = out[0x3A:0x41] = out[0x5B:0x61] = out[0x7B:0x7F] = MARK
    out[ord("'")] = OTHER
    out[0x30:0x3A] = DIGIT
    out[[0x20, *range(0x09, 0x0E)]] = BLANK
    return out


def words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, the row of each, whether it is letters only): cuts at which the tokenizer always cuts too.

    These are blanks and the places where letters, ASCII marks and single digits meet. Letters are
    ASCII ones and U+00C0 to U+017F; next to any other character nothing is cut or lower-cased, as
    marks may join their neighbours.
    """
    n = len(buf)
    kind = byte_classes()[buf]
    after = np.append(buf[1:], 0)
    lead = ((buf == 0xC3) & (after != 0x97) & (after != 0xB7)) | (buf == 0xC4) | (buf == 0xC5)
    kind[lead] = LETTER
    kind[1:][lead[:-1]] = LETTER
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    alone = np.append(kind[1:] != OTHER, True) | edge[1:]
    low = buf.copy()
    low[(buf >= 0x41) & (buf <= 0x5A) & alone] += 32
    solid = kind != BLANK
    before = np.append(BLANK, kind[:-1]) if n else kind
    turn = (kind != before) & (kind != OTHER) & (before != OTHER)
    starts = np.flatnonzero(solid & ((before == BLANK) | edge[:-1] | turn | ((kind == DIGIT) & (before == DIGIT))))
    at = np.cumsum(solid) - 1
    ends = np.append(at[starts], int(solid.sum()))
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(low[solid])])
    plain = np.add.reduceat(kind[solid] != LETTER, ends[:-1]) == 0 if len(starts) else np.zeros(0, bool)
    return words, np.searchsorted(offs, starts, "right") - 1, plain


class WordIds:
    """A tokenizer's ids word by word; words met before are looked up."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        vocabulary = self.encoder.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        # strings of added tokens are found before any other rule: texts that hold them go whole
        self.added = [t.content for t in self.encoder.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known, self.ids, self.starts = pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: pa.Array, plain: np.ndarray) -> None:
        """Words of letters are one unit each: many go as one text, and a unit's last id tells where it ends."""
        ids: list = [None] * len(words)
        text = [w.decode() for w in words.to_pylist()]
        joined = np.flatnonzero(plain)
        for a in range(0, len(joined), 4096):
            part = joined[a : a + 4096]
            flat = np.array(self.encode([" ".join(text[i] for i in part)])[0], np.int32)
            ends = np.flatnonzero(self.last[flat]) + 1
            if len(ends) == len(part):
                for i, x in zip(part, np.split(flat, ends[:-1]), strict=True):
                    ids[i] = x
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(rest, self.encode([text[i] for i in rest]), strict=True):
            ids[i] = np.array(x, np.int32)
        self.known = pa.concat_arrays([self.known, words])
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum([len(x) for x in ids], dtype=np.int64))
        self.ids = np.concatenate([self.ids, *ids])

    def rows(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows end to end, the number of each row's)."""
        words, row, plain = words_of(buf, offs)
        coded = words.dictionary_encode()
        if len(self.known) + len(coded.dictionary) > MOST_WORDS:
            self.forget()
        codes = coded.indices.to_numpy().astype(np.int64)
        found = pc.index_in(coded.dictionary, value_set=self.known)
        if found.null_count:
            new = np.flatnonzero(~np.asarray(found.is_valid()))
            is_plain = np.zeros(len(coded.dictionary), bool)
            is_plain[codes] = plain
            self.learn(coded.dictionary.take(pa.array(new)), is_plain[new])
            found = pc.index_in(coded.dictionary, value_set=self.known)
        at = found.to_numpy()[codes] if len(codes) else codes
        count = self.starts[at + 1] - self.starts[at]
        return self.ids[ranges(self.starts[at], count)], np.bincount(row, count, len(offs) - 1).astype(np.int64)

    def long_row(self, buf: np.ndarray) -> np.ndarray:
        """One long text, part by part, cut at blanks only."""
        blank = np.flatnonzero(byte_classes()[buf] == BLANK)
        out, a = [], 0
        while a < len(buf):
            i = int(np.searchsorted(blank, a + CHUNK))
            b = int(blank[i]) + 1 if i < len(blank) else len(buf)
            out.append(self.rows(buf[a:b], np.array([0, b - a]))[0])
            a = b
        return np.concatenate(out)


def word_ids(path: str) -> WordIds:
    """The worker's own table for this file; it stays while the worker lives, and is bounded by MOST_WORDS."""
    import tokenizers

    tables = tokenizers.__dict__.setdefault("_pagegrid_word_ids", {})
    if path not in tables:
        tables[path] = WordIds(path)
    return tables[path]


def token_rows(column, path: str):
    """(row, ids) of each text; nulls are empty."""
    table = word_ids(path)
    buf, offs = bytes_of(column)
    special = np.zeros(len(offs) - 1, bool)
    for content in table.added:
        special |= np.asarray(pc.fill_null(pc.match_substring(column, content), False))
    for lo, hi in chunks(offs, CHUNK):
        part, at = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        if special[lo:hi].any() or len(part) > CHUNK:
            for i in range(lo, hi):
                text = buf[offs[i] : offs[i + 1]]
                yield i, np.array(table.encode([text.tobytes().decode()])[0], np.int32) if special[i] else table.long_row(text) if len(text) else np.zeros(0, np.int32)
            continue
        ids, count = table.rows(part, at)
        for i, x in enumerate(np.split(ids, np.cumsum(count)[:-1])):
            yield lo + i, x


def cut_pieces(batches, path: str, capacity: int, end_id: int, with_ids: bool):
    for batch in batches:
        docs = batch.column("doc_id")
        rows, numbers, starts, lengths, sums, held = [], [], [], [], [], []
        for i, ids in token_rows(batch.column("text"), path):
            ids = np.append(ids, np.int32(end_id)).astype("<u4")
            for a in range(0, len(ids), capacity):
                part = ids[a : a + capacity]
                rows.append(i)
                numbers.append(a // capacity)
                starts.append(a)
                lengths.append(len(part))
                sums.append(zlib.crc32(part.data))
                held.append(part.tobytes() if with_ids else None)
        columns = [docs.take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), pa.array(sums, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.record_batch([*columns, pa.array(held, pa.binary())] if with_ids else columns, names=[*names, "ids"] if with_ids else names)


def plan_bins(count: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where pieces go, from the number of pieces of each length: (length, first rank, pieces, first bin, pieces a bin, offset).

    Pieces above a third of the capacity share a bin with one of their kind at most. From the
    largest down, each takes the largest partner that fits, which leaves as few bins as pairs can.
    Smaller pieces, from the largest down, go where the gap is tightest; a bin that took a piece is
    the tightest for the next of its length, so it takes as many as fit. Bins that look alike move
    together, so the work depends on the number of lengths, not on that of pieces.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    used = dict.fromkeys(count, 0)
    gaps: list[int] = []  # sorted; alike[g] holds runs of bins (first bin, bins) with gap g
    alike: dict[int, list[tuple[int, int]]] = {}
    bins = 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in alike:
                insort(gaps, gap)
            alike.setdefault(gap, []).append((first, n))

    def put(length: int, n: int, first: int, each: int, offset: int) -> None:
        out.append((length, used[length], n, first, each, offset))
        used[length] += n

    large = sorted(x for x, n in count.items() if n and 3 * x > capacity)
    left = {x: count[x] for x in large}
    while large:
        a = large[-1]
        k = bisect_left(large, min(capacity - a, a) + 1) - 1
        if k >= 0 and large[k] == a and left[a] == 1:
            k -= 1
        b = large[k] if k >= 0 else 0
        n = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
        put(a, n, bins, 1, 0)
        left[a] -= n
        if b:
            put(b, n, bins, 1, a)
            left[b] -= n
        leave(capacity - a - b, bins, n)
        bins += n
        for x in {a, b} - {0}:
            if not left[x]:
                large.pop(bisect_left(large, x))
    for s in sorted((x for x, n in count.items() if n and 3 * x <= capacity), reverse=True):
        n = count[s]
        while n:
            i = bisect_left(gaps, s)
            if i == len(gaps):
                gap, first, m = capacity, bins, -(-n // (capacity // s))
                bins += m
            else:
                gap = gaps[i]
                first, m = alike[gap].pop()
                if not alike[gap]:
                    del alike[gap], gaps[i]
            each = gap // s
            full = min(m, n // each)
            if full:
                put(s, full * each, first, each, capacity - gap)
                leave(gap - each * s, first, full)
                n -= full * each
            if full < m and n:
                put(s, n, first + full, n, capacity - gap)
                leave(gap - n * s, first + full, 1)
                n, full = 0, full + 1
            leave(gap, first + full, m - full)
    return out


def place(batches, plan: np.ndarray, first: np.ndarray):
    """Bins and offsets of pieces whose `_pos` counts all pieces by length; first: the place of each length's first piece."""
    key = (plan[:, 0] << 44) + plan[:, 1]
    for batch in batches:
        length = batch.column("length").to_numpy().astype(np.int64)
        rank = batch.column("_pos").to_numpy() - first[length]
        _, _, _, base, each, offset = plan[np.searchsorted(key, (length << 44) + rank, "right") - 1].T
        k = rank - plan[np.searchsorted(key, (length << 44) + rank, "right") - 1, 1]
        more = [pa.array(base + k // np.maximum(each, 1)), pa.array(offset + k % np.maximum(each, 1) * length)]
        yield pa.record_batch([*batch.drop_columns(["_pos"]).columns, *more], names=[*[c for c in batch.schema.names if c != "_pos"], "sequence_id", "offset"])


def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most `capacity` tokens, packed into few sequences of that size.

    docs has doc_id and a text; tokenizer is the path of a tokenizers file, which every executor
    must have. A document is its ids (nothing added by the tokenizer) and end_id. Returns doc_id,
    piece (from 0), start (ids of the document before it), length, ids_crc32 (over the ids as
    little-endian 32-bit words), sequence_id (from 0), offset (gapless from 0), and with with_ids
    the ids as such words. packed_sequences() joins those.

    Texts are tokenised once, each worker remembering the words it met. Only the number of pieces
    of each length, at most `capacity` numbers, reaches the driver, which plans whole runs of equal
    lengths; a piece finds its place by its rank among those of its length, which a range sort gives.

    Defined cases: null and empty texts are end_id alone; repeated rows and rows with null ids are
    packed each for itself; texts above CHUNK bytes are tokenised in parts cut at blanks; other
    columns are not looked at; an empty table gives no rows.
    """
    if not 0 < capacity < 1 << 19:
        raise ValueError("capacity must be between 1 and 524,287 tokens")
    texts = docs.select("doc_id", F.col(quoted(text_col)).alias("text"))
    cut = partial(cut_pieces, path=tokenizer, capacity=capacity, end_id=end_id, with_ids=with_ids)
    pieces = keep(texts.mapInArrow(cut, PIECES + (", ids binary" if with_ids else "")), "pieces")
    count = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = np.array(sorted(plan_bins(count, capacity)) or [(0, 0, 0, 0, 1, 0)], np.int64)
    first = np.zeros(capacity + 2, np.int64)
    first[1:] = np.cumsum([count.get(x, 0) for x in range(capacity + 1)])
    ranked = positions(pieces, [F.col(c) for c in ("length", "doc_id", "piece", "ids_crc32")], "pieces-by-length")
    placed = ranked.mapInArrow(partial(place, plan=plan, first=first), pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema)
    drop(pieces)
    return placed.withColumn("length", F.col("length").cast("long"))


def packed_sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids as binary, length, parts): the sequences of best_fit_pack(..., with_ids=True).

    A sequence holds at most `capacity` ids, so no group grows with the table.
    """
    part = F.struct("offset", "doc_id", "piece", "length", "ids")
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.aggregate("p", F.lit(0).cast("long"), lambda acc, p: acc + p["length"]).alias("length"), F.transform("p", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"])).alias("parts"))
