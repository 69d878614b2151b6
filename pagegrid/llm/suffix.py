"""Suffix-array dedup: repeated windows found by a depth-limited radix sort of suffixes.

Only suffixes at content-chosen anchors are sorted. In each window of `length` bytes the anchor
is the `gram`-byte string with the least hash (the first such, so equal windows have equal
anchors at equal places), and one anchor serves a run of consecutive windows. The passes take the
most significant digit first:

1. the anchor: all runs of one anchor meet, and anchors of one document only drop out;
2. the run: the bytes that a run covers, as one digit (its digest). A run found in a smaller
   document is repeated as a whole. Those left are the edges of repeats and chance anchors; where
   an anchor has very many of them, each of its windows goes on alone, under its own digest;
3. their windows, eight bytes a pass to the depth of the threshold, on the bytes themselves.
   A window alone in its group drops out after each pass. What is left at full depth are
   exactly the repeated windows, and those with a smaller document in the group are marked.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep, partitions, row_key
from .kernels import Rolling, U, bytes_of, chunks, ids_of

CHUNK = 2 << 20
LAST = 2**63 - 1
LOW48 = U(2**48 - 1)
#: Runs of one anchor to look into, beyond which its windows part.
HOT = 2000
#: Anchors known as frequent before the first pass, at most.
MOST_FREQUENT = 20_000


def pack_runs(h, t, doc, lo, n) -> bytes:
    """One block of runs, column after column: 48 bits of the anchor's hash, the run's digest, document number, first window, windows."""
    six = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    parts = [six, t.astype("<u8"), doc.astype("<u2"), (lo & 0xFFFF).astype("<u2"), (lo >> 16).astype("<u2"), n.astype(np.uint8)]
    return b"".join(np.ascontiguousarray(x).tobytes() for x in parts)


def unpack_runs(block: np.ndarray) -> tuple[np.ndarray, ...]:
    m = len(block) // 21
    full = np.zeros((m, 8), np.uint8)
    full[:, :6] = block[: 6 * m].reshape(m, 6)
    t = np.frombuffer(block[6 * m : 14 * m].tobytes(), "<u8")
    doc, low, high = (np.frombuffer(block[14 * m + 2 * m * i : 16 * m + 2 * m * i].tobytes(), "<u2").astype(np.int64) for i in range(3))
    return full.view("<u8").ravel(), t, doc, low + (high << 16), block[20 * m :].astype(np.int64)


def anchor_runs(buf: np.ndarray, offs: np.ndarray, length: int, gram: int, cache: dict) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: anchor hash, run digest, row, first window, windows."""
    n, width = len(buf), length - gram + 1
    if n < length:
        return tuple(np.zeros(0, t) for t in (U, U, np.int64, np.int64, np.int64))
    rolling = Rolling(buf, cache)
    at = np.arange(n - gram + 1)
    grams = rolling.of(at, at + gram)
    # the least of `width` consecutive grams, by doubling
    least, span = grams, 1
    while span * 2 <= width:
        least, span = np.minimum(least[: len(least) - span], least[span:]), span * 2
    if rest := width - span:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(least)]
    starts = np.arange(len(least))
    valid = starts + length <= offs[1:][row]
    starts, least, row = starts[valid], least[valid], row[valid]
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (U, U, np.int64, np.int64, np.int64))
    cut = np.ones(len(starts), bool)
    cut[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(cut)
    count = np.diff(np.append(first, len(starts)))
    # in periodic text one least value may last longer than a window: such runs are cut
    pieces = -(-count // width)
    run = np.repeat(np.arange(len(first)), pieces)
    step = (np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * width
    first, count = first[run] + step, np.minimum(width, count[run] - step)
    lo, row = starts[first], row[first]
    return least[first] & LOW48, rolling.of(lo, lo + count + length - 1), row, lo - offs[row], count


def count_anchors(batches, length: int, gram: int):
    """Anchors of each chunk of documents and how many runs they have."""
    cache: dict = {}
    for batch in batches:
        buf, offs = bytes_of(batch.column("text"))
        for a, b in chunks(offs, CHUNK):
            h, n = np.unique(anchor_runs(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], length, gram, cache)[0], return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])


def shipped_runs(batches, length: int, gram: int, buckets: int, frequent: np.ndarray):
    """Per chunk of documents and bucket, a block of runs; a run that the chunk holds in a smaller document goes as found.

    Runs of one anchor share a bucket; those of a frequent anchor only with the runs equal to them.
    """
    cache: dict = {}
    for batch in batches:
        buf_all, offs_all = bytes_of(batch.column("text"))
        ids, keys = ids_of(batch.column("doc_id"), LAST), ids_of(batch.column("rk"), 0)
        out_bucket, out_docs, out_runs = [], [], []
        for a, b in chunks(offs_all, CHUNK):
            buf, offs = buf_all[offs_all[a] : offs_all[b]], offs_all[a : b + 1] - offs_all[a]
            h, t, row, lo, n = anchor_runs(buf, offs, length, gram, cache)
            if not len(h):
                continue
            doc = ids[a:b][row]
            order = np.lexsort((doc, t, h))
            h, t, row, lo, n, doc = (x[order] for x in (h, t, row, lo, n, doc))
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
            # a run that this chunk holds in a smaller document is settled; it only passes through
            settled = doc > doc[new][np.cumsum(new) - 1]
            route = np.where(np.isin(h, frequent), t, h) % U(buckets)
            where = np.where(settled, -1 - int(ids[a] % buckets), route.astype(np.int64))
            by = np.argsort(where, kind="stable")
            known = np.stack([ids[a:b], keys[a:b]], 1)
            for k in np.split(by, np.flatnonzero(np.diff(where[by])) + 1):
                used, local = np.unique(row[k], return_inverse=True)
                for x in range(0, len(used), 65_536):
                    m = (local >= x) & (local < x + 65_536)
                    out_bucket.append(int(where[k[0]]))
                    out_docs.append(known[used[x : x + 65_536]].tobytes())
                    out_runs.append(pack_runs(h[k][m], t[k][m], local[m] - x, lo[k][m], n[k][m]))
        if out_bucket:
            yield pa.record_batch([pa.array(out_bucket, pa.int32()), pa.array(out_docs, pa.binary()), pa.array(out_runs, pa.binary())], names=["bucket", "docs", "runs"])


def settle_runs(table: pa.Table, frequent: np.ndarray) -> pa.Table:
    """First two passes in one bucket: whole runs that a smaller document holds, and runs to look into.

    Open runs of frequent anchors are all looked into, as their anchor's other runs are elsewhere.
    """
    parts, who = [], []
    for d, r in zip(table.column("docs"), table.column("runs"), strict=True):
        parts.append(unpack_runs(np.frombuffer(r.as_buffer(), np.uint8)))
        who.append(np.frombuffer(d.as_buffer(), np.int64).reshape(-1, 2)[parts[-1][2]])
    h, t, _, lo, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    ids, keys = np.concatenate(who).T
    found, look = np.ones(len(h), bool), np.zeros(len(h), np.int32)
    if table.column("bucket")[0].as_py() >= 0:
        order = np.lexsort((ids, t, h))
        h, t, lo, n, ids, keys = (x[order] for x in (h, t, lo, n, ids, keys))
        new_h = np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        new_t = new_h.copy()
        new_t[1:] |= t[1:] != t[:-1]
        group = np.cumsum(new_h) - 1
        found = ids > ids[new_t][np.cumsum(new_t) - 1]
        edges = np.flatnonzero(new_h)
        several = np.minimum.reduceat(ids, edges) < np.maximum.reduceat(ids, edges)
        apart = np.isin(h, frequent)
        look = (~found & (apart | (several & (np.bincount(group, weights=new_t) > 1))[group])).astype(np.int32)
        look += look * (apart | (np.bincount(group, weights=look) > HOT)[group])
    stay = found | (look > 0)
    return pa.table({
        "id": pa.array(ids[stay]), "rk": pa.array(keys[stay]), "lo": pa.array(lo[stay].astype(np.int32)), "n": pa.array(n[stay].astype(np.int32)),
        "h": pa.array(h[stay].view(np.int64)), "look": pa.array(look[stay]),
    })


def cut_contexts(batches, length: int, buckets: int):
    """The bytes of each run to look into, with the bucket b of its anchor.

    Runs of a hot anchor come apart: each window is a run under its own digest, so they spread over
    buckets, and windows that this batch holds in a smaller document are settled here and only
    pass through (b < 0).
    """
    cache: dict = {}
    types = {"id": pa.int64(), "rk": pa.int64(), "lo": pa.int32(), "n": pa.int32(), "h": pa.int64(), "b": pa.int32(), "part": pa.binary()}
    for batch in batches:
        buf, offs = bytes_of(batch.column("text"))
        data = buf.tobytes()
        ids, keys = ids_of(batch.column("id"), LAST), ids_of(batch.column("rk"), 0)
        asked = batch.column("asked")
        row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(asked.offsets)))
        lo, n, h, look = (np.asarray(asked.flatten().field(c)).astype(np.int64) for c in ("lo", "n", "h", "look"))
        at = offs[row] + lo
        plain, hot = np.flatnonzero(look == 1), np.flatnonzero(look == 2)
        part = [data[at[i] : at[i] + n[i] + length - 1] for i in plain]
        out = [ids[row[plain]], keys[row[plain]], lo[plain], n[plain], h[plain], h[plain] % buckets]
        if len(hot):
            run = np.repeat(np.arange(len(hot)), n[hot])
            k = np.arange(len(run)) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
            size = n[hot] + length - 1
            first = np.cumsum(size) - size
            joined = np.frombuffer(b"".join(data[at[i] : at[i] + n[i] + length - 1] for i in hot), np.uint8)
            w = first[run] + k
            key = Rolling(joined, cache).of(w, w + length).view(np.int64)
            doc = ids[row[hot[run]]]
            order = np.lexsort((doc, key))
            new = np.append(True, key[order][1:] != key[order][:-1])
            settled = np.zeros(len(run), bool)
            settled[order] = doc[order] > doc[order][new][np.cumsum(new) - 1]
            bucket = np.where(settled, -1 - key % buckets, key % buckets)
            body = joined.tobytes()
            part += [b"" if s else body[x : x + length] for x, s in zip(w.tolist(), settled.tolist(), strict=True)]
            more = [doc, keys[row[hot[run]]], lo[hot[run]] + k, np.ones(len(run), np.int64), key, bucket]
            out = [np.concatenate(x) for x in zip(out, more, strict=True)]
        yield pa.record_batch([pa.array(v, types[c]) for c, v in zip(types, [*out, part], strict=True)], names=list(types))


def radix_windows(table: pa.Table, length: int, most: int = 1 << 20) -> pa.Table:
    """The last passes: windows of the runs of some anchors, eight bytes at a time."""
    if table.column("b")[0].as_py() < 0:
        return table.select(["id", "rk", "lo", "n"])
    h = np.asarray(table.column("h").combine_chunks())
    order = np.argsort(h, kind="stable")
    table = table.take(pa.array(order))
    h = h[order]
    ids, keys, lo, n = (np.asarray(table.column(c).combine_chunks()).astype(np.int64) for c in ("id", "rk", "lo", "n"))
    out = [[], [], [], []]
    bounds = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    total = np.cumsum(n)
    a = 0
    while a < len(bounds):
        # whole anchors, about `most` windows at a time
        base = total[bounds[a] - 1] if bounds[a] else 0
        b = a + 1
        while b < len(bounds) and total[(bounds[b + 1] if b + 1 < len(bounds) else len(h)) - 1] - base <= most:
            b += 1
        i, j = bounds[a], bounds[b] if b < len(bounds) else len(h)
        buf, offs = bytes_of(table.column("part").slice(i, j - i))
        buf = np.concatenate([buf, np.zeros(8, np.uint8)])
        run = np.repeat(np.arange(j - i), n[i:j])
        k = np.arange(len(run)) - np.repeat(np.cumsum(n[i:j]) - n[i:j], n[i:j])
        at = offs[run] + k
        group = np.cumsum(np.append(True, h[i + 1 : j] != h[i : j - 1]))[run].astype(np.int64)
        live = np.arange(len(run))
        for depth in range(0, length, 8):
            take = min(8, length - depth)
            digit = np.zeros(len(live), U)
            for x in range(take):
                digit = (digit << U(8)) | buf[at[live] + depth + x].astype(U)
            o = np.lexsort((digit, group[live]))
            live, digit = live[o], digit[o]
            g = group[live]
            new = np.ones(len(live), bool)
            new[1:] = (g[1:] != g[:-1]) | (digit[1:] != digit[:-1])
            label = np.cumsum(new)
            size = np.bincount(label)
            stay = size[label] > 1
            group[live] = label
            live = live[stay]
            if not len(live):
                break
        if len(live):
            doc = ids[i:j][run[live]]
            o = np.lexsort((doc, group[live]))
            live, doc = live[o], doc[o]
            g = group[live]
            new = np.append(True, g[1:] != g[:-1])
            hit = np.sort(live[doc > doc[new][np.cumsum(new) - 1]])
            # neighbouring windows of one run go as one
            first = np.append(True, (hit[1:] != hit[:-1] + 1) | (run[hit[1:]] != run[hit[:-1]])) if len(hit) else np.zeros(0, bool)
            head = hit[first]
            out[0].append(ids[i:j][run[head]])
            out[1].append(keys[i:j][run[head]])
            out[2].append((lo[i:j][run[head]] + k[head]).astype(np.int32))
            out[3].append(np.diff(np.append(np.flatnonzero(first), len(hit))).astype(np.int32))
        a = b
    cat = [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.int32, np.int32), strict=True)]
    return pa.table({"id": pa.array(cat[0]), "rk": pa.array(cat[1]), "lo": pa.array(cat[2]), "n": pa.array(cat[3])})


def each_bucket(batches, column: str, work):
    """work(rows) for each bucket of a partition; rows that only pass through (below 0) don't wait for the rest."""
    held = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        passing = pc.less(table[column], 0)
        settled = table.filter(passing)
        if settled.num_rows:
            yield from work(settled).to_batches()
        held.append(table.filter(pc.invert(passing)))
    table = pa.concat_tables(held) if held else None
    buckets = pc.unique(table[column]).to_pylist() if held else []
    for bucket in buckets:
        yield from work(table if len(buckets) == 1 else table.filter(pc.equal(table[column], bucket))).to_batches()


def erase(batches, length: int):
    """Cut the marked windows out of each text."""
    for batch in batches:
        buf, offs = bytes_of(batch.column("text"))
        data = buf.tobytes()
        marks = batch.column("marks")
        n_bytes, n_removed, n_spans, kept, spans = [], [], [], [], []
        for i in range(batch.num_rows):
            text = data[offs[i] : offs[i + 1]]
            got = marks[i].as_py()
            cut = []
            if got:
                pairs = np.array([(x["lo"], x["lo"] + x["n"] - 1 + length) for x in got], np.int64)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                reach = np.maximum.accumulate(pairs[:, 1])
                new = np.append(True, pairs[1:, 0] > reach[:-1])
                cut = list(zip(pairs[new, 0].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)].tolist(), strict=True))
            body, last = [], 0
            for s, e in cut:
                body.append(text[last:s])
                last = e
            body.append(text[last:])
            body = b"".join(body)
            n_bytes.append(len(text))
            n_removed.append(len(text) - len(body))
            n_spans.append(len(cut))
            kept.append(body)
            spans.append([{"start": s, "end": e} for s, e in cut])
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "spans"],
        )


def erase_repeats(docs: DataFrame, length: int = 50, gram: int = 20, sample: int = 64, frequent_runs: int = 1 << 16) -> DataFrame:
    """Remove each byte covered by a `length`-byte string that also starts in a smaller document.

    docs needs doc_id and text; texts are UTF-8 bytes and matches never cross documents. Strings
    are judged on the input, overlaps count. Returns doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept (bytes), kept_sha256 and spans (start, end in bytes).

    Whole runs are compared by 112 bits of digests, all other windows byte by byte. Buckets grow
    in number with the text and each is a task, so tasks stay near 30 MB. An anchor that has about
    frequent_runs runs or more, by the documents whose digest falls in one of `sample` parts, has
    its runs dealt out by their own digests; which anchors these are changes no result.
    Defined cases: a null text is empty; rows with one doc_id never erase one another; a null
    doc_id is above all others; texts shorter than length stay; repeated rows each get their row;
    a long text is cut like any other; columns other than doc_id and text are not looked at and
    not returned; an empty table gives no rows.
    """
    spark = docs.sparkSession
    if not 8 <= gram <= length or length > 200:
        raise ValueError("8 <= gram <= length <= 200")
    keyed = docs.select("doc_id", "text", row_key("doc_id", "text").alias("rk"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(partitions(spark), -(-total // (16 << 20)))
    tally = keyed.filter(F.pmod(F.xxhash64(F.lit(1), "rk"), F.lit(sample)) == 0).mapInArrow(lambda it: count_anchors(it, length, gram), "h long, n long")
    tally = tally.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") * sample >= frequent_runs)
    frequent = np.array([r.h for r in tally.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).collect()], np.int64).view(U)
    blocks = keyed.mapInArrow(lambda it: shipped_runs(it, length, gram, buckets, frequent), "bucket int, docs binary, runs binary")
    settled = blocks.repartitionById(buckets, F.pmod("bucket", F.lit(buckets)))
    settled = settled.mapInArrow(lambda it: each_bucket(it, "bucket", lambda t: settle_runs(t, frequent)), "id long, rk long, lo int, n int, h long, look int")
    runs = keep(settled, "suffix-runs")

    asked = runs.filter("look > 0").groupBy("id", "rk").agg(F.collect_list(F.struct("lo", "n", "h", "look")).alias("asked"))
    by_id = keyed.withColumn("id", F.coalesce("doc_id", F.lit(LAST)))
    contexts = by_id.join(asked, ["id", "rk"]).select("id", "rk", "text", "asked")
    contexts = contexts.mapInArrow(lambda it: cut_contexts(it, length, buckets), "id long, rk long, lo int, n int, h long, b int, part binary")
    dealt = contexts.repartitionById(buckets, F.pmod("b", F.lit(buckets)))
    windows = dealt.mapInArrow(lambda it: each_bucket(it, "b", lambda t: radix_windows(t, length)), "id long, rk long, lo int, n int")
    marked = keep(windows.unionByName(runs.filter("look = 0").select("id", "rk", "lo", "n")), "suffix-marks")
    drop(runs)

    marks = marked.groupBy("id", "rk").agg(F.collect_list(F.struct("lo", "n")).alias("marks"))
    joined = by_id.join(marks, ["id", "rk"], "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(lambda it: erase(it, length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, spans array<struct<start: long, end: long>>")
