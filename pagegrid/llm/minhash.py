"""MinHash near-dedup: one-permutation hashing, optimal densification, star-shaped candidate edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop, keep, partitions, skewed_lookup
from .components import connected_components
from .kernels import Rolling, U, blanks, bytes_of, chunks, ids_of, lower_table, mix, spans

CHUNK = 2 << 20


def shingle_sets(buf: np.ndarray, offs: np.ndarray, words: int, cache: dict):
    """For each row the sorted distinct hashes of its `words`-word shingles, as (values, offsets).

    A row with fewer words has its whole sequence as one shingle; one without words has none.
    """
    with np.errstate(over="ignore"):
        n = len(offs) - 1
        starts, ends, row = spans(buf, offs, blanks())
        each = Rolling(lower_table()[buf], cache).of(starts, ends)
        per_row = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
        first = np.cumsum(per_row) - per_row
        full = np.maximum(per_row - words + 1, 0)
        count = np.where(full > 0, full, (per_row > 0).astype(np.int64))
        owner = np.repeat(np.arange(n), count)
        at = first[owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
        have = np.minimum(per_row, words)[owner]
        h = have.astype(U)
        padded = np.concatenate([each, np.zeros(words, U)])
        for k in range(words):
            h = np.where(k < have, mix(h * U(0x9FB21C651E98DF25) + padded[at + k]), h)
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
        sizes = np.bincount(owner, minlength=n) if len(owner) else np.zeros(n, np.int64)
        return h, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def densify_order(bins: int, seed: int) -> np.ndarray:
    """For each bin the order in which it asks the other bins for a value."""
    rng = np.random.default_rng(seed)
    return np.argsort(rng.random((bins, bins)), axis=1)


def signature(values: np.ndarray, bins: int, order: np.ndarray) -> np.ndarray:
    """Least hash of each bin of one permutation; an empty bin copies the first filled bin of its own order."""
    where = (values >> U(64 - bins.bit_length() + 1)).astype(np.int64)
    new = np.append(True, where[1:] != where[:-1])
    sig, filled = np.zeros(bins, U), np.zeros(bins, bool)
    sig[where[new]], filled[where[new]] = values[new], True
    empty = np.flatnonzero(~filled)
    if len(empty):
        sig[empty] = sig[order[empty, filled[order[empty]].argmax(axis=1)]]
    return sig


def signatures(batches, words: int, bins: int, rows: int, seed: int):
    """Per document: its set's size, its digest and a 64-bit key for each band."""
    order, cache = densify_order(bins, seed), {}
    salt = mix(np.arange(1, bins + 1, dtype=U) + U(seed << 32))
    with np.errstate(over="ignore"):
        for batch in batches:
            buf_all, offs_all = bytes_of(batch.column("text"))
            sizes, d1, d2, keys = [], [], [], []
            for a, b in chunks(offs_all, CHUNK):
                values, offs = shingle_sets(buf_all[offs_all[a] : offs_all[b]], offs_all[a : b + 1] - offs_all[a], words, cache)
                for i in range(b - a):
                    v = values[offs[i] : offs[i + 1]]
                    sizes.append(len(v))
                    d1.append(v.sum(dtype=U))
                    d2.append(mix(v).sum(dtype=U))
                    if len(v):
                        sig = signature(v, bins, order)
                        keys.append(mix(mix(sig ^ salt).reshape(-1, rows).sum(axis=1, dtype=U)).view(np.int64))
                    else:
                        keys.append(None)
            yield pa.record_batch(
                [batch.column("id"), batch.column("rk"), pa.array(sizes, pa.int64()), pa.array(np.array(d1, U).view(np.int64)), pa.array(np.array(d2, U).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "rk", "n", "d1", "d2", "bands"],
            )


def shared_with(index: tuple, own: np.ndarray, n: int) -> np.ndarray:
    """How many values of the set `own` each of n held sets has; index: (values in order, holders)."""
    values, holders = index
    first, last = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
    count = last - first
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return np.bincount(holders[at], minlength=n)


def stray_links(batches, words: int, percent: int):
    """Links of strays: rows come by (band, block, part), each group's strays (role 0) first.

    A group holds a bounded number of strays, and the other members stream past them. A pair is
    compared on full sets unless it has one label, was compared as center and member, shares an
    earlier band, or one set is too small to be `percent` of their union. The strays' sets are
    one inverted index, so a member is compared with all of them at once.
    """
    cache: dict = {}
    group, held = None, []
    index = ids = labels = keys = sizes = None
    for batch in batches:
        buf_all, offs_all = bytes_of(batch.column("text"))
        col = {c: ids_of(batch.column(c), 0) for c in ("band", "block", "part", "role", "cid", "label", "center", "minor")}
        key = [np.asarray(x.values) for x in batch.column("bands")]
        u, v = [], []
        for a, b in chunks(offs_all, CHUNK):
            values, offs = shingle_sets(buf_all[offs_all[a] : offs_all[b]], offs_all[a : b + 1] - offs_all[a], words, cache)
            for i in range(a, b):
                own = values[offs[i - a] : offs[i - a + 1]]
                if (now := (col["band"][i], col["block"][i], col["part"][i])) != group:
                    group, held = now, []
                    ids = index = None
                if col["role"][i] == 0:
                    held.append((col["cid"][i], col["label"][i], key[i], own))
                    continue
                if ids is None:
                    ids, labels = (np.array([h[k] for h in held]) for k in (0, 1))
                    keys, sizes = np.stack([h[2] for h in held]), np.array([len(h[3]) for h in held])
                ok = (labels != col["label"][i]) & (ids != col["center"][i]) & (col["cid"][i] != col["center"][i])
                if col["minor"][i]:
                    ok &= ids < col["cid"][i]
                ok &= 100 * np.minimum(sizes, len(own)) >= percent * np.maximum(sizes, len(own))
                some = np.flatnonzero(ok)
                if not len(some):
                    continue
                equal = keys[some] == key[i]
                some = some[key[i][equal.argmax(1)] == group[0]]
                if not len(some):
                    continue
                if index is None:
                    each = np.concatenate([h[3] for h in held])
                    order = np.argsort(each, kind="stable")
                    index = each[order], np.repeat(np.arange(len(held), dtype=np.int32), sizes)[order]
                same = shared_with(index, own, len(held))[some]
                linked = some[100 * same >= percent * (sizes[some] + len(own) - same)]
                u.extend([col["cid"][i]] * len(linked))
                v.extend(ids[linked])
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def compare_to_center(batches, words: int):
    """Rows of (center, part, member flag, id, text), each center's text before its members'."""
    cache: dict = {}
    now, center = None, np.zeros(0, U)
    for batch in batches:
        buf_all, offs_all = bytes_of(batch.column("text"))
        groups = np.stack([ids_of(batch.column("center"), 0), ids_of(batch.column("part"), 0)], 1)
        ids, member = ids_of(batch.column("id"), 0), ids_of(batch.column("member"), 0)
        out = [[], [], [], []]
        for a, b in chunks(offs_all, CHUNK):
            values, offs = shingle_sets(buf_all[offs_all[a] : offs_all[b]], offs_all[a : b + 1] - offs_all[a], words, cache)
            for i in range(a, b):
                v = values[offs[i - a] : offs[i - a + 1]]
                key = (groups[i, 0], groups[i, 1])
                if not member[i]:
                    now, center = key, v
                    continue
                if now != key:
                    raise RuntimeError("a center's text is missing")
                at = np.searchsorted(center, v)
                same = int((center[np.minimum(at, max(len(center) - 1, 0))] == v).sum()) if len(center) else 0
                for x, y in zip(out, (ids[i], key[0], same, len(center) + len(v) - same), strict=True):
                    x.append(y)
        yield pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["id", "center", "shared", "joint"])


def _verified(edges: DataFrame, texts: DataFrame, words: int, percent: int, part_rows: int = 512) -> DataFrame:
    """(id, center, linked) for edges (id, center), by the full sets of both.

    A center's members are dealt to parts of about part_rows, each with a copy of its text.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("k") / part_rows)).cast("int")
    counts = keep(edges.groupBy("center").agg(F.count("*").alias("k")), "minhash-stars")
    members = skewed_lookup(edges, counts.withColumn("w", F.col("k")), ["center"], "w")
    members = members.select("id", "center", F.pmod(F.xxhash64("id"), parts).cast("long").alias("part"), F.lit(1).cast("long").alias("member"))
    centers = counts.select(F.col("center").alias("id"), "center", F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long"))).alias("part"), F.lit(0).cast("long").alias("member"))
    dealt = texts.join(members.unionByName(centers), "id").select("center", "part", "member", "id", "text")
    dealt = dealt.repartition(partitions(edges.sparkSession), "center", "part").sortWithinPartitions("center", "part", "member")
    got = dealt.mapInArrow(lambda it: compare_to_center(it, words), "id long, center long, shared long, joint long")
    out = keep(got.select("id", "center", (F.lit(100) * F.col("shared") >= F.lit(percent) * F.col("joint")).alias("linked")).distinct(), "minhash-compared")
    drop(counts)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, bins: int = 128, rows: int = 4, seed: int = 3, block_shingles: int = 1 << 20, part_rows: int = 4096) -> DataFrame:
    """(doc_id, rk, n_shingles, component_id, kept): components of texts with Jaccard >= percent / 100.

    docs needs doc_id and text. A text's set holds the distinct `words`-word shingles of its
    lower-cased (A-Z) words. Texts with equal sets form a class. Signatures have `bins` bins of
    one permutation; `rows` bins make a band, and classes that agree in a band share a bucket.

    In each bucket the class that shares most buckets with others is the center of a star; every
    other member is compared with it, on full sets. Members that this leaves outside the bucket's
    largest component are then compared with the members of other components, on full sets unless
    the sets' sizes alone rule out a link. Strays wait in blocks of about block_shingles shingles while
    parts of the bucket stream past them; only links leave the task.

    Every linked pair that shares a bucket is found. How often a pair shares none, see README.

    rk is xxhash64(doc_id, text). Defined cases: texts that are null or have no words link with
    nothing; rows with a null id have a null component_id and are kept; rows that share an id
    are one node with the links of all of them; a text of any length is one set, whole; other columns
    are not looked at; an empty table gives no rows.
    """
    if bins & (bins - 1) or bins % rows:
        raise ValueError("bins must be a power of two and a multiple of rows")
    keyed = docs.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("rk"), "text")
    sigs = keep(keyed.mapInArrow(lambda it: signatures(it, words, bins, rows, seed), "id long, rk long, n long, d1 long, d2 long, bands array<long>"), "minhash-signatures")
    digest = ["n", "d1", "d2"]
    sets = sigs.filter("n > 0 and id is not null")
    grouped = sets.groupBy(*digest).agg(F.min(F.struct("id", "rk")).alias("rep"), F.count("*").alias("rows"), F.first("bands").alias("bands"))
    classes = keep(grouped.withColumn("cid", F.monotonically_increasing_id()), "minhash-classes")
    banded = classes.select("cid", "n", F.explode(F.array_distinct("bands")).alias("band"))
    sizes = keep(banded.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1").withColumn("w", F.col("m")), "minhash-sizes")
    shared = keep(skewed_lookup(banded, sizes, ["band"], "w"), "minhash-shared")
    known = shared.join(shared.groupBy("cid").agg(F.sum("m").alias("fame")), "cid")
    centers = keep(known.groupBy("band").agg(F.max(F.struct("fame", (-F.col("cid")).alias("c"))).alias("x"), F.count("*").alias("w")).select("band", (-F.col("x.c")).alias("center"), "w"), "minhash-bands")
    buckets = keep(skewed_lookup(shared.select("band", "cid", "n"), centers, ["band"], "w"), "minhash-buckets")
    wanted = classes.join(buckets.select("cid").distinct(), "cid").select("rep.id", "rep.rk", "cid")
    texts = keep(keyed.join(wanted, ["id", "rk"]).select(F.col("cid").alias("id"), "text"), "minhash-texts")
    drop(sizes, shared)

    starred = _verified(buckets.filter("cid <> center").select(F.col("cid").alias("id"), "center").distinct(), texts, words, percent)
    links = starred.filter("linked").select(F.col("id").alias("u"), F.col("center").alias("v"))
    parts = keep(connected_components(links), "minhash-parts")
    labelled = keep(buckets.join(parts.withColumnRenamed("node", "cid"), "cid", "left").select("band", "center", "cid", "n", F.coalesce("component", "cid").alias("label")), "minhash-labelled")
    tally = labelled.groupBy("band", "label").agg(F.count("*").alias("c"), F.sum("n").alias("shingles"))
    mixed = tally.groupBy("band").agg(
        F.count("*").alias("labels"), F.max(F.struct("c", "label", "shingles")).alias("x"), F.sum("c").alias("w"), F.sum("shingles").alias("all")
    ).filter("labels > 1 and w > 2")
    blocks = F.greatest(F.ceil((F.col("all") - F.col("x.shingles")) / block_shingles), F.lit(1)).cast("int")
    parts_of = F.ceil(F.col("w") / part_rows).cast("int")
    mixed = keep(mixed.select("band", F.col("x.label").alias("main"), blocks.alias("blocks"), parts_of.alias("parts"), "w"), "minhash-mixed")
    rows_of = skewed_lookup(labelled, mixed, ["band"], "w").withColumn("minor", (F.col("label") != F.col("main")).cast("long"))
    before = Window.partitionBy("band").orderBy("cid").rowsBetween(Window.unboundedPreceding, -1)
    block = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / block_shingles).cast("int")
    strays = rows_of.filter("minor = 1").withColumn("block", block).withColumn("role", F.lit(0))
    strays = strays.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    passing = rows_of.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).withColumn("role", F.lit(1))
    passing = passing.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["band", "block", "part", "role", "cid", "label", "center", "minor"]
    dealt = keep(strays.select(*columns).unionByName(passing.select(*columns)), "minhash-strays")
    dealt = dealt.join(classes.select("cid", "bands"), "cid").join(texts.withColumnRenamed("id", "cid"), "cid")
    dealt = dealt.repartition(partitions(docs.sparkSession), "band", "block", "part").sortWithinPartitions("band", "block", "part", "role", "cid")
    new = keep(dealt.mapInArrow(lambda it: stray_links(it, words, percent), "u long, v long"), "minhash-links")
    links = links.unionByName(new)
    if new.take(1):
        parts = keep(connected_components(links), "minhash-parts")

    by_class = skewed_lookup(sets.select("id", *digest), classes.select(*digest, "cid", "rows"), digest, "rows")
    shared = by_class.groupBy("id").agg(F.min("cid").alias("v"), F.max("cid").alias("last")).filter("v < last")
    ties = by_class.join(shared, "id").filter("cid > v").select(F.col("cid").alias("u"), "v")
    if ties.take(1):
        parts = keep(connected_components(links.unionByName(ties)), "minhash-parts")
    labelled = classes.join(parts.withColumnRenamed("node", "cid"), "cid", "left").select(*digest, "rows", F.col("rep.id").alias("rep"), F.coalesce("component", "cid").alias("label"))
    least = labelled.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("w"))
    answer = skewed_lookup(labelled, least, ["label"], "w").select(*digest, "rows", "component_id")
    found = skewed_lookup(sets.select("id", "rk", *digest), answer, digest, "rows")
    rest = sigs.filter("not (n > 0 and id is not null)").select("id", "rk", *digest, F.col("id").alias("component_id"))
    every = found.select("id", "rk", *digest, "component_id").unionByName(rest)
    return every.select(F.col("id").alias("doc_id"), "rk", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
