"""Prefix trie of conversations: balanced parentheses per shard, spines that shards share merged after."""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, keep, partitions
from .kernels import bytes_of

#: Positions whose excess minimum is kept in one leaf of the range min-max tree.
BLOCK = 64
#: Turns of one shard, about, and conversation ids hashed at a time.
SHARD_TURNS, IDS = 400_000, 1 << 12
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
SPINE = "key binary, parent binary, place int, words long, ends_at boolean"
EMPTY = hashlib.sha256(b"").hexdigest()


class Parentheses:
    """A forest as a balanced sequence: opens[i] is where node i (in preorder) opens.

    find_close() jumps over blocks by the least excess in them, held in a binary tree.
    """

    def __init__(self, depth: np.ndarray):
        n = len(depth)
        # before node i opens, i nodes have opened and all of them but its depth[i] ancestors have closed
        self.opens = 2 * np.arange(n) - depth
        self.bits = np.zeros(2 * n, np.int8)
        self.bits[self.opens] = 1
        blocks = -(-2 * n // BLOCK)
        excess = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        excess[: 2 * n] = np.cumsum(2 * self.bits.astype(np.int32) - 1)
        self.excess = excess.reshape(blocks, BLOCK)
        self.base = 1 << max(0, (blocks - 1).bit_length())
        self.least = np.full(2 * self.base, np.iinfo(np.int32).max, np.int32)
        self.least[self.base : self.base + blocks] = self.excess.min(1)
        for k in range(self.base.bit_length() - 2, -1, -1):
            level = slice(1 << k, 2 << k)
            below = self.least[2 << k : 4 << k]
            self.least[level] = np.minimum(below[::2], below[1::2])
        leaf = np.flatnonzero((self.bits[:-1] == 1) & (self.bits[1:] == 0)) if n else np.zeros(0, np.int64)
        self.pairs = np.zeros(2 * n + 1, np.int64)
        self.pairs[leaf + 1] = 1
        self.pairs = np.cumsum(self.pairs)

    def find_close(self) -> np.ndarray:
        """The position of the parenthesis that closes each node: the first later one with less excess than its own."""
        out = np.zeros(len(self.opens), np.int64)
        for a in range(0, len(out), 1 << 15):
            out[a : a + (1 << 15)] = self._close(self.opens[a : a + (1 << 15)])
        return out

    def _close(self, p: np.ndarray) -> np.ndarray:
        block, at = p // BLOCK, p % BLOCK
        target = self.excess[block, at] - 1
        here = (self.excess[block] <= target[:, None]) & (np.arange(BLOCK) > at[:, None])
        inside = here.any(1)
        out = block * BLOCK + here.argmax(1)
        far = np.flatnonzero(~inside)
        if not len(far):
            return out
        node, want = block[far] + self.base, target[far]
        up = np.ones(len(far), bool)
        while up.any():  # climb until a later sibling holds the target
            right = node ^ 1
            hit = up & (node % 2 == 0) & (self.least[right] <= want)
            node = np.where(hit, right, np.where(up, node // 2, node))
            up &= ~hit
        while (down := node < self.base).any():
            left = np.minimum(2 * node, len(self.least) - 1)
            node = np.where(down, np.where(self.least[left] <= want, left, left + 1), node)
        out[far] = (node - self.base) * BLOCK + (self.excess[node - self.base] <= want[:, None]).argmax(1)
        return out

    def leaves(self, close: np.ndarray) -> np.ndarray:
        """How many pairs () lie between each node's parentheses, by rank."""
        return self.pairs[close] - self.pairs[self.opens]


class Trie:
    """The trie of sorted distinct paths. offs, keys, words: paths' ends, turns' keys (n x 2), code points.

    Node 0 is the root. Nodes stand in preorder: path after path, those of its turns that are below
    what it shares with the path before it.
    """

    def __init__(self, offs: np.ndarray, keys: np.ndarray, words: np.ndarray):
        length = np.diff(offs)
        path = np.repeat(np.arange(len(length)), length)
        at = np.arange(len(keys)) - offs[path]
        # where a turn differs from the one of the path before, or has none
        other = np.maximum(offs[np.maximum(path - 1, 0)] + at, 0)
        known = (path > 0) & (at < length[np.maximum(path - 1, 0)])
        same = known & (keys[np.minimum(other, len(keys) - 1)] == keys).all(1) if len(keys) else known
        broken = np.cumsum(~same)
        before = np.append(0, broken)[offs[:-1]]
        new = broken > before[path]
        self.depth = np.append(0, at[new] + 1)
        self.path = np.append(0, path[new])
        self.words = np.append(0, words[new])
        n = len(self.depth)
        # the parent is the last node before that is one level higher
        by_depth = np.sort(self.depth * n + np.arange(n))
        want = (self.depth - 1) * n + np.arange(n)
        self.parent = by_depth[np.searchsorted(by_depth, want, "right") - 1] % n
        self.parent[0] = -1
        shape = Parentheses(self.depth)
        close = shape.find_close()
        self.size = (close - shape.opens + 1) // 2
        self.leaves = shape.leaves(close)
        self.children = np.bincount(self.parent[1:], minlength=n)
        # the last new turn of a path is its end: none is a prefix of the one before it
        self.end = np.zeros(len(length), np.int64)
        self.end[path[new]] = np.arange(1, n)
        self.last_path = self.path[np.arange(n) + self.size - 1]

    def below(self, own: np.ndarray) -> np.ndarray:
        """Sums over each node's subtree, by cumulative sums in preorder."""
        total = np.append(0, np.cumsum(own))
        i = np.arange(len(own))
        return total[i + self.size] - total[i]

    def least(self, of_path: np.ndarray) -> np.ndarray:
        """Smallest value of the paths through each node."""
        table, k = [of_path], 1
        while 2 * k <= len(of_path):
            table.append(np.minimum(table[-1][:-k], table[-1][k:]))
            k *= 2
        span = self.last_path - self.path + 1
        out = np.zeros(len(span), of_path.dtype)
        level = np.floor(np.log2(span)).astype(int)
        for j in range(len(table)):
            at = level == j
            out[at] = np.minimum(table[j][self.path[at]], table[j][self.last_path[at] - (1 << j) + 1])
        return out

    def spine(self) -> np.ndarray:
        """Nodes on the first or the last path, the only ones that another shard may hold."""
        return (self.path == 0) | (self.last_path == len(self.end) - 1)


def paths_table(batches) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def path_arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = table["path"].combine_chunks() if isinstance(table["path"], pa.ChunkedArray) else table["path"]
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    offs = np.append(0, np.cumsum(np.diff(column.offsets.to_numpy()))).astype(np.int64)
    keys = np.ascontiguousarray(bytes_of(flat.field("key"))[0]).view(np.int64).reshape(-1, 2)
    return offs, keys, flat.field("words").to_numpy().astype(np.int64)


def chain(keys: np.ndarray) -> list[bytes]:
    """A key for each prefix of a path, the root's first."""
    h, out = hashlib.sha256(), []
    for k in [b"", *(x.tobytes() for x in keys)]:
        h.update(k)
        out.append(h.digest()[:16])
    return out


SHARD_ROW = NODE + ", shard int, key binary, parent_key binary, is_spine boolean, words long, path array<struct<key:binary,words:int>>"


def shard_nodes(batches):
    """One shard: its nodes. Inner ones are final; a spine node has what its inner part adds up to.

    Spine rows also carry keys, so that the parts that several shards hold can meet.
    """
    from pyspark import TaskContext

    table = paths_table(batches)
    if table is None:
        return
    shard = TaskContext.get().partitionId()
    offs, keys, words = path_arrays(table)
    trie = Trie(offs, keys, words)
    n = len(trie.depth)
    copies = np.bincount(trie.end, table["copies"].to_numpy(), n).astype(np.int64)
    convs, least = trie.below(copies), trie.least(table["conv_id"].to_numpy())
    spine = trie.spine()
    leaf = (trie.children == 0) & ~spine
    own = np.where(spine, 0, (convs - 1) * trie.words)
    sha = np.full(n, EMPTY, object)
    sha[trie.end] = table["ends_sha256"].to_pylist()
    inner_child = np.bincount(trie.parent[1:], ~spine[1:], n).astype(np.int64)
    key: list = [None] * n
    # the path of a spine node is that of the first or of the last row
    for p in {0, len(offs) - 2}:
        prefix = chain(keys[offs[p] : offs[p + 1]])
        through = np.flatnonzero((trie.path <= p) & (trie.last_path >= p))
        for i in through:
            key[i] = prefix[trie.depth[i]]
    parent_key = [key[p] if p >= 0 else None for p in trie.parent]
    columns = {
        "conv_id": least, "depth": trie.depth, "n_convs": convs, "n_children": np.where(spine, inner_child, trie.children),
        "n_leaves": trie.below(leaf.astype(np.int64)), "saved_tokens": trie.below(own), "words": trie.words,
    }
    arrays = {c: pa.array(v.astype(np.int64)) for c, v in columns.items()}
    arrays["n_leaves"] = pa.array(np.where(spine, columns["n_leaves"], trie.leaves).astype(np.int64))
    parent = pa.array(np.where(trie.parent >= 0, least[np.maximum(trie.parent, 0)], 0), mask=trie.parent < 0)
    arrays |= {"parent_conv_id": parent, "ends_sha256": pa.array(sha.tolist(), pa.string()), "shard": pa.array(np.full(n, shard, np.int32)), "is_spine": pa.array(spine)}
    arrays |= {"key": pa.array([k if s else None for k, s in zip(key, spine, strict=True)], pa.binary()), "parent_key": pa.array(parent_key, pa.binary())}
    # the two outer paths go along once each, with the node that ends them
    ends = {int(trie.end[p]): p for p in (0, len(offs) - 2)}
    kind = table["path"].type
    arrays["path"] = pa.array([table["path"][ends[i]].as_py() if i in ends else None for i in range(n)], kind)
    names = [c.split()[0] for c in SHARD_ROW.split(", ")]
    whole = pa.record_batch([arrays[c] for c in names], names=names)
    for a in range(0, n, 1 << 15):
        yield whole.slice(a, 1 << 15)


def merge_spines(batches):
    """Merged spine nodes (one row for each key, and the outer paths) to whole sums over the spines.

    The outer paths are sorted and distinct, so they make a trie of their own; a node's inner sums
    are whole already, and what spine nodes below it add comes from the same cumulative arrays.
    """
    table = paths_table(batches)
    if table is None:
        return
    rows = {r["key"]: r for r in table.to_pylist()}
    ends = table.filter(table["path"].is_valid())
    paths = sorted({tuple(x["key"] for x in p): p for p in ends["path"].to_pylist()}.items())
    offs = np.append(0, np.cumsum([len(k) for k, _ in paths])).astype(np.int64)
    flat = b"".join(x for k, _ in paths for x in k)
    keys = np.frombuffer(flat, np.int64).reshape(-1, 2)
    words = np.array([x["words"] for _, p in paths for x in p], np.int64)
    trie = Trie(offs, keys, words)
    prefixes = [chain(keys[offs[p] : offs[p + 1]]) for p in range(len(paths))]
    key = [prefixes[p][d] for p, d in zip(trie.path, trie.depth, strict=True)]
    mine = [rows[k] for k in key]
    get = lambda c: np.array([r[c] for r in mine], np.int64)
    convs, inner = get("n_convs"), get("n_children")
    children = inner + trie.children
    leaves = get("n_leaves") + trie.below((children == 0).astype(np.int64))
    saved = get("saved_tokens") + trie.below((convs - 1) * trie.words)
    least = get("conv_id")
    parent = pa.array(np.where(trie.parent >= 0, least[np.maximum(trie.parent, 0)], 0), mask=trie.parent < 0)
    columns = [pa.array(x) for x in (least, trie.depth.astype(np.int64))]
    columns += [parent, *[pa.array(x.astype(np.int64)) for x in (convs, children, leaves, saved)], pa.array([r["ends_sha256"] for r in mine], pa.string()), pa.array(key, pa.binary())]
    yield pa.record_batch(columns, names=[*[c.split()[0] for c in NODE.split(", ")], "key"])


def hash_ends(batches):
    """Rows sorted by path_key and conv_id to runs of equal paths: how many, the smallest id, the digest of all ids.

    The first and the last run of a task may go on in others: they leave as parts, of at most IDS
    ids each, without a digest.
    """
    run: dict = {}
    first = True

    def leave(whole: bool) -> list[dict]:
        if not run:
            return []
        base = {"path_key": run["key"], "path": run["path"]}
        if whole:
            return [base | {"copies": run["n"], "conv_id": run["min"], "ends_sha256": hashlib.sha256(",".join(run["ids"]).encode()).hexdigest(), "ids": None}]
        parts = [run["ids"][a : a + IDS] for a in range(0, len(run["ids"]), IDS)]
        return [base | {"copies": len(p), "conv_id": int(p[0]), "ends_sha256": None, "ids": ",".join(p)} for p in parts]

    for batch in batches:
        out: list[dict] = []
        keys, ids = batch.column("path_key").to_pylist(), batch.column("conv_id").to_pylist()
        for i, k in enumerate(keys):
            if run.get("key") != k:
                out += leave(not first)
                first = first and not run
                run.clear()
                run |= {"key": k, "path": batch.column("path")[i].as_py(), "n": 0, "min": ids[i], "ids": []}
            run["n"] += 1
            run["ids"].append(str(ids[i]))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=RUN)
    if out := leave(False):
        yield pa.RecordBatch.from_pylist(out, schema=RUN)


PATH = pa.list_(pa.struct([("key", pa.binary()), ("words", pa.int32())]))
RUN = pa.schema([("path_key", pa.binary()), ("path", PATH), ("copies", pa.int64()), ("conv_id", pa.int64()), ("ends_sha256", pa.string()), ("ids", pa.string())])
RUNS = "path_key binary, path array<struct<key:binary,words:int>>, copies long, conv_id long, ends_sha256 string, ids string"


def join_ends(batches):
    """Parts sorted by path_key and first id, each path's in one task: one row for each path, hashed part by part."""
    now: dict = {}
    sha = hashlib.sha256()
    for batch in batches:
        out: list[dict] = []
        for r in batch.to_pylist():
            if now.get("path_key") != r["path_key"]:
                if now:
                    out.append(now | {"ends_sha256": sha.hexdigest()})
                now, sha = r | {"ids": None, "copies": 0}, hashlib.sha256()
            sha.update((b"," if now["copies"] else b"") + r["ids"].encode())
            now["copies"] += r["copies"]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=RUN)
    if now:
        yield pa.RecordBatch.from_pylist([now | {"ends_sha256": sha.hexdigest()}], schema=RUN)


def shared_turns(conv: Column, most: int = 6) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % most).cast("int")


def grafted(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, path): each conversation's turns, its first h replaced by the first h of its group's first one.

    turns: conv_id, turn, role, text; c's group begins at c - c % group, h = crc32(c) % most. A path
    is an array of (key, words): a digest of role and text, the text's code points.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = turns.filter("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), key.alias("key"), F.char_length(text).alias("words"))
    # null turns come first in array_sort() of structs whose first field tells them from others
    item = F.struct(F.col("turn").isNotNull().alias("given"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "key", "words")
    own = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("t"))
    own = keep(own.select("conv_id", F.transform("t", lambda x: F.struct(x["key"].alias("key"), x["words"].alias("words"))).alias("own"), shared_turns(F.col("conv_id"), most).alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base")), "conversations")
    heads = own.filter(F.col("conv_id") == F.col("base")).select("base", F.slice("own", 1, most - 1).alias("head"))
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<key:binary,words:int>>")), F.lit(1), F.col("h"))
    rest = F.when(F.size("own") > F.col("h"), F.slice("own", F.col("h") + 1, F.size("own"))).otherwise(F.array().cast("array<struct<key:binary,words:int>>"))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("path"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the paths (conv_id, path) as grafted() makes them.

    Columns as NODE says: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Equal paths become one row first, whatever their number: rows are sorted by path and id over
    all tasks, each hashes its runs, and only runs at a task's edges meet again, as parts of up to
    IDS ids (a digest of ids in order is one chain by nature; the parts pass through, they are
    not held). Distinct paths are range-partitioned by their turns, so a shard holds neighbours
    whatever they share, about SHARD_TURNS turns of them. It writes its trie as balanced
    parentheses: find_close delimits subtrees, ranks of pairs count leaves, cumulative sums give
    members and savings. Nodes on a shard's first and last path may lie in other shards as well;
    those spines, two paths a shard, are merged by key and summed in a trie of their own.

    A path is one row, 20 bytes a turn; a conversation's texts are not gathered, only digests.
    """
    spark = conversations.sparkSession
    n = partitions(spark)
    keyed = conversations.withColumn("path_key", F.unhex(F.md5(F.aggregate("path", F.lit(b""), lambda acc, x: F.unhex(F.md5(F.concat(acc, x["key"])))))))
    keyed = keep(keyed, "paths-keyed")
    runs = keep(keyed.repartitionByRange(n, "path_key", "conv_id").sortWithinPartitions("path_key", "conv_id").mapInArrow(hash_ends, RUNS), "path-runs")
    parts = runs.filter("ids is not null").repartition(n, "path_key").sortWithinPartitions("path_key", "conv_id").mapInArrow(join_ends, RUNS)
    paths = keep(runs.filter("ids is null").unionByName(parts).drop("path_key", "ids"), "paths")
    turns = paths.agg(F.sum(F.size("path").cast("long") + 1)).first()[0] or 0
    shards = max(n, -(-int(turns) // SHARD_TURNS))
    by = F.transform("path", lambda x: x["key"])
    nodes = keep(paths.repartitionByRange(shards, by).sortWithinPartitions(by).mapInArrow(shard_nodes, SHARD_ROW), "trie-shards")
    names = [c.split()[0] for c in NODE.split(", ")]
    spines = nodes.filter("is_spine")
    # a path ends in one shard, so ends_sha256 differs from that of no ids in one row at most
    sums = spines.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.coalesce(F.max(F.when(F.col("ends_sha256") != EMPTY, F.col("ends_sha256"))), F.lit(EMPTY)).alias("ends_sha256"), F.max("path").alias("path"),
    )
    merged = keep(sums.repartition(1).mapInArrow(merge_spines, NODE + ", key binary"), "trie-spines")
    # inner nodes below a spine node take the merged id of their parent, found by shard and key
    local = spines.select("shard", F.col("key").alias("parent_key")).join(merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent")), "parent_key")
    inner = nodes.filter("not is_spine")
    below = inner.filter("parent_key is not null").drop("parent_conv_id").join(local, ["shard", "parent_key"]).withColumnRenamed("_parent", "parent_conv_id")
    drop(keyed, runs)
    return inner.filter("parent_key is null").select(*names).unionByName(below.select(*names)).unionByName(merged.select(*names))
