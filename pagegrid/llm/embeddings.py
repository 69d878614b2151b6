"""Embedding near-dedup: a small-world graph per shard, every shard queried, links checked exactly."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep, skewed_lookup
from .components import connected_components
from .hnsw import Graph

#: What single precision may get wrong; candidates below the threshold by less are checked in double.
SLACK = 1e-4


def build_shard(table: pa.Table, m: int) -> pa.Table:
    d = table.column("dim")[0].as_py()
    order = np.argsort(np.asarray(table.column("cid").combine_chunks()), kind="stable")
    table = table.take(pa.array(order))
    flat = table.column("embedding").combine_chunks().flatten()
    raw = np.asarray(flat, np.float64).reshape(-1, d)
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    blob, sizes = Graph(unit, m).build().dump()
    cid, rows = (np.asarray(table.column(c).combine_chunks()).astype(np.int64) for c in ("cid", "rows"))
    return pa.table({"dim": pa.array([d], pa.int32()), "shard": table.column("shard").slice(0, 1), "cids": [cid.tobytes()], "rows": [rows.tobytes()], "vectors": [unit.tobytes()], "graph": [blob], "sizes": pa.array([sizes], pa.list_(pa.int32()))})


def build_shards(batches, m: int):
    """Rows in the order of (dim, shard): a graph for each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        dim, shard = batch.column("dim").to_numpy(), batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero((dim[1:] != dim[:-1]) | (shard[1:] != shard[:-1])) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and a < b and any(held[0].column(c)[0] != batch.column(c)[int(a)] for c in ("dim", "shard")):
                yield from build_shard(pa.Table.from_batches(held), m).to_batches()
                held = []
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield from build_shard(pa.Table.from_batches(held), m).to_batches()


def planted(vectors: np.ndarray, at: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """For each vector at[i] another one, in a random direction, whose cosine with it is `cosine`."""
    v = vectors[at].astype(np.float64)
    away = rng.normal(size=v.shape)
    away -= np.einsum("kd,kd->k", away, v)[:, None] * v
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    return (cosine * v + np.sqrt(1 - cosine**2) * away).astype(np.float32)


def audit_beam(query: Graph, other: Graph, beam: int, pick: np.ndarray, own: bool, recall: float, closest: int | None = None, least: float | None = None) -> tuple[int, float]:
    """Widen the beam until searches find enough of the true nearest others, known by brute force.

    All picked rows are audited, or the `closest` of them whose nearest other is most similar. With
    `least`, only those with a link, of that similarity or more; where there are fewer than `closest`,
    as many vectors as are missing are planted at just that similarity to rows of the other side and
    searched for. So the audit always has evidence, of what the search is for: beams that find
    nearest others far below a link would be many times as wide. Returns beam and recall.
    """
    n = len(other.v)
    if not len(pick) or n < 2:
        return beam, 1.0
    best = np.zeros(len(pick))
    for a in range(0, len(pick), 512):
        sims = query.v[pick[a : a + 512]] @ other.v.T
        if own:
            sims[np.arange(len(sims)), pick[a : a + 512]] = -np.inf
        best[a : a + 512] = sims.max(1)
    if closest is not None:
        first = np.argsort(-best, kind="stable")[:closest]
        pick, best = pick[first], best[first]
    extra, target = np.zeros((0, other.v.shape[1]), np.float32), np.zeros(0, np.int64)
    if least is not None:
        linked, wanted = best >= least, closest or len(pick)
        rng = np.random.default_rng([n, len(query.v), len(pick)])
        pick, best = pick[linked], best[linked]
        if other.v.shape[1] > 1:
            target = rng.permutation(n)[: wanted - len(pick)]
            extra = planted(other.v, target, least, rng)
    while True:
        found = np.zeros(0, bool)
        if len(pick):
            start = pick[:, None] if own else other.entry(0, query.v[pick])[:, None]
            ids, got = other.search(0, query.v[pick], start, min(beam, n))
            if own:
                got = np.where(ids == pick[:, None], -np.inf, got)
            found = got.max(1) >= best - 1e-6
        if len(target):
            ids, got = other.search(0, extra, other.entry(0, extra)[:, None], min(beam, n))
            # a beam full of links is compared with all rows anyway
            found = np.append(found, (ids == target[:, None]).any(1) | (got >= least - SLACK).all(1))
        share = float(found.mean()) if len(found) else 1.0
        if share >= recall or beam >= n:
            return beam, share
        beam *= 2


class Sets:
    """Disjoint sets over 0..n-1; a whole array of members joins at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while not np.array_equal(up := self.parent[r], r):
            r = up
        self.parent[x] = r
        return r

    def join(self, x: np.ndarray) -> None:
        r = self.roots(x)
        self.parent[r] = r.min()

    def join_pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.roots(a), self.roots(b)
            left = x != y
            if not left.any():
                return
            a, b, x, y = a[left], b[left], x[left], y[left]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def link_shards(table: pa.Table, m: int, least: float, beam: int, audit: int, recall: float) -> pa.Table:
    """Links between two shards (or inside one), from both sides.

    Of a seeded sample of 16 x audit rows of each side, the `audit` with the nearest others are
    audited where these are links, and planted ones besides (audit_beam), and the beam is widened
    until both sides pass. Rows whose beam is filled by links belong to large groups of near copies: they are
    compared with all rows of the other side in blocks, and only counts and sets are kept, so
    memory doesn't grow with a group's pairs. All other rows have fewer links than the beam is wide.

    Emits, per class with a link, how many rows it links to and the least class of its component
    in this task; and one row with a null cid and the least recall found.
    """
    d = table.column("dim")[0].as_py()
    sides = []
    for i in np.argsort(table.column("shard").to_numpy()):
        row = {c: table.column(c)[int(i)] for c in table.column_names}
        unit = np.frombuffer(row["vectors"].as_buffer(), np.float64).reshape(-1, d)
        ids = np.frombuffer(row["cids"].as_buffer(), np.int64)
        weight = np.frombuffer(row["rows"].as_buffer(), np.int64)
        sides.append((ids, weight, unit, Graph.load(unit, row["graph"].as_buffer(), row["sizes"].as_py(), m)))
    own = len(sides) == 1
    (ids_a, w_a, u_a, g_a), (ids_b, w_b, u_b, g_b) = sides[0], sides[-1]
    n_a, n_b = len(u_a), len(u_b)
    near = least - SLACK
    found = 1.0
    for query, other, rows in ((g_a, g_b, n_a), (g_b, g_a, n_b))[: 1 if own else 2]:
        pick = np.random.default_rng([n_a, n_b, rows]).permutation(rows)[: 16 * audit]
        beam, share = audit_beam(query, other, beam, pick, own, recall, audit, least)
        found = min(found, share)

    a, b, full_a = g_b.within(g_a.v, near, beam, np.arange(n_a) if own else None)
    if own:
        a, b, full_b = np.concatenate([a, b]), np.concatenate([b, a]), full_a
    else:
        b2, a2, full_b = g_a.within(g_b.v, near, beam)
        a, b = np.concatenate([a, a2]), np.concatenate([b, b2])
    code = np.unique((a * n_b + b)[~(full_a[a] | full_b[b])])
    a, b = code // n_b, code % n_b
    if own:
        a, b = a[a != b], b[a != b]
    exact = np.concatenate([np.einsum("kd,kd->k", u_a[a[i : i + 65536]], u_b[b[i : i + 65536]]) for i in range(0, len(a), 65536)]) if len(a) else np.zeros(0)
    a, b = a[exact >= least], b[exact >= least]
    shift = 0 if own else n_a
    links = np.zeros(n_a + (0 if own else n_b), np.int64)
    links[:n_a] += np.bincount(a, weights=w_b[b], minlength=n_a).astype(np.int64)
    if not own:
        links[shift:] += np.bincount(b, weights=w_a[a], minlength=n_b).astype(np.int64)
    sets = Sets(len(links))
    sets.join_pairs(a, b + shift)

    # the full rows of one side against the whole other side; then those of the other against what is left
    turns = ((full_a, u_a, g_a.v, w_a, 0, u_b, g_b.v, w_b, shift, np.ones(n_b, bool)), (full_b, u_b, g_b.v, w_b, shift, u_a, g_a.v, w_a, 0, ~full_a))
    for full, mine, mine_v, w_mine, at_mine, other, other_v, w_other, at_other, open_ in turns[: 1 if own else 2]:
        rest = np.flatnonzero(open_)
        rest_v, w_rest, w_float = other_v[rest], w_other[rest].astype(np.float64), w_mine.astype(np.float64)
        for block in np.array_split(np.flatnonzero(full), max(1, int(full.sum()) * len(rest) // (4 << 20))):
            sims = mine_v[block] @ rest_v.T
            link = sims >= least + SLACK
            # what single precision can't tell
            i, j = np.nonzero((sims >= near) & ~link)
            for k in range(0, len(i), 65536):
                x, y = i[k : k + 65536], j[k : k + 65536]
                link[x, y] = np.einsum("kd,kd->k", mine[block[x]], other[rest[y]]) >= least
            if own:
                link[np.arange(len(block)), block] = False
            # sums of rows are whole numbers far below 2^53
            hits = link.astype(np.float64)
            links[at_mine + block] += (hits @ w_rest).astype(np.int64)
            # inside one shard a pair of full rows is seen from both, any other pair only from its full row
            back = (w_float[block] @ hits).astype(np.int64)
            links[at_other + rest] += np.where(full[rest], 0, back) if own else back
            for i, row in zip(block, link, strict=True):
                sets.join(np.append(at_other + rest[row], at_mine + i))
    cid = np.concatenate([ids_a, [] if own else ids_b]).astype(np.int64)
    root = sets.roots(np.arange(len(links)))
    low = np.full(len(links), np.iinfo(np.int64).max)
    np.minimum.at(low, root, cid)
    some = links > 0
    return pa.table({
        "cid": pa.array([*cid[some].tolist(), None], pa.int64()), "links": pa.array([*links[some].tolist(), 0], pa.int64()),
        "root": pa.array([*low[root][some].tolist(), None], pa.int64()), "recall": pa.array([None] * int(some.sum()) + [found], pa.float64()),
    })


def link_pairs(batches, **params):
    """Rows of (dim, pair, shard, ...), the one or two sides of a pair next to each other."""
    side: list[pa.RecordBatch] = []
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            if side and any(side[0].column(c)[0] != row.column(c)[0] for c in ("dim", "pair")):
                yield from link_shards(pa.Table.from_batches(side), **params).to_batches()
                side = []
            side.append(row)
    if side:
        yield from link_shards(pa.Table.from_batches(side), **params).to_batches()


def near_vectors(vectors: DataFrame, cosine: float = 0.9, shard_rows: int = 100_000, shards: int = 6, m: int = 12, beam: int = 48, audit: int = 256, recall: float = 0.98) -> DataFrame:
    """(vec_id, rk, n_links, component_id, kept, audited_recall) of vectors (vec_id, embedding).

    Vectors link where their cosine in double precision is at least `cosine`. Equal vectors form
    a class. Classes are dealt to shards by a seeded hash, `shards` of them or as many as keep a
    shard near shard_rows; each shard gets a graph, written to the shared folder; and each pair of
    shards is one task, in which both sides query the other. Beams widen until the recall of true
    nearest others, for up to `audit` of a sample's rows that have links on each side, and of
    planted ones where these are fewer, reaches `recall`; the least recall found is returned. See link_shards.

    Work: every vector queries every shard, so tasks grow with the square of the number of
    shards and a query with the logarithm of shard_rows. A row in a large group of near copies
    costs a product with each shard, but no memory.

    rk is xxhash64(vec_id, embedding). Defined cases: vectors that are null, empty, zero or hold
    null or non-finite components link with nothing; vectors of different lengths never link;
    rows with a null vec_id link with nothing and have a null component_id; rows that share an id
    are one node of components; other columns, of whatever name, are not looked at; an empty table gives no rows.
    """
    rows = vectors.select("vec_id", F.xxhash64("vec_id", "embedding").alias("rk"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & fine, F.lit(False)))
    rows = rows.withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(1), "embedding"))
    key = ["k1", "k2"]
    narrow = keep(rows.select("vec_id", "rk", "ok", *key), "vec-rows")
    grouped = rows.filter("ok").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("rows"), F.first("embedding").alias("embedding"))
    classes = keep(grouped.withColumn("cid", F.monotonically_increasing_id()), "vec-classes")
    parts = max(shards, -(-classes.count() // shard_rows))
    sharded = classes.withColumn("dim", F.size("embedding")).withColumn("shard", F.pmod(F.xxhash64(F.lit(1), *key), F.lit(parts)).cast("int"))
    # one task for each shard
    built = sharded.select("dim", "shard", "cid", "rows", "embedding").repartitionById(parts, F.col("shard")).sortWithinPartitions("dim", "shard")
    graphs = keep(built.mapInArrow(partial(build_shards, m=m), "dim int, shard int, cids binary, rows binary, vectors binary, graph binary, sizes array<int>"), "vec-graphs")
    # one task for each pair of shards
    paired = graphs.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("a", F.least("shard", "other")).withColumn("b", F.greatest("shard", "other"))
    paired = paired.withColumn("pair", (F.col("b") * (F.col("b") + 1) / 2 + F.col("a")).cast("int")).drop("other", "a", "b")
    dealt = paired.repartitionById(parts * (parts + 1) // 2, F.col("pair")).sortWithinPartitions("dim", "pair", "shard")
    link = partial(link_pairs, m=m, least=cosine, beam=beam, audit=audit, recall=recall)
    found = keep(dealt.mapInArrow(link, "cid long, links long, root long, recall double"), "vec-links")
    drop(graphs)
    worst = found.agg(F.min("recall")).first()[0]
    found = found.filter("cid is not null")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    by_class = classes.join(links, "cid", "left").select(*key, "cid", "rep", "rows", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    edges = found.filter("cid <> root").select(F.col("cid").alias("u"), F.col("root").alias("v"))
    member = skewed_lookup(narrow.filter("ok").select("vec_id", *key), by_class.select(*key, "cid", F.col("rows").alias("w")), key, "w")
    shared = member.groupBy("vec_id").agg(F.min("cid").alias("v"), F.max("cid").alias("last")).filter("v < last")
    edges = edges.unionByName(member.join(shared, "vec_id").filter("cid > v").select(F.col("cid").alias("u"), "v"))
    joined = by_class.join(connected_components(edges).withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("component", "cid"))
    labelled = keep(joined.select(*key, "rep", "rows", "n_links", "label"), "vec-labelled")
    least = labelled.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("w"))
    answer = skewed_lookup(labelled, least, ["label"], "w").select(*key, "rows", "n_links", "component_id")
    good = skewed_lookup(narrow.filter("ok"), answer, key, "rows").select("vec_id", "rk", "n_links", "component_id")
    bad = narrow.filter("not ok").select("vec_id", "rk", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumns({"kept": F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)), "audited_recall": F.lit(worst).cast("double")})
