"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep


def _least(edges: DataFrame, at: str, other: str) -> DataFrame:
    return edges.groupBy(at).agg(F.least(F.min(other), F.col(at)).alias("m"))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _solve(batches):
    """All edges of a small graph: union-find with path halving."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(np.array([root(x) for x in nodes], np.int64))], names=["node", "component"])


def connected_components(edges: DataFrame, rounds: int = 50, one_task: int = 100_000) -> DataFrame:
    """(node, component) for the nodes of undirected edges (u, v): component is the smallest node.

    Every step links a node's neighbours to the least of them, so a hub's edges are spread over
    its neighbours and no group is ever gathered; minima are combined before the shuffle, and the
    joins back are plain joins that Spark may split where a hub is hot. Each round is written to
    the shared folder. Stops when a round changes nothing. A graph of at most one_task edges,
    which a count of the written edges decides, is solved in one task, with the same result.
    """
    now = keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    if now.limit(one_task + 1).count() <= one_task:
        return now.repartition(1).mapInArrow(_solve, "node long, component long")
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both, "u", "v"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        minima = _least(large, "u", "v")
        moved = large.join(minima, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(minima.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        nxt = keep(small, "cc")
        after = _mark(nxt)
        drop(now)
        now, same = nxt, after == mark
        mark = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
