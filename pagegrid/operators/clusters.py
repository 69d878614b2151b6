"""Colour clusters of pages and the backgrounds they show.

Pages are rows (page_id, width, height, r, g, b), channels as array<smallint>, rows end to end. Clusters
stay in the page's row, so neither pixels nor pages are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from pagegrid.operators import arrays as A
from pagegrid.operators import masks as M

CLUSTERS = "array<struct<L:double,A:double,B:double,pixels:long,frac:double,border:double>>"
FIELDS = ["L", "A", "B", "pixels", "frac", "border"]
ARROW = pa.list_(pa.struct([(f, pa.int64() if f == "pixels" else pa.float64()) for f in FIELDS]))


def lab_of(rgb: np.ndarray) -> np.ndarray:
    """CIE Lab of n x 3 bytes, as in functions.colour.with_lab."""
    s = rgb / 255.0
    light = np.where(s > 0.04045, ((s + 0.055) / 1.055) ** 2.4, s / 12.92)
    # fixed values: sRGB to XYZ, divided by the white point
    xyz = light @ np.array([[0.412453, 0.212671, 0.019334], [0.357580, 0.715160, 0.119193], [0.180423, 0.072169, 0.950227]]) / [0.950456, 1.0, 1.088754]
    x, y, z = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16.0 / 116.0).T
    return np.stack([(116.0 * y - 16.0) * 2.55, 500.0 * (x - y) + 128.0, 200.0 * (y - z) + 128.0], axis=1)


def distinct_colours(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Lab of each colour of a page, the pixels' colour numbers)."""
    if r is g and g is b:
        count = np.bincount(r)
        tone = np.flatnonzero(count)
        return lab_of(np.stack([tone] * 3, axis=1).astype(float)), (np.cumsum(count > 0) - 1)[r]
    packed = (r.astype(np.int64) << 16) | (g.astype(np.int64) << 8) | b
    colours, number = np.unique(packed, return_inverse=True)
    return lab_of(np.stack([colours >> 16, (colours >> 8) & 255, colours & 255], axis=1).astype(float)), number


def squares(lab: np.ndarray, center: np.ndarray) -> np.ndarray:
    return ((lab - center) ** 2).sum(1)


def nearest(lab: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin(np.stack([squares(lab, c) for c in centers]), axis=0)


def kmeans(lab: np.ndarray, weight: np.ndarray, k: int, rounds: int = 30, still: float = 1.0) -> np.ndarray:
    """At most k centers of weighted points, the same at every run.

    The first is the heaviest point, each next one the point with most weight times squared distance
    from those chosen; rounds end when no center moves by `still`.
    """
    chosen, away = [int(np.argmax(weight))], squares(lab, lab[np.argmax(weight)])
    while len(chosen) < k and (away * weight).max() > 0:
        chosen.append(int(np.argmax(away * weight)))
        away = np.minimum(away, squares(lab, lab[chosen[-1]]))
    centers = lab[chosen]
    for _ in range(rounds):
        part = nearest(lab, centers)
        total = np.bincount(part, weight, len(centers))
        moved = np.stack([np.bincount(part, weight * lab[:, c], len(centers)) for c in range(3)], axis=1) / np.maximum(total, 1)[:, None]
        moved = np.where(total[:, None] > 0, moved, centers)
        step = np.sqrt(((moved - centers) ** 2).sum(1)).max()
        centers = moved
        if step < still:
            break
    return centers


def page_clusters(r: np.ndarray, g: np.ndarray, b: np.ndarray, wide: int, high: int, k: int, share: float) -> list[dict]:
    """A page's clusters, largest first; `border` is the share of the border strips that a cluster holds."""
    if not len(r):
        return []
    lab, number = distinct_colours(r, g, b)
    pixels = np.bincount(number, minlength=len(lab))
    centers = kmeans(lab, pixels.astype(float), k)
    part = nearest(lab, centers)
    strip = max(2, int(min(wide, high) * share))
    edge = np.ones((high, wide), bool)
    edge[strip : high - strip, strip : wide - strip] = False
    at_edge = np.bincount(number[edge.ravel()], minlength=len(lab))
    size, border = (np.bincount(part, n, len(centers)) for n in (pixels, at_edge))
    found = [(*map(float, c), int(n), float(n / len(number)), float(e / edge.sum())) for c, n, e in zip(centers, size, border, strict=True) if n]
    return [dict(zip(FIELDS, c, strict=True)) for c in sorted(found, key=lambda c: (-c[3], c[:3]))]


def _channels(batch: pa.RecordBatch, i: int) -> list[np.ndarray]:
    return [np.asarray(batch.column(c)[i].values) for c in "rgb"]


def with_clusters(rasters: DataFrame, k: int = 4, share: float = 0.04) -> DataFrame:
    """rasters with `clusters`: k-means in Lab over all colours of the page, weighted by their pixels.

    A page with fewer than k colours has fewer clusters, one without pixels has none.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            wide, high = (batch.column(c).to_pylist() for c in ("width", "height"))
            found = [page_clusters(*_channels(batch, i), wide[i], high[i], k, share) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, type=ARROW)], names=[*batch.schema.names, "clusters"])

    return rasters.mapInArrow(run, StructType([*rasters.schema.fields, StructField("clusters", _parse_datatype_string(CLUSTERS))]))


def colour_clusters(rasters: DataFrame, k: int = 4) -> DataFrame:
    """(page_id, cluster_id, L, A, B, pixels, frac, border), numbered from 1, largest first."""
    one = with_clusters(rasters, k).select("page_id", F.posexplode("clusters").alias("i", "c"))
    return one.select("page_id", (F.col("i") + 1).alias("cluster_id"), *[F.col("c")[f].alias(f) for f in FIELDS])


def background_of(clusters: Column) -> Column:
    """Those of an array of clusters (largest first) that are background: masks.background_clusters for one row."""
    sure = F.filter(clusters, lambda c: M.surely_background(c["L"], c["border"], c["frac"]))
    spare = F.filter(clusters, lambda c: M.maybe_background(c["L"], c["frac"]))
    return F.when(F.size(sure) > 0, sure).otherwise(F.slice(spare, 1, 1))


def _round_dilated(mask: np.ndarray) -> np.ndarray:
    """Running maximum over a 5 x 5 disc."""
    return A.dilated(mask, 2, 1) | A.dilated(mask, 0, 2)


def _round_eroded(mask: np.ndarray) -> np.ndarray:
    return ~_round_dilated(~mask)


def repeated(f: Callable[[np.ndarray], np.ndarray], times: int, mask: np.ndarray) -> np.ndarray:
    for _ in range(times):
        mask = f(mask)
    return mask


def cluster_background_mask(rasters: DataFrame, k: int = 4, delta: float = 15.0) -> DataFrame:
    """(page_id, width, height, gray): 255 where a pixel's colour is near a background cluster, else 0.

    Near is delta, and more by half of the cluster's share; the mask is closed twice and opened once.
    """
    pages = with_clusters(rasters, k).withColumn("clusters", background_of(F.col("clusters")))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            wide, high, found = (batch.column(c).to_pylist() for c in ("width", "height", "clusters"))
            out = []
            for i in range(batch.num_rows):
                lab, number = distinct_colours(*_channels(batch, i))
                near = np.zeros(len(lab), bool)
                for c in found[i]:
                    near |= np.sqrt(squares(lab, np.array([c["L"], c["A"], c["B"]]))) < delta * (1.0 + 0.5 * c["frac"])
                mask = near[number].reshape(high[i], wide[i])
                mask = repeated(_round_eroded, 2, repeated(_round_dilated, 2, mask)) if mask.size else mask
                mask = _round_dilated(_round_eroded(mask)) if mask.size else mask
                out.append(np.where(mask, 255, 0).astype(np.int16).ravel())
            columns = [batch.column(c) for c in ("page_id", "width", "height")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, type=pa.list_(pa.int16()))], names=["page_id", "width", "height", "gray"])

    return pages.select("page_id", "width", "height", "r", "g", "b", "clusters").mapInArrow(run, A.MASK)
