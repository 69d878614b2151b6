"""Pages as one row each: (page_id, width, height, gray array<smallint>, rows end to end).

Neighbourhoods stay inside the row, so nothing is shuffled by pixel: a task turns a page's pixels
into a few boxes, bands or tiles with NumPy, and everything after is a plan over those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagegrid.operators.shapes import component_labels, components, holes, outlines  # noqa: F401

BOX = "page_id long, x double, y double, w double, h double"
MASK = "page_id long, width int, height int, gray array<smallint>"


def per_page(rasters: DataFrame, f: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Rows (page_id, *item) for each item that f returns for a page's height x width array."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids, wide, high = (batch.column(c).to_pylist() for c in ("page_id", "width", "height"))
            out: list[tuple] = []
            for i, page in enumerate(ids):
                gray = np.asarray(batch.column("gray")[i].values).reshape(high[i], wide[i])
                out += [(page, *item) for item in f(gray)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(names), types, strict=True)], names=names)

    empty = rasters.sparkSession.createDataFrame([], schema)
    to_arrow = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<smallint>": pa.list_(pa.int16())}
    types = [to_arrow[t.dataType.simpleString()] for t in empty.schema]
    return rasters.select("page_id", "width", "height", "gray").mapInArrow(run, schema)


def with_id(boxes: DataFrame) -> DataFrame:
    """rect_id from 1 by (y, x, h, w): a page's own order, whatever the plan."""
    return boxes.withColumn("rect_id", F.row_number().over(Window.partitionBy("page_id").orderBy("y", "x", "h", "w")))


def islands(index: np.ndarray, gap: int, least: int) -> list[tuple[int, int]]:
    """(first, last) of the runs of index whose steps are at most gap."""
    if not len(index):
        return []
    parts = np.split(index, np.flatnonzero(np.diff(index) > gap) + 1)
    return [(int(p[0]), int(p[-1])) for p in parts if p[-1] - p[0] + 1 >= least]


def bright_bands(profile: np.ndarray, share: float, contrast: float, gap: int, least: int, bright: float = 0.0) -> list[tuple[int, int]]:
    """Stretches of a profile above median + share x (max - median), if it has contrast and bright ground."""
    middle, high = float(np.median(profile)), float(profile.max())
    if high - middle < contrast or high <= bright:
        return []
    return islands(np.flatnonzero(profile >= middle + share * (high - middle)), gap, least)


def between(bands: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """(from, to) of the stretches that bands leave of 0..size."""
    cuts = [-1, *[x for b in bands for x in b], size]
    return [(a + 1, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True) if b > a + 1]


def gutter_cells(rasters: DataFrame, row_share: float = 0.65, col_share: float = 0.55, least_row: float = 0.12, min_side: int = 5) -> DataFrame:
    """Cells (page_id, x, y, w, h): rows between bright bands, each cut by bright columns of its own."""

    def cells(gray: np.ndarray) -> list[tuple]:
        high, wide = gray.shape
        out = []
        across = bright_bands(gray.mean(1), row_share, 30, 5, 3)
        for top, bottom in between(across, high) if across else []:
            if bottom - top < least_row * high:
                continue
            down = bright_bands(gray[top:bottom].mean(0), col_share, 30, 3, 3, 225)
            out += [(float(a), float(top), float(b - a), float(bottom - top)) for a, b in between(down, wide) if b - a >= min_side]
        return out

    return per_page(rasters, cells, BOX)


def box_sums(values: np.ndarray, k: int) -> np.ndarray:
    """Sum over the (2k+1) x (2k+1) surroundings, cut at the edges."""
    h, w = values.shape
    small = values.size and int(np.abs(values).max()) * values.size < 2**31
    table = np.zeros((h + 1, w + 1), np.int32 if small else np.int64)
    np.cumsum(values, 0, table.dtype, table[1:, 1:])
    np.cumsum(table[1:, 1:], 1, table.dtype, table[1:, 1:])
    y0, y1 = spans(h, k)
    rows = np.pad(table[y1] - table[y0], ((0, 0), (k, k)), mode="edge")
    return rows[:, 2 * k + 1 : 2 * k + 1 + w] - rows[:, :w]


def spans(size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to exclusive) of the 2k + 1 places around each one, cut at both ends."""
    return np.maximum(np.arange(size) - k, 0), np.minimum(np.arange(size) + k + 1, size)


def local_dark(gray: np.ndarray, block: int, c: float) -> np.ndarray:
    """Pixels at most the mean of their block less c."""
    (y0, y1), (x0, x1) = (spans(size, block // 2) for size in gray.shape)
    sums = box_sums(gray, block // 2)
    n = np.outer(y1 - y0, x1 - x0).astype(sums.dtype)
    if c == int(c):
        return (gray + int(c)) * n <= sums
    return gray.astype(np.int64) * n <= sums - c * n


def _spread(mask: np.ndarray, k: int, axis: int) -> np.ndarray:
    """Whether any of the 2k + 1 pixels around holds, along an axis: spans double until two of them cover all."""
    span, reach = 2 * k + 1, 1
    cut = (lambda a, b: (slice(a, b),)) if axis == 0 else (lambda a, b: (slice(None), slice(a, b)))
    high, wide = mask.shape
    part = np.zeros((high + 2 * k * (axis == 0), wide + 2 * k * (axis == 1)), bool)
    part[cut(k, k + mask.shape[axis])] = mask
    while reach < span:
        step = min(reach, span - reach)
        part = part[cut(None, -step)] | part[cut(step, None)]
        reach += step
    return part


def dilated(mask: np.ndarray, kx: int, ky: int) -> np.ndarray:
    """Running maximum over 2k+1 pixels on each axis."""
    out = _spread(mask, kx, 1) if kx else mask
    return _spread(out, ky, 0) if ky else out


def eroded(mask: np.ndarray, kx: int, ky: int) -> np.ndarray:
    return ~dilated(~mask, kx, ky)


def closed(mask: np.ndarray, k: int) -> np.ndarray:
    return eroded(dilated(mask, k, k), k, k)


def opened(mask: np.ndarray, kx: int, ky: int) -> np.ndarray:
    return dilated(eroded(mask, kx, ky), kx, ky)


def gradient(gray: np.ndarray) -> np.ndarray:
    """|gx| + |gy| of the 3x3 Sobel kernels; 0 on the page's edge."""
    # sums of eight tones at most
    g = gray.astype(np.int16 if gray.size and 0 <= gray.min() and gray.max() < 4096 else np.int32)
    out = np.zeros_like(g)
    smooth_y = g[:-2] + 2 * g[1:-1] + g[2:]
    smooth_x = g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]
    out[1:-1, 1:-1] = np.abs(smooth_y[:, 2:] - smooth_y[:, :-2]) + np.abs(smooth_x[2:] - smooth_x[:-2])
    return out


def ranked(values: np.ndarray, weight: np.ndarray, share: float) -> float:
    """np.quantile of rising values that each occur `weight` times."""
    upto = np.cumsum(weight)
    at = share * (upto[-1] - 1)
    low, high = (float(values[np.searchsorted(upto, i, "right")]) for i in (int(at), min(int(at) + 1, upto[-1] - 1)))
    return low + (high - low) * (at - int(at))


def quantile(plane: np.ndarray, share: float) -> float:
    """np.quantile of a plane of whole numbers from 0, by their counts."""
    count = np.bincount(plane.ravel())
    return ranked(np.arange(len(count)), count, share)


def component_boxes(rasters: DataFrame, mask: Callable[[np.ndarray], np.ndarray], find: Callable[[np.ndarray], list[tuple]] = components) -> DataFrame:
    """Boxes of a mask's components (or outlines) with their pixels, fill (share of the box) and rect_id."""
    boxes = per_page(rasters, lambda gray: find(mask(gray)), BOX + ", pixels long")
    return with_id(boxes.withColumn("fill", F.col("pixels") / (F.col("w") * F.col("h"))))


def numbered_components(rasters: DataFrame, mask: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(page_id, component, x, y, w, h, n_pixels) in whole pixels: a mask's 8-connected components, from 1 by their first pixel."""
    number = lambda gray: [(i, *map(int, c)) for i, c in enumerate(components(mask(gray)), 1)]
    return per_page(rasters, number, "page_id long, component long, x long, y long, w long, h long, n_pixels long")


def resized(rasters: DataFrame, factor: float, most_width: int = 2400) -> DataFrame:
    """Pages at `factor`, never wider than most_width: smaller ones by area averages, larger ones by the nearest pixel."""

    def resize(gray: np.ndarray) -> list[tuple]:
        h, w = gray.shape
        f = min(factor, most_width / w)
        high, wide = max(1, int(h * f)), max(1, int(w * f))
        if f >= 1:
            out = gray[(np.arange(high) * h) // high][:, (np.arange(wide) * w) // wide]
        else:
            ys, xs = (np.arange(h) * high) // h, (np.arange(w) * wide) // w
            total, n = np.zeros((high, wide)), np.zeros((high, wide))
            np.add.at(total, (ys[:, None], xs[None, :]), gray)
            np.add.at(n, (ys[:, None], xs[None, :]), 1)
            out = np.floor(total / np.maximum(n, 1) + 0.5)
        return [(wide, high, out.astype(np.int16).ravel().tolist())]

    return per_page(rasters, resize, MASK)


def level_shares(rasters: DataFrame, levels: list[int]) -> DataFrame:
    """(page_id, level, share): how much of a page each brightness threshold lets pass."""
    return per_page(rasters, lambda g: [(t, float((g >= t).mean())) for t in levels], "page_id long, level int, share double")


def tile_maps(rasters: DataFrame, grid: int = 20, dark: int = 200, edge: int = 100) -> DataFrame:
    """(page_id, ty, tx, content, edge): shares of dark pixels and of pixels with a steep gradient in each tile."""

    def tiles(gray: np.ndarray) -> list[tuple]:
        h, w = gray.shape
        steep = gradient(gray) > edge
        ys, xs = (np.arange(grid + 1) * h) // grid, (np.arange(grid + 1) * w) // grid
        n = np.maximum(np.outer(np.diff(ys), np.diff(xs)), 1)

        def shares(mask: np.ndarray) -> list[float]:
            table = np.pad(np.pad(mask.cumsum(1), ((0, 0), (1, 0)))[:, xs].cumsum(0), ((1, 0), (0, 0)))[ys]
            return (np.diff(np.diff(table, axis=0), axis=1) / n).ravel().tolist()

        return [(*divmod(k, grid), c, e) for k, (c, e) in enumerate(zip(shares(gray < dark), shares(steep), strict=True))]

    return per_page(rasters, tiles, "page_id long, ty int, tx int, content double, edge double")
