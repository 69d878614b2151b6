"""Shapes in a page's binary mask: labelled runs, boxes, hulls, least rectangles, distances, flooding.

Everything works on rows of runs, not on pixels, and takes time in proportion to the page.
"""

from __future__ import annotations

import numpy as np


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the horizontal runs, row by row; end is exclusive."""
    h, w = mask.shape
    # rows end to end, with a pixel of ground before each
    line = np.zeros(h * (w + 1) + 1, bool)
    line[:-1].reshape(h, w + 1)[:, 1:] = mask
    turn = np.flatnonzero(line[1:] != line[:-1])
    row, start = np.divmod(turn[::2], w + 1)
    return row, start, turn[1::2] - row * (w + 1)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n items' set, where items a[i] and b[i] are in one set."""
    parent = np.arange(n)
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def run_sets(row: np.ndarray, start: np.ndarray, end: np.ndarray, wide: int, diagonal: bool = True) -> np.ndarray:
    """The first run of each run's component: runs of neighbouring rows touch by sides, or by corners too."""
    stride, reach = wide + 3, int(diagonal)
    lo = np.searchsorted(row * stride + end, (row + 1) * stride + start - reach, "right")
    hi = np.searchsorted(row * stride + start, (row + 1) * stride + end + reach, "left")
    count = np.maximum(hi - lo, 0)
    upper = np.repeat(np.arange(len(row)), count)
    lower = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    return roots(len(row), upper, lower)


def component_labels(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """The first pixel of each pixel's component, height x width where there is none; 8-connected, or 4-connected."""
    h, w = mask.shape
    row, start, end = runs(mask)
    label = np.full(h * w, h * w)
    label[mask.ravel()] = np.repeat((row * w + start)[run_sets(row, start, end, w, diagonal)], end - start)
    return label.reshape(h, w)


class Components:
    """Components of a mask in the order of their first pixels: boxes (x0, y0, x1, y1 exclusive), pixels, `part` of each run."""

    def __init__(self, mask: np.ndarray, diagonal: bool = True):
        self.shape = mask.shape
        self.row, self.start, self.end = runs(mask)
        root = run_sets(self.row, self.start, self.end, mask.shape[1], diagonal)
        own = root == np.arange(len(root))
        first, self.part = np.flatnonzero(own), (np.cumsum(own) - 1)[root]
        n = len(first)
        self.x0, self.y0, self.x1, self.y1 = np.full(n, mask.shape[1]), self.row[first], np.zeros(n, int), np.zeros(n, int)
        np.minimum.at(self.x0, self.part, self.start)
        np.maximum.at(self.x1, self.part, self.end)
        np.maximum.at(self.y1, self.part, self.row + 1)
        self.pixels = np.bincount(self.part, self.end - self.start, n).astype(int)
        self.first = self.y0 * mask.shape[1] + self.start[first]

    def __len__(self) -> int:
        return len(self.pixels)

    def mask(self, keep: np.ndarray) -> np.ndarray:
        """The mask of the components for which keep holds."""
        out = np.zeros((self.shape[0], self.shape[1] + 1), np.int8)
        at = keep[self.part]
        np.add.at(out, (self.row[at], self.start[at]), 1)
        np.add.at(out, (self.row[at], self.end[at]), -1)
        return out.cumsum(1, dtype=np.int8)[:, :-1] > 0

    def corners(self, i: int) -> np.ndarray:
        """Points (x, y) of the outer pixels' corners of component i, enough for its hull."""
        at = self.part == i
        row, start, end = self.row[at], self.start[at], self.end[at]
        top = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        y, left, right = row[top], np.minimum.reduceat(start, top), np.maximum.reduceat(end, top)
        return np.concatenate([np.stack([x, y + d], 1) for x in (left, right) for d in (0, 1)])


def components(mask: np.ndarray, diagonal: bool = True) -> list[tuple]:
    """(x, y, w, h, pixels) of the components, by their first pixel."""
    c = Components(mask, diagonal)
    return [(float(a), float(b), float(p - a), float(q - b), int(s)) for a, b, p, q, s in zip(c.x0, c.y0, c.x1, c.y1, c.pixels, strict=True)]


def holes(mask: np.ndarray) -> np.ndarray:
    """Pixels outside the mask that it encloses: no path over sides leads them to the page's edge."""
    h, w = mask.shape
    c = Components(~mask, diagonal=False)
    return c.mask((c.x0 > 0) & (c.y0 > 0) & (c.x1 < w) & (c.y1 < h))


def outlines(mask: np.ndarray) -> list[tuple]:
    """Boxes of what a mask's lines enclose, one for each hole, and of its components with their holes filled."""
    inside = holes(mask)
    return components(mask | inside) + components(inside, diagonal=False)


def outermost(points: np.ndarray) -> np.ndarray:
    """The points without most of those that can't be corners of the hull: of each y the first and last x, without those
    that lie on or inside of a line between their neighbours on that side, again and again."""
    o = np.lexsort((points[:, 0], points[:, 1]))
    points = points[o]
    turn = np.flatnonzero(points[1:, 1] != points[:-1, 1]) + 1
    out = []
    for at, side in ((np.append(0, turn), 1), (np.append(turn, len(points)) - 1, -1)):
        line = points[at] if len(points) else points
        while len(line) > 2:
            a, b = line[1:-1] - line[:-2], line[2:] - line[1:-1]
            out_of_line = np.concatenate([[True], side * (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) < 0, [True]])
            if out_of_line.all():
                break
            line = line[out_of_line]
        out.append(line)
    return np.concatenate(out)


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise in a frame with y up."""
    points = np.unique(outermost(points), axis=0)
    if len(points) < 3:
        return points

    def half(rows):
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    rows = points.tolist()
    return np.array(half(rows) + half(rows[::-1]))


def polygon_area(corners: np.ndarray) -> float:
    x, y = corners.T
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def least_rectangle(corners: np.ndarray) -> tuple[float, float, float]:
    """(area, length, angle in degrees) of the smallest rectangle around a hull: one of its sides lies on a side of the hull."""
    side = np.roll(corners, -1, 0) - corners
    length = np.hypot(*side.T)
    unit = side[length > 0] / length[length > 0, None]
    along = unit @ corners.T
    across = np.stack([-unit[:, 1], unit[:, 0]], 1) @ corners.T
    wide, high = np.ptp(along, 1), np.ptp(across, 1)
    i = int(np.argmin(wide * high))
    return float(wide[i] * high[i]), float(max(wide[i], high[i])), float(np.degrees(np.arctan2(unit[i, 1], unit[i, 0])))


def distances(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each pixel of the mask to the nearest one outside; the page's edge is not outside."""
    h, w = mask.shape
    far = float(h + w)
    at = np.where(mask, -far, np.arange(h, dtype=float)[:, None])
    above = np.arange(h)[:, None] - np.maximum.accumulate(at, 0)
    at = np.where(mask, 2 * far + h, np.arange(h, dtype=float)[:, None])
    below = np.minimum.accumulate(at[::-1], 0)[::-1] - np.arange(h)[:, None]
    square = np.minimum(np.minimum(above, below), far) ** 2
    best, d = square.copy(), 1
    while d < w and d * d < best.max():
        best[:, d:] = np.minimum(best[:, d:], square[:, :-d] + d * d)
        best[:, :-d] = np.minimum(best[:, :-d], square[:, d:] + d * d)
        d += 1
    return np.sqrt(best)


def flooded(seeds: np.ndarray, height: np.ndarray, levels: int = 48) -> np.ndarray:
    """Labels (0: none) of where height > 0, grown from the seeds' labels over falling levels of height.

    A pixel goes to the label that reaches it at the highest level, there by fewest steps, the
    larger label where two meet; so regions part where the height between their seeds is least.
    """
    label = seeds.copy()
    steps = np.unique(np.quantile(height[height > 0], np.linspace(0, 1, levels)))[::-1] if (height > 0).any() else []
    for least in steps:
        free = (height >= least) & (label == 0)
        while free.any():
            wide = np.pad(label, 1)
            near = np.maximum(np.maximum(wide[:-2, 1:-1], wide[2:, 1:-1]), np.maximum(wide[1:-1, :-2], wide[1:-1, 2:]))
            new = free & (near > 0)
            if not new.any():
                break
            label[new] = near[new]
            free &= ~new
    return label
