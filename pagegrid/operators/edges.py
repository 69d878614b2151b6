"""Edges and straight lines of a page's pixels: thin edges with hysteresis, lines by votes near the two axes."""

from __future__ import annotations

import numpy as np

from pagegrid.operators import shapes as S


def blurred(gray: np.ndarray) -> np.ndarray:
    """3 x 3 binomial mean, edges repeated."""
    g = np.pad(gray.astype(float), 1, mode="edge")
    g = (g[:-2] + 2 * g[1:-1] + g[2:]) / 4
    return (g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]) / 4


def slopes(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel differences along x and y, edges repeated."""
    g = np.pad(gray, 1, mode="edge")
    sy, sx = g[:-2] + 2 * g[1:-1] + g[2:], g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]
    return sy[:, 2:] - sy[:, :-2], sx[2:] - sx[:-2]


def ridge(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """|dx| + |dy| where it is largest across the edge (of equals the first), else 0."""
    size = np.abs(dx) + np.abs(dy)
    wide = np.pad(size, 1)
    h, w = size.shape
    shift = lambda y, x: wide[1 + y : 1 + y + h, 1 + x : 1 + x + w]
    # directions in steps of 45 degrees: tan(22.5 degrees) parts the flat from the slanted ones
    flat, steep = np.abs(dy) <= 0.41421356 * np.abs(dx), np.abs(dx) <= 0.41421356 * np.abs(dy)
    same = (dx < 0) == (dy < 0)
    before = np.where(flat, shift(0, -1), np.where(steep, shift(-1, 0), np.where(same, shift(-1, -1), shift(-1, 1))))
    after = np.where(flat, shift(0, 1), np.where(steep, shift(1, 0), np.where(same, shift(1, 1), shift(1, -1))))
    return np.where((size > before) & (size >= after), size, 0.0)


def grown(thin: np.ndarray, low: float, high: float) -> np.ndarray:
    """Ridge pixels above low whose component (over corners too) has one above high."""
    mask = thin > low
    found = S.Components(mask)
    strong = (thin > high)[mask]
    length = found.end - found.start
    hit = np.add.reduceat(strong, np.cumsum(length) - length) if len(length) else np.zeros(0, int)
    return found.mask(np.bincount(found.part, hit, len(found)) > 0)


#: Pairs of limits whose edges are united.
LIMITS = ((30, 90), (50, 150), (80, 200))


def voted_edges(gray: np.ndarray, limits: tuple = LIMITS) -> np.ndarray:
    """Edges of the blurred page found at any of the pairs of limits."""
    # whole numbers, 16 times the blurred tones, as the mean has weights of sixteenths
    g = np.pad(gray.astype(np.int32), 2, mode="edge")
    g = g[:-2] + 2 * g[1:-1] + g[2:]
    g = (g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:])[1:-1, 1:-1]
    thin = steep_ridge(*slopes(g), 16 * min(low for low, _ in limits))
    out = np.zeros(gray.shape, bool)
    # limits that part the same pixels, as those above them do on clear drawings, find the same edges
    above = {limit: np.count_nonzero(thin > 16 * limit) for pair in limits for limit in pair}
    for low, high in {(above[low], above[high]): (low, high) for low, high in limits}.values():
        out |= grown(thin, 16 * low, 16 * high)
    return out


def steep_ridge(dx: np.ndarray, dy: np.ndarray, low: int) -> np.ndarray:
    """ridge() where it is above low, else 0: only such pixels are looked at."""
    size = np.abs(dx) + np.abs(dy)
    h, w = size.shape
    wide = np.pad(size, 1).ravel()
    y, x = np.divmod(np.flatnonzero(size > low), w)
    gx, gy, at = dx[y, x], dy[y, x], (y + 1) * (w + 2) + x + 1
    flat, steep = np.abs(gy) <= 0.41421356 * np.abs(gx), np.abs(gx) <= 0.41421356 * np.abs(gy)
    back = np.where(flat, 1, np.where(steep, w + 2, np.where((gx < 0) == (gy < 0), w + 3, w + 1)))
    top = (wide[at] > wide[at - back]) & (wide[at] >= wide[at + back])
    out = np.zeros_like(size)
    out[y[top], x[top]] = wide[at[top]]
    return out


def pieces(at: np.ndarray, gap: int, least: int) -> list[tuple[int, int]]:
    """(first, last) of sorted positions' stretches without gaps above `gap`, at least `least` long."""
    cut = np.flatnonzero(np.diff(at) > gap) + 1
    ends = zip(np.append(0, cut), np.append(cut, len(at)) - 1, strict=True)
    return [(int(at[a]), int(at[b])) for a, b in ends if at[b] - at[a] >= least]


def voted_lines(mask: np.ndarray, least: int, tolerance: int = 8, gap: int | None = None) -> list[tuple]:
    """(axis 0 or 1, x1, y1, x2, y2) of straight lines within `tolerance` degrees of an axis.

    Each pixel votes for its offset from every slope; the strongest line takes its pixels' stretches
    out, until none has `least` / 3 votes. Axis 0 runs along x.
    """
    gap = max(5, least // 8) if gap is None else gap
    out = []
    for axis in (0, 1):
        ys, xs = np.nonzero(mask if axis == 0 else mask.T)
        slope = np.tan(np.radians(np.arange(-tolerance, tolerance + 1)))
        size = (mask.shape[axis]) + 2 * int(np.ceil(slope.max() * mask.shape[1 - axis])) + 2
        base = int(np.ceil(slope.max() * mask.shape[1 - axis])) + 1
        offset = np.rint(ys[:, None] - xs[:, None] * slope).astype(np.int32) + base
        bins = offset + np.arange(len(slope), dtype=np.int32) * size
        votes = np.bincount(bins.ravel(), minlength=size * len(slope))
        free = np.ones(len(xs), bool)
        enough = max(8, least // 3)
        while len(xs) and votes.max() >= enough:
            best = int(votes.argmax())
            k, r = divmod(best, size)
            # a line takes what lies one pixel beside it as well
            on = np.flatnonzero(free & (np.abs(offset[:, k] - r) <= 1))
            on = on[np.argsort(xs[on], kind="stable")]
            taken = np.zeros(0, int)
            for a, b in pieces(xs[on], gap, least) if len(on) else []:
                ya, yb = (r - base + x * slope[k] for x in (a, b))
                out.append((axis, float(a), float(ya), float(b), float(yb)) if axis == 0 else (axis, float(ya), float(a), float(yb), float(b)))
                taken = np.append(taken, on[(xs[on] >= a) & (xs[on] <= b)])
            if not len(taken):
                votes[best] = 0
                continue
            free[taken] = False
            votes -= np.bincount(bins[taken].ravel(), minlength=len(votes))
    return out
