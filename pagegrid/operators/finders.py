"""What each detection route sees in one page: kernels from a Page to candidate boxes.

Lengths follow the page's size. A candidate has its box, its fill (the share of the box inside the
outline), rectangularity (the share of the least rectangle around it), and how outlines nest.
"""

from __future__ import annotations

import numpy as np

from pagegrid.operators import arrays as A
from pagegrid.operators import clusters as C
from pagegrid.operators import edges as E
from pagegrid.operators import shapes as S
from pagegrid.operators.pages import Page, area_mean

CANDIDATE = "struct<x:double,y:double,w:double,h:double,fill:double,rectangularity:double,children:int,depth:int>"
#: Outlines below this share of the page are no candidates for any route.
SPECK = 0.004


def candidate(x: float, y: float, w: float, h: float, fill: float = 1.0, rectangularity: float = 1.0, children: int = 0, depth: int = 0) -> dict:
    return dict(x=float(x), y=float(y), w=float(w), h=float(h), fill=float(fill), rectangularity=float(rectangularity), children=int(children), depth=int(depth))


def least_side(size: int) -> float:
    """The shortest side of a panel along an edge of `size` pixels."""
    return max(min(45.0, 0.1 * size), 0.025 * size)


# --- adaptive: local threshold


def adaptive(page: Page, c: float = 5.0) -> list[dict]:
    """Outer outlines of what is darker than its surroundings."""
    block = min(201, max(51, 51 * page.wide // 1200 | 1))
    side = min(15, max(3, 3 * page.wide // 1200 | 1))
    mask = A.closed(A.local_dark(page.gray, block, c), side // 2)
    found = S.Components(mask | S.holes(mask))
    box = (found.x1 - found.x0) * (found.y1 - found.y0)
    big = np.flatnonzero(box >= SPECK * page.wide * page.high)
    return [candidate(found.x0[i], found.y0[i], found.x1[i] - found.x0[i], found.y1[i] - found.y0[i], found.pixels[i] / box[i]) for i in big]


# --- hierarchy: nested outlines of edges


def nested_outlines(mask: np.ndarray, least: float) -> list[dict]:
    """Outlines of a mask's components and of their holes, by what they enclose, with depth and number of children.

    A hole lies in the component left of its first pixel, and a component in the region of ground left of its own.
    """
    h, w = mask.shape
    ink, ground = S.Components(mask), S.Components(~mask, diagonal=False)
    outer = (ground.x0 == 0) | (ground.y0 == 0) | (ground.x1 == w) | (ground.y1 == h)
    # the component of `of` that holds the pixel left of each first pixel of c
    left = lambda c, of: of.part[np.maximum(np.searchsorted(of.row * w + of.start, c.first // w * w + np.maximum(c.first % w - 1, 0), "right") - 1, 0)]
    # nodes: components first, then regions of ground; -1: none above
    n, m = len(ink), len(ground)
    parent = np.full(n + m, -1)
    if n and m:
        inside = ink.first % w > 0
        above = left(ink, ground)
        parent[:n] = np.where(inside & ~outer[above], n + above, -1)
        parent[n:] = np.where(outer, -1, left(ground, ink))
    area = np.append(ink.pixels, np.where(outer, 0, ground.pixels)).astype(float)
    # a node's first pixel comes before those of all it holds, so sums flow up from the last one
    order = np.argsort(-np.append(ink.first, ground.first), kind="stable")
    children = np.zeros(n + m, int)
    for i in order.tolist():
        if parent[i] >= 0:
            area[parent[i]] += area[i]
            children[parent[i]] += 1
    out = []
    for i in np.flatnonzero((area >= least) & ~np.append(np.zeros(n, bool), outer)):
        found, k = (ink, i) if i < n else (ground, i - n)
        depth, up = 0, parent[i]
        while up >= 0 and depth < 20:
            depth, up = depth + 1, parent[up]
        x, y, bw, bh = found.x0[k], found.y0[k], found.x1[k] - found.x0[k], found.y1[k] - found.y0[k]
        around = S.least_rectangle(S.hull(found.corners(k)))[0]
        out.append(candidate(x, y, bw, bh, area[i] / (bw * bh), min(1.0, area[i] / around), children[i], depth))
    return out


def hierarchy(page: Page) -> list[dict]:
    """Nested outlines of the page's edges, closed twice."""
    k = max(3, int(0.005 * min(page.wide, page.high)) | 1) // 2
    return nested_outlines(A.closed(page.edges, 2 * k), 0.008 * page.wide * page.high)


# --- lines


def gradient_lines(page: Page, least: int) -> list[tuple]:
    """(axis, position, lo, hi) of long thin components among the steepest pixels; a soft page has none, though some are its steepest."""
    steep = A.gradient(page.gray)
    mask = steep >= max(60.0, A.quantile(steep, 0.92))
    out = []
    for axis, kx, ky in ((0, least // 2, 0), (1, 0, least // 2)):
        for x, y, w, h, _ in S.components(A.opened(mask, kx, ky)):
            length, thick = (w, h) if axis == 0 else (h, w)
            if length >= least and thick < max(10, 0.01 * max(page.wide, page.high)):
                out.append((axis, y + h / 2, x, x + length) if axis == 0 else (axis, x + w / 2, y, y + length))
    return out


def segments(page: Page) -> list[tuple]:
    """(axis, position, lo, hi) of voted lines within 8 degrees of an axis and of gradient lines, near ones chained into one."""
    least = max(9, int(0.08 * min(page.wide, page.high)))
    voted = [(a, (y1 + y2) / 2, x1, x2) if a == 0 else (a, (x1 + x2) / 2, y1, y2) for a, x1, y1, x2, y2 in E.voted_lines(page.edges, least)]
    gap = max(8, int(0.005 * min(page.wide, page.high)))
    return chained(sorted(voted + gradient_lines(page, least)), gap)


def chained(lines: list[tuple], gap: float) -> list[tuple]:
    """Parallel lines, each at most `gap` from the one before, as one: mean position, whole extent."""
    out: list[list] = []
    for axis, at, lo, hi in lines:
        if out and out[-1][0] == axis and at - out[-1][-1] <= gap:
            group = out[-1]
            group[1] += at
            group[2], group[3], group[4], group[5] = min(group[2], lo), max(group[3], hi), group[4] + 1, at
        else:
            out.append([axis, at, lo, hi, 1, at])
    return [(axis, total / n, lo, hi) for axis, total, lo, hi, n, _ in out]


def line_cells(page: Page) -> list[dict]:
    """Cells of the grid that interior lines and the page's edges span, 2 pixels inside their lines."""
    places, every = [], segments(page)
    for axis, size in ((0, page.high), (1, page.wide)):
        lines = sorted((at, hi - lo) for a, at, lo, hi in every if a == axis)
        groups: list[list] = []
        for at, length in lines:
            if groups and at - groups[-1][-1][0] <= max(1.0, 0.04 * size):
                groups[-1].append((at, length))
            else:
                groups.append([(at, length)])
        middle = [int(sum(a * n for a, n in g) / sum(n for _, n in g)) for g in groups]
        places.append([0, *[m for m in middle if 0.03 * size < m < 0.97 * size], size])
    if len(places[0]) + len(places[1]) == 4:
        return []
    out = []
    for y0, y1 in zip(places[0][:-1], places[0][1:], strict=True):
        for x0, x1 in zip(places[1][:-1], places[1][1:], strict=True):
            left, top, right, bottom = x0 + 2 * (x0 > 0), y0 + 2 * (y0 > 0), x1 - 2 * (x1 < page.wide), y1 - 2 * (y1 < page.high)
            if right - left >= 0.03 * page.wide and bottom - top >= 0.03 * page.high:
                out.append(candidate(left, top, right - left, bottom - top))
    return out


# --- gutters


def smoothed(profile: np.ndarray, most: int = 51, degree: int = 3) -> np.ndarray:
    """Least-squares polynomials over a sliding window; the first and last one give the ends."""
    n = min(most, len(profile) // 2 | 1)
    if n <= degree or n > len(profile):
        return profile.astype(float)
    half = n // 2
    powers = np.vander(np.arange(-half, half + 1), degree + 1, increasing=True)
    fit = np.linalg.pinv(powers)
    out = np.empty(len(profile))
    out[half : len(profile) - half] = np.convolve(profile, fit[0][::-1], "valid")
    out[:half] = (powers @ fit @ profile[:n])[:half]
    out[len(profile) - half :] = (powers @ fit @ profile[-n:])[half + 1 :]
    return out


def peaks(v: np.ndarray, height: float, apart: int, prominence: float) -> np.ndarray:
    """Local maxima (middles of flat tops) of at least `height`; the higher of two nearer than `apart` stays; then by prominence."""
    edge = np.flatnonzero(np.diff(v) != 0)
    lo, hi = np.append(0, edge + 1), np.append(edge, len(v) - 1)
    inner = (lo > 0) & (hi < len(v) - 1)
    top = [(a + b) // 2 for a, b in zip(lo[inner], hi[inner], strict=True) if v[a - 1] < v[a] > v[b + 1] and v[a] >= height]
    kept: list[int] = []
    for p in sorted(top, key=lambda p: (-v[p], -p)):
        if all(abs(p - q) >= apart for q in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        higher_left, higher_right = np.flatnonzero(v[:p] > v[p]), np.flatnonzero(v[p + 1 :] > v[p])
        a = higher_left[-1] + 1 if len(higher_left) else 0
        b = p + 1 + higher_right[0] if len(higher_right) else len(v)
        if v[p] - max(v[a : p + 1].min(), v[p:b].min()) >= prominence:
            out.append(p)
    return np.array(out, int)


def gutter_mask(page: Page) -> np.ndarray:
    """Bright and even pixels in long stretches, closed, in components shaped like stripes."""
    lab, number = page.tones
    light, order = lab[:, 0], np.argsort(lab[:, 0])
    level = A.ranked(light[order], np.bincount(number.ravel(), minlength=len(light))[order], 0.94)
    steep = A.gradient(np.rint(light).astype(np.int32)[number])
    mask = (light >= min(level, 240.0))[number] & (steep <= A.quantile(steep, 0.25))
    reach = max(int(0.125 * page.wide), 15) // 2
    mask = A.closed(A.opened(mask, reach, 1) | A.opened(mask, 1, reach), 4)
    found = S.Components(mask)
    w, h = found.x1 - found.x0, found.y1 - found.y0
    across, down = int(0.20 * page.wide), int(0.20 * page.high)
    stripe = ((w >= across) & (h <= 25)) | ((h >= down) & (w <= 25))
    slim = (np.maximum(w / np.maximum(h, 1), h / np.maximum(w, 1)) >= 4.0) & (np.maximum(w, h) >= 0.4 * min(across, down))
    return found.mask(stripe | slim)


def mask_bands(mask: np.ndarray, axis: int, cover: float = 0.45, most: int = 10) -> list[tuple[int, int]]:
    """Bands of a gutter mask across (axis 0) or down the page: peaks of its profile that the mask covers enough."""
    profile = mask.mean(1 - axis)
    if not len(profile) or not profile.any():
        return []
    smooth = smoothed(profile)
    at = peaks(smooth, float(np.percentile(smooth, 85)), int(max(30, 0.015 * len(profile))), 0.015)
    at = np.sort(at[np.argsort(smooth[at], kind="stable")[-most:]])
    bands = [(max(0, p - 1), min(p + 1, len(profile) - 1)) for p in at]
    return [(a, b) for a, b in bands if profile[a : b + 1].mean() >= cover]


def with_new_bands(known: list[tuple[int, int]], new: list[tuple[int, int]], apart: float = 15.0) -> list[tuple[int, int]]:
    """known, and the new bands whose middle is `apart` from every known one, in order."""
    return sorted(known + [b for b in new if all(abs((b[0] + b[1]) / 2 - (k[0] + k[1]) / 2) >= apart for k in known)])


def sub_gutter(cell: np.ndarray, least: int = 3, bright: int = 225) -> tuple[int, int] | None:
    """(first, last) row of the one gutter that splits a cell into two stacked panels: near white, well inside, with most white in it.

    Cells under 60 pixels high or 30 wide stay whole.
    """
    high, wide = cell.shape
    if high < 60 or wide < 30:
        return None
    edge = max(3, wide // 20)
    inner = cell[:, edge : wide - edge]
    rows = inner.mean(1)
    middle, top = np.median(rows), rows.max()
    if top - middle < 40 or top < bright:
        return None
    found = A.islands(np.flatnonzero(rows >= max(middle + 0.65 * (top - middle), bright)), 3, least)
    inset = int(0.15 * high)
    white = [((inner[a : b + 1] >= bright).mean(), -a, (a, b)) for a, b in found if a >= inset and b <= high - inset]
    share, _, band = max(white, default=(0.0, 0, None))
    return band if share >= 0.55 else None


def gutter_grids(page: Page) -> tuple[list[dict], list[dict]]:
    """(cells of one grid over the page, cells of rows that are each cut by gutters of their own, and these once more across)."""
    gray, mask = page.gray, gutter_mask(page)
    inset = int(0.03 * page.wide)
    across = with_new_bands(A.bright_bands(gray[:, inset : page.wide - inset].mean(1), 0.65, 30, 5, 3), mask_bands(mask, 0))
    down = with_new_bands(A.bright_bands(gray.mean(0), 0.55, 30, 3, 3, 225), mask_bands(mask, 1))
    wide, high = least_side(page.wide), least_side(page.high)
    rows = A.between(across, page.high)
    flat, nested = [], []
    if across or down:
        columns = A.between(down, page.wide)
        flat = [candidate(x0, y0, x1 - x0, y1 - y0) for y0, y1 in rows for x0, x1 in columns if x1 - x0 >= wide and y1 - y0 >= high]
    for y0, y1 in rows if across else []:
        if y1 - y0 >= 0.12 * page.high:
            own = with_new_bands(A.bright_bands(gray[y0:y1].mean(0), 0.55, 30, 3, 3, 225), mask_bands(mask[y0:y1], 1))
            for x0, x1 in A.between(own, page.wide):
                if x1 - x0 >= wide:
                    split = sub_gutter(gray[y0:y1, x0:x1])
                    cuts = [(y0, y1)] if split is None else [(y0, y0 + split[0]), (y0 + split[1] + 1, y1)]
                    nested += [candidate(x0, a, x1 - x0, b - a) for a, b in cuts]
    return flat, nested


# --- freeform


def freeform(page: Page, background: tuple[float, float, float], delta: float = 15.0, seed: float = 0.35, most: int = 320) -> list[dict]:
    """Regions that differ from the background, parted where they narrow: seeds far from the ground, flooded.

    Distances and flooding work on a page of at most `most` pixels a side, which is enough for boxes.
    """
    ground = A.closed(A.opened(page.away(background) < delta, 1, 1), 3)
    ink = A.closed(A.opened(~ground, 2, 2), 4)
    step = max(1.0, max(page.wide, page.high) / most)
    high, wide = max(1, round(page.high / step)), max(1, round(page.wide / step))
    small = area_mean(ink.astype(np.int64) * 255, high, wide) >= 128 if step > 1 else ink
    away = S.distances(np.pad(small, 1))[1:-1, 1:-1]
    if not away.any():
        return []
    sure = away > seed * away.max()
    names = S.component_labels(sure)
    label = S.flooded(np.where(sure, names + 1, 0), away)
    out = []
    fx, fy = page.wide / small.shape[1], page.high / small.shape[0]
    for name in np.unique(label[label > 0]):
        ys, xs = np.nonzero(label == name)
        x0, y0, x1, y1 = xs.min(), ys.min(), xs.max() + 1, ys.max() + 1
        box = (x1 - x0) * (y1 - y0)
        around = S.least_rectangle(S.hull(S.Components(label == name).corners(0)))[0]
        out.append(candidate(x0 * fx, y0 * fy, (x1 - x0) * fx, (y1 - y0) * fy, len(xs) / box, min(1.0, len(xs) / around)))
    return out


# --- borders of a colour


def hsv(page: Page) -> np.ndarray:
    """Hue in half degrees (0 to 180), saturation and value (0 to 255), height x width x 3, as in functions.colour.with_hsv."""
    r, g, b = (page.channels.get(c, page.gray).astype(float) for c in "rgb")
    high = np.maximum(np.maximum(r, g), b)
    span = high - np.minimum(np.minimum(r, g), b)
    safe = np.where(span == 0, 1, span)
    turn = np.where(high == r, (g - b) / safe, np.where(high == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 60.0
    hue = np.where(span == 0, 0.0, turn % 360.0) / 2.0
    return np.stack([hue, np.where(high == 0, 0.0, span * 255.0 / np.maximum(high, 1)), high], -1)


def border_mask(page: Page, lower: tuple[int, int, int] | None = None, upper: tuple[int, int, int] | None = None) -> np.ndarray:
    """Pixels whose colour lies in a range, or without one (or with a black lower end) what is darker than its surroundings."""
    if lower is None or upper is None or not any(lower):
        return A.local_dark(np.rint(E.blurred(E.blurred(page.gray))), 99, 5)
    colour = hsv(page)
    return ((colour >= lower) & (colour <= upper)).all(-1)


def bordered(page: Page, lower: tuple | None, upper: tuple | None, close: int = 7, widen: int = 7) -> list[dict]:
    """Boxes of what borders enclose with `ink`, the share of their pixels darker by 10 than the 21 x 21 around them."""
    mask = A.dilated(A.closed(border_mask(page, lower, upper), close // 2), widen // 2, widen // 2)
    found = S.Components(mask | S.holes(mask))
    out = []
    for x0, y0, x1, y1 in zip(found.x0, found.y0, found.x1, found.y1, strict=True):
        if (x1 - x0) * (y1 - y0) >= 0.001 * page.wide * page.high:
            dark = A.local_dark(page.gray[y0:y1, x0:x1], 21, 10)
            out.append(dict(x=float(x0), y=float(y0), w=float(x1 - x0), h=float(y1 - y0), ink=float(dark.mean())))
    return out


# --- facts of a page


def gutter_runs(page: Page) -> int:
    """Runs of rows and of columns of the half-size page that are brighter than most."""
    gray = area_mean(page.gray, max(1, page.high // 2), max(1, page.wide // 2)).astype(float)
    total = 0
    for profile in (gray.mean(1), gray.mean(0)):
        at = np.flatnonzero(profile > np.percentile(profile, 85))
        total += int((np.diff(at) > 3).sum()) + 1 if len(at) else 0
    return total


def tint(page: Page, strip: int = 5) -> float:
    """Distance of the mean border colour from a fixed white."""
    lab, number = page.tones
    edge = lab[np.concatenate([x.ravel() for x in (number[:strip], number[-strip:], number[:, :strip], number[:, -strip:])])]
    return float(np.sqrt(((edge.mean(0) - [100.0, 128.0, 128.0]) ** 2).sum()))  # fixed values: the white that the rules compare with


def palette(page: Page, k: int = 4, share: float = 0.04) -> list[dict]:
    """The page's colour clusters; colours are taken in steps of 8, which bounds them at 32,768 points."""
    rgb = [(c >> 3 << 3) + 4 for c in page.rgb] if "r" in page.channels else [(page.gray.ravel() >> 3 << 3) + 4] * 3
    return C.page_clusters(*rgb, page.wide, page.high, k, share)


def tiles(page: Page, grid: int = 20, dark: int = 200) -> tuple[list[float], list[float]]:
    """Shares of dark pixels and of widened edges in each tile, row by row."""
    out = []
    ys, xs = (np.arange(grid + 1) * page.high) // grid, (np.arange(grid + 1) * page.wide) // grid
    n = np.diff(ys)[:, None] * np.diff(xs)
    for plane in (page.gray < dark, A.dilated(page.edges, 1, 1)):
        across = np.pad(plane.cumsum(1, dtype=np.int32), ((0, 0), (1, 0)))[:, xs]
        t = np.pad(across.cumsum(0), ((1, 0), (0, 0)))[ys]
        out.append(((t[1:, 1:] - t[1:, :-1] - t[:-1, 1:] + t[:-1, :-1]) / np.maximum(n, 1)).ravel().tolist())
    return out[0], out[1]
