"""Whole-page detection on drawn pages, and its kernels against plain Python."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagegrid.operators import arrays as A
from pagegrid.operators import detection as D
from pagegrid.operators import edges as E
from pagegrid.operators import finders as N
from pagegrid.operators import pages as P
from pagegrid.operators import shapes as S
from pagegrid.sources import files


def flood(mask, diagonal):
    """Component numbers by a plain search."""
    h, w = mask.shape
    out = np.full((h, w), h * w)
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    for y, x in zip(*np.nonzero(mask), strict=True):
        if out[y, x] < h * w:
            continue
        todo, out[y, x] = [(y, x)], y * w + x
        while todo:
            cy, cx = todo.pop()
            for a, b in steps:
                p, q = cy + a, cx + b
                if 0 <= p < h and 0 <= q < w and mask[p, q] and out[p, q] == h * w:
                    out[p, q] = y * w + x
                    todo.append((p, q))
    return out


@pytest.mark.parametrize("diagonal", [True, False])
def test_labels_are_those_of_a_plain_search(diagonal):
    rng = np.random.default_rng(1)
    for _ in range(60):
        mask = rng.random(rng.integers(1, 24, 2)) < rng.random()
        want = flood(mask, diagonal)
        assert (S.component_labels(mask, diagonal) == want).all()
        boxes = []
        for name in np.unique(want[mask]):
            ys, xs = np.nonzero(want == name)
            boxes.append((xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1, len(xs)))
        assert S.components(mask, diagonal) == boxes
        outside = np.unique(np.concatenate([e for e in (flood(~mask, False)[[0, -1]].ravel(), flood(~mask, False)[:, [0, -1]].ravel())]))
        assert (S.holes(mask) == (~mask & ~np.isin(flood(~mask, False), outside))).all()


def test_distances_hulls_and_least_rectangles():
    rng = np.random.default_rng(2)
    for _ in range(30):
        mask = rng.random(rng.integers(2, 20, 2)) < 0.7
        if mask.all() or not mask.any():
            continue
        ys, xs = np.nonzero(~mask)
        away = np.sqrt(((np.arange(mask.shape[0])[:, None, None] - ys) ** 2 + (np.arange(mask.shape[1])[None, :, None] - xs) ** 2).min(-1))
        assert np.allclose(S.distances(mask), np.where(mask, away, 0))
    yy, xx = np.mgrid[:200, :200]
    u, v = (xx - 100) * np.cos(0.5) + (yy - 100) * np.sin(0.5), (yy - 100) * np.cos(0.5) - (xx - 100) * np.sin(0.5)
    tilted = (abs(u) <= 60) & (abs(v) <= 30)
    corners = S.hull(S.Components(tilted).corners(0))
    area, length, angle = S.least_rectangle(corners)
    assert abs(area - 120 * 60) < 0.06 * 120 * 60 and abs(length - 120) < 4 and min(abs(angle % 90 - np.degrees(0.5)), 90) < 2
    assert S.polygon_area(corners) >= tilted.sum()


def test_tilted_panels_pass_where_upright_fill_would_not():
    page = np.full((400, 400), 250)
    yy, xx = np.mgrid[:400, :400]
    u, v = (xx - 200) * np.cos(0.7) + (yy - 200) * np.sin(0.7), (yy - 200) * np.cos(0.7) - (xx - 200) * np.sin(0.7)
    page[(abs(u) <= 120) & (abs(v) <= 60)] = 30
    found = N.hierarchy(P.Page(400, 400, {"gray": page}))
    assert found and all(c["rectangularity"] > 0.9 and c["fill"] < 0.6 for c in found)


def test_hysteresis_against_loops():
    rng = np.random.default_rng(3)
    thin = np.where(rng.random((30, 30)) < 0.4, rng.integers(1, 200, (30, 30)), 0).astype(float)
    label = flood(thin > 40, True)
    want = np.isin(label, np.unique(label[(thin > 150) & (label < 900)]))
    assert (E.grown(thin, 40, 150) == want).all()


def test_slanted_lines_are_voted():
    mask = np.zeros((300, 300), bool)
    for x in range(20, 280):
        mask[int(round(100 + np.tan(np.radians(5)) * x)), x] = True
    mask[40:260, 150] = True
    found = sorted(E.voted_lines(mask, 60))
    assert [axis for axis, *_ in found] == [0, 1]
    assert abs(found[0][4] - found[0][2] - np.tan(np.radians(5)) * 259) < 3
    mask[:] = False
    for x in range(20, 280):
        mask[int(round(20 + np.tan(np.radians(20)) * x)), x] = True
    assert E.voted_lines(mask, 60) == []


def test_touching_panels_are_parted():
    page = np.full((300, 400), 250)
    page[40:260, 30:180] = 60
    page[60:240, 220:370] = 90
    page[140:160, 180:220] = 60
    p = P.Page(400, 300, {"gray": page})
    found = N.freeform(p, tuple(p.lab[0, 0]))
    assert len(found) == 2 and sorted(c["x"] for c in found)[1] > 180


def test_gutters_that_profiles_miss():
    # a gray-lit page: bright content beside the gutter hides it from row means, the even stripe shows it
    rng = np.random.default_rng(5)
    page = rng.integers(150, 256, (600, 400)).astype(np.int16)
    page[292:308] = 245
    assert A.bright_bands(page.astype(float).mean(1), 0.65, 30, 5, 3) == [(292, 307)] or A.bright_bands(page.astype(float).mean(1), 0.65, 30, 5, 3) == []
    bands = N.mask_bands(N.gutter_mask(P.Page(400, 600, {"gray": page})), 0)
    assert len(bands) == 1 and 292 <= bands[0][0] <= bands[0][1] <= 307


def test_smoothing_keeps_cubics_and_peaks_part():
    x = np.linspace(-1, 1, 120)
    assert np.allclose(N.smoothed(x**3 - x), x**3 - x)
    v = np.zeros(200)
    v[[50, 60, 120]] = [3, 2, 1]
    assert N.peaks(v, 0.5, 30, 0.1).tolist() == [50, 120]
    assert N.peaks(v, 0.5, 5, 1.5).tolist() == [50, 60]


def test_measures_of_boxes(spark):
    rng = np.random.default_rng(6)
    gray = rng.integers(0, 256, (30, 40))
    boxes = [(0.0, 0.0, 40.0, 30.0), (3.7, 4.2, 10.0, 7.9), (35.0, 25.0, 50.0, 50.0)]
    frame = spark.createDataFrame([(1, 40, 30, gray.ravel().tolist(), [dict(zip("xywh", b, strict=True)) for b in boxes], {"L": 0.0, "A": 128.0, "B": 128.0})], f"page_id long, width int, height int, gray array<smallint>, boxes {D.BOXES}, ground struct<L:double,A:double,B:double>")
    got = P.with_measures(frame, "boxes", "ground", delta=50.0).first()
    light = P.Page(40, 30, {"gray": gray}).light
    for m, (x, y, w, h) in zip(got.measured, boxes, strict=True):
        cut = (slice(int(y), min(30, int(y) + int(h))), slice(int(x), min(40, int(x) + int(w))))
        want = gray[cut].mean(), gray[cut].std(), (gray[cut] <= 200).mean(), (light[cut] > 50).mean()
        assert np.allclose((m.mean, m.std, m.dark), want[:3]) and abs(m.non_bg - want[3]) < 0.02


# --- whole pages from image files of several sizes


def png(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape[:2]
    rows = b"".join(b"\0" + r.tobytes() for r in pixels.astype(np.uint8))
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def disc(page, cx, cy, r, colour):
    yy, xx = np.mgrid[: page.shape[0], : page.shape[1]]
    page[(xx - cx) ** 2 + (yy - cy) ** 2 <= r * r] = colour


def soft(page, k):
    for axis in (0, 1):
        pad = [(k + 1, k) if a == axis else (0, 0) for a in range(3)]
        c = np.cumsum(np.pad(page, pad, mode="edge"), axis=axis)
        page = (np.take(c, range(2 * k + 1, c.shape[axis]), axis) - np.take(c, range(c.shape[axis] - 2 * k - 1), axis)) / (2 * k + 1)
    return page


def cover():
    """One picture, all edges soft."""
    page = np.full((1007, 720, 3), (120.0, 80.0, 60.0))
    disc(page, 360, 550, 300, (200, 150, 100))
    disc(page, 360, 250, 120, (220, 170, 130))
    for _ in range(3):
        page = soft(page, 15)
    return page


def dark_gutters():
    page = np.full((1007, 720, 3), 255.0)
    page[330:340] = page[:, 355:365] = 0
    page[20:321, 20:341], page[20:321, 380:701], page[360:981, 20:701] = (180, 120, 80), (80, 120, 180), (80, 180, 80)
    return page


def light_panels():
    page = np.zeros((1200, 800, 3))
    page[100:401, 50:751] = page[450:951, 60:381] = page[450:951, 420:741] = 255
    return page


def framed():
    page = np.full((800, 600, 3), 255.0)
    for x0, y0, x1, y1 in ((20, 20, 290, 390), (310, 20, 580, 390), (20, 410, 580, 780)):
        page[y0 - 1 : y1 + 2, x0 - 1 : x1 + 2] = 0
        page[y0 + 2 : y1 - 1, x0 + 2 : x1 - 1] = 255
    for cx, cy, r, c in ((150, 200, 50, (100, 50, 50)), (450, 200, 50, (50, 100, 50)), (300, 600, 80, (50, 50, 100))):
        disc(page, cx, cy, r, c)
    return page


@pytest.fixture(scope="module")
def image_pages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pages")
    for i, draw in enumerate((cover, dark_gutters, light_panels, framed)):
        (folder / f"book_page_{i:03d}.png").write_bytes(png(draw()))
    (folder / "book_page_009.png").write_bytes(b"no image")
    return P.from_images(files.read_pages(spark, str(folder)))


def test_images_of_mixed_sizes(spark, image_pages):
    saved = spark.createDataFrame([(3, [])], f"page_id long, boxes {D.BOXES}")
    found = D.detect(image_pages).cache()
    got = {r.page_id: r for r in found.collect()}
    assert {i: (r.width, r.height) for i, r in got.items()} == {0: (720, 1007), 1: (720, 1007), 2: (800, 1200), 3: (600, 800)}
    assert [tuple(b) for b in got[0].panels] == [(0, 0, 720, 1007)] and got[0].fate == "whole"
    near = lambda boxes, want: len(boxes) == len(want) and all(np.allclose(b, w, atol=4) for b, w in zip(boxes, want, strict=True))
    assert near(got[1].panels, [(20, 20, 321, 301), (380, 20, 321, 301), (20, 360, 681, 621)])
    assert near(got[2].panels, [(50, 100, 701, 301), (60, 450, 321, 501), (420, 450, 321, 501)])
    assert near(got[3].panels, [(19, 19, 273, 373), (309, 19, 273, 373), (19, 409, 563, 373)])
    assert got[1].style == "classic_franco_belge" and got[0].style == "modern" and got[1].n_routes["gutter"] == 3
    assert D.panels(found).count() == 10
    assert saved.count() == 1
    found.unpersist()


def test_borders_of_a_colour_and_dark_ones(spark, tmp_path):
    def page(colour):
        out = np.full((500, 400, 3), 255.0)
        for x0, y0, x1, y1 in ((20, 20, 190, 240), (210, 30, 380, 240), (20, 260, 380, 480)):
            out[y0:y1, x0:x1] = colour
            out[y0 + 6 : y1 - 6, x0 + 6 : x1 - 6] = 255
        disc(out, 100, 120, 40, (200, 30, 30))
        return out

    import colorsys

    rng = np.random.default_rng(9)
    some = rng.integers(0, 256, (6, 7, 3))
    p = P.Page(7, 6, {"gray": some[..., 0], **{c: some[..., k] for k, c in enumerate("rgb")}})
    want = [[colorsys.rgb_to_hsv(*(v / 255)) for v in row] for row in some]
    assert np.allclose(N.hsv(p), np.array(want) * [180, 255, 255], atol=1e-6)
    for name, colour in (("green", (30, 200, 40)), ("black", (0, 0, 0))):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "a_page_001.png").write_bytes(png(page(colour)))
        images = P.from_images(files.read_pages(spark, str(folder)))
        found = D.detect_bordered(images, *(((45, 80, 80), (80, 255, 255)) if name == "green" else (None, None))).first()
        assert len(found.panels) == 3 and np.allclose([tuple(b) for b in found.panels], [(20, 20, 170, 220), (210, 30, 170, 210), (20, 260, 360, 220)], atol=8)


def test_switches_and_saved_corrections(spark):
    small = np.full((120, 100), 250, np.int16)
    small[6:56, 6:94] = small[64:114, 6:94] = 40
    pages = spark.createDataFrame([(i, 100, 120, small.ravel().tolist()) for i in range(3)], "page_id long, width int, height int, gray array<smallint>")
    saved = spark.createDataFrame([(0, []), (1, [(1.0, 2.0, 3.0, 4.0)])], f"page_id long, boxes {D.BOXES}")
    got = {r.page_id: r for r in D.detect(pages, saved, off=("lsd", "gutter"), mode="classic_franco_belge", titles=True, rtl=True).collect()}
    assert got[0].panels == [] and [tuple(b) for b in got[1].panels] == [(1, 2, 3, 4)] and got[0].fate == "corrected"
    assert len(got[2].panels) == 2 and set(got[2].n_routes) <= {"adaptive", "hierarchy"} and got[2].style == "classic_franco_belge"
    assert D.detect(pages.filter("false")).collect() == []


def test_rules_over_boxes(spark):
    boxes = [(0, 0, 100, 100), (10, 10, 20, 20), (5, 0, 100, 100), (300, 0, 40, 40)]
    frame = spark.createDataFrame([(1, [tuple(map(float, b)) for b in boxes])], f"page_id long, b {D.BOXES}")
    b = F.col("b")
    one = frame.select(
        D.merged(b, 0.5).alias("merged"), D.without_nested(b).alias("outer"), D.nested_absorbed(b).alias("absorbed"), D.regions_merged(b, 0.5).alias("regions"),
        D.covered(b, F.lit(20000.0)).alias("covered"), D.in_reading_order(b, F.lit(20.0), True).alias("order"),
    ).first()
    as_tuples = lambda xs: [tuple(x) for x in xs]
    assert as_tuples(one.merged) == [(0, 0, 105, 100), (10, 10, 20, 20), (300, 0, 40, 40)] and as_tuples(one.regions) == as_tuples(one.merged)
    assert as_tuples(one.outer) == [(0, 0, 100, 100), (300, 0, 40, 40)]
    assert as_tuples(one.absorbed) == [(0, 0, 100, 100), (5, 0, 100, 100), (300, 0, 40, 40)]
    assert one.covered == (105 * 100 + 1600) / 20000
    assert as_tuples(one.order)[0] == (300, 0, 40, 40)


def test_clear_edges_are_grown_once(monkeypatch):
    """Pairs of limits that part the same pixels are looked at once."""
    gray = np.full((60, 80), 250, np.int16)
    gray[10:50, 20:60] = 40
    soft = np.random.default_rng(3).integers(90, 140, (60, 80)).astype(np.int16)
    calls, grown = [], E.grown
    every = [grown(E.steep_ridge(*E.slopes(np.rint(16 * E.blurred(g)).astype(np.int32)), 480), 16 * low, 16 * high) for g in (gray, soft) for low, high in E.LIMITS]
    monkeypatch.setattr(E, "grown", lambda *x: calls.append(x) or grown(*x))
    assert (E.voted_edges(gray) == every[0] | every[1] | every[2]).all() and len(calls) == 1
    assert (E.voted_edges(soft) == every[3] | every[4] | every[5]).all() and len(calls) > 2


def test_hulls_look_at_few_points():
    """Of a box's rows only the corners are left to sort; of any points the same corners as by all of them."""
    box = np.array([(x, y) for y in range(500) for x in (3, 90)])
    assert len(S.outermost(box)) == 4 and S.hull(box).tolist() == [[3, 0], [90, 0], [90, 499], [3, 499]]
    rng = np.random.default_rng(4)
    for _ in range(50):
        points = rng.integers(0, 12, (rng.integers(1, 40), 2))
        corners = {tuple(p) for p in S.hull(points).tolist()}
        distinct = {tuple(p) for p in points.tolist()}
        for p in distinct:  # a corner: all others lie within less than half a turn as seen from it
            angle = sorted(np.arctan2(y - p[1], x - p[0]) for x, y in distinct - {p})
            gaps = np.diff([*angle, angle[0] + 2 * np.pi]) if angle else [2 * np.pi]
            assert (p in corners) == (max(gaps) > np.pi + 1e-9) or len(distinct) < 3


def test_pixels_go_on_as_bytes(spark):
    """Between the steps of detect() pixels are bytes, whatever part of a batch a page is in; the pixels are the same."""
    rng = np.random.default_rng(6)
    planes = [rng.integers(0, 256, (h, w)).astype(np.int16) for h, w in ((3, 4), (2, 5), (1, 1))]
    lists = pa.array([p.ravel() for p in planes])
    assert [np.frombuffer(x.as_buffer(), np.int16).tolist() for x in P.as_bytes(lists.slice(1))] == [p.ravel().tolist() for p in planes[1:]]
    pages = spark.createDataFrame([(i, p.shape[1], p.shape[0], p.ravel().tolist()) for i, p in enumerate(planes)], "page_id long, width int, height int, gray array<smallint>")
    once = P.with_columns(pages, lambda p: (int(p.gray.sum()),), "a bigint", pack=True)
    again = P.with_columns(once, lambda p: (int((p.gray * 3).sum()),), "b bigint", drop_pixels=True)
    assert dict(once.dtypes)["gray"] == "binary" and "gray" not in again.columns
    assert sorted((r.page_id, r.a, r.b) for r in again.collect()) == [(i, int(p.sum()), 3 * int(p.sum())) for i, p in enumerate(planes)]
