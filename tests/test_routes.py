"""Routes, templates, edits and array helpers on drawn pages and against plain Python."""

import numpy as np
import pytest

from pagegrid.operators import arrays as A
from pagegrid.operators import editing as E
from pagegrid.operators import routes as Q
from pagegrid.operators import templates as T

PAGE = "page_id long, width int, height int, gray array<smallint>"
BOXES = "page_id long, rect_id int, x double, y double, w double, h double"


def rasters(spark, *pages):
    return spark.createDataFrame([(i, p.shape[1], p.shape[0], p.astype(int).ravel().tolist()) for i, p in enumerate(pages)], PAGE)


def outlined(height=200, width=150, boxes=((10, 10, 130, 80), (10, 105, 60, 85), (80, 105, 60, 85))):
    page = np.full((height, width), 250)
    for x, y, w, h in boxes:
        page[y : y + h, x : x + w] = 20
    return page


def found(frame):
    return sorted((r.x, r.y, r.w, r.h) for r in frame.collect())


def test_freeform_border_and_hierarchy_find_drawn_panels(spark):
    page = rasters(spark, outlined())
    want = sorted([(10.0, 10.0, 130.0, 80.0), (10.0, 105.0, 60.0, 85.0), (80.0, 105.0, 60.0, 85.0)])
    assert found(Q.freeform_route(page)) == want
    assert Q.border_mask_route(page).count() == 3
    frames = np.full((200, 150), 250)
    for x, y, w, h in ((10, 10, 130, 80), (10, 105, 60, 85)):
        frames[y : y + 4, x : x + w] = frames[y + h - 4 : y + h, x : x + w] = frames[y : y + h, x : x + 4] = frames[y : y + h, x + w - 4 : x + w] = 0
    hollow = found(Q.hierarchy_filter(Q._page_share(A.component_boxes(rasters(spark, frames), lambda g: A.closed(A.gradient(g) > 100, 1)), rasters(spark, frames)), min_fill=0.05))
    assert len(hollow) == 2


def test_lines_span_a_grid(spark):
    page = np.full((120, 100), 40)
    page[58:62] = page[:, 48:52] = 250
    segments = Q.union_segments(Q.line_segments(rasters(spark, page)), gap=8).collect()
    assert sorted((r.axis, round(r.position)) for r in segments) == [("H", 60), ("V", 50)]
    assert found(Q.line_route(rasters(spark, page))) == [(0.0, 0.0, 50.0, 60.0), (0.0, 60.0, 50.0, 60.0), (50.0, 0.0, 50.0, 60.0), (50.0, 60.0, 50.0, 60.0)]


def test_array_helpers_against_loops():
    rng = np.random.default_rng(3)
    gray = rng.integers(0, 255, (17, 13))
    mask = gray < 60
    k = 2
    for y in range(17):
        for x in range(13):
            near = (slice(max(0, y - k), y + k + 1), slice(max(0, x - k), x + k + 1))
            assert A.box_sums(gray, k)[y, x] == gray[near].sum()
            assert A.dilated(mask, k, k)[y, x] == mask[near].any()
            inner = 0 < y < 16 and 0 < x < 12
            n = gray[y - 1 : y + 2, x - 1 : x + 2] if inner else np.zeros((3, 3))
            gx = (n[:, 2] - n[:, 0]) @ [1, 2, 1]
            gy = (n[2] - n[0]) @ [1, 2, 1]
            assert A.gradient(gray)[y, x] == abs(gx) + abs(gy)
    seen, want = set(), []
    for y, x in zip(*np.nonzero(mask), strict=True):
        if (y, x) in seen:
            continue
        part, todo = [], [(y, x)]
        seen.add((y, x))
        while todo:
            a, b = todo.pop()
            part.append((a, b))
            for c in ((a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if c not in seen and 0 <= c[0] < 17 and 0 <= c[1] < 13 and mask[c]:
                    seen.add(c)
                    todo.append(c)
        ys, xs = zip(*part, strict=True)
        want.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(part)))
    assert sorted(A.components(mask)) == sorted(want)
    assert A.components(np.zeros((3, 3), bool)) == [] and A.between([(3, 4)], 8) == [(0, 3), (5, 8)]


def test_resize_averages_and_repeats(spark):
    page = rasters(spark, np.array([[0, 10], [20, 30]]))
    assert list(A.resized(page, 0.5).first().gray) == [15]
    assert list(A.resized(page, 2.0).first().gray) == [0, 0, 10, 10, 0, 0, 10, 10, 20, 20, 30, 30, 20, 20, 30, 30]


def test_template_fits_a_grid_of_blocks(spark):
    page = np.full((400, 300), 255)
    for y in (0, 200):
        for x in (0, 150):
            page[y : y + 180, x : x + 135] = 50
    scores = T.score_templates(A.tile_maps(rasters(spark, page)))
    best = T.with_best_template(spark.createDataFrame([(0, 4)], "page_id long, n int"), scores).first()
    assert best.template == "4_grid" and best.template_score > 0.5
    weak = spark.createDataFrame([(0, 1, 0.0, 0.0, 20.0, 20.0)], BOXES)
    assert T.refine(weak, scores, 300.0, 400.0).count() == 4
    strong = spark.createDataFrame([(0, i, 150.0 * (i % 2), 200.0 * (i // 2), 148.0, 198.0) for i in range(4)], BOXES)
    assert found(T.refine(strong, scores, 300.0, 400.0)) == found(strong)


def test_edits_replay(spark):
    rects = spark.createDataFrame([(1, 1, 10.0, 10.0, 100.0, 100.0), (1, 2, 120.0, 10.0, 100.0, 100.0)], BOXES)
    schema = "page_id long, rect_id int, seq long, handle string, x double, y double, dx double, dy double"
    edits = [(1, 1, 1, "delete", 0.0, 0.0, 0.0, 0.0), (1, 2, 1, "left", 0.0, 0.0, 150.0, 0.0), (1, 2, 2, "bottom_right", 0.0, 0.0, -46.0, 9.0), (1, 3, 1, "new", 5.0, 5.0, -30.0, 40.0), (1, 4, 1, "new", 5.0, 5.0, 19.0, 40.0)]
    assert found(E.apply_edits(rects, spark.createDataFrame(edits, schema))) == [(-25.0, 5.0, 30.0, 40.0), (220.0, 10.0, 50.0, 100.0)]
    assert found(E.apply_edits(rects, spark.createDataFrame(edits[:0], schema))) == found(rects)


def test_config_drops_unknown_settings(spark):
    got = E.config_table(spark.createDataFrame([(7, '{"min_rect_px": 12, "no_such_setting": 1}')], "page_id long, json string")).first()
    assert got.min_rect_px == 12 and got.adaptive_block is None and "no_such_setting" not in got.asDict()
    assert E.presets_table(spark).count() == 3


def test_routes_can_be_passed_and_switched_off(spark):
    whole = lambda r: r.selectExpr("page_id", "1 as rect_id", "0.0D as x", "0.0D as y", "cast(width as double) as w", "cast(height as double) as h")
    page = rasters(spark, outlined())
    assert set(Q.enabled_routes({"lsd": False})) == {"adaptive", "hierarchy", "gutter"}
    assert found(Q.core_detection(page, 150.0, 200.0, routes={"whole": whole})) == [(0.0, 0.0, 150.0, 200.0)]
    saved = spark.createDataFrame([(0, 1, 1.0, 2.0, 30.0, 40.0)], BOXES)
    assert found(Q.detect_pages(page, 150.0, 200.0, corrected=saved)) == [(1.0, 2.0, 30.0, 40.0)]
    assert Q.detect_pages(page, 150.0, 200.0, routes={"freeform": Q.freeform_route}).count() == 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], PAGE)
    for route in (*Q.ROUTES.values(), Q.freeform_route, Q.border_mask_route):
        assert route(none).collect() == []


@pytest.mark.parametrize("share", [0.6, 1.0])
def test_scales_agree_on_drawn_panels(spark, share):
    page = rasters(spark, outlined(400, 300, ((20, 20, 260, 160), (20, 210, 120, 170), (160, 210, 120, 170))))
    got = Q.multiscale_detection(page, 300.0, 400.0, scales=(share, 1.0), routes={"freeform": Q.freeform_route})
    assert got.count() == 3


def test_outlines_are_told_by_what_they_enclose(spark):
    """Thin frames, one inside another and one with a gap, and a diagonal outline that sides cannot leave."""
    gray = np.full((60, 80), 255)
    for x0, y0, x1, y1 in ((5, 5, 35, 55), (45, 5, 75, 30), (50, 10, 70, 25)):
        gray[[y0, y1], x0 : x1 + 1] = 0
        gray[y0 : y1 + 1, [x0, x1]] = 0
    gray[40:56, 45], gray[40:56, 75], gray[40, 45:76], gray[55, 45:60] = 0, 0, 0, 0  # open at the bottom
    mask = gray == 0
    want = {(6.0, 6.0, 29.0, 49.0), (46.0, 6.0, 29.0, 24.0), (51.0, 11.0, 19.0, 14.0)}
    assert {b[:4] for b in A.components(A.holes(mask), diagonal=False)} == want
    assert {b[:4] for b in A.outlines(mask)} - want == {(5.0, 5.0, 31.0, 51.0), (45.0, 5.0, 31.0, 26.0), (45.0, 40.0, 31.0, 16.0)}
    diamond = np.abs(np.arange(11)[:, None] - 5) + np.abs(np.arange(11)[None] - 5) == 4
    assert A.holes(diamond).sum() == 25 and not A.holes(np.zeros((4, 4), bool)).any()
    page = spark.createDataFrame([(1, 80, 60, gray.ravel().tolist())], A.MASK)
    boxes = Q.hierarchy_route(page).collect()
    assert any(abs(b.x - 4) <= 1 and abs(b.w - 33) <= 2 and abs(b.h - 53) <= 2 for b in boxes)
    assert all(b.x < 40 or b.y < 35 for b in boxes)  # the open one encloses nothing
