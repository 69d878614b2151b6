"""Kernels of neighbourhoods against plain Python, and frames of pages of mixed sizes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegrid.operators import arrays as A
from pagegrid.operators import edges as E
from pagegrid.operators import finders as N
from pagegrid.operators import masks as M
from pagegrid.operators import pages as P
from pagegrid.operators import stencils as S
from pagegrid.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def noise(h, w, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w)).astype(np.int64)


def around(plane, y, x, ky, kx):
    return plane[max(0, y - ky) : y + ky + 1, max(0, x - kx) : x + kx + 1]


@pytest.mark.parametrize("kx,ky", [(0, 0), (1, 2), (3, 0), (5, 4), (20, 20)])
def test_extremes_are_those_of_the_surroundings(kx, ky):
    g = noise(13, 17)
    for op, f in (("erode", np.min), ("dilate", np.max)):
        got = S.extremes(g, op, kx, ky)
        assert all(got[y, x] == f(around(g, y, x, ky, kx)) for y in range(13) for x in range(17))
    assert (S.extremes(g, "open", kx, ky) <= g).all() and (S.extremes(g, "close", kx, ky) >= g).all()


def test_repeated_steps_are_steps_in_a_row():
    g = noise(9, 11)
    assert (S.extremes(g, "dilate", 1, 1, times=3) == S.extremes(S.extremes(S.extremes(g, "dilate", 1, 1), "dilate", 1, 1), "dilate", 1, 1)).all()


def test_scharr_at_one_place():
    g = noise(5, 5)
    gx = sum(k * (g[2 + i, 3] - g[2 + i, 1]) for i, k in ((-1, 3), (0, 10), (1, 3)))
    gy = sum(k * (g[3, 2 + i] - g[1, 2 + i]) for i, k in ((-1, 3), (0, 10), (1, 3)))
    got = S.scharr(g)
    assert math.isclose(got[2, 2], math.hypot(gx, gy)) and not got[0].any() and not got[:, -1].any()


def test_gaussian_mean_at_every_place():
    g, k = noise(8, 9), 2
    spread = 0.3 * ((5 - 1) * 0.5 - 1) + 0.8
    weight = [math.exp(-(i * i) / (2 * spread * spread)) for i in range(-k, k + 1)]
    got = S.gaussian_mean(g, 5)
    for y in range(8):
        for x in range(9):
            want = sum(weight[a + k] * weight[b + k] * g[min(max(y + a, 0), 7), min(max(x + b, 0), 8)] for a in range(-k, k + 1) for b in range(-k, k + 1))
            assert math.isclose(got[y, x], want / sum(weight) ** 2)
    assert np.allclose(S.gaussian_mean(np.full((4, 4), 9), 3), 9)


def plain_equalised(g, tiles, clip):
    """Tones of each pixel by the tables of the tiles whose middles surround it, one pixel at a time."""
    h, w = g.shape
    table = {}
    for ty in range(tiles):
        for tx in range(tiles):
            own = [int(g[y, x]) for y in range(h) for x in range(w) if y * tiles // h == ty and x * tiles // w == tx]
            cut = [min(own.count(v), max(1.0, clip * len(own) / 256)) for v in range(256)]
            spare = (len(own) - sum(cut)) / 256
            table[ty, tx] = [(sum(cut[: v + 1]) + (v + 1) * spare) * 255 / len(own) for v in range(256)]
    out = np.empty((h, w))
    for y in range(h):
        for x in range(w):
            py, px = (y + 0.5) * tiles / h - 0.5, (x + 0.5) * tiles / w - 0.5
            out[y, x] = 0
            for ty, part_y in ((math.floor(py), 1 - (py - math.floor(py))), (math.floor(py) + 1, py - math.floor(py))):
                for tx, part_x in ((math.floor(px), 1 - (px - math.floor(px))), (math.floor(px) + 1, px - math.floor(px))):
                    out[y, x] += part_y * part_x * table[min(max(ty, 0), tiles - 1), min(max(tx, 0), tiles - 1)][g[y, x]]
    return out


def test_blended_tones_are_those_of_plain_python():
    g = noise(21, 18, 3)
    assert np.allclose(S.equalised(g, 4, 2.0), plain_equalised(g, 4, 2.0))


def test_blended_tones_have_no_seams():
    g = np.tile(np.arange(128, dtype=np.int64), (128, 1))  # an even slope, without steps above 1
    plain, blended = S.equalised(g, 8, blend=False), S.equalised(g, 8)
    seam = lambda p: np.abs(np.diff(p, axis=1)).max()
    assert seam(blended) < 8 < seam(plain)


def test_tiny_pages_are_equalised_too():
    assert S.equalised(noise(3, 2), 8).shape == (3, 2)


def stacked(high=240, wide=300):
    """Two columns; the left one holds two panels, one above the other."""
    g = np.full((high, wide), 250, np.int16)
    g[10:230, 160:290] = 60
    g[10:110, 10:140] = 60
    g[122:230, 10:140] = 60
    return g


def test_a_cell_is_split_by_its_own_gutter():
    g = stacked()
    assert S.in_boxes(g, [dict(x=10, y=10, w=130, h=100)]) == [130 * 100 * 60]
    assert N.sub_gutter(g[10:230, 10:140]) == (100, 111)
    assert N.sub_gutter(g[10:230, 160:290]) is None
    assert N.sub_gutter(g[100:150, 10:140]) is None  # too low to be split
    _, nested = N.gutter_grids(P.Page(300, 240, {"gray": g.ravel()}))
    assert len([c for c in nested if c["x"] < 150]) == 2 and len([c for c in nested if c["x"] >= 150]) == 1


def test_sums_in_boxes_are_cut_to_the_page():
    g = noise(10, 12)
    boxes = [dict(x=-3, y=-3, w=6, h=6), dict(x=8, y=8, w=50, h=50), dict(x=40, y=2, w=3, h=3), dict(x=2, y=1, w=0, h=4)]
    assert S.in_boxes(g, boxes) == [int(g[:3, :3].sum()), int(g[8:, 8:].sum()), 0, 0] and S.in_boxes(g, []) == []


def pages(spark, *planes):
    rows = [(i, p.shape[1], p.shape[0], p.ravel().tolist()) for i, p in enumerate(planes)]
    return spark.createDataFrame(rows, "page_id long, width int, height int, gray array<smallint>")


def test_planes_of_pages_of_mixed_sizes(spark):
    a, b = noise(7, 9), noise(12, 5, 1)
    seen = S.as_pixels(S.with_plane(pages(spark, a, b), lambda g: S.extremes(g, "dilate", 1, 1), kind="bigint")).collect()
    for i, p in enumerate((a, b)):
        want = S.extremes(p, "dilate", 1, 1)
        mine = {(r.y, r.x): r.v for r in seen if r.page_id == i}
        assert len(mine) == p.size and all(mine[y, x] == want[y, x] for y in range(p.shape[0]) for x in range(p.shape[1]))


def test_totals_of_pages_with_and_without_boxes(spark):
    p = pages(spark, noise(7, 9), noise(12, 5, 1)).withColumn("boxes", F.expr("if(page_id = 0, array(struct(1D as x, 1D as y, 3D as w, 2D as h)), cast(null as array<struct<x:double,y:double,w:double,h:double>>))"))
    got = {r.page_id: r.totals for r in S.with_totals(p, "boxes", {"light": lambda page: page.gray}).collect()}
    assert got[0][0].light == noise(7, 9)[1:3, 1:4].sum() and got[1] == []


def test_plans_do_not_shuffle_pixels(spark):
    seen = S.as_pixels(S.with_plane(pages(spark, noise(7, 9)), S.scharr))
    assert "Exchange" not in seen._jdf.queryExecution().executedPlan().toString()


def test_profiles_leave_the_margins_out(spark):
    g = noise(100, 50)
    got = {r.idx: r.mean_v for r in S.interior_profile(pages(spark, g), axis=0).collect()}
    assert sorted(got) == list(range(3, 97)) and math.isclose(got[40], g[40, 1:49].mean())


def test_smoothing_fits_both_ends_and_leaves_short_profiles(spark):
    cubic = [(1, i, float(i**3 - 40 * i)) for i in range(30)] + [(2, i, float(i % 3)) for i in range(5)]
    got = {(r.page_id, r.idx): r.smooth for r in M.smooth_profile(spark.createDataFrame(cubic, "page_id long, idx int, v double"), 11, 3).collect()}
    assert len(got) == 35 and all(abs(got[p, i] - v) < 1e-4 for p, i, v in cubic)


@pytest.mark.parametrize("name", ["p5_background_mask", "s5_resize", "p3_to_lab", "q3_components_route", "a10_border_background", "g1_grid_components", "f9_stripe_filter"])
def test_pixels_stay_in_their_page(spark, name):
    """Pages are dealt out before they have pixels, and none of these is shuffled."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "Generate explode(" not in plan


@pytest.mark.parametrize("share", [0.0, 0.25, 0.92, 1.0])
def test_quantiles_by_counts(share):
    g = noise(13, 17)
    assert A.quantile(g, share) == pytest.approx(np.quantile(g, share))


def test_edges_in_whole_numbers_are_those_of_the_blurred_page():
    g = noise(40, 50) // 64 * 64
    thin = E.ridge(*E.slopes(E.blurred(g)))
    want = np.zeros(g.shape, bool)
    for low, high in E.LIMITS:
        want |= E.grown(thin, low, high)
    assert (E.voted_edges(g) == want).all() and want.any()


def test_outlines_that_begin_at_the_pages_edge():
    mask = np.zeros((12, 12), bool)
    mask[::2, 0] = mask[3:9, 3:9] = True
    assert [b["x"] for b in N.nested_outlines(mask, 5.0)] == [3.0]
