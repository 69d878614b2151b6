"""Folds against plain Python, components on drawn masks, files and streams."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegrid.operators import layout as Y
from pagegrid.operators import library as L
from pagegrid.operators import masks as M
from pagegrid.operators import rects as R
from pagegrid.plans.catalog import QUERIES
from pagegrid.sources import files, views
from pagegrid.streaming import jobs

SF = "/root/testdata/sf0.001"


def boxes(spark, rows):
    return spark.createDataFrame([(1, i, i % 3, *map(float, r)) for i, r in enumerate(rows)], "page_id long, rect_id int, scale_id int, x double, y double, w double, h double")


def inter(a, b):
    return max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))


def size(a):
    return a[2] * a[3]


def union(a, b):
    x, y = min(a[0], b[0]), min(a[1], b[1])
    return (x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y)


def some_boxes(seed, n=14):
    rng = random.Random(seed)
    return [(rng.randrange(60), rng.randrange(60), rng.choice((4, 9, 40, 90)), rng.choice((4, 9, 40, 90))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suppress_nested_as_in_plain_python(spark, seed):
    r = some_boxes(seed)
    gone, grown = set(), {}
    for i, s in enumerate(r):
        for j, b in enumerate(r):
            if j not in gone and size(s) < size(b) and size(s) / size(b) <= 0.25 and inter(s, b) >= 0.9 * size(s):
                grown[j] = union(s, b)
                gone.add(i)
                break
    want = {i: tuple(map(float, grown.get(i, b))) for i, b in enumerate(r) if i not in gone}
    got = {x.rect_id: (x.x, x.y, x.w, x.h) for x in Y.suppress_nested(boxes(spark, r)).collect()}
    assert got == want and gone


@pytest.mark.parametrize("seed", [4, 5])
def test_merge_regions_as_in_plain_python(spark, seed):
    r = some_boxes(seed)
    used, want = set(), {}
    for i, s in enumerate(r):
        if i in used:
            continue
        box = s
        for j in range(i + 1, len(r)):
            both = inter(s, r[j])
            if j not in used and both / (size(s) + size(r[j]) - both) > 0.2:
                used.add(j)
                box = union(box, r[j])
        want[i] = tuple(map(float, box))
    assert {x.rect_id: (x.x, x.y, x.w, x.h) for x in Y.merge_regions(boxes(spark, r)).collect()} == want


def test_consensus_needs_two_scales(spark):
    r = boxes(spark, [(0, 0, 100, 100), (4, 0, 100, 100), (500, 500, 50, 50)])
    got = Y.consensus(r).collect()
    assert [(x.x, x.y, x.w, x.h) for x in got] == [(2.0, 0.0, 100.0, 100.0)]
    assert Y.consensus(r.filter("false")).collect() == []


def test_components_touch_at_corners(spark):
    art = ["##..#", "..#..", "....#", "#...#"]
    px = spark.createDataFrame([(7, y, x) for y, row in enumerate(art) for x, c in enumerate(row) if c == "#"], "page_id long, y int, x int")
    got = sorted((r.x, r.y, r.w, r.h, r.n_pixels) for r in M.grid_components(px).collect())
    assert got == [(0, 0, 3, 2, 3), (0, 3, 1, 1, 1), (4, 0, 1, 1, 1), (4, 2, 1, 2, 2)]


def test_peaks_are_apart_and_prominent(spark):
    v = [0, 9, 0, 8, 0, 0, 0, 5, 4, 6, 0]
    p = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "page_id long, idx int, v double")
    near = M.space_peaks(M.local_peaks(p, 0.0), 3)
    assert sorted(r.idx for r in near.collect()) == [1, 9]
    rise = {r.idx: r.prominence for r in M.prominent(M.local_peaks(p, 0.0), p, 0.0).collect()}
    assert rise == {1: 9.0, 3: 8.0, 7: 1.0, 9: 6.0}


def test_pixels_to_boxes(spark):
    got = {r.page_id: r["count"] for r in QUERIES["q3_components_route"](spark, SF).groupBy("page_id").count().collect()}
    assert got and all(n == 2 + p % 3 for p, n in got.items())


def png(path, w, h, rgb):
    rows = b"".join(b"\0" + bytes(rgb) * w for _ in range(h))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_images_become_pixels(spark, tmp_path):
    png(tmp_path / "a_page_012.png", 30, 20, (200, 100, 50))
    (tmp_path / "broken_page_013.png").write_bytes(b"no image")
    pages = files.read_pages(spark, str(tmp_path))
    assert [(r.page_id, r.width_pt) for r in pages.collect()] == [(12, 14.4)]
    px = files.pixels_of(files.scanlines(pages))
    assert px.count() == 600 and abs(px.first().v - (200 * 0.299 + 100 * 0.587 + 50 * 0.114)) < 1e-9


def test_panel_files_round_trip(spark, tmp_path):
    r = boxes(spark, [(1, 2, 30, 40), (5, 6, 70, 80)]).withColumn("image_path", F.lit("p.png"))
    files.write_panel_json(r, str(tmp_path / "j"), 100, 200)
    got = sorted((x.rect_id, x.x, x.y, x.w, x.h) for x in files.read_panel_json(spark, str(tmp_path / "j")).collect())
    assert got == [(1, 1, 2, 30, 40), (2, 5, 6, 70, 80)]
    lines = files.report_lines(r, 2.0).first().value.split("\n")
    assert lines[0] == "panel_count=2" and lines[1].startswith("panel 0 px=(2,4,60,80)")


def test_streams_agree_with_their_batch_twins(spark, tmp_path):
    rows = views.actions(spark, SF)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name in ("latest_tasks", "open_tasks", "corrections_state"):
        job = getattr(jobs, name)
        job(stream()).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
        assert sorted(map(tuple, spark.table(name).collect()), key=str) == sorted(map(tuple, job(rows).collect()), key=str)


def test_pages_are_detected_once(spark, tmp_path):
    for k in (0, 1):
        spark.range(5 * k, 5 * k + 8).withColumnRenamed("id", "page_id").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    pages = spark.readStream.schema("page_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.detect_stream(pages, lambda df: df, str(tmp_path / "out"), str(tmp_path / "cp"), "h1").awaitTermination()
    got = [r.page_id for r in spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == list(range(13))


def test_correction_keys_of_long_page_numbers(spark):
    pages = [7, 1234, 12340, 12349, 1234567, None]
    frame = spark.createDataFrame([(p,) for p in pages], "page long")
    got = {r.page: r.key for r in frame.select("page", L.correction_key(F.lit("/lib/a.pdf"), F.col("page")).alias("key")).collect()}
    assert {p: k and k.split("_page")[1] for p, k in got.items()} == {p: None if p is None else f"{p:04d}" for p in pages}


def test_a_group_is_formed_once_and_a_sweep_groups_pages_only(spark):
    from pagegrid.plans.catalog import QUERIES

    plan = lambda name: QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert plan("m2_merge_regions").count("filter(items") == 1 and plan("j5_consensus").count("filter(items") == 1
    assert "Aggregate [config_id" not in plan("j14_sweep")


def test_coverage_meets_a_pages_boxes_once(spark):
    rng = random.Random(4)
    pages = {p: [(rng.randrange(12), rng.randrange(12), rng.randrange(6), rng.randrange(6)) for _ in range(rng.choice((1, 2, 2, 5, 30)))] for p in range(60)}
    pages[60] = [(3, 3, 0, 5), (4, 4, 0, 2)]  # no box has a width
    rows = [(p, i, *map(float, b)) for p, bs in pages.items() for i, b in enumerate(bs)]
    rows += [(0, 99, None, 1.0, 5.0, 5.0), (1, 99, 1.0, None, 20.0, 20.0), (2, 99, 1.0, 1.0, None, 5.0), (3, 99, 1.0, 1.0, 20.0, None), (None, 0, 1.0, 1.0, 5.0, 5.0)]
    r = spark.createDataFrame(rows, "page_id long, rect_id int, x double, y double, w double, h double")
    want = {p: len({(x, y) for a, b, w, h in bs for x in range(a, a + w) for y in range(b, b + h)}) / 400 for p, bs in pages.items() if any(w for _, _, w, _ in bs) or p in (1, 3)}
    high = r.filter("h > 0")  # aspects are w / h
    got, full = R.union_coverage(r, 20.0, 20.0), Y.page_features(high, 20.0, 20.0)
    for df in (got, full):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan
    assert {x.page_id: round(x.coverage, 9) for x in got.collect()} == {p: round(c, 9) for p, c in want.items()}
    assert {x.page_id: x.coverage for x in full.collect()} == {x.page_id: x.coverage for x in R.union_coverage(high, 20.0, 20.0).collect()}


def test_coverage_in_small_steps():
    rng = np.random.default_rng(6)
    sizes = np.array([3, 0, 3, 2, 3, 7])
    x, y, w, h = (rng.integers(0, 9, sizes.sum()).astype(float) for _ in range(4))
    assert np.array_equal(R.covered_areas(x, y, w, h, sizes), R.covered_areas(x, y, w, h, sizes, most=1))
    assert len(R.covered_areas(x[:0], y[:0], w[:0], h[:0], sizes[:0])) == 0
