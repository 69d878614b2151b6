"""The store of corrections, and images that come as a stream."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from pagegrid.operators.corrections import BOXES, CorrectionStore
from pagegrid.streaming import jobs
from tests.test_detection import framed, png

EDIT = f"path string, page int, panels {BOXES}, at timestamp, seq long"


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, minute)


def edits(spark, *rows):
    return spark.createDataFrame([(p, n, b, at(m), s) for p, n, b, m, s in rows], EDIT)


BOX = (1.0, 2.0, 3.0, 4.0)


def test_the_last_version_counts_whoever_wrote_it_first(spark, tmp_path):
    store = CorrectionStore(spark, str(tmp_path / "store"))
    assert store.load().collect() == []
    store.save(edits(spark, ("a.pdf", 1, [BOX], 5, 0), ("a.pdf", 2, [BOX], 1, 0), ("b.pdf", 1, [], 1, 0), ("a.pdf", 12345, [BOX], 1, 0)))
    store.save(edits(spark, ("a.pdf", 1, [], 3, 0), ("a.pdf", 2, [BOX, BOX], 1, 1)))  # an older edit that comes late, and one of the same minute
    got = {(r.path, r.page): len(r.panels) for r in store.load().collect()}
    assert got == {("a.pdf", 1): 1, ("a.pdf", 2): 2, ("b.pdf", 1): 0, ("a.pdf", 12345): 1}
    store.delete(edits(spark, ("a.pdf", 1, None, 4, 0), ("a.pdf", 2, None, 9, 0)))
    assert {(r.path, r.page) for r in store.load().collect()} == {("a.pdf", 1), ("b.pdf", 1), ("a.pdf", 12345)}
    store.save(edits(spark, ("a.pdf", 2, [BOX], 10, 0)))
    pages = spark.createDataFrame([(7, "a.pdf", 2, 100, 200), (8, "a.pdf", 3, 100, 200), (9, "b.pdf", 1, 100, 200)], "page_id long, path string, page int, width int, height int")
    assert [r.page_id for r in store.exists(pages).orderBy("page_id").collect()] == [7, 9]
    assert {r.page_id: len(r.boxes) for r in store.for_pages(pages).collect()} == {7: 1, 9: 0}
    small = store.compact(str(tmp_path / "small"))
    assert sorted(map(str, small.load().collect())) == sorted(map(str, store.load().collect())) and small.history().count() == 4


def test_a_run_written_again_replaces_itself_and_sizes_scale(spark, tmp_path):
    store = CorrectionStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        store.save(edits(spark, ("a.pdf", 1, [BOX], 5, 0)).withColumns({"page_width": F.lit(50.0), "page_height": F.lit(50.0)}), "one")
    assert store.history().count() == 1
    pages = spark.createDataFrame([(7, "a.pdf", 1, 100, 200)], "page_id long, path string, page int, width int, height int")
    assert [tuple(b) for b in store.for_pages(pages).first().boxes] == [(2.0, 8.0, 6.0, 16.0)]


def test_edits_come_as_a_stream(spark, tmp_path):
    store, source = CorrectionStore(spark, str(tmp_path / "store")), str(tmp_path / "edits")
    edits(spark, ("a.pdf", 1, [BOX], 1, 0), ("a.pdf", 2, [], 1, 1)).withColumn("deleted", F.lit(False)).write.parquet(source)
    read = lambda: spark.readStream.schema(EDIT + ", deleted boolean").parquet(source)
    jobs.save_edits(read(), store, str(tmp_path / "check")).awaitTermination()
    edits(spark, ("a.pdf", 1, None, 2, 0)).withColumn("deleted", F.lit(True)).write.mode("append").parquet(source)
    jobs.save_edits(read(), store, str(tmp_path / "check")).awaitTermination()
    assert [(r.page, r.panels) for r in store.load().collect()] == [(2, [])]


def test_images_dropped_into_a_folder_are_detected_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "x_page_001.png").write_bytes(png(framed()[:, ::2][::2]))
    (folder / "x_page_002.png").write_bytes(b"broken")
    run = lambda check: jobs.detect_images(spark, str(folder), str(tmp_path / "out"), str(tmp_path / check), mode="classic_franco_belge").awaitTermination()
    run("check")
    (folder / "x_page_003.png").write_bytes(png(np.full((60, 50, 3), 255)))
    run("check")
    run("other")  # another checkpoint sees all files again, and finds them done
    got = spark.read.parquet(str(tmp_path / "out")).select("page_id", F.size("panels").alias("n")).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(1, 3), (3, 0)]
