"""Colour clusters, background masks, the style model, and results of streams under several configurations."""

import json
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from pagegrid.operators import clusters as K
from pagegrid.operators import layout as Y
from pagegrid.operators import masks as M
from pagegrid.plans.catalog import QUERIES
from pagegrid.sources import files
from pagegrid.streaming import jobs

SCHEMA = "page_id long, width int, height int, r array<smallint>, g array<smallint>, b array<smallint>"


def page(number, rgb):
    h, w, _ = rgb.shape
    return (number, w, h, *[rgb[..., c].ravel().tolist() for c in range(3)])


def noisy():
    """White paper round a red and a blue panel, every pixel off by up to 3."""
    rgb = np.full((40, 40, 3), 245)
    rgb[4:36, 4:18], rgb[4:36, 22:36] = (180, 40, 40), (40, 40, 160)
    return np.clip(rgb + np.random.default_rng(5).integers(-3, 4, rgb.shape), 0, 255)


def test_lab_is_the_same_in_columns_and_arrays(spark):
    rgb = [(0, 0, 0), (255, 255, 255), (12, 200, 77), (130, 3, 250), (9, 9, 9)]
    frame = spark.createDataFrame([(1, 0, i, *c) for i, c in enumerate(rgb)], "page_id long, y int, x int, r int, g int, b int")
    want = [[r.L, r.A, r.B] for r in M.to_lab(frame).orderBy("x").collect()]
    assert np.allclose(K.lab_of(np.array(rgb, float)), want, atol=1e-5)


def test_clusters_of_noisy_panels(spark):
    got = K.colour_clusters(spark.createDataFrame([page(1, noisy())], SCHEMA), k=3).orderBy("cluster_id").collect()
    assert [r.pixels for r in got] == [1600 - 2 * 32 * 14, 32 * 14, 32 * 14]
    assert [round(r.border, 6) for r in got] == [1.0, 0.0, 0.0] and got[0].L > 235
    assert abs(sum(r.frac for r in got) - 1) < 1e-12


def test_clusters_of_odd_pages(spark):
    one = np.full((3, 5, 3), 90)
    rows = [page(1, one), (2, 0, 0, [], [], []), page(3, np.zeros((1, 1, 3), int))]
    rasters = spark.createDataFrame(rows, SCHEMA)
    assert {(r.page_id, r.cluster_id, r.pixels) for r in K.colour_clusters(rasters).collect()} == {(1, 1, 15), (3, 1, 1)}
    mask = {r.page_id: r.gray for r in K.cluster_background_mask(rasters).collect()}
    assert mask == {1: [255] * 15, 2: [], 3: [255]}
    assert K.colour_clusters(spark.createDataFrame([], SCHEMA)).count() == 0
    # pages without clusters are white
    ids = rasters.select("page_id")
    assert {r.page_id: (round(r.L), r.A, r.B) for r in M.dominant_background(K.colour_clusters(rasters), ids).filter("page_id = 2").collect()} == {2: (255, 128.0, 128.0)}


def test_array_rule_and_row_rule_agree(spark):
    rng = np.random.default_rng(2)
    pages = [page(i, rng.integers(0, 256, (4, 3))[rng.integers(0, 4, (12, 14))]) for i in range(40)]
    rasters = spark.createDataFrame(pages, SCHEMA)
    rows = Counter(tuple(r) for r in M.background_clusters(K.colour_clusters(rasters)).select("page_id", "L", "A").collect())
    arrays = K.with_clusters(rasters).select("page_id", F.explode(K.background_of(F.col("clusters"))).alias("c")).select("page_id", "c.L", "c.A")
    assert rows == Counter(tuple(r) for r in arrays.collect()) and rows


def test_mask_follows_the_paper(spark):
    got = np.array(K.cluster_background_mask(spark.createDataFrame([page(1, noisy())], SCHEMA), k=3).first().gray).reshape(40, 40)
    assert (got[:4] == 255).all() and (got[:, :4] == 255).all() and (got[8:32, 8:14] == 0).all()


@pytest.fixture(scope="module")
def styled(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(1, 20)), *map(float, rng.random(2)), int(rng.integers(0, 8)), float(rng.integers(0, 40)), float(rng.random()), float(rng.random())) for i in range(600)]
    f = spark.createDataFrame(rows, "page_id long, rect_count int, small_ratio double, margin_ratio double, gutter_count int, bg_tint_dist double, coverage double, aspect_variance double").cache()
    return Y.style_scores(f)


def test_style_model_on_held_out_pages(spark, styled, tmp_path):
    model = Y.fit_style_model(styled.filter("page_id % 5 <> 0"))
    model.write().overwrite().save(str(tmp_path / "m"))
    held = styled.filter("page_id % 5 = 0")
    want = {r.page_id: r.style for r in held.collect()}
    got = Y.classify_style(held.drop("classic", "modern"), PipelineModel.load(str(tmp_path / "m"))).collect()
    assert len(got) == len(want) and all(0.5 <= r.confidence <= 1 for r in got)
    assert sum(want[r.page_id] == r.style for r in got) >= 0.85 * len(want)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_learning_works_pages_out_once(spark, tmp_path):
    def features(batches):
        (tmp_path / uuid.uuid4().hex).touch()
        for batch in batches:
            yield batch.assign(style=["classic" if i % 2 else "modern" for i in batch.id], f=batch.id % 7)

    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = held()
    labelled = spark.range(80, numPartitions=2).mapInPandas(features, "id long, style string, f long")
    model = Y.fit_style_model(labelled, ["f"])
    assert len(list(tmp_path.iterdir())) == 2  # a file for each time that a partition is worked out
    assert held() == before
    assert Y.classify_style(spark.range(7).withColumnRenamed("id", "f"), model).count() == 7


def test_style_query_reads_stored_features(spark):
    got = QUERIES["x2_style_model"](spark, "/root/testdata/sf0.001")
    assert "lineitem" not in plan_of(got) and "Window" not in plan_of(got)
    assert got.count() == QUERIES["a5_page_features"](spark, "/root/testdata/sf0.001").count() > 0


def test_without_a_model_the_rules_decide(styled):
    got = {r.page_id: r.style for r in Y.classify_style(styled).collect()}
    assert got == {r.page_id: r.style for r in styled.collect()}


def test_stream_results_survive_new_checkpoints_and_hashes(spark, tmp_path):
    spark.range(6).withColumnRenamed("id", "page_id").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("page_id long").parquet(str(tmp_path / "in"))
    run = lambda check, h: jobs.detect_stream(stream(), lambda df: df, str(tmp_path / "out"), str(tmp_path / check), h).awaitTermination()
    results = lambda: sorted((r.config_hash, r.page_id) for r in spark.read.parquet(str(tmp_path / "out")).select("config_hash", "page_id").collect())
    run("cp", "h1")
    run("other", "h1")  # a new checkpoint: nothing is found twice and nothing is lost
    assert results() == [("h1", i) for i in range(6)]
    run("cp", "h2")  # a new configuration on the old checkpoint sees all pages again
    assert results() == [(h, i) for h in ("h1", "h2") for i in range(6)]
    spark.range(6, 8).withColumnRenamed("id", "page_id").write.mode("append").parquet(str(tmp_path / "in"))
    run("cp", "h1")
    assert results() == [("h1", i) for i in range(8)] + [("h2", i) for i in range(6)]


def test_panel_files_hold_parameters(spark, tmp_path):
    r = spark.createDataFrame([("a.png", 1, 1.0, 2.0, 30.0, 40.0)], "image_path string, rect_id int, x double, y double, w double, h double")
    files.write_panel_json(r, str(tmp_path / "j"), 100, 200, {"min_area": 50, "hsv_lower": [35, 40, 40]})
    got = json.loads(next((tmp_path / "j").glob("part-*.json")).read_text())
    assert got["parameters"] == {"min_area": 50, "hsv_lower": [35, 40, 40]} and got["num_panels"] == 1


def test_unreadable_images_are_told(spark, tmp_path):
    (tmp_path / "a_page_001.png").write_bytes(b"no image")
    assert [r.origin.split("/")[-1] for r in files.unreadable_pages(spark, str(tmp_path)).collect()] == ["a_page_001.png"]
