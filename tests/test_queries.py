"""Registered queries against their SQL on the smallest tables, and the rules on known rectangles."""

import math
from pathlib import Path

import duckdb
import pytest

from pagegrid.operators import rects as R
from pagegrid.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def rounded(rows):
    return sorted(([round(v, 9) if isinstance(v, float) else v for v in r] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rounded(tuple(r) for r in got.select(*want.columns).collect()) == rounded(want.fetchall())


def boxes(spark, rows):
    return spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(rows)], "page_id long, rect_id int, x double, y double, w double, h double")


def test_merge_grows_the_first_match(spark):
    got = R.merge_rects(boxes(spark, [(0, 0, 100, 100), (10, 0, 100, 100), (500, 500, 20, 20)])).orderBy("merged_id").collect()
    assert [(r.x, r.y, r.w, r.h) for r in got] == [(0, 0, 110, 100), (500, 500, 20, 20)]


def test_nested_rectangle_goes(spark):
    got = R.remove_nested(boxes(spark, [(10, 10, 20, 20), (0, 0, 100, 100), (95, 95, 50, 50)])).collect()
    assert sorted(r.rect_id for r in got) == [1, 2]


def test_nms_is_greedy_by_size(spark):
    got = R.nms(boxes(spark, [(0, 0, 100, 100), (10, 10, 90, 90), (300, 0, 50, 50)])).collect()
    assert sorted(r.rect_id for r in got) == [0, 2]


def test_rows_are_anchored_on_their_first(spark):
    # tops drift by 15: chained they would be one row, anchored they are two
    got = R.reading_order(boxes(spark, [(0, 0, 9, 9), (20, 15, 9, 9), (0, 30, 9, 9)])).orderBy("panel_no").collect()
    assert [(r.rect_id, r.row) for r in got] == [(0, 1), (1, 1), (2, 2)]


def test_score_of_four_even_panels(spark):
    four = boxes(spark, [(0, 0, 275, 400), (300, 0, 275, 400), (0, 420, 275, 400), (300, 420, 275, 400)])
    from pyspark.sql import functions as F

    one = R.score_layout(four.withColumn("route", F.lit("adaptive")), 595.0, 842.0).first()
    assert math.isclose(one.score, 1.0)


def test_merges_and_suppression_never_add(spark):
    for name in ("m1_merge_rects", "j3_remove_nested", "j4_nms"):
        assert QUERIES[name](spark, SF).count() <= 6000


def test_panels_found(spark):
    got = {r.page_id: r["count"] for r in QUERIES["panels_from_gutters"](spark, SF).groupBy("page_id").count().collect()}
    assert all(n == 2 + page % 3 for page, n in got.items()) and got
