"""Times the headline queries and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from pagegrid.plans.catalog import QUERIES

NAMES = ["panels_from_gutters", "q8_detect_drawn", "u2_segments_drawn", "j6_box_measures", "q8_detect_pages", "j10_score_templates", "w3_reading_order", "m1_merge_rects", "a4_score_layout", "j6_region_sums", "j1_overlap_pairs", "a6_union_coverage", "w1_bands"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count().collect()  # the JVM's start is no query's time
    took = {}
    for name in NAMES:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
