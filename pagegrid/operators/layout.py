"""Rules over candidates, lines and bands that choose or combine layouts.

Rules that depend on the visiting order fold one small array for each page.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagegrid.functions.geometry import area, intersection_area, iou, segment_angle, union_box
from pagegrid.operators.library import chain_islands
from pagegrid.operators.rects import BOX, ROUTES, covered_area, has_width, merge_rects, page_boxes, remove_header_footer, score_layout

BOX_TYPE = "x:double,y:double,w:double,h:double"


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _page():
    return Window.partitionBy("page_id")


def _box(r: Column) -> Column:
    return F.struct(*[r[c].alias(c) for c in BOX])


def _arrays(rects: DataFrame, *first) -> DataFrame:
    return rects.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(*first, "rect_id", *BOX))).alias("items"))


def suppress_nested(rects: DataFrame, contain: float = 0.90, ratio: float = 0.25) -> DataFrame:
    """A small rectangle goes into the first far larger one that holds it and is still there.

    The larger one becomes the union of both originals; the last such union counts.
    """
    start = F.struct(F.array().cast("array<int>").alias("gone"), F.array().cast(f"array<struct<rect_id:int,box:struct<{BOX_TYPE}>>>").alias("grown"))

    def step(acc, s):
        fits = F.filter("items", lambda b: ~F.array_contains(acc["gone"], b["rect_id"]) & (area(s) < area(b)) & (area(s) <= ratio * area(b)) & (intersection_area(s, b) >= contain * area(s)))
        into = F.get(fits, F.lit(0))
        more = F.struct(into["rect_id"].alias("rect_id"), union_box(s, into).alias("box"))
        return F.when(F.size(fits) > 0, F.struct(F.concat(acc["gone"], F.array(s["rect_id"])).alias("gone"), F.concat(acc["grown"], F.array(more)).alias("grown"))).otherwise(acc)

    typed = rects.withColumn("rect_id", F.col("rect_id").cast("int"))
    done = _arrays(typed).withColumn("acc", F.aggregate("items", start, step))
    left = done.withColumn("item", F.explode("items")).filter(~F.array_contains("acc.gone", F.col("item.rect_id")))
    last = F.element_at(F.concat(F.array(_box(F.col("item"))), F.transform(F.filter("acc.grown", lambda g: g["rect_id"] == F.col("item.rect_id")), lambda g: g["box"])), -1)
    return left.select("page_id", "item.rect_id", last.alias("b")).select("page_id", "rect_id", "b.*")


def consensus(rects: DataFrame, scales: int = 3, min_agree: int = 2, least: float = 0.30, merge: float = 0.25) -> DataFrame:
    """Boxes that at least min_agree scales (scale_id) see: averages of the group of each seed, merged.

    Members of a group that is too small stay free for later seeds.
    """
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(f"array<struct<confidence:double,{BOX_TYPE}>>").alias("out"))

    def step(acc, s):
        later = lambda b: F.struct(b["scale_id"], b["rect_id"]) > F.struct(s["scale_id"], s["rect_id"])
        group = F.filter("items", lambda b: (b["rect_id"] == s["rect_id"]) | (later(b) & ~F.array_contains(acc["used"], b["rect_id"]) & (iou(s, b) >= least)))
        seen = lambda g: F.size(F.array_distinct(F.transform(g, lambda b: b["scale_id"])))
        mean = lambda g, c: F.aggregate(g, F.lit(0.0), lambda a, b: a + b[c]) / F.size(g)
        box = lambda g: F.struct((seen(g) / scales).cast("double").alias("confidence"), *[mean(g, c).alias(c) for c in BOX])
        more = lambda g: F.struct(F.concat(acc["used"], F.transform(g, lambda b: b["rect_id"])).alias("used"), F.concat(acc["out"], F.array(box(g))).alias("out"))
        return F.when(F.array_contains(acc["used"], s["rect_id"]), acc).otherwise(let(group, lambda g: F.when(seen(g) >= min_agree, more(g)).otherwise(acc)))

    typed = rects.withColumn("rect_id", F.col("rect_id").cast("int")).withColumn("scale_id", F.col("scale_id").cast("int"))
    done = _arrays(typed, "scale_id").select("page_id", F.aggregate("items", start, step, lambda acc: acc["out"]).alias("out"))
    flat = done.select("page_id", F.posexplode("out").alias("turn", "b")).select("page_id", "turn", "b.*")
    ranked = flat.withColumn("rect_id", F.row_number().over(_page().orderBy(F.desc("confidence"), "turn")))
    return merge_rects(ranked.select("page_id", "rect_id", *BOX), merge)


def merge_regions(rects: DataFrame, most: float = 0.20) -> DataFrame:
    """Each seed takes the later free boxes that overlap it (not the grown box) above `most`."""
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(f"array<struct<rect_id:int,{BOX_TYPE}>>").alias("out"))

    def step(acc, s):
        group = F.filter("items", lambda b: (b["rect_id"] > s["rect_id"]) & ~F.array_contains(acc["used"], b["rect_id"]) & (iou(s, b) > most))
        whole = lambda g: F.aggregate(g, _box(s), lambda a, b: union_box(a, b))
        grown = lambda g: let(whole(g), lambda u: F.struct(s["rect_id"].alias("rect_id"), *[u[c].alias(c) for c in BOX]))
        more = lambda g: F.struct(F.concat(acc["used"], F.transform(g, lambda b: b["rect_id"])).alias("used"), F.concat(acc["out"], F.array(grown(g))).alias("out"))
        return F.when(F.array_contains(acc["used"], s["rect_id"]), acc).otherwise(let(group, more))

    done = _arrays(rects.withColumn("rect_id", F.col("rect_id").cast("int"))).select("page_id", F.explode(F.aggregate("items", start, step, lambda acc: acc["out"])).alias("m"))
    return done.select("page_id", "m.*")


def anchored_rows(rects: DataFrame, place: Column, tolerance: Column, across: Column) -> DataFrame:
    """Reading order where a row is anchored on its first box, with that box's tolerance."""
    item = F.struct("_at", "_across", "rect_id", "_tol")
    pages = rects.withColumn("_at", place).withColumn("_tol", tolerance).withColumn("_across", across).groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(None).cast("double").alias("at"), F.lit(0.0).alias("tol"), F.lit(0).alias("row"), F.array().cast("array<struct<row:int,across:double,rect_id:int>>").alias("out"))

    def step(acc, i):
        same = F.coalesce(F.abs(i["_at"] - acc["at"]) < acc["tol"], F.lit(False))
        row = acc["row"] + F.when(same, 0).otherwise(1)
        out = F.concat(acc["out"], F.array(F.struct(row.alias("row"), i["_across"].alias("across"), i["rect_id"].cast("int").alias("rect_id"))))
        return F.struct(F.when(same, acc["at"]).otherwise(i["_at"]).alias("at"), F.when(same, acc["tol"]).otherwise(i["_tol"]).alias("tol"), row.alias("row"), out.alias("out"))

    flat = pages.select("page_id", F.explode(F.aggregate("items", start, step, lambda acc: acc["out"])).alias("o")).select("page_id", "o.*")
    return flat.select("page_id", "rect_id", "row", F.row_number().over(_page().orderBy("row", "across", "rect_id")).alias("panel_no"))


def reading_order_centroid(rects: DataFrame, rtl: bool = False) -> DataFrame:
    """Rows by centroid within half the page's median height."""
    sized = rects.withColumn("_median", F.median("h").over(_page()))
    cx = F.col("x") + F.col("w") / 2
    return anchored_rows(sized, F.col("y") + F.col("h") / 2, 0.5 * F.col("_median"), -cx if rtl else cx)


def reading_order_height(rects: DataFrame) -> DataFrame:
    """Rows by top within half the height of the row's first box."""
    return anchored_rows(rects, F.col("y"), 0.5 * F.col("h"), F.col("x"))


def candidate_filter(rects: DataFrame, page_w: float, page_h: float, min_pct: float = 0.008, max_pct: float = 0.95, min_fill: float = 0.55, min_px: int = 45, min_frac: float = 0.02) -> DataFrame:
    """Loose first filter of candidates with a `fill`; the side limit is half of the later one."""
    share = F.col("w") * F.col("h") / (page_w * page_h)
    side = max(min_px // 2, int(min_frac * min(page_w, page_h) / 2))
    return rects.filter(share.between(min_pct / 2, max_pct) & (F.col("fill") >= 0.8 * min_fill) & (F.least("w", "h") >= side))


def content_filter(rects: DataFrame, min_content: float = 0.08, thin: float = 0.12, min_std: float = 12.0) -> DataFrame:
    """Boxes with `content` and `gray_std`: bare ones go, and thin ones with little content."""
    median = lambda c: F.median(c).over(_page())
    sized = rects.withColumn("_mw", median("w")).withColumn("_mh", median("h"))
    bare = (F.col("content") < min_content) & (F.col("gray_std") < min_std)
    narrow = (F.col("_mw") > 0) & (F.col("_mh") > 0) & ((F.col("h") < thin * F.col("_mh")) | (F.col("w") < thin * F.col("_mw")))
    return sized.filter(~bare & ~(narrow & (F.col("content") < max(1.8 * min_content, 0.18)))).drop("_mw", "_mh")


def component_nesting(rects: DataFrame) -> DataFrame:
    """Depth (number of containers, up to 20), the smallest container as parent, and direct children."""
    a = rects.select("page_id", "rect_id", *BOX)
    b = rects.select("page_id", F.col("rect_id").alias("o"), *[F.col(c).alias(f"o{c}") for c in BOX])
    inside = (F.col("o") != F.col("rect_id")) & (F.col("x") >= F.col("ox")) & (F.col("y") >= F.col("oy")) & (F.col("x") + F.col("w") <= F.col("ox") + F.col("ow")) & (F.col("y") + F.col("h") <= F.col("oy") + F.col("oh"))
    pairs = a.join(b, "page_id").filter(inside & (F.col("w") * F.col("h") < F.col("ow") * F.col("oh")))
    up = pairs.groupBy("page_id", "rect_id").agg(F.least(F.count("*"), F.lit(20)).alias("depth"), F.min(F.struct((F.col("ow") * F.col("oh")).alias("s"), "o"))["o"].alias("parent"))
    down = up.groupBy("page_id", F.col("parent").alias("rect_id")).agg(F.count("*").alias("children"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.select("page_id", "rect_id").join(up, ["page_id", "rect_id"], "left").join(down, ["page_id", "rect_id"], "left").select("page_id", "rect_id", zero("depth"), "parent", zero("children"))


def candidate_score(found: DataFrame, page_area: float, least: float = 2.0, most: int = 16) -> DataFrame:
    """The best-scored components: rectangularity, fill, area, content, children, depth and aspect."""
    share, aspect = F.col("w") * F.col("h") / page_area, F.col("w") / F.col("h")
    score = (
        2.0 * F.col("rectangularity") + 1.5 * F.col("fill")
        + F.when(share.between(0.05, 0.35), 2.0).when(share.between(0.02, 0.50), 1.0).otherwise(0.0)
        + F.when(F.col("has_content"), 1.0).otherwise(0.0)
        + F.when(F.col("children").between(2, 50), 0.5).when(F.col("children") > 100, -0.5).otherwise(0.0)
        + F.when(F.col("depth") <= 2, 0.5).when(F.col("depth") > 4, -0.5).otherwise(0.0)
        + F.when(aspect.between(0.3, 3.0), 0.5).otherwise(0.0)
    )
    good = found.withColumn("score", F.round(score, 9)).filter(F.col("score") > least)
    return good.withColumn("_r", F.row_number().over(_page().orderBy(F.desc("score"), "rect_id"))).filter(F.col("_r") <= most).drop("_r")


def make_segments(lines: DataFrame) -> DataFrame:
    """Length and angle of lines (x1, y1, x2, y2); axis H under 15 degrees, V above 75."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    angle = segment_angle(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return lines.withColumn("length", F.sqrt(dx * dx + dy * dy)).withColumn("angle", angle).withColumn("axis", F.when(F.col("angle") < 15, "H").when(F.col("angle") > 75, "V"))


def hv_segments(lines: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """Lines near an axis, as position across it and extent along it."""
    s = make_segments(lines).filter((F.col("angle") <= tolerance) | (F.col("angle") >= 90 - tolerance)).withColumn("axis", F.when(F.col("angle") <= tolerance, "H").otherwise("V"))
    flat = F.col("axis") == "H"
    pick = lambda a, b, f: F.when(flat, f(F.col(a + "1"), F.col(a + "2"))).otherwise(f(F.col(b + "1"), F.col(b + "2")))
    return s.select("page_id", "seg_id", "axis", "length", pick("y", "x", lambda p, q: (p + q) / 2).alias("position"), pick("x", "y", F.least).alias("lo"), pick("x", "y", F.greatest).alias("hi"))


def merge_parallel(segments: DataFrame, gap: float) -> DataFrame:
    """Chains of parallel lines become one: mean position, whole extent."""
    chained = chain_islands(segments, ["page_id", "axis"], "position", gap)
    return chained.groupBy("page_id", "axis", "island").agg(F.avg("position").alias("position"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"))


def interior_positions(lines: DataFrame, page_w: float, page_h: float, margin: float = 0.03) -> DataFrame:
    size = F.when(F.col("axis") == "H", page_h).otherwise(page_w)
    return lines.filter((F.col("position") > margin * size) & (F.col("position") < (1 - margin) * size))


def merge_bands(existing: DataFrame, new: DataFrame, apart: float = 15.0) -> DataFrame:
    """existing, and the new bands whose middle is at least `apart` from every existing one."""
    known = existing.select("page_id", ((F.col("lo") + F.col("hi")) / 2).alias("_mid"))
    n, k = new.alias("n"), known.alias("k")
    far = n.join(k, (F.col("n.page_id") == F.col("k.page_id")) & (F.abs((F.col("n.lo") + F.col("n.hi")) / 2 - F.col("k._mid")) < apart), "left_anti")
    return existing.select("page_id", "lo", "hi").unionByName(far.select("page_id", "lo", "hi"))


def peak_lines(indexes: DataFrame, thick: int = 3, top: int = 4096) -> DataFrame:
    """Runs of idx; runs under `thick` grow on both sides, inside 0..top."""
    runs = chain_islands(indexes, ["page_id"], "idx", 1).groupBy("page_id", "island").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    size = F.col("hi") - F.col("lo") + 1
    grow = F.when(size < thick, F.floor((thick - size + 1) / 2)).otherwise(0)
    return runs.select("page_id", F.when(grow > 0, F.greatest(F.lit(0), F.col("lo") - grow)).otherwise(F.col("lo")).cast("long").alias("lo"), F.when(grow > 0, F.least(F.col("hi") + grow, F.lit(top))).otherwise(F.col("hi")).cast("long").alias("hi"))


def page_features(rects: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Counts, shares of small and margin boxes, coverage, spread of aspects; pages without any box that has a width have none."""
    small = (F.col("w") * F.col("h") < 0.01 * page_w * page_h).cast("double")
    edge = (((F.col("y") < 0.06 * page_h) | (F.col("y") + F.col("h") > 0.94 * page_h)) & (F.col("h") < 0.12 * page_h)).cast("double")
    known = rects.filter("page_id is not null").groupBy("page_id")
    base = known.agg(F.count("*").alias("rect_count"), F.avg(small).alias("small_ratio"), F.avg(edge).alias("margin_ratio"), F.var_pop(F.col("w") / F.col("h")).alias("aspect_variance"), page_boxes().alias("_boxes"), has_width().alias("_wide"))
    return base.filter("_wide").withColumn("coverage", covered_area("_boxes") / (page_w * page_h)).drop("_boxes", "_wide")


def gutter_count(prof: DataFrame, gap: int = 3) -> DataFrame:
    """Runs of a profile (idx, v) above its 85th percentile."""
    high = prof.groupBy("page_id").agg(F.percentile("v", F.lit(0.85)).alias("p"))
    runs = chain_islands(prof.join(high, "page_id").filter("v > p"), ["page_id"], "idx", gap)
    return runs.groupBy("page_id").agg(F.max("island").alias("gutter_count"))


def style_scores(f: DataFrame) -> DataFrame:
    """classic or modern by additive rules; a tie is classic."""
    points = lambda *rules: sum((r for r in rules), F.lit(0.0))
    yes = lambda c, v: F.when(c, v).otherwise(0.0)
    # fixed values: the limits of the rules and their weights
    many, some, tint, cover = F.col("gutter_count") >= 3, F.col("small_ratio") < 0.30, F.col("bg_tint_dist") < 18.0, F.col("coverage") >= 0.50
    classic = points(yes(many, 2.0), yes(some, 1.0), yes(F.col("rect_count").between(3, 12), 1.0), yes(tint, 1.5), yes(cover, 0.5))
    modern = points(yes(~many & (F.col("gutter_count") <= 2), 1.5), yes(~some, 1.5), yes(F.col("rect_count") > 12, 0.5), yes(~tint, 2.0), yes(F.col("aspect_variance") > 0.5, 0.5))
    return f.withColumn("classic", classic).withColumn("modern", modern).withColumn("style", F.when(classic >= modern, "classic_franco_belge").otherwise("modern"))


def feature_vector(f: DataFrame) -> DataFrame:
    return f.withColumn("features", F.array(F.col("rect_count") / 12.0, "small_ratio", "margin_ratio", F.col("gutter_count") / 10.0, F.least(F.col("bg_tint_dist") / 50.0, F.lit(1.0)), "coverage", F.least("aspect_variance", F.lit(1.0))))


STYLE_FEATURES = ["rect_count", "small_ratio", "margin_ratio", "gutter_count", "bg_tint_dist", "coverage", "aspect_variance"]


def fit_style_model(labelled: DataFrame, features: list[str] | None = None) -> PipelineModel:
    """A random forest on pages with features and a known `style`; nulls count as 0. Styles follow from
    limits on features, which trees find and a linear model doesn't. The stages read the pages several times,
    so styles and features lie on the executors' disks until the model is there.

    Save it with model.write().save(path) and read it with PipelineModel.load(path).
    """
    names = features or STYLE_FEATURES
    spark = labelled.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = labelled.select("style", *names).repartition(tasks).persist(StorageLevel.DISK_ONLY)
    try:
        indexer = StringIndexer(inputCol="style", outputCol="_label", stringOrderType="alphabetAsc").fit(rows)
        stages = [
            SQLTransformer(statement="select *, " + ", ".join(f"coalesce(cast({c} as double), 0.0D) as _x_{c}" for c in names) + " from __THIS__"),
            VectorAssembler(inputCols=[f"_x_{c}" for c in names], outputCol="_features"),
            RandomForestClassifier(featuresCol="_features", labelCol="_label", predictionCol="_class", probabilityCol="_share", rawPredictionCol="_raw", numTrees=40, maxDepth=8, seed=1),
            IndexToString(inputCol="_class", outputCol="_style", labels=indexer.labels),
        ]
        return Pipeline(stages=stages).fit(indexer.transform(rows))
    finally:
        rows.unpersist()


def classify_style(f: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """f with `style` and `confidence`: by the trained model if there is one, else by the rules."""
    if model is None:
        scored, total = style_scores(f), F.col("classic") + F.col("modern")
        sure = F.when(total > 0, F.greatest("classic", "modern") / total).otherwise(0.5)
        return scored.withColumn("confidence", sure).drop("classic", "modern")
    known = model.transform(f.drop("style", "confidence"))
    return known.select(*f.drop("style", "confidence").columns, F.col("_style").alias("style"), F.array_max(vector_to_array("_share")).alias("confidence"))


def splash_fallback(rects: DataFrame, before: DataFrame, pages: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Pages that are one picture get one whole-page box; emptied modern pages get `before` back.

    pages: page_id, non_bg, mode, gutter_count, hierarchy_count.
    """
    whole, size = page_w * page_h, F.col("w") * F.col("h")
    now = rects.groupBy("page_id").agg(F.count("*").alias("n"), F.max(size).alias("big"), F.sum(size).alias("all"))
    old = before.groupBy("page_id").agg(F.count("*").alias("n_before"))
    p = pages.join(now, "page_id", "left").join(old, "page_id", "left").fillna(0, ["n", "n_before", "big", "all"])
    held = (F.col("mode") == "modern") & (F.col("n_before") >= 2)
    busy = F.col("non_bg") > 0.35
    lone = (F.col("n") == 1) & (F.col("big") / whole < 0.60) & busy & ~held
    ruled = (F.col("n") > 0) & (F.col("gutter_count") == 0) & (F.col("hierarchy_count") == 0) & (F.col("big") / whole > 0.40) & ((F.col("all") - F.col("big")) / whole < 0.20)
    fate = F.when((F.col("n") == 0) & held, "back").when(((F.col("n") == 0) & busy) | lone | ruled, "whole").otherwise("same")
    fates = p.select("page_id", fate.alias("fate"))
    pick = lambda df, f: df.select("page_id", "rect_id", *BOX).join(fates.filter(F.col("fate") == f).select("page_id"), "page_id", "left_semi")
    full = fates.filter("fate = 'whole'").select("page_id", F.lit(1).alias("rect_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(page_w).alias("w"), F.lit(page_h).alias("h"))
    return pick(rects, "same").unionByName(pick(before, "back")).unionByName(full)


def select_route_modern(rects: DataFrame, page_w: float, page_h: float, weak: float = 0.45) -> DataFrame:
    """Best route without header and footer strips; freeform only where the best is weak and it is better."""
    clean = remove_header_footer(rects, page_h)
    emptied = rects.join(clean.select("page_id").distinct(), "page_id", "left_anti")
    scores = score_layout(clean.unionByName(emptied), page_w, page_h)
    order = F.array_position(F.array(*[F.lit(r) for r in ROUTES]), F.col("route"))
    best = scores.filter("route <> 'freeform'").withColumn("_r", F.row_number().over(_page().orderBy(F.desc("score"), order))).filter("_r = 1").drop("_r")
    free = scores.filter("route = 'freeform'").select("page_id", F.struct("route", "n", "score").alias("f"))
    take = F.col("f").isNotNull() & (F.col("score").isNull() | ((F.col("score") < weak) & (F.col("f.score") > F.col("score"))))
    both = best.join(free, "page_id", "full")
    return both.select("page_id", *[F.when(take, F.col(f"f.{c}")).otherwise(F.col(c)).alias(c) for c in ("route", "n", "score")])


def choose_grid(flat: DataFrame, hier: DataFrame) -> DataFrame:
    """A page's cells by rows if they are more than the flat grid's but at most 2n + 3, else the flat ones."""
    n = flat.groupBy("page_id").agg(F.count("*").alias("f")).join(hier.groupBy("page_id").agg(F.count("*").alias("h")), "page_id", "full").fillna(0)
    rows = (F.col("f") == 0) | ((F.col("h") > F.col("f")) & (F.col("h") <= 2 * F.col("f") + 3))
    by_rows = n.select("page_id", rows.alias("by_rows"))
    pick = lambda df, c: df.join(by_rows.filter(c).select("page_id"), "page_id", "left_semi")
    return pick(flat, "not by_rows").unionByName(pick(hier, "by_rows"))


def fallback_scale(rects: DataFrame) -> DataFrame:
    """The scale with most rectangles, the first of equals."""
    n = rects.groupBy("page_id", "scale_id").agg(F.count("*").alias("n"))
    return n.groupBy("page_id").agg(F.max(F.struct("n", (-F.col("scale_id")).alias("s"))).alias("m")).select("page_id", (-F.col("m.s")).alias("scale_id"), "m.n")


def viewport_plan(rects: DataFrame, vw: float, vh: float, framing: str, page_w: float, page_h: float, margin: float = 12.0) -> DataFrame:
    """Zoom and scroll target that show each rectangle: framing fit, fill or center."""
    across, down = vw / F.greatest(F.lit(1e-6), "w"), vh / F.greatest(F.lit(1e-6), "h")
    zoom = F.greatest(across, down) * 1.01 if framing == "fill" else F.least(across, down) * 0.96
    z = rects.withColumn("zoom", F.least(F.lit(16.0), F.greatest(F.lit(0.05), zoom)))

    def target(pos: str, size: str, view: float, page: float) -> Column:
        seen = view / F.col("zoom")
        at = {"fill": F.col(pos) + F.greatest(F.lit(0.0), F.col(size) - seen), "center": F.col(pos) + F.col(size) / 2 - seen / 2, "fit": F.col(pos) - margin / F.col("zoom")}[framing]
        pad = F.greatest(F.lit(0.0), (view - page * F.col("zoom")) / 2)
        return F.bround(F.greatest(F.lit(0.0), pad + at * F.col("zoom"))).cast("long")

    return z.select("page_id", "rect_id", F.round("zoom", 9).alias("zoom"), target("x", "w", vw, page_w).alias("scroll_x"), target("y", "h", vh, page_h).alias("scroll_y"))


def config_hash(*params: str) -> Column:
    """Fingerprint of the parameters held in the named columns."""
    return F.sha2(F.to_json(F.struct(*params)), 256)
