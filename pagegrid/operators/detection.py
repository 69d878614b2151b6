"""Detection of panels, each page in a row of its own: kernels look at the pixels, column expressions decide.

No step shuffles: routes, style, choice, templates, filters and reading order are expressions over
the small arrays that a page's row holds. Only saved corrections are joined, to rows without pixels.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrid.functions.geometry import area, intersection_area, iou, union_box
from pagegrid.operators import finders as N
from pagegrid.operators import layout as Y
from pagegrid.operators import templates as T
from pagegrid.operators.clusters import CLUSTERS, background_of
from pagegrid.operators.pages import Page, resized, settled, with_columns, with_measures

BOX = "struct<x:double,y:double,w:double,h:double>"
BOXES = f"array<{BOX}>"
ROUTES = ("adaptive", "lsd", "hierarchy", "gutter")
EVIDENCE = f"adaptive array<{N.CANDIDATE}>, lsd array<{N.CANDIDATE}>, hierarchy array<{N.CANDIDATE}>, gutter_flat array<{N.CANDIDATE}>, gutter_rows array<{N.CANDIDATE}>"
FACTS = f"gutter_runs int, tint double, clusters {CLUSTERS}, content array<double>, edge array<double>"


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda t, x: t + x)


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _box(b: Column) -> Column:
    return F.struct(*[b[c].alias(c) for c in "xywh"])


def plain(boxes: Column) -> Column:
    return F.transform(boxes, _box)


def none() -> Column:
    return F.array().cast(BOXES)


# --- rules over one page's boxes


def merged(boxes: Column, least: float) -> Column:
    """One greedy pass: a box joins the first merged one with IoU >= least, which grows."""

    def step(acc, b):
        first = F.array_position(F.transform(acc, lambda m: iou(m, b) >= least), F.lit(True))
        grown = lambda at: F.transform(acc, lambda m, i: F.when(i == at - 1, union_box(m, b)).otherwise(m))
        return let(first, lambda at: F.when(at > 0, grown(at)).otherwise(F.concat(acc, F.array(b))))

    return F.aggregate(plain(boxes), none(), step)


def largest_first(boxes: Column) -> Column:
    keyed = F.transform(boxes, lambda b, i: F.struct((-area(b)).alias("s"), i.alias("i"), _box(b).alias("b")))
    return F.transform(F.array_sort(keyed), lambda k: k["b"])


def without_nested(boxes: Column, most: float = 0.85) -> Column:
    """Largest first; a box goes if more than `most` of it lies inside one kept."""
    step = lambda acc, b: F.when(F.exists(acc, lambda m: intersection_area(m, b) > most * area(b)), acc).otherwise(F.concat(acc, F.array(b)))
    return F.aggregate(largest_first(boxes), none(), step)


def regions_merged(boxes: Column, most: float = 0.20) -> Column:
    """A seed takes the later free boxes that overlap it, not the grown one, above `most`."""
    numbered = F.transform(plain(boxes), lambda b, i: F.struct(i.alias("i"), b.alias("b")))
    start = F.struct(F.array().cast("array<int>").alias("used"), none().alias("out"))

    def step(acc, s):
        group = F.filter(numbered, lambda o: (o["i"] > s["i"]) & ~F.array_contains(acc["used"], o["i"]) & (iou(s["b"], o["b"]) > most))
        whole = lambda g: F.aggregate(g, s["b"], lambda t, o: union_box(t, o["b"]))
        more = let(group, lambda g: F.struct(F.concat(acc["used"], F.transform(g, lambda o: o["i"])).alias("used"), F.concat(acc["out"], F.array(whole(g))).alias("out")))
        return F.when(F.array_contains(acc["used"], s["i"]), acc).otherwise(more)

    return F.aggregate(numbered, start, step, lambda acc: acc["out"])


def nested_absorbed(boxes: Column, contain: float = 0.90, ratio: float = 0.25) -> Column:
    """A small box goes into the first far larger one that holds it and is still there, which grows to their union."""
    numbered = F.transform(plain(boxes), lambda b, i: F.struct(i.alias("i"), b.alias("b")))
    start = F.struct(F.array().cast("array<int>").alias("gone"), F.array().cast(f"array<struct<i:int,b:{BOX}>>").alias("grown"))

    def step(acc, s):
        holds = lambda o: ~F.array_contains(acc["gone"], o["i"]) & (area(s["b"]) < area(o["b"])) & (area(s["b"]) <= ratio * area(o["b"])) & (intersection_area(s["b"], o["b"]) >= contain * area(s["b"]))
        more = lambda into: F.struct(into["i"].alias("i"), union_box(s["b"], into["b"]).alias("b"))
        both = lambda into: F.struct(F.concat(acc["gone"], F.array(s["i"])).alias("gone"), F.concat(acc["grown"], F.array(more(into))).alias("grown"))
        return let(F.get(F.filter(numbered, holds), F.lit(0)), lambda into: F.when(into.isNotNull(), both(into)).otherwise(acc))

    def left(acc):
        last = lambda o: F.element_at(F.concat(F.array(o["b"]), F.transform(F.filter(acc["grown"], lambda g: g["i"] == o["i"]), lambda g: g["b"])), -1)
        return F.transform(F.filter(numbered, lambda o: ~F.array_contains(acc["gone"], o["i"])), last)

    return F.aggregate(numbered, start, step, left)


def agreed(found: Column, scales: int, min_agree: int = 2, least: float = 0.30, merge: float = 0.25) -> Column:
    """Boxes that min_agree scales see, from structs (scale, b): means of each seed's group, the surest first, merged."""
    numbered = F.transform(found, lambda s, i: F.struct(i.alias("i"), s["scale"].alias("scale"), s["b"].alias("b")))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(f"array<struct<sure:double,i:int,b:{BOX}>>").alias("out"))

    def step(acc, s):
        group = F.filter(numbered, lambda o: (o["i"] == s["i"]) | ((o["i"] > s["i"]) & ~F.array_contains(acc["used"], o["i"]) & (iou(s["b"], o["b"]) >= least)))
        seen = lambda g: F.size(F.array_distinct(F.transform(g, lambda o: o["scale"])))
        mean = lambda g, c: _total(F.transform(g, lambda o: o["b"][c])) / F.size(g)
        box = lambda g: F.struct((-seen(g) / scales).cast("double").alias("sure"), s["i"].alias("i"), F.struct(*[mean(g, c).alias(c) for c in "xywh"]).alias("b"))
        more = lambda g: F.struct(F.concat(acc["used"], F.transform(g, lambda o: o["i"])).alias("used"), F.concat(acc["out"], F.array(box(g))).alias("out"))
        grown = let(group, lambda g: F.when(seen(g) >= min_agree, more(g)).otherwise(acc))
        return F.when(F.array_contains(acc["used"], s["i"]), acc).otherwise(grown)

    return merged(F.transform(F.array_sort(F.aggregate(numbered, start, step, lambda acc: acc["out"])), lambda k: k["b"]), merge)


def layout_score(boxes: Column, page: Column) -> Column:
    """How good a layout is: number of panels, cover, evenness, overlap. page: the page's area."""
    return let(boxes, lambda b: let(F.transform(b, area), lambda sizes: _layout_score(b, sizes, page)))


def _layout_score(boxes: Column, sizes: Column, page: Column) -> Column:
    n = F.size(boxes)
    much = lambda a, b: let(iou(a, b), lambda i: F.when(i > 0.15, i).otherwise(0.0))
    overlap = _total(F.transform(boxes, lambda a, i: _total(F.transform(F.slice(boxes, i + 2, F.size(boxes)), lambda b: much(a, b)))))
    # fixed values: how good a number of panels is
    count = F.when(n.between(3, 8), 1.0).when(n.between(2, 12), 0.7).when(n == 1, 0.3).otherwise(0.4)
    cover = F.least(F.lit(1.0), F.least(F.lit(1.0), _total(sizes) / page) / 0.75)
    even = F.when(n == 1, 0.5).otherwise(F.greatest(F.lit(0.2), F.array_min(sizes) / F.array_max(sizes)))
    return F.when(n == 0, 0.0).otherwise(F.round(0.35 * count + 0.30 * cover + 0.15 * even + 0.20 * F.greatest(F.lit(0.0), 1 - 0.2 * overlap), 9))


def covered(boxes: Column, page: Column) -> Column:
    """Share of the page under some box: between neighbouring x edges, the boxes' y intervals merge by a running end."""
    ends = F.array_sort(F.array_distinct(F.flatten(F.transform(boxes, lambda b: F.array(b["x"], b["x"] + b["w"])))))
    steps = let(ends, lambda e: F.zip_with(e, F.slice(e, 2, F.size(e)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))

    def strip(step):
        e, end = step["a"], step["b"]
        spans = F.array_sort(F.transform(F.filter(boxes, lambda b: (b["x"] <= e) & (b["x"] + b["w"] >= end)), lambda b: F.struct(b["y"].alias("lo"), (b["y"] + b["h"]).alias("hi"))))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("reach"))
        add = lambda acc, s: F.greatest(F.lit(0.0), s["hi"] - F.greatest(s["lo"], F.coalesce(acc["reach"], s["lo"])))
        step = lambda acc, s: F.struct((acc["sum"] + add(acc, s)).alias("sum"), F.greatest(F.coalesce(acc["reach"], s["hi"]), s["hi"]).alias("reach"))
        return F.coalesce(F.aggregate(spans, start, step, lambda acc: acc["sum"]) * (end - e), F.lit(0.0))

    return _total(F.transform(steps, strip)) / page


def in_reading_order(boxes: Column, row_gap: Column, rtl: bool = False) -> Column:
    """Rows anchored on the top of their first box, each from left to right (or right to left)."""
    items = F.array_sort(F.transform(boxes, lambda b: F.struct(b["y"].alias("y"), b["x"].alias("x"), _box(b).alias("b"))))
    start = F.struct(F.lit(None).cast("double").alias("at"), F.lit(0).alias("row"), F.array().cast(f"array<struct<row:int,across:double,b:{BOX}>>").alias("out"))

    def step(acc, i):
        same = F.coalesce(F.abs(i["y"] - acc["at"]) < row_gap, F.lit(False))
        row = acc["row"] + F.when(same, 0).otherwise(1)
        placed = F.struct(row.alias("row"), (-i["x"] if rtl else i["x"]).alias("across"), i["b"].alias("b"))
        return F.struct(F.when(same, acc["at"]).otherwise(i["y"]).alias("at"), row.alias("row"), F.concat(acc["out"], F.array(placed)).alias("out"))

    return F.transform(F.array_sort(F.aggregate(items, start, step, lambda acc: acc["out"])), lambda p: p["b"])


# --- routes


def adaptive_boxes(found: Column, wide: Column, high: Column, min_fill: float = 0.25) -> Column:
    """Loose candidates of the local threshold, merged."""
    side = F.greatest(F.least(F.lit(22), F.floor(0.1 * F.least(wide, high))), F.floor(0.025 * F.least(wide, high)))
    fine = lambda c: (area(c) / (wide * high)).between(0.004, 0.95) & (c["fill"] >= 0.8 * min_fill) & (F.least(c["w"], c["h"]) >= side)
    return merged(F.filter(found, fine), 0.25)


def outline_score(c: Column, page: Column) -> Column:
    """What makes a nested outline look like a panel."""
    share, aspect = area(c) / page, c["w"] / c["h"]
    return F.round(
        2.0 * c["rectangularity"] + 1.5 * c["fill"] + F.when(share.between(0.05, 0.35), 2.0).when(share.between(0.02, 0.50), 1.0).otherwise(0.0)
        + F.when(c["children"] > 0, 1.0).otherwise(0.0) + F.when(c["children"].between(2, 50), 0.5).when(c["children"] > 100, -0.5).otherwise(0.0)
        + F.when(c["depth"] <= 2, 0.5).when(c["depth"] > 4, -0.5).otherwise(0.0) + F.when(aspect.between(0.3, 3.0), 0.5).otherwise(0.0), 9,
    )


def hierarchy_boxes(found: Column, page: Column, most: int = 16) -> Column:
    """Outlines filled and rectangular enough, the best-scored ones, merged and without nested ones."""
    enclosed = lambda c: c["fill"] * area(c) / page
    fine = F.filter(found, lambda c: enclosed(c).between(0.008, 0.85) & (c["fill"] >= 0.40) & (c["rectangularity"] >= 0.50))
    scored = F.filter(F.transform(fine, lambda c, i: F.struct((-outline_score(c, page)).alias("s"), i.alias("i"), _box(c).alias("b"))), lambda k: -k["s"] > 2.0)
    return without_nested(merged(F.transform(F.slice(F.array_sort(scored), 1, most), lambda k: k["b"]), 0.30))


def gutter_boxes(flat: Column, rows: Column) -> Column:
    """Cells by rows if they are more than the flat grid's but at most 2n + 3, else the flat ones."""
    f, h = F.size(flat), F.size(rows)
    return plain(F.when((f == 0) | ((h > f) & (h <= 2 * f + 3)), rows).otherwise(flat))


def region_boxes(found: Column, page: Column) -> Column:
    """Freeform regions of any shape that fill enough of their box, merged where they overlap."""
    return regions_merged(F.filter(found, lambda c: (c["fill"] * area(c) / page).between(0.005, 0.95) & (c["fill"] >= 0.15)))


def route_boxes(seen: Column, wide: Column, high: Column) -> dict[str, Column]:
    """Boxes of each built-in route from what the kernels saw (a struct like EVIDENCE)."""
    return {
        "adaptive": adaptive_boxes(seen["adaptive"], wide, high), "lsd": plain(seen["lsd"]),
        "hierarchy": hierarchy_boxes(seen["hierarchy"], wide * high), "gutter": gutter_boxes(seen["gutter_flat"], seen["gutter_rows"]),
    }


# --- choice


def dominant_background(clusters: Column) -> Column:
    """The background cluster with most border, else the brightest cluster, else white."""
    pick = lambda c, *first: F.struct(*[c[f].alias(f"_{f}") for f in first], *[c[f].alias(f) for f in "LAB"])
    best = F.array_max(F.transform(background_of(clusters), lambda c: pick(c, "border")))
    top = F.array_max(F.transform(clusters, lambda c: pick(c)))
    white = {"L": 255.0, "A": 128.0, "B": 128.0}
    return F.struct(*[F.coalesce(best[f], top[f], F.lit(white[f])).alias(f) for f in "LAB"])


def with_style(pages: DataFrame, boxes: str, mode: str = "auto", model=None) -> DataFrame:
    """pages with `style`: the given mode, or by a trained model or the rules on the features of `boxes`."""
    if mode != "auto":
        return pages.withColumn("style", F.lit(mode))
    b, wide, high = F.col(boxes), F.col("width"), F.col("height")
    share = lambda f: F.coalesce(F.size(F.filter(b, f)) / F.when(F.size(b) > 0, F.size(b)), F.lit(0.0))
    aspects = F.transform(b, lambda r: r["w"] / r["h"])
    mean = lambda xs: _total(xs) / F.size(xs)
    squares = let(aspects, lambda xs: let(mean(xs), lambda m: mean(F.transform(xs, lambda a: (a - m) * (a - m)))))
    spread = F.when(F.size(b) > 1, squares).otherwise(0.0)
    margin = lambda r: ((r["y"] < 0.06 * high) | (r["y"] + r["h"] > 0.94 * high)) & (r["h"] < 0.12 * high)
    features = {
        "rect_count": F.size(b).cast("long"), "small_ratio": share(lambda r: area(r) < 0.01 * wide * high), "margin_ratio": share(margin), "gutter_count": F.col("gutter_runs").cast("long"),
        "bg_tint_dist": F.col("tint"), "coverage": covered(b, wide * high), "aspect_variance": spread,
    }
    named = pages.withColumns(features)
    return Y.classify_style(named, model).drop("confidence", *features)


def _best(routes: Column, page: Column, bonus: Column | bool = False) -> Column:
    """The best of structs (route, boxes): (route, boxes, score); ties go by the order of the routes."""
    score = lambda r: layout_score(r["boxes"], page) + F.when(F.lit(bonus) if isinstance(bonus, bool) else bonus, F.when((r["route"] == "gutter") & F.size(r["boxes"]).between(3, 12), 0.06).otherwise(0.0)).otherwise(0.0)
    keyed = F.transform(routes, lambda r, i: F.struct((-F.least(F.lit(1.0), F.round(score(r), 9))).alias("s"), i.alias("i"), r["route"].alias("route"), r["boxes"].alias("boxes")))
    return let(F.array_min(keyed), lambda best: F.struct(F.coalesce(best["route"], F.lit("")).alias("route"), F.coalesce(best["boxes"], none()).alias("boxes"), F.coalesce(-best["s"], F.lit(0.0)).alias("score")))


def chosen(routes: Column, style: Column, page: Column, high: Column) -> Column:
    """Classic pages: the best route, gutters preferred. Modern ones: the best without header and footer strips."""
    strip = lambda b: (b["h"] < 0.10 * high) & ((b["y"] < 0.06 * high) | (b["y"] + b["h"] > 0.94 * high))
    clean = F.filter(F.transform(routes, lambda r: F.struct(r["route"].alias("route"), F.filter(r["boxes"], lambda b: ~strip(b)).alias("boxes"))), lambda r: F.size(r["boxes"]) > 0)
    modern = style == "modern"
    return _best(let(clean, lambda c: F.when(modern & (F.size(c) > 0), c).otherwise(routes)), page, ~modern)


def template_fits(content: Column, edge: Column, grid: int = 20) -> Column:
    """Structs (score, n, catalogue_no, boxes as shares of the page) of every template on a page's tiles."""
    catalogue = [m | {"boxes": [dict(zip("xywh", b, strict=True)) for b in T.TEMPLATES[m["catalogue_no"]][1]]} for m in T.template_masks(grid)]
    masks = F.from_json(F.lit(json.dumps(catalogue)), T.MASKS.replace("border:array<int>", f"border:array<int>,boxes:{BOXES}"))
    total = lambda index, of: F.aggregate(index, F.lit(0.0), lambda a, i: a + F.get(of, i))
    ink = _total(content)

    def fit(m):
        shares = F.transform(m["panels"], lambda p: total(p, content) / F.size(p))
        return let(shares, lambda xs: let(_total(xs) / F.size(xs), lambda mean: rated(m, xs, mean)))

    def rated(m, shares, mean):
        std = F.sqrt(_total(F.transform(shares, lambda s: (s - mean) * (s - mean))) / F.size(shares))
        free = F.lit(grid * grid) - F.size(m["inside"])
        gutter = F.when(free > 0, F.greatest(F.lit(0.0), 1 - (ink - total(m["inside"], content)) / free / 0.15)).otherwise(0.5)
        edges = total(m["border"], edge) / F.size(m["border"])
        even = F.when(m["n"] > 1, F.greatest(F.lit(0.0), 1 - F.when(mean > 0, std / mean).otherwise(1.0))).otherwise(0.5)
        score = 0.30 * F.least(mean / 0.3, F.lit(1.0)) + 0.30 * gutter + 0.25 * F.least(edges / 0.15, F.lit(1.0)) + 0.15 * even
        return F.struct(F.round(score, 9).alias("score"), m["n"].alias("n"), m["catalogue_no"].alias("catalogue_no"), m["boxes"].alias("boxes"))

    return F.transform(masks, fit)


def with_template(pages: DataFrame, boxes: str, weak: float = 0.60, good: float = 0.50, least: float = 0.45) -> DataFrame:
    """pages whose weak `boxes` give way to the best template where that fits and its own layout is better; `template` names it.

    The tiles are looked at only on weak pages.
    """
    wide, high, now = F.col("width"), F.col("height"), F.col(boxes)
    order = lambda t: F.struct((-t["score"]).alias("s"), F.abs(t["n"] - F.size(now)).alias("off"), t["catalogue_no"].alias("k"), t["boxes"].alias("boxes"))
    pages = pages.withColumn("_score", layout_score(now, wide * high))
    pages = pages.withColumn("_fit", F.when(F.col("_score") < weak, F.array_min(F.transform(template_fits(F.col("content"), F.col("edge")), order))))
    scaled = F.transform("_fit.boxes", lambda b: F.struct((b["x"] * wide).alias("x"), (b["y"] * high).alias("y"), (b["w"] * wide).alias("w"), (b["h"] * high).alias("h")))
    pages = pages.withColumn("_new", scaled)
    swap = F.coalesce((-F.col("_fit.s") >= max(good, least)) & (layout_score(F.col("_new"), wide * high) > F.col("_score")), F.lit(False))
    names = F.array(*[F.lit(name) for name, _ in T.TEMPLATES])
    return pages.withColumn("template", F.when(swap, F.get(names, F.col("_fit.k")))).withColumn(boxes, F.when(swap, F.col("_new")).otherwise(now)).drop("_score", "_fit", "_new")


# --- filters after the choice


def kept_by_content(boxes: Column, measured: Column, page: Column, min_ink: float = 0.03, min_content: float = 0.08, thin: float = 0.12, min_std: float = 12.0) -> Column:
    """Boxes neither too small nor the page, with dark pixels, that differ from the background; thin ones need more of it."""
    sized = F.zip_with(boxes, measured, lambda b, m: F.struct(b.alias("b"), m.alias("m")))
    fine = F.filter(sized, lambda s: (area(s["b"]) / page).between(0.008, 0.95) & (s["m"]["dark"] >= min_ink))

    def median(found, c):
        half = lambda xs: F.floor(F.size(xs) / 2).cast("int")
        middle = lambda xs: F.when(F.size(xs) % 2 == 1, F.get(xs, half(xs))).otherwise((F.get(xs, half(xs) - 1) + F.get(xs, half(xs))) / 2)
        return let(F.array_sort(F.transform(found, lambda s: s["b"][c])), lambda xs: F.when(F.size(xs) > 1, middle(xs)).otherwise(0.0))

    bare = lambda s: (s["m"]["non_bg"] < min_content) & (s["m"]["std"] < min_std)
    narrow = lambda s, m: (m["w"] > 0) & (m["h"] > 0) & ((s["b"]["h"] < thin * m["h"]) | (s["b"]["w"] < thin * m["w"])) & (s["m"]["non_bg"] < max(1.8 * min_content, 0.18))
    kept = lambda found, m: F.transform(F.filter(found, lambda s: ~bare(s) & ~narrow(s, m)), lambda s: s["b"])
    return let(fine, lambda found: let(F.struct(median(found, "w").alias("w"), median(found, "h").alias("h")), lambda m: kept(found, m)))


def without_titles(boxes: Column, wide: Column, high: Column) -> Column:
    return F.filter(boxes, lambda b: ~((b["y"] < 0.15 * high) & (b["h"] < 0.12 * high) & (b["w"] > 0.35 * wide)))


def splash_fate(now: Column, before: Column, non_bg: Column, style: Column, gutters: Column, outlines: Column, page: Column) -> Column:
    """same, back (modern pages that filters emptied) or whole (pages that are one picture)."""
    n, sizes = F.size(now), F.transform(now, area)
    held, busy, big = (style == "modern") & (F.size(before) >= 2), non_bg > 0.35, F.coalesce(F.array_max(sizes), F.lit(0.0))
    lone = (n == 1) & (big / page < 0.60) & busy & ~held
    one = (n > 0) & (gutters == 0) & (outlines == 0) & (big / page > 0.40) & ((_total(sizes) - big) / page < 0.20)
    return F.when((n == 0) & held, "back").when(((n == 0) & busy) | lone | one, "whole").otherwise("same")


# --- the whole


def with_evidence(pages: DataFrame, scales: tuple[float, ...] = (1.0,), off: tuple[str, ...] = (), least: int = 100, facts: bool = True, pack: bool = False) -> DataFrame:
    """pages with `seen`, what the routes see at each scale (scale, EVIDENCE), and the page's FACTS, in one pass.

    Without facts, they are left out, and so are the pixels, which no later step will ask for. Routes named in `off` aren't run. Other scales than 1 are left out where a side gets under `least` pixels.
    pack: pixels go on as bytes (with_columns).
    """

    def look(page: Page) -> tuple:
        seen = []
        for s in scales:
            p = page if s == 1.0 else resized(page, s)
            if s != 1.0 and min(p.wide, p.high) < least:
                continue
            one = {"scale": float(p.wide / page.wide) if s != 1.0 else 1.0}
            one["adaptive"] = [] if "adaptive" in off else N.adaptive(p)
            one["lsd"] = [] if "lsd" in off else N.line_cells(p)
            one["hierarchy"] = [] if "hierarchy" in off else N.hierarchy(p)
            one["gutter_flat"], one["gutter_rows"] = ([], []) if "gutter" in off else N.gutter_grids(p)
            seen.append(one)
        return (seen, N.gutter_runs(page), N.tint(page), N.palette(page), *N.tiles(page)) if facts else (seen,)

    as_struct = EVIDENCE.replace(" array<struct", ":array<struct").replace(", ", ",")
    return with_columns(pages, look, f"seen array<struct<scale:double,{as_struct}>>" + (f", {FACTS}" if facts else ""), drop_pixels=not facts, pack=pack)


def decide(pages: DataFrame, mode: str = "auto", model=None, min_agree: int = 2) -> DataFrame:
    """pages (with_evidence) with `style`, `routes` (those at full size), `picked` (route, boxes, score) over all scales, `background`.

    With several scales, `picked` has what min_agree of them agree on, or else the boxes of the scale with most.
    """
    wide, high = F.col("width"), F.col("height")
    by_route = lambda s: route_boxes(s, wide * s["scale"], high * s["scale"])

    def listed(s):
        boxes = by_route(s)  # the names' order breaks ties
        return F.filter(F.array(*[F.struct(F.lit(k).alias("route"), boxes[k].alias("boxes")) for k in ROUTES]), lambda r: F.size(r["boxes"]) > 0)

    back = lambda boxes, f: F.transform(boxes, lambda b: F.struct(*[(b[c] / f).alias(c) for c in "xywh"]))
    found = F.transform("seen", lambda s: F.struct(s["scale"].alias("scale"), F.transform(listed(s), lambda r: F.struct(r["route"].alias("route"), back(r["boxes"], s["scale"]).alias("boxes"))).alias("routes")))
    pages = pages.withColumn("found", found).drop("seen")
    whole = F.get(F.filter("found", lambda s: s["scale"] == 1.0), F.lit(0))
    first = F.coalesce(whole, F.get("found", F.lit(0)))
    pages = pages.withColumn("routes", first["routes"])
    pages = pages.withColumn("_adaptive", F.coalesce(F.get(F.filter("routes", lambda r: r["route"] == "adaptive"), F.lit(0))["boxes"], none()))
    pages = with_style(pages, "_adaptive", mode, model).drop("_adaptive")
    best = F.transform("found", lambda s: chosen(s["routes"], F.col("style"), wide * high, high))
    pages = pages.withColumn("_best", best).drop("found")
    every = F.flatten(F.transform("_best", lambda r, k: F.transform(r["boxes"], lambda b: F.struct(k.alias("scale"), b.alias("b")))))
    both = agreed(every, 3, min_agree)
    most = F.array_max(F.transform("_best", lambda r, k: F.struct(F.size(r["boxes"]).alias("n"), (-k).alias("k"), r.alias("r"))))["r"]
    pages = pages.withColumn("_both", F.when(F.size("_best") > 1, both).otherwise(none()))
    shared = F.struct(F.lit("consensus").alias("route"), F.col("_both").alias("boxes"), layout_score(F.col("_both"), wide * high).alias("score"))
    pages = pages.withColumn("picked", F.when(F.size("_both") > 0, shared).otherwise(most)).drop("_both", "_best")
    return pages.withColumn("background", dominant_background(F.col("clusters"))).drop("clusters")


def with_freeform(pages: DataFrame, weak: float = 0.45, delta: float = 15.0) -> DataFrame:
    """pages whose weak `picked` gives way to freeform regions if those are better; only modern and weak pages are looked at."""
    page = F.col("width") * F.col("height")
    pages = pages.withColumn("_try", (F.col("style") == "modern") & (F.col("picked.score") < weak))
    look = lambda p, ask, bg: (N.freeform(p, (bg["L"], bg["A"], bg["B"]), delta) if ask else [],)
    pages = with_columns(pages, look, f"_free array<{N.CANDIDATE}>", ["_try", "background"])
    pages = pages.withColumn("_free", region_boxes(F.col("_free"), page)).withColumn("_worth", layout_score(F.col("_free"), page))
    other = F.struct(F.lit("freeform").alias("route"), F.col("_free").alias("boxes"), F.col("_worth").alias("score"))
    better = F.col("_try") & (F.col("_worth") > F.col("picked.score"))
    return pages.withColumn("picked", F.when(better, other).otherwise(F.col("picked"))).withColumn("freeform_tried", F.col("_try")).drop("_free", "_worth", "_try")


def detect(
    pages: DataFrame, corrected: DataFrame | None = None, scales: tuple[float, ...] = (1.0,), mode: str = "auto", model=None, off: tuple[str, ...] = (),
    titles: bool = False, templates: bool = True, freeform: bool = True, rtl: bool = False, row_gap: float = 0.024, delta: float = 15.0,
) -> DataFrame:
    """One row for each page: its panels in reading order, and every decision on the way to them.

    pages: page_id, width, height, gray and, where there is colour, r, g, b; any sizes in one frame.
    Returns the other columns of pages, panels (array of boxes in the page's pixels), style, route,
    score, n_routes (map from route to its number of boxes), freeform_tried, template, fate, non_bg.
    corrected: (page_id, boxes), at most one row for a page; a page with such a row takes its boxes,
    also if there are none, whatever was found. row_gap is a share of the page's height.
    """
    wide, high, size = F.col("width"), F.col("height"), F.col("width") * F.col("height")
    p = decide(with_evidence(pages, scales, off, pack=True), mode, model)
    p = with_freeform(p, delta=delta) if freeform and "freeform" not in off else p.withColumn("freeform_tried", F.lit(False))
    p = p.withColumn("panels", F.col("picked.boxes"))
    p = with_template(p, "panels") if templates else p.withColumn("template", F.lit(None).cast("string"))
    p = with_measures(p, "panels", "background", delta, drop_pixels=True)
    titled = without_titles(F.col("panels"), wide, high) if titles else F.col("panels")
    measured = F.col("measured")
    if titles:
        both = F.filter(F.zip_with("panels", "measured", lambda b, m: F.struct(b.alias("b"), m.alias("m"))), lambda s: F.array_contains(titled, s["b"]))
        p = p.withColumn("_titled", both)
        titled, measured = F.transform("_titled", lambda s: s["b"]), F.transform("_titled", lambda s: s["m"])
    p = p.withColumn("_kept", kept_by_content(titled, measured, size)).drop("_titled")
    p = p.withColumn("_fine", nested_absorbed(F.col("_kept")))
    number = lambda name: F.coalesce(F.get(F.filter("routes", lambda r: r["route"] == name), F.lit(0)).getField("boxes"), none())
    p = p.withColumn("fate", splash_fate(F.col("_fine"), F.col("panels"), F.col("whole.non_bg"), F.col("style"), F.size(number("gutter")), F.size(number("hierarchy")), size))
    page_box = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), wide.cast("double").alias("w"), high.cast("double").alias("h")))
    p = p.withColumn("panels", F.when(F.col("fate") == "back", F.col("panels")).when(F.col("fate") == "whole", page_box).otherwise(F.col("_fine")))
    if corrected is not None:
        p = p.join(corrected.select("page_id", F.col("boxes").alias("_saved"), F.lit(True).alias("_has")), "page_id", "left")
        p = p.withColumn("fate", F.when(F.col("_has"), "corrected").otherwise(F.col("fate"))).withColumn("panels", F.when(F.col("_has"), plain(F.coalesce("_saved", none()))).otherwise(F.col("panels")))
    p = p.withColumn("panels", in_reading_order(F.col("panels"), row_gap * high, rtl))
    counts = F.map_from_entries(F.transform("routes", lambda r: F.struct(r["route"], F.size(r["boxes"]))))
    others = [c for c in pages.columns if c not in ("gray", "r", "g", "b")]
    out = p.select(*others, "panels", "style", F.col("picked.route").alias("route"), F.col("picked.score").alias("score"), counts.alias("n_routes"), "freeform_tried", "template", "fate", F.col("whole.non_bg").alias("non_bg"))
    return settled(out)


def in_height_order(boxes: Column) -> Column:
    """Rows anchored on the top of their first box, as far as half of that box's height, each from left to right."""
    items = F.array_sort(F.transform(boxes, lambda b: F.struct(b["y"].alias("y"), b["x"].alias("x"), _box(b).alias("b"))))
    start = F.struct(F.lit(None).cast("double").alias("at"), F.lit(0.0).alias("reach"), F.lit(0).alias("row"), F.array().cast(f"array<struct<row:int,across:double,b:{BOX}>>").alias("out"))

    def step(acc, i):
        same = F.coalesce(F.abs(i["y"] - acc["at"]) < acc["reach"], F.lit(False))
        row = acc["row"] + F.when(same, 0).otherwise(1)
        placed = F.struct(row.alias("row"), i["x"].alias("across"), i["b"].alias("b"))
        at, reach = F.when(same, acc["at"]).otherwise(i["y"]), F.when(same, acc["reach"]).otherwise(0.5 * i["b"]["h"])
        return F.struct(at.alias("at"), reach.alias("reach"), row.alias("row"), F.concat(acc["out"], F.array(placed)).alias("out"))

    return F.transform(F.array_sort(F.aggregate(items, start, step, lambda acc: acc["out"])), lambda p: p["b"])


def detect_bordered(
    pages: DataFrame, lower: tuple[int, int, int] | None = None, upper: tuple[int, int, int] | None = None, close: int = 7, widen: int = 7,
    min_area: float = 10_000, aspect: tuple[float, float] = (0.2, 5.0), ink: float = 0.35,
) -> DataFrame:
    """Panels inside borders of a colour (a range of hue in half degrees, saturation and value) or, without one, dark borders.

    Boxes that are small, narrow, wholly in the upper 35 % or editorial (full of ink, low and wide) go.
    Returns the columns of pages without pixels, and panels in reading order.
    """
    wide, high = F.col("width"), F.col("height")
    seen = with_columns(pages, lambda p: (N.bordered(p, lower, upper, close, widen),), "_seen array<struct<x:double,y:double,w:double,h:double,ink:double>>", drop_pixels=True)
    fine = lambda b: (area(b) >= min_area) & (b["w"] / b["h"]).between(*aspect) & (b["y"] + b["h"] >= 0.35 * high)
    editorial = lambda b: (b["ink"] > ink) & (b["h"] < 0.25 * high) & (b["w"] > 0.40 * wide)
    return settled(seen.withColumn("panels", in_height_order(F.filter("_seen", lambda b: fine(b) & ~editorial(b)))).drop("_seen"))


def panels(detected: DataFrame) -> DataFrame:
    """(page_id, panel_no, x, y, w, h), one row for each panel of detect()."""
    return detected.select("page_id", F.posexplode("panels").alias("_i", "b")).select("page_id", (F.col("_i") + 1).alias("panel_no"), "b.*")
