"""Registered queries, each with the SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrid.functions import geometry as G
from pagegrid.operators import arrays as A
from pagegrid.operators import library as L
from pagegrid.operators import raster as P
from pagegrid.operators import rects as R
from pagegrid.operators import stencils as S
from pagegrid.sources import views as V
from pagegrid.sources.views import PAGE_H, PAGE_W, RASTER_H, RASTER_W

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
WITH = {"r": V.RECTS_SQL, "prof": V.PROFILES_SQL, "px": V.PIXELS_SQL, "act": V.ACTIONS_SQL, "pan": V.PANELS_SQL, "cells": V.CELLS_SQL}


def query(sql: str | None = None, *views: str):
    """Register the function under its name; views name the CTEs that its SQL reads."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = ("with recursive " + ", ".join(f"{v} as ({WITH[v]})" for v in views) + (", " if not sql.lstrip().lower().startswith("select") else "\n") if views else "") + sql
        return f

    return add


def inter(a: str, b: str) -> str:
    return f"(greatest(0, least({a}.x+{a}.w, {b}.x+{b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y+{a}.h, {b}.y+{b}.h) - greatest({a}.y, {b}.y)))"


def iou_sql(a: str, b: str) -> str:
    return f"({inter(a, b)} / ({a}.w*{a}.h + {b}.w*{b}.h - {inter(a, b)}))"


def union_sql(a: str, b: str) -> str:
    """The smallest box around two, as a struct."""
    return (
        f"{{'x': least({a}.x, {b}.x), 'y': least({a}.y, {b}.y), 'w': greatest({a}.x+{a}.w, {b}.x+{b}.w) - least({a}.x, {b}.x), "
        f"'h': greatest({a}.y+{a}.h, {b}.y+{b}.h) - least({a}.y, {b}.y)}}"
    )


BOX_SQL = "{'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h}"
ITEM_SQL = "{'rect_id': o.rect_id, 'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h}"


def keep_sql(order: str, clash: str) -> str:
    """A greedy pass over o in `order`: an item stays unless one kept before clashes."""
    return f"""o as (select *, row_number() over (partition by page_id order by {order}) k from r),
f(page_id, k, kept) as (select page_id, k, [{ITEM_SQL}] from o where k = 1
  union all select o.page_id, o.k, case when len(list_filter(kept, lambda m: {clash})) > 0 then kept else list_append(kept, {ITEM_SQL}) end
  from f join o on o.page_id = f.page_id and o.k = f.k + 1),
z as (select page_id, unnest(kept) m from (select * from f qualify row_number() over (partition by page_id order by k desc) = 1))
select page_id, m.rect_id::bigint rect_id, m.x x, m.y y, m.w w, m.h h from z"""


def merge_sql(source: str, least: float, name: str = "m1") -> str:
    """CTEs {name}f and {name}: the greedy merge of `source` (page_id, rect_id, x, y, w, h), ids from 0."""
    hit = f"list_position(list_transform(kept, lambda m: {iou_sql('m', 'o')} >= {least}), true)"
    return f"""{name}o as (select *, row_number() over (partition by page_id order by rect_id) k from {source}),
{name}f(page_id, k, kept) as (select page_id, k, [{BOX_SQL}] from {name}o o where k = 1
  union all select o.page_id, o.k, case when {hit} > 0 then list_transform(kept, lambda m, i: case when i = {hit} then {union_sql('m', 'o')} else m end) else list_append(kept, {BOX_SQL}) end
  from {name}f f join {name}o o on o.page_id = f.page_id and o.k = f.k + 1),
{name} as (select page_id, (unnest(range(len(kept))))::int merged_id, unnest(kept) m from (select * from {name}f qualify row_number() over (partition by page_id order by k desc) = 1))"""


INTER = "greatest(0, least(a.x+a.w, b.x+b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y+a.h, b.y+b.h) - greatest(a.y, b.y))"
PAIRS_ALL = f"pairs as (select a.page_id, a.rect_id i, b.rect_id j, {INTER} inter, a.w*a.h aa, b.w*b.h ba from r a join r b on a.page_id = b.page_id and a.rect_id < b.rect_id)"


@query("select page_id, rect_id, x, y, w, h from r where not (y < 0.15::double*910 and h < 0.12::double*910 and w > 0.35::double*720)", "r")
def f1_filter_title_rows(s: SparkSession, d: str) -> DataFrame:
    return R.filter_title_rows(V.rects(s, d), PAGE_W, PAGE_H).select("page_id", "rect_id", "x", "y", "w", "h")


@query("select page_id, rect_id, x, y, w, h from r where w*h/(720.0::double*910.0::double) between 0.03 and 0.05", "r")
def f2_filter_by_area(s, d):
    return R.filter_by_area(V.rects(s, d), PAGE_W, PAGE_H, 0.03, 0.05).select("page_id", "rect_id", "x", "y", "w", "h")


@query("select page_id, rect_id, x, y, w, h from r where not (h < 91 and (y < 54.6 or y+h > 855.4))", "r")
def f3_remove_header_footer(s, d):
    return R.remove_header_footer(V.rects(s, d), PAGE_H).select("page_id", "rect_id", "x", "y", "w", "h")


@query("select page_id, rect_id, x, y, w, h from r where w*h >= 10000 and w/h between 0.2 and 5 and y+h >= 318.5", "r")
def f5_box_filter(s, d):
    return R.box_filter(V.rects(s, d), PAGE_H).select("page_id", "rect_id", "x", "y", "w", "h")


@query("select page_id, rect_id, cast(trunc(x*1.5) as int) x_px, cast(round_even(y*1.5, 0) as int) y_px, (x*1.5)/1.5 x_pt from r", "r")
def p1_px_pt(s, d):
    r = V.rects(s, d)
    wide, pt = F.lit(1080.0), F.lit(720.0)
    return r.select("page_id", "rect_id", G.pt_to_px(F.col("x"), wide, pt).alias("x_px"), G.pt_to_px(F.col("y"), wide, pt, "round").alias("y_px"), G.px_to_pt(F.col("x") * 1.5, wide, pt).alias("x_pt"))


@query("select page_id, rect_id, w*h area, w*h/(720.0::double*910.0::double) area_pct, w/h aspect, x+w/2 cx, y+h/2 cy, x<=0 or y<=0 or x+w>=720 or y+h>=910 touches_border from r", "r")
def p8_rect_metrics(s, d):
    return R.rect_metrics(V.rects(s, d), PAGE_W, PAGE_H)


@query(f"{PAIRS_ALL} select page_id, i, j, inter, inter/(aa+ba-inter) iou, inter/least(aa,ba) of_smaller from pairs where inter > 0", "r")
def j1_overlap_pairs(s, d):
    return R.overlap_pairs(V.rects(s, d))


@query("""e as (select page_id, x e from r union select page_id, x+w from r),
st as (select page_id, e, lead(e) over (partition by page_id order by e) e2 from e),
i as (select st.page_id, e, e2, y, h, max(y+h) over (partition by st.page_id, e order by y, rect_id rows between unbounded preceding and 1 preceding) reach from st join r on r.page_id = st.page_id and x <= e and x+w >= e2 where e2 is not null)
select page_id, sum(greatest(0, y+h-greatest(y, coalesce(reach, y))) * (e2-e)) / 655200.0::double coverage from i group by page_id""", "r")
def a6_union_coverage(s, d):
    return R.union_coverage(V.rects(s, d), PAGE_W, PAGE_H)


SCORES = f"""p2 as (select a.page_id, a.route, {INTER} inter, a.w*a.h aa, b.w*b.h ba from r a join r b on a.page_id=b.page_id and a.route=b.route and a.rect_id<b.rect_id),
o as (select page_id, route, sum(inter/(aa+ba-inter)) o from p2 where inter > 0 and inter/(aa+ba-inter) > 0.15 group by all),
b as (select page_id, route, count(*) n, sum(w*h) s, min(w*h) lo, max(w*h) hi from r group by all),
sc as (select page_id, route, n, round(0.35 * (case when n between 3 and 8 then 1.0::double when n between 2 and 12 then 0.7::double when n = 1 then 0.3::double else 0.4::double end)
  + 0.30 * least(1.0, least(1.0, s/655200.0::double)/0.75::double) + 0.15 * (case when n = 1 then 0.5::double else greatest(0.2::double, lo/hi) end) + 0.20 * greatest(0.0, 1 - 0.2*coalesce(o, 0.0)), 9) score
  from b left join o using (page_id, route))"""


@query(f"{SCORES} select page_id, route, n, score from sc", "r")
def a4_score_layout(s, d):
    return R.score_layout(V.rects(s, d), PAGE_W, PAGE_H)


@query(f"""{SCORES}, f as (select page_id, route, n, round(case when route = 'gutter' and n between 3 and 12 then least(1.0::double, score + 0.06) else score end, 9) score from sc)
select page_id, route, n, score from f qualify row_number() over (partition by page_id order by score desc, list_position(['adaptive','lsd','hierarchy','gutter'], route)) = 1""", "r")
def k1_select_route(s, d):
    return R.select_route(R.score_layout(V.rects(s, d), PAGE_W, PAGE_H))


@query(merge_sql("r", 0.25) + " select page_id, merged_id, m.x x, m.y y, m.w w, m.h h from m1", "r")
def m1_merge_rects(s, d):
    return R.merge_rects(V.rects(s, d))


@query(keep_sql("w*h desc, rect_id", f"{inter('m', 'o')} > 0.85*(o.w*o.h)"), "r")
def j3_remove_nested(s, d):
    return R.remove_nested(V.rects(s, d))


@query(keep_sql("w*h desc, rect_id", f"{inter('m', 'o')} / least(m.w*m.h, o.w*o.h) > 0.4"), "r")
def j4_nms(s, d):
    return R.nms(V.rects(s, d))


@query("""o as (select *, row_number() over (partition by page_id order by y, x, rect_id) k from r),
f(page_id, k, anchor, line) as (select page_id, k, y, 1 from o where k = 1
  union all select o.page_id, o.k, case when abs(o.y - anchor) < 20 then anchor else o.y end, case when abs(o.y - anchor) < 20 then line else line + 1 end from f join o on o.page_id = f.page_id and o.k = f.k + 1)
select page_id, line as row, rect_id, x, y, w, h, row_number() over (partition by page_id order by line, x, rect_id) panel_no from f join o using (page_id, k)""", "r")
def w3_reading_order(s, d):
    return R.reading_order(V.rects(s, d))


PROFILE = "pr as (select page_id, y idx, avg(v) mean_v from px group by all)"
BANDS = """th as (select page_id, median(mean_v) + 0.65*(max(mean_v)-median(mean_v)) t from {p} group by 1 having max(mean_v)-median(mean_v) >= 30),
g{p} as (select page_id, idx, case when idx - lag(idx) over (partition by page_id order by idx) <= 5 then 0 else 1 end new from {p} join th using (page_id) where mean_v >= t),
i{p} as (select page_id, idx, sum(new) over (partition by page_id order by idx) b from g{p}),
b{p} as (select page_id, min(idx) lo, max(idx) hi from i{p} group by page_id, b having max(idx)-min(idx)+1 >= 3)"""


@query("select page_id, y idx, avg(v) mean_v from px group by all", "px")
def a1_profile(s, d):
    return P.profile(V.pixels(s, d), "y")


@query("select page_id, x idx, avg(v) mean_v from px where x between 1 and 46 and y between 1 and 62 group by all", "px")
def a1_interior_profile(s, d):
    """Column means inside margins of 3 %."""
    return S.interior_profile(V.rasters(s, d), axis=1)


@query("select page_id, median(v) + 0.8*(max(v)-median(v)) threshold from prof group by 1 having max(v)-median(v) >= 30", "prof")
def a2_profile_threshold(s, d):
    return P.profile_threshold(V.profiles(s, d).withColumnRenamed("v", "mean_v"), 0.8)


@query("select page_id, quantile_cont(v, 0.94) p94, quantile_cont(v, 0.25) p25 from px group by 1", "px")
def a3_pixel_percentile(s, d):
    return V.pixels(s, d).groupBy("page_id").agg(F.percentile("v", F.lit(0.94)).alias("p94"), F.percentile("v", F.lit(0.25)).alias("p25"))


@query(f"{PROFILE}, {BANDS.format(p='pr')} select page_id, lo, hi from bpr", "px")
def w1_bands(s, d):
    return P.profile_bands(V.pixels(s, d), "y")


@query("select page_id, floor(y*0.5)::bigint y, floor(x*0.5)::bigint x, avg(v) v from px group by all", "px")
def s5_resize(s, d):
    return S.resized_pixels(V.rasters(s, d), 0.5)


def with_four_boxes(pages: DataFrame) -> DataFrame:
    """pages with four boxes of 20 x 25 pixels at places that follow from the page's id."""
    box = lambda k: F.struct((F.col("page_id") * k % 20).alias("x"), ((F.col("page_id") + 7 * k) % 30).alias("y"), F.lit(20).alias("w"), F.lit(25).alias("h"))
    return pages.withColumn("boxes", F.array(*[box(k) for k in range(1, 5)]))


@query("select c.page_id, c.rect_id, sum(case when v >= 225 then 1 else 0 end)::bigint total from (select s_suppkey page_id, k rect_id, (s_suppkey*k)%20 x, (s_suppkey+7*k)%30 y from supplier cross join (select unnest(range(1,5)) k)) c join px on px.page_id = c.page_id and px.x between c.x and c.x+19 and px.y between c.y and c.y+24 group by all", "px")
def j6_region_sums(s, d):
    """Bright pixels in four boxes of every page, from the page's summed-area table."""
    bright = {"total": lambda page: page.gray >= 225}
    found = S.with_totals(with_four_boxes(V.rasters(s, d)), "boxes", bright)
    return found.select("page_id", F.posexplode("totals").alias("i", "t")).select("page_id", (F.col("i") + 1).alias("rect_id"), "t.total")


def moved(s, d, op: str) -> DataFrame:
    """Pixels of every page after a step of 5 x 3 pixels, read off the page's row."""
    return S.as_pixels(S.with_plane(V.rasters(s, d), lambda g: S.extremes(g, op, 2, 1), kind="bigint"))


def morphology_sql(*steps: str) -> str:
    """One running extreme along each axis for every step."""
    ctes, last = [], "px"
    for i, f in enumerate(steps):
        ctes.append(f"m{i} as (select page_id, y, x, {f}(v) over (partition by page_id, y order by x rows between 2 preceding and 2 following) v from {last})")
        ctes.append(f"n{i} as (select page_id, y, x, {f}(v) over (partition by page_id, x order by y rows between 1 preceding and 1 following) v from m{i})")
        last = f"n{i}"
    return ", ".join(ctes) + f" select page_id, y, x, v::bigint v from {last}"


@query("select page_id, y, x, max(m) over (partition by page_id, x order by y rows between 1 preceding and 1 following) v from (select page_id, y, x, max(v) over (partition by page_id, y order by x rows between 2 preceding and 2 following) m from px)", "px")
def w8_dilate(s, d):
    return moved(s, d, "dilate")


@query(morphology_sql("min"), "px")
def w8_erode(s, d):
    return moved(s, d, "erode")


@query(morphology_sql("min", "max"), "px")
def w8_open(s, d):
    return moved(s, d, "open")


@query(morphology_sql("max", "min"), "px")
def w8_close(s, d):
    return moved(s, d, "close")


@query("""n as (select a.page_id, a.y, a.x, sum(b.v*(b.x-a.x)*(2-abs(b.y-a.y))) gx, sum(b.v*(b.y-a.y)*(2-abs(b.x-a.x))) gy, count(*) c from px a join px b on a.page_id=b.page_id and b.x between a.x-1 and a.x+1 and b.y between a.y-1 and a.y+1 group by all)
select page_id, y, x, (abs(gx)+abs(gy))::bigint g from n where c = 9""", "px")
def w7_gradient(s, d):
    return inner(S.as_pixels(S.with_plane(V.rasters(s, d), A.gradient, kind="bigint"))).withColumnRenamed("v", "g")


def inner(pixels: DataFrame) -> DataFrame:
    """Pixels of the rasters that have all eight neighbours."""
    return pixels.filter((F.col("y") > 0) & (F.col("y") < RASTER_H - 1) & (F.col("x") > 0) & (F.col("x") < RASTER_W - 1))


@query("""n as (select a.page_id, a.y, a.x, sum(b.v*(b.x-a.x)*(10-7*abs(b.y-a.y))) gx, sum(b.v*(b.y-a.y)*(10-7*abs(b.x-a.x))) gy, count(*) c from px a join px b on a.page_id=b.page_id and b.x between a.x-1 and a.x+1 and b.y between a.y-1 and a.y+1 group by all)
select page_id, y, x, round(sqrt((gx*gx + gy*gy)::double), 6) g from n where c = 9""", "px")
def w7_scharr(s, d):
    return inner(S.as_pixels(S.with_plane(V.rasters(s, d), S.scharr))).select("page_id", "y", "x", F.round("v", 6).alias("g"))


@query("select page_id, ty::int ty, tx::int tx, avg(case when v < 200 then 1.0::double else 0.0 end) content from px join (select unnest(range(20)) ty) on y >= (ty*64)//20 and y < ((ty+1)*64)//20 join (select unnest(range(20)) tx) on x >= (tx*48)//20 and x < ((tx+1)*48)//20 group by all", "px")
def a9_tile_maps(s, d):
    return A.tile_maps(V.rasters(s, d)).drop("edge")


@query("select page_id, idx, v - lag(v) over (partition by page_id order by idx) diff from prof qualify abs(diff) > 20", "prof")
def w10_profile_diff(s, d):
    from pyspark.sql.window import Window

    out = V.profiles(s, d).withColumn("diff", F.col("v") - F.lag("v").over(Window.partitionBy("page_id").orderBy("idx")))
    return out.filter(F.abs("diff") > 20).select("page_id", "idx", "diff")


@query("select case s_suppkey % 3 when 0 then 2 when 1 then 3 else 4 end::bigint n, s_suppkey page_id from supplier")
def panel_counts(s, d):
    return panels_from_gutters(s, d).groupBy("page_id").agg(F.count("*").alias("n"))


@query("select page_id, (row_number() over (partition by page_id order by y, x))::int panel_no, x, y, w, h from cells", "cells")
def panels_from_gutters(s, d):
    """The minimum slice: one row a page from pixels to cells, then reading order."""
    cells = A.with_id(A.gutter_cells(V.rasters(s, d)))
    return R.reading_order(cells, row_gap=5.0).select("page_id", "panel_no", "x", "y", "w", "h")


@query("select page_id, ts, event_id, value from act where action in ('upsert','revert') qualify row_number() over (partition by page_id order by ts desc, event_id desc) = 1 and action = 'upsert'", "act")
def t4_corrections_state(s, d):
    return L.live_corrections(V.actions(s, d)).select("page_id", "ts", "event_id", "value")


@query("select page_id, ts, event_id, action, value from act qualify row_number() over (partition by page_id order by ts desc, event_id desc) = 1", "act")
def t2_latest_task(s, d):
    return L.latest_by_page(V.actions(s, d))


@query("""c as (select distinct page_id from act where action = 'upsert')
select page_id, rect_id, x, y, w, h from r where page_id not in (select page_id from c) union all select page_id, 1, 0.0::double, 0.0::double, 720.0::double, 910.0::double from c""", "r", "act")
def j11_apply_corrections(s, d):
    one = V.actions(s, d).filter("action = 'upsert'").select("page_id").distinct()
    saved = one.select("page_id", F.lit(1).alias("rect_id"), *[F.lit(v).alias(c) for c, v in zip("xywh", (0.0, 0.0, PAGE_W, PAGE_H), strict=True)])
    return L.apply_corrections(V.rects(s, d).select("page_id", "rect_id", "x", "y", "w", "h"), saved)


@query("select distinct page_id, 'h' || (page_id % 2) config_hash from r where not (page_id % 3 = 0 and page_id % 2 = 1)", "r")
def j12_pending_pages(s, d):
    pages = V.rects(s, d).select("page_id").distinct().withColumn("config_hash", F.concat(F.lit("h"), (F.col("page_id") % 2).cast("string")))
    done = pages.filter("page_id % 3 = 0").select("page_id", F.lit("h1").alias("config_hash"))
    return L.pending_pages(pages, done)


@query("select page_id from (select page_id+1 page_id from r where page_id % 10 = 0 union select page_id-1 from r where page_id % 10 = 0) where page_id in (select page_id from r) and page_id not in (select page_id from r where page_id % 4 = 1)", "r")
def j13_neighbour_pages(s, d):
    p = V.rects(s, d).select("page_id").distinct()
    return L.neighbour_pages(p.filter("page_id % 10 = 0"), p, p.filter("page_id % 4 = 1"))


@query("select event_id point_id, user_id page_id, max(rect_id) rect_id from events left join r on r.page_id = user_id and (event_id*37)%720 between x and x+w and (event_id*53)%910 between y and y+h group by all", "r")
def j15_hit_test(s, d):
    pts = V.table(s, d, "events").select(F.col("event_id").alias("point_id"), F.col("user_id").alias("page_id"), ((F.col("event_id") * 37) % 720).alias("px"), ((F.col("event_id") * 53) % 910).alias("py"))
    return L.hit_test(pts, V.rects(s, d))


@query("select c config_id, page_id, count(*) n from r join (select unnest(range(8)) c) on w*h/655200.0::double >= c*0.01::double and w*h/655200.0::double <= 0.9 group by all", "r")
def j14_sweep(s, d):
    grid = s.range(8).select(F.col("id").alias("config_id"), (F.col("id") * 0.01).alias("min_pct"), F.lit(0.9).alias("max_pct"))
    return L.sweep(V.rects(s, d), grid, PAGE_W * PAGE_H)


@query("""n as (select page_id // 50 doc, page_id, rect_id from r)
select doc, page_id, rect_id, lead(page_id) over a next_page, lead(rect_id) over a next_panel, coalesce(lag(rect_id) over b, max(rect_id) over (partition by doc, page_id)) prev_panel
from n window a as (partition by doc order by page_id, rect_id), b as (partition by doc, page_id order by rect_id)""", "r")
def w5_panel_navigation(s, d):
    return L.panel_navigation(V.rects(s, d).select(F.floor(F.col("page_id") / 50).alias("doc"), "page_id", "rect_id"), "doc", "page_id", "rect_id")


@query("select page_id // 50 doc, page_id, coalesce(sum(922.0::double) over (partition by page_id // 50 order by page_id rows between unbounded preceding and 1 preceding), 0) y_offset from (select distinct page_id from r)", "r")
def w6_document_offsets(s, d):
    p = V.rects(s, d).select("page_id").distinct().withColumn("doc", F.floor(F.col("page_id") / 50)).withColumn("height_pt", F.lit(PAGE_H))
    return L.document_offsets(p).select("doc", "page_id", "y_offset")


@query("""n as (select page_id, x, case when x - lag(x) over (partition by page_id order by x) <= 28.8 then 0 else 1 end new, w from r),
i as (select page_id, x, w, sum(new) over (partition by page_id order by x) island from n)
select page_id, island::bigint island, cast(floor(sum(x*w)/sum(w)) as int) "at" from i group by all""", "r")
def a14_weighted_positions(s, d):
    chained = L.chain_islands(V.rects(s, d).select("page_id", "x", "w"), ["page_id"], "x", 0.04 * PAGE_W)
    return chained.groupBy("page_id", "island").agg(F.floor(F.sum(F.col("x") * F.col("w")) / F.sum("w")).cast("int").alias("at"))


@query("select page_id, route, count(*) n, sum(w*h)/655200.0::double coverage, avg(case when w*h/655200.0::double < 0.03 then 1.0::double else 0.0 end) small_ratio from r group by all", "r")
def a19_regression_metrics(s, d):
    size = F.col("w") * F.col("h")
    return V.rects(s, d).groupBy("page_id", "route").agg(F.count("*").alias("n"), (F.sum(size) / (PAGE_W * PAGE_H)).alias("coverage"), F.avg((size / (PAGE_W * PAGE_H) < 0.03).cast("double")).alias("small_ratio"))


@query("select case when w*h < 13104 then 'TOO SMALL' when w/h < 0.8 then 'LOW FILL' else 'KEEP' end status, count(*) n from r group by 1", "r")
def a21_filter_funnel(s, d):
    status = F.when(F.col("w") * F.col("h") < 0.02 * PAGE_W * PAGE_H, "TOO SMALL").when(F.col("w") / F.col("h") < 0.8, "LOW FILL").otherwise("KEEP")
    return V.rects(s, d).groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("select action, count(*) n, avg(value) mean_value, max(value) max_value from act group by 1", "act")
def a23_run_summary(s, d):
    return V.actions(s, d).groupBy("action").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"))


@query("select page_id, rect_id, w*h area from r qualify row_number() over (partition by page_id order by w*h desc, rect_id) <= 3", "r")
def k6_top_candidates(s, d):
    from pyspark.sql.window import Window

    ranked = V.rects(s, d).withColumn("area", F.col("w") * F.col("h")).withColumn("r", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("area"), "rect_id")))
    return ranked.filter("r <= 3").select("page_id", "rect_id", "area")


@query("select page_id, substr(md5('/lib/book_' || (page_id % 50) || '.pdf'), 1, 12) || '_page' || lpad(page_id::varchar, greatest(4, length(page_id::varchar))::int, '0') as store_key from (select distinct page_id from r)", "r")
def s8_correction_key(s, d):
    p = V.rects(s, d).select("page_id").distinct()
    return p.select("page_id", L.correction_key(F.concat(F.lit("/lib/book_"), (F.col("page_id") % 50).cast("string"), F.lit(".pdf")), F.col("page_id")).alias("store_key"))
