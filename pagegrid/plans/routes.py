"""Queries of the detection routes, templates, edits and audits, each with the SQL of its result.

The rasters have panels at known places (views PANELS_SQL and CELLS_SQL), so what a route must find
is written down in SQL without repeating how it looks for it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegrid.operators import arrays as A
from pagegrid.operators import editing as E
from pagegrid.operators import library as L
from pagegrid.operators import rects as R
from pagegrid.operators import routes as Q
from pagegrid.operators import templates as T
from pagegrid.plans.registry import SCORES, query
from pagegrid.sources import views as V
from pagegrid.sources.views import PAGE_H, PAGE_W, RASTER_H, RASTER_W

SIZE = (float(RASTER_W), float(RASTER_H))
NUMBERED = "row_number() over (partition by page_id order by y, x)"
COMPONENTS = f"c as (select page_id, {NUMBERED}::int rect_id, x, y, w, h, w*h/3072.0::double share from pan)"


def flat(s, d):
    """The pages with all ink in one tone, so that the only edges are the panels' rims."""
    return V.rasters(s, d).withColumn("gray", F.transform("gray", lambda v: F.when(v < 225, 40).otherwise(v).cast("smallint")))


def parts(s, d):
    return Q._page_share(A.component_boxes(V.rasters(s, d), lambda g: g < 225), V.rasters(s, d))


@query(f"select page_id, {NUMBERED}::int rect_id, x, y, w, h from cells", "cells")
def q1_gutter_route(s, d):
    return Q.gutter_route(V.rasters(s, d))


@query()
def q2_line_route(s, d):
    return Q.line_route(V.rasters(s, d))


@query(f"select page_id, ({NUMBERED} - 1)::int rect_id, x, y, w, h from pan", "pan")
def q3_adaptive_route(s, d):
    """On pages whose ink is one tone: the local threshold sees panels against their gutters."""
    return Q.adaptive_route(flat(s, d), block=101)


@query(f"select page_id, ({NUMBERED} - 1)::int rect_id, x+1 as x, y+1 as y, w-2 as w, h-2 as h from pan", "pan")
def q4_hierarchy_route(s, d):
    """On pages whose ink is one tone: edges lie on both sides of a panel's rim and enclose what is inside it."""
    return Q.hierarchy_route(flat(s, d))


@query(f"select page_id, {NUMBERED}::int rect_id, x, y, w, h from pan", "pan")
def q5_freeform_route(s, d):
    return Q.freeform_route(V.rasters(s, d))


ROUTE_BOXES = f"""r as (select page_id, {NUMBERED} rect_id, x, y, w, h, 'gutter' route from cells union all select page_id, {NUMBERED}, x, y, w, h, 'freeform' from pan)"""
FINAL = "round(case when route = 'gutter' and n between 3 and 12 then least(1.0::double, score + 0.06) else score end, 9)"


@query(
    ROUTE_BOXES + ", " + SCORES.replace("655200.0", "3072.0") + f", k as (select page_id, route from sc qualify row_number() over (partition by page_id order by {FINAL} desc, list_position(['gutter'], route) nulls first) = 1) "
    "select page_id, route, rect_id::int rect_id, x, y, w, h from r join k using (page_id, route)", "cells", "pan",
)
def q6_core_detection(s, d):
    """Two routes that find panels on these pages, each with boxes of its own."""
    return Q.core_detection(V.rasters(s, d), *SIZE, routes={"gutter": Q.gutter_route, "freeform": Q.freeform_route})


@query(f"""a as (select *, {NUMBERED} k from cells), b as (select *, {NUMBERED} k from pan)
select page_id, (k - 1)::int rect_id, (a.x+b.x)/2 as x, (a.y+b.y)/2 as y, (a.w+b.w)/2 as w, (a.h+b.h)/2 as h from a join b using (page_id, k)""", "cells", "pan")
def q7_multiscale_detection(s, d):
    """At twice the size the page's white edges are wide enough to be bands, so the scales differ there."""
    return Q.multiscale_detection(V.rasters(s, d), *SIZE, scales=(1.0, 2.0), routes={"gutter": Q.gutter_route})


@query(f"""u as (select page_id from act where action in ('upsert','revert') qualify row_number() over (partition by page_id order by ts desc, event_id desc) = 1 and action = 'upsert'),
p as (select page_id, x, y, w, h from cells where page_id not in (select page_id from u) union all select s_suppkey, 0.0::double, 0.0::double, 48.0::double, 64.0::double from supplier where s_suppkey in (select page_id from u))
select page_id, {NUMBERED}::int panel_no, x, y, w, h from p""", "cells", "act")
def q8_detect_pages(s, d):
    """The flagship: all routes, templates, filters, reading order, and the corrections that events left live."""
    pages = V.rasters(s, d)
    live = L.live_corrections(V.actions(s, d)).select("page_id").join(pages.select("page_id"), "page_id")
    whole = live.select("page_id", F.lit(1).alias("rect_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(SIZE[0]).alias("w"), F.lit(SIZE[1]).alias("h"))
    return Q.detect_pages(pages, *SIZE, corrected=whole)


@query(f"select page_id, {NUMBERED}::int rect_id, {NUMBERED}::int panel_no from pan", "pan")
def q9_border_mask(s, d):
    return Q.border_mask_route(V.rasters(s, d)).select("page_id", F.col("rect_id").cast("int").alias("rect_id"), F.col("panel_no").cast("int").alias("panel_no"))


@query("""i as (select page_id, round(avg((v < 225)::int), 9) ink from px group by page_id)
select page_id, ink, n, covered, smallest from i join (select page_id, count(*) n, round(sum(w*h/3072.0::double), 9) covered, round(min(w*h/3072.0::double), 9) smallest from cells group by page_id) using (page_id)""", "px", "cells")
def q10_layout_audit(s, d):
    return Q.layout_audit(V.rasters(s, d), Q.gutter_route(V.rasters(s, d)))


@query("select page_id, level, avg((v >= level)::int)::double as share from px cross join (values (60), (120), (225), (251)) t(level) group by all", "px")
def q11_threshold_audit(s, d):
    return A.level_shares(V.rasters(s, d), [60, 120, 225, 251])


@query("select page_id, scale::double as scale, count(*) n from cells cross join (values (1.0), (2.0)) t(scale) group by all", "cells")
def q12_scale_audit(s, d):
    return Q.scale_audit(V.rasters(s, d), Q.gutter_route, (1.0, 2.0))


@query(f"{COMPONENTS} select page_id, rect_id, x, y, w, h from c where share between 0.008 and 0.3", "pan")
def f11_hierarchy_filter(s, d):
    return Q.hierarchy_filter(parts(s, d), max_share=0.3).select("page_id", "rect_id", "x", "y", "w", "h")


@query(f"{COMPONENTS} select page_id, rect_id, x, y, w, h from c where share between 0.2 and 0.95", "pan")
def f12_region_filter(s, d):
    return Q.region_filter(parts(s, d), min_share=0.2).select("page_id", "rect_id", "x", "y", "w", "h")


@query(f"{COMPONENTS} select page_id, rect_id, x, y, w, h from c where not (h < 0.45*64 and w > 0.5*48)", "pan")
def f6_editorial_boxes(s, d):
    """Strips lower than 45 % and wider than half of the page; all panels are full of ink here."""
    return R.editorial_boxes(parts(s, d).withColumn("ink", F.col("fill")), V.rasters(s, d), low=0.45, wide=0.5).select("page_id", "rect_id", "x", "y", "w", "h")


@query()
def f14_u2_line_segments(s, d):
    return Q.union_segments(Q.line_segments(V.rasters(s, d)), Q.line_segments(V.rasters(s, d), share=0.96), gap=3.0)


@query("select page_id, rect_id, route, x, y, w, h from r where route in ('adaptive', 'gutter')", "r")
def f15_enabled_routes(s, d):
    """Routes that only select their candidates; two are switched off and no part of the plan."""
    pick = {n: (lambda rects, n=n: rects.filter(F.col("route") == n).drop("route")) for n in ("adaptive", "lsd", "hierarchy", "gutter")}
    on = Q.enabled_routes({"lsd": False, "hierarchy": False}, pick)
    return Q.union_routes(V.rects(s, d), on).select("page_id", "rect_id", "route", "x", "y", "w", "h")


EDGES = """e1 as (select page_id, y, x, v, lead(v) over w - lag(v) over w dx, lag(v) over w + 2*v + lead(v) over w sx from px window w as (partition by page_id, y order by x)),
e2 as (select page_id, y, x, v, coalesce(abs(lag(dx) over w + 2*dx + lead(dx) over w) + abs(lead(sx) over w - lag(sx) over w), 0) > 100 steep from e1 window w as (partition by page_id, x order by y)),
cut as (select unnest(range(20)) i), ty as (select i::int ty, i*64//20 a, (i+1)*64//20 b from cut), tx as (select i::int tx, i*48//20 a, (i+1)*48//20 b from cut),
tiles as (select page_id, ty, tx, avg((v < 200)::int)::double as content, avg(steep::int)::double as edge from e2 join ty on y >= ty.a and y < ty.b join tx on x >= tx.a and x < tx.b group by all)"""


@query(f"{EDGES} select page_id, ty, tx, round(content, 9) as content, round(edge, 9) as edge from tiles", "px")
def a9_content_and_edge_maps(s, d):
    return A.tile_maps(V.rasters(s, d)).withColumns({c: F.round(c, 9) for c in ("content", "edge")})


VALUES = ", ".join(f"('{n}', {k}, {len(b)}, {i}, {x}::double, {y}::double, {w}::double, {h}::double)" for k, (n, b) in enumerate(T.TEMPLATES) for i, (x, y, w, h) in enumerate(b))
TEMPLATES = f"""t as (select * from (values {VALUES}) t(template, catalogue_no, n, panel, x, y, w, h)),
tc as (select *, floor(x*20)::int x0, floor(y*20)::int y0, floor((x+w)*20)::int x1, floor((y+h)*20)::int y1 from t),
ce as (select template, catalogue_no, n, panel, ty, tx, ty < y1 and tx < x1 as inside, tx in (x0, least(x1, 19)) or ty in (y0, least(y1, 19)) as border from tc join (select i::int ty from cut) on ty between y0 and least(y1, 19) join (select i::int tx from cut) on tx between x0 and least(x1, 19)),
pm as (select page_id, template, catalogue_no, n, avg(c) m, stddev_pop(c) sd from (select page_id, template, catalogue_no, n, panel, avg(content) c from tiles join ce using (ty, tx) where inside group by all) group by all),
un as (select template, ty, tx, bool_or(inside) inside, bool_or(border) border from ce group by all),
sm as (select page_id, template, sum(content) filter (where inside) covered, count(*) filter (where inside) k, avg(edge) filter (where border) edges from tiles join un using (ty, tx) group by all),
ink as (select page_id, sum(content) ink from tiles group by all),
ts as (select page_id, template, catalogue_no, n, round(0.30*least(m/0.3, 1.0::double) + 0.30*greatest(0.0::double, 1 - (ink-covered)/(400-k)/0.15) + 0.25*least(edges/0.15, 1.0::double)
  + 0.15*case when n > 1 then greatest(0.0::double, 1 - case when m > 0 then sd/m else 1.0::double end) else 0.5::double end, 9) score from pm join sm using (page_id, template) join ink using (page_id))"""


@query(f"{EDGES}, {TEMPLATES} select page_id, template, round(score, 6) as score from ts", "px")
def j10_score_templates(s, d):
    return T.score_templates(A.tile_maps(V.rasters(s, d))).select("page_id", "template", F.round("score", 6).alias("score"))


@query(f"""{EDGES}, {TEMPLATES}, d as (select page_id, count(*) n0 from cells group by page_id),
k as (select page_id, template from ts join d using (page_id) where score >= 0.45 qualify row_number() over (partition by page_id order by score desc, abs(n - n0), catalogue_no) = 1)
select page_id, template, panel, x*720 as x, y*910 as y, w*720 as w, h*910 as h from k join t using (template)""", "px", "cells")
def k3_best_template(s, d):
    """The best template of each page, its panels in page points (P10)."""
    counts = Q.gutter_route(V.rasters(s, d)).groupBy("page_id").agg(F.count("*").alias("n"))
    best = T.with_best_template(counts, T.score_templates(A.tile_maps(V.rasters(s, d))))
    panels = T.template_to_page(T.templates_table(s), PAGE_W, PAGE_H).select("template", "panel", "x", "y", "w", "h")
    return best.select("page_id", "template").join(F.broadcast(panels), "template")


@query(f"""{EDGES}, {TEMPLATES}, w as (select page_id, rect_id, x, y, w, h from (select *, {NUMBERED} rect_id from cells) where rect_id = 1),
k as (select page_id, template from ts where score >= 0.5 qualify row_number() over (partition by page_id order by score desc, abs(n - 1), catalogue_no) = 1),
r as (select page_id, 'found' route, rect_id, x, y, w, h from w union all select 0, template, panel + 1, x*48, y*64, w*48, h*64 from t),
{SCORES.replace("655200.0", "3072.0")},
sw as (select k.page_id, template from k join sc a on a.page_id = k.page_id and a.route = 'found' join sc b on b.route = template where a.score < 0.60 and b.score > a.score)
select page_id, rect_id::int rect_id, x, y, w, h from w where page_id not in (select page_id from sw) union all select page_id, (panel + 1)::int, x*48, y*64, w*48, h*64 from sw join t using (template)""", "px", "cells")
def k4_refine_with_template(s, d):
    """Pages of which only the first cell was found: weak, so the template takes over."""
    first = Q.gutter_route(V.rasters(s, d)).filter("rect_id = 1")
    return T.refine(first, T.score_templates(A.tile_maps(V.rasters(s, d))), *SIZE).select("page_id", F.col("rect_id").cast("int").alias("rect_id"), "x", "y", "w", "h")


HANDLES = ["move", "delete", "new", "left", "top", "right", "bottom", "top_left", "top_right", "bottom_left", "bottom_right"]
STRUCT = "struct(x double, y double, w double, h double)"


@query(f"""ed as (select page_id, 1 + event_id % 4 rect_id, event_id seq, {HANDLES}[1 + event_id % 11] handle, (event_id % 300)::double x, (event_id % 400)::double y, ((event_id*7) % 80 - 40)::double dx, ((event_id*11) % 60 - 30)::double dy from act),
e as (select *, row_number() over (partition by page_id, rect_id order by seq) k from ed),
f(page_id, rect_id, k, b) as (
  select page_id, rect_id, 0, cast(case when r.x is null then null else {{'x': r.x, 'y': r.y, 'w': r.w, 'h': r.h}} end as {STRUCT}) from r full join (select distinct page_id, rect_id from ed) using (page_id, rect_id)
  union all select page_id, rect_id, k, case when handle = 'new' then case when least(abs(dx), abs(dy)) >= 20 then {{'x': least(x, x+dx), 'y': least(y, y+dy), 'w': abs(dx), 'h': abs(dy)}} end
    when handle = 'delete' or b is null then null when least(abs(nw), abs(nh)) >= 10 then {{'x': least(nx, nx+nw), 'y': least(ny, ny+nh), 'w': abs(nw), 'h': abs(nh)}} else b end
  from (select e.*, b, b.x + case when handle = 'move' or contains(handle, 'left') then dx else 0 end nx, b.y + case when handle = 'move' or contains(handle, 'top') then dy else 0 end ny,
      b.w - case when contains(handle, 'left') then dx else 0 end + case when contains(handle, 'right') then dx else 0 end nw,
      b.h - case when contains(handle, 'top') then dy else 0 end + case when contains(handle, 'bottom') then dy else 0 end nh
    from f join e on e.page_id = f.page_id and e.rect_id = f.rect_id and e.k = f.k + 1))
select page_id, rect_id, b.x x, b.y y, b.w w, b.h h from (select * from f qualify row_number() over (partition by page_id, rect_id order by k desc) = 1) where b is not null""", "r", "act")
def p13_apply_edits(s, d):
    i = F.col("event_id")
    handle = F.element_at(F.array(*[F.lit(h) for h in HANDLES]), (i % 11 + 1).cast("int"))
    edits = V.actions(s, d).select(
        "page_id", (i % 4 + 1).cast("int").alias("rect_id"), i.alias("seq"), handle.alias("handle"), (i % 300).cast("double").alias("x"), (i % 400).cast("double").alias("y"),
        ((i * 7) % 80 - 40).cast("double").alias("dx"), ((i * 11) % 60 - 30).cast("double").alias("dy"),
    )
    return E.apply_edits(V.rects(s, d), edits)


@query("""p as (select * from (values (0, 40, 20), (1, 35, 24), (2, 40, 16)) t(k, least, most))
select page_id, rect_id, x, y, w, h from r join p on page_id % 3 = k where least(w, h) >= least.least qualify row_number() over (partition by page_id order by w*h desc, rect_id) <= most""".replace("least.least", "p.least"), "r")
def s11_apply_preset(s, d):
    """Each page under one of the presets, by turns."""
    names = F.array(*[F.lit(p[0]) for p in E.PRESETS])
    rects = V.rects(s, d).withColumn("preset", F.element_at(names, (F.col("page_id") % 3 + 1).cast("int")))
    return E.apply_preset(rects, E.presets_table(s), "preset").select("page_id", "rect_id", "x", "y", "w", "h")
