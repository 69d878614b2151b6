"""Queries of detection on whole pages of two sizes, drawn from the supplier ids (views.drawn_pages).

Where the panels are is known, so the SQL states what must be found, chosen and decided on each kind of page.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegrid.operators import detection as D
from pagegrid.operators import edges as E
from pagegrid.operators import finders as N
from pagegrid.operators import library as L
from pagegrid.operators import pages as P
from pagegrid.operators.corrections import CorrectionStore
from pagegrid.plans.registry import query
from pagegrid.sources import views as V
from pagegrid.sources.files import shared_folder
from pagegrid.sources.views import MAGNIFIED, RASTER_H, RASTER_W

#: d: each page's kind, its number of panels less two, its magnification; dp: its panels in its own pixels.
DRAWN = (
    f"d as (select s_suppkey page_id, s_suppkey % 5 kind, s_suppkey % 3 k, {MAGNIFIED} + 2 * (s_suppkey % 2) m, {RASTER_W} * m w, {RASTER_H} * m h from supplier), "
    "dp as (select page_id, k, m, x*m x, y*m y, pan.w*m w, pan.h*m h from pan join d using (page_id) where kind < 3)"
)


def outlined(before: int) -> str:
    """Panels as the chosen route finds them: pages of two are best seen by their outlines, which lie outside of the panel."""
    return f"o as (select page_id, k, case k when 0 then x - {before} else x end::double x, case k when 0 then y - {before} else y end::double y, case k when 0 then w + {before} else w end::double w, case k when 0 then h + {before} else h end::double h from dp)"


WHOLE = "select page_id, 0.0::double x, 0.0::double y, w::double w, h::double h from d where kind = 3"


@query(f"""{DRAWN}, {outlined(1)}, a as (select * exclude (k) from o union all {WHOLE}),
s as (select page_id from act where action in ('upsert','revert') qualify row_number() over (partition by page_id order by ts desc, event_id desc) = 1 and action = 'upsert'),
p as (select * from a where page_id not in (select page_id from s) union all select page_id, 0.0::double, 0.0::double, w/2::double, h::double from d where page_id in (select page_id from s) and page_id % 3 > 0)
select page_id, row_number() over (partition by page_id order by y, x)::int panel_no, x, y, w, h from p""", "pan", "act")
def q8_detect_drawn(s, d):
    """Everything: routes, style, choice, templates, content filters, splash rules, saved corrections (some of them empty)."""
    pages = V.drawn_pages(s, d)
    live = L.live_corrections(V.actions(s, d)).select("page_id").join(pages.select("page_id", "width", "height"), "page_id")
    half = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), (F.col("width") / 2).alias("w"), F.col("height").cast("double").alias("h")))
    saved = live.select("page_id", F.when(F.col("page_id") % 3 > 0, half).otherwise(D.none()).alias("boxes"))
    return D.panels(D.detect(pages, saved))


@query(f"""{DRAWN} select page_id, case kind when 4 then 'modern' else 'classic_franco_belge' end as style, case when kind = 4 then '' when kind = 3 or k > 0 then 'gutter' else 'hierarchy' end route,
  case kind when 3 then 'whole' else 'same' end fate, case when kind < 3 then k + 2 end::int n_adaptive, case when kind < 3 then [9, 15, 21][k + 1] end::int n_lsd,
  case when kind < 3 then k + 2 end::int n_hierarchy, case when kind < 3 then k + 2 when kind = 3 then 1 end::int n_gutter, kind = 4 freeform_tried from d""", "pan")
def a18_decisions_drawn(s, d):
    """Why each page got its panels: style, route, how many boxes every route found, what the last rules did."""
    counts = [F.col("n_routes")[r].cast("int").alias(f"n_{r}") for r in D.ROUTES]
    return D.detect(V.drawn_pages(s, d)).select("page_id", "style", "route", "fate", *counts, "freeform_tried")


@query(f"""{DRAWN}, {outlined(2)}, a as (select page_id, case k when 0 then x + 0.5 else x end x, case k when 0 then y + 0.5 else y end y, case k when 0 then w - 0.5 else w end w, case k when 0 then h - 0.5 else h end h from o union all {WHOLE})
select page_id, row_number() over (partition by page_id order by y, x)::int panel_no, x, y, w, h from a""", "pan")
def q7_consensus_drawn(s, d):
    """At full and at half size, what both agree on; outlines at half size lie two pixels outside, so means lie at one and a half."""
    return D.panels(D.detect(V.drawn_pages(s, d), scales=(1.0, 0.5)))


SEGMENTS = f"""{DRAWN}, e as (select page_id, m, 'H' axis, unnest([y, y + h]) e, x lo, x + w hi from dp union all select page_id, m, 'V', unnest([x, x + w]), y, y + h from dp),
g as (select page_id, axis, e - 0.5 as position, min(lo) - 1 as lo, max(hi) + 1 as hi from e group by all)"""


@query(f"{SEGMENTS} select page_id, axis, position::double as position, lo::double lo, hi::double hi from g", "pan")
def u2_segments_drawn(s, d):
    """Voted lines and gradient lines, near ones joined: both ends of every panel, in the middle between ink and paper."""
    found = "segments array<struct<axis:int,position:double,lo:double,hi:double>>"
    look = lambda p: ([dict(zip(("axis", "position", "lo", "hi"), x, strict=True)) for x in N.segments(p)],)
    seen = P.with_columns(V.drawn_pages(s, d), look, found, drop_pixels=True)
    return seen.select("page_id", F.explode("segments").alias("l")).select("page_id", F.when(F.col("l.axis") == 0, "H").otherwise("V").alias("axis"), "l.position", "l.lo", "l.hi")


CELLS = f"""{SEGMENTS}, c as (select page_id, axis, trunc(position) p, case axis when 'H' then d.h else d.w end size from g join d using (page_id)),
q as (select page_id, axis, p, size from c where p > 0.03 * size and p < 0.97 * size union all select page_id, axis, unnest([0, size]), size from (select distinct page_id, axis, size from c)),
t as (select page_id, axis, size, p lo, lead(p) over (partition by page_id, axis order by p) hi from (select distinct * from q)),
u as (select page_id, axis, size, lo + case when lo > 0 then 2 else 0 end lo, hi - case when hi < size then 2 else 0 end hi from t where hi is not null),
lc as (select a.page_id, b.lo::double x, a.lo::double y, (b.hi - b.lo)::double w, (a.hi - a.lo)::double h from u a join u b on a.page_id = b.page_id and a.axis = 'H' and b.axis = 'V'
where a.hi - a.lo >= 0.03 * a.size and b.hi - b.lo >= 0.03 * b.size)"""


@query(f"{CELLS} select * from lc", "pan")
def q2_line_cells_drawn(s, d):
    """Cells of the grid that a page's lines span, two pixels inside them."""
    seen = D.with_evidence(V.drawn_pages(s, d), off=("adaptive", "hierarchy", "gutter"), facts=False).select("page_id", F.explode(F.get("seen", F.lit(0))["lsd"]).alias("b"))
    return seen.select("page_id", "b.x", "b.y", "b.w", "b.h")


@query(f"""{CELLS} select page_id, 'lsd' as route, x, y, w, h from lc
union all select page_id, unnest(['adaptive', 'gutter']), x::double, y::double, w::double, h::double from dp union all select page_id, 'hierarchy', x - 1, y - 1, w + 1, h + 1 from dp
union all select page_id, 'gutter', 0, 0, w, h - case m when 8 then 13 else 9 end from d where kind = 3""", "pan")
def u1_all_routes_drawn(s, d):
    """The boxes of all four routes on every page, before any is chosen; the soft picture's brightest rows look like a gutter."""
    seen = D.with_evidence(V.drawn_pages(s, d), facts=False).select("page_id", "width", "height", F.get("seen", F.lit(0)).alias("seen"))
    found = D.route_boxes(F.col("seen"), F.col("width"), F.col("height"))
    routes = P.settled(seen.select("page_id", F.array(*[F.struct(F.lit(r).alias("route"), found[r].alias("boxes")) for r in D.ROUTES]).alias("routes")))
    return routes.select("page_id", F.explode("routes").alias("r")).select("page_id", "r.route", F.explode("r.boxes").alias("b")).select("page_id", "route", "b.*")


@query("""m as (select pan.page_id, panel, avg(v) mean, stddev_pop(v) std, avg((v <= 200)::int) dark from pan join px on px.page_id = pan.page_id and px.x >= pan.x and px.x < pan.x + w and px.y >= pan.y and px.y < pan.y + h group by all)
select page_id, panel::int panel, round(mean, 6) mean, round(std, 6) std, round(dark, 6) dark from m""", "pan", "px")
def j6_box_measures(s, d):
    """Mean, deviation and dark share of every panel from the page's summed-area tables, without pixel rows."""
    rects = s.createDataFrame([(k, p, *map(float, b)) for k, p, b in V.PANELS], "k int, panel int, x double, y double, w double, h double")
    boxes = rects.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("panel", "x", "y", "w", "h"))), lambda r: F.struct(*[r[c] for c in "xywh"])).alias("boxes"))
    pages = V.rasters(s, d).withColumn("k", (F.col("page_id") % 3).cast("int")).join(F.broadcast(boxes), "k")
    white = F.struct(F.lit(255.0).alias("L"), F.lit(128.0).alias("A"), F.lit(128.0).alias("B"))
    seen = P.with_measures(pages.withColumn("ground", white), "boxes", "ground", drop_pixels=True)
    flat = seen.select("page_id", F.posexplode("measured").alias("i", "q"))
    return flat.select("page_id", (F.col("i") + 1).alias("panel"), *[F.round(f"q.{c}", 6).alias(c) for c in ("mean", "std", "dark")])


@query(f"""{DRAWN}, b as (select page_id, 2 * (w + h) - 4 as n from dp) select page_id, sum(n)::bigint n from b group by 1""", "pan")
def w14_voted_edges_drawn(s, d):
    """Thin edges with hysteresis: a line of one pixel around every panel."""
    look = lambda p: (int(E.voted_edges(p.gray).sum()),)
    return P.with_columns(V.drawn_pages(s, d), look, "n bigint", drop_pixels=True).filter("n > 0").select("page_id", "n")


@query("""l as (select * from act where action in ('upsert','revert') qualify row_number() over (partition by page_id order by ts desc, event_id desc) = 1)
select 'book.pdf' as path, page_id::int page, case when page_id % 3 > 0 then 1 else 0 end::int n, event_id seq from l where action = 'upsert'""", "act")
def s8_corrections_store(s, d):
    """Two writers, one for edits and one for deletions, and what the store holds in the end; some saved lists are empty."""
    acts = V.actions(s, d).filter(F.col("action").isin("upsert", "revert")).select(F.lit("book.pdf").alias("path"), F.col("page_id").cast("int").alias("page"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), "action")
    one = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(10.0).alias("w"), F.lit(20.0).alias("h")))
    store = CorrectionStore(s, shared_folder(s, "corrections"))
    store.delete(acts.filter("action = 'revert'").drop("action"))
    store.save(acts.filter("action = 'upsert'").drop("action").withColumn("panels", F.when(F.col("page") % 3 > 0, one).otherwise(D.none())))
    return store.load().select("path", "page", F.size("panels").alias("n"), "seq")
