"""Queries of the colour, mask, line, band and layout rules."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from pagegrid.functions import colour as C
from pagegrid.functions import geometry as G
from pagegrid.operators import arrays as A
from pagegrid.operators import layout as Y
from pagegrid.operators import library as L
from pagegrid.operators import masks as M
from pagegrid.operators import raster as P
from pagegrid.operators import rects as R
from pagegrid.operators import stencils as N
from pagegrid.plans.registry import (
    BANDS,
    PROFILE,
    SCORES,
    WITH,
    inter,
    iou_sql,
    merge_sql,
    query,
    union_sql,
    with_four_boxes,
)
from pagegrid.sources import views as V
from pagegrid.sources.views import PAGE_H, PAGE_W, RASTER_H, RASTER_W

WITH["rgb"] = f"select page_id, y, x, v r, (v*3 + x*5) % 256 g, (v*7 + y*3) % 256 b from ({V.PIXELS_SQL})"
WITH["seg"] = f"select page_id, rect_id seg_id, x x1, y y1, x + case scale_id when 1 then 2 else w end x2, y + case scale_id when 0 then 3 else h end y2 from ({V.RECTS_SQL})"
LAB_SQL = """lin as (select page_id, y, x, """ + ", ".join(f"case when {c}/255.0::double > 0.04045::double then pow(({c}/255.0::double + 0.055::double)/1.055::double, 2.4::double) else {c}/255.0::double/12.92::double end {c}" for c in "rgb") + """ from rgb),
xyz as (select page_id, y py, x px, (0.412453::double*r+0.357580::double*g+0.180423::double*b)/0.950456::double x, 0.212671::double*r+0.715160::double*g+0.072169::double*b y, (0.019334::double*r+0.119193::double*g+0.950227::double*b)/1.088754::double z from lin),
f as (select page_id, py, px, """ + ", ".join(f"case when {c} > 0.008856::double then pow({c}, 1.0::double/3) else 7.787::double*{c}+16.0::double/116 end {c}" for c in "xyz") + """ from xyz),
lab as (select page_id, py y, px x, round((116*y-16)*2.55::double, 6) "L", round(500*(x-y)+128, 6) "A", round(200*(y-z)+128, 6) "B" from f)"""
BG_SQL = """cnt as (select *, (x < 5 or x >= 43)::int + (y < 5 or y >= 59)::int n from lab),
bg as (select page_id, median("L") "bg_L", median("A") "bg_A", median("B") "bg_B" from (select * from cnt where n > 0 union all select * from cnt where n = 2) group by 1)"""
HV_SQL = """ang as (select *, degrees(atan2(abs(y2-y1), abs(x2-x1))) angle from seg),
hv as (select page_id, seg_id, 'H' axis, (y1+y2)/2 "position", least(x1,x2) lo, greatest(x1,x2) hi from ang where angle <= 8 union all
  select page_id, seg_id, 'V', (x1+x2)/2, least(y1,y2), greatest(y1,y2) from ang where angle > 8 and angle >= 82)"""
STYLE_COLS = ["rect_count", "small_ratio", "margin_ratio", "aspect_variance", "coverage", "gutter_count", "bg_tint_dist"]
FEATURES_SQL = """e as (select page_id, x e from r union select page_id, x+w from r),
st as (select page_id, e, lead(e) over (partition by page_id order by e) e2 from e),
i as (select st.page_id, e, e2, y, h, max(y+h) over (partition by st.page_id, e order by y, rect_id rows between unbounded preceding and 1 preceding) reach from st join r on r.page_id = st.page_id and x <= e and x+w >= e2 where e2 is not null),
cov as (select page_id, sum(greatest(0, y+h-greatest(y, coalesce(reach, y))) * (e2-e)) / 655200.0::double coverage from i group by page_id),
ft as (select page_id, count(*) rect_count, avg(case when w*h < 6552 then 1.0::double else 0.0 end) small_ratio, avg(case when (y < 54.6 or y+h > 855.4) and h < 109.2 then 1.0::double else 0.0 end) margin_ratio, round(var_pop(w/h) + 1e-9::double, 6) aspect_variance from r group by 1),
feat as (select *, page_id % 6 gutter_count, (page_id % 40)::double bg_tint_dist from ft join cov using (page_id)),
sty as (select *, (case when gutter_count >= 3 then 2.0::double else 0 end) + (case when small_ratio < 0.3::double then 1 else 0 end) + (case when rect_count between 3 and 12 then 1 else 0 end) + (case when bg_tint_dist < 18 then 1.5::double else 0 end) + (case when coverage >= 0.5::double then 0.5::double else 0 end) classic,
  (case when gutter_count <= 2 then 1.5::double else 0 end) + (case when small_ratio < 0.3::double then 0 else 1.5::double end) + (case when rect_count > 12 then 0.5::double else 0 end) + (case when bg_tint_dist < 18 then 0 else 2.0::double end) + (case when aspect_variance > 0.5::double then 0.5::double else 0 end) modern from feat)"""


def rgb(s, d):
    return V.pixels(s, d).select("page_id", "y", "x", F.col("v").alias("r"), ((F.col("v") * 3 + F.col("x") * 5) % 256).alias("g"), ((F.col("v") * 7 + F.col("y") * 3) % 256).alias("b"))


def segments(s, d):
    r = V.rects(s, d)
    return r.select("page_id", F.col("rect_id").alias("seg_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.when(F.col("scale_id") == 1, 2.0).otherwise(F.col("w"))).alias("x2"), (F.col("y") + F.when(F.col("scale_id") == 0, 3.0).otherwise(F.col("h"))).alias("y2"))


def features(s, d):
    # two aspects often have a variance that ends in a 5 at the seventh digit: the shift settles which way it rounds
    f = Y.page_features(V.rects(s, d), PAGE_W, PAGE_H).withColumn("aspect_variance", F.round(F.col("aspect_variance") + 1e-9, 6))
    return f.withColumn("gutter_count", F.col("page_id") % 6).withColumn("bg_tint_dist", (F.col("page_id") % 40).cast("double"))


def prof(s, d):
    return V.profiles(s, d)


def profile_bands(s, d, share):
    p = prof(s, d).withColumnRenamed("v", "mean_v")
    return P.bands(p.join(P.profile_threshold(p, share), "page_id").filter("mean_v >= threshold"))


def bands_sql(n: str, share: float) -> str:
    return f"""th{n} as (select page_id, median(v) + {share}::double*(max(v)-median(v)) t from prof group by 1 having max(v)-median(v) >= 30),
g{n} as (select page_id, idx, case when idx - lag(idx) over (partition by page_id order by idx) <= 5 then 0 else 1 end new from prof join th{n} using (page_id) where v >= t),
isl_{n} as (select page_id, idx, sum(new) over (partition by page_id order by idx) k from g{n}),
b{n} as (select page_id, min(idx) lo, max(idx) hi from isl_{n} group by page_id, k having max(idx)-min(idx)+1 >= 3)"""


@query("select page_id, y, x, round(r*0.299::double + g*0.587::double + b*0.114::double, 6) gray from rgb", "rgb")
def p2_to_gray(s, d):
    return rgb(s, d).select("page_id", "y", "x", F.round(G.gray(F.col("r"), F.col("g"), F.col("b")), 6).alias("gray"))


@query(f'{LAB_SQL} select page_id, y, x, "L" l8, "A" a8, "B" b8 from lab', "rgb")
def p3_to_lab(s, d):
    lab = N.lab_pixels(V.tinted_rasters(s, d))
    return lab.select("page_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("L").alias("l8"), F.col("A").alias("a8"), F.col("B").alias("b8"))


@query("""m as (select *, greatest(r,g,b) hi, (greatest(r,g,b)-least(r,g,b))::double sp from rgb),
t as (select *, case when sp = 0 then 0 when hi = r then 60.0::double*(g-b)/sp when hi = g then 120+60.0::double*(b-r)/sp else 240+60.0::double*(r-g)/sp end t from m)
select page_id, count(*) n from t where (case when t < 0 then t+360 else t end)/2 between 35 and 85 and (case when hi = 0 then 0 else sp*255/hi end) between 40 and 255 and hi between 40 and 255 group by 1""", "rgb")
def p4_hsv_mask(s, d):
    inside = C.in_range((F.col("H"), F.col("S"), F.col("V")), (35, 40, 40), (85, 255, 255))
    return C.with_hsv(rgb(s, d)).groupBy("page_id").agg(F.count_if(inside).alias("n")).filter("n > 0")


@query(f'{LAB_SQL}, {BG_SQL} select page_id, "bg_L" bg_l, "bg_A" bg_a, "bg_B" bg_b from bg', "rgb")
def a10_border_background(s, d):
    out = N.border_background(V.tinted_rasters(s, d))
    return out.select("page_id", F.col("bg_L").alias("bg_l"), F.col("bg_A").alias("bg_a"), F.col("bg_B").alias("bg_b"))


@query(f'{LAB_SQL}, {BG_SQL} select page_id, count(*) filter (sqrt(pow("L"-"bg_L",2)+pow("A"-"bg_A",2)+pow("B"-"bg_B",2)) < 60) n_background, count(*) n from lab join bg using (page_id) group by 1', "rgb")
def p5_background_mask(s, d):
    return N.background_counts(V.tinted_rasters(s, d), 60.0)


@query("""a as (select *, sum(v) over w s, count(*) over w n from px window w as (partition by page_id, y order by x rows between 5 preceding and 5 following)),
c as (select page_id, v, sum(s) over w s, sum(n) over w n from a window w as (partition by page_id, x order by y rows between 5 preceding and 5 following))
select page_id, count(*) n_dark from c where v*n <= s - 5*n group by 1""", "px")
def w9_local_threshold(s, d):
    return counted(s, d, lambda g: A.local_dark(g, 11, 5.0))


def counted(s, d, mask):
    """(page_id, n_dark): pixels of each page's mask."""
    return A.per_page(V.rasters(s, d), lambda g: [(n,)] if (n := int(mask(g).sum())) else [], "page_id long, n_dark long")


GAUSS = "(case {d} " + " ".join(f"when {i} then {math.exp(-i * i / (2 * 2.0**2))!r}" for i in range(6)) + " end::double)"


@query(f"""c as (select a.page_id, a.y, a.x, any_value(a.v) v, sum({GAUSS.format(d="abs(o)")}*b.v) / sum({GAUSS.format(d="abs(o)")}) m from px a cross join (select unnest(range(-5, 6)) o)
  join px b on a.page_id = b.page_id and a.y = b.y and b.x = least(47, greatest(0, a.x + o)) group by all),
g as (select a.page_id, a.y, a.x, any_value(a.v) v, sum({GAUSS.format(d="abs(o)")}*b.m) / sum({GAUSS.format(d="abs(o)")}) m from c a cross join (select unnest(range(-5, 6)) o)
  join c b on a.page_id = b.page_id and a.x = b.x and b.y = least(63, greatest(0, a.y + o)) group by all)
select page_id, count(*) n_dark from g where v <= m - 5 group by 1""", "px")
def w9_gaussian_threshold(s, d):
    """Means by Gaussian weights with edges repeated; a block of 11 has a spread of 2."""
    return counted(s, d, lambda g: N.locally_dark(g, 11, 5.0, gaussian=True))


@query("""h as (select page_id, (y*8)//64 ty, (x*8)//48 tx, v, count(*) n from px group by all),
t as (select *, sum(n) over (partition by page_id, ty, tx) total from h),
c as (select *, least(n::double, greatest(1.0::double, 2.0::double*total/256)) c from t),
o as (select *, sum(c) over (partition by page_id, ty, tx order by v) + (v+1)*(total - sum(c) over (partition by page_id, ty, tx))/256 cdf from c)
select px.page_id, y, x, round(cdf*255/total, 6) v from px join o on o.page_id = px.page_id and ty = (y*8)//64 and tx = (x*8)//48 and o.v = px.v""", "px")
def w13_tile_equalise(s, d):
    plane = N.with_plane(V.rasters(s, d), lambda g: N.equalised(g, blend=False))
    return N.as_pixels(plane).withColumn("v", F.round("v", 6))


HAT = "[" + ", ".join(str(row) for row in M.smoothing_weights(11, 3).tolist()) + "]::double[][]"


@query(f"""l as (select page_id, list(v::double order by idx) l, count(*) n from prof group by 1),
i as (select page_id, l, idx, greatest(0, least(idx - 5, n - 11)) a from l join prof using (page_id))
select page_id, idx, round(list_dot_product(({HAT})[idx - a + 1], l[a + 1:a + 11]), 6) smooth from i""", "prof")
def w11_smooth_profile(s, d):
    return M.smooth_profile(prof(s, d), 11, 3)


PEAKS_SQL = """pk as (select page_id, idx, v from (select page_id, idx, v, quantile_cont(v, 0.85) over (partition by page_id) p from prof qualify v > lag(v) over (partition by page_id order by idx) and v > lead(v) over (partition by page_id order by idx)) where v >= p)"""


@query(f"{PEAKS_SQL} select page_id, idx, v, row_number() over (partition by page_id order by idx) peak_no from (select * from pk qualify row_number() over (partition by page_id order by v desc, idx) <= 10)", "prof")
def k5_top_peaks(s, d):
    return M.top_peaks(M.local_peaks(prof(s, d)))


@query("""n as (select page_id, idx, v, lag(v) over w a, lead(v) over w b from prof window w as (partition by page_id order by idx)),
c as (select n.* from n join (select page_id, quantile_cont(v, 0.85) p from prof group by page_id) using (page_id) where v > a and v > b and v >= p),
o as (select page_id, idx, v, row_number() over (partition by page_id order by v desc, idx) k from c),
f(page_id, k, kept) as (select page_id, k, [idx] from o where k = 1
  union all select o.page_id, o.k, case when len(list_filter(kept, lambda i: abs(i - o.idx) < 5)) > 0 then kept else list_append(kept, o.idx) end from f join o on o.page_id = f.page_id and o.k = f.k + 1),
z as (select page_id, unnest(kept) idx from (select * from f qualify row_number() over (partition by page_id order by k desc) = 1)),
pk as (select z.page_id, z.idx, v from z join prof using (page_id, idx)),
wl as (select p.page_id, p.idx, p.v, max(q.idx) filter (where q.idx < p.idx and q.v > p.v) l, min(q.idx) filter (where q.idx > p.idx and q.v > p.v) r from pk p join prof q on p.page_id = q.page_id group by all),
pr as (select w.page_id, w.idx, w.v, w.v - greatest(min(q.v) filter (where q.idx <= w.idx and (l is null or q.idx > l)), min(q.v) filter (where q.idx >= w.idx and (r is null or q.idx < r))) prominence
  from wl w join prof q on w.page_id = q.page_id group by w.page_id, w.idx, w.v)
select page_id, idx::int idx, v::double v, prominence::double prominence from pr where prominence >= 4""", "prof")
def w12_find_peaks(s, d):
    p = prof(s, d)
    return M.prominent(M.space_peaks(M.local_peaks(p), 5), p, 4.0)


@query("""g as (select page_id, idx, idx - row_number() over (partition by page_id order by idx) k from prof where v >= 240),
b as (select page_id, min(idx) lo, max(idx) hi from g group by page_id, k)
select page_id, case when hi-lo < 2 then greatest(0, lo - (3-(hi-lo))//2) else lo end::bigint lo, case when hi-lo < 2 then least(hi + (3-(hi-lo))//2, 4096) else hi end::bigint hi from b""", "prof")
def w2_peak_lines(s, d):
    return Y.peak_lines(prof(s, d).filter("v >= 240").select("page_id", "idx"))


@query("""q as (select page_id, idx, v, quantile_cont(v, 0.85) over (partition by page_id) p from prof),
g as (select page_id, case when idx - lag(idx) over (partition by page_id order by idx) <= 3 then 0 else 1 end new from q where v > p)
select page_id, sum(new)::bigint gutter_count from g group by 1""", "prof")
def a7_gutter_count(s, d):
    return Y.gutter_count(prof(s, d))


@query(f"""{bands_sql('o', 0.8)}, {bands_sql('n', 0.55)}
select page_id, lo, hi from bo union all select page_id, lo, hi from bn where not exists (select 1 from bo where bo.page_id = bn.page_id and abs((bo.lo+bo.hi)/2 - (bn.lo+bn.hi)/2) < 15)""", "prof")
def j9_merge_bands(s, d):
    return Y.merge_bands(profile_bands(s, d, 0.8), profile_bands(s, d, 0.55))


@query(f"{bands_sql('n', 0.65)} select page_id, lo, hi from bn where lo > 5 and hi < 58", "prof")
def f16_margin_bands(s, d):
    return profile_bands(s, d, 0.65).filter("lo > 2 + 3 and hi < 63 - 5")


@query(f"{bands_sql('n', 0.65)} select page_id, min(lo) lo, m best from (select page_id, lo, avg(v) a, max(avg(v)) over (partition by page_id) m from bn join prof using (page_id) where idx between lo and hi group by page_id, lo) where a = m group by page_id, m", "prof")
def k8_best_sub_band(s, d):
    b = profile_bands(s, d, 0.65).join(prof(s, d), "page_id").filter("idx between lo and hi").groupBy("page_id", "lo").agg(F.avg("v").alias("a"))
    return b.groupBy("page_id").agg(F.max(F.struct("a", (-F.col("lo")).alias("m"))).alias("t")).select("page_id", (-F.col("t.m")).alias("lo"), F.col("t.a").alias("best"))


@query(f"{PROFILE}, {BANDS.format(p='pr')} select b.page_id, lo, hi, avg(case when v >= 225 then 1.0::double else 0.0 end) as cover from bpr b join px on px.page_id = b.page_id and y between lo and hi where hi-lo+1 >= 2 group by all having avg(case when v >= 225 then 1.0::double else 0.0 end) >= 0.45", "px")
def f10_validate_bands(s, d):
    return N.valid_bands(V.rasters(s, d), lambda g: g >= 225)


@query("select page_id, y, x from (select a.page_id, a.y, a.x, sum(b.v*(b.x-a.x)*(2-abs(b.y-a.y))) gx, sum(b.v*(b.y-a.y)*(2-abs(b.x-a.x))) gy, count(*) c from px a join px b on a.page_id=b.page_id and b.x between a.x-1 and a.x+1 and b.y between a.y-1 and a.y+1 group by all) where c = 9 and abs(gx)+abs(gy) > 600", "px")
def w14_edge_mask(s, d):
    return N.as_pixels(N.with_plane(V.rasters(s, d), A.gradient, kind="bigint")).filter("v > 600").select("page_id", "y", "x")


@query("select page_id, bool_and(bright and even) both_all, count(*) filter (bright and even) n_and, count(*) filter (bright or even) n_or from (select page_id, v >= 225 bright, v % 2 = 0 as even from px) group by 1", "px")
def u3_mask_and_or(s, d):
    m = V.pixels(s, d).select("page_id", (F.col("v") >= 225).alias("bright"), (F.col("v") % 2 == 0).alias("even"))
    return m.groupBy("page_id").agg(F.every(F.col("bright") & F.col("even")).alias("both_all"), F.count_if(F.col("bright") & F.col("even")).alias("n_and"), F.count_if(F.col("bright") | F.col("even")).alias("n_or"))


@query("select page_id, case page_id % 3 when 0 then 2 when 1 then 3 else 4 end::bigint n, count(*) filter (v < 225) n_pixels from px group by 1", "px")
def g1_grid_components(s, d):
    found = A.numbered_components(V.rasters(s, d), lambda g: g < 225)
    return found.groupBy("page_id").agg(F.count("*").alias("n"), F.sum("n_pixels").alias("n_pixels"))


@query("select page_id, 1::bigint component, 2::bigint x, 31::bigint y, 44::bigint w, 3::bigint h, count(*) n_pixels from px where page_id % 3 = 0 and v >= 225 and x between 2 and 45 and y between 2 and 61 group by 1", "px")
def f9_stripe_filter(s, d):
    inner = lambda g: np.pad(g[2:62, 2:46] >= 225, 2)
    return M.stripe_filter(A.numbered_components(V.rasters(s, d), inner), RASTER_W)


@query("""ct as (select a.page_id, a.rect_id, b.rect_id o, b.w*b.h s from r a join r b on a.page_id = b.page_id and a.rect_id <> b.rect_id and a.x >= b.x and a.y >= b.y and a.x+a.w <= b.x+b.w and a.y+a.h <= b.y+b.h and a.w*a.h < b.w*b.h),
up as (select page_id, rect_id, least(count(*), 20) depth, (list(o order by s, o))[1] parent from ct group by all)
select page_id, rect_id, coalesce(depth, 0) depth, parent, (select count(*) from up u where u.page_id = r.page_id and u.parent = r.rect_id) children from r left join up using (page_id, rect_id)""", "r")
def g2_component_nesting(s, d):
    return Y.component_nesting(V.rects(s, d))


@query("""sc as (select page_id, rect_id, w, h, round(2*((rect_id*13)%10)/10.0::double + 1.5::double*((page_id*7+rect_id)%10)/10.0::double + (case when w*h/655200.0::double between 0.05 and 0.35 then 2 when w*h/655200.0::double between 0.02 and 0.5 then 1 else 0 end)
  + (case when page_id % 2 = 0 then 1 else 0 end) + (case when rect_id*3 between 2 and 50 then 0.5::double when rect_id*3 > 100 then -0.5::double else 0 end) + (case when scale_id*3 <= 2 then 0.5::double when scale_id*3 > 4 then -0.5::double else 0 end) + (case when w/h between 0.3 and 3 then 0.5::double else 0 end), 9) score from r)
select page_id, rect_id, score from sc where score > 2 qualify row_number() over (partition by page_id order by score desc, rect_id) <= 16""", "r")
def a16_candidate_score(s, d):
    r = V.rects(s, d).withColumn("rectangularity", (F.col("rect_id") * 13 % 10) / 10.0).withColumn("fill", ((F.col("page_id") * 7 + F.col("rect_id")) % 10) / 10.0)
    r = r.withColumn("has_content", F.col("page_id") % 2 == 0).withColumn("children", F.col("rect_id") * 3).withColumn("depth", F.col("scale_id") * 3)
    return Y.candidate_score(r, PAGE_W * PAGE_H).select("page_id", "rect_id", "score")


@query("select page_id, seg_id, round(sqrt(pow(x2-x1,2)+pow(y2-y1,2)), 6) length, round(degrees(atan2(abs(y2-y1), abs(x2-x1))), 6) angle, case when degrees(atan2(abs(y2-y1), abs(x2-x1))) < 15 then 'H' when degrees(atan2(abs(y2-y1), abs(x2-x1))) > 75 then 'V' end axis from seg", "seg")
def p9_make_segment(s, d):
    return Y.make_segments(segments(s, d)).select("page_id", "seg_id", F.round("length", 6).alias("length"), F.round("angle", 6).alias("angle"), "axis")


@query(f'{HV_SQL} select page_id, seg_id, axis, "position", lo, hi from hv', "seg")
def f7_hv_segments(s, d):
    return Y.hv_segments(segments(s, d)).drop("length")


@query(f"""{HV_SQL}, n as (select *, case when "position" - lag("position") over (partition by page_id, axis order by "position") <= 8 then 0 else 1 end new from hv),
k as (select *, sum(new) over (partition by page_id, axis order by "position") island from n)
select page_id, axis, island::bigint island, avg("position") "position", min(lo) lo, max(hi) hi, count(*) n from k group by page_id, axis, island""", "seg")
def a15_merge_parallel(s, d):
    return Y.merge_parallel(Y.hv_segments(segments(s, d)), 8.0)


@query(f"""{HV_SQL} select page_id, seg_id, axis, "position" from hv where ("position" > 0.03::double*case axis when 'H' then 910 else 720 end) and ("position" < 0.97::double*case axis when 'H' then 910 else 720 end)""", "seg")
def f8_interior_positions(s, d):
    return Y.interior_positions(Y.hv_segments(segments(s, d)), PAGE_W, PAGE_H).select("page_id", "seg_id", "axis", "position")


@query("select page_id, rect_id from r where w*h/655200.0::double between 0.004::double and 0.95::double and ((rect_id*37+scale_id*11) % 100)/100.0::double >= 0.8::double*0.55::double and least(w,h) >= 22", "r")
def f4_candidate_filter(s, d):
    r = V.rects(s, d).withColumn("fill", ((F.col("rect_id") * 37 + F.col("scale_id") * 11) % 100) / 100.0)
    return Y.candidate_filter(r, PAGE_W, PAGE_H).select("page_id", "rect_id")


@query("""m as (select *, ((rect_id*17+page_id) % 100)/200.0::double content, (page_id*7+rect_id) % 30 sd, median(w) over (partition by page_id) mw, median(h) over (partition by page_id) mh from r)
select page_id, rect_id from m where not (content < 0.08::double and sd < 12) and not ((h < 0.12::double*mh or w < 0.12::double*mw) and content < 0.18::double)""", "r")
def a24_content_filter(s, d):
    r = V.rects(s, d).withColumn("content", ((F.col("rect_id") * 17 + F.col("page_id")) % 100) / 200.0).withColumn("gray_std", (F.col("page_id") * 7 + F.col("rect_id")) % 30)
    return Y.content_filter(r).select("page_id", "rect_id")


@query(f"{FEATURES_SQL} select {', '.join(['page_id', *STYLE_COLS])} from feat", "r")
def a5_page_features(s, d):
    return features(s, d).select("page_id", *STYLE_COLS)


@query(f"{FEATURES_SQL} select page_id, classic, modern, case when classic >= modern then 'classic_franco_belge' else 'modern' end style from sty", "r")
def a8_classify_style(s, d):
    return Y.style_scores(features(s, d)).select("page_id", "classic", "modern", "style")


@query(f"{FEATURES_SQL} select page_id, rect_count/12.0::double f1, small_ratio f2, margin_ratio f3, gutter_count/10.0::double f4, least(bg_tint_dist/50.0::double, 1) f5, coverage f6, least(aspect_variance, 1) f7 from feat", "r")
def p11_feature_vector(s, d):
    return Y.feature_vector(features(s, d)).select("page_id", *[F.col("features")[i].alias(f"f{i + 1}") for i in range(7)])


@query("""k as (select page_id, (page_id % 100)/100.0::double non_bg, case when page_id % 2 = 0 then 'modern' else 'classic' end mode, (page_id % 3 = 0)::int::bigint gc, (page_id % 5 = 0)::int::bigint hc from (select distinct page_id from r)),
cur as (select * from r where w*h > 30000), nn as (select page_id, count(*) n, max(w*h) big, sum(w*h) al from cur group by 1), ob as (select page_id, count(*) nb from r group by 1),
j as (select k.*, coalesce(n, 0) n, coalesce(big, 0) big, coalesce(al, 0) al, nb from k left join nn using (page_id) join ob using (page_id)),
f as (select page_id, case when n = 0 and mode = 'modern' and nb >= 2 then 'back' when (n = 0 and non_bg > 0.35::double) or (n = 1 and big/655200.0::double < 0.6::double and non_bg > 0.35::double and not (mode = 'modern' and nb >= 2)) or (n > 0 and gc = 0 and hc = 0 and big/655200.0::double > 0.4::double and (al-big)/655200.0::double < 0.2::double) then 'whole' else 'same' end fate from j)
select page_id, rect_id, x, y, w, h from cur where page_id in (select page_id from f where fate = 'same') union all select page_id, rect_id, x, y, w, h from r where page_id in (select page_id from f where fate = 'back')
union all select page_id, 1, 0, 0, 720, 910 from f where fate = 'whole'""", "r")
def a17_splash_fallback(s, d):
    r = V.rects(s, d)
    p = r.select("page_id").distinct().withColumn("non_bg", (F.col("page_id") % 100) / 100.0).withColumn("mode", F.when(F.col("page_id") % 2 == 0, "modern").otherwise("classic"))
    p = p.withColumn("gutter_count", (F.col("page_id") % 3 == 0).cast("long")).withColumn("hierarchy_count", (F.col("page_id") % 5 == 0).cast("long"))
    return Y.splash_fallback(r.filter("w * h > 30000"), r, p, PAGE_W, PAGE_H).withColumn("rect_id", F.col("rect_id").cast("long"))


@query("select page_id, string_agg(route || ':' || n, ',' order by route) routes from (select page_id, route, count(*) n from r group by all) group by 1", "r")
def a18_decision_summary(s, d):
    n = V.rects(s, d).groupBy("page_id", "route").agg(F.count("*").alias("n"))
    return n.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("route", F.lit(":"), F.col("n").cast("string")))), ",").alias("routes"))


CONFIG_ERRORS = """n as (select c config_id, page_id, count(*) filter (w*h/655200.0::double >= c*0.01::double and w*h/655200.0::double <= 0.9) n from r cross join (select unnest(range(8)) c) group by all),
err as (select config_id, sum(abs(n - (2 + page_id % 3)))::bigint error from n group by 1)"""


def config_errors(s, d):
    r = V.rects(s, d)
    grid = s.range(8).select(F.col("id").alias("config_id"), (F.col("id") * 0.01).alias("min_pct"), F.lit(0.9).alias("max_pct"))
    every = r.select("page_id").distinct().join(F.broadcast(grid.select("config_id")), F.lit(True))
    n = every.join(L.sweep(r, grid, PAGE_W * PAGE_H), ["config_id", "page_id"], "left").fillna(0, ["n"])
    return n.groupBy("config_id").agg(F.sum(F.abs(F.col("n") - (2 + F.col("page_id") % 3))).alias("error"))


@query(f"{CONFIG_ERRORS} select config_id, error from err", "r")
def a20_count_error(s, d):
    return config_errors(s, d)


@query(f"{CONFIG_ERRORS} select config_id, error from err order by error, config_id limit 5", "r")
def k7_best_configs(s, d):
    return config_errors(s, d).orderBy("error", "config_id").limit(5)


@query("select c.page_id, c.rect_id, sum(v)/500.0::double mean_v, sum(case when v < 128 then 1 else 0 end)/500.0::double dark from (select s_suppkey page_id, k rect_id, (s_suppkey*k)%20 x, (s_suppkey+7*k)%30 y from supplier cross join (select unnest(range(1,5)) k)) c join px on px.page_id = c.page_id and px.x between c.x and c.x+19 and px.y between c.y and c.y+24 group by all", "px")
def a22_panel_ink_report(s, d):
    found = N.with_totals(with_four_boxes(V.rasters(s, d)), "boxes", {"light": lambda p: p.gray, "dark": lambda p: p.gray < 128})
    flat = found.select("page_id", F.posexplode("totals").alias("i", "t"))
    return flat.select("page_id", (F.col("i") + 1).alias("rect_id"), (F.col("t.light") / 500.0).alias("mean_v"), (F.col("t.dark") / 500.0).alias("dark"))


CLEAN_SQL = "cl as (select * from r where not (h < 91 and (y < 54.6 or y+h > 855.4))), rf as (select * from cl union all select * from r where page_id not in (select page_id from cl))"


@query(f"{CLEAN_SQL}, {SCORES.replace('from r ', 'from rf ').replace('join r ', 'join rf ')} select page_id, route, n, score from sc qualify row_number() over (partition by page_id order by score desc, list_position(['adaptive','lsd','hierarchy','gutter'], route)) = 1", "r")
def k2_select_route_modern(s, d):
    return Y.select_route_modern(V.rects(s, d), PAGE_W, PAGE_H)


@query("select page_id, scale_id, n from (select page_id, scale_id, count(*) n from r group by all) qualify row_number() over (partition by page_id order by n desc, scale_id) = 1", "r")
def k9_fallback_scale(s, d):
    return Y.fallback_scale(V.rects(s, d))


@query("""n as (select coalesce(a.page_id, b.page_id) page_id, coalesce(f, 0) f, coalesce(hh, 0) hh from (select page_id, count(*) f from r where route = 'gutter' group by 1) a full join (select page_id, count(*) hh from r where route = 'lsd' group by 1) b on a.page_id = b.page_id)
select page_id, rect_id, route from r join n using (page_id) where route = case when f = 0 or (hh > f and hh <= 2*f+3) then 'lsd' else 'gutter' end""", "r")
def k10_choose_grid(s, d):
    r = V.rects(s, d).select("page_id", "rect_id", "route")
    return Y.choose_grid(r.filter("route = 'gutter'"), r.filter("route = 'lsd'"))


@query("select page_id, 'gutter' route, rect_id from r where route = 'gutter' union all select page_id, 'lsd', rect_id from r where route = 'lsd'", "r")
def u1_union_routes(s, d):
    r = V.rects(s, d).select("page_id", "rect_id", "route")
    found = {name: r.filter(F.col("route") == name).drop("route") for name in ("gutter", "lsd")}
    tagged = [df.withColumn("route", F.lit(name)) for name, df in found.items()]
    return tagged[0].unionByName(tagged[1])


@query("select distinct page_id from r where page_id % 3 <> 0 and page_id % 5 <> 0", "r")
def u4_minus_known(s, d):
    p = V.rects(s, d).select("page_id").distinct()
    return p.join(p.filter("page_id % 3 = 0"), "page_id", "left_anti").join(p.filter("page_id % 5 = 0"), "page_id", "left_anti")


def _viewport_sql(zoom: str, x: str, y: str) -> str:
    return f"""z as (select *, least(16.0::double, greatest(0.05::double, {zoom})) z from r)
select page_id, rect_id, round(z, 9) zoom, round_even(greatest(0.0::double, greatest(0.0::double, (1280-720*z)/2) + ({x})*z), 0)::bigint scroll_x, round_even(greatest(0.0::double, greatest(0.0::double, (800-910*z)/2) + ({y})*z), 0)::bigint scroll_y from z"""


@query(_viewport_sql("least(1280.0::double/w, 800.0::double/h)*0.96::double", "x - 12/z", "y - 12/z"), "r")
def p12_viewport_fit(s, d):
    return Y.viewport_plan(V.rects(s, d), 1280.0, 800.0, "fit", PAGE_W, PAGE_H)


@query(_viewport_sql("greatest(1280.0::double/w, 800.0::double/h)*1.01::double", "x + greatest(0, w-1280/z)", "y + greatest(0, h-800/z)"), "r")
def p12_viewport_fill(s, d):
    return Y.viewport_plan(V.rects(s, d), 1280.0, 800.0, "fill", PAGE_W, PAGE_H)


@query("""select page_id, sha256('{"route":"' || route || '","n":' || n || '}') config_hash from (select page_id, route, count(*) n from r group by all)""", "r")
def p14_config_hash(s, d):
    n = V.rects(s, d).groupBy("page_id", "route").agg(F.count("*").alias("n"))
    return n.select("page_id", Y.config_hash("route", "n").alias("config_hash"))


def _order_sql(at: str, tol: str, across: str) -> str:
    return f"""t as (select *, {at} at_, {tol} tol, {across} across from r), o as (select *, row_number() over (partition by page_id order by at_, across, rect_id) k from t),
f(page_id, k, anchor, tol, line) as (select page_id, k, at_, tol, 1 from o where k = 1
  union all select o.page_id, o.k, case when abs(o.at_ - anchor) < f.tol then anchor else o.at_ end, case when abs(o.at_ - anchor) < f.tol then f.tol else o.tol end, case when abs(o.at_ - anchor) < f.tol then line else line + 1 end from f join o on o.page_id = f.page_id and o.k = f.k + 1)
select page_id, rect_id, line as row, row_number() over (partition by page_id order by line, across, rect_id) panel_no from f join o using (page_id, k)"""


@query(_order_sql("y + h/2", "0.5::double*median(h) over (partition by page_id)", "x + w/2"), "r")
def w3b_reading_order_centroid(s, d):
    return Y.reading_order_centroid(V.rects(s, d))


@query(_order_sql("y", "0.5::double*h", "x"), "r")
def w3c_reading_order_height(s, d):
    return Y.reading_order_height(V.rects(s, d))


ITEMS = "i as (select page_id, list({'rect_id': rect_id, 'x': x, 'y': y, 'w': w, 'h': h} order by rect_id) items from r group by page_id), o as (select r.*, items, row_number() over (partition by page_id order by rect_id) k from r join i using (page_id))"


@query(f"""{ITEMS},
f(page_id, k, items, gone, grown) as (
  select page_id, 0, items, []::bigint[], []::struct(rect_id bigint, b struct(x double, y double, w double, h double))[] from i
  union all select page_id, k, items, case when b is null then gone else list_append(gone, rect_id) end,
    case when b is null then grown else list_append(grown, {{'rect_id': b.rect_id, 'b': {union_sql('o', 'b')}}}) end
  from (select o.page_id, o.k, o.items, gone, grown, o.rect_id, {{'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h}} o, list_filter(o.items, lambda b: not list_contains(gone, b.rect_id) and o.w*o.h < b.w*b.h
      and o.w*o.h <= 0.25*(b.w*b.h) and {inter('o', 'b')} >= 0.90*(o.w*o.h))[1] b
    from f join o on o.page_id = f.page_id and o.k = f.k + 1)),
z as (select page_id, gone, grown, unnest(items) m from (select * from f qualify row_number() over (partition by page_id order by k desc) = 1)),
y as (select page_id, m.rect_id::int rect_id, coalesce(list_filter(grown, lambda g: g.rect_id = m.rect_id)[-1].b, {{'x': m.x, 'y': m.y, 'w': m.w, 'h': m.h}}) b from z where not list_contains(gone, m.rect_id))
select page_id, rect_id, b.x x, b.y y, b.w w, b.h h from y""", "r")
def j2_suppress_nested(s, d):
    return Y.suppress_nested(V.rects(s, d))


@query(f"""i as (select page_id, list({{'rect_id': rect_id, 'scale_id': scale_id, 'x': x, 'y': y, 'w': w, 'h': h}} order by scale_id, rect_id) items from r group by page_id),
o as (select r.*, items, row_number() over (partition by page_id order by scale_id, rect_id) k from r join i using (page_id)),
f(page_id, k, used, made) as (
  select page_id, 0, []::bigint[], []::struct(c double, x double, y double, w double, h double)[] from i
  union all select page_id, k, case when ok then used || list_transform(g, lambda b: b.rect_id) else used end,
    case when ok then list_append(made, {{'c': len(list_distinct(list_transform(g, lambda b: b.scale_id)))/3.0::double, 'x': list_sum(list_transform(g, lambda b: b.x))/len(g),
      'y': list_sum(list_transform(g, lambda b: b.y))/len(g), 'w': list_sum(list_transform(g, lambda b: b.w))/len(g), 'h': list_sum(list_transform(g, lambda b: b.h))/len(g)}}) else made end
  from (select *, not list_contains(used, rect_id) and len(list_distinct(list_transform(g, lambda b: b.scale_id))) >= 2 ok from (
    select o.page_id, o.k, o.rect_id, used, made, list_filter(o.items, lambda b: b.rect_id = o.rect_id or ((b.scale_id > o.scale_id or (b.scale_id = o.scale_id and b.rect_id > o.rect_id))
      and not list_contains(used, b.rect_id) and {iou_sql('o', 'b')} >= 0.30)) g
    from f join o on o.page_id = f.page_id and o.k = f.k + 1))),
t as (select page_id, unnest(range(len(made))) turn, unnest(made) b from (select * from f qualify row_number() over (partition by page_id order by k desc) = 1)),
q as (select page_id, row_number() over (partition by page_id order by b.c desc, turn) rect_id, b.x x, b.y y, b.w w, b.h h from t),
{merge_sql('q', 0.25)} select page_id, merged_id, m.x x, m.y y, m.w w, m.h h from m1""", "r")
def j5_consensus(s, d):
    return Y.consensus(V.rects(s, d))


UNION_OF_LIST = "{'x': list_min(list_transform(g, lambda b: b.x)), 'y': list_min(list_transform(g, lambda b: b.y)), 'w': list_max(list_transform(g, lambda b: b.x+b.w)) - list_min(list_transform(g, lambda b: b.x)), 'h': list_max(list_transform(g, lambda b: b.y+b.h)) - list_min(list_transform(g, lambda b: b.y))}"


@query(f"""{ITEMS},
f(page_id, k, used, made) as (
  select page_id, 0, []::bigint[], []::struct(rect_id bigint, b struct(x double, y double, w double, h double))[] from i
  union all select page_id, k, case when list_contains(used, rect_id) then used else used || list_transform(g[2:], lambda b: b.rect_id) end,
    case when list_contains(used, rect_id) then made else list_append(made, {{'rect_id': rect_id, 'b': {UNION_OF_LIST}}}) end
  from (select o.page_id, o.k, o.rect_id, used, made, list_filter(o.items, lambda b: b.rect_id = o.rect_id or (b.rect_id > o.rect_id and not list_contains(used, b.rect_id) and {iou_sql('o', 'b')} > 0.20)) g
    from f join o on o.page_id = f.page_id and o.k = f.k + 1)),
t as (select page_id, unnest(made) m from (select * from f qualify row_number() over (partition by page_id order by k desc) = 1))
select page_id, m.rect_id::int rect_id, m.b.x x, m.b.y y, m.b.w w, m.b.h h from t""", "r")
def m2_merge_regions(s, d):
    return Y.merge_regions(V.rects(s, d))


@query()
def q3_components_route(s, d):
    """Fixed threshold, closing, components, side limits and merge; q3_adaptive_route is the whole route."""
    boxes = A.numbered_components(V.rasters(s, d), lambda g: A.closed(g < 225, 1)).filter("w >= 5 and h >= 5")
    return R.merge_rects(boxes.select("page_id", F.col("component").alias("rect_id"), *[F.col(c).cast("double").alias(c) for c in "xywh"]))
