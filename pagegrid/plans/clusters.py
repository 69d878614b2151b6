"""Queries of the colour clusters, their backgrounds, and the trained style model.

The pages of colour_rasters() have four flat colours, so the clusters that k-means must find are these
colours, which SQL counts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegrid.operators import clusters as K
from pagegrid.operators import layout as Y
from pagegrid.operators import masks as M
from pagegrid.plans.layout import LAB_SQL, features
from pagegrid.plans.registry import WITH, query
from pagegrid.sources import views as V
from pagegrid.sources.files import stored

WITH["crgb"] = V.COLOURS_SQL
CLUSTERS_SQL = LAB_SQL.replace("from rgb", "from crgb") + """,
cl as (select page_id, "L" l, "A" a, "B" b, count(*) pixels, count(*)/3072.0::double frac, count(*) filter (x < 2 or x >= 46 or y < 2 or y >= 62)/432.0::double border,
  row_number() over (partition by page_id order by count(*) desc, "L", "A", "B")::int cluster_id from lab group by page_id, "L", "A", "B"),
s1 as (select *, (l > 140 and border >= 0.15::double and frac >= 0.05::double) or (border >= 0.4::double and frac >= 0.05::double) sure, l > 120 and frac > 0.08::double spare from cl),
s2 as (select *, bool_or(sure) over (partition by page_id) anyone, row_number() over (partition by page_id order by spare desc, frac desc, cluster_id) k from s1),
bgc as (select * from s2 where sure or (not anyone and spare and k = 1))"""


def found(s, d):
    return K.colour_clusters(V.colour_rasters(s, d))


@query(f"{CLUSTERS_SQL} select page_id, cluster_id, round(l, 4) l, round(a, 4) a, round(b, 4) b, pixels, round(frac, 9) frac, round(border, 9) border from cl", "crgb")
def a11_colour_clusters(s, d):
    rounded = [F.round(c, n).alias(c.lower()) for c, n in (("L", 4), ("A", 4), ("B", 4), ("frac", 9), ("border", 9))]
    return found(s, d).select("page_id", "cluster_id", "pixels", *rounded)


@query(f"{CLUSTERS_SQL} select page_id, cluster_id, round(l, 4) l from bgc", "crgb")
def f13_background_clusters(s, d):
    return M.background_clusters(found(s, d)).select("page_id", "cluster_id", F.round("L", 4).alias("l"))


@query(f"""{CLUSTERS_SQL}, top as (select page_id, l, a, b, 1 place, border from bgc union all select page_id, l, a, b, 2, l from cl)
select page_id, round(l, 4) l, round(a, 4) a, round(b, 4) b from top qualify row_number() over (partition by page_id order by place, border desc, l desc, a desc, b desc) = 1""", "crgb")
def a12_dominant_background(s, d):
    c = found(s, d)
    return M.dominant_background(c, V.colour_rasters(s, d)).select("page_id", *[F.round(x, 4).alias(x.lower()) for x in M.CHANNELS])


def disc_sql(number: int, most: str) -> str:
    """CTE m{number}: the max or min of m{number - 1} over a 5 x 5 disc, cut at the page's edges."""
    two, pick = "rows between 2 preceding and 2 following", {"max": "greatest", "min": "least"}[most]
    return f"""h{number} as (select *, {most}(v) over (partition by page_id, y order by x {two}) h from m{number - 1}),
m{number} as (select page_id, y, x, {pick}({most}(h) over (partition by page_id, x order by y rows between 1 preceding and 1 following), {most}(v) over (partition by page_id, x order by y {two})) v from h{number})"""


DISCS_SQL = ", ".join(disc_sql(i, m) for i, m in enumerate(["max", "max", "min", "min", "min", "max"], 1))


@query(f"""{CLUSTERS_SQL},
m0 as (select p.page_id, p.y, p.x, max((sqrt(pow(p."L"-c.l, 2) + pow(p."A"-c.a, 2) + pow(p."B"-c.b, 2)) < 15*(1 + 0.5*c.frac))::int) v from lab p join bgc c on c.page_id = p.page_id group by all),
{DISCS_SQL} select page_id, count(*) n, sum(v)::bigint n_background, sum(v*x)::bigint sum_x, sum(v*y)::bigint sum_y from m6 group by page_id""", "crgb")
def a13_cluster_background_mask(s, d):
    """The mask's pixels, and the sums of their places, which tell masks of one size apart."""
    at = K.cluster_background_mask(V.colour_rasters(s, d)).withColumn("_on", F.expr("filter(transform(gray, (v, i) -> if(v = 255, i, -1)), i -> i >= 0)"))
    total = lambda place: F.expr(f"aggregate(_on, 0L, (a, i) -> a + {place})")
    return at.select("page_id", F.size("gray").cast("long").alias("n"), F.size("_on").cast("long").alias("n_background"), total("i % width").alias("sum_x"), total("i div width").alias("sum_y"))


@query()
def x2_style_model(s, d):
    """A model of the rules' own styles, learned from four fifths of the pages and applied to all of them.

    Features are worked out once and stored: learning and applying read them.
    """
    f = stored(features(s, d), "features")
    model = Y.fit_style_model(Y.style_scores(f.filter("page_id % 5 <> 0")))
    return Y.classify_style(f, model).select("page_id", "style", F.round("confidence", 4).alias("confidence"))
