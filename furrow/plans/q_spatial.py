"""Queries over polygons, pixels and lattices."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from furrow.functions.scalars import albers, albers_constants, box_degrees, ellipsoid_cell_area, quadkey, r6, slippy_tile
from furrow.operators import geometry as G
from furrow.operators import polygons
from furrow.operators import spatial as J
from furrow.plans.registry import query
from furrow.sources.geopackage import encode_polygons

#: Overlapping pairs of boxes in DuckDB.
PAIRS = """select a.poly_id as a, b.poly_id as b, (least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0)) as inter_px,
  (a.x1-a.x0)*(a.y1-a.y0) as area_a, (b.x1-b.x0)*(b.y1-b.y0) as area_b, a.kx as akx, a.ky as aky, b.kx as bkx, b.ky as bky
  from fx_poly a join fx_poly b on a.x0<b.x1 and b.x0<a.x1 and a.y0<b.y1 and b.y0<a.y1"""


def poly_pairs(t, condition=None):
    boxes = t.poly.select("poly_id", "kx", "ky", "x0", "y0", "x1", "y1")
    return J.box_pairs(boxes, boxes, condition=F.col("a_poly_id") < F.col("b_poly_id") if condition is None else condition)


query("G1 G2 G3 G4 G5", "polygon_shape", """
  select poly_id, round((x1-x0)*(y1-y0)/100.0::double,6) as area_ha, 20*((x1-x0)+(y1-y0)) as perimeter_m, round(2*((x1-x0)+(y1-y0))/sqrt(cast((x1-x0)*(y1-y0) as double)),6) as compactness,
    x0, y0, x1, y1, round((x0+x1)/2.0::double,6) as cx, round((y0+y1)/2.0::double,6) as cy,
    x0+(x1-x0-1)//2 as in_x, y0+(y1-y0-1)//2 as in_y from fx_poly
""")(lambda t: G.shape(t.px).select("poly_id", r6("area_ha").alias("area_ha"), "perimeter_m", r6("compactness").alias("compactness"), "x0", "y0", "x1", "y1", r6("cx").alias("cx"), r6("cy").alias("cy"), "in_x", "in_y"))

query("J14 G6 G7 G8", "overlap_pairs", f"""
  select a, b, inter_px, round(inter_px/cast(area_a+area_b-inter_px as double),6) as iou, round(inter_px/cast(least(area_a,area_b) as double),6) as contain from ({PAIRS}) where a<b
""")(lambda t: G.with_areas(G.overlaps(t.px.select("poly_id", "px", "py"), t.px.select("poly_id", "px", "py"), "poly_id", "poly_id", F.col("a_poly_id") < F.col("b_poly_id")), G.areas(t.px), G.areas(t.px)).select(
    "a", "b", "inter_px", r6("iou").alias("iou"), r6("contain").alias("contain")))

query("J15", "cross_tile_pairs", f"select a, b, inter_px from ({PAIRS}) where a<b and (akx<>bkx or aky<>bky)")(
    lambda t: poly_pairs(t, (F.col("a_poly_id") < F.col("b_poly_id")) & ((F.col("a_kx") != F.col("b_kx")) | (F.col("a_ky") != F.col("b_ky")))).select(F.col("a_poly_id").alias("a"), F.col("b_poly_id").alias("b"), "inter_px"))

query("G9", "coverage_by_many", """
  select p.poly_id, count(*) as n_px, count(*) filter (c.px is not null) as n_covered, round(count(*) filter (c.px is not null)/cast(count(*) as double),6) as coverage
  from fx_px p left join (select distinct p.poly_id, p.px, p.py from fx_px p join fx_px o on p.px=o.px and p.py=o.py and p.poly_id<>o.poly_id) c on p.poly_id=c.poly_id and p.px=c.px and p.py=c.py group by 1
""")(lambda t: G.coverage(t.px, t.px.select(F.col("poly_id").alias("own"), "px", "py")).withColumn("coverage", r6("coverage")))

query("G10", "union_area", "select kx, count(*) as n_px from (select distinct kx, px, py from fx_px) group by 1")(lambda t: G.union(t.px, "kx").groupBy("kx").agg(F.count("*").alias("n_px")))

query("G12", "difference_area", """
  select poly_id, count(*) as n_left from fx_px p where not exists (select 1 from fx_poly_year o where o.yr=2019 and p.px>=o.x0 and p.px<o.x1 and p.py>=o.y0 and p.py<o.y1) group by 1
""")(lambda t: G.difference(t.px, G.pixels(t.poly_year.where("yr = 2019"))).groupBy("poly_id").agg(F.count("*").alias("n_left")))

query("G13", "erosion", "select poly_id, case when (x1-x0-2)*(y1-y0-2)>0 then (x1-x0-2)*(y1-y0-2) else (x1-x0)*(y1-y0) end as n_px from fx_poly")(
    lambda t: G.eroded_or_whole(t.px).groupBy("poly_id").agg(F.count("*").alias("n_px")))

query("G14 G15", "dilation", "select poly_id, (x1-x0+4)*(y1-y0+4) as n_px from fx_poly")(lambda t: G.dilated(t.px, rings=2).groupBy("poly_id").agg(F.count("*").alias("n_px")))

query("G11", "largest_part", """
  with recursive u as (select distinct ky as g, px, py from fx_px), n as (select g, px, py, row_number() over (order by g, px, py) as id from u),
  e as (select a.id as a, b.id as b from n a join n b on a.g=b.g and abs(a.px-b.px)+abs(a.py-b.py)=1), r as (select id, id as c from n union select e.b, r.c from r join e on r.id=e.a where r.c<e.b),
  l as (select id, min(c) as c from r group by 1), p as (select n.g, l.c, count(*) as k from n join l using (id) group by 1,2)
  select g as ky, count(*) as n_parts, max(k) as largest_px, sum(k)::bigint as n_px from p group by 1
""")(lambda t: G.parts(G.union(t.px, "ky"), "ky").groupBy("ky").agg(F.count("*").alias("n_parts"), F.max("n_px").alias("largest_px"), F.sum("n_px").alias("n_px")))

query("G16", "edge_length", """
  select poly_id, 10*((case when x0%20=0 then y1-y0 else 0 end)+(case when x1%20=0 then y1-y0 else 0 end)+(case when y0%20=0 then x1-x0 else 0 end)+(case when y1%20=0 then x1-x0 else 0 end)) as edge_m from fx_poly
""")(lambda t: G.edge_touch(t.px, 20))

query("G17 G18", "tile_distances", """
  select poly_id, 10*least(abs(x0-kx*20),abs(x1-(kx+1)*20),abs(y0-ky*20),abs(y1-(ky+1)*20)) as dist_m, 10*least(abs(x0-kx*20),abs(x1-(kx+1)*20),abs(y0-ky*20),abs(y1-(ky+1)*20))<=10 as touches,
    round(least(((x0%20)+20)%20, 20-((x0%20)+20)%20)*1.0::double,6) as line_dist from fx_poly
""")(lambda t: (lambda d: t.poly.select("poly_id", d.alias("dist_m"), (d <= 10).alias("touches"), r6(G.lattice_distance(F.col("x0").cast("double"), 0.0, 20.0)).alias("line_dist")))(
    G.tile_distance(*(F.col(c) for c in ("x0", "y0", "x1", "y1", "kx", "ky")), 20)))

query("G19", "lattice_recovery", """
  with v as (select distinct cast(kx*20+3 as double) as v from fx_poly), s as (select min(v-p) as step from (select v, lag(v) over (order by v) as p from v)) select step, median(v - floor(v/step)*step) as origin from v, s group by 1
""")(lambda t: G.recover_lattice(t.poly.select((F.col("kx") * 20 + 3).alias("v")), "v"))

query("G20", "rasterise_last_wins", "select px, py, max(poly_id) as poly_id from fx_px group by 1,2")(lambda t: G.rasterise(t.px))

query("G22", "resample_blocks", "select cast(floor(px/5.0) as bigint) as bx, cast(floor(py/5.0) as bigint) as by, max(poly_id) as most, round(avg(poly_id),6) as mean, count(*) as n from fx_px group by 1,2")(
    lambda t: G.resample(t.px, "poly_id", 5).withColumn("mean", r6("mean")))

query("G24 X27", "identity_hash", """
  select poly_id, substring(md5(string_agg(px||','||py, ';' order by px, py)),1,12) as hash from fx_px group by 1
""")(lambda t: G.identity(t.px).select("poly_id", F.substring("hash", 1, 12).alias("hash")))

query("G25", "valid_boxes", "select poly_id, x1-x0 as w, y1-y0 as h from (select poly_id, x0, x0+(x1-x0)*(poly_id%3) as x1, y0, y1 from fx_poly) where x1>x0 and y1>y0")(
    lambda t: G.pixels(t.poly.select("poly_id", "x0", (F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("poly_id") % 3)).alias("x1"), "y0", "y1")).groupBy("poly_id").agg(
        F.count_distinct("px").alias("w"), F.count_distinct("py").alias("h")))

_ZONE = "(sin(radians({l}))/(2*(1-0.00669438002290::double*pow(sin(radians({l})),2))) + ln((1+sqrt(0.00669438002290::double)*sin(radians({l})))/(1-sqrt(0.00669438002290::double)*sin(radians({l}))))/(4*sqrt(0.00669438002290::double)))"
query("G21 G23 X35", "projected_points", f"""
  select trial, round(pow(6378137.0::double,2)*(1-0.00669438002290::double)*radians(0.01::double)*({_ZONE.format(l='lat')}-{_ZONE.format(l='(lat-0.01::double)')}),1) as cell_m2,
    cast(floor(lon/0.1::double) as bigint) as gx, cast(floor(lat/0.1::double) as bigint) as gy from fx_site
""")(lambda t: t.sites.select("trial", F.round(ellipsoid_cell_area(F.col("lat"), 0.01), 1).alias("cell_m2"), F.floor(F.col("lon") / 0.1).alias("gx"), F.floor(F.col("lat") / 0.1).alias("gy")))

_K = albers_constants()
_Q = f"(1-{_K['e2']!r}::double)*(s/(1-{_K['e2']!r}::double*s*s)-1/(2*{_K['e']!r}::double)*ln((1-{_K['e']!r}::double*s)/(1+{_K['e']!r}::double*s)))"
query("G21", "albers_metres", f"""
  with p as (select trial, radians(lon-132.0)*{_K['n']!r}::double as th, sin(radians(lat)) as s from fx_site), r as (select trial, th, {_K['a']!r}::double*sqrt({_K['c']!r}::double-({_K['n']!r}::double)*({_Q}))/({_K['n']!r}::double) as rho from p)
  select trial, round(rho*sin(th),3) as x, round({_K['rho0']!r}::double-rho*cos(th),3) as y from r
""")(lambda t: (lambda x, y: t.sites.select("trial", F.round(x, 3).alias("x"), F.round(y, 3).alias("y")))(*albers(F.col("lon"), F.col("lat"))))

query("G26", "quadkey", """
  with s as (select trial, cast(floor((lon+180)/360*4096) as bigint) as x, cast(floor((1-ln(tan(radians(lat))+1/cos(radians(lat)))/3.141592653589793::double)/2*4096) as bigint) as y from fx_site)
  select trial, x, y, (select string_agg(cast(((x>>i)%2)+((y>>i)%2)*2 as varchar), '' order by i desc) from (select unnest(range(12)) as i)) as quadkey from s
""")(lambda t: (lambda x, y: t.sites.select("trial", x.alias("x"), y.alias("y")).select("trial", "x", "y", quadkey(F.col("x"), F.col("y"), 12).alias("quadkey")))(*slippy_tile(F.col("lon"), F.col("lat"), 12)))

query("G27", "aoi_boxes", """
  select trial, round(lon-4500/(111320*cos(radians(lat))),6) as west, round(lat-4500/111320.0::double,6) as south, round(lon+4500/(111320*cos(radians(lat))),6) as east, round(lat+4500/111320.0::double,6) as north from fx_site
""")(lambda t: t.sites.select("trial", *(r6(c).alias(n) for n, c in box_degrees(F.col("lon"), F.col("lat"), 4500).items())))

query("G28", "tree_fraction", """
  select poly_id, count(h) as n_seen, round(count(*) filter (h>3)/nullif(cast(count(h) as double),0),6) as tree_frac
  from (select p.poly_id, case when (p.px+p.py)%4=0 then null else (((p.px*7+p.py*13)%11)+11)%11 end as h from fx_px p) group by 1
""")(lambda t: G.tree_fraction(t.px, t.px.where("(px + py) % 4 != 0").select("px", "py", F.pmod(F.col("px") * 7 + F.col("py") * 13, F.lit(11)).cast("double").alias("height")).distinct(), 3).withColumn("tree_frac", r6("tree_frac")))

query("G29", "band_share", "select b as band, round(1-pow((4500-b)/4500.0::double,2),6) as share from (select unnest([10,50,100,500]) as b)")(
    lambda t: t.spark.createDataFrame([(b, G.band_share(4500, b)) for b in (10, 50, 100, 500)], "band int, share double").withColumn("share", r6("share")))

_CORNERED = """
  l as (select poly_id, x0, y0, x1, y1, cast(floor((x0+x1)/2.0) as bigint) as xm, cast(floor((y0+y1)/2.0) as bigint) as ym from fx_poly)
"""


def _cornered(t):
    """The polygons without their upper right quarter and with a hole of a pixel: (poly_id, geom)."""

    @F.arrow_udf("binary")
    def blob(x0s: pa.Array, y0s: pa.Array, x1s: pa.Array, y1s: pa.Array) -> pa.Array:
        out = []
        for x0, y0, x1, y1 in zip(x0s.to_pylist(), y0s.to_pylist(), x1s.to_pylist(), y1s.to_pylist(), strict=True):
            xm, ym = (x0 + x1) // 2, (y0 + y1) // 2
            outer = [(x0, y0), (x1, y0), (x1, ym), (xm, ym), (xm, y1), (x0, y1)]
            out.append(encode_polygons([[outer, [(x0 + 1, y0 + 1), (x0 + 2, y0 + 1), (x0 + 2, y0 + 2), (x0 + 1, y0 + 2)]]]))
        return pa.array(out, pa.binary())

    return t.poly.select("poly_id", blob("x0", "y0", "x1", "y1").alias("geom"))


query("G20 J13", "polygon_centre_rule", f"""
  with {_CORNERED} select p.poly_id, px, py from fx_px p join l on p.poly_id=l.poly_id where not (px>=xm and py>=ym) and not (px=l.x0+1 and py=l.y0+1)
""")(lambda t: polygons.polygon_pixels(_cornered(t)).select("poly_id", "px", "py"))

query("J11 J12 S36", "point_in_rings", f"""
  with {_CORNERED}, p as (select c_custkey as pt, (c_custkey*7)%100+0.25 as x, (c_custkey*13)%(2*(select max(y1) from fx_poly))+0.75 as y from customer)
  select pt, poly_id from p join l on x>=x0 and x<x1 and y>=y0 and y<y1 where not (x>=xm and y>=ym) and not (floor(x)=x0+1 and floor(y)=y0+1)
""")(lambda t: _in_rings(t))


def _in_rings(t):
    top = t.poly.agg((2 * F.max("y1")).alias("top"))
    c = F.col("c_custkey")
    points = t.customer.join(F.broadcast(top)).select(c.alias("pt"), (c * 7 % 100 + 0.25).alias("x"), (c * 13 % F.col("top") + 0.75).alias("y"))
    return polygons.point_in_polygon(points, _cornered(t)).select("pt", "poly_id")


query("J11", "point_in_polygon", """
  select y.poly_id as pt, y.yr, p.poly_id from (select poly_id, yr, (x0+x1)/2.0::double as x, (y0+y1)/2.0::double as y from fx_poly_year) y join fx_poly p on y.x>=p.x0 and y.x<p.x1 and y.y>=p.y0 and y.y<p.y1
""")(lambda t: J.point_in_box(_points(t), t.poly.select("poly_id", "x0", "y0", "x1", "y1")).select("pt", "yr", "poly_id"))


def _points(t):
    return t.poly_year.select(F.col("poly_id").alias("pt"), "yr", ((F.col("x0") + F.col("x1")) / 2.0).alias("x"), ((F.col("y0") + F.col("y1")) / 2.0).alias("y"))


_PTS = "(select poly_id as pt, yr, (x0+x1)/2.0::double as x, (y0+y1)/2.0::double as y from fx_poly_year)"
query("J12", "point_in_polygon_one", f"""
  select pt, yr, min(p.poly_id) as poly_id from {_PTS} y left join fx_poly p on y.x>=p.x0 and y.x<p.x1 and y.y>=p.y0 and y.y<p.y1 group by 1,2
""")(lambda t: J.one_each(J.point_in_box(_points(t), t.poly.select("poly_id", "x0", "y0", "x1", "y1"), "left"), ["pt", "yr"], F.col("poly_id").asc_nulls_last()).select("pt", "yr", "poly_id"))

query("J13", "intersects_aoi", """
  select p.poly_id, t.gx, t.gy from fx_poly p join fx_tile t on p.x0<t.gx*20+20 and p.x1>t.gx*20 and p.y0<t.gy*20+20 and p.y1>t.gy*20
""")(lambda t: J.box_pairs(t.poly.select("poly_id", "x0", "y0", "x1", "y1"), t.tiles.select("gx", "gy", (F.col("gx") * 20).alias("x0"), (F.col("gy") * 20).alias("y0"), (F.col("gx") * 20 + 20).alias("x1"), (F.col("gy") * 20 + 20).alias("y1"))).select(
    F.col("a_poly_id").alias("poly_id"), F.col("b_gx").alias("gx"), F.col("b_gy").alias("gy")))

_IOU = "inter_px/cast(area_a+area_b-inter_px as double)"
query("J16", "best_match_iou", f"""
  select a, b, round(iou,6) as iou from (select a, b, {_IOU} as iou, row_number() over (partition by a order by {_IOU} desc, b) as rn from ({PAIRS}) where a<>b) where rn=1
""")(lambda t: J.best_match(_iou_pairs(t), "a", "iou", "b").select("a", "b", r6("iou").alias("iou")))


def _iou_pairs(t):
    size = lambda s: (F.col(f"{s}_x1") - F.col(f"{s}_x0")) * (F.col(f"{s}_y1") - F.col(f"{s}_y0"))
    i = F.col("inter_px")
    return poly_pairs(t, F.col("a_poly_id") != F.col("b_poly_id")).select(F.col("a_poly_id").alias("a"), F.col("b_poly_id").alias("b"), "inter_px", (i / (size("a") + size("b") - i).cast("double")).alias("iou"), (i / size("a").cast("double")).alias("share_a"))


query("J17", "best_match_both_ways", """
  with p as (select a.poly_id as a, b.poly_id as b, (least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0))*1.0::double as i, (a.x1-a.x0)*(a.y1-a.y0) as na, (b.x1-b.x0)*(b.y1-b.y0) as nb
    from fx_poly a join fx_poly_year b on b.yr=2020 and a.x0<b.x1 and b.x0<a.x1 and a.y0<b.y1 and b.y0<a.y1)
  select 'ab' as way, a as src, b as dst, round(i/na,6) as share from (select *, row_number() over (partition by a order by i/na desc, b) as rn from p) where rn=1
  union all select 'ba', b, a, round(i/nb,6) from (select *, row_number() over (partition by b order by i/nb desc, a) as rn from p) where rn=1
""")(lambda t: _both_ways(t))


def _both_ways(t):
    size = lambda s: ((F.col(f"{s}_x1") - F.col(f"{s}_x0")) * (F.col(f"{s}_y1") - F.col(f"{s}_y0"))).cast("double")
    box = ["poly_id", "x0", "y0", "x1", "y1"]
    pairs = J.box_pairs(t.poly.select(*box), t.poly_year.where("yr = 2020").select(*box)).select(
        F.col("a_poly_id").alias("a"), F.col("b_poly_id").alias("b"), (F.col("inter_px") / size("a")).alias("share_a"), (F.col("inter_px") / size("b")).alias("share_b"))
    way = lambda name, src, dst, share: J.best_match(pairs, src, share, dst).select(F.lit(name).alias("way"), F.col(src).alias("src"), F.col(dst).alias("dst"), r6(share).alias("share"))
    return way("ab", "a", "b", "share_a").unionAll(way("ba", "b", "a", "share_b"))


YEAR_PAIRS = """select a.poly_id as a, a.yr as yr, b.poly_id as b, b.yr as other, (least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0)) as i,
  (a.x1-a.x0)*(a.y1-a.y0) as area_a, (b.x1-b.x0)*(b.y1-b.y0) as area_b from fx_poly_year a join fx_poly_year b on a.yr<>b.yr and a.x0<b.x1 and b.x0<a.x1 and a.y0<b.y1 and b.y0<a.y1"""


def year_pairs(t):
    boxes = t.poly_year.select("poly_id", "yr", "x0", "y0", "x1", "y1")
    size = lambda s: (F.col(f"{s}_x1") - F.col(f"{s}_x0")) * (F.col(f"{s}_y1") - F.col(f"{s}_y0"))
    i = F.col("inter_px")
    return J.box_pairs(boxes, boxes, condition=F.col("a_yr") != F.col("b_yr")).select(
        F.col("a_poly_id").alias("a"), F.col("a_yr").alias("yr"), F.col("b_poly_id").alias("b"), F.col("b_yr").alias("other"),
        (i / (size("a") + size("b") - i).cast("double")).alias("iou"), (i / F.least(size("a"), size("b")).cast("double")).alias("contain"))


query("J18", "match_other_years", f"""
  with p as (select a, yr, b, other, i/cast(area_a+area_b-i as double) as iou, i/cast(least(area_a,area_b) as double) as contain from ({YEAR_PAIRS}))
  select a, yr, other, max(b) filter (r1=1) as best_iou_id, round(max(iou),6) as best_iou, max(b) filter (r2=1) as best_contain_id, round(max(contain),6) as best_contain
  from (select *, row_number() over (partition by a, yr, other order by iou desc, b) as r1, row_number() over (partition by a, yr, other order by contain desc, b) as r2 from p) group by 1,2,3
""")(lambda t: year_pairs(t).groupBy("a", "yr", "other").agg(
    F.max_by("b", F.struct("iou", -F.col("b"))).alias("best_iou_id"), r6(F.max("iou")).alias("best_iou"), F.max_by("b", F.struct("contain", -F.col("b"))).alias("best_contain_id"), r6(F.max("contain")).alias("best_contain")))

_DIST = "sqrt(pow(greatest(p.x0-y.x, y.x-p.x1, 0),2)+pow(greatest(p.y0-y.y, y.y-p.y1, 0),2))"
query("J19", "nearest_within", f"""
  select pt, yr, poly_id, round(dist,6) as dist from (select pt, yr, p.poly_id, {_DIST} as dist, row_number() over (partition by pt, yr order by {_DIST}, p.poly_id) as rn
  from {_PTS} y join fx_poly p on {_DIST}<=5) where rn=1
""")(lambda t: J.one_each(J.near_boxes(_points(t), t.poly.select("poly_id", "x0", "y0", "x1", "y1"), 5.0), ["pt", "yr"], "dist", "poly_id").select("pt", "yr", "poly_id", r6("dist").alias("dist")))

query("J20 C22", "nearest_with_upgrade", f"""
  with m as (select pt, yr, poly_id, area_ha, x, y from (select pt, yr, x, y, p.poly_id, p.area_ha, row_number() over (partition by pt, yr order by {_DIST}, p.poly_id) as rn from {_PTS} y join fx_poly p on {_DIST}<=5) where rn=1),
  u as (select pt, yr, up, row_number() over (partition by pt, yr order by dist, up) as rn from (select y.pt, y.yr, p.poly_id as up, {_DIST} as dist from m y join fx_poly p on y.area_ha<0.5 and p.area_ha>=1.5*y.area_ha and {_DIST}<=15))
  select m.pt, m.yr, m.poly_id as first_id, coalesce(u.up, m.poly_id) as poly_id from m left join u on m.pt=u.pt and m.yr=u.yr and u.rn=1
""")(lambda t: _upgraded(t))


def _upgraded(t):
    boxes = t.poly.select("poly_id", "area_ha", "x0", "y0", "x1", "y1")
    first = J.one_each(J.near_boxes(_points(t), boxes, 5.0), ["pt", "yr"], "dist", "poly_id").select("pt", "yr", "x", "y", F.col("poly_id").alias("first_id"), F.col("area_ha").alias("own_ha"))
    more = J.near_boxes(first.where("own_ha < 0.5"), boxes, 15.0).where(F.col("area_ha") >= 1.5 * F.col("own_ha"))
    up = J.one_each(more, ["pt", "yr"], "dist", "poly_id").select("pt", "yr", F.col("poly_id").alias("up"))
    return first.join(up, ["pt", "yr"], "left").select("pt", "yr", "first_id", F.coalesce("up", "first_id").alias("poly_id"))


query("J25", "overlay_area_by_region", f"""
  select gx//2 as region, sum((least(p.x1,gx*20+20)-greatest(p.x0,gx*20))*(least(p.y1,gy*20+20)-greatest(p.y0,gy*20)))::bigint as px
  from fx_poly p join fx_tile t on p.x0<t.gx*20+20 and p.x1>t.gx*20 and p.y0<t.gy*20+20 and p.y1>t.gy*20 where gx>=0 group by 1
""")(lambda t: J.box_pairs(t.poly.select("poly_id", "x0", "y0", "x1", "y1"), t.tiles.where("gx >= 0").select("gx", "gy", (F.col("gx") * 20).alias("x0"), (F.col("gy") * 20).alias("y0"), (F.col("gx") * 20 + 20).alias("x1"), (F.col("gy") * 20 + 20).alias("y1"))).groupBy(
    F.floor(F.col("b_gx") / 2).alias("region")).agg(F.sum("inter_px").alias("px")))

query("J26", "cell_key_join", """
  select a.cx, a.cy, a.n as n_map, b.n as n_other from (select cast(floor(x0/10.0) as bigint) as cx, cast(floor(y0/10.0) as bigint) as cy, count(*) as n from fx_poly group by 1,2) a
  join (select cast(floor(x0/10.0) as bigint) as cx, cast(floor(y0/10.0) as bigint) as cy, count(*) as n from fx_poly_year where yr=2019 group by 1,2) b using (cx, cy)
""")(lambda t: (lambda c: c(t.poly, "n_map").join(c(t.poly_year.where("yr = 2019"), "n_other"), ["cx", "cy"]))(
    lambda d, n: d.groupBy(F.floor(F.col("x0") / 10).alias("cx"), F.floor(F.col("y0") / 10).alias("cy")).agg(F.count("*").alias(n))))

query("J27", "neighbour_join", """
  select a.gx, a.gy, count(*) as n from fx_tile a join fx_tile b on abs(a.gx-b.gx)<=1 and abs(a.gy-b.gy)<=1 and (a.gx<>b.gx or a.gy<>b.gy) group by 1,2
""")(lambda t: J.neighbours(t.tiles, "gx", "gy").join(t.tiles.select(F.col("gx").alias("nx"), F.col("gy").alias("ny")), ["nx", "ny"]).groupBy("gx", "gy").agg(F.count("*").alias("n")))

query("J28", "ownership_join", """
  select poly_id, kx, ky, cast(floor((x0+x1)/2.0/20) as bigint) as okx, cast(floor((y0+y1)/2.0/20) as bigint) as oky, floor((x0+x1)/2.0/20)=kx and floor((y0+y1)/2.0/20)=ky as home from fx_poly
""")(lambda t: (lambda a, b: t.poly.select("poly_id", "kx", "ky", a.alias("okx"), b.alias("oky"), ((a == F.col("kx")) & (b == F.col("ky"))).alias("home")))(
    J.owner_cell((F.col("x0") + F.col("x1")) / 2.0, 20), J.owner_cell((F.col("y0") + F.col("y1")) / 2.0, 20)))

query("J29", "preferred_candidate", f"""
  select pt, yr, poly_id from (select pt, yr, p.poly_id, row_number() over (partition by pt, yr order by (floor(y.x/20)=p.kx and floor(y.y/20)=p.ky) desc, p.area_ha desc, p.poly_id) as rn
  from {_PTS} y join fx_poly p on y.x>=p.x0 and y.x<p.x1 and y.y>=p.y0 and y.y<p.y1) where rn=1
""")(lambda t: J.one_each(J.point_in_box(_points(t), t.poly), ["pt", "yr"], ((F.floor(F.col("x") / 20) == F.col("kx")) & (F.floor(F.col("y") / 20) == F.col("ky"))).desc(), F.col("area_ha").desc(), "poly_id").select("pt", "yr", "poly_id"))

query("J30", "parent_rollup", "select cast(floor(gx/3.0) as bigint) as px, cast(floor(gy/3.0) as bigint) as py, count(*) as n, round(avg(gx),6) as mx, round(avg(gy),6) as my from fx_tile group by 1,2")(
    lambda t: t.tiles.groupBy(F.floor(F.col("gx") / 3).alias("px"), F.floor(F.col("gy") / 3).alias("py")).agg(F.count("*").alias("n"), r6(F.avg("gx")).alias("mx"), r6(F.avg("gy")).alias("my")))

query("J33 S43", "lattice_window", "select a.gx, a.gy, count(*) as n from fx_tile a join fx_tile b on b.gx between a.gx-2 and a.gx+2 and b.gy between a.gy-1 and a.gy+1 group by 1,2")(
    lambda t: (lambda w: w.join(t.tiles.select(F.col("gx").alias("nx"), F.col("gy").alias("ny")), ["nx", "ny"]).groupBy("gx", "gy").agg(F.count("*").alias("n")))(
        t.tiles.withColumn("nx", F.explode(F.sequence(F.col("gx") - 2, F.col("gx") + 2))).withColumn("ny", F.explode(F.sequence(F.col("gy") - 1, F.col("gy") + 1)))))

query("J34", "candidates_flagged", f"""
  select pt, yr, p.poly_id, p.poly_id=y.pt as chosen from {_PTS} y join fx_poly p on {_DIST}<=8 where yr=2018
""")(lambda t: J.near_boxes(_points(t).where("yr = 2018"), t.poly.select("poly_id", "x0", "y0", "x1", "y1"), 8.0).select("pt", "yr", "poly_id", (F.col("poly_id") == F.col("pt")).alias("chosen")))

_HAV = "2*6371000.0::double*asin(sqrt(pow(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2)))"
query("J22 X14 C36", "nearest_different_crop", f"""
  with n as (select a.trial, min({_HAV}) as nearest_m from fx_site a left join fx_site b on a.yr=b.yr and a.crop<>b.crop group by 1)
  select trial, round(nearest_m,2) as nearest_m, nearest_m is null or nearest_m>200 as clean from n
""")(lambda t: J.nearest_different(t.sites, "trial", "yr", "crop").select("trial", F.round("nearest_m", 2).alias("nearest_m"), (F.col("nearest_m").isNull() | (F.col("nearest_m") > 200)).alias("clean")))
