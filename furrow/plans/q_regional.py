"""Queries that compare mapped areas with statistics: the flagship and its relatives."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from furrow.functions.scalars import r6
from furrow.operators import metrics as M
from furrow.operators import regional as R
from furrow.plans.catalog import CROPS
from furrow.plans.registry import query

_WIDE = ", ".join(f"coalesce(sum(ha) filter (cls='{c}'),0) as {c.lower()}" for c in CROPS)
_SHARES = f"""m as (select region, yr, {_WIDE} from fx_mapped group by 1,2), s as (select region, yr, {_WIDE} from fx_stat group by 1,2),
  j as (select m.region, m.yr, {', '.join(f'm.{c.lower()} as m_{c.lower()}, s.{c.lower()} as s_{c.lower()}' for c in CROPS)}, m.canola+m.cereal+m.legume as m_total, s.canola+s.cereal+s.legume as s_total from m join s using (region, yr))"""

query("C13 A18 A19 J6", "regional_comparison", f"""
  with {_SHARES} select region, yr, {', '.join(f'round(m_{c.lower()}/nullif(m_total,0),6) as map_{c.lower()}, round(s_{c.lower()}/nullif(s_total,0),6) as ref_{c.lower()}, round(m_{c.lower()}/nullif(m_total,0)-s_{c.lower()}/nullif(s_total,0),6) as err_{c.lower()}' for c in CROPS)},
    round(m_total/nullif(s_total,0),6) as area_ratio from j
""")(lambda t: R.shares(t.mapped, t.stat, CROPS).select("region", "yr", *(r6(f"{p}_{c.lower()}").alias(f"{p}_{c.lower()}") for c in CROPS for p in ("map", "ref", "err")), r6("area_ratio").alias("area_ratio")))

query("A31 W5", "share_correlation", f"""
  with {_SHARES}, r as (select m_canola/m_total as a, s_canola/s_total as b from j), k as (select a, b, rank() over (order by a)+(count(*) over (partition by a)-1)/2.0::double as ra, rank() over (order by b)+(count(*) over (partition by b)-1)/2.0::double as rb from r)
  select count(*) as n, round(corr(a,b),6) as pearson, round(corr(ra,rb),6) as spearman, round(median(abs(a-b)),6) as med_abs from k
""")(lambda t: R.correlations(R.shares(t.mapped, t.stat, CROPS), "map_canola", "ref_canola"))

query("A54", "share_decomposition", f"""
  with {_SHARES}, x as (select avg(m_total/s_total) as ratio, {', '.join(f'avg(m_{c.lower()}/m_total) as g_{c.lower()}, avg(s_{c.lower()}/s_total) as f_{c.lower()}' for c in CROPS)} from j)
  {' union all '.join(f"select '{c}' as cls, round(f_{c.lower()}/ratio,6) as diluted, round(g_{c.lower()}-f_{c.lower()}/ratio,6) as absorbed from x" for c in CROPS)}
""")(lambda t: R.decomposition(R.shares(t.mapped, t.stat, CROPS), CROPS))

query("A55", "argmax_vs_probability", """
  with a as (select area_ha, pred, p_canola, p_cereal, p_legume from fx_poly), s as (select sum(area_ha) as w from a)
  select 'Canola' as cls, round(sum(case when pred='Canola' then area_ha else 0 end)/max(w),6) as hard, round(sum(area_ha*p_canola)/max(w),6) as soft from a, s
  union all select 'Cereal', round(sum(case when pred='Cereal' then area_ha else 0 end)/max(w),6), round(sum(area_ha*p_cereal)/max(w),6) from a, s
  union all select 'Legume', round(sum(case when pred='Legume' then area_ha else 0 end)/max(w),6), round(sum(area_ha*p_legume)/max(w),6) from a, s
""")(lambda t: R.hard_and_soft(t.poly, CROPS))

query("A56", "two_reference_gap", "select cls, round(median(abs(m.ha/s.ha-1)),6) as gap, count(*) as n from fx_mapped m join fx_stat s using (region, yr, cls) where s.ha>0 group by 1")(
    lambda t: t.mapped.join(t.stat.withColumnRenamed("ha", "ref"), ["region", "yr", "cls"]).where("ref > 0").groupBy("cls").agg(r6(F.median(F.abs(F.col("ha") / F.col("ref") - 1))).alias("gap"), F.count("*").alias("n")))

query("A64", "state_median_difference", """
  with m as (select n_regionkey as state, yr, sum(ha) as ha from fx_mapped join nation on region=n_nationkey group by 1,2), s as (select n_regionkey as state, yr, sum(ha) as ha from fx_stat join nation on region=n_nationkey group by 1,2)
  select state, count(*) as n, round(median(abs(m.ha-s.ha)),4) as med_diff from m join s using (state, yr) where s.ha>=20 group by 1
""")(lambda t: R.state_difference(t.mapped, t.stat, t.nation, 20))

query("A68", "nested_level_check", """
  select 'nation' as level, yr, round(sum(ha),6) as ha from fx_stat group by 2 union all select 'state', yr, round(sum(ha),6) from (select n_regionkey, yr, sum(ha) as ha from fx_stat join nation on region=n_nationkey group by 1,2) group by 2
""")(lambda t: (lambda s: s.groupBy("yr").agg(F.round(F.sum("ha"), 6).alias("ha")).select(F.lit("nation").alias("level"), "yr", "ha").unionAll(
    s.join(t.nation, F.col("region") == F.col("n_nationkey")).groupBy("n_regionkey", "yr").agg(F.sum("ha").alias("ha")).groupBy("yr").agg(F.round(F.sum("ha"), 6).alias("ha")).select(F.lit("state"), "yr", "ha")))(t.stat))

query("A53 A67 C38", "coverage_by_reason", """
  select case when coalesce(abstain_reason,'')='' then pred else 'abstain:'||abstain_reason end as category, count(*) as n, round(sum(area_ha),6) as ha, round(sum(area_ha)/(select sum(area_ha) from fx_poly),6) as share from fx_poly group by 1
""")(lambda t: R.by_category(t.poly))

query("A16 A17", "weighted_mean_vector", """
  with w as (select kx, ky, sum(area_ha*p_canola)/sum(area_ha) as a, sum(area_ha*p_cereal)/sum(area_ha) as b, sum(area_ha*p_legume)/sum(area_ha) as c,
    sum(case when poly_id%3<>0 then area_ha*p_canola end)/sum(case when poly_id%3<>0 then area_ha end) as skip from fx_poly group by 1,2)
  select kx, ky, round(a,6) as p_canola, round(b,6) as p_cereal, round(c,6) as p_legume, case when round(a,9)>=round(b,9) and round(a,9)>=round(c,9) then 'Canola' when round(b,9)>=round(c,9) then 'Cereal' else 'Legume' end as cls, round(skip,6) as skip_null from w
""")(lambda t: R.weighted_vector(t.poly, ["kx", "ky"], CROPS, "area_ha").join(t.poly.groupBy("kx", "ky").agg(R.null_safe_mean(F.when(F.col("poly_id") % 3 != 0, F.col("p_canola")), F.col("area_ha")).alias("skip_null")), ["kx", "ky"]).select(
    "kx", "ky", *(r6(f"p_{c.lower()}").alias(f"p_{c.lower()}") for c in CROPS), "cls", r6("skip_null").alias("skip_null")))

query("A12 A14 A15", "modal_and_winner", """
  with w as (select region, yr, cls from (select *, row_number() over (partition by region, yr order by ha desc, cls) as rn from fx_mapped) where rn=1),
  c as (select region, cls, count(*) as n, row_number() over (partition by region order by count(*) desc, cls) as rn from w group by 1,2)
  select region, max(cls) filter (rn=1) as modal, sum(case when cls='Canola' then n else 0 end)::bigint as canola_years, sum(n)::bigint as n_years from c group by 1
""")(lambda t: R.modal(R.winner(t.mapped, ["region", "yr"], "cls", "ha"), "region", "cls"))

query("A25", "two_by_two", """
  with x as (select yr, sum(case when pred='Canola' and truth='Canola' then score else 0 end) as a, sum(case when pred='Canola' and truth<>'Canola' then score else 0 end) as b, sum(case when pred<>'Canola' and truth='Canola' then score else 0 end) as c,
    sum(case when pred<>'Canola' and truth<>'Canola' then score else 0 end) as d from fx_pred group by 1), y as (select *, a+b+c+d as n from x)
  select yr, round((a+d)/n,6) as agreement, round(((a+d)/n-((a+b)*(a+c)+(c+d)*(b+d))/(n*n))/(1-((a+b)*(a+c)+(c+d)*(b+d))/(n*n)),6) as kappa, round(a/(a+b+c),6) as iou, round(a/(a+b),6) as second_given_first, round(a/(a+c),6) as first_given_second from y
""")(lambda t: (lambda p, q, v: t.pred.groupBy("yr").agg(v(p & q).alias("a"), v(p & ~q).alias("b"), v(~p & q).alias("c"), v(~p & ~q).alias("d")).select("yr", *(r6(c).alias(n) for n, c in M.two_by_two(*(F.col(x) for x in "abcd")).items())))(
    F.col("pred") == "Canola", F.col("truth") == "Canola", lambda c: F.sum(F.when(c, F.col("score")).otherwise(0.0))))

_HIST = "select l_linenumber%3 as state, cast(round(l_discount*100) as integer) as p, cast(round(l_tax*100) as integer) as f, sum(l_quantity) as area from lineitem group by 1,2,3"


def hist(t):
    return R.joint_histogram(t.lineitem.select((F.col("l_linenumber") % 3).alias("state"), F.round(F.col("l_discount") * 100).cast("int").alias("p"), F.round(F.col("l_tax") * 100).cast("int").alias("f"), F.col("l_quantity").alias("area")), ["state", "p", "f"], "area")


query("A26", "joint_histogram", _HIST)(hist)

query("A27", "threshold_and_expected", f"select state, sum(case when p>=5 then area else 0 end) as area_over, round(sum(p/100.0::double*area),4) as expected from ({_HIST}) group by 1")(
    lambda t: hist(t).groupBy("state").agg(F.sum(F.when(F.col("p") >= 5, F.col("area")).otherwise(0.0)).alias("area_over"), F.round(F.sum(F.col("p") / 100.0 * F.col("area")), 4).alias("expected")))

query("A28 W8", "area_matched_threshold", f"""
  with b as (select state, p, sum(area) as area from ({_HIST}) group by 1,2), c as (select *, sum(area) over (partition by state order by p desc rows unbounded preceding) as cum, sum(p/10.0::double*area) over (partition by state) as expected from b)
  select state, min(p) filter (cum<=expected) as threshold from c group by 1
""")(lambda t: R.area_matched(hist(t).groupBy("state", "p").agg(F.sum("area").alias("area")), "state", "p", 10.0))

query("A29", "weighted_moments", f"""
  with m as (select state, sum(area) as w, sum(area*p)/sum(area) as mp, sum(area*f)/sum(area) as mf, sum(area*p*p)/sum(area) as pp, sum(area*f*f)/sum(area) as ff, sum(area*p*f)/sum(area) as pf from ({_HIST}) group by 1)
  select state, round(mp,6) as mean_p, round(mf,6) as mean_f, round(pf-mp*mf,6) as cov, round((pf-mp*mf)/sqrt((pp-mp*mp)*(ff-mf*mf)),6) as corr from m
""")(lambda t: R.weighted_moments(hist(t), ["state"], "p", "f", "area"))

query("A30", "calibration_bands", f"select least(p//2, 4) as band, round(sum(f*area)/sum(area),6) as mean_f, sum(area) as area from ({_HIST}) group by 1")(
    lambda t: hist(t).groupBy(F.least(F.floor(F.col("p") / 2), F.lit(4)).alias("band")).agg(r6(F.sum(F.col("f") * F.col("area")) / F.sum("area")).alias("mean_f"), F.sum("area").alias("area")))

query("C15", "reference_intercomparison", f"""
  with h as ({_HIST}), m as (select state, sum(case when p>=5 and f>=4 then area else 0 end) as a, sum(case when p>=5 and f<4 then area else 0 end) as b, sum(case when p<5 and f>=4 then area else 0 end) as c, sum(case when p<5 and f<4 then area else 0 end) as d from h group by 1)
  select state, a, b, c, d, round(a/(a+b+c),6) as iou, round((a+d)/(a+b+c+d),6) as agreement, (a+b)-(a+c) as bias from m
""")(lambda t: (lambda x: x.select("state", "a", "b", "c", "d", r6(M.two_by_two(*(F.col(k) for k in "abcd"))["iou"]).alias("iou"), r6(M.two_by_two(*(F.col(k) for k in "abcd"))["agreement"]).alias("agreement"), ((F.col("a") + F.col("b")) - (F.col("a") + F.col("c"))).alias("bias")))(
    R.cross_areas(hist(t), ["state"], F.col("p") >= 5, F.col("f") >= 4, "area")))

query("A57", "enrichment", """
  with g as (select cls, median(ha) as med from fx_mapped group by 1) select g.cls, round(g.med,4) as med, round(g.med/b.med,6) as enrichment from g, (select med from g where cls='Cereal') b
""")(lambda t: R.enrichment(t.mapped, "cls", "ha", "Cereal"))

query("A58 A59", "column_argmax", f"""
  select region, yr, case when greatest(canola,cereal,legume)=canola then 'canola' when greatest(canola,cereal,legume)=cereal then 'cereal' else 'legume' end as top, greatest(canola,cereal,legume) as most from (select region, yr, {_WIDE} from fx_mapped group by 1,2)
""")(lambda t: R.column_argmax(R.pivot_classes(t.mapped, ["region", "yr"], CROPS), [c.lower() for c in CROPS]).select("region", "yr", "top", "most"))

query("A60", "describe", "select cls, round(quantile_cont(ha,0.25),6) as q1, round(median(ha),6) as q2, round(quantile_cont(ha,0.75),6) as q3 from fx_mapped group by 1")(
    lambda t: t.mapped.groupBy("cls").agg(F.percentile("ha", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).select("cls", *(r6(F.col("q")[i]).alias(f"q{i + 1}") for i in range(3))))

query("A66", "area_by_class_year", f"select yr, {_WIDE} from fx_mapped group by 1")(lambda t: R.pivot_classes(t.mapped, ["yr"], CROPS))

query("C14 T16", "score_filter_sweep", """
  with q as (select unnest([0.0,0.25,0.5])::double as q),
  c as (select 0.0::double as q, quantile_cont(ha,0.0) as cut from fx_mapped union all select 0.25, quantile_cont(ha,0.25) from fx_mapped union all select 0.5, quantile_cont(ha,0.5) from fx_mapped),
  k as (select q, cls, sum(ha) as ha from fx_mapped, c where ha>=cut group by 1,2),
  r as (select q, cls, sum(ha)/5 as ha from fx_mapped, q, (select unnest(range(5)) as rep) where ((region*7919+yr*104729+ascii(cls)*31+rep*1299709)%1000003)/1000003.0::double >= q group by 1,2)
  select k.q, k.cls, round(k.ha,4) as ha, round(r.ha,4) as random_ha from k left join r using (q, cls)
""")(lambda t: R.filter_sweep(t.mapped, [0.0, 0.25, 0.5], 5))

query("C40 A20 A21", "crosstab_with_margins", """
  select coalesce(truth,'All') as truth, coalesce(pred,'All') as pred, count(*) as n, round(100.0::double*count(*)/sum(count(*)) over (partition by grouping(truth,pred), truth),6) as pct from fx_pred group by cube(truth, pred)
""")(lambda t: (lambda c: c.select("truth", "pred", "n", r6(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("g", "truth"))).alias("pct")))(
    t.pred.cube("truth", "pred").agg(F.count("*").alias("n"), F.grouping_id().alias("g")).select(F.coalesce("truth", F.lit("All")).alias("truth"), F.coalesce("pred", F.lit("All")).alias("pred"), "n", "g")))

query("A61", "majority_class_per_cell", """
  select cx, cy, pred from (select cast(floor(x0/30.0) as bigint) as cx, cast(floor(y0/30.0) as bigint) as cy, pred, row_number() over (partition by cast(floor(x0/30.0) as bigint), cast(floor(y0/30.0) as bigint) order by count(*) desc, pred) as rn from fx_poly group by 1,2,3) where rn=1
""")(lambda t: R.winner(t.poly.groupBy(F.floor(F.col("x0") / 30).alias("cx"), F.floor(F.col("y0") / 30).alias("cy"), "pred").agg(F.count("*").alias("n")), ["cx", "cy"], "pred", "n").select("cx", "cy", "pred"))

query("A70", "percentile_stretch", "select poly_id, round(greatest(least((area_ha-a)/(b-a),1),0),6) as v from fx_poly, (select quantile_cont(area_ha,0.01) as a, quantile_cont(area_ha,0.99) as b from fx_poly)")(
    lambda t: R.stretched(t.poly, "area_ha").select("poly_id", r6("stretched").alias("v")))
