"""Queries for the composites: classification, merges between tiles, identity over years, audits and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import indices as X
from furrow.functions.scalars import r6
from furrow.operators import geometry as G
from furrow.operators import identity as I
from furrow.operators import merge as M
from furrow.operators import series as S
from furrow.operators import spatial as J
from furrow.plans.q_series import CFI, NDVI
from furrow.plans.q_spatial import PAIRS, YEAR_PAIRS, year_pairs
from furrow.plans.registry import query

_CELL = "case when (x0+x1)/2.0/20 is null then 0 else cast(floor({a}/2.0/20) as bigint) end"
_HOME = f"select *, {_CELL.format(a='(x0+x1)')} as home_kx, {_CELL.format(a='(y0+y1)')} as home_ky, coalesce(abstain_reason,'') as reason from fx_poly"
_W = "(a.area_ha*a.p_{c}+b.area_ha*b.p_{c})/(a.area_ha+b.area_ha)"
_RULE = f"""round({_W.format(c='canola')},9) as w1, round({_W.format(c='cereal')},9) as w2, round({_W.format(c='legume')},9) as w3, least(a.p_canola,b.p_canola) as l1, least(a.p_cereal,b.p_cereal) as l2, least(a.p_legume,b.p_legume) as l3"""
_WINNER = "case when w1>=w2 and w1>=w3 then 'Canola' when w2>=w3 then 'Cereal' else 'Legume' end"
_PMIN = "case when w1>=w2 and w1>=w3 then l1 when w2>=w3 then l2 else l3 end"
_WHY = "case when a_pred=b_pred then 'same_class' when winner<>a_pred and winner<>b_pred then 'conflict_no_majority_class' when pmin<0.15 then 'conflict_confident_disagreement' else 'class_conflict_reconciled' end"
#: Pairs with what both decisions need; the perimeter of a union of two boxes is the sum less that of their intersection.
_MET = f"""select a.poly_id as a, b.poly_id as b, i, aa, ab, a_pred, b_pred, a_reason, b_reason, (2*(aw+ah)+2*(bw+bh)-2*(iw+ih))/sqrt(cast(aa+ab-i as double)) as comp, {_WINNER} as winner, {_PMIN} as pmin, akx, aky, bkx, bky from (
  select a, b, iw*ih as i, aw*ah as aa, bw*bh as ab, * from (
  select a, b, a.pred as a_pred, b.pred as b_pred, a.reason as a_reason, b.reason as b_reason, a.kx as akx, a.ky as aky, b.kx as bkx, b.ky as bky, a.x1-a.x0 as aw, a.y1-a.y0 as ah, b.x1-b.x0 as bw, b.y1-b.y0 as bh,
    least(a.x1,b.x1)-greatest(a.x0,b.x0) as iw, least(a.y1,b.y1)-greatest(a.y0,b.y0) as ih, {_RULE}
  from h a join h b on a.poly_id<>b.poly_id and a.x0<b.x1 and b.x0<a.x1 and a.y0<b.y1 and b.y0<a.y1 where {{cond}}))"""

query("C3", "away_decisions", f"""
  with h as ({_HOME}), hh as (select *, home_kx<>kx or home_ky<>ky as away from h),
  m as ({_MET.format(cond="(a.home_kx<>a.kx or a.home_ky<>a.ky) and not (b.home_kx<>b.kx or b.home_ky<>b.ky) and (a.reason<>'' or b.reason in ('','no_crop_signal'))")}),
  c as (select p.poly_id as a, count(*) as covered from fx_px p where exists (select 1 from m join fx_px o on o.poly_id=m.b where m.a=p.poly_id and o.px=p.px and o.py=p.py) group by 1),
  t as (select *, count(*) over (partition by a) as n_covering, row_number() over (partition by a order by i desc, b) as rn from m),
  j as (select hh.poly_id as fid, (x1-x0)*(y1-y0)*1.0::double as area, coalesce(t.n_covering,0) as n_covering, coalesce(c.covered,0)/((x1-x0)*(y1-y0)*1.0::double) as coverage, t.* from hh left join t on t.a=hh.poly_id and t.rn=1 left join c on c.a=hh.poly_id where away),
  d as (select *, {_WHY} as why from j),
  e as (select *, case when coverage<0.5 then 'rescue' when b is null then 'drop_partial' when coverage>=0.95 then 'drop_duplicate' when a_reason<>'' or b_reason<>'' then 'drop_partial' when i/area<0.6 then 'drop_partial' when comp>8 then 'drop_partial' when why in ('same_class','class_conflict_reconciled') then 'union_into_twin' else 'drop_partial' end as decision,
    case when coverage<0.5 then 'uncovered' when b is null then 'no_twin_no_rescue' when coverage>=0.95 then 'fully_covered' when a_reason<>'' or b_reason<>'' then 'not_both_classified' when i/area<0.6 then 'no_single_twin' when comp>8 then 'union_over_max_compactness' else why end as reason from d)
  select fid, n_covering, round(coverage,6) as coverage, b as twin_fid, round(i/area,6) as twin_frac, round(i/(area+ab-i),6) as twin_iou, decision, reason, round(case when decision in ('drop_partial','drop_duplicate') then area*0.01*(1-coverage) else 0 end,6) as lost_ha from e
""")(lambda t: M.away_decisions(t.poly, t.px).select("fid", "n_covering", *(r6(c).alias(c) for c in ("coverage", "twin_frac", "twin_iou", "lost_ha")), "twin_fid", "decision", "reason"))

_KEPT = "not (a.home_kx<>a.kx or a.home_ky<>a.ky) and not (b.home_kx<>b.kx or b.home_ky<>b.ky) and a.poly_id<b.poly_id and (a.kx<>b.kx or a.ky<>b.ky)"
_UNION = f"""h as ({_HOME}), m as ({_MET.format(cond=_KEPT)}), w as (select *, {_WHY} as why from m),
  p as (select *, i/cast(least(aa,ab) as double) as ovl, case when i/cast(least(aa,ab) as double)<0.2 then 'leave' when a_reason<>'' or b_reason<>'' then 'leave' when comp>8 then 'leave' when why in ('same_class','class_conflict_reconciled') then 'merge' else 'leave' end as decision,
    case when i/cast(least(aa,ab) as double)<0.2 then 'sliver_below_ovl_min' when a_reason<>'' or b_reason<>'' then 'not_both_classified' when comp>8 then 'union_over_max_compactness' else why end as reason from w)"""
query("C4", "union_pairs", f"with {_UNION} select a, b, i as inter_px, round(ovl,6) as ovl_small, round(comp,6) as union_comp, winner as merged_class, round(pmin,6) as pmin_winner, decision, reason from p")(
    lambda t: M.union_pairs(t.poly, t.px, ovl_min=0.2).select("a", "b", "inter_px", r6("ovl_small").alias("ovl_small"), r6("union_comp").alias("union_comp"), "merged_class", r6("pmin_winner").alias("pmin_winner"), "decision", "reason"))

_CC = "e as (select a, b from {p} union all select b, a from {p}), r as (select a as id, a as c from e union select e.b, r.c from r join e on r.id=e.a where r.c<e.b), l as (select id, min(c) as c from r group by 1)"
query("C4", "union_features", f"""
  with recursive {_UNION}, q as (select a, b from p where decision='merge'), {_CC.format(p='q')},
  n as (select l.c as component, l.id, f.area_ha, f.pred, f.p_canola, f.p_cereal, f.p_legume from l join fx_poly f on f.poly_id=l.id),
  s as (select component, count(*) as merge_n, string_agg(cast(id as varchar), ';' order by id) as merged_from_fid, sum(area_ha) as frag_area_ha, count(distinct pred) as k, round(sum(area_ha*p_canola)/sum(area_ha),9) as w1, round(sum(area_ha*p_cereal)/sum(area_ha),9) as w2, round(sum(area_ha*p_legume)/sum(area_ha),9) as w3,
    min(p_canola) as l1, min(p_cereal) as l2, min(p_legume) as l3, list(distinct pred) as preds from n group by 1), g as (select component, count(*)*0.01 as area_ha from (select distinct n.component, px, py from n join fx_px x on x.poly_id=n.id) group by 1),
  z as (select s.*, g.area_ha, {_WINNER} as winner, {_PMIN} as pmin from s join g using (component))
  select component, merge_n, merged_from_fid, round(frag_area_ha,6) as frag_area_ha, round(area_ha,6) as area_ha, winner as pred, k>1 as class_conflict from z where merge_n<=4 and not (k>1 and (not list_contains(preds, winner) or pmin<0.15))
""")(lambda t: M.union_merges(t.poly, t.px, ovl_min=0.2)[1].withColumn("frag_area_ha", r6("frag_area_ha")).withColumn("area_ha", r6("area_ha")))

query("C5", "clip_to_owner", """
  with w as (select x.poly_id, row_number() over (partition by px, py order by (floor(px/20.0)=p.kx and floor(py/20.0)=p.ky) desc, (x1-x0)*(y1-y0) desc, x.poly_id) as rn, (x1-x0)*(y1-y0) as n from fx_px x join fx_poly p on p.poly_id=x.poly_id), l as (select poly_id, n as n_px, count(*) filter (rn>1) as lost_px from w group by 1,2)
  select poly_id, n_px, lost_px, lost_px>0 and lost_px<=0.5*n_px as clipped, case when lost_px<=0.5*n_px then n_px-lost_px else n_px end as left_px from l
""")(lambda t: M.clipped(t.poly, t.px))

_OVER = f"q as (select a, b from ({PAIRS}) where a<b and inter_px>1)"
query("C6 C7 S17", "overlap_groups", f"""
  with recursive {_OVER}, {_CC.format(p='q')}, g as (select f.*, coalesce(l.c, f.poly_id) as grp from fx_poly f left join l on l.id=f.poly_id), k as (select *, row_number() over (partition by grp order by area_ha desc, poly_id) as rn from g),
  u as (select grp, count(*)*0.01 as ha from (select distinct grp, px, py from fx_px x join g on g.poly_id=x.poly_id) group by 1), f as (select grp, count(*) as merge_n, coalesce(string_agg(cast(poly_id as varchar), ',' order by poly_id) filter (rn>1),'') as merged_from from k group by 1)
  select k.poly_id, merge_n, merged_from, round(u.ha,6) as area_ha, case when not (merge_n>1 and u.ha>2.5) then pred end as pred, case when merge_n>1 and u.ha>2.5 then 'unsegmented_blob' else abstain_reason end as abstain_reason from k join u using (grp) join f using (grp) where rn=1
""")(lambda t: M.overlap_groups(t.poly, t.px, 1, 2.5).withColumn("area_ha", r6("area_ha")))

_YP = f"yp as (select a, yr, b, other, i/cast(area_a+area_b-i as double) as iou, i/cast(least(area_a,area_b) as double) as contain from ({YEAR_PAIRS}))"
_STAB = f"""{_YP}, q as (select a*10000+yr as a, b*10000+other as b from yp where iou>=0.5), {_CC.format(p='q')},
  s0 as (select p.poly_id as a, p.yr, y.o, coalesce(max(yp.iou),0) as iou from fx_poly_year p join (select unnest([2017,2018,2019,2020,2021]) as o) y on y.o<>p.yr left join yp on yp.a=p.poly_id and yp.yr=p.yr and yp.other=y.o group by 1,2,3),
  st as (select s0.a, s0.yr, count(*) filter (iou>=0.5) as n_years, median(iou) as median_iou, avg(iou) filter (iou>=0.5) as mean_iou_hits, coalesce(max(l.c), s0.a*10000+s0.yr) as paddock_id from s0 left join l on l.id=s0.a*10000+s0.yr group by 1,2)"""
YEARS = list(range(2017, 2022))


def stable(t):
    return I.stability(year_pairs(t), t.poly_year, YEARS)


query("C9", "stability", f"with recursive {_STAB} select a, yr, n_years, round(median_iou,6) as median_iou, round(mean_iou_hits,6) as mean_iou_hits, paddock_id from st")(
    lambda t: stable(t).withColumn("median_iou", r6("median_iou")).withColumn("mean_iou_hits", r6("mean_iou_hits")))

query("C10", "stability_report", f"with recursive {_STAB} select n_years, case when area_ha<=0.4 then '(0,0.4]' when area_ha<=0.8 then '(0.4,0.8]' else '(0.8,2]' end as size_bin, count(*) as n, round(median(median_iou),6) as med_iou from st join fx_poly on poly_id=a group by 1,2")(
    lambda t: _stability_report(t))


def _stability_report(t):
    from furrow.functions.scalars import right_closed_bin

    return stable(t).join(t.poly.select(F.col("poly_id").alias("a"), "area_ha"), "a").groupBy("n_years", right_closed_bin(F.col("area_ha"), [0, 0.4, 0.8, 2]).alias("size_bin")).agg(F.count("*").alias("n"), r6(F.median("median_iou")).alias("med_iou"))


_CROP = "case (poly_id+yr)%3 when 0 then 'Canola' when 1 then 'Cereal' else 'Legume' end"


def _members(t):
    k, y = F.col("poly_id"), F.col("yr")
    crop = F.when((k + y) % 3 == 0, "Canola").when((k + y) % 3 == 1, "Cereal").otherwise("Legume")
    polys = t.poly_year.select(k.alias("a"), "yr", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * 0.01).alias("area_ha"), crop.alias("crop"), ((k * 7 + y) % 10 / 10.0).alias("conf"))
    return stable(t).join(polys, ["a", "yr"]).withColumn("id", F.col("a"))


_MEMB = f"mb as (select st.paddock_id, st.yr, st.a as id, st.n_years, (x1-x0)*(y1-y0)*0.01::double as area_ha, {_CROP.replace('+yr', '+p.yr')} as crop, ((poly_id*7+p.yr)%10)/10.0::double as conf from st join fx_poly_year p on p.poly_id=st.a and p.yr=st.yr)"
query("C11", "rotation_plausibility", f"""
  with recursive {_STAB}, {_MEMB}, g as (select paddock_id, count(distinct yr) as years, count(distinct crop) as classes, count(*) filter (crop='Canola') as canola, bool_and(n_years>=3) as steady from mb group by 1)
  select steady, count(*) as n, round(avg(classes),6) as mean_classes, sum(canola)::bigint as canola_years, round(avg(case when classes=1 then 1.0::double else 0 end),6) as single from g where years>=4 group by 1
""")(lambda t: _members(t).groupBy("paddock_id").agg(F.count_distinct("yr").alias("years"), F.count_distinct("crop").alias("classes"), F.count_if(F.col("crop") == "Canola").alias("canola"), F.bool_and(F.col("n_years") >= 3).alias("steady")).where("years >= 4").groupBy("steady").agg(
    F.count("*").alias("n"), r6(F.avg("classes")).alias("mean_classes"), F.sum("canola").alias("canola_years"), r6(F.avg((F.col("classes") == 1).cast("double"))).alias("single")))

query("C12", "consensus", f"""
  with recursive {_STAB}, {_MEMB}, w as (select * from (select paddock_id, yr, crop, avg(conf) as conf, row_number() over (partition by paddock_id, yr order by sum(area_ha) desc, crop) as rn from mb group by 1,2,3) where rn=1),
  rep as (select paddock_id, id as rep_id, yr as from_year, area_ha from (select *, row_number() over (partition by paddock_id order by area_ha desc, id) as rn from mb) where rn=1 and area_ha>=0.3),
  k as (select paddock_id, {', '.join(f"max(crop) filter (yr={y}) as crop_{y}, round(max(conf) filter (yr={y}),6) as conf_{y}" for y in YEARS)}, count(*) as n_class_years, count(distinct crop) as n_classes, count(*) filter (crop='Canola') as canola_years,
    concat_ws('-', {', '.join(f"coalesce(substring(max(crop) filter (yr={y}),1,2),'.')" for y in YEARS)}) as crop_seq from w group by 1),
  m as (select paddock_id, crop as modal_crop from (select paddock_id, crop, row_number() over (partition by paddock_id order by count(*) desc, crop) as rn from w group by 1,2) where rn=1)
  select paddock_id, rep_id, round(area_ha,6) as area_ha, k.* exclude (paddock_id), modal_crop from rep join k using (paddock_id) join m using (paddock_id)
""")(lambda t: _consensus(t))


def _consensus(t):
    got = I.consensus(_members(t), YEARS, 0.3)
    return got.select("paddock_id", "rep_id", r6("area_ha").alias("area_ha"), *(f"crop_{y}" for y in YEARS), *(r6(f"conf_{y}").alias(f"conf_{y}") for y in YEARS), "n_class_years", "n_classes", "canola_years", "crop_seq", "modal_crop")


query("C8", "constrained_identity")(lambda t: I.constrained_groups(
    year_pairs(t).where("iou >= 0.5").select((F.col("a") * 10000 + F.col("yr")).alias("a"), (F.col("b") * 10000 + F.col("other")).alias("b"), "iou"),
    t.poly_year.select((F.col("poly_id") * 10000 + F.col("yr")).alias("id"), "ky", "x0", "y0", "x1", "y1", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area")), "ky", 22.0, 2.0))

_SCORES = "4*coalesce({c}__p90,0)", "coalesce({n}__amp,0)", "0.3"
_FEAT = f"""ft as (select trial_id, quantile_cont(c,0.9) as c90, quantile_cont(n,0.9)-quantile_cont(n,0.1) as amp from (select trial_id, cast(floor((doy-90)/20.0) as integer) as bin, median({CFI}) as c, median({NDVI}) as n from fx_ts where doy>=90 and doy<350 group by 1,2) group by 1),
  ob as (select trial_id, count(*) as n_obs, sum(n_clear)/cast(sum(n_px) as double) as clear_frac, quantile_cont({NDVI},0.9)-quantile_cont({NDVI},0.1) as ndvi_amp from fx_ts group by 1)"""
MODEL = {"Canola": {"cfi__p90": 4.0}, "Cereal": {"ndvi__amp": 1.0}, "Legume": {"": 0.3}}


def classified(features, model: dict[str, dict[str, float]]):
    """Class probabilities by softmax of linear scores, the class of the largest, and its probability."""
    score = {c: sum((w * (F.coalesce(F.col(f), F.lit(0.0)) if f else F.lit(1.0)) for f, w in ws.items()), F.lit(0.0)) for c, ws in model.items()}
    total = sum((F.exp(s) for s in score.values()), F.lit(0.0))
    out = features.withColumns({f"p_{c.lower()}": F.exp(s) / total for c, s in score.items()})
    best = F.greatest(*(F.round(f"p_{c.lower()}", 9) for c in model))
    return out.withColumn("raw_pred", F.coalesce(*(F.when(F.round(f"p_{c.lower()}", 9) == best, F.lit(c)) for c in model))).withColumn("confidence", F.greatest(*(F.col(f"p_{c.lower()}") for c in model)))


query("C1", "wall_to_wall_classify", f"""
  with {_FEAT}, s as (select ft.*, exp({_SCORES[0].format(c='c90').replace('c90__p90', 'c90')}) as e1, exp({_SCORES[1].format(n='amp').replace('amp__amp', 'amp')}) as e2, exp({_SCORES[2]}) as e3 from ft),
  p as (select trial_id, e1/(e1+e2+e3) as a, e2/(e1+e2+e3) as b, e3/(e1+e2+e3) as c from s),
  j as (select ob.trial_id, n_obs, clear_frac, ndvi_amp, a, b, c, case when round(a,9)>=round(b,9) and round(a,9)>=round(c,9) then 'Canola' when round(b,9)>=round(c,9) then 'Cereal' else 'Legume' end as raw_pred, greatest(a,b,c) as conf from ob left join p using (trial_id)),
  r as (select *, case when n_obs<32 then 'too_few_observations' when coalesce(ndvi_amp,0)<0.35 then 'no_crop_signal' when not coalesce(conf>=0.4,false) then 'no_crop_shape' else '' end as abstain_reason from j)
  select trial_id, n_obs, round(clear_frac,6) as clear_frac, round(ndvi_amp,6) as ndvi_amp, round(a,6) as p_canola, round(b,6) as p_cereal, round(c,6) as p_legume, round(conf,6) as confidence, abstain_reason, case when abstain_reason='' then raw_pred end as pred from r
""")(lambda t: _classify(t))


def _classify(t):
    from furrow.operators.filters import first_reason

    per = t.ts.groupBy("trial_id").agg(F.count("*").alias("n_obs"), (F.sum("n_clear") / F.sum("n_px").cast("double")).alias("clear_frac"), S.spread(X.ndvi(), 0.1, 0.9).alias("ndvi_amp"))
    scored = per.join(classified(S.feature_table(t.ts, {"ndvi": X.ndvi(), "cfi": X.cfi()}), MODEL), "trial_id", "left")
    reason = first_reason([(F.col("n_obs") < 32, "too_few_observations"), (F.coalesce("ndvi_amp", F.lit(0.0)) < 0.35, "no_crop_signal"), (~F.coalesce(F.col("confidence") >= 0.4, F.lit(False)), "no_crop_shape")])
    return scored.withColumn("abstain_reason", reason).select("trial_id", "n_obs", *(r6(c).alias(c) for c in ("clear_frac", "ndvi_amp", "p_canola", "p_cereal", "p_legume", "confidence")), "abstain_reason", F.when(F.col("abstain_reason") == "", F.col("raw_pred")).alias("pred"))


query("C16", "map_versus_map", f"""
  with b as (select poly_id, kx, x0, y0, x1, y1, {_CROP} as pred from fx_poly_year where yr=2019),
  m as (select a.kx, a.poly_id, max((least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0))/cast((a.x1-a.x0)*(a.y1-a.y0)+(b.x1-b.x0)*(b.y1-b.y0)-(least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0)) as double)) as iou
    from fx_poly a join b on a.x0<b.x1 and b.x0<a.x1 and a.y0<b.y1 and b.y0<a.y1 group by 1,2)
  select kx, n_a, n_b, round(ha_a,6) as canola_a, round(ha_b,6) as canola_b, round(med,6) as med_iou from (select kx, count(*) as n_a, sum(case when pred='Canola' then area_ha else 0 end) as ha_a from fx_poly group by 1)
  join (select kx, count(*) as n_b, sum(case when pred='Canola' then (x1-x0)*(y1-y0)*0.01 else 0 end) as ha_b from b group by 1) using (kx) join (select kx, median(iou) as med from m group by 1) using (kx)
""")(lambda t: _map_versus_map(t))


def _map_versus_map(t):
    k, y = F.col("poly_id"), F.col("yr")
    b = t.poly_year.where("yr = 2019").withColumn("pred", F.when((k + y) % 3 == 0, "Canola").when((k + y) % 3 == 1, "Cereal").otherwise("Legume"))
    size = lambda s: (F.col(f"{s}_x1") - F.col(f"{s}_x0")) * (F.col(f"{s}_y1") - F.col(f"{s}_y0"))
    i = F.col("inter_px")
    best = J.box_pairs(t.poly.select("poly_id", "kx", "x0", "y0", "x1", "y1"), b.select("poly_id", "x0", "y0", "x1", "y1")).groupBy(F.col("a_kx").alias("kx"), "a_poly_id").agg(F.max(i / (size("a") + size("b") - i).cast("double")).alias("iou"))
    ha = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * 0.01
    pa = t.poly.groupBy("kx").agg(F.count("*").alias("n_a"), r6(F.sum(F.when(F.col("pred") == "Canola", F.col("area_ha")).otherwise(0.0))).alias("canola_a"))
    pb = b.groupBy("kx").agg(F.count("*").alias("n_b"), r6(F.sum(F.when(F.col("pred") == "Canola", ha).otherwise(0.0))).alias("canola_b"))
    return pa.join(pb, "kx").join(best.groupBy("kx").agg(r6(F.median("iou")).alias("med_iou")), "kx").select("kx", "n_a", "n_b", "canola_a", "canola_b", "med_iou")


query("C17", "boundary_source_comparison", """
  with b as (select poly_id, x0, y0, x1, y1, (x1-x0)*(y1-y0) as n from fx_poly_year where yr=2020 and (x1-x0)*(y1-y0) between 30 and 120),
  s as (select p.trial, p.x, p.y from (select poly_id*10+1 as trial, (x0+x1)/2.0::double as x, (y0+y1)/2.0::double as y from fx_poly) p), j as (select s.trial, b.poly_id, b.n, row_number() over (partition by s.trial order by b.n, b.poly_id) as rn from s left join b on x>=x0 and x<x1 and y>=y0 and y<y1)
  select count(*) as n_points, count(poly_id) as n_inside, round(count(poly_id)/cast(count(*) as double),6) as share, round(median(n),6) as med_px from j where rn=1
""")(lambda t: _boundaries(t))


def _boundaries(t):
    n = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    b = t.poly_year.where("yr = 2020").withColumn("n", n).where("n between 30 and 120").select("poly_id", "n", "x0", "y0", "x1", "y1")
    pts = t.poly.select((F.col("poly_id") * 10 + 1).alias("trial"), ((F.col("x0") + F.col("x1")) / 2.0).alias("x"), ((F.col("y0") + F.col("y1")) / 2.0).alias("y"))
    one = J.one_each(J.point_in_box(pts, b, "left"), ["trial"], F.col("n").asc_nulls_last(), F.col("poly_id").asc_nulls_last())
    return one.agg(F.count("*").alias("n_points"), F.count("poly_id").alias("n_inside"), r6(F.count("poly_id") / F.count("*").cast("double")).alias("share"), r6(F.median("n")).alias("med_px"))


query("C18", "seam_audit", """
  with h as (select *, coalesce(abstain_reason,'') as reason, 10*((case when x0%20=0 then y1-y0 else 0 end)+(case when x1%20=0 then y1-y0 else 0 end)+(case when y0%20=0 then x1-x0 else 0 end)+(case when y1%20=0 then x1-x0 else 0 end)) as edge_m from fx_poly),
  s0 as (select poly_id, kx, ky, pred, x0, x1, y0, y1, unnest(range(x0-3,x1+3)) as px from h where edge_m>=40), s1 as (select *, unnest(range(y0-3,y1+3)) as py from s0),
  s as (select poly_id, pred, px, py from s1 where not (px>=x0 and px<x1 and py>=y0 and py<y1) and (floor(px/20.0)<>kx or floor(py/20.0)<>ky)),
  k as (select s.poly_id, s.px, s.py, max(case when o.poly_id is null then 0 when o.reason<>'' then 1 when o.pred<>s.pred then 2 else 3 end) as k from s left join h o on o.poly_id<>s.poly_id and s.px>=o.x0 and s.px<o.x1 and s.py>=o.y0 and s.py<o.y1 group by 1,2,3),
  f as (select poly_id, count(*) as strip_px, avg(case when k=3 then 1.0::double else 0 end) as fs, avg(case when k=2 then 1.0::double else 0 end) as fo, avg(case when k=1 then 1.0::double else 0 end) as fa, avg(case when k=0 then 1.0::double else 0 end) as fn from k group by 1)
  select h.poly_id, edge_m, edge_m>=40 as truncated, strip_px, round(fs,6) as fill_same, round(fo,6) as fill_other, round(fa,6) as fill_abst, round(fn,6) as fill_none,
    case when strip_px is null then '' when fs>=0.5 then 'same' when fo>=0.5 then 'other' when fa>=0.5 then 'abst' when fn>=0.5 then 'none' else 'mixed' end as beyond_cut from h left join f using (poly_id)
""")(lambda t: (lambda a: a.select("poly_id", "edge_m", "truncated", "strip_px", *(r6(f"fill_{k}").alias(f"fill_{k}") for k in ("same", "other", "abst", "none")), "beyond_cut"))(M.seam_audit(t.poly, t.px)))

query("C19", "cut_continuity", """
  with r0 as (select poly_id, x0, x1, y0, y1, unnest(range(x0-1,x1+1)) as px from fx_poly), r1 as (select *, unnest(range(y0-1,y1+1)) as py from r0),
  v as (select poly_id, px>=x0 and px<x1 and py>=y0 and py<y1 as inside, (((px*31+py*17)%23)+23)%23*1.0::double as v from r1 where px in (x0-1,x0,x1-1,x1) or py in (y0-1,y0,y1-1,y1))
  select poly_id, round(abs(avg(case when inside then v end)-avg(case when not inside then v end))/sqrt((pow(stddev_pop(case when inside then v end),2)+pow(stddev_pop(case when not inside then v end),2))/2),6) as contrast from v group by 1
""")(lambda t: _continuity(t))


def _continuity(t):
    from furrow.operators.metrics import contrast

    own = t.px.select("poly_id", "px", "py")
    rim = G.with_core(own).where("not core").drop("core").withColumn("inside", F.lit(True))
    ring = G.ring(own).withColumn("inside", F.lit(False))
    v = F.pmod(F.col("px") * 31 + F.col("py") * 17, F.lit(23)).cast("double")
    side = lambda f, c: f(F.when(c, v))
    i = F.col("inside")
    return rim.unionByName(ring).groupBy("poly_id").agg(r6(contrast(side(F.avg, i), side(F.stddev_pop, i), side(F.avg, ~i), side(F.stddev_pop, ~i))).alias("contrast"))


_DONOR = "case yr when 2019 then 1 when 2020 then 2 else 3 end"
query("C20", "cross_year_repair", f"""
  with t as (select poly_id, x0, y0, x1, y1, (x1-x0)*(y1-y0) as own from fx_poly_year where yr=2018), d as (select poly_id as donor, {_DONOR} as rank, x0, y0, x1, y1 from fx_poly_year where yr in (2019,2020)),
  p as (select t.poly_id, donor, rank, own, (least(t.x1,d.x1)-greatest(t.x0,d.x0))*(least(t.y1,d.y1)-greatest(t.y0,d.y0)) as i, d.x0, d.y0, d.x1, d.y1 from t join d on t.x0<d.x1 and d.x0<t.x1 and t.y0<d.y1 and d.y0<t.y1),
  c as (select * from (select *, row_number() over (partition by poly_id, rank order by i desc, donor) as rn from p) where rn=1), cx as (select poly_id, rank, unnest(range(x0,x1)) as px, y0, y1 from c), cp as (select poly_id, rank, px, unnest(range(y0,y1)) as py from cx),
  ad as (select poly_id, rank, count(*) as added from cp where not exists (select 1 from t where cp.px>=t.x0 and cp.px<t.x1 and cp.py>=t.y0 and cp.py<t.y1) group by 1,2),
  k as (select c.poly_id, c.rank, c.donor, coalesce(added,0) as added_px, case when i/cast(own as double)<0.8 then 'donor_cover_below_min' when coalesce(added,0)=0 then 'nothing_to_add' when added<4 then 'added_below_min' when added>3*own then 'added_over_ratio' when own+added>30000 then 'result_over_max_area' else 'repaired' end as reason from c left join ad using (poly_id, rank)),
  w as (select *, row_number() over (partition by poly_id order by case when reason='repaired' then 0 else 1 end, case when reason='repaired' then rank else -rank end) as rn from k)
  select t.poly_id, case when reason='repaired' then donor end as donor, case when reason='repaired' then rank end as donor_rank, case when reason='repaired' then added_px else 0 end as added_px, coalesce(reason,'no_donor_overlap') as reason from t left join w on w.poly_id=t.poly_id and w.rn=1
""")(lambda t: (lambda y, d: M.grafts(y, G.pixels(y), d, G.pixels(d)))(t.poly_year.where("yr = 2018").select("poly_id", "x0", "y0", "x1", "y1"),
    t.poly_year.where("yr in (2019, 2020)").select("poly_id", (F.col("yr") - 2018).alias("rank"), "x0", "y0", "x1", "y1")))

query("C21", "cross_year_wholeness", f"""
  with {_YP}, b as (select p.poly_id, max(yp.iou) as iou from fx_poly_year p left join yp on yp.a=p.poly_id and yp.yr=2018 and yp.other=2019 where p.yr=2018 group by 1)
  select case when poly_id%4=0 then 'union' when poly_id%4=1 then 'clipped' else 'untouched' end as action, count(*) as n, round(median(coalesce(iou,0)),6) as med_iou, round(avg(case when coalesce(iou,0)>=0.7 then 1.0::double else 0 end),6) as whole from b group by 1
""")(lambda t: t.poly_year.where("yr = 2018").select("poly_id").join(year_pairs(t).where("yr = 2018 and other = 2019").groupBy(F.col("a").alias("poly_id")).agg(F.max("iou").alias("iou")), "poly_id", "left").withColumn("iou", F.coalesce("iou", F.lit(0.0))).groupBy(
    F.when(F.col("poly_id") % 4 == 0, "union").when(F.col("poly_id") % 4 == 1, "clipped").otherwise("untouched").alias("action")).agg(F.count("*").alias("n"), r6(F.median("iou")).alias("med_iou"), r6(F.avg((F.col("iou") >= 0.7).cast("double"))).alias("whole")))

query("C33 J30", "tile_selection", """
  with b as (select cast(floor(px/20.0) as bigint) as gx, cast(floor(py/20.0) as bigint) as gy, max(case when poly_id%2=0 then 0.8::double else 0.3 end) as most, avg(case when poly_id%2=0 then 0.8::double else 0.3 end) as mean from (select px, py, max(poly_id) as poly_id from fx_px group by 1,2) group by 1,2)
  select gx, gy, cast(floor(gx/2.0) as bigint) as block_c, cast(floor(gy/2.0) as bigint) as block_r, round(mean,6) as expected from b where most>=0.5
""")(lambda t: G.resample(G.rasterise(t.px).withColumn("v", F.when(F.col("poly_id") % 2 == 0, 0.8).otherwise(0.3)), "v", 20).where("most >= 0.5").select(
    F.col("bx").alias("gx"), F.col("by").alias("gy"), F.floor(F.col("bx") / 2).alias("block_c"), F.floor(F.col("by") / 2).alias("block_r"), r6("mean").alias("expected")))

query("C35 X35", "aoi_sizing", """
  with c as (select trial, lon, lat, round_even(lon*10,0) as cx, round_even(lat*10,0) as cy from fx_site), g as (select cx, cy, count(*) as n, avg(lon) as mlon, avg(lat) as mlat, max(lon)-min(lon) as wlon, max(lat)-min(lat) as wlat from c group by 1,2)
  select cx, cy, n, round(mlon,6) as lon, round(mlat,6) as lat, round(least(greatest(greatest(wlon,wlat)*111320/2+500,1500),4500),3) as half_m from g
""")(lambda t: t.sites.groupBy(F.rint(F.col("lon") * 10).alias("cx"), F.rint(F.col("lat") * 10).alias("cy")).agg(F.count("*").alias("n"), F.avg("lon").alias("a"), F.avg("lat").alias("b"), F.greatest(F.max("lon") - F.min("lon"), F.max("lat") - F.min("lat")).alias("w")).select(
    "cx", "cy", "n", r6("a").alias("lon"), r6("b").alias("lat"), F.round(F.least(F.greatest(F.col("w") * 111320 / 2 + 500, F.lit(1500.0)), F.lit(4500.0)), 3).alias("half_m")))

query("C37", "flat_attribute_table", f"""
  with recursive {_STAB} select p.poly_id, p.yr, round((p.x0+p.x1)/2.0::double,6) as x, round((p.y0+p.y1)/2.0::double,6) as y, st.n_years, round(st.median_iou,6) as median_iou, st.paddock_id, min(t.gx*1000+t.gy) as region
  from fx_poly_year p left join st on st.a=p.poly_id and st.yr=p.yr left join fx_tile t on (p.x0+p.x1)/2.0>=t.gx*20 and (p.x0+p.x1)/2.0<t.gx*20+20 and (p.y0+p.y1)/2.0>=t.gy*20 and (p.y0+p.y1)/2.0<t.gy*20+20 group by all
""")(lambda t: _flat(t))


def _flat(t):
    from furrow.operators.joins import unique_left_join

    pts = t.poly_year.select("poly_id", "yr", ((F.col("x0") + F.col("x1")) / 2.0).alias("x"), ((F.col("y0") + F.col("y1")) / 2.0).alias("y"))
    full = unique_left_join(pts, stable(t).withColumnRenamed("a", "poly_id").drop("mean_iou_hits"), ["poly_id", "yr"])
    box = t.tiles.select((F.col("gx") * 1000 + F.col("gy")).alias("region"), (F.col("gx") * 20).alias("x0"), (F.col("gy") * 20).alias("y0"), (F.col("gx") * 20 + 20).alias("x1"), (F.col("gy") * 20 + 20).alias("y1"))
    one = J.one_each(J.point_in_box(full, box, "left", cell=20), ["poly_id", "yr"], F.col("region").asc_nulls_last())
    return one.select("poly_id", "yr", r6("x").alias("x"), r6("y").alias("y"), "n_years", r6("median_iou").alias("median_iou"), "paddock_id", "region")


query("C39", "site_scoring", """
  with s as (select poly_id*10+3 as trial, (x0+x1)/2.0::double as x, y0+0.5::double as y, case (poly_id*7)%3 when 0 then 'Canola' when 1 then 'Cereal' else 'Legume' end as truth from fx_poly),
  m as (select s.trial, s.truth, p.pred, coalesce(p.abstain_reason,'') as reason, p.area_ha, row_number() over (partition by s.trial order by (floor(s.x/20)=p.kx and floor(s.y/20)=p.ky) desc, p.area_ha desc, p.poly_id) as rn from s left join fx_poly p on s.x>=p.x0 and s.x<p.x1 and s.y>=p.y0 and s.y<p.y1),
  o as (select * from m where rn=1), k as (select truth as cls, count(*) as n_sites, count(*) filter (pred is not null and reason='') as n_scored, count(*) filter (pred=truth and reason='') as hits from o group by 1)
  select cls, n_sites, n_scored, hits, round(hits/nullif(cast(n_scored as double),0),6) as recall, round(hits/cast(n_sites as double),6) as adjusted_recall from k
""")(lambda t: _site_scores(t))


def _site_scores(t):
    k = F.col("poly_id")
    pts = t.poly.select((k * 10 + 3).alias("trial"), ((F.col("x0") + F.col("x1")) / 2.0).alias("x"), (F.col("y0") + 0.5).alias("y"), F.when(k * 7 % 3 == 0, "Canola").when(k * 7 % 3 == 1, "Cereal").otherwise("Legume").alias("cls"))
    owner = (F.floor(F.col("x") / 20) == F.col("kx")) & (F.floor(F.col("y") / 20) == F.col("ky"))
    one = J.one_each(J.point_in_box(pts, t.poly, "left"), ["trial"], owner.desc_nulls_last(), F.col("area_ha").desc_nulls_last(), F.col("poly_id").asc_nulls_last())
    ok = F.col("pred").isNotNull() & (F.coalesce("abstain_reason", F.lit("")) == "")
    per = one.groupBy("cls").agg(F.count("*").alias("n_sites"), F.count_if(ok).alias("n_scored"), F.count_if(ok & (F.col("pred") == F.col("cls"))).alias("hits"))
    return per.withColumn("recall", r6(F.try_divide(F.col("hits").cast("double"), F.col("n_scored").cast("double")))).withColumn("adjusted_recall", r6(F.col("hits") / F.col("n_sites").cast("double")))


query("C44", "aoi_lists", "select t.gx, t.gy, i, j, t.gx*3+i as sx, t.gy*3+j as sy from fx_tile t, (select unnest(range(3)) as i), (select unnest(range(3)) as j) where (t.gx+1, t.gy) in (select gx, gy from fx_tile)")(
    lambda t: t.tiles.withColumn("nx", F.col("gx") + 1).join(t.tiles.select(F.col("gx").alias("nx"), "gy"), ["nx", "gy"], "left_semi").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(
        "gx", "gy", "i", "j", (F.col("gx") * 3 + F.col("i")).alias("sx"), (F.col("gy") * 3 + F.col("j")).alias("sy")))
