"""Queries for accuracy, agreement, resampling and benchmark figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions.scalars import r6
from furrow.operators import metrics as M
from furrow.plans.catalog import CROPS
from furrow.plans.registry import query

query("A22", "confusion", "select truth, " + ", ".join(f"count(*) filter (pred='{c}') as n_{c.lower()}" for c in CROPS) + " from fx_pred group by 1")(lambda t: M.confusion(t.pred, "truth", "pred", CROPS))

_PER = "select cls, count(*) filter (truth=cls and pred=cls) as tp, count(*) filter (truth<>cls and pred=cls) as fp, count(*) filter (truth=cls and pred<>cls) as fn from fx_pred, (select unnest(['Canola','Cereal','Legume']) as cls) group by 1"
_PRF = "coalesce(tp/nullif(cast(tp+fp as double),0),0) as precision, coalesce(tp/nullif(cast(tp+fn as double),0),0) as recall, coalesce(2*tp/nullif(cast(2*tp+fp+fn as double),0),0) as f1"
query("A23", "class_metrics", f"select cls, tp, fp, fn, round(precision,6) as precision, round(recall,6) as recall, round(f1,6) as f1 from (select *, {_PRF} from ({_PER}))")(
    lambda t: M.class_metrics(t.pred, "truth", "pred", CROPS).select("cls", "tp", "fp", "fn", *(r6(c).alias(c) for c in ("precision", "recall", "f1"))))

query("A24", "overall_metrics", f"""
  select round((select avg(case when truth=pred then 1.0::double else 0 end) from fx_pred),6) as accuracy, round(avg(f1),6) as macro_f1, round(avg(recall),6) as balanced_accuracy from (select *, {_PRF} from ({_PER}))
""")(lambda t: M.overall_metrics(t.pred, "truth", "pred", CROPS).select(*(r6(c).alias(c) for c in ("accuracy", "macro_f1", "balanced_accuracy"))))


def _scored(t):
    return t.pred.withColumn("score", F.round("score", 3)).withColumn("pos", F.col("truth") == "Canola")


_RANKS = "select yr, round(score,3) as s, truth='Canola' as pos, rank() over (partition by yr order by round(score,3))+(count(*) over (partition by yr, round(score,3))-1)/2.0::double as r from fx_pred"
query("A32 A33", "rank_auc", f"""
  with x as (select yr, sum(case when pos then r else 0 end)-count(*) filter (pos)*(count(*) filter (pos)+1)/2.0::double as u, count(*) filter (pos) as n_pos, count(*) filter (not pos) as n_neg from ({_RANKS}) group by 1)
  select yr, n_pos, n_neg, round(u,2) as u, case when n_pos>=4 and n_neg>=4 then round(u/(n_pos*n_neg),6) end as auc from x
""")(lambda t: M.auc(_scored(t), "score", "pos", ["yr"]).select("yr", "n_pos", "n_neg", F.round("u", 2).alias("u"), r6("auc").alias("auc")))

query("A33", "mann_whitney_p", f"""
  with x as (select yr, sum(case when pos then r else 0 end)-count(*) filter (pos)*(count(*) filter (pos)+1)/2.0::double as u, count(*) filter (pos) as n, count(*) filter (not pos) as m from ({_RANKS}) group by 1),
  z as (select yr, abs(u-n*m/2.0::double)/sqrt(n*m*(n+m+1)/12.0::double) as z from x), t as (select yr, z, 1/(1+0.3275911::double*z/sqrt(2.0::double)) as t from z)
  select yr, round(t*(0.254829592::double+t*(-0.284496736::double+t*(1.421413741::double+t*(-1.453152027::double+t*1.061405429::double))))*exp(-z*z/2),6) as p from t
""")(lambda t: M.auc(_scored(t), "score", "pos", ["yr"]).select("yr", r6(M.mann_whitney_p(F.col("u"), F.col("n_pos"), F.col("n_neg"))).alias("p")))

query("A34", "youden_scan", """
  with c as (select unnest([0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8])::double as cut), j as (select yr, cut, avg(case when truth='Canola' then case when score>=cut then 1.0::double else 0 end end)-avg(case when truth<>'Canola' then case when score>=cut then 1.0::double else 0 end end) as j from fx_pred, c group by 1,2)
  select yr, round(j,6) as youden_j, cut from (select *, row_number() over (partition by yr order by round(j,9) desc, cut) as rn from j where j is not null) where rn=1
""")(lambda t: M.youden(t.pred.withColumn("pos", F.col("truth") == "Canola"), "score", "pos", [i / 10 for i in range(1, 9)], ["yr"]).select("yr", r6("youden_j").alias("youden_j"), "cut"))

query("A35 A36", "sensitivity_at_fpr", """
  with c as (select yr, quantile_cont(case when truth<>'Canola' then score end, 0.95) as cut from fx_pred group by 1), h as (select yr, max(cut) as cut, count(*) filter (truth='Canola' and score>cut) as hits, count(*) filter (truth='Canola') as n_pos from fx_pred join c using (yr) group by 1)
  select cast(yr as varchar) as season, round(cut,6) as cut, hits, n_pos, round(hits/nullif(cast(n_pos as double),0),6) as sensitivity from h
  union all select 'pooled', null, sum(hits)::bigint, sum(n_pos)::bigint, round(sum(hits)/cast(sum(n_pos) as double),6) from h
""")(lambda t: (lambda s: s.select(F.col("yr").cast("string").alias("season"), r6("cut").alias("cut"), "hits", "n_pos", r6("sensitivity").alias("sensitivity")).unionByName(
    s.agg(F.sum("hits").alias("hits"), F.sum("n_pos").alias("n_pos")).select(F.lit("pooled").alias("season"), F.lit(None).cast("double").alias("cut"), "hits", "n_pos", r6(F.col("hits") / F.col("n_pos").cast("double")).alias("sensitivity"))))(
    M.sensitivity_at(t.pred.withColumn("pos", F.col("truth") == "Canola"), "score", "pos", ["yr"])))

query("A38", "average_precision", """
  with p as (select yr, round(score,3) as s, count(*) filter (truth='Canola') as p, count(*) as n from fx_pred group by 1,2), c as (select *, sum(p) over (partition by yr order by s desc)/cast(sum(n) over (partition by yr order by s desc) as double) as prec from p)
  select yr, round(sum(p*prec)/sum(p),6) as average_precision from c group by 1
""")(lambda t: M.average_precision(_scored(t), "score", "pos", ["yr"]).withColumn("average_precision", r6("average_precision")))

query("A39", "wilson_interval", """
  with x as (select stratum, count(*) filter (bal>0) as k, count(*) as n from fx_site group by 1), p as (select *, k/cast(n as double) as p from x)
  select stratum, k, n, round((p+1.96*1.96/(2*n)-1.96*sqrt(p*(1-p)/n+1.96*1.96/(4.0::double*n*n)))/(1+1.96*1.96/n),6) as low, round((p+1.96*1.96/(2*n)+1.96*sqrt(p*(1-p)/n+1.96*1.96/(4.0::double*n*n)))/(1+1.96*1.96/n),6) as high from p
""")(lambda t: (lambda w: t.sites.groupBy("stratum").agg(F.count_if(F.col("bal") > 0).alias("k"), F.count("*").alias("n")).select("stratum", "k", "n", r6(w[0]).alias("low"), r6(w[1]).alias("high")))(M.wilson(F.col("k"), F.col("n"))))

query("A40 C26", "stratified_extrapolation", """
  with p as (select stratum, count(*) as population from fx_site group by 1), r as (select stratum, count(*) as reviewed, avg(case when bal>0 then 1.0::double else 0 end) as rate from fx_site where crop<2 group by 1)
  select stratum, population, reviewed, round(rate,6) as rate, round(population*(1-rate),4) as expected_bad from p join r using (stratum)
""")(lambda t: t.sites.groupBy("stratum").agg(F.count("*").alias("population"), F.count_if(F.col("crop") < 2).alias("reviewed"), F.avg(F.when(F.col("crop") < 2, (F.col("bal") > 0).cast("double"))).alias("rate")).where("reviewed > 0").select(
    "stratum", "population", "reviewed", r6("rate").alias("rate"), F.round(F.col("population") * (1 - F.col("rate")), 4).alias("expected_bad")))

query("A41", "regression_errors", """
  select yr, round(1-sum(pow(score-p,2))/nullif(sum(score*score)-sum(score)*sum(score)/count(*),0),6) as r2, round(sqrt(avg(pow(score-p,2))),6) as rmse, round(avg(abs(score-p)),6) as mae from (select yr, score, (id%100)/100.0::double as p from fx_pred) group by 1
""")(lambda t: t.pred.withColumn("p", F.col("id") % 100 / 100.0).groupBy("yr").agg(*(r6(c).alias(n) for n, c in M.regression_errors(F.col("score"), F.col("p")).items())))

_W = "(case when u>=0.36787944 then 1 else 0 end+case when u>=0.73575888 then 1 else 0 end+case when u>=0.91969860 then 1 else 0 end+case when u>=0.98101184 then 1 else 0 end+case when u>=0.99634015 then 1 else 0 end+case when u>=0.99940582 then 1 else 0 end)"


def _boot_sql(unit: str, value: str, source: str, n: int) -> str:
    return f"""select rep as replicate, sum(w*s)/nullif(cast(sum(w*n) as double),0) as stat from (select rep, s, n, {_W} as w from (
      select *, ((a*a+unit*31+rep*17)%1000003)/1000003.0::double as u from (select unit, s, n, rep, (unit*7919+rep*104729+1299709)%1000003 as a from (select {unit} as unit, sum({value}) as s, count({value}) as n from {source} group by 1), (select unnest(range({n})) as rep)))) group by 1"""


query("A42", "bootstrap_rows", f"""
  select round(quantile_cont(stat,0.025),6) as low, round(median(stat),6) as mid, round(quantile_cont(stat,0.975),6) as high from ({_boot_sql('id', 'case when truth=pred then 1.0::double else 0 end', 'fx_pred', 50)})
""")(lambda t: M.interval(M.bootstrap(t.pred, "id", 50, F.col("truth") == F.col("pred"))).select(*(r6(c).alias(c) for c in ("low", "mid", "high"))))

query("A43", "bootstrap_clusters", f"select replicate, round(stat,6) as stat from ({_boot_sql('site', 'case when truth=pred then 1.0::double else 0 end', 'fx_pred', 100)})")(
    lambda t: M.bootstrap(t.pred, "site", 100, F.col("truth") == F.col("pred")).withColumn("stat", r6("stat")))

query("A52", "rotation_summary", """
  with w as (select region, yr, cls from (select *, row_number() over (partition by region, yr order by ha desc, cls) as rn from fx_mapped) where rn=1), r as (select region, count(distinct cls) as n_classes, count(*) filter (cls='Canola') as canola_years, count(*) as n_years from w group by 1)
  select n_classes, count(*) as n, sum(canola_years)::bigint as canola_years, round(avg(case when n_classes=1 then 1.0::double else 0 end),6) as single from r group by 1
""")(lambda t: _rotation(t))


def _rotation(t):
    from furrow.operators.regional import winner

    per = winner(t.mapped, ["region", "yr"], "cls", "ha").groupBy("region").agg(F.count_distinct("cls").alias("n_classes"), F.count_if(F.col("cls") == "Canola").alias("canola_years"))
    return per.groupBy("n_classes").agg(F.count("*").alias("n"), F.sum("canola_years").alias("canola_years"), r6(F.avg((F.col("n_classes") == 1).cast("double"))).alias("single"))


query("A62 C43", "cost_projection", """
  select event_type as stage, count(*) as n, round(median(value),6) as med_s, round(median(value)*99465/3600*2.0,4) as projected_su from events group by 1
""")(lambda t: t.events.groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.median("value").alias("m")).select("stage", "n", r6("m").alias("med_s"), F.round(F.col("m") * 99465 / 3600 * 2.0, 4).alias("projected_su")))

query("A63", "matched_share", """
  with p as (select a.poly_id as a, max((least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0))/cast((a.x1-a.x0)*(a.y1-a.y0) as double)) as s from fx_poly a join fx_poly b on a.poly_id<>b.poly_id and a.x0<b.x1 and b.x0<a.x1 and a.y0<b.y1 and b.y0<a.y1 group by 1),
  x as (select coalesce(s,0) as s from fx_poly left join p on poly_id=a)
  select round(avg(case when s>=0.5 then 1.0::double else 0 end),6) as m50, round(avg(case when s>=0.7 then 1.0::double else 0 end),6) as m70, round(avg(case when s>=0.9 then 1.0::double else 0 end),6) as m90, count(*) as n from x
""")(lambda t: _matched(t))


def _matched(t):
    from furrow.plans.q_spatial import _iou_pairs

    best = _iou_pairs(t).groupBy("a").agg(F.max("share_a").alias("s"))
    s = F.coalesce("s", F.lit(0.0))
    return t.poly.join(best, F.col("poly_id") == F.col("a"), "left").agg(*(r6(F.avg((s >= c / 100).cast("double"))).alias(f"m{c}") for c in (50, 70, 90)), F.count("*").alias("n"))


query("A71 A72", "strip_contrast", """
  with s as (select poly_id, avg(case when inside then v end) as m1, avg(case when not inside then v end) as m2, stddev_pop(case when inside then v end) as s1, stddev_pop(case when not inside then v end) as s2
    from (select poly_id, (px+py)%2=0 as inside, (((px*31+py*17)%23)+23)%23*1.0::double as v from fx_px) group by 1), c as (select poly_id, abs(m1-m2)/nullif(sqrt((s1*s1+s2*s2)/2),0) as c from s),
  g as (select unnest(range(51))/50.0::double as cut), e as (select cut, abs(avg(case when poly_id%2=0 then case when c<cut then 1.0::double else 0 end end)-avg(case when poly_id%2=1 then case when c>=cut then 1.0::double else 0 end end)) as gap from c, g group by 1)
  select round(cut,6) as cut, round(gap,6) as gap from e order by round(gap,9), cut limit 1
""")(lambda t: _equal_error(t))


def _equal_error(t):
    v = F.pmod(F.col("px") * 31 + F.col("py") * 17, F.lit(23)).cast("double")
    inside = (F.col("px") + F.col("py")) % 2 == 0
    side = lambda f, c: f(F.when(c, v))
    c = t.px.groupBy("poly_id").agg(M.contrast(side(F.avg, inside), side(F.stddev_pop, inside), side(F.avg, ~inside), side(F.stddev_pop, ~inside)).alias("c"))
    grid = c.withColumn("cut", F.explode(F.array(*(F.lit(i / 50) for i in range(51)))))
    low = F.avg(F.when(F.col("poly_id") % 2 == 0, F.coalesce(F.col("c") < F.col("cut"), F.lit(False)).cast("double")))
    high = F.avg(F.when(F.col("poly_id") % 2 == 1, F.coalesce(F.col("c") >= F.col("cut"), F.lit(False)).cast("double")))
    return grid.groupBy("cut").agg(F.abs(low - high).alias("gap")).orderBy(F.round("gap", 9), "cut").limit(1).select(r6("cut").alias("cut"), r6("gap").alias("gap"))


query("A73", "sampling_noise", f"""
  with b as ({_boot_sql('id', 'score', 'fx_pred', 40)}) select round(stddev_samp(stat),6) as noise_sd, round((select stddev_samp(m) from (select avg(score) as m from fx_pred group by yr)),6) as observed_sd from b
""")(lambda t: M.bootstrap(t.pred, "id", 40, F.col("score")).agg(r6(F.stddev_samp("stat")).alias("noise_sd")).join(t.pred.groupBy("yr").agg(F.avg("score").alias("m")).agg(r6(F.stddev_samp("m")).alias("observed_sd"))))

query("A74", "clearest_scene", "select site_id, yr, doy, n_clear from (select *, row_number() over (partition by site_id, yr order by n_clear desc, doy) as rn from fx_ts) where rn=1")(
    lambda t: t.ts.groupBy("site_id", "yr").agg(F.max(F.struct("n_clear", (-F.col("doy")).alias("m"))).alias("s")).select("site_id", "yr", (-F.col("s.m")).alias("doy"), "s.n_clear"))

query("A44 X26", "importance_by_family", """
  select regexp_replace(feature, '_+[^_]*$', '') as family, round(sum(v),6) as importance, count(*) as n from (select unnest(['ndvi_90','ndvi_110','ndvi__p10','cfi_90','cfi__amp','ndyi_110']) as feature, unnest([0.1,0.2,0.05,0.3,0.15,0.2])::double as v) group by 1
""")(lambda t: _by_family(t))


def _by_family(t):
    from furrow.operators.filters import family

    rows = [("ndvi_90", 0.1), ("ndvi_110", 0.2), ("ndvi__p10", 0.05), ("cfi_90", 0.3), ("cfi__amp", 0.15), ("ndyi_110", 0.2)]
    return t.spark.createDataFrame([(family(f), f, v) for f, v in rows], "family string, feature string, v double").groupBy("family").agg(r6(F.sum("v")).alias("importance"), F.count("*").alias("n"))


query("C29", "separability_panels", """
  with g as (select yr, site%4 as state, count(*) filter (truth='Canola') as n_canola, count(*) filter (truth<>'Canola') as n_other, median(case when truth='Canola' then score end) as canola_med, median(case when truth<>'Canola' then score end) as other_med from fx_pred group by 1,2),
  r as (select yr, site%4 as state, truth='Canola' as pos, rank() over (partition by yr, site%4 order by round(score,3))+(count(*) over (partition by yr, site%4, round(score,3))-1)/2.0::double as r from fx_pred),
  u as (select yr, state, (sum(case when pos then r else 0 end)-count(*) filter (pos)*(count(*) filter (pos)+1)/2.0::double)/nullif(count(*) filter (pos)*count(*) filter (not pos),0) as auc from r group by 1,2)
  select yr, state, n_canola, n_other, case when n_canola>=4 and n_other>=4 then round(auc,6) end as auc, round(canola_med,6) as canola_med, round(other_med,6) as other_med from g join u using (yr, state)
""")(lambda t: (lambda d: M.auc(d, "s", "pos", ["yr", "state"]).join(d.groupBy("yr", "state").agg(F.median(F.when(F.col("pos"), F.col("score"))).alias("a"), F.median(F.when(~F.col("pos"), F.col("score"))).alias("b")), ["yr", "state"]).select(
    "yr", "state", F.col("n_pos").alias("n_canola"), F.col("n_neg").alias("n_other"), r6("auc").alias("auc"), r6("a").alias("canola_med"), r6("b").alias("other_med")))(
    t.pred.withColumns({"state": F.col("site") % 4, "pos": F.col("truth") == "Canola", "s": F.round("score", 3)})))
