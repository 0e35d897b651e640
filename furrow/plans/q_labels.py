"""Queries for label quality and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions.scalars import r6
from furrow.operators import labels as L
from furrow.operators import metrics as M
from furrow.plans.q_sampling import _mix
from furrow.plans.registry import query

query("C24 W1 W2 A13", "label_conflicts", """
  with g as (select site, yr, count(*) as n_trials, count(distinct crop) as n_crops, count(distinct case when crop=0 then 0 when crop<4 then 1 else 2 end) as n_groups from fx_site group by 1,2)
  select trial, n_trials, cast(n_crops as integer) as n_crops, cast(n_groups as integer) as n_groups, n_crops>1 as crop_conflict, n_groups>1 as group_conflict from fx_site join g using (site, yr)
""")(lambda t: L.conflict_flags(t.sites, ["site", "yr"], "crop", F.when(F.col("crop") == 0, 0).when(F.col("crop") < 4, 1).otherwise(2)).select("trial", "n_trials", "n_crops", "n_groups", "crop_conflict", "group_conflict"))

_POLY = """select trial%300 as poly, count(*) as n_trials, string_agg(cast(trial as varchar), ',' order by cast(trial as varchar)) as trial_codes, count(distinct crop) as n_crops, max(bal) as paddock_ha,
  concat_ws('; ', case when count(distinct crop)>6 then 'group_conflict' end, case when max(bal)<9000 then 'too_small' end) as flag_reason from fx_site group by 1"""


def _polygons(t):
    return L.review_polygons(t.sites.withColumn("poly", F.col("trial") % 300), "poly")


query("C25 J32", "review_package", f"select poly, n_trials, trial_codes, n_crops, paddock_ha, flag_reason, flag_reason<>'' as triage_flag from ({_POLY})")(
    lambda t: _polygons(t).select("poly", "n_trials", "trial_codes", "n_crops", "paddock_ha", "flag_reason", "triage_flag"))

query("C25 T6", "review_sample", f"""
  with p as (select *, flag_reason<>'' as triage_flag from ({_POLY})), r as (select *, row_number() over (partition by triage_flag order by {_mix('poly')}, poly) as rn from p)
  select poly, triage_flag, row_number() over (order by triage_flag desc, rn, poly) as review_order from r where triage_flag or rn<=20
""")(lambda t: L.review_sample(_polygons(t), "poly", 20).select("poly", "triage_flag", "review_order"))

query("C25 F25 X24", "review_ingest", f"""
  with p as (select *, case when poly%4=0 then 'good' when poly%4=1 then 'bad' end as old from ({_POLY})), f as (select poly, trial_codes, coalesce(old, case when flag_reason<>'' then 'bad' else 'good' end) as verdict from p)
  select unnest(string_split(trial_codes, ',')) as trial_code, poly, verdict from f
""")(lambda t: L.ingested(L.finalised(L.refreshed(_polygons(t).select("poly", F.when(F.col("poly") % 4 == 0, "good").when(F.col("poly") % 4 == 1, "bad").alias("verdict")), _polygons(t), "poly")), "poly"))

query("C41 T7", "label_quality_arms", f"""
  with f as (select trial, yr<=2020 as train, bal>0 as clean, crop=3 as conflict, {_mix('trial', 5)} as m from fx_site), r as (select *, row_number() over (partition by train order by m, trial) as rk, (select count(*) from f where train and clean) as size from f)
  select arm, count(*) as n, sum(trial)::bigint as checksum from (select trial, 'all' as arm from r where train union all select trial, 'clean' from r where train and clean union all select trial, 'no_conflict' from r where train and not conflict
    union all select trial, 'control' from r where train and rk<=size union all select trial, 'test' from r where not train) group by 1
""")(lambda t: L.training_arms(t.sites, "trial", F.col("bal") > 0, F.col("crop") == 3, F.col("yr") <= 2020).groupBy("arm").agg(F.count("*").alias("n"), F.sum("trial").alias("checksum")))

query("C28", "yield_by_diagnosis", """
  with g as (select yr, case when truth=pred then 'agree' else 'differ' end as diag, count(*) as n, avg(score) as mean_yield, median(score) as med_yield from fx_pred group by 1,2) select yr, diag, n, round(mean_yield,6) as mean_yield, round(med_yield,6) as med_yield from g
""")(lambda t: t.pred.groupBy("yr", F.when(F.col("truth") == F.col("pred"), "agree").otherwise("differ").alias("diag")).agg(F.count("*").alias("n"), r6(F.avg("score")).alias("mean_yield"), r6(F.median("score")).alias("med_yield")))

query("C28 A33", "yield_difference_test", """
  with r as (select yr, truth=pred as pos, rank() over (partition by yr order by round(score,4))+(count(*) over (partition by yr, round(score,4))-1)/2.0::double as r from fx_pred)
  select yr, round((sum(case when pos then r else 0 end)-count(*) filter (pos)*(count(*) filter (pos)+1)/2.0::double)/(count(*) filter (pos)*count(*) filter (not pos)),6) as auc from r group by 1
""")(lambda t: M.auc(t.pred.withColumns({"s": F.round("score", 4), "pos": F.col("truth") == F.col("pred")}), "s", "pos", ["yr"]).select("yr", r6("auc").alias("auc")))
