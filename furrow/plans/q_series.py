"""Queries over paddock time series: indices, features, gates and windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from furrow.functions import indices as X
from furrow.functions.scalars import r6
from furrow.operators import series as S
from furrow.operators.filters import min_observations, observed, verdict
from furrow.operators.metrics import youden
from furrow.plans.registry import query

#: DuckDB forms of the indices that the oracles use.
NDVI = "(nir-red)/nullif(nir+red,0)"
NDYI = "(green-blue)/nullif(green+blue,0)"
CFI = f"({NDVI})*((red+green)+(green-blue))"

_SQL_INDEX = {
    "ndvi": NDVI, "ndyi": NDYI, "cfi": CFI, "ndre": "(nir-re1)/(nir+re1)", "ndwi": "(green-nir)/(green+nir)", "nbr": "(nir-sw3)/(nir+sw3)",
    "psri": "(red-blue)/re3", "swir_ratio": "sw2/sw3", "evi": "2.5*(nir-red)/(nir+6*red-7.5*blue+1)", "evi2": "2.5*(nir-red)/(nir+2.4*red+1)",
    "savi": "1.5*(nir-red)/(nir+red+0.5)", "gndvi": "(nir-green)/(nir+green)", "ci_red_edge": "nir/re1-1", "ndre2": "(nir-re2)/(nir+re2)",
    "vi2": "(re2+red)-(re1-blue)", "vi3": "(re1+green)-(blue+red)", "vdvi": "(2*green-red-blue)/(2*green+red+blue)",
    "vci": "pow(0.38*(nir-green)+green-red,2)/nullif(pow(0.38*(nir-green)+green-blue,2),0)", "evi2_ramped": "2.4*(nir-red)/(nir+red+1)",
}
_KEYS = "l_orderkey, l_linenumber, l_partkey, trial_id"
_GUARD = {"vci": "case when abs(pow(0.38*(nir-green)+green-blue,2))>=1e-6 then {} end"}


def _index_sql(names: list[str]) -> str:
    cols = ", ".join(f"round({_GUARD.get(n, '{}').format(_SQL_INDEX[n])},6) as {n}" for n in names)
    return f"select {_KEYS}, doy, {cols} from fx_ts"


def _index_query(names: list[str]):
    return lambda t: t.ts.select("l_orderkey", "l_linenumber", "l_partkey", "trial_id", "doy", *(r6(X.INDICES[n]()).alias(n) for n in names))


for _ids, _name, _cols in (
    ("X1 X2 X3 X13", "base_indices", ["ndvi", "ndyi", "cfi"]),
    ("X4 X5", "red_edge_indices", ["ndre", "ndwi", "nbr", "psri", "swir_ratio"]),
    ("X6", "vegetation_indices", ["evi", "evi2", "savi", "gndvi", "ci_red_edge"]),
    ("X7 X8 X9 X10", "contrast_indices", ["ndre2", "vi2", "vi3", "vdvi", "vci", "evi2_ramped"]),
):
    query(_ids, _name, _index_sql(_cols))(_index_query(_cols))

query("X11", "gap_fill_harmonic", f"""
  select trial_id, round(avg(v),6) as f0, round(avg(v*cos(2*3.141592653589793*doy/365.0::double)),6) as f_cos, round(avg(v*sin(2*3.141592653589793*doy/365.0::double)),6) as f_sin
  from (select trial_id, doy, coalesce({_SQL_INDEX['ndwi']}, avg({_SQL_INDEX['ndwi']}) over (partition by trial_id)) as v from fx_ts) group by trial_id
""")(lambda t: S.fourier_mean(t.ts, X.ndwi(), ["trial_id"]).select("trial_id", *(r6(c).alias(c) for c in ("f0", "f_cos", "f_sin"))))

query("X12 F8", "radar_decibel", """
  select trial_id, round(median(10*log10(sw2)),6) as vv_db, round(median(10*log10(sw3)-10*log10(sw2)),6) as vhvv, count(*) as n from fx_ts where sw2>0 and sw3>0 group by trial_id having count(*)>=10
""")(lambda t: t.ts.where("sw2 > 0 and sw3 > 0").groupBy("trial_id").agg(
    r6(F.median(X.decibel(F.col("sw2")))).alias("vv_db"), r6(F.median(X.decibel(F.col("sw3")) - X.decibel(F.col("sw2")))).alias("vhvv"), F.count("*").alias("n")).where("n >= 10"))

query("X15 X16", "presto_channels", """
  select l_orderkey, l_linenumber, l_partkey, trial_id, round((nir+0.5)/2.0,6) as ch, coalesce(round((nir-red)/nullif(nir+red,0),6),0) as ndvi,
         least(cast(floor((cast(floor(red*10000) as bigint)+50)/100.0) as bigint), 100) as pct from fx_ts
""")(lambda t: t.ts.select("l_orderkey", "l_linenumber", "l_partkey", "trial_id", r6(X.presto_normalised(F.col("nir"), 0.5, 2.0)).alias("ch"),
    F.coalesce(r6(X.ndvi()), F.lit(0.0)).alias("ndvi"), X.half_up_percent(F.floor(F.col("red") * 10000)).alias("pct")))

query("F1 F4", "clear_dedup", "select trial_id, site_id, yr, doy, n_clear, round(red,6) as red, round(nir,6) as nir from fx_ts")(
    lambda t: t.ts.select("trial_id", "site_id", "yr", "doy", "n_clear", r6("red").alias("red"), r6("nir").alias("nir")))

query("F2", "min_observations", "select trial_id, count(*) as n from fx_ts group by 1 having count(*)>=30")(
    lambda t: min_observations(t.ts, ["trial_id"], 30).groupBy("trial_id").agg(F.count("*").alias("n")))

query("A1 A2 A4", "zonal_statistics", """
  select trial_id, round(median(sw2),6) as med, round(avg(sw2),6) as mean, round(stddev_pop(sw2),6) as sd, count(*) filter (n_clear>=40) as n_clear_dates
  from fx_ts group by 1
""")(lambda t: t.ts.groupBy("trial_id").agg(r6(F.median("sw2")).alias("med"), r6(F.avg("sw2")).alias("mean"), r6(F.stddev_pop("sw2")).alias("sd"), F.count_if(F.col("n_clear") >= 40).alias("n_clear_dates")))

query("A3", "nearest_value", """
  select trial_id, doy, round(red,6) as red from (select *, row_number() over (partition by trial_id order by abs(doy-200), doy, l_orderkey, l_linenumber) as rn from fx_ts) where rn=1
""")(lambda t: t.ts.groupBy("trial_id").agg(F.min_by(F.struct("doy", r6("red").alias("red")), F.struct(F.abs(F.col("doy") - 200), "doy", "l_orderkey", "l_linenumber")).alias("s")).select("trial_id", "s.*"))

query("A5", "season_clear_fraction", "select trial_id, round(sum(n_clear)/cast(sum(n_px) as double),6) as clear_frac from fx_ts group by 1")(
    lambda t: S.clear_season(t.ts).withColumn("clear_frac", r6("clear_frac")))

_BIN = "case when doy>=90 and doy<350 then cast(floor((doy-90)/20.0) as integer)*20+90 end"
_BINS_SQL = f"select trial_id, {_BIN} as bin, median({NDVI}) as ndvi, median({CFI}) as cfi from fx_ts where doy>=90 and doy<350 group by 1,2"

query("A6 X33 ST6", "binned_median_wide", f"""
  select trial_id, {', '.join(f'round(max(case when bin={b} then ndvi end),6) as ndvi_{b}' for b in S.BINS)} from ({_BINS_SQL}) group by 1
""")(lambda t: S.widen(S.binned(t.ts, {"ndvi": X.ndvi()}), ["ndvi"]).select("trial_id", *(r6(f"ndvi_{b}").alias(f"ndvi_{b}") for b in S.BINS)))

_SUMMARY = """round(quantile_cont({v},0.1),6) as {v}__p10, round(quantile_cont({v},0.9),6) as {v}__p90, round(quantile_cont({v},0.9)-quantile_cont({v},0.1),6) as {v}__amp,
  arg_max(bin, case when {v} is not null then row({v}, -bin) end) as {v}__peak_doy"""
query("A7 A8", "bin_summaries", f"select trial_id, {_SUMMARY.format(v='ndvi')} from ({_BINS_SQL}) group by 1")(
    lambda t: S.bin_summaries(S.binned(t.ts, {"ndvi": X.ndvi()}), ["ndvi"]).select("trial_id", *(r6(f"ndvi__{s}").alias(f"ndvi__{s}") for s in ("p10", "p90", "amp")), "ndvi__peak_doy"))

query("C2", "feature_builder", f"""
  select trial_id, {', '.join(f'round(max(case when bin={b} then {v} end),6) as {v}_{b}' for v in ('ndvi', 'cfi') for b in S.BINS)},
  {_SUMMARY.format(v='ndvi')}, {_SUMMARY.format(v='cfi')} from ({_BINS_SQL}) group by 1
""")(lambda t: (lambda d: d.select(*(c if c == "trial_id" or c.endswith("doy") else r6(c).alias(c) for c in d.columns)))(S.feature_table(t.ts, {"ndvi": X.ndvi(), "cfi": X.cfi()})))

query("A9 A10", "amplitudes", f"""
  select trial_id, round(quantile_cont({NDVI},0.9)-quantile_cont({NDVI},0.1),6) as amp_raw, case when count({NDVI})>=5 then round(quantile_cont({NDVI},0.95)-quantile_cont({NDVI},0.05),6) end as amp_check
  from fx_ts group by 1
""")(lambda t: t.ts.groupBy("trial_id").agg(r6(S.spread(X.ndvi(), 0.1, 0.9)).alias("amp_raw"), r6(S.spread(X.ndvi(), 0.05, 0.95, 5)).alias("amp_check")))

_WITH_DATES = "select s.*, t.sow, t.harv, t.crop from fx_ts s join fx_trial t using (trial_id)"


def _dated(t):
    return t.ts.join(t.trial.select("trial_id", "sow", "harv", "crop"), "trial_id")


_GAP_SQL = f"""
  select trial_id, max(gap) as max_gap_d from (
    select trial_id, d - lag(d) over (partition by trial_id order by d) as gap from (
      select trial_id, d from ({_WITH_DATES}) where d between sow and harv
      union all select distinct trial_id, sow from ({_WITH_DATES}) union all select distinct trial_id, harv from ({_WITH_DATES}))) group by 1"""
query("A45 W7", "largest_gap", f"select trial_id, cast(max_gap_d as integer) as max_gap_d from ({_GAP_SQL})")(lambda t: S.largest_gap(_dated(t), "sow", "harv"))

_SEASON_SQL = f"""
  select trial_id, max(case when f then v end) as peak, arg_max(doy, case when f then row(v, -doy) end) as peak_doy, median(case when doy between 100 and 180 then v end) as baseline, count(*) filter (f) as n_flower
  from (select trial_id, doy, {CFI} as v, doy between 200 and 300 and {CFI} is not null as f from fx_ts) group by 1"""
query("A46", "flowering_season", f"select trial_id, round(peak,6) as peak, peak_doy, round(baseline,6) as baseline, n_flower, round(peak-baseline,6) as amplitude from ({_SEASON_SQL})")(
    lambda t: S.season(t.ts, X.cfi()).select("trial_id", r6("peak").alias("peak"), "peak_doy", r6("baseline").alias("baseline"), "n_flower", r6("amplitude").alias("amplitude")))

_DAS_SQL = f"select trial_id, max(case when d-sow between 120 and 190 then {CFI} end) as peak_das, count(*) filter (d-sow between 120 and 190 and {CFI} is not null) as n_das from ({_WITH_DATES}) group by 1"
query("A47 X29", "days_after_sowing_peak", f"select trial_id, round(peak_das,6) as peak_das, n_das from ({_DAS_SQL})")(
    lambda t: S.window_after_sowing(_dated(t), X.cfi()).withColumn("peak_das", r6("peak_das")))

query("J23 X30", "season_window_join", f"select trial_id, count(*) as n, min(d) as first_d, max(d) as last_d from ({_WITH_DATES}) where d between sow-30 and harv+30 group by 1")(
    lambda t: S.anchored(t.ts, t.trial).groupBy("trial_id").agg(F.count("*").alias("n"), F.min("d").alias("first_d"), F.max("d").alias("last_d")))

_PHENO_SQL = f"""
  select trial_id, max(pk.v) as peak, max(pk.doy) as peak_doy,
    (max(pk.v)-median(case when doy-pk.doy between -120 and -30 then v end))/max(pk.v) as greenup_rise, (max(pk.v)-median(case when doy-pk.doy between 45 and 150 then v end))/max(pk.v) as senescence_drop
  from (select trial_id, doy, v, first_value({{'v': v, 'doy': doy}}) over (partition by trial_id order by v desc, doy) as pk from (select trial_id, doy, {NDVI} as v from fx_ts) where v is not null) group by 1"""
query("A48 J24", "phenology_fractions", f"select trial_id, round(peak,6) as peak, peak_doy, round(greenup_rise,6) as greenup_rise, round(senescence_drop,6) as senescence_drop from ({_PHENO_SQL})")(
    lambda t: S.phenology(t.ts, X.ndvi()).select("trial_id", r6("peak").alias("peak"), "peak_doy", r6("greenup_rise").alias("greenup_rise"), r6("senescence_drop").alias("senescence_drop")))

query("A49", "phenology_on_dates", f"""
  select trial_id, round(peak,6) as peak, round((peak-a)/nullif(peak,0),6) as greenup_rise, round((peak-b)/nullif(peak,0),6) as senescence_drop from (
    select trial_id, max(case when d between sow and harv then {NDVI} end) as peak, median(case when d<=sow+30 then {NDVI} end) as a, median(case when d>=harv-10 then {NDVI} end) as b from ({_WITH_DATES}) group by 1)
""")(lambda t: S.phenology_on_dates(_dated(t), X.ndvi()).select("trial_id", r6("peak").alias("peak"), r6("greenup_rise").alias("greenup_rise"), r6("senescence_drop").alias("senescence_drop")))

_GRID = "select unnest(range(78)) as i"
query("A50", "presence_only_gate", f"""
  with ph as ({_PHENO_SQL}),
  a as (select quantile_cont(greenup_rise, {[round((1 + 0.5 * i) / 100, 4) for i in range(78)]}) as ca, quantile_cont(senescence_drop, {[round((1 + 0.5 * i) / 100, 4) for i in range(78)]}) as cb from ph),
  s as (select 1+0.5::double*i as p, ca[i+1] as cut_a, cb[i+1] as cut_b from a, ({_GRID})),
  r as (select p, cut_a, cut_b, avg(case when coalesce(greenup_rise>=cut_a and senescence_drop>=cut_b, false) then 1.0::double else 0 end) as recall from ph, s group by 1,2,3)
  select p, round(cut_a,6) as cut_a, round(cut_b,6) as cut_b, round(recall,6) as recall from r where recall>=0.5 order by p desc limit 1
""")(lambda t: S.fit_gate(S.phenology(t.ts, X.ndvi()), "greenup_rise", "senescence_drop", 0.5).select("p", r6("cut_a").alias("cut_a"), r6("cut_b").alias("cut_b"), r6("recall").alias("recall")))

query("A51", "gate_recall_by_group", f"""
  select crop, count(*) as n, round(avg(case when coalesce(greenup_rise>=0.2,false) then 1.0::double else 0 end),6) as rise_recall,
         round(avg(case when coalesce(greenup_rise>=0.2 and senescence_drop>=0.2,false) then 1.0::double else 0 end),6) as both_recall,
         count(*) filter (coalesce(greenup_rise>=0.2,false) = coalesce(senescence_drop>=0.2,false)) as agree
  from ({_PHENO_SQL}) join fx_trial using (trial_id) group by 1
""")(lambda t: (lambda a, b: S.phenology(t.ts, X.ndvi()).join(t.trial, "trial_id").groupBy("crop").agg(
    F.count("*").alias("n"), r6(F.avg(a.cast("double"))).alias("rise_recall"), r6(F.avg((a & b).cast("double"))).alias("both_recall"), F.count_if(a == b).alias("agree")))(
    F.coalesce(F.col("greenup_rise") >= 0.2, F.lit(False)), F.coalesce(F.col("senescence_drop") >= 0.2, F.lit(False))))

query("A69 W9 X28", "monthly_tensor", """
  with g as (select trial_id, unnest(range(12)) as month from (select distinct trial_id from fx_ts)),
  m as (select trial_id, month(d)-1 as month, avg(red) as red from fx_ts group by 1,2),
  j as (select g.trial_id, cast(g.month as integer) as month, m.red from g left join m on g.trial_id=m.trial_id and g.month=m.month),
  k as (select *, last_value(case when red is not null then {'x': month, 'y': red} end ignore nulls) over (partition by trial_id order by month rows between unbounded preceding and current row) as l,
               first_value(case when red is not null then {'x': month, 'y': red} end ignore nulls) over (partition by trial_id order by month rows between current row and unbounded following) as r from j)
  select trial_id, month, round(case when l is null then r.y when r is null then l.y when l.x=r.x then l.y else l.y+(r.y-l.y)*(month-l.x)/(r.x-l.x) end,6) as red from k
""")(lambda t: S.monthly(t.ts, {"red": F.col("red")}).select("trial_id", "month", r6("red").alias("red")))

query("C32 F22", "phenology_confirm", f"""
  with a as (select trial_id, case when count({NDVI})>=5 then quantile_cont({NDVI},0.95)-quantile_cont({NDVI},0.05) end as amp from fx_ts group by 1), b as ({_DAS_SQL})
  select trial_id, crop, round(amp,6) as amp, round(peak_das,6) as peak_das,
    case when amp is null or peak_das is null then 'UNCERTAIN' when amp<0.2 then 'REJECTED' when (peak_das>=0.1309)=(crop=0) then 'CONFIRMED' when crop=0 then 'REJECTED' else 'UNCERTAIN' end as verdict
  from a join b using (trial_id) join fx_trial using (trial_id)
""")(lambda t: t.ts.groupBy("trial_id").agg(S.spread(X.ndvi(), 0.05, 0.95, 5).alias("amp")).join(S.window_after_sowing(_dated(t), X.cfi()), "trial_id").join(t.trial.select("trial_id", "crop"), "trial_id").select(
    "trial_id", "crop", r6("amp").alias("amp"), r6("peak_das").alias("peak_das"), verdict(F.col("amp"), F.col("peak_das"), F.col("crop") == 0).alias("verdict")))

query("C30", "window_placement_scan", f"""
  with w as (select s, wd from (select unnest([90,100,110,120,130,140]) as s), (select unnest([20,40,60,80]) as wd)),
  p as (select trial_id, s as start, wd as width, max({CFI}) as peak, crop=0 as positive from ({_WITH_DATES}) join w on d-sow>=s and d-sow<s+wd where {CFI} is not null group by 1,2,3,crop),
  c as (select unnest([0.02,0.04,0.06,0.08,0.1,0.12,0.14,0.16,0.18,0.2])::double as cut),
  j as (select start, width, cut, avg(case when positive then case when peak>=cut then 1.0::double else 0 end end) as tpr, avg(case when not positive then case when peak>=cut then 1.0::double else 0 end end) as fpr from p, c group by 1,2,3)
  select start, width, round(j,6) as youden_j, cut from (select *, tpr-fpr as j, row_number() over (partition by start, width order by round(tpr-fpr,9) desc, cut) as rn from j where tpr is not null and fpr is not null) where rn=1
""")(lambda t: youden(S.placement_scan(_dated(t), X.cfi(), F.col("crop") == 0, [90, 100, 110, 120, 130, 140], [20, 40, 60, 80]), "peak", "positive", [0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.14, 0.16, 0.18, 0.2], ["start", "width"]).select(
    "start", "width", r6("youden_j").alias("youden_j"), "cut"))

query("C31", "threshold_evidence", f"""
  with p as ({_DAS_SQL}), q as (select crop, quantile_cont(peak_das, [0.05,0.25,0.5,0.75,0.95]) as q, count(peak_das) as n, count(*) filter (peak_das<0.1309) as rejected from p join fx_trial using (trial_id) group by 1)
  select crop, n, rejected, round(q[1],6) as q05, round(q[2],6) as q25, round(q[3],6) as q50, round(q[4],6) as q75, round(q[5],6) as q95 from q
""")(lambda t: S.window_after_sowing(_dated(t), X.cfi()).join(t.trial, "trial_id").groupBy("crop").agg(
    F.count("peak_das").alias("n"), F.count_if(F.col("peak_das") < 0.1309).alias("rejected"),
    F.percentile("peak_das", F.array(*(F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)))).alias("q")).select(
    "crop", "n", "rejected", *(r6(F.col("q")[i]).alias(f"q{n}") for i, n in enumerate(("05", "25", "50", "75", "95")))))

query("C27 A37 W6 F21 F28", "flowering_audit", f"""
  with s as ({_SEASON_SQL}), g as ({_GAP_SQL}), j as (select trial_id, yr, crop=0 as canola, peak, n_flower, max_gap_d from s join g using (trial_id) join fx_trial using (trial_id)),
  n as (select yr, case when count(peak) filter (not canola)>=8 then quantile_cont(peak,0.95) filter (not canola) end as cut from j group by 1),
  b as (select j.*, n.cut, (select avg(case when o.peak<j.peak then 1.0::double else 0 end) from j o where o.yr=j.yr and not o.canola and o.peak is not null) as below from j join n using (yr))
  select trial_id, yr, round(peak,6) as peak, round(cut,6) as cut, round(below,6) as share_below, n_flower>=3 and max_gap_d<=45 as observed,
    case when peak is null then 'no_data' when not (n_flower>=3 and max_gap_d<=45) then 'gap' when cut is null then 'no_null' when peak>=cut then 'flowering' else 'below_null' end as reason
  from b where canola
""")(lambda t: _flowering_audit(t))


def _flowering_audit(t):
    rows = S.season(t.ts, X.cfi()).join(S.largest_gap(_dated(t), "sow", "harv"), "trial_id").join(t.trial.select("trial_id", "yr", "crop"), "trial_id").withColumn("canola", F.col("crop") == 0)
    rest = F.when(~F.col("canola"), F.col("peak"))
    w = Window.partitionBy("yr")
    up_to = w.orderBy("peak").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    lower = F.count(rest).over(up_to) - F.count(rest).over(Window.partitionBy("yr", "peak"))
    cut = F.when(F.count(rest).over(w) >= 8, F.percentile(rest, F.lit(0.95)).over(w))
    below = F.try_divide(lower.cast("double"), F.count(rest).over(w).cast("double"))
    seen = observed(F.col("n_flower"), F.col("max_gap_d"))
    scored = rows.withColumn("cut", cut).withColumn("below", F.when(F.col("peak").isNotNull(), below).otherwise(F.when(F.count(rest).over(w) > 0, 0.0))).withColumn("observed", seen)
    reason = F.when(F.col("peak").isNull(), "no_data").when(~F.col("observed"), "gap").when(F.col("cut").isNull(), "no_null").when(F.col("peak") >= F.col("cut"), "flowering").otherwise("below_null")
    return scored.where("canola").select("trial_id", "yr", r6("peak").alias("peak"), r6("cut").alias("cut"), r6("below").alias("share_below"), "observed", reason.alias("reason"))
