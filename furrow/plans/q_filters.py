"""Queries for projections, filters, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions import scalars as X
from furrow.functions.scalars import r6
from furrow.operators import filters as P
from furrow.plans.registry import query

query("F3", "keep_list", "select trial, crop from fx_site where trial in (select o_custkey from orders where o_orderstatus='F')")(
    lambda t: P.keep_list(t.sites.select("trial", "crop"), t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("trial")), ["trial"]))

query("F5 W4", "smallest_per_key", "select kx, ky, poly_id from (select *, row_number() over (partition by kx, ky order by area_ha, poly_id) as rn from fx_poly) where rn=1")(
    lambda t: P.dedup_first(t.poly, ["kx", "ky"], ["area_ha", "poly_id"]).select("kx", "ky", "poly_id"))

query("F6", "validity_box", "select trial, lon, lat from fx_site where lat between -38 and -28 and lon between 120 and 140 and stratum<>'BUILDING'")(
    lambda t: P.within_box(t.sites.where("stratum <> 'BUILDING'"), "lon", "lat", 120, -38, 140, -28).select("trial", "lon", "lat"))

query("F7", "scene_mask", """
  select l_orderkey, l_linenumber, l_partkey, round(case when l_linenumber%3=1 and l_partkey%17<>0 and l_suppkey%5<>0 then l_partkey%10000/1e4 end,6) as refl from lineitem
""")(lambda t: t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", r6(P.reflectance(
    F.when(F.col("l_partkey") % 17 == 0, -999).otherwise(F.col("l_partkey") % 10000), F.col("l_linenumber") % 3, F.col("l_suppkey") % 5 == 0)).alias("refl")))

query("F9", "size_and_shape", "select poly_id, area_ha from fx_poly where area_ha between 0.4 and 1.1 and 2*((x1-x0)+(y1-y0))/sqrt(cast((x1-x0)*(y1-y0) as double))<=4.2")(
    lambda t: P.size_and_shape(t.poly.withColumn("compactness", 2 * (F.col("x1") - F.col("x0") + F.col("y1") - F.col("y0")) / F.sqrt(((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("double"))), least=0.4, most=1.1, shape=4.2).select("poly_id", "area_ha"))

query("F10", "abstention_cascade", """
  select poly_id, case when area_ha<0.3 then 'area_below_min' when area_ha>1.3 then 'unsegmented_blob' when poly_id%13<2 then 'too_few_observations' when coalesce((poly_id%7)/10.0,0)<0.2 then 'no_crop_signal' when poly_id%5=0 then 'no_crop_shape' else '' end as reason from fx_poly
""")(lambda t: t.poly.select("poly_id", P.abstain_reason(F.col("area_ha"), F.lit(4.0), F.col("poly_id") % 13, F.col("poly_id") % 7 / 10.0, F.col("poly_id") % 5 != 0, min_area=0.3, max_area=1.3, min_obs=2, min_amp=0.2).alias("reason")))

query("F11", "exempt_gate", "select poly_id, poly_id%4=0 as failed, case when poly_id%4<>0 or pred='Legume' then pred end as pred from fx_poly")(
    lambda t: (lambda g: t.poly.select("poly_id", g[0].alias("failed"), g[1].alias("pred")))(P.exempt_gate(F.col("pred"), F.col("poly_id") % 4 != 0, ["Legume"])))

query("F12 F13", "classified_predicate", "select poly_id, pred from fx_poly where (coalesce(abstain_reason,'')='' or abstain_reason in ('no_crop_signal')) and pred in ('Canola','Cereal')")(
    lambda t: t.poly.where(P.is_classified(F.col("abstain_reason"), ["no_crop_signal"]) & F.col("pred").isin("Canola", "Cereal")).select("poly_id", "pred"))

query("F14", "threshold_sweep", """
  select c as cut, cls, sum(case when ha>=c then ha else 0 end) as ha_kept, count(*) filter (ha>=c) as n_kept from fx_mapped, (select unnest([0,200,400,800])::double as c) group by 1,2
""")(lambda t: P.threshold_sweep(t.mapped, "ha", [0, 200, 400, 800], ["cls"], lambda k: [F.sum(F.when(k, F.col("ha")).otherwise(0.0)).alias("ha_kept"), F.count_if(k).alias("n_kept")]))

query("F15", "quantile_cut", "select region, yr, cls, ha from fx_mapped where ha >= (select quantile_cont(ha,0.75) from fx_mapped)")(lambda t: P.quantile_cut(t.mapped, "ha", 0.75))

query("F16", "missing_input_share", """
  select count(*) as n_wanted, count(*) filter (o_custkey is null) as n_missing, round(count(*) filter (o_custkey is null)/cast(count(*) as double),6) as share
  from (select distinct c_custkey from customer) left join (select distinct o_custkey from orders where o_orderstatus='P') on c_custkey=o_custkey
""")(lambda t: P.missing_share(t.customer.select(F.col("c_custkey").alias("k")), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), ["k"]).withColumn("share", r6("share")))

query("F17 F18 F19 F20 X26", "column_contract", """
  select trial_id as trial_id, round(max(red),6) as "red_max@bands", cast(null as double) as extra from fx_ts group by 1
""")(lambda t: P.conform(P.with_suffix(P.keep_families(P.drop_all_null(t.ts.groupBy("trial_id").agg(r6(F.max("red")).alias("red_max"), r6(F.max("nir")).alias("nir_max"), F.max(F.lit(None).cast("double")).alias("red_none"))), ["red"], ["trial_id"]), "bands", ["trial_id"]),
    T.StructType([T.StructField("trial_id", T.LongType()), T.StructField("red_max@bands", T.DoubleType()), T.StructField("extra", T.DoubleType())])))

query("F23 T5", "risk_flags", """
  select poly_id, score, flags from (select poly_id, (case when area_ha<0.4 then 3 else 0 end)+(case when poly_id%4=0 then 3 else 0 end)+(case when coalesce(abstain_reason<>'',false) then 2 else 0 end)+(case when pred='Legume' then 1 else 0 end) as score,
    concat_ws(',', case when area_ha<0.4 then 'small' end, case when poly_id%4=0 then 'seam' end, case when abstain_reason<>'' then 'abstained' end, case when pred='Legume' then 'legume' end) as flags from fx_poly) order by score desc, poly_id
""")(lambda t: (lambda s, n: t.poly.select("poly_id", s.alias("score"), n.alias("flags")).orderBy(F.col("score").desc(), "poly_id"))(*P.risk({
    "small": (F.col("area_ha") < 0.4, 3), "seam": (F.col("poly_id") % 4 == 0, 3), "abstained": (F.col("abstain_reason") != "", 2), "legume": (F.col("pred") == "Legume", 1)})))

query("F24", "triage_reasons", """
  select poly_id, area_ha<0.3 or area_ha>1.2 or poly_id%6=0 as flagged, concat_ws('; ', case when poly_id%6=0 then 'point_outside' end, case when area_ha<0.3 then 'too_small' end, case when area_ha>1.2 then 'too_big' end) as why from fx_poly
""")(lambda t: (lambda s, n: t.poly.select("poly_id", (s > 0).alias("flagged"), F.replace(n, F.lit(","), F.lit("; ")).alias("why")))(*P.risk({
    "point_outside": (F.col("poly_id") % 6 == 0, 1), "too_small": (F.col("area_ha") < 0.3, 1), "too_big": (F.col("area_ha") > 1.2, 1)})))

_VERDICT = "case when poly_id%7=0 then 'good' when poly_id%7=1 then 'bad' end"
query("F25 F29", "policy_fill", f"""
  select poly_id, coalesce({_VERDICT}, case when poly_id%5=0 then 'bad' else 'good' end) as final, case when {_VERDICT} is null then 'unreviewed' when {_VERDICT}='good' then 'good' else 'bad' end as status from fx_poly
""")(lambda t: (lambda v: t.poly.select("poly_id", P.policy_fill(v, F.col("poly_id") % 5 == 0).alias("final"), P.review_status(v).alias("status")))(
    F.when(F.col("poly_id") % 7 == 0, "good").when(F.col("poly_id") % 7 == 1, "bad")))

query("F26 X40", "value_map", """
  select trial, case crop when 0 then 'Canola' when 1 then 'Cereal' when 2 then 'Cereal' when 3 then 'Cereal' else 'Legume' end as grp, coalesce(case crop when 0 then 'a' when 4 then 'b' end, '?') as code from fx_site
""")(lambda t: t.sites.select("trial", P.value_map(F.col("crop"), dict(enumerate(["Canola"] + ["Cereal"] * 3 + ["Legume"] * 5)), strict=True).alias("grp"), F.coalesce(P.value_map(F.col("crop"), {0: "a", 4: "b"}), F.lit("?")).alias("code")))

query("F27", "rename", "select poly_id, pred as predicted_crop_type from fx_poly")(lambda t: t.poly.withColumnRenamed("pred", "predicted_crop_type").select("poly_id", "predicted_crop_type"))

_STUB = "concat('nsw_', kx, '_', 2017+poly_id%5, '_r', ky, 'c', kx)"
query("X20 X21 X22 X23", "stub_strings", f"""
  select poly_id, regexp_extract({_STUB}, '^(.+)_(\\d{{4}})_(r\\d+c\\d+)$', 1) as region, regexp_extract({_STUB}, '^(.+)_(\\d{{4}})_(r\\d+c\\d+)$', 2) as year, regexp_extract({_STUB}, '^(.+)_(\\d{{4}})_(r\\d+c\\d+)$', 3) as cell,
    regexp_replace({_STUB}, '_[^_]*_[^_]*$', '') as base, regexp_replace({_STUB}, '_\\d{{4}}(_r\\d+c\\d+)$', '_2030\\1') as moved, upper(substring({_STUB},1,3)) as head, length({_STUB}) as n, starts_with({_STUB},'nsw_1') as first from fx_poly
""")(lambda t: (lambda s: t.poly.select("poly_id", *(c.alias(n) for n, c in X.stub_parts(s).items()), X.stub_region(s).alias("base"), X.stub_with_year(s, 2030).alias("moved"),
    F.upper(F.substring(s, 1, 3)).alias("head"), F.length(s).alias("n"), s.startswith("nsw_1").alias("first")))(F.concat(F.lit("nsw_"), F.col("kx"), F.lit("_"), 2017 + F.col("poly_id") % 5, F.lit("_r"), F.col("ky"), F.lit("c"), F.col("kx"))))

query("X24", "split_to_rows", "select poly_id, unnest(string_split(concat(pred, ';', kx, ';', ky), ';')) as part from fx_poly")(lambda t: t.poly.select("poly_id", F.explode(F.split(F.concat_ws(";", "pred", "kx", "ky"), ";")).alias("part")))

query("X25", "signed_stub", "select poly_id, concat('e', case when x0<0 then 'm' else 'p' end, lpad(cast(abs(x0) as varchar),4,'0')) as stub from fx_poly")(lambda t: t.poly.select("poly_id", X.signed_stub("e", F.col("x0")).alias("stub")))

query("X31", "crop_year", """
  select o_orderkey, year(o_orderdate) as crop_year, case when o_orderkey%10=0 then null else year(o_orderdate) end as parsed from orders
""")(lambda t: (lambda y: t.orders.select("o_orderkey", X.crop_year(F.concat(y, F.lit("-"), F.lpad((y + 1) % 100, 2, "0"))).alias("crop_year"),
    X.crop_year(F.when(F.col("o_orderkey") % 10 == 0, "total").otherwise(F.concat(y, F.lit("–"), F.lpad((y + 1) % 100, 2, "0")))).alias("parsed")))(F.year("o_orderdate")))

query("X32 S34", "log_scan", """
  select o_orderkey, o_orderkey%3 as exit_status, round(o_totalprice,2) as service_units, (o_orderkey%100)*3600+(o_custkey%60)*60+o_orderkey%60 as seconds from orders
""")(lambda t: (lambda line: t.orders.select("o_orderkey", line.alias("line")).select("o_orderkey", F.regexp_extract("line", r"Exit Status:\s+(\d+)", 1).cast("long").alias("exit_status"),
    F.regexp_extract("line", r"Service Units:\s+([\d.]+)", 1).cast("double").alias("service_units"), X.clock_seconds(F.regexp_extract("line", r"Walltime:\s+(\d+:\d+:\d+)", 1)).alias("seconds")))(
    F.concat(F.lit("Exit Status: "), F.col("o_orderkey") % 3, F.lit(" Service Units: "), F.format_string("%.2f", F.round("o_totalprice", 2)), F.lit(" Walltime: "), F.lpad(F.col("o_orderkey") % 100, 2, "0"), F.lit(":"), F.lpad(F.col("o_custkey") % 60, 2, "0"), F.lit(":"), F.lpad(F.col("o_orderkey") % 60, 2, "0"))))

query("X34", "right_closed_bins", "select poly_id, case when area_ha>0 and area_ha<=0.4 then '(0,0.4]' when area_ha>0.4 and area_ha<=0.8 then '(0.4,0.8]' when area_ha>0.8 and area_ha<=2 then '(0.8,2]' end as size_bin from fx_poly")(
    lambda t: t.poly.select("poly_id", X.right_closed_bin(F.col("area_ha"), [0, 0.4, 0.8, 2]).alias("size_bin")))

query("X36 X37", "ratio_and_rounding", "select poly_id, round(abs(ln(area_ha/0.8)),6) as log_ratio, abs(ln(area_ha/0.8))<=ln(1.5) as near, round_even(area_ha*10,0) as even from fx_poly")(
    lambda t: t.poly.select("poly_id", r6(X.log_area_ratio(F.col("area_ha"), F.lit(0.8))).alias("log_ratio"), (X.log_area_ratio(F.col("area_ha"), F.lit(0.8)) <= F.ln(F.lit(1.5))).alias("near"), F.rint(F.col("area_ha") * 10).alias("even")))

query("X38", "list_cells", "select kx, count(*) as n, round(median(area_ha),6) as med from fx_poly group by 1")(
    lambda t: t.poly.groupBy("kx", "ky").agg(F.collect_list("area_ha").alias("l")).groupBy("kx").agg(F.flatten(F.collect_list("l")).alias("l")).select("kx", F.explode("l").alias("a")).groupBy("kx").agg(F.count("*").alias("n"), r6(F.median("a")).alias("med")))

query("X39", "embedding_columns", "select vec_id, round(cast(embedding[1] as double),6) as presto_000, round(cast(embedding[2] as double),6) as presto_001, round(cast(embedding[64] as double),6) as presto_063 from embeddings")(
    lambda t: t.embeddings.select("vec_id", *(r6(F.element_at("embedding", i + 1).cast("double")).alias(f"presto_{i:03d}") for i in (0, 1, 63))))

query("X41", "json_properties", "select event_id, cast(json_extract(props,'$.k') as integer) as k from events")(lambda t: t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k")))

query("A11 A13 A65", "multi_aggregate", """
  select site, count(*) as n, max(bal) as top, count(distinct crop) as n_crops, bool_or(stratum='BUILDING') as any_building, round(avg(bal),4) as mean_bal,
    (select string_agg(x, ',' order by x) from (select distinct cast(s.crop as varchar) as x from fx_site s where s.site=g.site)) as crops from fx_site g group by site
""")(lambda t: t.sites.groupBy("site").agg(F.count("*").alias("n"), F.max("bal").alias("top"), F.count_distinct("crop").alias("n_crops"), F.bool_or(F.col("stratum") == "BUILDING").alias("any_building"),
    F.round(F.avg("bal"), 4).alias("mean_bal"), F.concat_ws(",", F.array_sort(F.collect_set(F.col("crop").cast("string")))).alias("crops")))
