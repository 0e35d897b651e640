"""Queries for joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions.scalars import r6
from furrow.operators import joins as J
from furrow.plans.registry import query

query("J1 J2", "feature_blocks", """
  select o_orderkey, c_mktsegment, coalesce(n,0) as n from orders join customer on o_custkey=c_custkey left join (select l_orderkey, count(*) as n from lineitem where l_returnflag='A' group by 1) on o_orderkey=l_orderkey
""")(lambda t: t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.lineitem.where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n")), "o_orderkey", "left").select("o_orderkey", "c_mktsegment", F.coalesce("n", F.lit(0)).alias("n")))

query("J3", "left_join_same_rows", "select c_custkey, n_name from customer left join nation on c_nationkey=n_nationkey")(
    lambda t: J.unique_left_join(t.customer.select("c_custkey", F.col("c_nationkey").alias("k")), t.nation.select(F.col("n_nationkey").alias("k"), "n_name"), ["k"]).select("c_custkey", "n_name"))

query("J4", "full_outer", """
  select coalesce(a.k,b.k) as k, a.n as n_a, b.n as n_b from (select o_custkey as k, count(*) as n from orders where o_orderstatus='P' group by 1) a full join (select o_custkey as k, count(*) as n from orders where o_orderstatus='F' group by 1) b on a.k=b.k
""")(lambda t: (lambda f: f("P", "n_a").join(f("F", "n_b"), "k", "full_outer"))(lambda s, n: t.orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias(n))))

query("J5", "multi_key_join", "select m.region, m.yr, m.cls, round(m.ha,6) as ha, round(s.ha,6) as ref from fx_mapped m join fx_stat s on m.region=s.region and m.yr=s.yr and m.cls=s.cls")(
    lambda t: t.mapped.join(t.stat.withColumnRenamed("ha", "ref"), ["region", "yr", "cls"]).select("region", "yr", "cls", r6("ha").alias("ha"), r6("ref").alias("ref")))

query("J7", "semi_join_tuples", "select region, yr, cls from fx_mapped where (region, yr) in (select region, yr from fx_stat where cls='Legume' and ha>5000)")(
    lambda t: t.mapped.join(t.stat.where("cls = 'Legume' and ha > 5000"), ["region", "yr"], "left_semi").select("region", "yr", "cls"))

query("J8 U4", "anti_join_pending", "select distinct user_id from events where user_id not in (select user_id from events where event_type='error' and value>40)")(
    lambda t: J.pending(t.events.select("user_id").distinct(), t.events.where("event_type = 'error' and value > 40").select("user_id"), ["user_id"]))

query("J9", "lookup_map", "select trial, n_name as place from fx_site left join nation on site=n_nationkey")(
    lambda t: t.sites.join(t.nation.select(F.col("n_nationkey").alias("site"), F.col("n_name").alias("place")), "site", "left").select("trial", "place"))

query("J10 C23", "change_status", """
  with o as (select trial, crop%3 as g from fx_site where bal>-500), n as (select trial, case when trial%4=0 then (crop+1)%3 else crop%3 end as g from fx_site)
  select n.trial, n.g, case when o.trial is null then 'new' when o.g=n.g then 'unchanged' else 'changed' end as status from n left join o on n.trial=o.trial
""")(lambda t: J.changes(t.sites.where("bal > -500").select("trial", (F.col("crop") % 3).alias("g")), t.sites.select("trial", F.when(F.col("trial") % 4 == 0, (F.col("crop") + 1) % 3).otherwise(F.col("crop") % 3).alias("g")), "trial", "g"))

query("J21", "claim_aware_matching")(lambda t: J.claim_matching(
    t.sites.select((F.col("site") % 5).alias("aoi"), "yr", "trial", (F.col("crop") % 3).alias("kind"), F.explode(F.array((F.col("trial") % 50), (F.col("trial") % 50) + 1, (F.col("trial") % 50) + 2)).alias("poly_idx")),
    ["aoi", "yr"], ["trial", "poly_idx"], "trial", "poly_idx", "kind", "aoi int, yr int, trial long, kind long, poly_idx long"))

query("J31", "first_donor", """
  select a.poly_id, a.yr, d.yr as donor_yr from fx_poly_year a left join (select poly_id, yr, row_number() over (partition by poly_id order by abs(yr-2019), yr) as rn from fx_poly_year where yr<>2018) d on a.poly_id=d.poly_id and d.rn=1 where a.yr=2018
""")(lambda t: J.first_donor(t.poly_year.where("yr = 2018").select("poly_id", "yr"), t.poly_year.where("yr <> 2018").select("poly_id", F.col("yr").alias("donor_yr"), (F.abs(F.col("yr") - 2019) * 10000 + F.col("yr")).alias("rank")), ["poly_id"], "rank").drop("rank"))

query("J32", "reviewer_overlap", """
  select count(*) as n_both, count(*) filter (a.v=b.v) as n_same from (select trial, crop%2 as v from fx_site where bal>0) a join (select trial, (crop+trial)%2 as v from fx_site where crop<5) b using (trial)
""")(lambda t: J.overlap_agreement(t.sites.where("bal > 0").select("trial", (F.col("crop") % 2).alias("v")), t.sites.where("crop < 5").select("trial", ((F.col("crop") + F.col("trial")) % 2).alias("v")), "trial", "v"))

query("U1", "union_by_name", "select c_custkey as k, c_acctbal as bal, null as size from customer union all select p_partkey, null, p_size from part")(
    lambda t: t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal")).unionByName(t.part.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size")), allowMissingColumns=True))

query("U2 U6", "distinct_union", "select cast(l_shipdate as date) as d from lineitem where l_linenumber=1 union select cast(o_orderdate as date) from orders")(
    lambda t: t.lineitem.where("l_linenumber = 1").select(F.to_date("l_shipdate").alias("d")).union(t.orders.select(F.to_date("o_orderdate"))).distinct())

query("U3", "intersection", "select l_suppkey as k from lineitem intersect select c_custkey from customer")(lambda t: t.lineitem.select(F.col("l_suppkey").alias("k")).intersect(t.customer.select("c_custkey")))

query("U4", "difference", "select p_partkey as k from part except select l_partkey from lineitem where l_quantity>45")(lambda t: t.part.select(F.col("p_partkey").alias("k")).subtract(t.lineitem.where("l_quantity > 45").select("l_partkey")))

query("U5", "mask_union", "select px, py, max(v) as v from (select px, py, case when poly_id%2=0 then 1 else 0 end as v from fx_px union all select px+1, py, case when poly_id%3=0 then 1 else 0 end from fx_px) group by 1,2")(
    lambda t: t.px.select("px", "py", (F.col("poly_id") % 2 == 0).cast("int").alias("v")).unionAll(t.px.select(F.col("px") + 1, "py", (F.col("poly_id") % 3 == 0).cast("int"))).groupBy("px", "py").agg(F.max("v").alias("v")))

query("W3", "last_per_group", "select region, yr, round(ha,4) as ha from (select *, row_number() over (partition by region order by ha desc, yr, cls) as rn from fx_mapped) where rn=1")(
    lambda t: t.mapped.groupBy("region").agg(F.max(F.struct("ha", (-F.col("yr")).alias("y"))).alias("s")).select("region", (-F.col("s.y")).alias("yr"), F.round("s.ha", 4).alias("ha")))

query("W10 S21", "fill_down", """
  select event_id, last_value(case when event_type='error' then user_id end ignore nulls) over (partition by user_id%10 order by ts, event_id rows between unbounded preceding and current row) as label from events
""")(lambda t: _fill_down(t))


def _fill_down(t):
    from furrow.sources.sheets import fill_down

    return fill_down(t.events.withColumn("part", F.col("user_id") % 10).withColumn("label", F.when(F.col("event_type") == "error", F.col("user_id"))), "label", ["part"], ["ts", "event_id"]).select("event_id", "label")


query("W12", "sequence_string", """
  with y as (select unnest([2017,2018,2019,2020,2021]) as yr), k as (select distinct poly_id from fx_poly_year)
  select poly_id, string_agg(coalesce(c,'.'), '-' order by yr) as crop_seq from (select k.poly_id, y.yr, case when p.poly_id is not null then substring('CWL', cast((p.poly_id+p.yr)%3+1 as integer), 1) end as c from k cross join y left join fx_poly_year p on p.poly_id=k.poly_id and p.yr=y.yr) group by 1
""")(lambda t: _sequence(t))


def _sequence(t):
    from furrow.operators.identity import year_sequence

    return year_sequence(t.poly_year.select("poly_id", "yr", F.substring(F.lit("CWL"), (F.col("poly_id") + F.col("yr")) % 3 + 1, F.lit(1)).alias("c")), "poly_id", "yr", "c", list(range(2017, 2022)), "crop_seq")

