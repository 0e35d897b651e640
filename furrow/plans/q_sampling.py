"""Queries for orders, limits, chunks and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import sampling as S
from furrow.plans.registry import query

_MIX = "(((({k}*7919+{s}*104729+17)%1000003)*(({k}*7919+{s}*104729+17)%1000003)+{k}*31)%1000003)/1000003.0::double"


def _mix(k: str, s: int = 0) -> str:
    return _MIX.format(k=k, s=s)


query("T1", "locality_order", "select gx, gy, cast(floor(gx/2.0) as bigint) as bx, cast(floor(gy/2.0) as bigint) as by_ from fx_tile")(
    lambda t: S.local_order(t.tiles.select("gx", "gy", F.floor(F.col("gx") / 2).alias("bx"), F.floor(F.col("gy") / 2).alias("by_")), "bx", "by_", "gx", "gy"))

query("T2", "parsed_key_order", "select stub from (select distinct concat('r', gy, 'c', gx) as stub, gx, gy from fx_tile) order by gy, gx")(
    lambda t: t.tiles.select(F.concat(F.lit("r"), "gy", F.lit("c"), "gx").alias("stub")).orderBy(F.regexp_extract("stub", r"r(-?\d+)c", 1).cast("int"), F.regexp_extract("stub", r"c(-?\d+)$", 1).cast("int")))

query("T3 T15", "top_k", "select region, round(sum(ha),4) as ha from fx_mapped group by 1 order by 2 desc, 1 limit 5")(
    lambda t: t.mapped.groupBy("region").agg(F.round(F.sum("ha"), 4).alias("ha")).orderBy(F.col("ha").desc(), "region").limit(5))

query("T4", "greedy_apart")(lambda t: t.spark.createDataFrame(
    [(r["trial"], r["site"], r["bal"]) for r in S.greedy_apart(t.sites, "bal", "trial", "lon", "lat", "site", 1.5, 8)], "trial long, site int, bal double"))

_ALLOWED = "e.site<>{p}.site and (e.lon-{p}.lon)*(e.lon-{p}.lon)+(e.lat-{p}.lat)*(e.lat-{p}.lat)>=2.25"

query("C34", "region_tiles", f"""
  with e as (select trial, site, bal, lon, lat from fx_site where crop<>0 and bal>0),
  p1 as (select * from e order by bal desc, trial limit 1), p2 as (select e.* from e, p1 where {_ALLOWED.format(p="p1")} order by e.bal desc, e.trial limit 1),
  p3 as (select e.* from e, p1, p2 where {_ALLOWED.format(p="p1")} and {_ALLOWED.format(p="p2")} order by e.bal desc, e.trial limit 1),
  p as (select concat('region', n) as region, lon, lat from (select 0 as n, * from p1 union all select 1, * from p2 union all select 2, * from p3) z)
  select concat(region, '_', y, '_r', i, 'c', j) as stub, round(lon+({_mix('y', 7)}-0.5)*0.1+(j-1.5)*0.1,6) as lon, round(lat+({_mix('y', 8)}-0.5)*0.1-(i-1.5)*0.1,6) as lat,
         cast(i as integer) as grid_r, cast(j as integer) as grid_c, cast(y as integer) as year, region
  from p, (select unnest([2023,2024]::bigint[]) as y), (select unnest(range(4)) as i), (select unnest(range(4)) as j)
""")(lambda t: _region_tiles(t))


def _region_tiles(t):
    """The best eligible sites, each far from the others and in a site of its own, and the tiles about them."""
    chosen = S.greedy_apart(t.sites.where("crop <> 0 and bal > 0"), "bal", "trial", "lon", "lat", "site", 1.5, 3)
    regions = t.spark.createDataFrame([(f"region{i}", r["lon"], r["lat"]) for i, r in enumerate(chosen)], "region string, lon double, lat double")
    return S.lay_tiles(regions, "region", "lon", "lat", 4, 0.05, [2023, 2024], 7).withColumns({c: F.round(c, 6) for c in ("lon", "lat")})


query("T6", "review_order", "select poly_id, row_number() over (order by (poly_id%3)*1000-area_ha*10, poly_id) as review_order from fx_poly")(
    lambda t: S.row_index(t.poly.select("poly_id", (F.col("poly_id") % 3 * 1000 - F.col("area_ha") * 10).alias("risk")), "risk", "poly_id").select("poly_id", (F.col("row_index") + 1).alias("review_order")))

query("T7", "random_sample", f"select trial from (select trial from fx_site order by {_mix('trial', 3)}, trial limit 100)")(lambda t: S.sample_n(t.sites, "trial", 100, 3).select("trial"))

query("T8", "rarest_flag_sample", f"""
  with f as (select trial, case when crop=0 then 'canola' when bal<0 then 'debt' else stratum end as stratum from fx_site) select trial, stratum from (select *, row_number() over (partition by stratum order by {_mix('trial')}, trial) as rn from f) where rn<=7
""")(lambda t: S.stratified(t.sites.drop("stratum").join(t.sites.select("trial", F.col("stratum").alias("s")), "trial"), F.when(F.col("crop") == 0, "canola").when(F.col("bal") < 0, "debt").otherwise(F.col("s")), "trial", 7).select("trial", "stratum"))

query("T9", "cluster_sample", f"select distinct t.gx+i as gx, t.gy+j as gy from fx_tile t, (select unnest(range(3)) as i), (select unnest(range(3)) as j) where {_mix('((t.gx+50)*1000+t.gy+50)', 2)}<0.2 and (t.gx+i, t.gy+j) in (select gx, gy from fx_tile)")(
    lambda t: S.cluster_blocks(t.tiles.where(S.mixed((F.col("gx") + 50) * 1000 + F.col("gy") + 50, 2) < 0.2), 3, t.tiles, "gx", "gy"))

query("T10", "contiguous_chunks", "select chunk, count(*) as n, min(poly_id) as first_id from (select poly_id, ntile(7) over (order by poly_id)-1 as chunk from fx_poly) group by 1")(
    lambda t: S.chunks(t.poly, 7, "poly_id").groupBy("chunk").agg(F.count("*").alias("n"), F.min("poly_id").alias("first_id")))

query("T11", "group_chunks", "select poly_id, cast(floor((dense_rank() over (order by ky)-1)/3) as bigint) as chunk from fx_poly")(lambda t: S.group_chunks(t.poly, "ky", 3).select("poly_id", "chunk"))

query("T12 T13", "fixed_chunks_and_stride", "select poly_id, (row_number() over (order by poly_id)-1)//100 as chunk from fx_poly qualify (row_number() over (order by poly_id)-1)%4=1")(
    lambda t: S.strided(S.fixed_chunks(t.poly, 100, "poly_id"), 4, 1, "poly_id").select("poly_id", "chunk"))

query("T14 S37", "range_shards", "select cast(floor((poly_id-1)/40.0) as bigint) as shard, count(*) as n from fx_poly group by 1")(
    lambda t: t.poly.groupBy(S.range_shard(F.col("poly_id"), 40).alias("shard")).agg(F.count("*").alias("n")))

query("T16", "random_retention", f"select r as draw, count(*) as n from fx_site, (select unnest(range(4)) as r) where {_mix('trial', 'r')}<0.3 group by 1")(
    lambda t: t.sites.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).where(((lambda a: (a * a + F.col("trial") * 31) % 1000003 / 1000003.0)((F.col("trial") * 7919 + F.col("draw") * 104729 + 17) % 1000003)) < 0.3).groupBy("draw").agg(F.count("*").alias("n")))

query("T17", "capped_status_sample", f"select trial, stratum from (select trial, stratum, row_number() over (partition by stratum order by {_mix('trial')}, trial) as rn from fx_site) where rn <= case when stratum='BUILDING' then 1000000 else 5 end")(
    lambda t: S.stratified(t.sites.withColumnRenamed("stratum", "s"), F.col("s"), "trial", F.when(F.col("s") == "BUILDING", 1_000_000).otherwise(5)).select("trial", "stratum"))

query("W11", "round_robin_pick", f"""
  with a as (select trial, stratum, crop%3 as pool, row_number() over (partition by stratum, crop%3 order by {_mix('trial')}, trial) as rn from fx_site), b as (select *, row_number() over (partition by stratum order by rn, pool, trial) as turn from a)
  select stratum, trial, pool, turn from b where turn<=10
""")(lambda t: S.round_robin(t.sites.withColumn("pool", F.col("crop") % 3), "stratum", "pool", F.col("pool"), "trial", 10).select("stratum", "trial", "pool", "turn"))
