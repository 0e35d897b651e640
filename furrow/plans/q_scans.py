"""Queries that go through files and registered functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import udfs
from furrow.functions.scalars import r6
from furrow.plans.registry import query
from furrow.session import scratch
from furrow.sources import files as S
from furrow.sources.geopackage import GeoPackage

_CSV = "trial long, crop long, site int, yr int, lon double"


def _write_sites(t) -> str:
    path = scratch(t.spark, "csv")
    for k in range(3):
        S.write_csv(t.sites.where(F.col("trial") % 3 == k).select("trial", "crop", "site", "yr", "lon"), path, append=k > 0)
    return path


query("S1 S3 S4", "csv_round_trip", "select trial, crop, site, yr, round(lon,6) as lon from fx_site")(lambda t: S.read_csvs(t.spark, _write_sites(t), _CSV).withColumn("lon", r6("lon")))

query("S2", "csv_pruned_scan", "select distinct trial from fx_site")(lambda t: S.read_csvs(t.spark, _write_sites(t), _CSV, ["trial"]).distinct())

query("S35", "headerless_scan", "select c_custkey as t, c_nationkey as rss, c_acctbal as cg from customer")(lambda t: _headerless(t))


def _headerless(t):
    path = scratch(t.spark, "tsv")
    t.customer.select("c_custkey", "c_nationkey", "c_acctbal").write.csv(path, sep=" ")
    return S.read_csvs(t.spark, path, "t long, rss int, cg double", sep=" ", header=False)


def _boxes(t, path: str):
    at = t.poly.select("poly_id", "pred", F.struct(F.col("x0").alias("xmin"), F.col("y0").alias("ymin"), F.col("x1").alias("xmax"), F.col("y1").alias("ymax")).alias("bbox"))
    at.repartitionByRange(4, "poly_id").sortWithinPartitions("poly_id").write.parquet(path)
    return t.spark.read.parquet(path)


query("S5 S6 S7 S10", "bbox_pruned_scan", "select poly_id, pred from fx_poly where x0<=60 and x1>=30 and y0<=120 and y1>=40")(
    lambda t: S.within_bbox(_boxes(t, scratch(t.spark, "boxes") + ".parquet"), 30, 40, 60, 120).select("poly_id", "pred"))

query("S8", "file_bbox_index", "select count(*) as n, min(x0) as w, max(y1) as n_edge from fx_poly")(
    lambda t: S.file_index(_boxes(t, scratch(t.spark, "boxes") + ".parquet")).agg(F.sum("rows").alias("n"), F.min("w").alias("w"), F.max("n").alias("n_edge")))


def _package(t, layer: str = "crops") -> str:
    """The polygons as a GeoPackage layer."""
    t.spark.dataSource.register(GeoPackage)
    path = scratch(t.spark, "gpkg")
    blob = udfs.box_blob(F.col("x0") * 10, F.col("y0") * 10, F.col("x1") * 10, F.col("y1") * 10)
    t.poly.select(F.col("poly_id").alias("fid"), blob.alias("geom"), "pred", "area_ha", (F.col("poly_id") % 2 == 0).alias("even")).write.format("geopackage").option("layer", layer).mode("append").save(path)
    return path


_LAYER = "fid long, geom binary, pred string, area_ha double, even boolean"


def _layer(t, schema: str = _LAYER, **options):
    reader = t.spark.read.format("geopackage").schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(_package(t))


query("S11 S16 S36", "geopackage_scan", "select poly_id as fid, pred, round(area_ha,6) as area_ha, poly_id%2=0 as even from fx_poly")(lambda t: _layer(t).select("fid", "pred", r6("area_ha").alias("area_ha"), "even"))

query("S12", "geopackage_bbox_scan", "select poly_id as fid from fx_poly where x0*10<=500 and x1*10>=100 and y0*10<=600 and y1*10>=200")(lambda t: _layer(t, "fid long", bbox="100,200,500,600"))

query("S13 UD1 X42", "geopackage_envelopes", "select poly_id as fid, x0*10.0::double as minx, y0*10.0::double as miny, x1*10.0::double as maxx, y1*10.0::double as maxy, 3577 as srid from fx_poly")(lambda t: _envelopes(t))


def _envelopes(t):
    udfs.register(t.spark)
    return _layer(t, "fid long, geom binary").selectExpr("fid", "st_minx(geom) as minx", "st_miny(geom) as miny", "st_maxx(geom) as maxx", "st_maxy(geom) as maxy", "st_srid(geom) as srid")


query("S14 S15", "geopackage_lookup", "select poly_id as fid, pred from fx_poly where poly_id in (select poly_id from fx_poly where abstain_reason='no_crop_signal')")(
    lambda t: _layer(t, "fid long, pred string").join(t.poly.where("abstain_reason = 'no_crop_signal'").select(F.col("poly_id").alias("fid")), "fid", "left_semi"))

query("S17", "rewritten_layer", """
  select poly_id, case when pred='Legume' then 'Merged' else pred end as pred, case when pred='Legume' then 2 end as merge_n from fx_poly where abstain_reason is distinct from 'area_below_min' union all select 100000+poly_id, pred, 3 from fx_poly where abstain_reason is null
""")(lambda t: S.rewritten(t.poly.select("poly_id", "pred"), "poly_id", t.poly.where("abstain_reason = 'area_below_min'"), t.poly.where("pred = 'Legume'").select("poly_id", F.lit("Merged").alias("pred"), F.lit(2).alias("merge_n")),
    t.poly.where("abstain_reason is null").select((F.col("poly_id") + 100000).alias("poly_id"), "pred", F.lit(3).alias("merge_n"))))

query("S18 S40", "stacked_layers", "select poly_id, pred, cast(null as bigint) as kx from fx_poly where pred='Canola' union all select poly_id, null, kx from fx_poly where pred<>'Canola' and kx in (1,2)")(
    lambda t: S.stacked([t.poly.where("pred = 'Canola'").select("poly_id", "pred"), t.poly.where("pred <> 'Canola' and kx in (1, 2)").select("poly_id", "kx")]))

query("S19", "derived_products", "select poly_id, pred as predicted_crop_type, area_ha as hectares from fx_poly where coalesce(abstain_reason,'')='' and area_ha>=0.5")(
    lambda t: S.derived(t.poly.select("poly_id", "pred", "area_ha", "abstain_reason"), (F.coalesce("abstain_reason", F.lit("")) == "") & (F.col("area_ha") >= 0.5), {"pred": "predicted_crop_type", "area_ha": "hectares"}).drop("abstain_reason"))

query("S23 S27 S29", "raster_window_and_sample", """
  with c as (select px, py, max(poly_id) as v from fx_px where px between 10 and 60 and py between 0 and 80 group by 1,2) select s.trial, c.v from (select trial, 10+trial%50 as sx, trial*7%80 as sy from fx_site) s join c on c.px=s.sx and c.py=s.sy
""")(lambda t: t.px.where("px between 10 and 60 and py between 0 and 80").groupBy("px", "py").agg(F.max("poly_id").alias("v")).join(t.sites.select("trial", (10 + F.col("trial") % 50).alias("px"), (F.col("trial") * 7 % 80).alias("py")), ["px", "py"]).select("trial", "v"))

query("S24", "lenient_scan", "select count(*) as n from fx_poly")(lambda t: _lenient(t))


def _lenient(t):
    path = scratch(t.spark, "lenient") + ".parquet"
    t.poly.write.parquet(path)
    t.spark.createDataFrame([("not parquet",)], "value string").coalesce(1).write.mode("append").text(path)
    return S.read_table(t.spark, path, t.poly.schema, lenient=True).agg(F.count("poly_id").alias("n"))


query("S30 U6", "densified_store", """
  with v as (select site, yr, count(*) as n from fx_site where bal>9500 group by 1,2) select k.site, d.yr, m.n from (select distinct site from v) k cross join (select distinct yr from v) d left join v m on m.site=k.site and m.yr=d.yr
""")(lambda t: S.densified(t.sites.where("bal > 9500").groupBy("site", "yr").agg(F.count("*").alias("n")), "site", "yr", ["n"]))

query("S33", "json_summary", "select concat('{\"n\":', count(*), ',\"top\":\"', max(pred), '\"}') as summary from fx_poly")(lambda t: S.summary_json(t.poly.agg(F.count("*").alias("n"), F.max("pred").alias("top"))))

query("S34", "log_epilogue", "select concat('job', o_orderkey) as file, cast(o_orderkey%2 as integer) as exit_status, round(o_totalprice,1) as service_units, '01:02:03' as walltime from orders")(lambda t: _logs(t))


def _logs(t):
    k = F.col("o_orderkey")
    lines = F.array(F.concat(F.lit("  Exit Status:        "), k % 2), F.concat(F.lit("  Service Units:      "), F.format_string("%.1f", F.round("o_totalprice", 1))), F.lit("  Walltime Used: 01:02:03"), F.lit("noise"))
    return S.epilogue(t.orders.select(F.concat(F.lit("job"), k).alias("file"), F.explode(lines).alias("value")))


query("S37", "sharded_export", "select poly_id, pred as PRED_CROP, area_ha as HECTARES, cast(floor(poly_id/100.0) as integer) as shard from fx_poly")(lambda t: _shards(t))


def _shards(t):
    path = scratch(t.spark, "shards")
    S.sharded(t.poly.select("poly_id", "pred", "area_ha"), path, F.floor(F.col("poly_id") / 100).cast("int"), {"pred": "PRED_CROP", "area_ha": "HECTARES"})
    return t.spark.read.parquet(path)


query("S39 S42", "lookup_export", "select poly_id, concat('t', poly_id, '_ndwi.tif') as link, pred, round((x0+x1)/2.0::double,6) as cx, round((y0+y1)/2.0::double,6) as cy from fx_poly")(
    lambda t: t.poly.select("poly_id", F.concat(F.lit("t"), "poly_id", F.lit("_ndwi.tif")).alias("link"), "pred", r6((F.col("x0") + F.col("x1")) / 2.0).alias("cx"), r6((F.col("y0") + F.col("y1")) / 2.0).alias("cy")))

query("S20 S21 S22", "sheet_parser", """
  select * from (values ('Canola','NSW','''000 ha','2019-20',1000.0::double),('Canola','NSW','''000 ha','2020-21',2000.0),('Canola','VIC','t','2019-20',3.0),('Wheat','NSW','''000 ha','2020-21',4000.0)) as v(section, item, unit, season, value)
""")(lambda t: _sheet(t))


def _sheet(t):
    from furrow.sources.sheets import parse_sheet

    rows = [["Table 1", None, None], ["", "unit", "2017-18", "2018-19", "2019-20", "2020-21", "2021-22"], ["Canola", None], ["NSW", "'000 ha", None, None, 1, 2], ["VIC", "t", None, None, 3], ["Wheat", None], ["NSW", "'000 ha", None, None, None, 4]]
    return parse_sheet(t.spark, rows)


query("S28 S26 S25", "cells_round_trip", "select kx, ky, px, py, poly_id from fx_px")(lambda t: _cells(t))


def _cells(t):
    path = scratch(t.spark, "cells")
    t.px.select("poly_id", "kx", "ky", "px", "py").write.partitionBy("kx", "ky").parquet(path)
    return t.spark.read.schema("poly_id long, px long, py long, kx long, ky long").parquet(path).select("kx", "ky", "px", "py", "poly_id")


query("UD2", "longest_run", """
  with e as (select user_id, event_type='error' as f, row_number() over (partition by user_id order by ts, event_id) as r from events), g as (select user_id, r-row_number() over (partition by user_id, f order by r) as g, f from e)
  select user_id, cast(coalesce(max(n),0) as integer) as longest from (select distinct user_id from events) left join (select user_id, count(*) as n from g where f group by user_id, g) using (user_id) group by 1
""")(lambda t: t.events.groupBy("user_id").agg(udfs.longest_run(F.col("event_type") == "error", F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000).alias("longest")))

query("UD3", "aoi_table_function", "select trial, i, j, round(lon+(i-1)*0.1,6) as lon, round(lat+(j-1)*0.1,6) as lat from fx_site, (select unnest(range(3)) as i), (select unnest(range(3)) as j) ")(lambda t: _aois(t))


def _aois(t):
    udfs.aois_table(t.spark)
    t.sites.createOrReplaceTempView("furrow_sites")
    return t.spark.sql("select trial, a.i, a.j, round(a.lon, 6) as lon, round(a.lat, 6) as lat from furrow_sites, lateral aois(lon, lat, 3, 0.1D) a")
