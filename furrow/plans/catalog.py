"""The driver's tables, and views over them in the roles of the domain; each view also as DuckDB SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CROPS = ("Canola", "Cereal", "Legume")
#: Nine species and their groups, by code.
SPECIES = ("Canola", "Wheat", "Barley", "Oat", "Lentil", "Chickpea", "Field Pea", "Faba Bean", "Lupin")

CTES = """
fx_ts_raw as (
  select l_suppkey*10000+year(l_shipdate) as trial_id, l_suppkey as site_id, year(l_shipdate) as yr,
         cast(l_shipdate as date) as d, dayofyear(l_shipdate) as doy, cast(l_quantity as int) as n_clear, 50 as n_px,
         0.02+l_tax*0.5 as blue, 0.04+l_quantity/500 as green, 0.03+l_discount*1.5 as red,
         case when l_orderkey % 29 = 0 then null else 0.15+((l_partkey*37+l_orderkey*11)%500)/1000.0::double end as nir,
         0.1+(l_partkey%40)/200.0::double as re1, 0.12+(l_partkey%50)/180.0::double as re2, 0.14+(l_partkey%60)/170.0::double as re3,
         0.2+(l_orderkey%70)/300.0::double as sw2, 0.15+(l_orderkey%60)/290.0::double as sw3,
         l_orderkey, l_linenumber, l_partkey, l_extendedprice
  from lineitem),
fx_ts as (
  select * exclude (rn) from (select *, row_number() over (partition by trial_id, d order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as rn from fx_ts_raw) z
  where rn = 1 and n_clear/cast(n_px as double) >= 0.5),
fx_trial as (
  select distinct trial_id, site_id, yr, cast((site_id*7+yr*3)%9 as integer) as crop, make_date(cast(yr as integer),1,1) + cast(60+site_id%60 as integer) as sow,
         make_date(cast(yr as integer),1,1) + cast(270+site_id%60 as integer) as harv from fx_ts_raw),
fx_poly as (
  select k as poly_id, kx, ky, kx*20+(k*7)%27-7 as x0, ky*20+(k*11)%23-6 as y0, kx*20+(k*7)%27-7+w as x1, ky*20+(k*11)%23-6+h as y1,
         w*h/100.0::double as area_ha, case k*5%3 when 0 then 'Canola' when 1 then 'Cereal' else 'Legume' end as pred,
         case when k%11=0 then 'area_below_min' when k%11=1 then 'no_crop_signal' when k%11=2 then null else '' end as abstain_reason,
         (k%5+1)/cast(k%5+k%3+k%7+3 as double) as p_canola, (k%3+1)/cast(k%5+k%3+k%7+3 as double) as p_cereal, (k%7+1)/cast(k%5+k%3+k%7+3 as double) as p_legume
  from (select cast(p_partkey as bigint) as k, cast(floor(p_partkey/4) as bigint)%5 as kx, cast(floor(p_partkey/20) as bigint) as ky,
               cast(4+p_size%9 as bigint) as w, cast(4+(p_size*3+p_partkey)%9 as bigint) as h from part) q),
fx_px as (select poly_id, kx, ky, px, unnest(range(y0, y1)) as py from (select poly_id, kx, ky, y0, y1, unnest(range(x0, x1)) as px from fx_poly)),
fx_poly_year as (
  select poly_id, kx, ky, yr, x0+(poly_id*13+yr*5)%3-1 as x0, y0+(poly_id*7+yr*3)%3-1 as y0,
         x1+(poly_id*13+yr*5)%3-1+(poly_id+yr)%2 as x1, y1+(poly_id*7+yr*3)%3-1 as y1
  from fx_poly cross join (select unnest([2017,2018,2019,2020,2021]) as yr) ys where (poly_id+yr)%4<>0),
fx_mapped as (
  select s_nationkey as region, year(l_shipdate) as yr, case l_returnflag when 'A' then 'Canola' when 'N' then 'Cereal' else 'Legume' end as cls, sum(l_quantity) as ha
  from lineitem join supplier on l_suppkey=s_suppkey group by 1,2,3),
fx_stat as (
  select c_nationkey as region, year(o_orderdate) as yr, case o_orderstatus when 'F' then 'Canola' when 'O' then 'Cereal' else 'Legume' end as cls, sum(o_totalprice)/1000 as ha
  from orders join customer on o_custkey=c_custkey group by 1,2,3),
fx_pred as (
  select o_orderkey as id, o_custkey%40 as site, year(o_orderdate) as yr, case o_orderstatus when 'F' then 'Canola' when 'O' then 'Cereal' else 'Legume' end as truth,
         case cast(substring(o_orderpriority,1,1) as integer)%3 when 0 then 'Canola' when 1 then 'Cereal' else 'Legume' end as pred,
         o_totalprice/500000.0::double as score from orders),
fx_site as (
  select c_custkey as trial, c_custkey%9 as crop, 115+(c_custkey*37%3500)/100.0::double as lon, -40+(c_custkey*53%1400)/100.0::double as lat,
         c_nationkey as site, cast(2017+c_custkey%5 as integer) as yr, c_mktsegment as stratum, c_acctbal as bal from customer),
fx_tile as (select distinct cast(floor(x0/20) as bigint) as gx, cast(floor(y0/20) as bigint) as gy from fx_poly)
"""


def with_ctes(sql: str) -> str:
    """SQL over the domain's views: their definitions go before it."""
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {CTES.strip()},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {CTES.strip()},\n{body[5:]}"
    return f"with {CTES.strip()}\n{body}"


def case_of(col: str | F.Column, names: dict) -> F.Column:
    """A value map as CASE: keys to values, the last key's value for the rest when it is None."""
    out = None
    col = F.col(col) if isinstance(col, str) else col
    rest = names.get(None)
    for k, v in names.items():
        if k is not None:
            out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out.otherwise(rest) if rest is not None else out


class Tables:
    """Views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    @cached_property
    def ts_raw(self) -> DataFrame:
        """Observations: one row per trial, date and scene, nir null here and there."""
        q, p, o, s = F.col("l_quantity"), F.col("l_partkey"), F.col("l_orderkey"), F.col("l_suppkey")
        yr = F.year("l_shipdate")
        return self.lineitem.select(
            (s * 10000 + yr).alias("trial_id"), s.alias("site_id"), yr.alias("yr"), F.to_date("l_shipdate").alias("d"),
            F.dayofyear("l_shipdate").alias("doy"), q.cast("int").alias("n_clear"), F.lit(50).alias("n_px"),
            (0.02 + F.col("l_tax") * 0.5).alias("blue"), (0.04 + q / 500).alias("green"), (0.03 + F.col("l_discount") * 1.5).alias("red"),
            F.when(o % 29 != 0, 0.15 + ((p * 37 + o * 11) % 500) / 1000.0).alias("nir"),
            (0.1 + (p % 40) / 200.0).alias("re1"), (0.12 + (p % 50) / 180.0).alias("re2"), (0.14 + (p % 60) / 170.0).alias("re3"),
            (0.2 + (o % 70) / 300.0).alias("sw2"), (0.15 + (o % 60) / 290.0).alias("sw3"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        )

    @cached_property
    def ts(self) -> DataFrame:
        """Observations after the dedup on (trial, date) and the clear-fraction filter.

        They are dealt by trial, which serves the dedup and every aggregate per trial after it.
        """
        from furrow.operators.filters import clear_fraction, dedup_first

        return clear_fraction(dedup_first(self.ts_raw.repartition("trial_id"), ["trial_id", "d"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]))

    @cached_property
    def trial(self) -> DataFrame:
        """Trials with crop code, sowing and harvest date."""
        first = F.make_date("yr", F.lit(1), F.lit(1))
        off = (F.col("site_id") % 60).cast("int")
        return self.ts_raw.select("trial_id", "site_id", "yr").distinct().select(
            "*", ((F.col("site_id") * 7 + F.col("yr") * 3) % 9).cast("int").alias("crop"), F.date_add(first, off + 60).alias("sow"), F.date_add(first, off + 270).alias("harv")
        )

    @cached_property
    def poly(self) -> DataFrame:
        """Field polygons, one for each part, as half-open pixel boxes on a lattice of 20 by 20 tiles, with class and reason.

        They are many times the size of the two columns that they are made of, so joins deal them.
        """
        from furrow.operators.geometry import dealt

        pk = F.col("p_partkey")
        q = self.part.select(
            pk.cast("long").alias("poly_id"), (F.floor(pk / 4) % 5).alias("kx"), F.floor(pk / 20).alias("ky"),
            (4 + F.col("p_size") % 9).cast("long").alias("w"), (4 + (F.col("p_size") * 3 + pk) % 9).cast("long").alias("h"),
        )
        k = F.col("poly_id")
        x0, y0 = F.col("kx") * 20 + (k * 7) % 27 - 7, F.col("ky") * 20 + (k * 11) % 23 - 6
        total = (k % 5 + k % 3 + k % 7 + 3).cast("double")
        return dealt(q).select(
            "poly_id", "kx", "ky", x0.alias("x0"), y0.alias("y0"), (x0 + F.col("w")).alias("x1"), (y0 + F.col("h")).alias("y1"),
            (F.col("w") * F.col("h") / 100.0).alias("area_ha"), case_of(k * 5 % 3, {0: "Canola", 1: "Cereal", None: "Legume"}).alias("pred"),
            F.when(k % 11 == 0, "area_below_min").when(k % 11 == 1, "no_crop_signal").when(k % 11 != 2, "").alias("abstain_reason"),
            ((k % 5 + 1) / total).alias("p_canola"), ((k % 3 + 1) / total).alias("p_cereal"), ((k % 7 + 1) / total).alias("p_legume"),
        )

    @cached_property
    def px(self) -> DataFrame:
        """The polygons' pixels."""
        from furrow.operators.geometry import pixels

        return pixels(self.poly.select("poly_id", "kx", "ky", "x0", "y0", "x1", "y1"))

    @cached_property
    def poly_year(self) -> DataFrame:
        """The polygons over five years, moved and grown a little."""
        k, y = F.col("poly_id"), F.col("yr")
        years = self.poly.select("poly_id", "kx", "ky", "x0", "y0", "x1", "y1", F.explode(F.sequence(F.lit(2017), F.lit(2021))).alias("yr"))
        dx, dy = (k * 13 + y * 5) % 3 - 1, (k * 7 + y * 3) % 3 - 1
        return years.where((k + y) % 4 != 0).select(
            "poly_id", "kx", "ky", "yr", (F.col("x0") + dx).alias("x0"), (F.col("y0") + dy).alias("y0"),
            (F.col("x1") + dx + (k + y) % 2).alias("x1"), (F.col("y1") + dy).alias("y1"),
        )

    @cached_property
    def mapped(self) -> DataFrame:
        """Mapped hectares by region, year and class."""
        cls = case_of("l_returnflag", {"A": "Canola", "N": "Cereal", None: "Legume"})
        joined = self.lineitem.join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        return joined.groupBy(F.col("s_nationkey").alias("region"), F.year("l_shipdate").alias("yr"), cls.alias("cls")).agg(F.sum("l_quantity").alias("ha"))

    @cached_property
    def stat(self) -> DataFrame:
        """The independent statistic's hectares by region, year and class."""
        cls = case_of("o_orderstatus", {"F": "Canola", "O": "Cereal", None: "Legume"})
        joined = self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
        return joined.groupBy(F.col("c_nationkey").alias("region"), F.year("o_orderdate").alias("yr"), cls.alias("cls")).agg((F.sum("o_totalprice") / 1000).alias("ha"))

    @cached_property
    def pred(self) -> DataFrame:
        """Truth, prediction and score per site sample."""
        return self.orders.select(
            F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("site"), F.year("o_orderdate").alias("yr"),
            case_of("o_orderstatus", {"F": "Canola", "O": "Cereal", None: "Legume"}).alias("truth"),
            case_of(F.substring("o_orderpriority", 1, 1).cast("int") % 3, {0: "Canola", 1: "Cereal", None: "Legume"}).alias("pred"),
            (F.col("o_totalprice") / 500000.0).alias("score"),
        )

    @cached_property
    def sites(self) -> DataFrame:
        """Trial sites with crop, coordinates, site, year and stratum."""
        c = F.col("c_custkey")
        return self.customer.select(
            c.alias("trial"), (c % 9).alias("crop"), (115 + (c * 37 % 3500) / 100.0).alias("lon"), (-40 + (c * 53 % 1400) / 100.0).alias("lat"),
            F.col("c_nationkey").alias("site"), (2017 + c % 5).cast("int").alias("yr"), F.col("c_mktsegment").alias("stratum"), F.col("c_acctbal").alias("bal"),
        )

    @cached_property
    def tiles(self) -> DataFrame:
        """Lattice cells that hold a polygon's corner."""
        return self.poly.select(F.floor(F.col("x0") / 20).alias("gx"), F.floor(F.col("y0") / 20).alias("gy")).distinct()


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
