"""Field identity across years: stability, constrained groups, consensus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from furrow.operators.geometry import dealt
from furrow.operators.graph import components


def year_sequence(df: DataFrame, key: str, year: str, value: str, years: list[int], name: str, sep: str = "-", missing: str = ".") -> DataFrame:
    """One value per year, in order, joined to a text; years without a row have a mark of their own."""
    return df.groupBy(key).agg(F.concat_ws(sep, *(F.coalesce(F.max(F.when(F.col(year) == y, F.col(value))), F.lit(missing)) for y in years)).alias(name))


def stability(pairs: DataFrame, polygons: DataFrame, years: list[int], iou_hit: float = 0.5) -> DataFrame:
    """Per polygon and year: years matched, median IoU over the other years (0 where unmatched), mean IoU of hits, identity.

    ``pairs`` has a, yr, b, other, iou for overlapping polygons of different years; polygons are
    joined to identities over hits by connected components.
    """
    # A polygon's best IoU of every year in one row: as many rows as polygons are joined, not one for each other year.
    best = pairs.groupBy("a", "yr").agg(*(F.max(F.when(F.col("other") == y, F.col("iou"))).alias(f"_{y}") for y in years))
    full = dealt(polygons.select(F.col("poly_id").alias("a"), "yr").where("yr is not null").distinct()).join(dealt(best), ["a", "yr"], "left")
    ious = F.array_compact(F.array(*(F.when(F.col("yr") != y, F.coalesce(f"_{y}", F.lit(0.0))) for y in years)))
    n, hits = F.size("_ious"), F.filter("_ious", lambda v: v >= iou_hit)
    middle = (F.get("_ious", F.floor((n - 1) / 2).cast("int")) + F.get("_ious", F.floor(n / 2).cast("int"))) / 2
    stats = full.withColumn("_ious", F.array_sort(ious)).where(n > 0).select(
        "a", "yr", F.size(hits).cast("long").alias("n_years"), middle.alias("median_iou"),
        F.try_divide(F.aggregate(hits, F.lit(0.0), lambda s, v: s + v), F.size(hits).cast("double")).alias("mean_iou_hits"),
    )
    node = lambda k, y: F.col(k) * 10000 + F.col(y)
    edges = pairs.where(F.col("iou") >= iou_hit).select(node("a", "yr").alias("src"), node("b", "other").alias("dst"))
    named = dealt(components(edges))
    return stats.withColumn("node", node("a", "yr")).join(named, "node", "left").select("a", "yr", "n_years", "median_iou", "mean_iou_hits", F.coalesce("component", "node").alias("paddock_id"))


def constrained_groups(pairs: DataFrame, boxes: DataFrame, region: str, max_diagonal: float, max_ratio: float) -> DataFrame:
    """Union-find that refuses a merge whose box grows beyond a diagonal or whose areas differ too much.

    What is refused depends on the order, which is by falling IoU, then ids; regions are independent
    and bounded by an area's polygons, so each is one group of work.
    """
    left = boxes.select(region, F.col("id").alias("a"), *(F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1", "area")))
    right = boxes.select(F.col("id").alias("b"), *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1", "area")))
    rows = pairs.join(left, "a").join(right, "b").where(F.col("a") < F.col("b"))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict = {}
        box: dict = {}
        area: dict = {}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for r in pdf.sort_values(["iou", "a", "b"], ascending=[False, True, True]).to_dict("records"):
            for s in "ab":
                if r[s] not in parent:
                    parent[r[s]] = r[s]
                    box[r[s]] = tuple(r[f"{s}_{c}"] for c in ("x0", "y0", "x1", "y1"))
                    area[r[s]] = (r[f"{s}_area"], r[f"{s}_area"])
            a, b = find(r["a"]), find(r["b"])
            if a == b:
                continue
            p, q = box[a], box[b]
            joint = (min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3]))
            low, high = min(area[a][0], area[b][0]), max(area[a][1], area[b][1])
            if ((joint[2] - joint[0]) ** 2 + (joint[3] - joint[1]) ** 2) ** 0.5 > max_diagonal or high > max_ratio * low:
                continue
            keep, gone = min(a, b), max(a, b)
            parent[gone], box[keep], area[keep] = keep, joint, (low, high)
        return pd.DataFrame({"id": list(parent), "group_id": [find(x) for x in parent]}, columns=["id", "group_id"])

    return rows.groupBy(region).applyInPandas(group, "id long, group_id long")


def consensus(members: DataFrame, years: list[int], least_area: float = 0.0) -> DataFrame:
    """Per identity its largest polygon, the crop and confidence of each year, and what they sum to.

    ``members`` has paddock_id, yr, id, area_ha, crop, conf; the crop of a year is that of the largest
    summed area, the confidence a plain mean.
    """
    first = Window.partitionBy("paddock_id").orderBy(F.col("area_ha").desc(), "id")
    rep = members.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select("paddock_id", F.col("id").alias("rep_id"), F.col("yr").alias("from_year"), "area_ha").where(F.col("area_ha") >= least_area)
    sums = members.groupBy("paddock_id", "yr", "crop").agg(F.sum("area_ha").alias("ha"), F.avg("conf").alias("conf"))
    best = Window.partitionBy("paddock_id", "yr").orderBy(F.col("ha").desc(), "crop")
    won = sums.withColumn("_rn", F.row_number().over(best)).where("_rn = 1")
    pick = lambda c, y: F.max(F.when(F.col("yr") == y, F.col(c)))
    wide = won.groupBy("paddock_id").agg(
        *(pick("crop", y).alias(f"crop_{y}") for y in years), *(pick("conf", y).alias(f"conf_{y}") for y in years),
        F.count("*").alias("n_class_years"), F.count_distinct("crop").alias("n_classes"), F.count_if(F.col("crop") == "Canola").alias("canola_years"),
        F.concat_ws("-", *(F.coalesce(F.substring(pick("crop", y), 1, 2), F.lit(".")) for y in years)).alias("crop_seq"),
        F.collect_list(F.struct("crop")).alias("_crops"),
    )
    # The crop of most years, the first by name of ties: an identity has a few years, so its own row says it.
    often = F.transform(F.array_distinct("_crops"), lambda c: F.struct((-F.size(F.filter("_crops", lambda x: x.eqNullSafe(c)))).alias("n"), c.alias("c")))
    return dealt(rep).join(dealt(wide.withColumn("modal_crop", F.array_min(often)["c"]["crop"]).drop("_crops")), "paddock_id")


def share_of_rows(cond: Column) -> Column:
    return F.avg(cond.cast("double"))
