"""Areas by region against statistics, histograms and their readings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from furrow.functions.scalars import r6


def pivot_classes(df: DataFrame, keys: list[str], classes: tuple[str, ...], cls: str = "cls", value: str = "ha") -> DataFrame:
    """Hectares by key with one column per class, zero where a class is absent; the classes are fixed."""
    return df.groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(F.col(cls) == c, F.col(value))), F.lit(0.0)).alias(c.lower()) for c in classes))


def shares(mapped: DataFrame, stat: DataFrame, classes: tuple[str, ...], keys: tuple[str, ...] = ("region", "yr")) -> DataFrame:
    """Class shares of map and statistic per key, their difference, and the ratio of total areas."""
    names = [c.lower() for c in classes]
    m, s = pivot_classes(mapped, list(keys), classes), pivot_classes(stat, list(keys), classes)
    total = reduce(lambda a, b: a + b, (F.col(n) for n in names))
    m = m.select(*keys, total.alias("_m"), *(F.try_divide(F.col(n), total).alias(f"map_{n}") for n in names))
    s = s.select(*keys, total.alias("_s"), *(F.try_divide(F.col(n), total).alias(f"ref_{n}") for n in names))
    joined = m.join(s, list(keys))
    return joined.select(*keys, *(F.col(f"{p}_{n}") for n in names for p in ("map", "ref")), *((F.col(f"map_{n}") - F.col(f"ref_{n}")).alias(f"err_{n}") for n in names), F.try_divide("_m", "_s").alias("area_ratio"))


def correlations(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, Pearson, Spearman (average ranks) and the median absolute difference."""
    rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2.0
    ranked = df.select(a, b, rank(a).alias("_ra"), rank(b).alias("_rb"))
    return ranked.agg(F.count("*").alias("n"), r6(F.corr(a, b)).alias("pearson"), r6(F.corr("_ra", "_rb")).alias("spearman"), r6(F.median(F.abs(F.col(a) - F.col(b)))).alias("med_abs"))


def decomposition(df: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """Per class what dilution by excess area explains of its share, and what it absorbed."""
    one = df.agg(F.avg("area_ratio").alias("ratio"), *(F.avg(f"{p}_{c.lower()}").alias(f"{p}_{c.lower()}") for c in classes for p in ("map", "ref")))
    rows = F.array(*(F.struct(F.lit(c).alias("cls"), (F.col(f"ref_{c.lower()}") / F.col("ratio")).alias("diluted"), (F.col(f"map_{c.lower()}") - F.col(f"ref_{c.lower()}") / F.col("ratio")).alias("absorbed")) for c in classes))
    return one.select(F.explode(rows).alias("r")).select("r.cls", r6("r.diluted").alias("diluted"), r6("r.absorbed").alias("absorbed"))


def hard_and_soft(df: DataFrame, classes: tuple[str, ...], area: str = "area_ha", pred: str = "pred") -> DataFrame:
    """Area shares by the winning class and by mean probability."""
    one = df.agg(F.sum(area).alias("_w"), *(F.sum(F.when(F.col(pred) == c, F.col(area)).otherwise(0.0)).alias(f"h_{c}") for c in classes), *(F.sum(F.col(area) * F.col(f"p_{c.lower()}")).alias(f"s_{c}") for c in classes))
    rows = F.array(*(F.struct(F.lit(c).alias("cls"), (F.col(f"h_{c}") / F.col("_w")).alias("hard"), (F.col(f"s_{c}") / F.col("_w")).alias("soft")) for c in classes))
    return one.select(F.explode(rows).alias("r")).select("r.cls", r6("r.hard").alias("hard"), r6("r.soft").alias("soft"))


def state_difference(mapped: DataFrame, stat: DataFrame, nation: DataFrame, least: float) -> DataFrame:
    """Median absolute area difference per state over years whose reference reaches a floor."""
    up = lambda d, name: d.join(nation, F.col("region") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("state"), "yr").agg(F.sum("ha").alias(name))
    joined = up(mapped, "m").join(up(stat, "s"), ["state", "yr"]).where(F.col("s") >= least)
    return joined.groupBy("state").agg(F.count("*").alias("n"), F.round(F.median(F.abs(F.col("m") - F.col("s"))), 4).alias("med_diff"))


def by_category(df: DataFrame) -> DataFrame:
    """Count, area and area share of every class and abstention reason."""
    category = F.when(F.coalesce("abstain_reason", F.lit("")) == "", F.col("pred")).otherwise(F.concat(F.lit("abstain:"), F.col("abstain_reason")))
    per = df.groupBy(category.alias("category")).agg(F.count("*").alias("n"), F.sum("area_ha").alias("ha"))
    return per.select("category", "n", r6("ha").alias("ha"), r6(F.col("ha") / F.sum("ha").over(Window.partitionBy())).alias("share"))


def null_safe_mean(value: Column, weight: Column) -> Column:
    """Weighted mean over the rows that have a value."""
    return F.sum(value * weight) / F.sum(F.when(value.isNotNull(), weight))


def weighted_vector(df: DataFrame, keys: list[str], classes: tuple[str, ...], weight: str) -> DataFrame:
    """Area-weighted class probabilities and the class of the largest, the first in order of ties."""
    out = df.groupBy(*keys).agg(*((F.sum(F.col(weight) * F.col(f"p_{c.lower()}")) / F.sum(weight)).alias(f"p_{c.lower()}") for c in classes))
    best = F.greatest(*(F.round(f"p_{c.lower()}", 9) for c in classes))
    cls = F.coalesce(*(F.when(F.round(f"p_{c.lower()}", 9) == best, F.lit(c)) for c in classes))
    return out.withColumn("cls", cls)


def winner(df: DataFrame, keys: list[str], cls: str, value: str) -> DataFrame:
    """The class of the largest value per key, the first by name of ties."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), cls)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def modal(df: DataFrame, key: str, cls: str) -> DataFrame:
    """Per key the most frequent class (the first by name of ties), its canola years and all years."""
    per = df.groupBy(key, cls).agg(F.count("*").alias("_n"))
    best = winner(per, [key], cls, "_n").select(key, F.col(cls).alias("modal"))
    sums = per.groupBy(key).agg(F.sum(F.when(F.col(cls) == "Canola", F.col("_n")).otherwise(0)).alias("canola_years"), F.sum("_n").alias("n_years"))
    return best.join(sums, key)


def joint_histogram(df: DataFrame, bins: list[str], weight: str) -> DataFrame:
    """Area by bin combination: computed once, all thresholds read from it."""
    return df.groupBy(*bins).agg(F.sum(weight).alias(weight))


def area_matched(hist: DataFrame, key: str, bin_col: str, scale: float) -> DataFrame:
    """The smallest threshold whose area from there upwards does not exceed the expected area."""
    down = Window.partitionBy(key).orderBy(F.col(bin_col).desc()).rowsBetween(Window.unboundedPreceding, 0)
    seen = hist.withColumns({"_cum": F.sum("area").over(down), "_want": F.sum(F.col(bin_col) / scale * F.col("area")).over(Window.partitionBy(key))})
    return seen.groupBy(key).agg(F.min(F.when(F.col("_cum") <= F.col("_want"), F.col(bin_col))).alias("threshold"))


def weighted_moments(df: DataFrame, keys: list[str], p: str, f: str, weight: str) -> DataFrame:
    """Weighted means, covariance and correlation per key."""
    mean = lambda c: F.sum(F.col(weight) * c) / F.sum(weight)
    a, b = F.col(p), F.col(f)
    one = df.groupBy(*keys).agg(mean(a).alias("mp"), mean(b).alias("mf"), mean(a * a).alias("pp"), mean(b * b).alias("ff"), mean(a * b).alias("pf"))
    cov = F.col("pf") - F.col("mp") * F.col("mf")
    sd = F.sqrt((F.col("pp") - F.col("mp") * F.col("mp")) * (F.col("ff") - F.col("mf") * F.col("mf")))
    return one.select(*keys, r6("mp").alias("mean_p"), r6("mf").alias("mean_f"), r6(cov).alias("cov"), r6(cov / sd).alias("corr"))


def cross_areas(df: DataFrame, keys: list[str], first: Column, second: Column, weight: str) -> DataFrame:
    """Areas a (both), b (only first), c (only second), d (none) per key."""
    v = lambda c: F.sum(F.when(c, F.col(weight)).otherwise(0.0))
    return df.groupBy(*keys).agg(v(first & second).alias("a"), v(first & ~second).alias("b"), v(~first & second).alias("c"), v(~first & ~second).alias("d"))


def enrichment(df: DataFrame, group: str, value: str, baseline: str) -> DataFrame:
    """Median per group and its ratio to a baseline group's."""
    med = df.groupBy(group).agg(F.median(value).alias("med"))
    base = med.where(F.col(group) == baseline).select(F.col("med").alias("_b"))
    return med.join(F.broadcast(base)).select(group, F.round("med", 4).alias("med"), r6(F.col("med") / F.col("_b")).alias("enrichment"))


def column_argmax(df: DataFrame, cols: list[str]) -> DataFrame:
    """The name of the largest column, the first of ties, and its value; NULLs are skipped."""
    most = F.greatest(*cols)
    return df.withColumn("most", most).withColumn("top", F.coalesce(*(F.when(F.col(c) == F.col("most"), F.lit(c)) for c in cols)))


def filter_sweep(df: DataFrame, quantiles: list[float], draws: int) -> DataFrame:
    """Class areas above quantiles of the score, against the mean of as many random removals.

    The random control keeps a row by a mix of its keys and the draw, in integer arithmetic.
    """
    qs = F.array(*(F.lit(float(q)) for q in quantiles))
    cuts = df.agg(F.percentile("ha", qs).alias("_c")).select(F.explode(F.arrays_zip(qs.alias("q"), F.col("_c").alias("cut"))).alias("s")).select("s.q", "s.cut")
    kept = df.join(F.broadcast(cuts), F.col("ha") >= F.col("cut")).groupBy("q", "cls").agg(F.sum("ha").alias("ha"))
    mixed = (F.col("region") * 7919 + F.col("yr") * 104729 + F.ascii("cls") * 31 + F.col("rep").cast("long") * 1299709) % 1000003 / 1000003.0
    rows = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("q", F.explode(qs))
    control = rows.where(mixed >= F.col("q")).groupBy("q", "cls").agg((F.sum("ha") / draws).alias("random_ha"))
    return kept.join(control, ["q", "cls"], "left").select("q", "cls", F.round("ha", 4).alias("ha"), F.round("random_ha", 4).alias("random_ha"))


def stretched(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """A column between its percentiles mapped to 0..1, what lies outside clipped."""
    p = df.agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("_p"))
    scaled = (F.col(value) - F.col("_p")[0]) / (F.col("_p")[1] - F.col("_p")[0])
    return df.join(F.broadcast(p)).withColumn("stretched", F.greatest(F.least(scaled, F.lit(1.0)), F.lit(0.0))).drop("_p")
