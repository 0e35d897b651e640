"""Time series to features: bins, summaries, gaps, seasons and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from furrow.functions.scalars import left_closed_bin

#: Day-of-year bins: lower edges of 13 left-closed bins of 20 days.
BIN_START, BIN_STOP, BIN_STEP = 90, 350, 20
BINS = list(range(BIN_START, BIN_STOP, BIN_STEP))


def clear_season(df: DataFrame, key: str = "trial_id") -> DataFrame:
    """Clear pixels over all pixels of a season."""
    return df.groupBy(key).agg((F.sum("n_clear") / F.sum("n_px").cast("double")).alias("clear_frac"))


def binned(df: DataFrame, values: dict[str, Column], key: str = "trial_id") -> DataFrame:
    """Long medians: key, bin and one median per value."""
    rows = df.withColumn("bin", left_closed_bin(F.col("doy"), BIN_START, BIN_STOP, BIN_STEP)).where(F.col("bin").isNotNull())
    return rows.groupBy(key, "bin").agg(*(F.median(c).alias(n) for n, c in values.items()))


def widen(bins: DataFrame, values: list[str], key: str = "trial_id") -> DataFrame:
    """One row per key with a column {value}_{bin} for every bin, the list of bins being fixed."""
    return bins.groupBy(key).agg(*(F.max(F.when(F.col("bin") == b, F.col(v))).alias(f"{v}_{b}") for v in values for b in BINS))


def bin_summaries(bins: DataFrame, values: list[str], key: str = "trial_id") -> DataFrame:
    """Per key: p10, p90, amp over the bins' medians, and the bin of the largest, the first of ties."""
    aggs = []
    for v in values:
        p = F.percentile(v, F.array(F.lit(0.1), F.lit(0.9)))
        peak = F.max_by("bin", F.when(F.col(v).isNotNull(), F.struct(F.col(v), -F.col("bin"))))
        aggs += [p[0].alias(f"{v}__p10"), p[1].alias(f"{v}__p90"), (p[1] - p[0]).alias(f"{v}__amp"), peak.alias(f"{v}__peak_doy")]
    return bins.groupBy(key).agg(*aggs)


def feature_table(df: DataFrame, values: dict[str, Column], key: str = "trial_id") -> DataFrame:
    """The wide feature table: bin medians and their summaries, from one shuffle on the key."""
    bins = binned(df, values, key)
    names = list(values)
    wide = [F.max(F.when(F.col("bin") == b, F.col(v))).alias(f"{v}_{b}") for v in names for b in BINS]
    aggs = []
    for v in names:
        p = F.percentile(v, F.array(F.lit(0.1), F.lit(0.9)))
        peak = F.max_by("bin", F.when(F.col(v).isNotNull(), F.struct(F.col(v), -F.col("bin"))))
        aggs += [p[0].alias(f"{v}__p10"), p[1].alias(f"{v}__p90"), (p[1] - p[0]).alias(f"{v}__amp"), peak.alias(f"{v}__peak_doy")]
    return bins.groupBy(key).agg(*wide, *aggs)


def spread(value: Column, low: float, high: float, least: int = 0) -> Column:
    """A percentile range, NULL with fewer than ``least`` values: raw dates use 0.1 and 0.9, checks 0.05 and 0.95."""
    p = F.percentile(value, F.array(F.lit(low), F.lit(high)))
    return F.when(F.count(value) >= least, p[1] - p[0])


def largest_gap(df: DataFrame, start: str, end: str, key: str = "trial_id", day: str = "d") -> DataFrame:
    """Per key the longest stretch without a date from a window's start to its end, edges included."""
    inside = df.where(F.col(day).between(F.col(start), F.col(end)))
    edges = df.select(key, F.col(start).alias(day)).unionAll(df.select(key, F.col(end).alias(day))).distinct()
    days = inside.select(key, day).unionAll(edges)
    w = Window.partitionBy(key).orderBy(day)
    return days.withColumn("_gap", F.datediff(day, F.lag(day).over(w))).groupBy(key).agg(F.max("_gap").alias("max_gap_d"))


def season(df: DataFrame, value: Column, key: str = "trial_id", flower: tuple[int, int] = (200, 300), base: tuple[int, int] = (100, 180)) -> DataFrame:
    """Flowering maximum, its day (the first of ties), the baseline's median and their difference."""
    rows = df.withColumn("_v", value)
    inside = F.col("doy").between(*flower) & F.col("_v").isNotNull()
    before = F.col("doy").between(*base)
    return rows.groupBy(key).agg(
        F.max(F.when(inside, F.col("_v"))).alias("peak"),
        F.max_by("doy", F.when(inside, F.struct(F.col("_v"), -F.col("doy")))).alias("peak_doy"),
        F.median(F.when(before, F.col("_v"))).alias("baseline"),
        F.count_if(inside).alias("n_flower"),
    ).withColumn("amplitude", F.col("peak") - F.col("baseline"))


def window_after_sowing(df: DataFrame, value: Column, first: int = 120, last: int = 190, key: str = "trial_id") -> DataFrame:
    """The largest value in a window of days after sowing; NULL where nothing was seen."""
    das = F.datediff("d", "sow")
    return df.groupBy(key).agg(F.max(F.when(das.between(first, last), value)).alias("peak_das"), F.count_if(das.between(first, last) & value.isNotNull()).alias("n_das"))


def anchored(df: DataFrame, trials: DataFrame, before: int = 30, after: int = 30, key: str = "trial_id") -> DataFrame:
    """Observations from so many days before sowing to so many after harvest: an equi join with a range."""
    t = trials.select(key, "sow", "harv")
    inside = F.col("d").between(F.date_sub("sow", before), F.date_add("harv", after))
    return df.join(t, key).where(inside)


def phenology(df: DataFrame, value: Column, key: str = "trial_id") -> DataFrame:
    """Peak, and the fractions of it by which the season rises before and falls after it.

    The medians are over [peak - 120, peak - 30] and [peak + 45, peak + 150] days; the peak's day is
    the first of ties. One window per key, then one aggregation on the same partitioning.
    """
    w = Window.partitionBy(key)
    rows = df.withColumn("_v", value).where(F.col("_v").isNotNull())
    at = rows.withColumn("_peak", F.max(F.struct(F.col("_v"), -F.col("doy"))).over(w))
    lag = F.col("doy") + F.col("_peak")["col2"]
    peak = F.max(F.col("_peak")["_v"])
    return at.groupBy(key).agg(
        peak.alias("peak"), F.max(-F.col("_peak")["col2"]).alias("peak_doy"),
        ((peak - F.median(F.when(lag.between(-120, -30), F.col("_v")))) / peak).alias("greenup_rise"),
        ((peak - F.median(F.when(lag.between(45, 150), F.col("_v")))) / peak).alias("senescence_drop"),
    )


def phenology_on_dates(df: DataFrame, value: Column, key: str = "trial_id") -> DataFrame:
    """The same fractions about the known season: before sowing + 30 days and after harvest - 10."""
    v = value
    inside = F.col("d").between(F.col("sow"), F.col("harv"))
    peak = F.max(F.when(inside, v))
    return df.groupBy(key).agg(
        peak.alias("peak"),
        F.try_divide(peak - F.median(F.when(F.col("d") <= F.date_add("sow", 30), v)), peak).alias("greenup_rise"),
        F.try_divide(peak - F.median(F.when(F.col("d") >= F.date_sub("harv", 10), v)), peak).alias("senescence_drop"),
    )


def fit_gate(df: DataFrame, first: str, second: str, recall: float = 0.95) -> DataFrame:
    """Presence-only thresholds: the largest percentile p in 1, 1.5, ... 39.5 whose joint gate keeps the recall.

    One pass gives all percentiles, a second counts for every p at once.
    """
    grid = [1 + 0.5 * i for i in range(78)]
    ps = F.array(*(F.lit(p / 100) for p in grid))
    cuts = df.agg(F.percentile(first, ps).alias("_a"), F.percentile(second, ps).alias("_b"))
    steps = cuts.select(F.posexplode(F.arrays_zip("_a", "_b")).alias("i", "c")).select(
        F.col("i"), F.element_at(F.array(*(F.lit(p) for p in grid)), F.col("i") + 1).alias("p"), F.col("c._a").alias("cut_a"), F.col("c._b").alias("cut_b")
    )
    passed = (F.col(first) >= F.col("cut_a")) & (F.col(second) >= F.col("cut_b"))
    scored = df.select(first, second).join(F.broadcast(steps)).groupBy("p", "cut_a", "cut_b").agg(F.avg(F.coalesce(passed, F.lit(False)).cast("double")).alias("recall"))
    return scored.where(F.col("recall") >= recall).orderBy(F.col("p").desc()).limit(1)


def monthly(df: DataFrame, values: dict[str, Column], key: str = "trial_id") -> DataFrame:
    """Twelve months per key with each value's mean, gaps filled on straight lines, ends held flat."""
    seen = df.groupBy(key, (F.month("d") - 1).alias("month")).agg(*(F.avg(c).alias(n) for n, c in values.items()))
    grid = df.select(key).distinct().withColumn("month", F.explode(F.sequence(F.lit(0), F.lit(11))))
    rows = grid.join(seen, [key, "month"], "left")
    return interpolated(rows, list(values), key, "month")


def interpolated(rows: DataFrame, values: list[str], key: str, at: str) -> DataFrame:
    """Gaps of ordered rows filled linearly between the neighbours that have a value, flat at the ends."""
    w = Window.partitionBy(key).orderBy(at)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    out = rows
    for v in values:
        here = F.when(F.col(v).isNotNull(), F.struct(F.col(at).alias("x"), F.col(v).alias("y")))
        left, right = F.last(here, True).over(back), F.first(here, True).over(ahead)
        out = out.withColumn("_l", left).withColumn("_r", right).withColumn(
            v,
            F.when(F.col("_l").isNull(), F.col("_r.y")).when(F.col("_r").isNull(), F.col("_l.y")).when(F.col("_l.x") == F.col("_r.x"), F.col("_l.y")).otherwise(
                F.col("_l.y") + (F.col("_r.y") - F.col("_l.y")) * (F.col(at) - F.col("_l.x")) / (F.col("_r.x") - F.col("_l.x"))
            ),
        ).drop("_l", "_r")
    return out


def fourier_mean(df: DataFrame, value: Column, key: list[str], harmonics: int = 1) -> DataFrame:
    """Mean and the cosine and sine sums of a yearly harmonic, after filling gaps with the key's mean."""
    w = Window.partitionBy(*key)
    filled = df.withColumn("_v", value).withColumn("_v", F.coalesce("_v", F.avg("_v").over(w)))
    turn = 2 * 3.141592653589793 * harmonics * F.col("doy") / 365.0
    return filled.groupBy(*key).agg(F.avg("_v").alias("f0"), F.avg(F.col("_v") * F.cos(turn)).alias("f_cos"), F.avg(F.col("_v") * F.sin(turn)).alias("f_sin"))


def placement_scan(df: DataFrame, value: Column, positive: Column, starts: list[int], widths: list[int], key: str = "trial_id") -> DataFrame:
    """For every window start and width: the largest value per key within it, with its label.

    The windows are a literal list, so rows are repeated only for the windows that hold them.
    """
    das = F.datediff("d", "sow")
    windows = [(s, w) for s in starts for w in widths]
    held = F.filter(
        F.array(*(F.struct(F.lit(s).alias("start"), F.lit(w).alias("width")) for s, w in windows)), lambda x: (das >= x["start"]) & (das < x["start"] + x["width"])
    )
    rows = df.withColumn("_v", value).withColumn("_y", positive).where(F.col("_v").isNotNull()).withColumn("_w", F.explode(held))
    return rows.groupBy(key, "_w.start", "_w.width").agg(F.max("_v").alias("peak"), F.first("_y").alias("positive"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
