"""Projections, filters and predicates."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def clear_fraction(df: DataFrame, least: float = 0.5, clear: str = "n_clear", total: str = "n_px") -> DataFrame:
    """Rows of which at least a share of the pixels is clear."""
    return df.where(F.col(clear) / F.greatest(F.col(total), F.lit(1)).cast("double") >= least)


def min_observations(df: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """Rows of groups with at least so many rows: a partial count, then a semi join."""
    enough = df.groupBy(*keys).count().where(F.col("count") >= least).select(*keys)
    return df.join(enough, keys, "left_semi")


def keep_list(df: DataFrame, keep: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(keep, on, "left_semi")


def dedup_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key, the first in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def within_box(df: DataFrame, lon: str, lat: str, west: float = 112, south: float = -44, east: float = 154, north: float = -10) -> DataFrame:
    """Rows whose point lies in a box of degrees."""
    return df.where(F.col(lon).between(west, east) & F.col(lat).between(south, north))


def reflectance(dn: Column, fmask: Column, tree: Column | None = None, nodata: int = -999) -> Column:
    """A digital number as reflectance where the scene is clear, has data and no tree; else NULL."""
    good = (fmask == 1) & (dn != nodata)
    return F.when(good if tree is None else good & ~tree, dn / 1e4)


def positive_only(df: DataFrame, *cols: str) -> DataFrame:
    """Rows whose values may go into a logarithm."""
    out = df
    for c in cols:
        out = out.where(~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf")))
    return out


def size_and_shape(df: DataFrame, area: str = "area_ha", compactness: str = "compactness", least: float = 1, most: float = 1500, shape: float = 8) -> DataFrame:
    """Polygons within an area range and not too ragged."""
    return df.where(F.col(area).between(least, most) & (F.col(compactness) <= shape))


def first_reason(rules: list[tuple[Column, str]], otherwise: str = "") -> Column:
    """The name of the first rule that holds; rules that are NULL don't."""
    out = None
    for cond, name in rules:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(otherwise)


def abstain_reason(area: Column, compactness: Column, n_obs: Column, amplitude: Column, shape_ok: Column, min_area: float = 5, max_area: float = 300, min_obs: int = 10, min_amp: float = 0.35) -> Column:
    """Why a polygon gets no class, the first reason that applies, '' if it gets one."""
    return first_reason([
        (area < min_area, "area_below_min"),
        ((area > max_area) | (compactness > 8), "unsegmented_blob"),
        (F.coalesce(n_obs, F.lit(0)) < min_obs, "too_few_observations"),
        (F.coalesce(amplitude, F.lit(0.0)) < min_amp, "no_crop_signal"),
        (~F.coalesce(shape_ok, F.lit(False)), "no_crop_shape"),
    ])


def exempt_gate(pred: Column, passed: Column, exempt: Iterable[str]) -> tuple[Column, Column]:
    """A gate whose failure is recorded for all but takes the class only from classes that aren't exempt."""
    failed = ~F.coalesce(passed, F.lit(False))
    return failed, F.when(~failed | pred.isin(*exempt), pred)


def is_classified(reason: Column, extra: Iterable[str] = ()) -> Column:
    """Whether an abstention reason means a class was given: empty, missing, or one of the extra ones."""
    plain = F.coalesce(reason, F.lit("")) == ""
    extra = list(extra)
    return plain | F.coalesce(reason.isin(*extra), F.lit(False)) if extra else plain


def threshold_sweep(df: DataFrame, value: str, cuts: list[float], keys: list[str], aggs: Callable[[Column], list[Column]]) -> DataFrame:
    """The same rows at many cut-offs in one pass: a row counts for every cut-off it reaches.

    Rows are reduced to the cells between neighbouring cut-offs only by the aggregation itself, so
    the list of cut-offs, a literal, sets how often a row is repeated.
    """
    rows = df.withColumn("cut", F.explode(F.array(*(F.lit(float(c)) for c in cuts))))
    return rows.groupBy("cut", *keys).agg(*aggs(F.col(value) >= F.col("cut")))


def quantile_cut(df: DataFrame, value: str, q: float) -> DataFrame:
    """Rows at or above a quantile of the column."""
    cut = df.agg(F.percentile(value, F.lit(q)).alias("_cut"))
    return df.join(F.broadcast(cut), F.col(value) >= F.col("_cut")).drop("_cut")


def missing_share(wanted: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """One row: n_wanted, n_missing, share."""
    have = present.select(*on).distinct().withColumn("_have", F.lit(1))
    joined = wanted.select(*on).distinct().join(have, on, "left")
    return joined.agg(F.count("*").alias("n_wanted"), F.count_if(F.col("_have").isNull()).alias("n_missing")).withColumn(
        "share", F.try_divide(F.col("n_missing").cast("double"), F.col("n_wanted").cast("double"))
    )


def require_present(df: DataFrame, share: DataFrame, most: float) -> DataFrame:
    """``df``, or an error when the missing share of its input exceeds a limit."""
    guard = share.select(F.when(F.col("share") > most, F.raise_error(F.concat(F.lit("missing input: "), F.col("share").cast("string")))).alias("_error"))
    return df.join(F.broadcast(guard)).where(F.col("_error").isNull()).drop("_error")


def family(column: str) -> str:
    """The family of a feature column: what stands before its bin or statistic."""
    return column.split("@")[0].rsplit("_", 1)[0].rstrip("_")


def keep_families(df: DataFrame, keep: Iterable[str], always: Iterable[str] = ()) -> DataFrame:
    """Columns of the families to keep, and those that always stay."""
    keep, always = set(keep), set(always)
    return df.select(*(c for c in df.columns if c in always or family(c) in keep))


def drop_all_null(df: DataFrame) -> DataFrame:
    """Columns that hold any value; one aggregate pass tells."""
    some = df.agg(*(F.count(c).alias(c) for c in df.columns)).first()
    return df.select(*(c for c in df.columns if some[c]))


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the contract's columns in its order: missing ones NULL, others dropped."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


def with_suffix(df: DataFrame, suffix: str, keys: Iterable[str]) -> DataFrame:
    """Columns other than the keys renamed by their source."""
    keys = set(keys)
    return df.select(*(F.col(c) if c in keys else F.col(c).alias(f"{c}@{suffix}") for c in df.columns))


def verdict(amplitude: Column, peak_cfi: Column, is_canola: Column, min_amp: float = 0.2, min_cfi: float = 0.1309) -> Column:
    """REJECTED without a season, CONFIRMED when the flower index agrees with the label, else UNCERTAIN."""
    flowers = peak_cfi >= min_cfi
    return (
        F.when(amplitude.isNull() | peak_cfi.isNull(), "UNCERTAIN")
        .when(amplitude < min_amp, "REJECTED")
        .when(flowers == is_canola, "CONFIRMED")
        .when(is_canola, "REJECTED")
        .otherwise("UNCERTAIN")
    )


def risk(flags: dict[str, tuple[Column, int]]) -> tuple[Column, Column]:
    """Weighted score of flags, and their names joined in order."""
    score = sum((F.coalesce(c, F.lit(False)).cast("int") * w for c, w in flags.values()), F.lit(0))
    names = F.concat_ws(",", *(F.when(F.coalesce(c, F.lit(False)), n) for n, (c, _) in flags.items()))
    return score, names


def policy_fill(explicit: Column, flagged: Column) -> Column:
    """An explicit verdict, else bad for flagged and good for other rows."""
    return F.coalesce(explicit, F.when(flagged, "bad").otherwise("good"))


def value_map(col: Column, mapping: dict, strict: bool = False) -> Column:
    """A dictionary applied to a column; unmapped values are NULL, or an error if ``strict``."""
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    got = table[col]
    if not strict:
        return got
    return F.when(col.isNotNull() & got.isNull(), F.raise_error(F.concat(F.lit("unmapped value: "), col.cast("string")))).otherwise(got)


def observed(n: Column, max_gap: Column, least: int = 3, most: int = 45) -> Column:
    """Whether a window was observed well enough; unknown counts as not."""
    return (F.coalesce(n, F.lit(0)) >= least) & (F.coalesce(max_gap, F.lit(999)) <= most)


def review_status(v: Column) -> Column:
    """NULL is unreviewed, which is neither good nor bad."""
    return F.when(v.isNull(), "unreviewed").when(v == "good", "good").otherwise("bad")
