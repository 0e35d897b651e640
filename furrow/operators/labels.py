"""Labels and their review: conflicts, packages, propagation, experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from furrow.operators.sampling import mixed, row_index


def conflict_flags(df: DataFrame, paddock: list[str], crop: str, group: Column) -> DataFrame:
    """Rows with how many trials, crops and crop groups their paddock and year holds, and what conflicts."""
    w = Window.partitionBy(*paddock)
    out = df.withColumn("_g", group)
    n = lambda c: F.size(F.collect_set(c).over(w))
    return out.withColumns({"n_trials": F.count("*").over(w), "n_crops": n(crop), "n_groups": n("_g")}).withColumns(
        {"crop_conflict": F.col("n_crops") > 1, "group_conflict": F.col("n_groups") > 1}
    ).drop("_g")


def review_polygons(df: DataFrame, key: str) -> DataFrame:
    """One row per polygon with its trials, crops, groups and years rolled up, and the triage verdict."""
    names = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(F.col(c).cast("string"))))
    rolled = df.groupBy(key).agg(
        F.count("*").alias("n_trials"), names("trial").alias("trial_codes"), names("crop").alias("crops"), F.count_distinct("crop").alias("n_crops"), names("yr").alias("years"), F.max("bal").alias("paddock_ha"),
    )
    flags = F.concat_ws("; ", F.when(F.col("n_crops") > 6, "group_conflict"), F.when(F.col("paddock_ha") < 9000, "too_small"))
    return rolled.withColumn("flag_reason", flags).withColumn("triage_flag", F.col("flag_reason") != "")


def review_sample(polygons: DataFrame, key: str, batch: int) -> DataFrame:
    """All flagged polygons and a seeded sample of the others, in review order."""
    rank = F.row_number().over(Window.partitionBy("triage_flag").orderBy(mixed(F.col(key)), key))
    chosen = polygons.withColumn("_rn", rank).where(F.col("triage_flag") | (F.col("_rn") <= batch))
    placed = row_index(chosen.withColumn("_unflagged", ~F.col("triage_flag")), "_unflagged", "_rn", key)
    return placed.withColumn("review_order", F.col("row_index") + 1).drop("_rn", "_unflagged", "row_index")


def refreshed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A rebuilt package that keeps the verdicts already given; polygons that are gone drop out."""
    return new.join(old.select(key, "verdict"), key, "left")


def finalised(df: DataFrame) -> DataFrame:
    """Explicit verdicts, else good for unflagged and bad for flagged polygons."""
    return df.withColumn("verdict", F.coalesce("verdict", F.when(F.col("triage_flag"), "bad").otherwise("good")))


def ingested(polygons: DataFrame, key: str) -> DataFrame:
    """Verdicts carried from polygons to the trials that their code lists name."""
    return polygons.select(F.explode(F.split("trial_codes", ",")).alias("trial_code"), key, "verdict")


def training_arms(df: DataFrame, key: str, clean: Column, conflict: Column, train: Column) -> DataFrame:
    """Rows with the training arms they belong to, and the test rows that all arms share.

    The control arm is a sample of all training rows of the clean arm's size, so that quality is not
    mistaken for quantity.
    """
    flagged = df.withColumns({"_train": train, "_clean": clean, "_conflict": conflict})
    size = flagged.agg(F.count_if(F.col("_train") & F.col("_clean")).alias("_size"))
    rank = F.row_number().over(Window.partitionBy("_train").orderBy(mixed(F.col(key), 5), key))
    rows = flagged.withColumn("_rank", rank).join(F.broadcast(size))
    arms = F.array_compact(F.array(
        F.when(F.col("_train"), "all"), F.when(F.col("_train") & F.col("_clean"), "clean"), F.when(F.col("_train") & ~F.col("_conflict"), "no_conflict"),
        F.when(F.col("_train") & (F.col("_rank") <= F.col("_size")), "control"), F.when(~F.col("_train"), "test"),
    ))
    return rows.withColumn("arm", F.explode(arms)).drop("_train", "_clean", "_conflict", "_rank", "_size")
