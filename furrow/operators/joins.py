"""Equi joins with the checks that the pipeline wants."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unique_left_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A left join that may not change the row count: a repeated key on the right is an error.

    The check rides on the right side's own shuffle by the key and needs no count of its own.
    """
    n = F.count("*").over(Window.partitionBy(*on))
    checked = right.withColumn("_n", n).withColumn("_bad", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("key occurs twice on the right: "), F.to_json(F.struct(*on))))))
    return left.join(checked.where(F.col("_bad").isNull()).drop("_n", "_bad"), on, "left")


def pending(todo: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """What is still to do."""
    return todo.join(done, on, "left_anti")


def changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """new, changed or unchanged for every new row by the old value of its key."""
    before = old.select(key, F.col(value).alias("_old"), F.lit(True).alias("_known"))
    status = F.when(F.col("_known").isNull(), "new").when(F.col(value).eqNullSafe(F.col("_old")), "unchanged").otherwise("changed")
    return new.join(before, key, "left").withColumn("status", status).drop("_old", "_known")


def first_donor(rows: DataFrame, donors: DataFrame, on: list[str], rank: str) -> DataFrame:
    """Rows with the first donor, by rank, that has one for them; rows without a donor keep NULLs."""
    w = Window.partitionBy(*on).orderBy(rank)
    best = donors.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return rows.join(best, on, "left")


def claim_matching(candidates: DataFrame, group: list[str], order: list[str], item: str, target: str, label: str, schema: str) -> DataFrame:
    """Matching in a fixed order within independent groups: an item takes its first candidate that no other label holds.

    The result of one item depends on those before it, so a group is a loop; groups are areas and
    years, whose size is bounded by an area's trials.
    """

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        claimed: dict = {}
        taken: dict = {}
        for row in pdf.sort_values(order).itertuples(index=False):
            own, want, kind = getattr(row, item), getattr(row, target), getattr(row, label)
            if own not in taken and claimed.setdefault(want, kind) == kind:
                taken[own] = want
        first = pdf.sort_values(order).drop_duplicates(item)
        out = first[[*group, item, label]].copy()
        out[target] = [taken.get(x) for x in out[item]]
        return out[[*group, item, label, target]].astype({target: "Int64"})

    return candidates.groupBy(*group).applyInPandas(match, schema)


def overlap_agreement(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row: rows that both reviewers judged, and how many they judged alike."""
    other = b.select(key, F.col(value).alias("_qc"))
    both = a.join(other, key)
    same: Column = (F.col(value) == F.col("_qc")).cast("int")
    return both.agg(F.count("*").alias("n_both"), F.coalesce(F.sum(same), F.lit(0)).alias("n_same"))

