"""Bounded samples of labelled rows, by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WIDE = 1 << 30


def share_of(count: int, most: int) -> float:
    """The share of ``count`` rows that a sample of about ``most`` takes."""
    return min(1.0, most / max(1, count))


def in_share(id_col: Column | str, share: float, salt: str) -> Column:
    """Whether a row's id falls into a share of all ids; null ids never do."""
    place = F.pmod(F.xxhash64(id_col, F.lit(salt)), F.lit(_WIDE))
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return col.isNotNull() & (place < F.lit(int(share * _WIDE)))


def labelled(labels: DataFrame, id_col: str, names: list[str]) -> DataFrame:
    """One row per labelled id; ids or labels that are null are no labels, nor are an id's rows that contradict each other."""
    known = labels.where(F.col(id_col).isNotNull())
    for name in names:
        known = known.where(F.col(name).isNotNull())
    per_id = known.groupBy(F.col(id_col).alias("_id")).agg(*(F.max(n).cast("int").alias(n) for n in names), *(F.min(n).cast("int").alias(f"_least_{n}") for n in names))
    for name in names:
        per_id = per_id.where(F.col(name) == F.col(f"_least_{name}"))
    return per_id.select("_id", *names)
