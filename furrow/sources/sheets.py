"""Semi-structured sheets: find the header, carry section labels down, scale units."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SEASON = re.compile(r"^\d{4}\s*[-–]\s*\d{2,4}")


def fill_down(df: DataFrame, col: str, keys: list[str], order: list[str]) -> DataFrame:
    """NULLs replaced by the last value above them, in order within the keys."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(col, F.last(col, True).over(w))


def header_row(rows: Sequence[Sequence[object]], least: int = 5) -> int:
    """The first row with so many cells that name a season."""
    for i, row in enumerate(rows):
        if sum(bool(_SEASON.match(str(c))) for c in row if c is not None) >= least:
            return i
    raise ValueError("no row names enough seasons")


def parse_sheet(spark: SparkSession, rows: Sequence[Sequence[object]], label: int = 0, unit: int = 1) -> DataFrame:
    """(section, item, unit, season, value) of a sheet whose sections head their items' rows.

    A row without values begins a section, which the rows below it carry; '000 units are scaled.
    """
    top = header_row(rows)
    seasons = {i: str(c) for i, c in enumerate(rows[top]) if c is not None and _SEASON.match(str(c))}
    cells = []
    for n, row in enumerate(rows[top + 1 :]):
        values = {s: row[i] for i, s in seasons.items() if i < len(row) and isinstance(row[i], int | float)}
        name = None if row[label] is None else str(row[label]).strip()
        kind = str(row[unit]).strip() if len(row) > unit and row[unit] is not None else None
        cells += [(n, None if values else name, name, kind, s, float(v)) for s, v in values.items()] or [(n, name, None, None, None, None)]
    df = spark.createDataFrame(cells, "n int, section string, item string, unit string, season string, value double").withColumn("sheet", F.lit(0))
    scale = F.when(F.col("unit").startswith("'000"), 1000.0).otherwise(1.0)
    filled = fill_down(df, "section", ["sheet"], ["n", "season"])
    return filled.where(F.col("season").isNotNull()).select("section", "item", "unit", "season", (F.col("value") * scale).alias("value"))
