"""User functions: geometry accessors for SQL, an aggregate, and table functions (UD1-UD3, X42)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from furrow.sources.geopackage import decode_header, encode_box, envelope

ACCESSORS = ("st_minx", "st_miny", "st_maxx", "st_maxy")


def _accessor(i: int):
    @F.arrow_udf("double")
    def of(blobs: pa.Array) -> pa.Array:
        return pa.array([None if b is None else envelope(b)[i] for b in blobs.to_pylist()], pa.float64())

    return of


def register(spark: SparkSession) -> None:
    """Register st_minx, st_miny, st_maxx, st_maxy and st_srid for GeoPackage blobs in SQL."""
    for i, name in enumerate(ACCESSORS):
        spark.udf.register(name, _accessor(i))

    @F.arrow_udf("int")
    def srid(blobs: pa.Array) -> pa.Array:
        return pa.array([None if b is None else decode_header(b)[0] for b in blobs.to_pylist()], pa.int32())

    spark.udf.register("st_srid", srid)


def box_blob(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box as a GeoPackage blob."""

    @F.arrow_udf("binary")
    def of(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        return pa.array([encode_box(*row) for row in zip(a.to_pylist(), b.to_pylist(), c.to_pylist(), d.to_pylist(), strict=True)], pa.binary())

    return of(*(v.cast("double") for v in (x0, y0, x1, y1)))


def longest_run(flag: Column, order: Column) -> Column:
    """A grouped aggregate in pandas: the longest run of true flags in an order. For what no built-in expresses."""

    @F.pandas_udf("int")
    def of(flags: pd.Series, orders: pd.Series) -> int:
        best = run = 0
        for value in flags.iloc[orders.argsort(kind="stable")]:
            run = run + 1 if value else 0
            best = max(best, run)
        return best

    return of(flag, order)


def aois_table(spark: SparkSession) -> None:
    """Register the table function aois(lon, lat, n, step): the n by n grid of tile centres around a point."""

    @F.udtf(returnType="i int, j int, lon double, lat double")
    class Aois:
        def eval(self, lon: float, lat: float, n: int, step: float) -> Iterator[tuple]:
            for i in range(n):
                for j in range(n):
                    yield i, j, lon + (i - (n - 1) / 2) * step, lat + (j - (n - 1) / 2) * step

    spark.udtf.register("aois", Aois)
