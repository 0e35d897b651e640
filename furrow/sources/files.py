"""Scans and sinks over files: CSV, parquet, logs, summaries, shards and rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csvs(spark: SparkSession, paths: str | list[str], schema: StructType | str, columns: list[str] | None = None, sep: str = ",", header: bool = True) -> DataFrame:
    """CSV files of one schema as one table; a column list reads no more than those columns."""
    df = spark.read.csv(paths, schema=schema, header=header, sep=sep, nullValue="")
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """A CSV folder with headers; appending adds files, each complete or absent."""
    df.write.mode("append" if append else "overwrite").csv(path, header=True)


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, lenient: bool = False) -> DataFrame:
    """Parquet by its extension, CSV otherwise; ``lenient`` skips files that can't be read, for which a schema must be given."""
    if path.rstrip("/").endswith(".parquet"):
        reader = spark.read.option("ignoreCorruptFiles", str(lenient).lower())
        return (reader if schema is None else reader.schema(schema)).parquet(path)
    return spark.read.csv(path, schema=schema, header=True, inferSchema=schema is None)


def within_bbox(df: DataFrame, west: float, south: float, east: float, north: float, bbox: str = "bbox") -> DataFrame:
    """Rows whose bbox struct meets a box: plain comparisons on its leaves, which parquet prunes row groups by."""
    b = lambda c: F.col(f"{bbox}.{c}")
    return df.where((b("xmin") <= east) & (b("xmax") >= west) & (b("ymin") <= north) & (b("ymax") >= south))


def file_index(df: DataFrame, bbox: str = "bbox") -> DataFrame:
    """One row per file: its extent and rows."""
    b = lambda c: F.col(f"{bbox}.{c}")
    return df.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(b("xmin")).alias("w"), F.min(b("ymin")).alias("s"), F.max(b("xmax")).alias("e"), F.max(b("ymax")).alias("n"), F.count("*").alias("rows"))


def rewritten(base: DataFrame, key: str, deletes: DataFrame | None = None, updates: DataFrame | None = None, inserts: DataFrame | None = None) -> DataFrame:
    """A table with deletes, updates and inserts applied: what is left of the base, then the new rows."""
    out = base
    if deletes is not None:
        out = out.join(deletes.select(key), key, "left_anti")
    if updates is not None:
        known = updates.join(out.select(key), key, "left_semi")
        out = out.join(updates.select(key), key, "left_anti").unionByName(known, allowMissingColumns=True)
    return out if inserts is None else out.unionByName(inserts, allowMissingColumns=True)


def stacked(layers: list[DataFrame]) -> DataFrame:
    """Layers appended by column name; columns that one lacks are NULL there."""
    out = layers[0]
    for df in layers[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def derived(df: DataFrame, condition: Column, renames: dict[str, str]) -> DataFrame:
    """A filtered product with renamed columns."""
    return df.where(condition).withColumnsRenamed(renames)


def densified(df: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    """Every key at every time that occurs anywhere, NULL where nothing was seen: the union time axis.

    The axis is one row with an array of the distinct times, of which a season has some hundred.
    """
    axis = df.agg(F.array_sort(F.collect_set(time)).alias("_axis"))
    grid = df.select(key).distinct().join(F.broadcast(axis)).select(key, F.explode("_axis").alias(time))
    return grid.join(df.select(key, time, *values), [key, time], "left")


def summary_json(df: DataFrame, name: str = "summary") -> DataFrame:
    """A one-row table as a JSON document."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def sharded(df: DataFrame, path: str, shard: Column, renames: dict[str, str]) -> None:
    """A folder per shard, with the short column names that the target format allows."""
    df.withColumnsRenamed(renames).withColumn("shard", shard).repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def epilogue(lines: DataFrame) -> DataFrame:
    """Exit status, service units and wall time per log file from its text lines (file, value)."""
    grab = lambda p: F.max(F.nullif(F.regexp_extract("value", p, 1), F.lit("")))
    return lines.groupBy("file").agg(grab(r"Exit Status:\s+(-?\d+)").cast("int").alias("exit_status"), grab(r"Service Units:\s+([\d.]+)").cast("double").alias("service_units"), grab(r"Walltime Used:\s+(\d+:\d+:\d+)").alias("walltime"))
