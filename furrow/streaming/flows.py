"""Structured Streaming: resume, micro-batches, windows, sessions, state and idempotent upserts (ST1-ST8)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from furrow.session import scratch


def replay(df: DataFrame, order: str, files: int) -> str:
    """A table written as files that follow one another in an order, for a file stream to read.

    A file stream takes files by their age, so each is written after the one before it.
    """
    path = scratch(df.sparkSession, "replay")
    at = F.col(order).cast("double")
    cuts = df.agg(F.percentile(at, F.array(*(F.lit(i / files) for i in range(1, files))))).first()[0] or []
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:], strict=False):
        part = df.where(F.lit(True) if low is None else at >= low).where(F.lit(True) if high is None else at < high)
        part.coalesce(1).sortWithinPartitions(order).write.mode("append").parquet(path)
    return path


def close(df: DataFrame, path: str, ts: str, after: str) -> None:
    """End a replay: two files with a row each that holds nothing but a time so far after the last, so that watermarks pass."""
    last = df.agg(F.max(ts).alias("at"))
    for k in (1, 2):
        at = F.col("at") + k * F.expr(f"interval {after}")
        last.select(*(at.alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields)).write.mode("append").parquet(path)


def files_stream(spark: SparkSession, path: str, schema: StructType, per_batch: int = 1, oldest_first: bool = True) -> DataFrame:
    """A file stream, so many files per micro-batch; only files that were committed are listed."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("latestFirst", str(not oldest_first).lower()).parquet(path)


_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def run(df: DataFrame, mode: str, each: Callable[[DataFrame, int], None], checkpoint: str | None = None, timers: bool = False) -> None:
    """Drain what is there in micro-batches, each handed to an idempotent sink.

    With the ``checkpoint`` of an earlier run it goes on where that ended; without one it begins anew.
    A stream with ``timers`` by the clock would ask for empty batches for ever: it gets none, and what
    is due fires with the next batch that has rows.
    """
    spark = df.sparkSession
    place = checkpoint or scratch(spark, "checkpoint")
    before = spark.conf.get(_EMPTY_BATCHES)
    spark.conf.set(_EMPTY_BATCHES, "false" if timers else before)
    try:
        df.writeStream.outputMode(mode).option("checkpointLocation", place).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
    finally:
        spark.conf.set(_EMPTY_BATCHES, before)


def ready(path: str, spark: SparkSession, now: float, least_age: float = 2.0, glob: str = "*.parquet") -> DataFrame:
    """path, length and modified of the files below a path that are older than ``least_age`` seconds: no writer is at them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified")).where(F.unix_millis("modificationTime") < F.lit(int((now - least_age) * 1000)))


def by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes a batch to a folder of its own and overwrites it when the batch is run again."""
    return lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")


def tumbling(events: DataFrame, ts: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Counts, sums and means per calendar window and key, late rows up to a watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, late: str, key: str) -> DataFrame:
    """Sessions per key: a gap ends one."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def resume(path: str, key: str, ok: str) -> Callable[[DataFrame, int], None]:
    """A sink that logs work done: keys already done are left out, failed ones may come again.

    What a batch finds done is the log of the batches before it. Its own folder, which an earlier try
    may have left, doesn't count, so a batch that runs again writes what it wrote the first time.
    """

    def each(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        fresh = df.where(ok).select(key).distinct()
        if n:
            logged = StructType([*fresh.schema.fields, StructField("batch", LongType())])
            fresh = fresh.join(spark.read.schema(logged).parquet(path).where(F.col("batch") < n), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return each


def upsert_days(path: str, source: DataFrame, day: str) -> Callable[[DataFrame, int], None]:
    """A sink that recomputes the days a batch touches from the source and overwrites just them."""

    def each(df: DataFrame, n: int) -> None:
        del n
        days = df.select(F.to_date(day).alias("day")).distinct()
        whole = source.withColumn("day", F.to_date(day)).join(F.broadcast(days), "day", "left_semi")
        whole.groupBy("day").agg(F.count("*").alias("n"), F.sum("value").alias("total")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)

    return each


def watchdog(events: DataFrame, key: str, ts: str, order: str, bad: str, idle_s: float, limit: int, silence: str | None = None) -> DataFrame:
    """Per key and batch: the longest run of failures so far, whether the breaker tripped, and whether the key ever stalled.

    The state is the current run, the longest, the last time and the longest gap; rows of a batch are
    taken in time order, and batches follow one another in time. With ``silence``, a duration, a key
    from which no row comes for so long by the clock is reported as stalled when its timer fires.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, longest, last, gap = state.get if state.exists else (0, 0, -1.0, 0.0)
        if state.hasTimedOut:
            state.update((int(current), int(longest), float(last), float("inf")))
            yield pd.DataFrame({key: [k[0]], "longest": [int(longest)], "tripped": [bool(longest >= limit)], "stalled": [True]})
            return
        rows = pd.concat(list(batches)).sort_values([ts, order], kind="stable")
        for when, failed in zip(rows[ts], rows[bad], strict=True):
            now = when.timestamp()
            if last >= 0:
                gap = max(gap, now - last)
            last = max(last, now)
            current = current + 1 if failed else 0
            longest = max(longest, current)
        state.update((int(current), int(longest), float(last), float(gap)))
        if silence is not None:
            state.setTimeoutDuration(silence_ms)
        yield pd.DataFrame({key: [k[0]], "longest": [int(longest)], "tripped": [bool(longest >= limit)], "stalled": [bool(gap > idle_s)]})

    silence_ms = None if silence is None else int(pd.Timedelta(silence).total_seconds() * 1000)
    timer = GroupStateTimeout.NoTimeout if silence is None else GroupStateTimeout.ProcessingTimeTimeout

    return events.groupBy(key).applyInPandasWithState(
        step, f"{key} long, longest long, tripped boolean, stalled boolean", "current long, longest long, last double, gap double", "append", timer
    )
