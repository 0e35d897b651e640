"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

Training time runs from 0 to 1. Each source has a weight schedule, a piecewise linear function of
time; its integral is the source's weight in the whole mix. A source's documents, in a fixed
pseudo-random order, form a token line that is read once, or once and a part, or twice; the token at
offset u gets the time at which the source's cumulative demand reaches u, found by inverting the
integral of the schedule. Documents are range-sorted by the time of their first token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from furrow.llm.text import n_words
from furrow.session import cut

def ramp_schedules(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), swing: float = 0.5) -> DataFrame:
    """(source, knots): weights dealt to the sources by code point, null (as '') last, as ramps.

    Sources of odd rank fall from (1 + swing) to (1 - swing) times their weight, the others rise,
    so that every integral is the weight itself.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source") == "", "source"))  # '' stands for null
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank - 1) % len(weights) + 1)
    sign = F.when(rank % 2 == 1, 1.0).otherwise(-1.0)
    knot = lambda t, w: F.struct(F.lit(t).alias("t"), w.alias("w"))
    return sources.select("source").distinct().select(
        "source", F.array(knot(0.0, weight * (1 + sign * swing)), knot(1.0, weight * (1 - sign * swing))).alias("knots")
    )


def plan(sizes: DataFrame, schedules: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target, segments) from (source, source_size) and (source, knots).

    Targets are ``share`` of all sizes, by integrated weight; what exceeds ``cap`` times a source's
    size goes to the others by weight until none is above: sources fill in the order of cap over
    weight. ``segments`` hold the schedule with its cumulative demand as a part of the whole.
    """
    part = F.transform(
        F.sequence(F.lit(1), F.size("knots") - 1),
        lambda i: F.struct(
            F.element_at("knots", i)["t"].alias("t0"),
            (F.element_at("knots", i + 1)["t"] - F.element_at("knots", i)["t"]).alias("dt"),
            F.element_at("knots", i)["w"].alias("r0"),
            F.element_at("knots", i + 1)["w"].alias("r1"),
        ),
    )
    area = lambda s: (s["r0"] + s["r1"]) / 2 * s["dt"]
    total = lambda parts: F.aggregate(parts, F.lit(0.0), lambda acc, s: acc + area(s))
    known = (
        sizes.join(schedules.withColumnRenamed("source", "_source"), F.col("source") == F.col("_source"))
        .withColumn("_parts", part)
        .withColumn("_weight", total(F.col("_parts")))
        .withColumn("_cap", cap * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    )
    everything = Window.partitionBy()
    up_to = Window.orderBy("_ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    filled = (
        known.withColumn("_all", share * F.sum("source_size").over(everything))
        .withColumn("_below", F.sum("_cap").over(up_to))
        .withColumn("_left", F.sum("_weight").over(everything) - F.sum("_weight").over(up_to))
        .withColumn("_full", F.col("_below") + F.col("_ratio") * F.col("_left") <= F.col("_all"))
        .withColumn("_rest", F.col("_all") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(everything))
        .withColumn("_open", F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_weight"))).over(everything))
    )
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_rest") / F.col("_open") * F.col("_weight"))
    segments = F.transform(
        "_parts",
        lambda s, i: F.struct(
            s["t0"].alias("t0"),
            s["dt"].alias("dt"),
            (s["r0"] / F.col("_weight")).alias("r0"),
            (s["r1"] / F.col("_weight")).alias("r1"),
            (total(F.slice("_parts", 1, i)) / F.col("_weight")).alias("c0"),
        ),
    )
    return filled.select("source", "source_size", target.alias("target"), segments.alias("segments"))


def time_at(part: Column, segments: Column) -> Column:
    """The time at which ``part`` (0 to 1) of a source's demand is met: the inverse of the integral."""
    own = F.element_at(F.filter(segments, lambda s: s["c0"] <= part), -1)
    gone = part - own["c0"]
    slope = (own["r1"] - own["r0"]) / own["dt"]
    root = F.sqrt(F.greatest(own["r0"] * own["r0"] + 2 * gone * slope, F.lit(0.0)))
    return own["t0"] + F.coalesce(F.try_divide(2 * gone, own["r0"] + root), F.lit(0.0))


def _sized(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``df`` with the size, the order key, its bucket, a tie-breaker and the source of each row."""
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return df.withColumns({
        "_mix_size": n_words(F.col(text_col)),
        "_mix_key": F.substring(key, 1, 16),
        "_mix_bucket": F.conv(F.substring(key, 1, 3), 16, 10).cast("int"),
        "_mix_tie": F.xxhash64(text_col),
        # A text that is never null, so that one hash partitioning serves the window and the join.
        "_mix_of": F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")),
    })


def _placed(df: DataFrame, schedules: DataFrame | None, id_col: str, text_col: str, source_col: str, share: float, cap: float) -> DataFrame:
    """``df`` with _mix_ columns: its place on its source's token line and what the target takes of it."""
    sized = _sized(df, id_col, text_col, source_col) if "_mix_size" not in df.columns else df
    by_bucket = sized.groupBy(F.col("_mix_of").alias("source"), "_mix_bucket").agg(F.sum("_mix_size").alias("_sum"))
    sizes = by_bucket.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    if schedules is not None:
        schedules = schedules.withColumn("source", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    planned = plan(sizes, ramp_schedules(sizes) if schedules is None else schedules, share, cap)
    before = Window.partitionBy("source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.select(
        F.col("source").alias("_s_of"),
        F.col("_mix_bucket").alias("_s_bucket"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_mix_offset"),
    )
    # One row per source and bucket, at most 4096 for each source, with the source's own plan.
    planned = planned.select(*(F.col(c).alias(f"_mix_{c}") for c in planned.columns))
    starts = offsets.join(planned, F.col("_s_of") == F.col("_mix_source")).drop("_mix_source")
    line = (
        Window.partitionBy("_mix_of", "_mix_bucket")
        .orderBy("_mix_key", "_mix_size", "_mix_tie")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    first, passes = F.col("_mix_first"), F.col("_mix_passes")
    return (
        sized.withColumn("_mix_before", F.coalesce(F.sum("_mix_size").over(line), F.lit(0)))
        .join(starts, (F.col("_mix_of") == F.col("_s_of")) & (F.col("_mix_bucket") == F.col("_s_bucket")))
        .withColumn("_mix_first", F.col("_mix_offset") + F.col("_mix_before"))
        .withColumn("_mix_passes", F.when(F.col("_mix_source_size") > 0, F.floor(F.col("_mix_target") / F.col("_mix_source_size"))).otherwise(0))
        .withColumn("_mix_over", F.floor(F.col("_mix_target") - passes * F.col("_mix_source_size")))
        .withColumn("_mix_rest", F.greatest(F.least(F.col("_mix_over") - first, F.col("_mix_size")), F.lit(0)))
        .withColumn("_mix_taken", passes * F.col("_mix_size") + F.col("_mix_rest"))
        .withColumn("_mix_position", F.when(F.col("_mix_taken") > 0, time_at(first / F.col("_mix_target"), F.col("_mix_segments"))))
    )


def mix(
    df: DataFrame,
    schedules: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """Per row of ``df``: id, size, source_size, target, passes, rest, taken and position.

    ``passes`` whole readings of a source and its words up to the target make up what is taken:
    ``taken`` is passes * size plus ``rest``, what the last reading covers of the document, so a
    source's words add up to its target's whole part and no document exceeds ``cap`` times its size
    (``cap`` is a whole number here). ``position`` is the time of the first word, null if nothing is
    taken. The order within a source is by md5 of the id, then size, then a hash of the text: reruns
    agree. Null texts have size 0; null sources are a source of their own; null ids sort as '';
    repeated rows are taken one by one; an empty table gives no rows; other columns are left out.
    The rows come range-sorted by position, those that aren't taken first; ties go by id.
    """
    names = ("size", "source_size", "target", "passes", "rest", "taken", "position")
    sized = _sized(df.select(id_col, text_col, source_col), id_col, text_col, source_col)
    placed = _placed(cut(sized.drop(text_col, source_col)), schedules, id_col, text_col, source_col, share, cap)
    placed = placed.select(id_col, *(F.col(f"_mix_{c}").alias(c) for c in names))
    return placed.repartitionByRange("position", id_col).sortWithinPartitions("position", id_col)


def training_rows(
    df: DataFrame,
    schedules: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """The training order: one row per reading of a document, range-sorted by the reading's position.

    Columns are those of ``df``. A reading that the target cuts off holds the document's first words
    as far as they are taken, with the white space before each as it was. Documents without words,
    null texts among them, or of which nothing is taken, go. Null sources are a source of their own,
    null ids sort as '', repeated rows are read one by one, and an empty table gives no rows.
    """
    placed = _placed(df, schedules, id_col, text_col, source_col, share, cap)
    kind = "array<struct<k:bigint,words:bigint>>"
    whole = F.when(
        F.col("_mix_passes") > 0,
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("_mix_passes") - 1), lambda k: F.struct(k.alias("k"), F.col("_mix_size").alias("words"))),
    ).otherwise(F.array().cast(kind))
    rest = F.when(
        F.col("_mix_rest") > 0, F.array(F.struct(F.col("_mix_passes").alias("k"), F.col("_mix_rest").alias("words")))
    ).otherwise(F.array().cast(kind))
    start = F.col("_mix_reading.k") * F.col("_mix_source_size") + F.col("_mix_first")
    chunks = F.regexp_extract_all(text_col, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    read = F.when(
        F.col("_mix_reading.words") < F.col("_mix_size"),
        F.array_join(F.slice(chunks, F.lit(1), F.col("_mix_reading.words").cast("int")), ""),
    ).otherwise(F.col(text_col))
    rows = (
        placed.where("_mix_size > 0")
        .withColumn("_mix_reading", F.explode(F.concat(whole, rest)))
        .withColumn("_mix_at", time_at(start / F.col("_mix_target"), F.col("_mix_segments")))
        .withColumn(text_col, read)
    )
    return rows.select(*df.columns, "_mix_at").repartitionByRange("_mix_at").sortWithinPartitions("_mix_at").drop("_mix_at")
