"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from furrow.session import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _digest(edges: DataFrame) -> tuple[int, object, int]:
    """The number of edges, a sum over their hashes, equal for equal tables, and the largest degree."""
    per = _both(edges).groupBy("u").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    n, digest, most = per.agg(F.sum("n"), F.sum("h"), F.max("n")).first()
    return (n or 0) // 2, digest, most or 0


#: Keys with more rows than this, and than a fifty-thousandth of all, are hot: at most 50,000 of them.
HOT = 1000


#: Rows from which on a table's joins deal them.
MANY = 200_000


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """Joins deal the rows by their keys where there are many.

    A checkpoint keeps the size that Spark estimated before it, and for edges that come of explodes
    that is far too low: they would be broadcast.
    """
    return df.hint("merge") if rows > MANY else df


def hot_from(rows: int) -> int:
    return max(HOT, rows // 50_000)


def with_least(df: DataFrame, key: str, value: str, name: str, rows: int) -> DataFrame:
    """Rows with the smallest ``value`` of their ``key`` (long) as ``name``; no task holds all rows of a hot key.

    The minima are reduced before the shuffle. Those of hot keys, which are few by definition of the
    limit, go to every task; the rows of all other keys meet theirs in a shuffle join.
    """
    least = df.groupBy(key).agg(F.min(value).alias(name), F.count("*").alias("_n"))
    limit = hot_from(rows)
    hot = F.broadcast(least.where(F.col("_n") > limit).select(F.col(key).alias("_hot"), name))
    cold = dealt(least.where(F.col("_n") <= limit).drop("_n"), rows)
    spread = df.join(hot, F.col(key) == F.col("_hot")).drop("_hot")
    rest = df.join(hot.select("_hot"), F.col(key) == F.col("_hot"), "left_anti").join(cold, key)
    return spread.unionByName(rest)


def _least(edges: DataFrame, rows: int, hubs: bool) -> DataFrame:
    if hubs:
        return with_least(edges, "u", "v", "m", rows)
    return edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))


def components(edges: DataFrame, rows: int | None = None, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``edges`` (src long, dst long); component = smallest node.

    ``rows``, if known, is about how many edges there are at most.

    Each round keeps at most as many edges as the one before and halves the depth of the trees, so
    the rounds grow with the logarithm of a component's diameter. A hub's rows never meet in one
    task (see ``with_least``). Nulls and loops are ignored; repeated edges count once; an empty
    table gives no rows.
    """
    now = cut(
        edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct(),
        rows,
    )
    before = _digest(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        # Hubs are met rarely; without them one shuffle brings a node's edges together, and nothing is joined.
        # No degree grows in between.
        hubs = before[2] > hot_from(before[0])
        known = _least(_both(now), before[0], hubs)
        large = known.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        tied = _least(cut(large.distinct(), before[0]) if hubs else large.repartition("u").distinct(), before[0], hubs)
        # One projection, not a union of two filters, for which the large stars would be made twice.
        small = tied.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = cut(small, before[0])
        same, before = before, _digest(now)
        if same == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
