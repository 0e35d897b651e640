"""Orders, chunks and deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from furrow.session import cut

_PRIME = 1000003


def mixed(key: Column, seed: int = 0) -> Column:
    """A pseudo-random number from 0 to 1 of an integer key, in integer arithmetic that any engine repeats."""
    a = (key * 7919 + seed * 104729 + 17) % _PRIME
    return (a * a + key * 31) % _PRIME / float(_PRIME)


def local_order(df: DataFrame, *cols: str, partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by a locality key: neighbours share a partition, no global sort task."""
    spread = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    return spread.sortWithinPartitions(*cols)


def sample_n(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of a simple random sample, the same each time: a top-n by the mixed key."""
    return df.orderBy(mixed(F.col(key), seed), key).limit(n)


def stratified(df: DataFrame, stratum: Column, key: str, n: int | Column, seed: int = 0) -> DataFrame:
    """At most n rows per stratum; ``n`` may depend on the stratum."""
    w = Window.partitionBy("_stratum").orderBy(mixed(F.col(key), seed), key)
    return df.withColumn("_stratum", stratum).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn").withColumnRenamed("_stratum", "stratum")


def round_robin(df: DataFrame, state: str, pool: str, pool_rank: Column, key: str, n: int) -> DataFrame:
    """Per state n rows, one of each pool in turn."""
    own = Window.partitionBy(state, pool).orderBy(mixed(F.col(key)), key)
    turn = Window.partitionBy(state).orderBy("_rn", "_rank", key)
    return df.withColumn("_rn", F.row_number().over(own)).withColumn("_rank", pool_rank).withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= n).drop("_rn", "_rank")


def row_index(df: DataFrame, *order: str, name: str = "row_index") -> DataFrame:
    """Rows numbered from 0 in a total order, without a task that holds them all.

    Rows are range-partitioned and cut; the driver sees one count per partition, and each partition
    numbers its own rows from where the one before it ends. Equal keys share a partition.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())
    if not counts:
        return df.withColumn(name, F.lit(0).cast("long"))
    starts, total = [], 0
    for part, n in counts:
        starts += [F.lit(part), F.lit(total).cast("long")]
        total += n
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn(name, F.create_map(*starts)[F.col("_part")] + own).drop("_part")


def chunks(df: DataFrame, n: int, *order: str) -> DataFrame:
    """n contiguous chunks whose sizes differ by one at most, the larger ones first."""
    total = df.count()
    size, more = divmod(total, n)
    at = F.col("row_index")
    late = F.lit(more) + F.floor((at - more * (size + 1)) / max(size, 1))
    return row_index(df, *order).withColumn("chunk", F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(late).cast("int")).drop("row_index")


def group_chunks(df: DataFrame, group: str, per: int) -> DataFrame:
    """Chunks of so many groups; no group is split. Only the distinct groups are numbered."""
    names = row_index(df.select(group).distinct(), group).select(group, F.floor(F.col("row_index") / per).alias("chunk"))
    return df.join(names, group)


def fixed_chunks(df: DataFrame, size: int, *order: str) -> DataFrame:
    """Chunks of a fixed number of rows in an order."""
    return row_index(df, *order).withColumn("chunk", F.floor(F.col("row_index") / size)).drop("row_index")


def strided(df: DataFrame, n: int, i: int, *order: str) -> DataFrame:
    """Every n-th row from the i-th on."""
    return row_index(df, *order).where(F.col("row_index") % n == i).drop("row_index")


def range_shard(key: Column, size: int) -> Column:
    """The shard of an id range; ids without rows leave gaps."""
    return F.floor((key - 1) / size)


def cluster_blocks(centres: DataFrame, size: int, mask: DataFrame, x: str, y: str) -> DataFrame:
    """The cells of size by size blocks from sampled corners, those inside a mask, each once."""
    steps = F.sequence(F.lit(0), F.lit(size - 1))
    cells = centres.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).select((F.col(x) + F.col("_i")).alias(x), (F.col(y) + F.col("_j")).alias(y))
    return cells.distinct().join(mask, [x, y], "left_semi")


def greedy_apart(df: DataFrame, score: str, key: str, x: str, y: str, group: str, apart: float, k: int, pool: int = 1000) -> list[dict]:
    """Up to k rows by falling score, each at least so far from those before it and one per group.

    The choice depends on what was chosen, so the best ``pool`` rows, a bounded list, are walked on
    the driver. If they don't suffice, the next pass walks the best of all rows that are still
    allowed beside those chosen, until there are k or no row is left: each pass but the last chooses
    one at least.
    """
    chosen: list[dict] = []
    rest = df.orderBy(F.col(score).desc(), key)
    while len(chosen) < k:
        rows = rest.limit(pool).collect()
        known = len(chosen)
        for row in rows:
            r = row.asDict()
            if all((r[x] - c[x]) * (r[x] - c[x]) + (r[y] - c[y]) * (r[y] - c[y]) >= apart * apart and r[group] != c[group] for c in chosen):
                chosen.append(r)
            if len(chosen) == k:
                break
        if len(rows) < pool:
            break
        allowed = F.lit(True)
        for c in chosen[known:]:
            dx, dy = F.col(x) - F.lit(c[x]), F.col(y) - F.lit(c[y])
            allowed &= (dx * dx + dy * dy >= apart * apart) & ~F.col(group).eqNullSafe(F.lit(c[group]))
        rest = rest.where(allowed)
    return chosen


def lay_tiles(regions: DataFrame, region: str, x: str, y: str, grid: int, half: float, years: list[int], seed: int | None = None) -> DataFrame:
    """A grid of square tiles about every region's centre for each year: stub, x, y, grid_r, grid_c, year and region.

    With a seed each year's whole grid is moved by up to half a tile either way, by the year and the
    seed alone, so that tile edges of different years cut different places and years can be added.
    """
    steps = F.sequence(F.lit(0), F.lit(grid - 1))
    rows = regions.select(region, F.col(x).alias("_x"), F.col(y).alias("_y"), F.explode(F.array(*(F.lit(v) for v in years))).alias("year"))
    rows = rows.withColumn("grid_r", F.explode(steps)).withColumn("grid_c", F.explode(steps))
    moved = lambda k: F.lit(0.0) if seed is None else (mixed(F.col("year").cast("long"), seed + k) - 0.5) * 2 * half
    step = lambda c: (F.col(c) - (grid - 1) / 2) * 2 * half
    stub = F.concat(F.col(region), F.lit("_"), F.col("year"), F.lit("_r"), F.col("grid_r"), F.lit("c"), F.col("grid_c"))
    return rows.select(
        stub.alias("stub"), (F.col("_x") + moved(0) + step("grid_c")).alias(x), (F.col("_y") + moved(1) - step("grid_r")).alias(y), "grid_r", "grid_c", "year", region
    )
