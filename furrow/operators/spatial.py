"""Spatial joins as equi joins on grid cells, with the exact test behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from furrow.functions.scalars import haversine
from furrow.operators.geometry import dealt
from furrow.session import cut


def _cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, cell: float) -> DataFrame:
    """A row for every cell that a closed box touches; joins deal them."""
    lo = lambda v: F.floor(v / cell)
    return dealt(df.withColumn("_cx", F.explode(F.sequence(lo(x0), lo(x1)))).withColumn("_cy", F.explode(F.sequence(lo(y0), lo(y1)))))


def box_pairs(a: DataFrame, b: DataFrame, cell: int = 16, condition: Column | None = None) -> DataFrame:
    """Pairs of overlapping half-open boxes with their common area; columns get prefixes a_ and b_.

    A pair is reported in the one cell that holds the lower corner of its intersection, so that no
    distinct is needed however many cells two boxes share.
    """
    last = lambda c: F.col(c) - 1
    left = _cells(a, F.col("x0"), F.col("y0"), last("x1"), last("y1"), cell).select(*(F.col(c).alias(f"a_{c}") for c in a.columns), "_cx", "_cy")
    right = _cells(b, F.col("x0"), F.col("y0"), last("x1"), last("y1"), cell).select(*(F.col(c).alias(f"b_{c}") for c in b.columns), "_cx", "_cy")
    x0, y0 = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    x1, y1 = F.least("a_x1", "b_x1"), F.least("a_y1", "b_y1")
    here = (F.floor(x0 / cell) == F.col("_cx")) & (F.floor(y0 / cell) == F.col("_cy"))
    joined = left.join(right, ["_cx", "_cy"]).where((x1 > x0) & (y1 > y0) & here)
    if condition is not None:
        joined = joined.where(condition)
    return joined.withColumn("inter_px", (x1 - x0) * (y1 - y0)).drop("_cx", "_cy")


def point_in_box(points: DataFrame, boxes: DataFrame, how: str = "inner", cell: int = 16) -> DataFrame:
    """Points (x, y) with the boxes that hold them; a left join keeps points outside all boxes."""
    at = points.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    tiles = _cells(boxes, F.col("x0"), F.col("y0"), F.col("x1") - 1, F.col("y1") - 1, cell).withColumnsRenamed({"_cx": "_bx", "_cy": "_by"})
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return at.join(tiles, (F.col("_cx") == F.col("_bx")) & (F.col("_cy") == F.col("_by")) & inside, how).drop("_cx", "_cy", "_bx", "_by")


def one_each(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row per key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def box_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance from a point to a box, zero inside."""
    dx = F.greatest(x0 - x, x - x1, F.lit(0.0))
    dy = F.greatest(y0 - y, y - y1, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def near_boxes(points: DataFrame, boxes: DataFrame, reach: float, cell: int = 16) -> DataFrame:
    """All boxes within a distance of each point, with it: boxes grown by the reach join on cells."""
    at = points.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    wide = _cells(boxes, F.col("x0") - reach, F.col("y0") - reach, F.col("x1") + reach, F.col("y1") + reach, cell)
    dist = box_distance(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return at.join(wide, ["_cx", "_cy"]).withColumn("dist", dist).where(F.col("dist") <= reach).drop("_cx", "_cy")


def nearest_box(points: DataFrame, boxes: DataFrame, key: str, box_key: str, reach: float, cell: int = 16) -> DataFrame:
    """The box that holds a point, else the nearest within reach; ties go to the smaller box key."""
    return one_each(near_boxes(points, boxes, reach, cell), [key], "dist", box_key)


def best_match(pairs: DataFrame, key: str, score: str, target: str, also: list[str] | None = None) -> DataFrame:
    """Per key the target with the best score, the smaller target of ties."""
    best = F.max_by(F.struct(target, score, *(also or [])), F.struct(score, -F.col(target)))
    return pairs.groupBy(key).agg(best.alias("_m")).select(key, "_m.*")


def neighbours(df: DataFrame, kx: str = "kx", ky: str = "ky", reach: int = 1) -> DataFrame:
    """Every cell with the offsets of its neighbourhood, itself left out: an explode for an equi join."""
    ring = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if (i, j) != (0, 0)]
    around = F.explode(F.array(*(F.struct((F.col(kx) + i).alias("nx"), (F.col(ky) + j).alias("ny")) for i, j in ring)))
    return df.withColumn("_n", around).withColumn("nx", F.col("_n.nx")).withColumn("ny", F.col("_n.ny")).drop("_n")


def owner_cell(v: Column, size: float) -> Column:
    """The lattice cell that owns a coordinate."""
    return F.floor(v / size)


def nearest_different(df: DataFrame, key: str, group: str, label: str, lon: str = "lon", lat: str = "lat", cell: float = 0.5, levels: int = 5) -> DataFrame:
    """Per row the distance in metres to the nearest row of its group with another label; NULL if there is none.

    Rows meet in the 3 by 3 cells around them. A distance is final when nothing outside those cells
    can be nearer; rows without one go on to cells four times as wide, of which the last hold
    everything. So a dense group costs its neighbourhoods, not all its pairs.
    """
    todo = df.select(key, group, label, F.col(lon).alias("_lon"), F.col(lat).alias("_lat"))
    there = todo.select(F.col(group).alias("_g"), F.col(label).alias("_other"), F.col("_lon").alias("_x"), F.col("_lat").alias("_y"))
    done: DataFrame | None = None
    for level in range(levels):
        c = cell * 4**level if level < levels - 1 else 720.0
        at = lambda x: F.floor(x / c)  # noqa: B023, E731
        around = neighbours(todo.withColumns({"_cx": at(F.col("_lon")), "_cy": at(F.col("_lat"))}), "_cx", "_cy")
        own = todo.withColumns({"nx": at(F.col("_lon")), "ny": at(F.col("_lat"))})
        cells = around.drop("_cx", "_cy").unionByName(own)
        other = there.withColumns({"_nx": at(F.col("_x")), "_ny": at(F.col("_y"))})
        on = (F.col("nx") == F.col("_nx")) & (F.col("ny") == F.col("_ny")) & (F.col(group) == F.col("_g")) & (F.col(label) != F.col("_other"))
        met = cells.join(other, on).groupBy(key).agg(F.min(haversine(F.col("_lon"), F.col("_lat"), F.col("_x"), F.col("_y"))).alias("nearest_m"))
        found = cut(todo.join(met, key, "left"))
        # What lies outside the nine cells is at least a cell's width away, along a meridian or a parallel.
        safe = c * 111_000.0 * F.cos(F.radians(F.least(F.abs(F.col("_lat")) + c, F.lit(89.9))))
        final = F.lit(True) if level == levels - 1 else F.coalesce(F.col("nearest_m") <= safe, F.lit(False))
        part = found.where(final).select(key, "nearest_m")
        done = part if done is None else done.unionByName(part)
        todo = found.where(~final).drop("nearest_m")
        if todo.isEmpty():
            break
    return done
