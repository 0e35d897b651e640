"""Geometry on the pixel model: a polygon is the set of its 10 m pixels.

Boxes are half-open, [x0, x1) by [y0, y1) in pixels. Set operations are relational: area is a count,
intersection an inner join on (px, py), difference an anti join, union a distinct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PIXEL_M = 10
HA_PER_PIXEL = PIXEL_M * PIXEL_M / 1e4


def dealt(df: DataFrame) -> DataFrame:
    """Rows that joins deal by their keys and never send whole to the driver.

    Spark takes what an explode makes to be no larger than what went in, and a semi join's rows to be
    no more than its left side's, so it would broadcast millions of pixels. The hint holds through
    projections, filters and aggregates, not through a join.
    """
    return df.hint("merge")


def pixels(boxes: DataFrame) -> DataFrame:
    """A row per pixel of each box; x0, y0, x1, y1 become px, py."""
    rest = [c for c in boxes.columns if c not in ("x0", "y0", "x1", "y1")]
    return dealt(
        boxes.where("x1 > x0 and y1 > y0")
        .select(*rest, "y0", "y1", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("px"))
        .select(*rest, "px", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("py"))
    )


def exposed(px: DataFrame, key: str = "poly_id") -> DataFrame:
    """Pixels with flags left, right, below, above: no pixel of the same polygon lies there.

    One shuffle on the key serves both orderings.
    """
    rows, cols = Window.partitionBy(key, "py").orderBy("px"), Window.partitionBy(key, "px").orderBy("py")
    gone = lambda w, c, step: ~F.coalesce((F.lag(c).over(w) == F.col(c) - 1) if step < 0 else (F.lead(c).over(w) == F.col(c) + 1), F.lit(False))
    return px.repartition(key).select(
        "*", gone(rows, "px", -1).alias("left"), gone(rows, "px", 1).alias("right"), gone(cols, "py", -1).alias("below"), gone(cols, "py", 1).alias("above")
    )


def shape(px: DataFrame, key: str = "poly_id") -> DataFrame:
    """Area, perimeter, compactness, bounds, centroid and a point inside, per polygon."""
    edges = sum((F.col(c).cast("int") for c in ("left", "right", "below", "above")), F.lit(0))
    out = exposed(px, key).groupBy(key).agg(
        F.count("*").alias("n_px"), F.sum(edges).alias("n_edges"), F.min("px").alias("x0"), F.min("py").alias("y0"), (F.max("px") + 1).alias("x1"), (F.max("py") + 1).alias("y1"),
        (F.avg("px") + 0.5).alias("cx"), (F.avg("py") + 0.5).alias("cy"),
    )
    inside = px.join(out.select(key, "cx", "cy"), key)
    away = F.pow(F.col("px") + 0.5 - F.col("cx"), 2) + F.pow(F.col("py") + 0.5 - F.col("cy"), 2)
    point = inside.groupBy(key).agg(F.min_by(F.struct("px", "py"), F.struct(F.round(away, 9), "px", "py")).alias("inside"))
    return out.join(point, key).select(
        key, (F.col("n_px") * HA_PER_PIXEL).alias("area_ha"), (F.col("n_edges") * PIXEL_M).alias("perimeter_m"),
        (F.col("n_edges") / F.sqrt(F.col("n_px").cast("double"))).alias("compactness"), "x0", "y0", "x1", "y1", "cx", "cy", F.col("inside.px").alias("in_x"), F.col("inside.py").alias("in_y"),
    )


def overlaps(a: DataFrame, b: DataFrame, a_id: str, b_id: str, condition: Column | None = None) -> DataFrame:
    """Common pixels of pairs of polygons, by an equi join on the pixel and a partial count."""
    left = dealt(a.select(*(F.col(c).alias(f"a_{c}") for c in a.columns)))
    right = dealt(b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns)))
    on = (F.col("a_px") == F.col("b_px")) & (F.col("a_py") == F.col("b_py"))
    return left.join(right, on if condition is None else on & condition).groupBy(F.col(f"a_{a_id}").alias("a"), F.col(f"b_{b_id}").alias("b")).agg(F.count("*").alias("inter_px"))


def with_areas(pairs: DataFrame, areas_a: DataFrame, areas_b: DataFrame) -> DataFrame:
    """Pairs with both areas (px), IoU, containment in the smaller one, and each side's share."""
    i, a, b = F.col("inter_px"), F.col("area_a"), F.col("area_b")
    joined = pairs.join(areas_a.toDF("a", "area_a"), "a").join(areas_b.toDF("b", "area_b"), "b")
    return joined.withColumns({"iou": i / (a + b - i).cast("double"), "contain": i / F.least(a, b).cast("double"), "share_a": i / a.cast("double"), "share_b": i / b.cast("double")})


#: Pixels to the side of the square blocks in which pixels of neighbours meet in one task.
BLOCK = 256


def areas(px: DataFrame, key: str = "poly_id") -> DataFrame:
    return px.groupBy(key).agg(F.count("*").alias("n_px"))


_RING = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def _spread(px: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    around = F.explode(F.array(*(F.struct((F.col("px") + i).alias("x"), (F.col("py") + j).alias("y")) for i, j in offsets)))
    rest = [c for c in px.columns if c not in ("px", "py")]
    return px.select(*rest, around.alias("_n")).select(*rest, F.col("_n.x").alias("px"), F.col("_n.y").alias("py"))


def with_core(px: DataFrame, key: str = "poly_id") -> DataFrame:
    """key, px, py and ``core``: all eight neighbours belong to the polygon too.

    First those beside a pixel are looked at, then whether the pixels above and below have theirs; one
    shuffle on the key serves both.
    """
    rows, cols = Window.partitionBy(key, "py").orderBy("px"), Window.partitionBy(key, "px").orderBy("py")
    beside = (F.lag("px").over(rows) == F.col("px") - 1) & (F.lead("px").over(rows) == F.col("px") + 1)
    both = (F.lag("py").over(cols) == F.col("py") - 1) & (F.lead("py").over(cols) == F.col("py") + 1) & F.lag("_h").over(cols) & F.lead("_h").over(cols)
    flat = px.select(key, "px", "py").repartition(key).withColumn("_h", F.coalesce(beside, F.lit(False)))
    return flat.select(key, "px", "py", F.coalesce(F.col("_h") & both, F.lit(False)).alias("core"))


def eroded(px: DataFrame, key: str = "poly_id") -> DataFrame:
    """Pixels all of whose eight neighbours belong to the polygon too."""
    return with_core(px, key).where("core").drop("core")


def eroded_or_whole(px: DataFrame, key: str = "poly_id") -> DataFrame:
    """The eroded polygon, or the polygon itself where nothing is left."""
    left = F.max("core").over(Window.partitionBy(key))
    return with_core(px, key).withColumn("_left", left).where("core or not _left").drop("core", "_left")


def _grown(px: DataFrame, key: str, rings: int) -> DataFrame:
    """key, px, py of the polygon and so many rings around it, and whether a pixel is its ``own``.

    The square around a pixel is made along one axis and then the other; after one shuffle on the key
    no task needs rows of another.
    """
    steps = range(-rings, rings + 1)
    out = px.select(key, "px", "py").repartition(key).withColumn("own", F.lit(True))
    for axis in ("px", "py"):
        here = F.explode(F.array(*(F.struct((F.col(axis) + i).alias("v"), (F.col("own") & F.lit(i == 0)).alias("own")) for i in steps))).alias("_n")
        rest = "py" if axis == "px" else "px"
        out = out.select(key, rest, here).groupBy(key, rest, F.col("_n.v").alias(axis)).agg(F.max("_n.own").alias("own"))
    return out.select(key, "px", "py", "own")


def dilated(px: DataFrame, key: str = "poly_id", rings: int = 1) -> DataFrame:
    """The polygon with so many rings of pixels around it."""
    return _grown(px, key, rings).drop("own")


def ring(px: DataFrame, key: str = "poly_id", rings: int = 1) -> DataFrame:
    """The rings of pixels around a polygon alone, those in its holes among them."""
    return _grown(px, key, rings).where("not own").drop("own")


def union(px: DataFrame, group: str) -> DataFrame:
    """The pixels of a group's polygons, each once."""
    return px.select(group, "px", "py").distinct()


def difference(px: DataFrame, other: DataFrame) -> DataFrame:
    """Pixels that the other set doesn't have."""
    return px.join(dealt(other.select("px", "py").distinct()), ["px", "py"], "left_anti")


def coverage(px: DataFrame, covering: DataFrame, key: str = "poly_id") -> DataFrame:
    """The share of each polygon that other polygons cover together; ``covering`` has own, px, py."""
    # Another polygon is there if the least or the largest key at the pixel is not the own one; pixels are
    # dealt by blocks, so that most of a polygon's are counted in one task before its count is shuffled.
    both = px.select(key, "px", "py", F.lit(None).cast(covering.schema["own"].dataType).alias("own")).unionByName(covering.select(F.lit(None).cast(px.schema[key].dataType).alias(key), "px", "py", "own"))
    blocks = both.withColumns({"_bx": F.floor(F.col("px") / BLOCK), "_by": F.floor(F.col("py") / BLOCK)}).repartition("_bx", "_by")
    here = Window.partitionBy("_bx", "_by", "px", "py")
    seen = blocks.withColumns({"_low": F.min("own").over(here), "_high": F.max("own").over(here)}).where(F.col(key).isNotNull())
    hit = (F.col("_low") != F.col(key)) | (F.col("_high") != F.col(key))
    per = seen.groupBy(key).agg(F.count("*").alias("n_px"), F.count_if(F.coalesce(hit, F.lit(False))).alias("n_covered"))
    return per.select(key, "n_px", "n_covered", (F.col("n_covered") / F.col("n_px").cast("double")).alias("coverage"))


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, block, px, py) sorted so, whole blocks together, with the least row of their part within the block as ``_at``.

    Runs of a column of pixels meet those of the column before; a batch's last block waits for the next batch.
    """
    kept: list[np.ndarray] = []

    def label(v: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(v), dtype=bool)
        new[1:] = (v[1:, :4] != v[:-1, :4]).any(axis=1)
        v = v[new]
        edge = np.zeros((2, 0), dtype=np.int64)
        if len(v) > 1:
            up = np.flatnonzero((v[1:, :3] == v[:-1, :3]).all(axis=1) & (v[1:, 3] == v[:-1, 3] + 1))
            # The pixel to the left, by search among the rows of the same group and block.
            code = np.cumsum(np.r_[0, (v[1:, :2] != v[:-1, :2]).any(axis=1)])
            place = (code * (BLOCK + 1) + v[:, 2] % BLOCK + 1) * BLOCK + v[:, 3] % BLOCK
            order = np.argsort(place, kind="stable")
            at = order[np.minimum(np.searchsorted(place[order], place - BLOCK), len(v) - 1)]
            left = np.flatnonzero((v[at, :2] == v[:, :2]).all(axis=1) & (v[at, 2] == v[:, 2] - 1) & (v[at, 3] == v[:, 3]))
            edge = np.stack([np.r_[up, at[left]], np.r_[up + 1, left]])
        root = np.arange(len(v))
        while edge.shape[1]:
            a, b = root[edge[0]], root[edge[1]]
            edge, a, b = edge[:, a != b], a[a != b], b[a != b]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
        own = v[root]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (v[:, 0], v[:, 2], v[:, 3], own[:, 2], own[:, 3])], names=["_g", "px", "py", "_ax", "_ay"])

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1))
        last = kept[-1]
        if (last[0, :2] == last[-1, :2]).all():
            continue
        cut_at = int(np.flatnonzero((last[:, :2] != last[-1, :2]).any(axis=1))[-1]) + 1
        yield label(np.concatenate([*kept[:-1], last[:cut_at]]))
        kept = [last[cut_at:]]
    if kept:
        yield label(np.concatenate(kept))


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows of numbers sorted by their first column, in pieces that end where it changes."""
    kept: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)], axis=1))
        last = kept[-1]
        if last[0, 0] == last[-1, 0]:
            continue
        cut_at = int(np.searchsorted(last[:, 0], last[-1, 0]))
        yield np.concatenate([*kept[:-1], last[:cut_at]])
        kept = [last[cut_at:]]
    if kept:
        yield np.concatenate(kept)


def _stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, px, py, key) sorted by block: the lists of keys that share a pixel, with the number of such pixels."""
    for v in _whole_blocks(batches):
        v = v[np.lexsort((v[:, 3], v[:, 2], v[:, 1]))]
        new = np.ones(len(v), dtype=bool)
        new[1:] = (v[1:, 1:] != v[:-1, 1:]).any(axis=1)
        v = v[new]
        first = np.ones(len(v), dtype=bool)
        first[1:] = (v[1:, 1:3] != v[:-1, 1:3]).any(axis=1)
        start = np.flatnonzero(first)
        length = np.diff(np.r_[start, len(v)])
        names, code = np.unique(v[:, 3], return_inverse=True)
        # Lists are named by their prefix's name and their last key, so equal names are equal lists.
        name, known = np.zeros(len(start), dtype=np.int64), 1
        for k in range(int(length.max())):
            more = length > k
            found, at = np.unique(name[more] * len(names) + code[start[more] + k], return_inverse=True)
            name[more] = known + at
            known += len(found)
        _, one, n = np.unique(name, return_index=True, return_counts=True)
        ends = np.cumsum(length[one])
        rows = np.repeat(start[one] - np.r_[0, ends[:-1]], length[one]) + np.arange(ends[-1])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(np.ascontiguousarray(v[rows, 3])))
        yield pa.RecordBatch.from_arrays([lists, pa.array(n)], names=["keys", "n"])


def stacks(px: DataFrame, key: str = "poly_id") -> DataFrame:
    """keys, n: the polygons that share pixels, ascending, and how many pixels just these share; a list may come in several rows.

    A polygon is cut into few such pieces, so what is counted over pixels and polygons together is
    counted on far fewer rows. Pixels are dealt by blocks once; a task holds a block at a time.
    """
    at = lambda c: F.floor(F.col(c) / BLOCK)
    rows = px.where(F.col(key).isNotNull()).select(F.xxhash64(at("px"), at("py")).alias("_b"), F.col("px").cast("long"), F.col("py").cast("long"), F.col(key).cast("long").alias("_k"))
    return rows.repartition("_b").sortWithinPartitions("_b").mapInArrow(_stacked, "keys array<long>, n long")


def parts(px: DataFrame, group: str) -> DataFrame:
    """group, part, n_px: the 4-connected parts of pixel sets; a part is named by a hash of one of its pixels.

    A pixel's key is a 64-bit hash of group and place, so groups and places may be any numbers. Blocks of
    ``BLOCK`` by ``BLOCK`` pixels are joined up each in one task; only the pixels along their edges, and
    the parts that they belong to, take part in the components over all blocks.
    """
    from furrow.operators.graph import components
    from furrow.session import cut

    at = lambda c: F.floor(F.col(c) / BLOCK)
    none = F.lit(-(2**63))
    rows = px.select(F.coalesce(F.col(group).cast("long"), none).alias("_g"), F.xxhash64(at("px"), at("py")).alias("_b"), F.col("px").cast("long"), F.col("py").cast("long"))
    flat = rows.repartition("_g", "_b").sortWithinPartitions("_g", "_b", "px", "py").mapInArrow(_labelled, "_g long, px long, py long, _ax long, _ay long")
    own = flat.withColumn("node", F.xxhash64("_g", "_ax", "_ay"))
    side = lambda c: F.pmod(F.col(c), F.lit(BLOCK))
    last = (side("px") == BLOCK - 1) | (side("py") == BLOCK - 1) | (side("px") == 0) | (side("py") == 0)
    # One pass makes both: the size of each part within its block, and the pixels along the block's edges.
    rim = own.where(last).select("_g", "px", "py", "node", F.lit(None).cast("long").alias("n"))
    sizes = own.groupBy("_g", "node").agg(F.count("*").alias("n")).select("_g", F.lit(None).cast("long").alias("px"), F.lit(None).cast("long").alias("py"), "node", "n")
    known = cut(rim.unionByName(sizes))
    rim, sizes = known.where("px is not null"), known.where("px is null").select("_g", "node", "n")
    there = dealt(rim.select("_g", "px", "py", F.col("node").alias("dst")))
    step = lambda dx, dy, c: rim.where(side(c) == BLOCK - 1).select("_g", (F.col("px") + dx).alias("px"), (F.col("py") + dy).alias("py"), F.col("node").alias("src"))
    edges = dealt(step(1, 0, "px").unionByName(step(0, 1, "py"))).join(there, ["_g", "px", "py"]).select("src", "dst").distinct()
    named = dealt(sizes).join(dealt(components(edges)), "node", "left").withColumn("part", F.coalesce("component", "node"))
    return named.groupBy(F.nullif("_g", none).cast(px.schema[group].dataType).alias(group), "part").agg(F.sum("n").alias("n_px"))


def edge_touch(px: DataFrame, size: int, key: str = "poly_id") -> DataFrame:
    """Metres of each polygon's boundary that run along the lattice of square tiles."""
    x, y = F.pmod("px", F.lit(size)), F.pmod("py", F.lit(size))
    along = [F.col("left") & (x == 0), F.col("right") & (x == size - 1), F.col("below") & (y == 0), F.col("above") & (y == size - 1)]
    return exposed(px, key).groupBy(key).agg((F.sum(sum((c.cast("int") for c in along), F.lit(0))) * PIXEL_M).alias("edge_m"))


def tile_distance(x0: Column, y0: Column, x1: Column, y1: Column, kx: Column, ky: Column, size: int) -> Column:
    """Metres from a bounding box's sides to its own tile's sides, the least of the four."""
    return F.least(F.abs(x0 - kx * size), F.abs(x1 - (kx + 1) * size), F.abs(y0 - ky * size), F.abs(y1 - (ky + 1) * size)) * PIXEL_M


def lattice_distance(v: Column, origin: float, step: float) -> Column:
    """Distance to the nearest line of a lattice."""
    return F.abs(F.pmod(v - origin + step / 2, F.lit(float(step))) - step / 2)


def recover_lattice(df: DataFrame, v: str) -> DataFrame:
    """One row: the smallest step between distinct positions, and the median position modulo it."""
    seen = df.select(F.col(v).cast("double").alias("v")).distinct()
    step = seen.select((F.col("v") - F.lag("v").over(Window.orderBy("v"))).alias("s")).agg(F.min("s").alias("step"))
    return seen.join(F.broadcast(step)).groupBy("step").agg(F.median(F.pmod("v", "step")).alias("origin"))


def rasterise(px: DataFrame, order: str = "poly_id") -> DataFrame:
    """px, py and the polygon that is drawn last there."""
    return px.groupBy("px", "py").agg(F.max(order).alias(order))


def resample(cells: DataFrame, value: str, factor: int) -> DataFrame:
    """Blocks of factor by factor cells: largest, mean and count.

    Fractions are summed as decimals, so the mean doesn't depend on an order of rows; where a value is
    not finite or has over ten digits before the point, it is the plain one.
    """
    mean = F.avg(value)
    if cells.schema[value].dataType.typeName() in ("double", "float"):
        exact = F.col(value).cast("string").try_cast("decimal(28,18)")
        mean = F.when(F.count(exact) == F.count(value), (F.sum(exact) / F.count(value)).cast("double")).otherwise(mean)
    return cells.groupBy(F.floor(F.col("px") / factor).alias("bx"), F.floor(F.col("py") / factor).alias("by")).agg(F.max(value).alias("most"), mean.alias("mean"), F.count("*").alias("n"))


def identity(px: DataFrame, key: str = "poly_id") -> DataFrame:
    """A polygon's md5 over its sorted pixels: equal shapes in equal places have equal hashes."""
    return px.groupBy(key).agg(F.md5(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("px", "py"))), lambda p: F.concat_ws(",", p["px"], p["py"])))).alias("hash"))


def tree_fraction(px: DataFrame, canopy: DataFrame, height: float, key: str = "poly_id") -> DataFrame:
    """Share of a polygon's pixels with canopy data above a height; NULL where there are no data."""
    return px.join(dealt(canopy), ["px", "py"], "left").groupBy(key).agg(
        F.count("height").alias("n_seen"), F.try_divide(F.count_if(F.col("height") > height).cast("double"), F.count("height").cast("double")).alias("tree_frac")
    )


def band_share(half: float, band: float) -> float:
    """The share of a square's area within a band along its sides, in closed form."""
    inner = max(0.0, half - band)
    return 1 - (inner / half) ** 2
