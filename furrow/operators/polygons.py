"""Polygons with corners and holes: their pixels by the centre rule, and exact point-in-polygon joins.

Geometries are GeoPackage blobs. Inside is what an odd number of rings' edges lie to the left of, so
holes and parts need no order; a point on a left or lower edge is inside, on a right or upper one not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.spatial import point_in_box
from furrow.sources.geopackage import envelope, rings


def _edges(blob: bytes) -> np.ndarray:
    """x and y of the ends of all edges, a row each; level ones are left out."""
    ends = [(*a, *b) for ring in rings(blob) for a, b in zip(ring, ring[1:], strict=False)]
    edges = np.array(ends, dtype=np.float64).reshape(-1, 4)
    return edges[edges[:, 1] != edges[:, 3]]


def _crossings(edges: np.ndarray, y: float) -> np.ndarray:
    """Where the edges cross a height, from left to right."""
    low, high = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
    own = edges[(low <= y) & (y < high)]
    return np.sort(own[:, 0] + (y - own[:, 1]) / (own[:, 3] - own[:, 1]) * (own[:, 2] - own[:, 0]))


def _runs(blob: bytes, pixel: float) -> list[dict]:
    """The pixels whose centres are inside, as runs of a row: py, first px, and the px after the last."""
    edges, out = _edges(blob), []
    if not len(edges):
        return out
    first = int(np.ceil(edges[:, [1, 3]].min() / pixel - 0.5))
    last = int(np.ceil(edges[:, [1, 3]].max() / pixel - 0.5))
    for py in range(first, last):
        at = np.ceil(_crossings(edges, (py + 0.5) * pixel) / pixel - 0.5).astype(int)
        out += [{"py": py, "x0": int(a), "x1": int(b)} for a, b in zip(at[::2], at[1::2], strict=True) if b > a]
    return out


def polygon_pixels(df: DataFrame, geom: str = "geom", pixel: float = 1.0) -> DataFrame:
    """A row per pixel whose centre lies in the polygon: the geometry becomes px, py.

    A task holds one polygon's runs, a few numbers for each of its rows of pixels. Null geometries have
    no pixels; repeated rows have theirs each.
    """

    @F.arrow_udf("array<struct<py:bigint,x0:bigint,x1:bigint>>")
    def runs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("py", pa.int64()), ("x0", pa.int64()), ("x1", pa.int64())]))
        for blobs in batches:
            yield pa.array([_runs(b.as_py(), pixel) if b.is_valid else [] for b in blobs], kind)

    rest = [c for c in df.columns if c != geom]
    rows = df.select(*rest, F.explode(runs(geom)).alias("_run"))
    return rows.select(*rest, F.col("_run.py").alias("py"), F.explode(F.sequence("_run.x0", F.col("_run.x1") - 1)).alias("px"))


def boxed(df: DataFrame, geom: str = "geom") -> DataFrame:
    """``df`` with the bounding box of its geometries as x0, y0, x1, y1; null geometries go."""

    @F.arrow_udf("array<double>")
    def box(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for blobs in batches:
            yield pa.array([envelope(b.as_py()) for b in blobs], pa.list_(pa.float64()))

    rest = [c for c in df.columns if c not in ("x0", "y0", "x1", "y1")]
    at = df.where(F.col(geom).isNotNull()).select(*rest, box(geom).alias("_box"))
    return at.select(*rest, *(F.col("_box")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


def inside(geom: Column | str, x: Column | str, y: Column | str) -> Column:
    """Whether a point lies in a polygon; the edges of a geometry that stays the same are read once."""

    @F.arrow_udf("boolean")
    def of(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: tuple[bytes | None, np.ndarray] = (None, np.zeros((0, 4)))
        for blobs, xs, ys in batches:
            out = []
            for blob, px, py in zip(blobs.to_pylist(), xs.to_pylist(), ys.to_pylist(), strict=True):
                if blob is None or px is None or py is None:
                    out.append(None)
                    continue
                if blob != known[0]:
                    known = (blob, _edges(blob))
                out.append(bool((_crossings(known[1], py) <= px).sum() % 2))
            yield pa.array(out, pa.bool_())

    return of(geom, x, y)


def point_in_polygon(points: DataFrame, polygons: DataFrame, geom: str = "geom", cell: int = 16) -> DataFrame:
    """Points (x, y) with the polygons that hold them: boxes meet on cells, then the rings decide."""
    wide = boxed(polygons, geom).withColumns({c: f(c).cast("double") for c, f in (("x0", F.floor), ("y0", F.floor), ("x1", F.ceil), ("y1", F.ceil))})
    met = point_in_box(points, wide, "inner", cell)
    return met.where(inside(geom, "x", "y")).drop("x0", "y0", "x1", "y1")
