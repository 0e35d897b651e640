"""Polygons with holes and parts against a test of every pixel."""

from __future__ import annotations

import random
import sqlite3

import pytest

from furrow.operators import polygons
from furrow.session import scratch
from furrow.sources import geopackage


def _inside(rings, x, y):
    """Crossings of a ray to the left, edge by edge."""
    hits = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if ay != by and min(ay, by) <= y < max(ay, by) and ax + (y - ay) / (by - ay) * (bx - ax) <= x:
                hits += 1
    return hits % 2 == 1


def _shapes():
    rng = random.Random(2)
    shapes = {1: [[[(0, 0), (9, 0), (9, 4), (4, 4), (4, 9), (0, 9)], [(1, 1), (3, 1), (3, 3), (1, 3)]]]}
    for k in range(2, 12):
        parts = []
        for p in range(1 + k % 2):
            ring = [(rng.uniform(0, 30) + 40 * p, rng.uniform(-20, 30)) for _ in range(rng.randint(3, 8))]
            parts.append([ring])
        shapes[k] = parts
    return shapes


def test_rings_of_polygons_and_multipolygons_round_trip():
    for parts in _shapes().values():
        got = geopackage.rings(geopackage.encode_polygons(parts))
        assert [r[:-1] for r in got] == [[tuple(map(float, p)) for p in ring] for part in parts for ring in part]
    with pytest.raises(ValueError, match="mount"):
        geopackage._local("hdfs://host/layer")


def test_pixels_and_points_against_every_pixel(spark):
    shapes = _shapes()
    frame = spark.createDataFrame([(k, geopackage.encode_polygons(p)) for k, p in shapes.items()] + [(99, None)], "k long, geom binary")
    want = set()
    for k, parts in shapes.items():
        every = [ring for part in parts for ring in part]
        want |= {(k, x, y) for x in range(-5, 80) for y in range(-25, 40) if _inside(every, x + 0.5, y + 0.5)}
    assert {(r.k, r.px, r.py) for r in polygons.polygon_pixels(frame).collect()} == want
    rng = random.Random(3)
    points = [(i, rng.uniform(-5, 80), rng.uniform(-25, 40)) for i in range(400)]
    got = {(r.p, r.k) for r in polygons.point_in_polygon(spark.createDataFrame(points, "p long, x double, y double"), frame).collect()}
    assert got == {(i, k) for i, x, y in points for k, parts in shapes.items() if _inside([ring for part in parts for ring in part], x, y)}


def test_layers_hold_the_tables_that_readers_ask_for(spark):
    spark.dataSource.register(geopackage.GeoPackage)
    path = scratch(spark, "layer")
    frame = spark.createDataFrame([(1, geopackage.encode_polygons(_shapes()[3]))], "fid long, geom binary").coalesce(1)
    frame.write.format("geopackage").option("path", path).option("layer", "fields").mode("append").save()
    import glob

    names = set()
    for name in glob.glob(geopackage._local(path) + "/*.gpkg"):
        con = sqlite3.connect(name)
        names |= {r[0] for r in con.execute("select table_name from gpkg_geometry_columns")}
        assert con.execute("select count(*) from gpkg_spatial_ref_sys").fetchone()[0] >= 3
        assert con.execute("pragma application_id").fetchone()[0] == int.from_bytes(b"GPKG", "big")
    assert names == {"fields"}
