"""GeoPackage layers: a reader and writer as a Spark data source, and the geometry blob's codec.

A GeoPackage is an SQLite file, so its path must be a folder that driver and executors mount. Each
task writes one file, under a name of its own; a layer is all files of the folder that the commit
named in its manifest. Boxes are stored as polygons with an envelope in the blob's header.
"""

from __future__ import annotations

import json
import os
import sqlite3
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructType

#: Bytes of the envelope by its code in the header's flags.
ENVELOPES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
_MANIFEST = "manifest.json"
#: The application id and the tables that the GeoPackage standard asks of every file.
_TABLES = """
PRAGMA application_id = 1196444487;
PRAGMA user_version = 10300;
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
INSERT INTO gpkg_spatial_ref_sys VALUES
  ('Undefined Cartesian', -1, 'NONE', -1, 'undefined', NULL), ('Undefined geographic', 0, 'NONE', 0, 'undefined', NULL),
  ('WGS 84', 4326, 'EPSG', 4326, 'undefined', NULL), ('GDA94 / Australian Albers', 3577, 'EPSG', 3577, 'undefined', NULL);
CREATE TABLE gpkg_contents (table_name TEXT NOT NULL PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER REFERENCES gpkg_spatial_ref_sys(srs_id));
CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
CREATE TABLE gpkg_extensions (table_name TEXT, column_name TEXT, extension_name TEXT NOT NULL, definition TEXT NOT NULL, scope TEXT NOT NULL);
"""


def encode_box(x0: float, y0: float, x1: float, y1: float, srs: int = 3577) -> bytes:
    """A box as a GeoPackage blob: header with envelope, then the polygon as little-endian WKB."""
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    wkb = struct.pack("<BIII", 1, 3, 1, len(ring)) + b"".join(struct.pack("<2d", *p) for p in ring)
    return b"GP" + struct.pack("<BBi4d", 0, 0b11, srs, x0, x1, y0, y1) + wkb


def encode_polygons(parts: list[list[list[tuple[float, float]]]], srs: int = 3577) -> bytes:
    """Parts, each its outer ring and its holes, as a blob: a polygon if there is one part, else a multipolygon."""
    points = [p for rings_of in parts for ring in rings_of for p in ring]
    xs, ys = zip(*points, strict=True)

    def polygon(rings_of: list) -> bytes:
        out = struct.pack("<BII", 1, 3, len(rings_of))
        for ring in rings_of:
            closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
            out += struct.pack("<I", len(closed)) + b"".join(struct.pack("<2d", *p) for p in closed)
        return out

    body = b"".join(map(polygon, parts))
    wkb = body if len(parts) == 1 else struct.pack("<BII", 1, 6, len(parts)) + body
    return b"GP" + struct.pack("<BBi4d", 0, 0b11, srs, min(xs), max(xs), min(ys), max(ys)) + wkb


def decode_header(blob: bytes) -> tuple[int, tuple[float, float, float, float] | None, int]:
    """Reference system, (minx, miny, maxx, maxy) if the header has it, and where the WKB begins."""
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    flags = blob[3]
    order = "<" if flags & 1 else ">"
    size = ENVELOPES[flags >> 1 & 7]
    (srs,) = struct.unpack_from(order + "i", blob, 4)
    box = None
    if size:
        minx, maxx, miny, maxy = struct.unpack_from(order + "4d", blob, 8)
        box = (minx, miny, maxx, maxy)
    return srs, box, 8 + size


def rings(blob: bytes) -> list[list[tuple[float, float]]]:
    """The rings of a polygon's or a multipolygon's blob, of all parts one after the other."""
    out: list[list[tuple[float, float]]] = []

    def shape(at: int) -> int:
        order = "<" if blob[at] else ">"
        kind, n = struct.unpack_from(order + "II", blob, at + 1)
        if kind not in (3, 6):
            raise ValueError(f"geometry type {kind} is neither a polygon nor a multipolygon")
        at += 9
        for _ in range(n):
            if kind == 6:
                at = shape(at)
                continue
            (count,) = struct.unpack_from(order + "I", blob, at)
            flat = struct.unpack_from(order + f"{2 * count}d", blob, at + 4)
            out.append(list(zip(flat[::2], flat[1::2], strict=True)))
            at += 4 + 16 * count
        return at

    shape(decode_header(blob)[2])
    return out


def envelope(blob: bytes) -> tuple[float, float, float, float]:
    """The box of a geometry, from its header alone where that has one."""
    box = decode_header(blob)[1]
    if box is not None:
        return box
    xs, ys = zip(*(p for r in rings(blob) for p in r), strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def _local(path: str) -> str:
    """A path as the file system knows it; SQLite opens no other stores."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path}: a GeoPackage needs a folder that driver and executors mount")
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Done(WriterCommitMessage):
    name: str
    rows: int


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.folder, self.layer = schema, _local(options["path"]), options.get("layer", "crops")
        self.bbox = [float(v) for v in options["bbox"].split(",")] if options.get("bbox") else None

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.folder):
            return [_File(self.folder)]
        with open(f"{self.folder}/{_MANIFEST}") as f:
            return [_File(f"{self.folder}/{name}") for name in json.load(f)["files"]]

    def read(self, partition: _File) -> Iterator[tuple]:
        names = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        where, args = "", ()
        if self.bbox:
            where = f' WHERE fid IN (SELECT id FROM "rtree_{self.layer}_geom" WHERE minx <= ? AND maxx >= ? AND miny <= ? AND maxy >= ?)'
            args = (self.bbox[2], self.bbox[0], self.bbox[3], self.bbox[1])
        con = sqlite3.connect(f"file:{partition.path}?mode=ro&immutable=1", uri=True)
        try:
            booleans = [i for i, f in enumerate(self.schema.fields) if isinstance(f.dataType, BooleanType)]
            for row in con.execute(f'SELECT {names} FROM "{self.layer}"{where}', args):
                yield tuple(bool(v) if i in booleans and v is not None else v for i, v in enumerate(row))
        finally:
            con.close()


class _Writer(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.folder, self.layer = schema, _local(options["path"]), options.get("layer", "crops")

    def write(self, iterator: Iterator) -> _Done:
        os.makedirs(self.folder, exist_ok=True)
        name = f"{uuid.uuid4().hex}.gpkg"
        con = sqlite3.connect(f"{self.folder}/{name}")
        kinds = lambda t: "BLOB" if isinstance(t, BinaryType) else "REAL" if isinstance(t, DoubleType) else "INTEGER" if isinstance(t, LongType | IntegerType | BooleanType) else "TEXT"
        columns = ", ".join(f'"{f.name}" {kinds(f.dataType)}' + (" PRIMARY KEY" if f.name == "fid" else "") for f in self.schema.fields)
        con.execute(f'CREATE TABLE "{self.layer}" ({columns})')
        con.execute(f'CREATE VIRTUAL TABLE "rtree_{self.layer}_geom" USING rtree(id, minx, maxx, miny, maxy)')
        con.executescript(_TABLES)
        con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', 3577, 0, 0)", (self.layer,))
        marks = ", ".join("?" * len(self.schema.fields))
        at = {f.name: i for i, f in enumerate(self.schema.fields)}
        n, extent = 0, None
        for row in iterator:
            values = [bytes(v) if isinstance(v, bytearray) else v for v in row]
            con.execute(f'INSERT INTO "{self.layer}" VALUES ({marks})', values)
            if "geom" in at and "fid" in at and values[at["geom"]] is not None:
                x0, y0, x1, y1 = envelope(values[at["geom"]])
                con.execute(f'INSERT INTO "rtree_{self.layer}_geom" VALUES (?, ?, ?, ?, ?)', (values[at["fid"]], x0, x1, y0, y1))
                extent = (x0, y0, x1, y1) if extent is None else (min(extent[0], x0), min(extent[1], y0), max(extent[2], x1), max(extent[3], y1))
            n += 1
        con.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, 'features', ?, ?, ?, ?, ?, 3577)", (self.layer, self.layer, *(extent or (None,) * 4)))
        con.commit()
        con.close()
        return _Done(name, n)

    def commit(self, messages: list) -> None:
        done = [m for m in messages if m is not None]
        with open(f"{self.folder}/{_MANIFEST}", "w") as f:
            json.dump({"files": sorted(m.name for m in done), "rows": sum(m.rows for m in done)}, f)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(f"{self.folder}/{m.name}"):
                os.remove(f"{self.folder}/{m.name}")


class GeoPackage(DataSource):
    """``spark.read.format("geopackage")`` with options path, layer and bbox (west,south,east,north), and the like writer."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> str:
        return "fid long, geom binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(schema, self.options)
