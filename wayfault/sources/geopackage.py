"""GeoPackage layers in and out (SQLite files with geometries as well-known binary).

Reading: ranges of row ids are dealt over the tasks, each of which opens the file read-only; the file must be on a path that all executors see.
Writing: a GeoPackage is one file, so rows pass through the driver a batch at a time; it is an export of results, not a table format to work on.

A geometry is a struct ``kind`` (POINT, LINESTRING, POLYGON, MULTI…) and ``parts``: for points and lines one list of points each, in one ring; for polygons their rings.
"""

from __future__ import annotations

import os
import sqlite3
import stat
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON"}
CODES = {k: n for n, k in KINDS.items()}
POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
GEOMETRY = pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.list_(POINTS)))])
SPARK_GEOMETRY = "struct<kind:string,parts:array<array<array<struct<x:double,y:double>>>>>"
BATCH = 2000
ROWS_PER_TASK = 100_000
Parts = list[list[list[tuple[float, float]]]]


# -- well-known binary
def read_wkb(data: bytes, at: int = 0) -> tuple[str, Parts, int]:
    """Kind and parts of a geometry, and where it ends; heights and measures are left out."""
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    high = code & 0x80000000, code & 0x40000000
    if code & 0x20000000:
        at += 4
    code &= 0x0FFFFFFF
    width = 2 + (bool(high[0]) or code // 1000 in (1, 3)) + (bool(high[1]) or code // 1000 in (2, 3))
    kind = KINDS[code % 1000]

    def points(n: int, at: int) -> tuple[list[tuple[float, float]], int]:
        v = struct.unpack_from(f"{order}{n * width}d", data, at)
        return list(zip(v[::width], v[1::width], strict=True)), at + 8 * n * width

    def count(at: int) -> tuple[int, int]:
        return struct.unpack_from(order + "I", data, at)[0], at + 4

    if kind == "POINT":
        p, at = points(1, at)
        return kind, [] if p[0][0] != p[0][0] else [[p]], at
    if kind == "LINESTRING":
        n, at = count(at)
        p, at = points(n, at)
        return kind, [[p]] if n else [], at
    if kind == "POLYGON":
        rings, (n, at) = [], count(at)
        for _ in range(n):
            m, at = count(at)
            p, at = points(m, at)
            rings.append(p)
        return kind, [rings] if rings else [], at
    parts, (n, at) = [], count(at)
    for _ in range(n):
        _, inner, at = read_wkb(data, at)
        parts += inner
    return kind, parts, at


def write_wkb(kind: str, parts: Parts) -> bytes:
    flat = lambda p: struct.pack(f"<{2 * len(p)}d", *[c for q in p for c in q])
    head = struct.pack("<BI", 1, CODES[kind])
    if kind == "POINT":
        return head + (flat(parts[0][0]) if parts else struct.pack("<2d", float("nan"), float("nan")))
    if kind == "LINESTRING":
        p = parts[0][0] if parts else []
        return head + struct.pack("<I", len(p)) + flat(p)
    if kind == "POLYGON":
        rings = parts[0] if parts else []
        return head + struct.pack("<I", len(rings)) + b"".join(struct.pack("<I", len(r)) + flat(r) for r in rings)
    return head + struct.pack("<I", len(parts)) + b"".join(write_wkb(kind[5:], [p]) for p in parts)


def from_blob(blob: bytes | None) -> tuple[str, Parts] | None:
    """A geometry of the package's own header and well-known binary."""
    if blob is None:
        return None
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    envelope = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
    kind, parts, _ = read_wkb(blob, 8 + envelope)
    return kind, parts


def to_blob(kind: str, parts: Parts, srs: int) -> bytes:
    return b"GP\x00" + struct.pack("<Bi", 1 | (0 if parts else 16), srs) + write_wkb(kind, parts)


# -- reading
def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro&immutable=1", uri=True)


def layers(path: str) -> dict[str, str | None]:
    """Tables of the package and their geometry columns."""
    with _connect(path) as con:
        tables = [r[0] for r in con.execute("SELECT table_name FROM gpkg_contents ORDER BY table_name")]
        geometry = dict(con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns")) if con.execute("SELECT 1 FROM sqlite_master WHERE name = 'gpkg_geometry_columns'").fetchone() else {}
    return {t: geometry.get(t) for t in tables}


def _arrow_type(declared: str) -> pa.DataType:
    d = declared.upper()
    if d.startswith(("INT", "BIGINT", "MEDIUMINT", "SMALLINT", "TINYINT")):
        return pa.int64()
    if d.startswith(("REAL", "DOUBLE", "FLOAT", "NUMERIC", "DECIMAL")):
        return pa.float64()
    if d.startswith("BOOL"):
        return pa.bool_()
    return pa.binary() if d.startswith("BLOB") else pa.string()


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def read(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """A layer with its attributes, and its geometry under the geometry column's name."""
    from pyspark.sql.pandas.types import from_arrow_type

    geometry = layers(path)[layer]
    with _connect(path) as con:
        columns = [(r[1], r[2]) for r in con.execute(f"PRAGMA table_info({quoted(layer)})")]
        low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(layer)}").fetchone()
    types = {c: GEOMETRY if c == geometry else _arrow_type(t) for c, t in columns}
    schema = T.StructType([T.StructField(c, T._parse_datatype_string(SPARK_GEOMETRY) if c == geometry else from_arrow_type(t)) for c, t in types.items()])
    starts = list(range(low, high + 1, ROWS_PER_TASK)) if low is not None else []
    ranges = spark.createDataFrame([(s,) for s in starts], "start long").repartitionByRange(max(1, len(starts)), "start")
    listed = ", ".join(map(quoted, types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in batch.column(0).to_pylist():
                con = _connect(path)
                rows = con.execute(f"SELECT {listed} FROM {quoted(layer)} WHERE rowid BETWEEN ? AND ? ORDER BY rowid", (start, start + ROWS_PER_TASK - 1))
                while part := rows.fetchmany(BATCH):
                    made = []
                    for (name, kind), values in zip(types.items(), zip(*part, strict=True), strict=True):
                        if name == geometry:
                            shapes = [from_blob(v) for v in values]
                            made.append(pa.array([None if s is None else {"kind": s[0], "parts": [[[{"x": x, "y": y} for x, y in r] for r in p] for p in s[1]]} for s in shapes], GEOMETRY))
                        elif pa.types.is_boolean(kind):
                            made.append(pa.array([None if v is None else bool(v) for v in values], kind))
                        elif pa.types.is_string(kind):
                            made.append(pa.array([None if v is None else str(v) for v in values], kind))
                        else:
                            made.append(pa.array(values, kind))
                    yield pa.RecordBatch.from_arrays(made, list(types))
                con.close()

    return ranges.mapInArrow(run, schema)


# -- writing
def line_geometry(line: Column) -> Column:
    return F.when(line.isNotNull(), F.struct(F.lit("LINESTRING").alias("kind"), F.array(F.array(line)).alias("parts")))


def point_geometry(x: Column, y: Column) -> Column:
    at = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(F.lit("POINT").alias("kind"), F.array(F.array(F.array(at))).alias("parts")))


def polygon_geometry(parts: Column) -> Column:
    """Of an array of polygons."""
    return F.when(parts.isNotNull(), F.struct(F.lit("MULTIPOLYGON").alias("kind"), parts.alias("parts")))


def _declared(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "BOOLEAN"
    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return "INTEGER"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "DOUBLE"
    return "BLOB" if isinstance(kind, T.BinaryType) else "TEXT"


SETUP = """
CREATE TABLE IF NOT EXISTS gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES ('Undefined Cartesian', -1, 'NONE', -1, 'undefined', NULL), ('Undefined geographic', 0, 'NONE', 0, 'undefined', NULL),
 ('WGS 84', 4326, 'EPSG', 4326, 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]', NULL);
CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT NOT NULL PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')),
 min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
"""


def write(tables: dict[str, DataFrame], path: str, geometry: str = "geometry", srs: int = 4326, append: bool = False, read_only: bool = False) -> None:
    """Tables as layers of one file, in one transaction; a failure leaves the file as it was (with ``append``) or none.

    ``geometry`` names a column as made by ``line_geometry`` and its like; lists and structs of other columns become JSON.
    """
    path = path.removeprefix("file://")
    if not append and os.path.exists(path):
        os.remove(path)
    elif append and os.path.exists(path):
        os.chmod(path, os.stat(path).st_mode | stat.S_IWUSR)
    con, done = sqlite3.connect(path, isolation_level=None), False
    try:
        con.execute("PRAGMA application_id = 1196444487")
        con.execute("PRAGMA user_version = 10300")
        con.execute("BEGIN")
        for statement in SETUP.strip().split(";\n"):
            con.execute(statement.rstrip(";"))
        for name, df in tables.items():
            _write_layer(con, name, df, geometry, srs)
        con.execute("COMMIT")
        done = True
    finally:
        if not done and con.in_transaction:
            con.execute("ROLLBACK")
        con.close()
        if not done and not append:
            os.remove(path)
    if read_only:
        os.chmod(path, stat.S_IRUSR | stat.S_IRGRP | stat.S_IROTH)


def _write_layer(con: sqlite3.Connection, name: str, df: DataFrame, geometry: str, srs: int) -> None:
    spatial = geometry in df.columns
    con.execute("DELETE FROM gpkg_contents WHERE table_name = ?", (name,))
    con.execute("DELETE FROM gpkg_geometry_columns WHERE table_name = ?", (name,))
    con.execute(f"DROP TABLE IF EXISTS {quoted(name)}")
    plain = [f for f in df.schema.fields if f.name != geometry]
    nested = (T.ArrayType, T.StructType, T.MapType)
    rows = df.select(*[(F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`").cast("double") if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`").cast("string") if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.col(f"`{f.name}`")).alias(f.name) for f in plain], *([F.col(geometry)] if spatial else []))
    fid = "fid" if "fid" not in {f.name.lower() for f in plain} else "gpkg_fid"
    columns = [f"{quoted(fid)} INTEGER PRIMARY KEY AUTOINCREMENT", *[f"{quoted(f.name)} {_declared(f.dataType)}" for f in plain], *([f"{quoted(geometry)} GEOMETRY"] if spatial else [])]
    con.execute(f"CREATE TABLE {quoted(name)} ({', '.join(columns)})")
    insert = f"INSERT INTO {quoted(name)} ({', '.join(quoted(c) for c in rows.columns)}) VALUES ({', '.join('?' * len(rows.columns))})"
    box, held = [float("inf"), float("inf"), float("-inf"), float("-inf")], []
    for r in rows.toLocalIterator(prefetchPartitions=True):
        values = list(r)
        if spatial and values[-1] is not None:
            kind, parts = values[-1]["kind"], [[[(q["x"], q["y"]) for q in ring] for ring in part] for part in values[-1]["parts"]]
            for x, y in (q for part in parts for ring in part for q in ring):
                box = [min(box[0], x), min(box[1], y), max(box[2], x), max(box[3], y)]
            values[-1] = to_blob(kind, parts, srs)
        held.append(values)
        if len(held) >= BATCH:
            con.executemany(insert, held)
            held = []
    con.executemany(insert, held)
    known = box if box[0] <= box[2] else [None] * 4
    con.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, ?, ?, ?, ?, ?, ?, ?)", (name, "features" if spatial else "attributes", name, *known, srs))
    if spatial:
        con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, ?, 'GEOMETRY', ?, 0, 0)", (name, geometry, srs))
