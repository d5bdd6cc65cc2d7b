"""Map extracts, GeoPackages, a database, and a matching service, each against what the test itself wrote or serves."""

import http.server
import json
import os
import sqlite3
import struct
import threading
import urllib.parse
import zlib

import pytest
from pyspark.sql import functions as F

from wayfault.operators import matching
from wayfault.operators.validation import ValidationError
from wayfault.sources import database, geopackage, match_service, osm_pbf, readers, sinks


# -- a writer of map extracts
def number(v):
    out = b""
    while v > 0x7F:
        out += bytes([v & 0x7F | 0x80])
        v >>= 7
    return out + bytes([v])


def zigzag(v):
    return (v << 1) ^ (v >> 63) if v >= 0 else ((-v) << 1) - 1


def item(n, value):
    return number(n << 3) + number(value) if isinstance(value, int) else number(n << 3 | 2) + number(len(value)) + value


def deltas(values):
    return b"".join(number(zigzag(b - a)) for a, b in zip([0, *values], values, strict=False))


def blob(kind, data, pack=True):
    body = item(2, len(data)) + item(3, zlib.compress(data)) if pack else item(1, data)
    head = item(1, kind) + item(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def strings(tags):
    table = [b"", *sorted({s.encode() for t in tags for kv in t.items() for s in kv})]
    return table, {s.decode(): i for i, s in enumerate(table)}


def node_block(nodes):
    table, at = strings([t for *_, t in nodes])
    listed = b"".join(b"".join(number(at[s]) for kv in t.items() for s in kv) + number(0) for *_, t in nodes)
    dense = item(1, deltas([n[0] for n in nodes])) + item(8, deltas([round(n[2] * 1e7) for n in nodes])) + item(9, deltas([round(n[1] * 1e7) for n in nodes])) + item(10, listed)
    return item(1, b"".join(item(1, s) for s in table)) + item(2, item(2, dense))


def way_block(ways):
    table, at = strings([t for *_, t in ways])
    group = b"".join(item(3, item(1, i) + item(2, b"".join(number(at[k]) for k in t)) + item(3, b"".join(number(at[v]) for v in t.values())) + item(8, deltas(refs))) for i, refs, t in ways)
    return item(1, b"".join(item(1, s) for s in table)) + item(2, group)


@pytest.fixture
def extract(tmp_path):
    nodes = [(10**10 + i, -73.5 + i / 1000, 42.0 - i / 500, {"highway": "crossing"} if i == 2 else {}) for i in range(40)]
    ids = [n[0] for n in nodes]
    ways = [
        (1, ids[:4], {"highway": "primary", "name": "Main", "oneway": "yes"}), (2, ids[3:6][::-1], {"highway": "residential", "oneway": "-1", "bridge": "yes"}), (3, ids[5:8], {"highway": "footway"}),
        (4, ids[7:9], {"highway": "service", "service": "parking_aisle"}), (5, [*ids[10:13], ids[10]], {"highway": "tertiary", "junction": "roundabout"}), (6, ids[20:30], {"waterway": "river"}), (7, ids[30:33], {"highway": "service"}),
    ]
    path = tmp_path / "x.osm.pbf"
    path.write_bytes(blob(b"OSMHeader", b"") + blob(b"OSMData", node_block(nodes[:25])) + blob(b"OSMData", node_block(nodes[25:]), False) + blob(b"OSMData", way_block(ways[:3])) + blob(b"OSMData", way_block(ways[3:])))
    return str(path), nodes, ways


def test_extract_is_read_whole(spark, extract):
    path, nodes, ways = extract
    got = {r.node_id: r for r in osm_pbf.read_nodes(spark, path).collect()}
    assert set(got) == {n[0] for n in nodes}
    assert all((got[i].x, got[i].y, got[i].tags) == (pytest.approx(x), pytest.approx(y), t) for i, x, y, t in nodes)
    assert {r.osmid: (r.node_ids, r.tags) for r in osm_pbf.read_ways(spark, "file://" + path).collect()} == {i: (refs, t) for i, refs, t in ways}


def test_driving_network(spark, extract):
    path, nodes, ways = extract
    roads, used = osm_pbf.driving_network(spark, path)
    got = {r.osmid: (r.node_ids, r.oneway, r.name, r.bridge) for r in roads.collect()}
    assert got == {1: (ways[0][1], True, "Main", None), 2: (ways[1][1][::-1], True, None, "yes"), 5: (ways[4][1], True, None, None), 7: (ways[6][1], False, None, None)}
    assert {r.node_id for r in used.collect()} == {n for i in (0, 1, 4, 6) for n in ways[i][1]}
    assert readers.base_edges(roads, used).count() == 3 + 2 + 3 + 4
    near, _ = osm_pbf.driving_network(spark, path, (-73.5, 41.9, -73.4985, 42.1))
    assert [r.osmid for r in near.collect()] == [1]


def test_geopackage(spark, tmp_path):
    path = f"{tmp_path}/x.gpkg"
    line = [(0.0, 1.0), (2.0, 3.5)]
    rows = spark.createDataFrame([(1, "a", 1.5, True, line, [1, 2]), (2, None, None, None, None, None), (3, 'q"', float(7), False, line[::-1], [])], "k long, name string, v double, flag boolean, line array<struct<x:double,y:double>>, l array<int>")
    roads = rows.withColumn("geometry", geopackage.line_geometry(F.col("line"))).drop("line")
    hole = [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)], [(1.0, 0.5), (2.0, 0.5), (2.0, 1.0), (1.0, 0.5)]], [[(9.0, 9.0), (10.0, 9.0), (9.0, 10.0), (9.0, 9.0)]]]
    parts = spark.createDataFrame([(hole,)], "p array<array<array<struct<x:double,y:double>>>>").select(F.lit(1).alias("id"), geopackage.polygon_geometry(F.col("p")).alias("geometry"))
    points = spark.range(5).select("id", geopackage.point_geometry(F.col("id"), F.col("id") + 1).alias("geometry"))
    geopackage.write({"roads": roads, "places": points, "plain": rows.select("k", "name")}, path, read_only=True)
    assert not os.stat(path).st_mode & 0o222
    geopackage.write({"regions": parts}, path, append=True)
    assert geopackage.layers(path) == {"places": "geometry", "plain": None, "regions": "geometry", "roads": "geometry"}
    got = sorted(geopackage.read(spark, path, "roads").collect(), key=lambda r: r.k)
    assert [(r.k, r.name, r.v, r.flag, r.l) for r in got] == [(1, "a", 1.5, True, "[1,2]"), (2, None, None, None, None), (3, 'q"', 7.0, False, "[]")]
    assert got[1].geometry is None and got[0].geometry.kind == "LINESTRING" and [tuple(p) for p in got[2].geometry.parts[0][0]] == line[::-1]
    (region,) = geopackage.read(spark, path, "regions").collect()
    assert region.geometry.kind == "MULTIPOLYGON" and [[[tuple(q) for q in r] for r in p] for p in region.geometry.parts] == hole
    assert sorted(r.geometry.parts[0][0][0].y for r in geopackage.read(spark, path, "places").collect()) == [1, 2, 3, 4, 5]
    with sqlite3.connect(path) as con:
        assert con.execute("SELECT min_x, max_y FROM gpkg_contents WHERE table_name = 'roads'").fetchone() == (0.0, 3.5)
    with pytest.raises(Exception, match="boom"):
        geopackage.write({"bad": spark.range(1).select(F.raise_error(F.lit("boom")).cast("string").alias("x"))}, f"{tmp_path}/y.gpkg")
    assert not os.path.exists(f"{tmp_path}/y.gpkg")


def test_geopackage_in_ranges(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/x.gpkg"
    geopackage.write({"n": spark.range(50).select("id")}, path)
    monkeypatch.setattr(geopackage, "ROWS_PER_TASK", 50)
    assert sorted(r.id for r in geopackage.read(spark, path, "n").collect()) == list(range(50))
    geopackage.write({"none": spark.range(0).select("id")}, path)
    assert geopackage.read(spark, path, "none").collect() == []


def test_read_only_layers(spark, tmp_path):
    sinks.write_layers({"a": spark.range(3)}, str(tmp_path), read_only=True)
    files = [os.path.join(d, f) for d, _, fs in os.walk(f"{tmp_path}/a") for f in fs if f.endswith(".parquet")]
    assert files and not any(os.stat(f).st_mode & 0o222 for f in files)
    sinks.write_layers({"a": spark.range(2)}, str(tmp_path), mode="append")
    assert sinks.read_layer(spark, str(tmp_path), "a").count() == 5


# -- a database
def redundancy_tables(spark, detour_of=(1, 2, 0)):
    roads = spark.createDataFrame([(1, 2, 0, [(0.0, 0.0), (1.0, 0.5)]), (2, 3, 0, None)], "u long, v long, key long, geometry array<struct<x:double,y:double>>")
    detours = spark.createDataFrame([(*detour_of, 12.5)], "u long, v long, key long, difference_sec double")
    paths = spark.createDataFrame([(*detour_of, 0, 2, 3, 0)], "u long, v long, key long, path_edge_index int, path_u long, path_v long, path_key long")
    return {"roadways": roads, "detours_info": detours, "base_paths": paths, "detour_paths": paths}


def test_database(spark, tmp_path):
    url, props = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    for _ in range(2):  # the second load replaces the first
        database.load(spark, redundancy_tables(spark), url, "APP", props)
    read = lambda name: spark.read.jdbc(url, f'"APP"."{name}"', properties=props)
    assert {(r.u, r.geometry) for r in read("roadways").collect()} == {(1, "LINESTRING (0.0 0.0, 1.0 0.5)"), (2, None)}
    assert read("base_paths").count() == read("detours_info").count() == 1
    with pytest.raises(ValidationError, match="parent"):
        database.load(spark, redundancy_tables(spark, (5, 6, 0)), url, "APP", props)
    con = spark._jvm.java.sql.DriverManager.getConnection(url)
    with pytest.raises(Exception, match="(?i)duplicate|constraint"):
        con.createStatement().executeUpdate('INSERT INTO "APP"."detours_info" VALUES (1, 2, 0, 1.0)')
    with pytest.raises(Exception, match="(?i)constraint"):
        con.createStatement().executeUpdate('INSERT INTO "APP"."detours_info" VALUES (7, 8, 0, 1.0)')
    con.close()


def test_a_failed_load_leaves_the_former_tables(spark, tmp_path):
    url, props = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    database.load(spark, redundancy_tables(spark), url, "APP", props)
    with pytest.raises(Exception):  # noqa: B017 there is no staged table, so the transaction fails after it dropped the former ones
        database.run(spark, url, "APP", database.REDUNDANCY, props)
    assert spark.read.jdbc(url, '"APP"."roadways"', properties=props).count() == 2


def test_statements_for_a_database_that_clusters():
    made = database.statements(database.REDUNDANCY, "s", "postgresql")
    assert made[0] == 'DROP TABLE IF EXISTS "s"."detour_paths"' and made[-1] == 'CLUSTER "s"."detour_paths" USING "detour_paths_pk"'
    assert sum("FOREIGN KEY" in x for x in made) == 5 and sum("PRIMARY KEY" in x for x in made) == 4


# -- a matching service
class Service(http.server.BaseHTTPRequestHandler):
    seen: list = []

    def do_GET(self):
        at = urllib.parse.urlsplit(self.path)
        Service.seen.append(self.path)
        points = [[float(v) for v in p.split(",")] for p in at.path.split("/")[-1].split(";")]
        if points[0][0] > 50:
            body, status = b"<html>busy</html>", 503
        elif points[0][0] > 10:
            body, status = json.dumps({"code": "NoMatch", "message": "nothing near"}).encode(), 400
        else:
            body = json.dumps({"code": "Ok", "tracepoints": [{"location": p, "distance": 0.5, "matchings_index": 0, "waypoint_index": i} for i, p in enumerate(points)], "matchings": [{"confidence": 0.9, "legs": []}]}).encode()
            status = 200
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_matching_service(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = spark.createDataFrame([(1, [(1.0, 2.0), (1.123456789, 2.5)]), (2, [(20.0, 2.0), (21.0, 2.0)]), (3, [(1.0, 1.0)]), (4, None), (5, [(60.0, 2.0), (61.0, 2.0)])], "trace_id long, line array<struct<x:double,y:double>>")
    got = match_service.responses(rows, f"http://127.0.0.1:{server.server_port}/", timeout=20).cache()
    points, _, matchings, errors = matching.parse_responses(got)
    assert [(r.trace_id, r.idx, r.x, r.y) for r in points.orderBy("idx").collect()] == [(1, 0, 1.0, 2.0), (1, 1, 1.1234568, 2.5)]
    assert {(r.trace_id, r.code) for r in errors.collect()} == {(2, "NoMatch"), (5, "HttpError")} and matchings.count() == 1
    assert "/match/v1/driving/1.0000000,2.0000000;1.1234568,2.5000000?geometries=geojson&annotations=true&overview=full" in Service.seen
    server.shutdown()
    dead = match_service.responses(rows.where("trace_id = 1"), f"http://127.0.0.1:{server.server_port}/", timeout=2)
    server.server_close()
    assert json.loads(dead.first().body)["code"] == "NoAnswer"
