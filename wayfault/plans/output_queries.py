"""Queries on simplification, fusion, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfault.functions import geometry as G
from wayfault.operators import flood as W
from wayfault.operators import fusion as U
from wayfault.operators import simplify as N
from wayfault.operators import tables as B
from wayfault.operators import validation as V
from wayfault.operators.spatial_join import polygon_literal
from wayfault.plans import matching_queries as M
from wayfault.plans import network_queries as Q
from wayfault.plans.registry import adapter, query
from wayfault.sources import readers as R
from wayfault.sources import sinks as K

# -- a subdivided network: each edge of the mesh becomes a chain of one to four base edges
adapter(
    "base_edges",
    """SELECT CASE WHEN i = 0 THEN u ELSE u * 100000 + v * 100 + i + 1000 END AS u, CASE WHEN i = n - 1 THEN v ELSE u * 100000 + v * 100 + i + 1001 END AS v, key, u * 1000 + v * 10 + CAST(floor(i / 2) AS BIGINT) AS osmid,
       CAST(10 * (i + 1) AS DOUBLE) AS length, CASE WHEN i = 1 THEN 'yes' ELSE NULL END AS bridge, CAST(NULL AS STRING) AS tunnel, concat('R', CAST(u % 5 AS STRING)) AS ref, CAST(NULL AS STRING) AS name
       FROM (SELECT u, v, key, 1 + (u + v) % 4 AS n FROM mesh) JOIN (SELECT CAST(r_regionkey AS BIGINT) AS i FROM region) ON i < n""",
)


def base_nodes(t):
    n = t.base_edges.select(F.col("u").alias("node_id")).union(t.base_edges.select("v")).distinct()
    return n.select("node_id", (F.col("node_id") % 977).cast("double").alias("x"), (F.col("node_id") % 991).cast("double").alias("y"))


def simple(t):
    return N.simplify(t.base_edges, base_nodes(t))


@query("n1_simplify")
def simplify(t):
    return simple(t).select("u", "v", "key", "length", F.size("merged_edges").alias("n"), F.array_join("osmid", ",").alias("osmids"))


@query("n1_total_length", "SELECT sum(length) AS length, count(*) AS n FROM base_edges")
def total_length(t):
    return simple(t).agg(F.sum("length").alias("length"), F.sum(F.size("merged_edges")).alias("n"))


#: Edges with planted faults, by the remainder of u.
@query(
    "n2_alignment",
    """SELECT u, v, key, problem FROM edges JOIN (VALUES (1, 'no base edges'), (1, 'number of vertices'), (1, 'vertex is not at its node'), (2, 'ends differ'), (2, 'vertex is not at its node'), (3, 'broken chain'), (4, 'number of vertices')) f(kind, problem) ON u % 5 = kind""",
)
def alignment(t):
    e = t.edges.select("u", "v", "key", (F.col("u") % 5).alias("kind"))
    pair = lambda a, b: F.struct(a.cast("long").alias("u"), b.cast("long").alias("v"))
    u, v, far = F.col("u"), F.col("v"), F.lit(10**9)
    at = lambda n: F.struct((n % 977).cast("double").alias("x"), (n + 0.5).cast("double").alias("y"))
    chain = F.when(F.col("kind") == 1, F.array().cast("array<struct<u:bigint,v:bigint>>")).when(F.col("kind") == 2, F.array(pair(v, u))).when(F.col("kind") == 3, F.array(pair(u, far), pair(far + 1, v))).otherwise(F.array(pair(u, v)))
    line = F.when(F.col("kind") == 3, F.array(at(u), at(far), at(v))).when(F.col("kind") == 4, F.array(at(u), at(v), at(v))).otherwise(F.array(at(u), at(v)))
    nodes = e.select(u.alias("node_id")).union(e.select("v")).union(t.spark.range(10**9, 10**9 + 1)).distinct().select("node_id", at(F.col("node_id")).alias("p")).select("node_id", "p.x", "p.y")
    return N.alignment_violations(e.select("u", "v", "key", chain.alias("merged_edges"), line.alias("geometry")), nodes)


# -- ways of one to four base edges, two to a way; beside every fifth pair a bridge of another way
adapter("chain_items", "SELECT u, v, key, i, 1 + (u + v) % 4 AS n, u * 1000 + v * 10 + CAST(floor(i / 2) AS BIGINT) AS osmid FROM mesh JOIN (SELECT CAST(r_regionkey AS BIGINT) AS i FROM region) ON i < 1 + (u + v) % 4")
WAY_TAGS = """CASE osmid % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'No' WHEN 2 THEN 'no' WHEN 3 THEN 'Viaduct' ELSE NULL END AS bridge, CASE osmid % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'culvert' ELSE NULL END AS tunnel"""
adapter(
    "way_items",
    f"""SELECT u, v, key, i, n, u * 100000 + v * 100 + i AS mu, u * 100000 + v * 100 + i + 1 AS mv, osmid, {WAY_TAGS} FROM chain_items
UNION ALL SELECT u, v, key, i, n, u * 100000 + v * 100 + i, u * 100000 + v * 100 + i + 1, osmid + 100000000, 'yes', NULL FROM chain_items WHERE osmid % 5 = 4 AND i = 1""",
)


@query(
    "n3_way_slices",
    """WITH b AS (SELECT u, v, key, i, n, mu, mv, arg_max(osmid, CASE WHEN lower(bridge) <> 'no' THEN 1 ELSE 0 END) AS osmid, max(CASE WHEN lower(bridge) <> 'no' THEN bridge END) AS bridge,
 arg_max(CASE WHEN lower(tunnel) = 'yes' THEN 'yes' ELSE '' END, CASE WHEN lower(bridge) <> 'no' THEN 1 ELSE 0 END) AS tunnel FROM way_items GROUP BY u, v, key, i, n, mu, mv),
r AS (SELECT *, sum(CASE WHEN osmid = p THEN 0 ELSE 1 END) OVER (PARTITION BY u, v, key ORDER BY i) AS run FROM (SELECT *, lag(osmid) OVER (PARTITION BY u, v, key ORDER BY i) AS p FROM b))
SELECT u, v, key, osmid, CAST(min(i) AS INT) AS start_coord_idx, CAST(max(i) + 1 AS INT) AS end_coord_idx, round(min(i) / n, 9) AS start_ratio, round((max(i) + 1) / n, 9) AS end_ratio, any_value(bridge) AS bridge_tag, nullif(any_value(tunnel), '') AS tunnel_tag,
 string_agg('' || mu, ',' ORDER BY i) || ',' || max(mv) AS osm_nodes FROM r GROUP BY u, v, key, osmid, run, n""",
)
def way_slices(t):
    rows = t.way_items
    pair = F.struct("i", F.col("mu").alias("u"), F.col("mv").alias("v"))
    edges = rows.groupBy("u", "v", "key").agg(F.array_sort(F.collect_set(pair)).alias("c"), F.collect_set("osmid").alias("osmid"), F.max("n").cast("double").alias("length"))
    geometry = F.transform(F.sequence(F.lit(0), F.col("length").cast("int")), lambda i: G.point(i, F.lit(0)))
    edges = edges.select("u", "v", "key", "osmid", (F.col("length") * 10).alias("length"), F.transform("c", lambda p: F.struct(p["u"].alias("u"), p["v"].alias("v"))).alias("merged_edges"), geometry.alias("geometry"))
    base = rows.select(F.col("mu").alias("u"), F.col("mv").alias("v"), "osmid", F.lit(10.0).alias("length"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("string").alias("name"), "bridge", "tunnel")
    s = N.way_slices(edges, base).select("u", "v", "key", F.explode("way_along").alias("w"))
    return s.select("u", "v", "key", "w.osmid", "w.start_coord_idx", "w.end_coord_idx", F.round("w.start_ratio_along", 9).alias("start_ratio"), F.round("w.end_ratio_along", 9).alias("end_ratio"), "w.bridge_tag", "w.tunnel_tag", F.array_join("w.osm_nodes", ",").alias("osm_nodes"))


@query("n9_base_edges_of_edges", "SELECT u, v, CAST(key AS BIGINT) AS key FROM base_edges")
def exploded(t):
    rows = simple(t).select(F.explode("merged_edges").alias("m"))
    return rows.select("m.u", "m.v", F.lit(0).cast("long").alias("key"))


# -- ways, extracts
adapter("road_ways", "SELECT l_orderkey AS osmid, CASE l_orderkey % 6 WHEN 0 THEN 'motorway' WHEN 1 THEN 'residential' WHEN 2 THEN 'footway' WHEN 3 THEN 'tertiary_link' WHEN 4 THEN 'unclassified' ELSE 'service' END AS highway, l_orderkey % 4 = 0 AS oneway, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS pos, l_partkey AS node FROM lineitem")
adapter("road_nodes", "SELECT p_partkey AS node_id, CAST(p_partkey % 97 AS DOUBLE) / 10 AS x, CAST(p_partkey % 89 AS DOUBLE) / 10 AS y FROM part")


def ways(t):
    return t.road_ways.groupBy("osmid", "highway", "oneway").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("l")).select("osmid", "highway", "oneway", F.col("l.node").alias("node_ids"))


PAIRS = """p AS (SELECT osmid, highway, oneway, node AS u, lead(node) OVER (PARTITION BY osmid ORDER BY pos) AS v FROM road_ways), d AS (SELECT osmid, highway, u, v FROM p WHERE v IS NOT NULL UNION ALL SELECT osmid, highway, v, u FROM p WHERE v IS NOT NULL AND NOT oneway)"""


@query("s1_base_edges", f"WITH {PAIRS} SELECT osmid, highway, d.u, d.v, round({M.HAV.format(x1='a.x', y1='a.y', x2='b.x', y2='b.y')}, 3) AS length FROM d JOIN road_nodes a ON d.u = a.node_id JOIN road_nodes b ON d.v = b.node_id")
def base(t):
    return R.base_edges(ways(t), t.road_nodes).select("osmid", "highway", "u", "v", F.round("length", 3).alias("length"))


INSIDE = "x BETWEEN 2 AND 6 AND y BETWEEN 3 AND 5"
KEPT = f"hit AS (SELECT DISTINCT osmid FROM road_ways JOIN (SELECT node_id FROM road_nodes WHERE {INSIDE}) ON node = node_id), kept AS (SELECT * FROM road_ways WHERE osmid IN (SELECT osmid FROM hit) AND highway IN ('motorway', 'residential', 'tertiary_link', 'unclassified'))"
BOX = [[(2, 3), (6, 3), (6, 5), (2, 5), (2, 3)]]


@query("k11_extract_ways", f"WITH {KEPT} SELECT osmid, highway, CAST(count(*) AS INT) AS n FROM kept GROUP BY osmid, highway")
def extract_ways(t):
    return R.extract(ways(t), t.road_nodes, polygon_literal(BOX))[0].select("osmid", "highway", F.size("node_ids").alias("n"))


@query("k11_extract_nodes", f"WITH {KEPT} SELECT node_id, x, y FROM road_nodes WHERE node_id IN (SELECT node FROM kept)")
def extract_nodes(t):
    return R.extract(ways(t), t.road_nodes, polygon_literal(BOX))[1]


@query("s4_floodplains", "SELECT box_id, CASE WHEN box_id % 2 = 0 THEN 4 ELSE 11 END AS flood_risk_level FROM boxes WHERE x0 <= 500 AND x1 >= 100 AND y0 <= 400 AND y1 >= 50")
def floodplains(t):
    rows = Q.boxes(t).withColumn("fld_zone", F.when(F.col("box_id") % 2 == 0, "V").otherwise("AE")).withColumn("zone_subty", F.lit(None).cast("string"))
    return R.floodplains(rows, (100, 50, 500, 400)).select("box_id", "flood_risk_level")


@query("s8_inventory", "SELECT event_route_id, from_measure, to_measure, code FROM lrs_events WHERE to_date IS NULL AND event_route_id % 62 + 1 = 3 AND from_measure >= 20")
def inventory(t):
    rows = t.lrs_events.withColumn("county", F.col("event_route_id") % 62 + 1)
    return R.inventory(rows, "36005", ("from_measure >= 20",)).select("event_route_id", "from_measure", "to_measure", "code")


@query("s9_event_table", "SELECT code, count(*) AS n FROM lrs_events GROUP BY code")
def event_table(t):
    return t.lrs_events.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("s15_cached_table", "SELECT u, v, key, travel_time FROM edges")
def cached(t):
    from wayfault.operators.scratch import shared_folder

    key = R.content_key("edges", *map(str, V.fingerprint(t.edges, ["u", "v", "key", "travel_time"]).first()))
    R.cached(t.spark, f"{shared_folder(t.spark)}/wayfault-cache", key, lambda: t.edges.select("u", "v", "key", "travel_time"))
    return R.cached(t.spark, f"{shared_folder(t.spark)}/wayfault-cache", key, lambda: t.edges.limit(0))


@query("s11_layer_read_back", "SELECT u, v, key FROM edges")
def layer(t):
    import uuid

    from wayfault.operators.scratch import shared_folder

    folder = f"{shared_folder(t.spark)}/wayfault-layers-{uuid.uuid4().hex}"
    K.write_layers({"roadways": t.edges.select("u", "v", "key")}, folder)
    return K.read_layer(t.spark, folder, "roadways")


# -- fusion
PARTS = """red AS (SELECT u, v, key, travel_time % 1000 AS difference_sec FROM edges WHERE u % 3 = 0), flo AS (SELECT u, v, key, CASE WHEN v % 2 = 0 THEN 'FLOODED' ELSE 'NOT_IMPACTED' END AS nonfunctional_reason, CASE WHEN v % 4 = 0 THEN '100 YEAR' END AS nonfunctional_frequency FROM edges),
ev AS (SELECT u, v, key, u % 4 AS all_incidents_count FROM edges WHERE v % 3 = 1), fused AS (SELECT e.u, e.v, e.key, e.length, r.difference_sec AS redundancy_difference_sec, f.nonfunctional_reason AS flood_nonfunctional_reason, f.nonfunctional_frequency AS flood_nonfunctional_frequency,
ev.all_incidents_count AS events_all_incidents_count FROM edges e LEFT JOIN red r USING (u, v, key) LEFT JOIN flo f USING (u, v, key) LEFT JOIN ev USING (u, v, key))"""


def fused(t):
    e = t.edges.select("u", "v", "key", "length")
    red = t.edges.where("u % 3 = 0").select("u", "v", "key", (F.col("travel_time") % 1000).alias("difference_sec"))
    flo = t.edges.select("u", "v", "key", F.when(F.col("v") % 2 == 0, "FLOODED").otherwise("NOT_IMPACTED").alias("nonfunctional_reason"), F.when(F.col("v") % 4 == 0, "100 YEAR").alias("nonfunctional_frequency"))
    ev = t.edges.where("v % 3 = 1").select("u", "v", "key", (F.col("u") % 4).alias("all_incidents_count"))
    return U.fuse(e, {"redundancy": red, "flood": flo, "events": ev})


@query("j17_fused", f"WITH {PARTS} SELECT * FROM fused")
def fused_query(t):
    return fused(t)


@query("k6_fused_numbered", f"WITH {PARTS} SELECT row_number() OVER (ORDER BY u, v, key) AS _id_, * FROM fused")
def numbered(t):
    return U.numbered(fused(t))


@query("k7_simplified", f"WITH {PARTS} SELECT u, v, key, CAST(NULL AS VARCHAR) AS openlr_roadclass, redundancy_difference_sec AS redundancy_detour_seconds_diff, CAST(NULL AS VARCHAR) AS road_network_edge_betweenness_centrality, events_all_incidents_count AS flood_related_events_count, CASE WHEN flood_nonfunctional_reason = 'FLOODED' THEN flood_nonfunctional_frequency END AS flooding_vulnerability_frequency FROM fused")
def simplified(t):
    return U.simplified(fused(t))


@query("k6_csv_lines", f"""WITH {PARTS} SELECT u || ',' || v || ',' || key || ',' || coalesce('' || redundancy_difference_sec, '') || ',' || '"' || flood_nonfunctional_reason || '"' AS value FROM fused""")
def csv(t):
    return K.csv_lines(fused(t).select("u", "v", "key", "redundancy_difference_sec", "flood_nonfunctional_reason"))


@query("j18_geometry_join", "SELECT e.u, e.v, e.key, e.length, n.travel_time FROM edges e JOIN edges n USING (u, v, key)")
def geometry_join(t):
    return B.with_columns_of(t.edges.select("u", "v", "key", "length"), t.edges, ["travel_time"])


@query("j5_path_lookup", "SELECT pos, u, v, travel_time FROM (SELECT row_number() OVER (ORDER BY u, v) - 1 AS pos, u, v, travel_time FROM edges)")
def path_lookup(t):
    from wayfault.operators.paths import path_geometries, path_table

    ids = t.edges.agg(F.array_sort(F.collect_list(F.struct("u", "v", "key"))).alias("base_path_edge_ids"))
    info = ids.select(F.lit(0).alias("u"), F.lit(0).alias("v"), F.lit(0).alias("key"), "base_path_edge_ids")
    got = path_geometries(path_table(info, "base"), t.edges.select("u", "v", "key", "travel_time"))
    return got.select(F.col("path_edge_index").cast("long").alias("pos"), F.col("path_u").alias("u"), F.col("path_v").alias("v"), "travel_time")


@query("k9_origin_geometries", "SELECT u, v, key, x FROM edges JOIN (SELECT DISTINCT u AS node_id, CAST(u % 977 AS DOUBLE) AS x FROM edges) ON u = node_id")
def origin_geometries(t):
    d = t.edges.select("u", "v", "key", F.col("u").alias("origin"), F.col("v").alias("destination"))
    nodes = t.edges.select(F.col("u").alias("node_id")).union(t.edges.select("v")).distinct().select("node_id", (F.col("node_id") % 977).cast("double").alias("x"), F.lit(0.0).alias("y"))
    paths = d.select("u", "v", "key", F.lit(0).alias("path_edge_index"), F.col("u").alias("path_u"), F.col("v").alias("path_v"), F.col("key").alias("path_key"))
    K.views(t.spark, t.edges, d, paths, paths, nodes)
    return t.spark.sql("SELECT u, v, key, point.x AS x FROM origin_geoms")


@query("k10_polygon_filter", "SELECT count(*) * 7 + 2 AS n FROM boxes")
def polygon_filter(t):
    return K.polygon_filter_lines(Q.boxes(t)).agg(F.count(F.lit(1)).alias("n"))


@query("k13_data_dictionary", "SELECT 'u' AS \"column\", 'bigint' AS type, 'start node' AS description UNION ALL SELECT 'v', 'bigint', '' UNION ALL SELECT 'key', 'bigint', ''")
def dictionary(t):
    return K.data_dictionary(K.described(t.edges.select("u", "v", "key"), {"u": "start node"}))


@query("g5_point_line_distance", "SELECT event_id, round(least(sqrt(x * x + y * y), CASE WHEN x BETWEEN 0 AND 500 THEN y ELSE sqrt(pow(x - 500, 2) + y * y) END), 6) AS metres FROM event_points")
def point_line(t):
    line = F.array(G.point(F.lit(0), F.lit(0)), G.point(F.lit(500), F.lit(0)))
    return t.event_points.select("event_id", F.round(G.distance(F.col("x"), F.col("y"), line), 6).alias("metres"))


@query("v5_flood_zones", "SELECT count(*) AS n FROM zones WHERE fld_zone = 'AO'")
def zones(t):
    rows = t.zones.where("fld_zone = 'AO'").withColumn("zone_subty", F.lit(None).cast("string"))
    return W.require_ranks(rows).where("flood_risk_level = 10").agg(F.count(F.lit(1)).alias("n"))
