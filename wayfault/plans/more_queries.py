"""Queries that show the operators that the others only use on their way."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayfault.functions import exact_geometry as X
from wayfault.functions import geometry as G
from wayfault.operators import linear_reference as L
from wayfault.operators import matching as M
from wayfault.operators import spatial_join as J
from wayfault.operators import tables as B
from wayfault.operators import validation as V
from wayfault.operators.scratch import shared_folder
from wayfault.plans import events_queries as E
from wayfault.plans import lrs_queries as R
from wayfault.plans import matching_queries as T
from wayfault.plans import network_queries as Q
from wayfault.plans.registry import query
from wayfault.sources import sinks as K


def folder(t, what: str) -> str:
    return f"{shared_folder(t.spark)}/wayfault-{what}-{uuid.uuid4().hex}"


@query("s7_clipped_events", "SELECT event_id FROM event_points WHERE x > 200 AND x < 300 AND y > 100 AND y < 500")
def clipped_events(t):
    return J.clip(t.event_points, J.polygon_literal([[(200, 100), (300, 100), (300, 500), (200, 500), (200, 100)]])).select("event_id")


@query("s12_sql_on_files", "SELECT a.u, a.v, a.travel_time, b.ref FROM edges a JOIN edge_tags b USING (u, v, key) WHERE b.ref IS NOT NULL")
def sql_on_files(t):
    at = folder(t, "files")
    K.write_layers({"a": t.edges, "b": t.edge_tags.select("u", "v", "key", "ref")}, at)
    return t.spark.sql(f"SELECT a.u, a.v, a.travel_time, b.ref FROM parquet.`{at}/a` a JOIN parquet.`{at}/b` b USING (u, v, key) WHERE b.ref IS NOT NULL")


@query("k1_layers", "SELECT 'roadways' AS layer, u, v, key, travel_time, CAST(NULL AS VARCHAR) AS bridge FROM edges UNION ALL SELECT 'bridges', u, v, key, travel_time, bridge FROM edge_tags WHERE bridge = 'yes'")
def layers(t):
    """Layers are written read-only, replaced once, and read back whole."""
    at = folder(t, "layers")
    roads, bridges = t.edges.select("u", "v", "key", "travel_time"), t.edge_tags.where("bridge = 'yes'").select("u", "v", "key", "travel_time", "bridge")
    K.write_layers({"roadways": roads.limit(1), "bridges": bridges}, at, read_only=True)
    K.write_layers({"roadways": roads}, at, read_only=True)
    read = lambda name: K.read_layer(t.spark, at, name).withColumn("layer", F.lit(name))
    return read("roadways").unionByName(read("bridges"), allowMissingColumns=True).select("layer", "u", "v", "key", "travel_time", "bridge")


@query("k2_impact_layer", "SELECT u, v, key, CASE WHEN u % 3 = 0 THEN 'FLOODED' ELSE 'NOT_IMPACTED' END AS nonfunctional_reason FROM edges")
def impact_layer(t):
    at = folder(t, "impact")
    K.write_layers({"flood_impact": Q.impact_columns(t).select("u", "v", "key", "nonfunctional_reason")}, at)
    return K.read_layer(t.spark, at, "flood_impact")


@query("k3_event_output", f"WITH {E.COLLECTED}, {E._hours('x', 'true')} SELECT x.u, x.v, x.key, x.n AS n_intervals, r.roads FROM x JOIN (SELECT u, v, key, count(*) AS roads FROM incidents GROUP BY u, v, key) r USING (u, v, key)")
def event_output(t):
    from wayfault.operators.intervals import EDGE, outage_hours

    roads = t.incidents.groupBy(*EDGE).agg(F.count(F.lit(1)).alias("roads"))
    return roads.join(outage_hours(E.collected(t), EDGE, "start_ts", "end_ts", "event_id"), EDGE).select(*EDGE, "n_intervals", "roads")


@query("k4_centrality_layers", f"{Q.CLOSENESS.replace('SELECT node_id, round', 'SELECT half, node_id, round')}, (SELECT 0 AS half UNION ALL SELECT 1)")
def centrality_layers(t):
    """Node metrics in a layer, and the same rows added to it."""
    from wayfault.operators import centrality as C

    at = folder(t, "centrality")
    rows = C.closeness(t.edges, C.path_sums(t.edges))
    K.write_layers({"nodes": rows.withColumn("half", F.lit(0))}, at)
    K.write_layers({"nodes": rows.withColumn("half", F.lit(1))}, at, mode="append")
    return K.read_layer(t.spark, at, "nodes").select("half", "node_id", F.round("closeness_centrality", 12).alias("closeness_centrality"))


@query("k5_conflation_qa", "SELECT count(*) AS edges, count(*) FILTER (EXISTS (SELECT 1 FROM match_rows m WHERE m.osm_u = e.u AND m.osm_v = e.v)) AS matched FROM match_edges e")
def conflation_qa(t):
    edges = t.match_edges.select("u", "v", "key")
    return L.matching_rate(R.best(t), edges, ["u", "v", "key"]).select(F.col("total").alias("edges"), "matched")


@query("k5_qa_layers", "SELECT 'all_edges' AS layer, u AS id, count(*) AS n FROM match_edges GROUP BY u UNION ALL SELECT 'all_routes', CAST(range AS BIGINT), 1 FROM range(60) UNION ALL SELECT 'unmatched_routes', CAST(range AS BIGINT), 1 FROM range(60) WHERE range NOT IN (SELECT route_id FROM match_rows)")
def conflation_qa_layers(t):
    """Routes 0 to 39 have match rows; whether an edge carries a route is another question, so all of them count as matched here."""
    from wayfault.plans import pipelines

    edges = t.match_edges.withColumn("geometry", F.array(G.point(F.col("u"), F.col("v"))))
    routes = t.spark.range(60).select(F.col("id").alias("route_id"))
    conflated = t.match_rows.select(F.col("osm_u").alias("u"), F.col("osm_v").alias("v"), F.lit(0).cast("long").alias("key"), "route_id")
    layers, _ = pipelines.conflation_layers(pipelines.Network(edges, edges, edges), routes, conflated)
    at = folder(t, "qa")
    K.write_layers(layers, at, read_only=True)
    n = lambda name, c: K.read_layer(t.spark, at, name).groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("layer"), "id", "n")
    return n("all_edges", "u").union(n("all_routes", "route_id")).union(n("unmatched_routes", "route_id"))


@query("k8_checked_load", "SELECT 'roadways' AS name, u, v, key FROM mesh UNION ALL SELECT 'base_paths', u, v, key FROM mesh")
def checked_load(t):
    """Keys and references hold; then tables are handed over, clustered."""
    done = {}
    paths = t.mesh.select("u", "v", "key", F.lit(0).alias("path_edge_index"), F.col("u").alias("path_u"), F.col("v").alias("path_v"), F.col("key").alias("path_key"))
    K.load_tables(t.mesh, t.mesh, paths, paths, done.__setitem__)
    return done["roadways"].select(F.lit("roadways").alias("name"), "u", "v", "key").union(done["base_paths"].select(F.lit("base_paths"), "u", "v", "key"))


#: A mask in the shape of a U, and the three rectangles that it is made of.
U_SHAPE = [(200, 100), (600, 100), (600, 700), (350, 700), (350, 220), (320, 220), (320, 700), (200, 700), (200, 100)]
LEGS = "(VALUES (200, 100, 600, 220), (200, 220, 320, 700), (350, 220, 600, 700)) m(a, b, c, d)"
SHARED = f"(SELECT box_id, greatest(least(x1, c) - greatest(x0, a), 0) * greatest(least(y1, d) - greatest(y0, b), 0) AS part FROM boxes, {LEGS})"


def clipped_boxes(t):
    return Q.boxes(t).withColumn("parts", X.polygon_intersection("polygon", J.polygon_literal([U_SHAPE])))


@query("j9_overlay", f"SELECT box_id, sum(part) AS area FROM {SHARED} GROUP BY box_id HAVING sum(part) > 0")
def overlay(t):
    return clipped_boxes(t).where(F.size("parts") > 0).select("box_id", F.round(X.parts_area(F.col("parts")), 6).alias("area"))


@query(
    "g18_overlay_rings",
    f"""SELECT b.box_id, CAST(CASE WHEN (SELECT count(*) FROM {SHARED} s WHERE s.box_id = b.box_id AND part > 0) = 0 THEN 0
 WHEN x0 < 320 AND x1 > 350 AND y0 >= 220 THEN 2 ELSE 1 END AS INT) AS n_parts,
 greatest(x1 - x0, 0) * (y1 - y0) / 2 AS bow_area, CAST(2 AS INT) AS bow_parts FROM boxes b""",
)
def overlay_rings(t):
    """Parts of each box in the mask; and the two triangles of a ring that crosses itself in the middle of the box; made once for equal boxes."""
    p = lambda a, b: F.struct(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    bow = F.array(F.array(p("x0", "y0"), p("x1", "y1"), p("x1", "y0"), p("x0", "y1"), p("x0", "y0")))
    equal = J.shapes(Q.boxes(t), ["x0", "y0", "x1", "y1", "polygon"], ["box_id"], "_boxes", ["x0", "y0", "x1", "y1"])
    rows = equal.withColumns({"parts": X.polygon_intersection("polygon", J.polygon_literal([U_SHAPE])), "bow": X.make_valid(bow)})
    return J.expanded(rows.select("_boxes", F.size("parts").alias("n_parts"), F.round(X.parts_area(F.col("bow")), 6).alias("bow_area"), F.size("bow").alias("bow_parts")), "_boxes").select("box_id", "n_parts", "bow_area", "bow_parts")


@query("j19_map_lookup", "SELECT e.u, e.v, e.key, a.m AS m_u, b.m AS m_v FROM edges e LEFT JOIN (SELECT u AS node, count(*) AS m FROM edges GROUP BY u) a ON e.u = a.node LEFT JOIN (SELECT u AS node, count(*) AS m FROM edges GROUP BY u) b ON e.v = b.node")
def map_lookup(t):
    from wayfault.operators.centrality import on_edges

    return on_edges(t.edges.select("u", "v", "key"), t.edges.groupBy(F.col("u").alias("node_id")).agg(F.count(F.lit(1)).alias("m"))).select("u", "v", "key", "m_u", "m_v")


@query(
    "a15_union_of_regions",
    """SELECT grp, CAST(count(*) AS DOUBLE) AS area FROM (SELECT DISTINCT box_id % 20 AS grp, cx, cy FROM (SELECT box_id, y0, y1, unnest(range(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT))) AS cx FROM boxes),
LATERAL (SELECT unnest(range(CAST(y0 AS BIGINT), CAST(y1 AS BIGINT))) AS cy)) GROUP BY grp""",
)
def union_of_regions(t):
    """Boxes have whole corners, so the area of their union is the number of unit squares that they cover."""
    united = X.union_polygons(Q.boxes(t).withColumn("grp", F.col("box_id") % 20), ["grp"])
    return united.select("grp", F.round(X.parts_area(F.col("parts")), 6).alias("area"))


@query("g10_union_of_lines", "SELECT ly, CAST(count(*) AS DOUBLE) AS length FROM (SELECT DISTINCT CAST(CAST(ly AS BIGINT) % 40 AS BIGINT) AS ly, unnest(range(CAST(lx0 AS BIGINT), CAST(lx1 AS BIGINT))) AS cx FROM flat_lines) GROUP BY ly")
def union_of_lines(t):
    """Lines along each other are counted once."""
    p = lambda a: F.struct(F.col(a).alias("x"), F.col("ly").cast("double").alias("y"))
    lines = t.flat_lines.withColumn("ly", F.col("ly").cast("long") % 40).select("ly", F.array(p("lx0"), p("lx1")).alias("line"))
    pieces = X.noded_lines(lines, ["ly"], 75.0)
    return pieces.groupBy("ly").agg(F.round(F.sum(F.abs(F.col("bx") - F.col("ax"))), 6).alias("length"))


@query("w3_island_flags", f"WITH {E.COLLECTED}, {E._hours('x', 'true')} SELECT u, v, key, count(*) AS islands FROM x_g GROUP BY u, v, key")
def island_flags(t):
    from wayfault.operators.intervals import EDGE, islands

    return islands(E.intervals_of(t), EDGE, "start_ts", "end_ts").groupBy(*EDGE).agg(F.max("island_id").alias("islands"))


@query("w5_row_numbers", "SELECT l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS INT) AS n FROM lineitem")
def row_numbers(t):
    return B.row_numbers(t.lineitem, ["l_orderkey"], [F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber"]).select("l_orderkey", "l_partkey", "n")


@query("w8_leg_cumulative", f"WITH {T.SEGMENTS} SELECT trace_id, matching_idx, leg_idx, leg_segment_idx, round(leg_cumulative_m, 2) AS leg_cumulative_m, round(matching_cumulative_m, 2) AS matching_cumulative_m FROM segs")
def leg_cumulative(t):
    return T.segments(t).select("trace_id", "matching_idx", "leg_idx", "leg_segment_idx", F.round("leg_cumulative_m", 2).alias("leg_cumulative_m"), F.round("matching_cumulative_m", 2).alias("matching_cumulative_m"))


@query(
    "g1_projection_centre",
    """WITH c AS (SELECT DISTINCT box_id % 20 AS grp, cx, cy FROM (SELECT box_id, y0, y1, unnest(range(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT))) AS cx FROM boxes), LATERAL (SELECT unnest(range(CAST(y0 AS BIGINT), CAST(y1 AS BIGINT))) AS cy))
SELECT grp, round(avg(cx + 0.5), 4) AS lon0, round(avg(cy + 0.5), 4) AS lat0 FROM c GROUP BY grp""",
)
def projection_centre(t):
    """Centroid of a union, where its own projection is centred: here the mean of the unit squares that it covers."""
    united = X.union_polygons(Q.boxes(t).withColumn("grp", F.col("box_id") % 20), ["grp"])
    c = X.parts_centroid(F.col("parts"))
    return united.select("grp", F.round(c["x"], 4).alias("lon0"), F.round(c["y"], 4).alias("lat0"))


#: Length of a meridian from the equator, by the series in the third flattening, and of a degree of the equator.
N = "(0.0033528106647474805 / (2 - 0.0033528106647474805))"
MERIDIAN = f"""6378137.0 / (1 + {N}) * ((1 + pow({N}, 2) / 4 + pow({N}, 4) / 64) * p - 1.5 * ({N} - pow({N}, 3) / 8) * sin(2 * p) + 0.9375 * (pow({N}, 2) - pow({N}, 4) / 4) * sin(4 * p)
 - 35.0 / 48 * pow({N}, 3) * sin(6 * p) + 315.0 / 512 * pow({N}, 4) * sin(8 * p))"""


@query("g4a_ellipsoid_length", f"SELECT trace_id, idx, round({MERIDIAN} + 6378137.0 * radians(1), 2) AS metres FROM (SELECT trace_id, idx, radians(abs(y)) AS p FROM tracepoints WHERE x IS NOT NULL)")
def ellipsoid(t):
    """Along a meridian to the equator and one degree along it, where lengths are known otherwise."""
    rows = t.tracepoints.where("x IS NOT NULL")
    line = F.array(G.point(F.col("x"), F.col("y")), G.point(F.col("x"), F.lit(0)), G.point(F.col("x") + 1, F.lit(0)))
    return rows.select("trace_id", "idx", F.round(X.ellipsoid_length(line), 2).alias("metres"))


@query("g3_buffer_area", "SELECT box_id, round((x1 - x0) * (y1 - y0) + 2 * (x1 - x0 + y1 - y0) * (1 + box_id % 3) + 32 * sin(2 * pi() / 64) * pow(1 + box_id % 3, 2), 4) AS area FROM boxes")
def buffer_area(t):
    """A box, four sides and four quarters of a disc of 64 corners; made once for equal boxes and distances."""
    rows = Q.boxes(t).withColumn("distance", (1 + F.col("box_id") % 3).cast("double"))
    equal = J.shapes(rows, ["polygon", "distance"], ["box_id"], "_boxes")
    area = F.round(X.parts_area(X.buffer(F.col("polygon"), F.col("distance"))), 4)
    return J.expanded(equal.select("_boxes", area.alias("area")), "_boxes").select("box_id", "area")


@query("g8_intersects", "SELECT line_id, count(*) AS n FROM flat_lines, boxes WHERE lx0 <= x1 AND lx1 >= x0 AND ly BETWEEN y0 AND y1 GROUP BY line_id")
def intersects(t):
    return J.polygons_per_line(Q.flat_lines(t), Q.boxes(t), 50.0, ["line_id"], ["box_id"])


@query("g9_line_in_polygon", "SELECT line_id, box_id, least(lx1, x1) - greatest(lx0, x0) AS length FROM flat_lines, boxes WHERE least(lx1, x1) > greatest(lx0, x0) AND ly BETWEEN y0 AND y1")
def line_in_polygon(t):
    met = J.lengths_in_polygons(Q.flat_lines(t), Q.boxes(t), 50.0, ["line_id"], ["box_id"])
    return met.select("line_id", "box_id", F.round("length", 6).alias("length"))


@query("g15_cell_index", "SELECT cx, cy, count(*) AS n FROM (SELECT unnest(range(CAST(floor(x0 / 50) AS BIGINT), CAST(floor(x1 / 50) AS BIGINT) + 1)) AS cx, y0, y1 FROM boxes), LATERAL (SELECT unnest(range(CAST(floor(y0 / 50) AS BIGINT), CAST(floor(y1 / 50) AS BIGINT) + 1)) AS cy) GROUP BY cx, cy")
def cell_index(t):
    return J.quadrats(Q.boxes(t), 50.0).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))


@query("g16_make_point", "SELECT event_id, x, y FROM event_points")
def make_point(t):
    return t.event_points.select("event_id", G.point(F.col("x"), F.col("y")).alias("p")).select("event_id", "p.x", "p.y")


@query("g19_boundary_geometry", "SELECT box_id, x0 AS min_x, y1 AS max_y FROM boxes WHERE box_id = 3")
def boundary_geometry(t):
    b = G.bounds(F.col("polygon")[0])
    return Q.boxes(t).where("box_id = 3").select("box_id", b["min_x"].alias("min_x"), b["max_y"].alias("max_y"))


@query("n17_graph_and_tables", "SELECT u, count(*) AS n, CAST(sum(travel_time) AS BIGINT) AS seconds FROM edges GROUP BY u")
def graph_and_tables(t):
    back = B.from_adjacency(B.adjacency(t.edges, ["travel_time"]))
    return back.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.sum("travel_time").alias("seconds"))


@query(
    "m8_leg_starts",
    """SELECT trace_id, matching_idx, waypoint_idx AS leg_idx, x, y, lead(x) OVER o AS next_x, lead(y) OVER o AS next_y, lead(idx) OVER o IS NOT NULL AS has_next FROM tracepoints WHERE matching_idx IS NOT NULL WINDOW o AS (PARTITION BY trace_id ORDER BY idx)""",
)
def leg_starts(t):
    rows = M.next_points(t.tracepoints).where("matching_idx IS NOT NULL")
    return rows.select("trace_id", "matching_idx", F.col("waypoint_idx").alias("leg_idx"), "x", "y", "next_x", "next_y", "has_next")


@query("m9_joined_segments", f"WITH {T.SEGMENTS} SELECT trace_id, matching_idx, leg_idx, count(*) AS n, round(sum(segment_length_m), 2) AS length_m FROM segs GROUP BY trace_id, matching_idx, leg_idx")
def joined_segments(t):
    return T.segments(t).groupBy("trace_id", "matching_idx", "leg_idx").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("segment_length_m"), 2).alias("length_m"))


@query("m11_matches_on_edges", f"WITH {R.EDGE_MATCHES} SELECT u, v, key, route_id, reversed_input, from_mi, to_mi, round(r, 6) AS ratio_covered FROM es")
def matches_on_edges(t):
    return R.edge_matches(t).select("u", "v", "key", "route_id", "reversed_input", "from_mi", "to_mi", F.round("ratio_covered", 6).alias("ratio_covered"))


@query("m12_selected_routes", f"WITH {R.EDGE_MATCHES}, {R.FILLED} SELECT match_type, count(*) AS n FROM filled GROUP BY match_type")
def selected_routes(t):
    return L.fill_reverse(R.best(t), t.match_edges).groupBy("match_type").agg(F.count(F.lit(1)).alias("n"))


@query("m15_enriched", f"SELECT m._idx_, f.federal_class FROM lrs_matches m LEFT JOIN (SELECT DISTINCT ON (_idx_) * FROM ({R.CLASS}) ORDER BY _idx_, overlap_mi DESC, functional_class) f USING (_idx_)")
def enriched(t):
    return L.enriched(t.lrs_matches, {"f": R.longest(t)}).select("_idx_", F.col("f_federal_class").alias("federal_class"))


#: Attributes as the inventory's tables give them to the numbered matches of best and filled routes.
M_ON = R.ON.replace("a.", "m.").replace("b.event_route_id", "b.event_route_id")
M_MI = R.MI.replace("a.", "m.")
M_AT = R.AT.replace("a.", "m.")


@query(
    "m16_conflation",
    f"""WITH {R.EDGE_MATCHES}, {R.FILLED}, m AS (SELECT row_number() OVER (ORDER BY u, v, key) - 1 AS _idx_, * FROM filled),
f AS (SELECT DISTINCT ON (_idx_) * FROM (SELECT DISTINCT m._idx_, {M_MI} AS overlap_mi, b.functional_class, d.f AS federal_class FROM m JOIN lrs_events b ON {M_ON} LEFT JOIN class_types c ON b.functional_class = c.type_id
 LEFT JOIN (VALUES (1, 1), (2, 2), (4, 3), (6, 4), (7, 5), (8, 6), (9, 7)) d(s, f) ON CAST(c.type_functional_class AS INT) % 10 = d.s) ORDER BY _idx_, overlap_mi DESC, functional_class),
s AS (SELECT DISTINCT ON (_idx_) * FROM (SELECT DISTINCT m._idx_, {M_MI} AS overlap_mi, b.code FROM m JOIN lrs_events b ON {M_ON}) ORDER BY _idx_, overlap_mi DESC, code),
b AS (SELECT DISTINCT ON (_idx_) * FROM (SELECT DISTINCT m._idx_, i.structure AS bin, i.rating FROM m JOIN lrs_events b ON {M_ON} JOIN structures i ON b.structure = i.structure) ORDER BY _idx_, rating NULLS LAST, bin),
c AS (SELECT DISTINCT ON (_idx_) * FROM (SELECT DISTINCT m._idx_, i.structure AS cin, i.rating FROM m JOIN culvert_points b ON {M_AT} JOIN structures i ON b.structure = i.structure) ORDER BY _idx_, rating NULLS LAST, cin),
n AS (SELECT DISTINCT ON (_idx_) * FROM (SELECT DISTINCT ON (_idx_, from_measure) m._idx_, b.from_measure, {M_MI} AS overlap_mi, b.from_date AS aadt FROM m JOIN lrs_events b ON {M_ON} ORDER BY _idx_, from_measure, dd_id, from_date DESC, overlap_mi)
 ORDER BY _idx_, overlap_mi DESC, from_measure)
SELECT m.u, m.v, m.key, m.route_id, m.match_type, f.overlap_mi AS fclass_overlap_mi, f.functional_class AS fclass_functional_class, f.federal_class AS fclass_federal_class, s.code AS strategic_code, b.bin AS bridge_bin, b.rating AS bridge_condition_rating,
 c.cin AS culvert_cin, c.rating AS culvert_condition_rating, n.overlap_mi AS counts_overlap_mi, n.aadt AS counts_aadt FROM m LEFT JOIN f USING (_idx_) LEFT JOIN s USING (_idx_) LEFT JOIN b USING (_idx_) LEFT JOIN c USING (_idx_) LEFT JOIN n USING (_idx_)""",
)
def conflation(t):
    from wayfault.operators.inventory import attribute_pulls

    e, i = t.lrs_events, t.structures.select(F.col("structure").alias("bin"), F.col("rating").alias("ConditionR"))
    tables = {
        "fclass": e, "fclass_types": t.class_types, "strategic": e, "domains": t.domains, "domain_entries": t.domain_entries, "bridges": e.withColumnRenamed("structure", "bin"), "bridge_inventory": i,
        "culverts": t.culvert_points.withColumnRenamed("structure", "cin"), "culvert_inventory": i, "counts": e.withColumn("AADT", F.col("from_date")),
    }
    selected = L.numbered_matches(L.fill_reverse(R.best(t), t.match_edges))
    got = L.enriched(selected, {name: pull(selected) for name, pull in attribute_pulls(tables).items()})
    return got.select(
        "u", "v", "key", "route_id", "match_type", "fclass_overlap_mi", "fclass_functional_class", "fclass_federal_class", "strategic_code", "bridge_bin", "bridge_condition_rating", "culvert_cin",
        "culvert_condition_rating", "counts_overlap_mi", "counts_aadt",
    )


@query("m17_parameterised_join", "SELECT count(*) AS n FROM lrs_matches a JOIN lrs_events b ON a.route_id = b.event_route_id AND b.to_date IS NULL AND b.from_measure >= 30 AND greatest(a.min_from_mi, a.max_to_mi) > least(b.from_measure, b.to_measure) AND least(a.min_from_mi, a.max_to_mi) < greatest(b.from_measure, b.to_measure)")
def parameterised(t):
    return L.overlap_join(t.lrs_matches, t.lrs_events.where(F.col("from_measure") >= 30)).agg(F.count(F.lit(1)).alias("n"))


@query("v4_disjoint", "SELECT u, v, key, travel_time FROM edges")
def disjoint(t):
    return J.checked_union(t.edges.where("u % 2 = 0"), t.edges.where("u % 2 = 1"), ["u", "v", "key"]).select("u", "v", "key", "travel_time")


@query("v6_unchanged", "SELECT u, v, key, travel_time + 1 AS x FROM edges")
def unchanged(t):
    return V.require_unchanged(t.edges, t.edges.withColumn("x", F.col("travel_time") + 1), ["u", "v", "key"]).select("u", "v", "key", "x")


@query("v8_coordinate_system", "SELECT event_id, x, y FROM event_points")
def coordinate_system(t):
    rows = V.with_crs(t.event_points.withColumn("p", G.point(F.col("x"), F.col("y"))), "p", "EPSG:4326")
    return V.require_crs(rows, "p", "EPSG:4326").select("event_id", "p.x", "p.y")
