"""Queries on road networks: spans, components, floods, walks, paths, centrality."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfault.operators import centrality as C
from wayfault.operators import components as K
from wayfault.operators import flood as W
from wayfault.operators import paths as P
from wayfault.operators import spans as N
from wayfault.operators import spatial_join as J
from wayfault.operators import tables as B
from wayfault.operators.scratch import cut
from wayfault.plans.registry import adapter, query
from wayfault.plans.scalar_queries import named

# -- spans
adapter(
    "way_slices",
    """SELECT u, v, key, pos, tag, osmid, ref, first_idx, first_idx + 1 + osmid % 3 AS last_idx FROM (SELECT u, v, key, pos, tag, osmid, ref,
       CAST(sum(1 + osmid % 3) OVER (PARTITION BY u, v, key ORDER BY pos) - 1 - osmid % 3 AS INT) AS first_idx FROM (SELECT l_orderkey AS u, l_orderkey + 1 AS v, CAST(0 AS BIGINT) AS key,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS pos, l_suppkey AS osmid,
       CASE WHEN l_partkey % 4 = 0 THEN 'yes' WHEN l_partkey % 4 = 1 THEN 'no' WHEN l_partkey % 4 = 2 THEN 'viaduct' ELSE NULL END AS tag, CAST(l_suppkey % 9 AS STRING) AS ref FROM lineitem))""",
)


def sliced(t):
    s = F.struct("pos", F.struct(
        F.col("first_idx").alias("start_coord_idx"), F.col("last_idx").alias("end_coord_idx"), F.lit(0.0).alias("start_ratio_along"), F.lit(1.0).alias("end_ratio_along"),
        "osmid", "ref", F.lit(None).cast("string").alias("name"), F.col("tag").alias("bridge_tag"), F.array(F.col("osmid") * 10, F.col("osmid") * 10 + 1).alias("osm_nodes"),
    ).alias("s"))
    return t.way_slices.groupBy("u", "v", "key").agg(F.array_sort(F.collect_list(s)).alias("_w")).select("u", "v", "key", F.col("_w.s").alias("way_along"))


SPANS = """f AS (SELECT *, coalesce(tag <> 'no', false) AS bridge FROM way_slices), c AS (SELECT *, CASE WHEN bridge = lag(bridge) OVER (PARTITION BY u, v, key ORDER BY pos) THEN 0 ELSE 1 END AS new FROM f),
r AS (SELECT *, sum(new) OVER (PARTITION BY u, v, key ORDER BY pos) AS run FROM c),
g AS (SELECT u, v, key, run, bridge, min(first_idx) AS start_coord_idx, max(last_idx) AS end_coord_idx, string_agg('' || osmid, ',' ORDER BY pos) AS osmids, string_agg(ref, ',' ORDER BY pos) AS refs FROM r GROUP BY u, v, key, run, bridge),
s AS (SELECT *, CAST(row_number() OVER (PARTITION BY u, v, key, bridge ORDER BY run) - 1 AS INT) AS span_idx FROM g)"""


@query("n4_bridge_spans", f"WITH {SPANS} SELECT u, v, key, span_idx, start_coord_idx, end_coord_idx, osmids, refs FROM s WHERE bridge")
def bridge_spans(t):
    return N.bridge_spans(sliced(t)).select("u", "v", "key", "span_idx", "start_coord_idx", "end_coord_idx", F.array_join("osmids", ",").alias("osmids"), F.array_join("refs", ",").alias("refs"))


@query("n5_nonbridge_spans", f"WITH {SPANS} SELECT u, v, key, span_idx, start_coord_idx, end_coord_idx, osmids FROM s WHERE NOT bridge")
def nonbridge_spans(t):
    return N.nonbridge_spans(sliced(t)).select("u", "v", "key", "span_idx", "start_coord_idx", "end_coord_idx", F.array_join("osmids", ",").alias("osmids"))


@query("w11_runs", f"WITH {SPANS} SELECT u, v, key, CAST(count(*) AS INT) AS n_runs FROM g GROUP BY u, v, key")
def runs(t):
    return sliced(t).select("u", "v", "key", F.size(N.runs(F.col("way_along"), lambda x: N.is_bridge(x["bridge_tag"]))).alias("n_runs"))


@query("w10_consecutive_pairs", "SELECT l_orderkey, a, b FROM (SELECT l_orderkey, l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS b FROM lineitem) WHERE b IS NOT NULL")
def pairs(t):
    chain = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice"))).alias("c")).select("l_orderkey", F.col("c.l_partkey").alias("nodes"))
    return N.broken_chains(chain, ["l_orderkey"], "nodes").select("l_orderkey", F.col("u").alias("a"), F.col("v").alias("b"))


@query("m6_path_check", "SELECT l_orderkey, a, b FROM (SELECT l_orderkey, l_partkey % 100 AS a, lead(l_partkey % 100) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS b FROM lineitem) WHERE b IS NOT NULL AND (a, b) NOT IN (SELECT u, v FROM edges)")
def path_check(t):
    chain = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice"))).alias("c")).select("l_orderkey", F.transform("c.l_partkey", lambda x: x % 100).alias("nodes"))
    return N.broken_chains(chain, ["l_orderkey"], "nodes").join(t.edges, ["u", "v"], "left_anti").select("l_orderkey", F.col("u").alias("a"), F.col("v").alias("b"))


# -- components
COMPONENTS = """nodes AS (SELECT DISTINCT u AS node_id FROM edges UNION SELECT v FROM edges), both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach(node_id, other) AS (SELECT node_id, node_id FROM nodes UNION SELECT r.node_id, b.v FROM reach r JOIN both_ways b ON r.other = b.u), comp AS (SELECT node_id, min(other) AS component FROM reach GROUP BY node_id)"""


def labels(t):
    return K.components(C._nodes(t.edges), t.edges)


@query("n10_components", f"WITH RECURSIVE {COMPONENTS} SELECT node_id, component FROM comp")
def components(t):
    return labels(t)


@query("o4_ranked_components", f"WITH RECURSIVE {COMPONENTS} SELECT component, count(*) AS size, CAST(row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS INT) AS rank FROM comp GROUP BY component")
def ranked(t):
    return K.ranked_components(labels(t))


@query("a17_largest_share", f"WITH RECURSIVE {COMPONENTS} SELECT max(n) AS largest, CAST(sum(n) AS BIGINT) AS total, max(n) / sum(n) AS ratio FROM (SELECT count(*) AS n FROM comp GROUP BY component)")
def share(t):
    return K.largest_share(labels(t))


@query("n10_outside_largest", f"WITH RECURSIVE {COMPONENTS} SELECT node_id FROM comp WHERE component <> (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)")
def outside(t):
    return K.outside_largest(labels(t))


# -- floods
ZONES = ", ".join(f"('{z}', {'NULL' if s is None else repr(s)}, {r})" for z, s, r in W.ZONE_RANKS)
adapter(
    "zones",
    """SELECT p_partkey AS floodplain_idx, p_partkey % 300 AS grp, CASE p_size % 7 WHEN 0 THEN 'VE' WHEN 1 THEN 'AE' WHEN 2 THEN 'AO' WHEN 3 THEN 'X' WHEN 4 THEN 'A' WHEN 5 THEN 'OPEN WATER' ELSE 'D' END AS fld_zone,
       CASE p_partkey % 5 WHEN 0 THEN 'FLOODWAY' WHEN 1 THEN 'COASTAL FLOODPLAIN' WHEN 2 THEN '0.2 PCT ANNUAL CHANCE FLOOD HAZARD' ELSE NULL END AS zone_subty FROM part""",
)
RANKED = f"ranks(zone, subtype, level) AS (VALUES {ZONES}), ranked AS (SELECT z.*, level AS flood_risk_level FROM zones z LEFT JOIN ranks r ON z.fld_zone IS NOT DISTINCT FROM r.zone AND z.zone_subty IS NOT DISTINCT FROM r.subtype)"


@query("f14_flood_rank", f"WITH {RANKED} SELECT floodplain_idx, flood_risk_level FROM ranked")
def flood_rank(t):
    return W.with_rank(t.zones).select("floodplain_idx", "flood_risk_level")


@query("f13_highest_zone", f"WITH {RANKED} SELECT grp, min(flood_risk_level) AS flood_risk_level, arg_min(fld_zone, flood_risk_level) AS fld_zone FROM ranked GROUP BY grp")
def highest(t):
    return W.highest_zone(t.zones, ["grp"]).select("grp", "flood_risk_level", "fld_zone")


adapter("span_floods", "SELECT p_partkey AS floodplain_idx, p_partkey % 40 AS u, p_partkey % 40 + 1 AS v, CAST(0 AS BIGINT) AS key, CAST(p_size % 3 AS INT) AS span_idx FROM part")


def levels(t):
    return W.span_levels(t.span_floods, W.with_rank(t.zones).where("flood_risk_level IS NOT NULL"))


LEVELS = f"{RANKED}, lv AS (SELECT u, v, key, span_idx, min(flood_risk_level) AS level FROM span_floods s JOIN ranked USING (floodplain_idx) WHERE flood_risk_level IS NOT NULL GROUP BY u, v, key, span_idx)"


@query("a3_min_risk", f"WITH {LEVELS} SELECT u, v, key, span_idx, level FROM lv")
def min_risk(t):
    return levels(t)


@query("n11_edge_level", f"WITH {LEVELS} SELECT u, v, key, max(level) AS level FROM lv GROUP BY u, v, key")
def edge_level(t):
    return W.edge_level(levels(t))


@query("n11_impacts")
def impacts(t):
    e = t.edges.select("u", "v", "key")
    span = F.lit(0).alias("span_idx")
    bridge = (F.col("u") * F.col("v") % 5 == 0)
    flooded = e.where(~bridge & (F.col("u") % 4 == 1)).select("u", "v", "key", span, (1 + (F.col("u") + F.col("v")) % 4 * 5).cast("int").alias("level"))
    return W.impacts(e, e.where(~bridge).select("*", span), e.where(bridge).select("*", span), flooded)


@query(
    "n12_impact_columns",
    "SELECT u, v, key, CASE WHEN u % 3 = 0 THEN 'FLOODED' ELSE 'NOT_IMPACTED' END AS nonfunctional_reason, CASE WHEN u % 3 = 0 THEN v % 18 + 1 END AS nonfunctional_risk_level, CASE WHEN u % 3 = 0 THEN CASE WHEN v % 18 + 1 < 14 THEN '100 YEAR' ELSE '500 YEAR' END END AS nonfunctional_frequency, CASE WHEN v % 5 = 0 THEN -1 END AS isolated_edge_risk_level, CASE WHEN v % 5 = 0 THEN '100 YEAR' END AS isolated_edge_frequency FROM edges",
)
def impact_columns(t):
    e = t.edges.select("u", "v", "key")
    return W.impact_columns(e, e.where("u % 3 = 0").select("*", F.lit("FLOODED").alias("reason"), (F.col("v") % 18 + 1).alias("level")), e.where("v % 5 = 0").select("*", F.lit(-1).alias("level")))


# -- walks and paths
def streets(t):
    return named(t)


STEP = "CASE WHEN {a}.ref IS NOT NULL THEN e.ref = {a}.ref ELSE e.name IS NOT DISTINCT FROM {a}.name END"


def _walk_sql(up: bool) -> str:
    """Three steps, each the smallest (node, key) that is allowed; used pairs are kept as text."""
    near, far, at = ("v", "u", "u") if up else ("u", "v", "v")
    parts = [f"s0 AS (SELECT u, v, key, ref, name, {at} AS at, '|' || u || '>' || v || '|' || v || '>' || u || '|' AS used, '' AS nodes FROM streets)"]
    for i in range(3):
        parts.append(
            f"""o{i} AS (SELECT s.u, s.v, s.key, min((e.{far}, e.key, e.u, e.v)) AS st FROM s{i} s JOIN streets e ON s.at = e.{near} WHERE {STEP.format(a='s')} AND NOT contains(s.used, '|' || e.u || '>' || e.v || '|') GROUP BY s.u, s.v, s.key),
s{i + 1} AS (SELECT s.u, s.v, s.key, s.ref, s.name, o.st[1] AS at, s.used || coalesce('|' || o.st[3] || '>' || o.st[4] || '|' || o.st[4] || '>' || o.st[3] || '|', '') AS used, CASE WHEN o.st IS NULL THEN s.nodes ELSE s.nodes || ',' || o.st[1] END AS nodes FROM s{i} s LEFT JOIN o{i} o ON s.u = o.u AND s.v = o.v AND s.key = o.key)"""
        )
    return "streets AS (SELECT u, v, key, ref, name FROM edge_tags), " + ", ".join(parts)


for _up in (True, False):

    @query(f"n6_walk_{'up' if _up else 'down'}stream", f"WITH {_walk_sql(_up)} SELECT u, v, key, ltrim(nodes, ',') AS nodes FROM s3")
    def walk(t, up=_up):
        return P.walk(t.edge_tags, t.edge_tags, up).select("u", "v", "key", F.array_join("nodes", ",").alias("nodes"))


DIST = "d(src, node, cost) USING KEY (src, node) AS (SELECT DISTINCT u, u, CAST(0 AS BIGINT) FROM edges UNION SELECT d.src, e.v, min(d.cost + e.travel_time) FROM d JOIN edges e ON d.node = e.u LEFT JOIN recurring.d r ON r.src = d.src AND r.node = e.v WHERE r.cost IS NULL OR d.cost + e.travel_time < r.cost GROUP BY d.src, e.v)"


@query("n7_shortest_paths", f"WITH RECURSIVE {DIST} SELECT e.u, e.v, CAST(d.cost AS DOUBLE) AS cost FROM edges e JOIN d ON d.src = e.v AND d.node = e.u")
def shortest(t):
    """The way back along every edge."""
    q = t.edges.select("u", "v", F.concat_ws(">", "u", "v").alias("query"), F.col("v").alias("origin"), F.col("u").alias("destination"))
    return P.shortest_paths(t.edges, q).join(q, "query").select("u", "v", "cost")


TARGETS = "u <> v"


@query(
    "n7_detours",
    f"""WITH RECURSIVE d(bu, bv, node, cost) USING KEY (bu, bv, node) AS (SELECT u, v, u, CAST(0 AS BIGINT) FROM mesh WHERE {TARGETS}
UNION SELECT d.bu, d.bv, e.v, min(d.cost + CASE WHEN e.u = d.bu AND e.v = d.bv THEN 1000000 ELSE e.travel_time END) FROM d JOIN mesh e ON d.node = e.u LEFT JOIN recurring.d r ON r.bu = d.bu AND r.bv = d.bv AND r.node = e.v
WHERE r.cost IS NULL OR d.cost + CASE WHEN e.u = d.bu AND e.v = d.bv THEN 1000000 ELSE e.travel_time END < r.cost GROUP BY d.bu, d.bv, e.v)
SELECT bu AS u, bv AS v, CAST(cost AS DOUBLE) AS detour_sec FROM d WHERE node = bv""",
)
def detours(t):
    q = t.mesh.where(TARGETS).select(F.concat_ws(">", "u", "v").alias("query"), F.col("u").alias("origin"), F.col("v").alias("destination"), F.col("u").alias("bu"), F.col("v").alias("bv"), F.col("key").alias("bkey"))
    return P.shortest_paths(t.mesh, q).join(q, "query").select(F.col("bu").alias("u"), F.col("bv").alias("v"), F.col("cost").alias("detour_sec"))


def info(t):
    e = t.mesh_tags.withColumn("length_mi", F.col("length").cast("double"))
    return P.redundancy(e, e.where(TARGETS), paved_only=False)


@query("n8_redundancy")
def redundancy(t):
    return info(t).withColumns({c: F.to_json(c) for c in ("base_path_edge_ids", "detour_path_edge_ids")})


@query("n9_path_table", "SELECT u, v, key, CAST(i AS INT) AS path_edge_index, u + i AS path_u, v + i AS path_v, key AS path_key FROM edges, range(4) r(i) WHERE i <= u % 4")
def path_table(t):
    ids = F.transform(F.sequence(F.lit(0), (F.col("u") % 4).cast("int")), lambda i: F.struct((F.col("u") + i).alias("u"), (F.col("v") + i).alias("v"), F.col("key").alias("key")))
    return P.path_table(t.edges.select("u", "v", "key", ids.alias("base_path_edge_ids")), "base")


@query("n9_redundancy_paths")
def redundancy_paths(t):
    return P.path_table(info(t), "base")


@query("j3_path_geometries", "SELECT e.u, e.v, e.key, CAST(i AS INT) AS path_edge_index, p.u AS path_u, p.v AS path_v, p.travel_time, p.length FROM mesh e, range(2) r(i) JOIN mesh p ON p.u = CASE i WHEN 0 THEN e.u ELSE e.v END AND p.v = CASE i WHEN 0 THEN e.v ELSE e.u END AND p.key = e.key")
def path_geometries(t):
    """There and back, where there is a way back."""
    step = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"), F.col("key").alias("key"))
    there = t.mesh.select("u", "v", "key", F.array(step("u", "v"), step("v", "u")).alias("detour_path_edge_ids"))
    got = P.path_geometries(P.path_table(there, "detour"), t.mesh)
    return got.select("u", "v", "key", "path_edge_index", "path_u", "path_v", "travel_time", "length")


@query("j4_detours_with_roads", "SELECT u, v, key, travel_time, ref, name FROM edges JOIN (SELECT u, v, key, ref, name FROM edge_tags) USING (u, v, key)")
def with_roads(t):
    return B.with_columns_of(t.edges, t.edge_tags, ["ref", "name"]).select("u", "v", "key", "travel_time", "ref", "name")


# -- centrality
CLOSENESS = f"WITH RECURSIVE {DIST}, nodes AS (SELECT DISTINCT u AS node_id FROM edges UNION SELECT v FROM edges), s AS (SELECT node, sum(cost) AS far, count(*) AS reach FROM d WHERE src <> node GROUP BY node) SELECT node_id, round(CASE WHEN far > 0 THEN reach / far * reach / ((SELECT count(*) FROM nodes) - 1) ELSE 0 END, 12) AS closeness_centrality FROM nodes LEFT JOIN s ON node_id = node"


@query("n15_closeness", CLOSENESS)
def closeness(t):
    return C.closeness(t.edges, C.path_sums(t.edges)).select("node_id", F.round("closeness_centrality", 12).alias("closeness_centrality"))


@query("n13_node_betweenness")
def node_betweenness(t):
    return C.node_betweenness(t.edges, C.path_sums(t.edges))


@query("n14_edge_betweenness")
def edge_betweenness(t):
    return C.edge_betweenness(t.edges, C.path_sums(t.edges))


@query("n16_louvain")
def louvain(t):
    return C.communities(t.edges)


@query("n18_metric_by_name", CLOSENESS)
def by_name(t):
    return C.metric(t.edges, "closeness_centrality").select("node_id", F.round("closeness_centrality", 12).alias("closeness_centrality"))


@query("n19_metrics_on_edges", "SELECT u, v, key, u * 2 AS m_u, v * 2 AS m_v FROM edges")
def on_edges(t):
    nodes = C._nodes(t.edges).withColumn("m", F.col("node_id") * 2)
    return C.on_edges(t.edges.select("u", "v", "key"), nodes).select("u", "v", "key", "m_u", "m_v")


# -- polygons
adapter("boxes", "SELECT p_partkey AS box_id, CAST(p_partkey * 31 % 1000 AS DOUBLE) AS x0, CAST(p_partkey * 17 % 1000 AS DOUBLE) AS y0, CAST(p_partkey * 31 % 1000 + 5 + p_size AS DOUBLE) AS x1, CAST(p_partkey * 17 % 1000 + 55 - p_size AS DOUBLE) AS y1 FROM part")


def boxes(t):
    p = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    return t.boxes.withColumn("polygon", F.array(F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"), p("x0", "y0"))))


@query("j6_points_within", "SELECT event_id, box_id FROM event_points, boxes WHERE x > x0 AND x < x1 AND y > y0 AND y < y1")
def within(t):
    return J.points_in_polygons(t.event_points, boxes(t).select("box_id", "polygon"), 50.0).select("event_id", "box_id")


@query("j6_points_intersecting", "SELECT event_id, box_id FROM event_points, boxes WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
def intersecting(t):
    return J.points_in_polygons(t.event_points, boxes(t).select("box_id", "polygon"), 50.0, boundary=True).select("event_id", "box_id")


@query("g14_quadrats", "SELECT box_id, cx, cy FROM (SELECT box_id, unnest(range(CAST(floor(x0 / 50) AS BIGINT), CAST(floor(x1 / 50) AS BIGINT) + 1)) AS cx, y0, y1 FROM boxes), LATERAL (SELECT unnest(range(CAST(floor(y0 / 50) AS BIGINT), CAST(floor(y1 / 50) AS BIGINT) + 1)) AS cy)")
def quadrats(t):
    return J.quadrats(boxes(t), 50.0).select("box_id", "cx", "cy")


adapter("flat_lines", "SELECT s_suppkey AS line_id, CAST(s_suppkey * 23 % 900 AS DOUBLE) AS lx0, CAST(s_suppkey * 29 % 1000 AS DOUBLE) AS ly, CAST(s_suppkey * 23 % 900 + 40 AS DOUBLE) AS lx1 FROM supplier")


def flat_lines(t):
    p = lambda a: F.struct(F.col(a).alias("x"), F.col("ly").alias("y"))
    return t.flat_lines.select("line_id", F.array(p("lx0"), p("lx1")).alias("line"))


@query("j10_lines_in_polygons", "SELECT line_id, box_id FROM flat_lines, boxes WHERE lx0 <= x1 AND lx1 >= x0 AND ly BETWEEN y0 AND y1")
def lines_in_polygons(t):
    return J.lines_in_polygons(flat_lines(t), boxes(t), 50.0, ["line_id"], ["box_id"])


@query("s5_clipped_points", "SELECT event_id FROM event_points WHERE x > 100 AND x < 400 AND y > 200 AND y < 700")
def clipped(t):
    region = J.polygon_literal([[(100, 200), (400, 200), (400, 700), (100, 700), (100, 200)]])
    return J.clip(t.event_points, region, box=(100, 200, 400, 700)).select("event_id")


@query("s6_clipped_intersecting", "SELECT event_id FROM event_points WHERE x BETWEEN 100 AND 400 AND y BETWEEN 200 AND 700")
def clipped_boundary(t):
    region = J.polygon_literal([[(100, 200), (400, 200), (400, 700), (100, 700), (100, 200)]])
    return J.clip(t.event_points, region, boundary=True).select("event_id")


# -- the same on a larger network, made from the orders: blocks of 25 nodes with streets between them
adapter(
    "order_edges",
    """SELECT u, v, CAST(0 AS BIGINT) AS key, min(tt) AS travel_time FROM (
       SELECT n AS u, n - n % 25 + (n * 7 + 3) % 25 AS v, 100 + c % 91 AS tt FROM (SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS n, o_custkey AS c FROM orders)
       UNION ALL SELECT n - n % 25 + (n * 3 + 1) % 25, n, 100 + c % 97 FROM (SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS n, o_custkey AS c FROM orders)
       ) WHERE u <> v GROUP BY u, v""",
)


@query("n10_components_of_orders", f"WITH RECURSIVE {COMPONENTS.replace('edges', 'order_edges')} SELECT node_id, component FROM comp")
def components_of_orders(t):
    return K.components(C._nodes(t.order_edges), t.order_edges)


@query("n15_closeness_of_orders", CLOSENESS.replace("edges", "order_edges"))
def closeness_of_orders(t):
    e = cut(t.order_edges)
    return C.closeness(e, C.distance_sums(e)).select("node_id", F.round("closeness_centrality", 12).alias("closeness_centrality"))


@query("n7_shortest_paths_of_orders", f"WITH RECURSIVE {DIST.replace('edges', 'order_edges')} SELECT e.u, e.v, CAST(d.cost AS DOUBLE) AS cost FROM order_edges e JOIN d ON d.src = e.v AND d.node = e.u")
def shortest_of_orders(t):
    e = cut(t.order_edges)
    q = e.select("u", "v", F.concat_ws(">", "u", "v").alias("query"), F.col("v").alias("origin"), F.col("u").alias("destination"))
    return P.path_costs(e, q).join(q, "query").select("u", "v", "cost")
