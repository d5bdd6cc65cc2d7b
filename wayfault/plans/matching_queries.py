"""Queries on match responses and map matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfault.functions import geometry as G
from wayfault.operators import matching as M
from wayfault.plans.registry import adapter, query

adapter(
    "tracepoints",
    """SELECT trace_id, idx, CASE WHEN ok % 11 = 0 THEN NULL ELSE CAST(floor(idx / 4) AS INT) END AS matching_idx, CASE WHEN ok % 11 = 0 THEN NULL WHEN ok % 13 = 0 THEN CAST(idx % 4 + 1 AS INT) ELSE CAST(idx % 4 AS INT) END AS waypoint_idx,
       CASE WHEN ok % 17 = 0 THEN NULL ELSE CAST(ok % 360 - 180 AS DOUBLE) END AS x, CAST(ok % 170 - 85 AS DOUBLE) AS y, CAST(ok % 23 AS DOUBLE) AS distance
       FROM (SELECT o_custkey AS trace_id, o_orderkey AS ok, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS idx FROM orders)""",
)
adapter("trace_legs", "SELECT DISTINCT trace_id, CAST(floor(idx / 4) AS INT) AS matching_idx, CAST(idx % 4 AS INT) AS leg_idx, trace_id * 10 + idx AS first_node FROM tracepoints WHERE idx % 4 < 3")


@query(
    "m4_structure_violations",
    """WITH n AS (SELECT trace_id, matching_idx, count(*) AS n_legs FROM trace_legs GROUP BY 1, 2), p AS (SELECT t.*, coalesce(n_legs, 0) AS n_legs FROM tracepoints t LEFT JOIN n USING (trace_id, matching_idx) WHERE matching_idx IS NOT NULL),
w AS (SELECT *, lag(matching_idx) OVER o AS pm, lag(waypoint_idx) OVER o AS pw, lag(n_legs) OVER o AS pl, lead(idx) OVER o IS NULL AS is_last FROM p WINDOW o AS (PARTITION BY trace_id ORDER BY idx))
SELECT trace_id, idx, 'does not start at 0' AS problem FROM w WHERE pm IS NULL AND (matching_idx <> 0 OR waypoint_idx <> 0)
UNION ALL SELECT trace_id, idx, 'waypoint does not follow' FROM w WHERE matching_idx = pm AND waypoint_idx <> pw + 1
UNION ALL SELECT trace_id, idx, 'matching does not follow' FROM w WHERE matching_idx <> pm AND matching_idx <> pm + 1
UNION ALL SELECT trace_id, idx, 'matching does not start at waypoint 0' FROM w WHERE matching_idx <> pm AND waypoint_idx <> 0
UNION ALL SELECT trace_id, idx, 'matching before ended early' FROM w WHERE matching_idx <> pm AND pw <> pl
UNION ALL SELECT trace_id, idx, 'waypoint out of range' FROM w WHERE waypoint_idx < 0 OR waypoint_idx > n_legs
UNION ALL SELECT trace_id, idx, 'last matching ended early' FROM w WHERE is_last AND waypoint_idx <> n_legs""",
)
def structure(t):
    return M.structure_violations(t.tracepoints, t.trace_legs)


@query("w9_next_matched_point", "SELECT trace_id, idx, first(CASE WHEN matching_idx IS NOT NULL THEN y END IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_y FROM tracepoints")
def next_point(t):
    return M.next_points(t.tracepoints).select("trace_id", "idx", "next_y")


H = "(pow(sin((radians({y2}) - radians({y1})) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))"
HAV = f"(2 * 6378137.0 * asin(sqrt(least(1.0, {H}))) + 0 * {H})"  # the last term keeps nulls


@query(
    "w7_distance_along",
    f"""WITH s AS (SELECT trace_id, idx, CASE WHEN row_number() OVER o = 1 THEN coalesce({HAV.format(x1='lag(x) OVER o', y1='lag(y) OVER o', x2='x', y2='y')}, 0) ELSE {HAV.format(x1='lag(x) OVER o', y1='lag(y) OVER o', x2='x', y2='y')} END AS d FROM tracepoints WINDOW o AS (PARTITION BY trace_id ORDER BY idx))
SELECT trace_id, idx, CASE WHEN max(CASE WHEN d IS NULL THEN 1 ELSE 0 END) OVER o = 0 THEN round(sum(d) OVER o, 2) END AS distance_along FROM s WINDOW o AS (PARTITION BY trace_id ORDER BY idx ROWS UNBOUNDED PRECEDING)""",
)
def along(t):
    return M.along_feature(t.tracepoints).select("trace_id", "idx", F.round("distance_along", 2).alias("distance_along"))


@query("a11_tracepoint_stats", "SELECT trace_id, count(distance) AS n, round(avg(distance), 9) AS mean, round(stddev_samp(distance), 9) AS std, min(distance) AS low, quantile_cont(distance, 0.25) AS q25, quantile_cont(distance, 0.5) AS q50, quantile_cont(distance, 0.75) AS q75, max(distance) AS high FROM tracepoints GROUP BY trace_id")
def stats(t):
    return M.describe(t.tracepoints, "distance", ["trace_id"]).withColumn("mean", F.round("mean", 9)).withColumn("std", F.round("std", 9))


@query("a13_list_lengths", "SELECT trace_id, CAST(count(matching_idx) AS INT) AS n FROM tracepoints GROUP BY trace_id")
def lengths(t):
    return t.tracepoints.groupBy("trace_id").agg(F.coalesce(F.size(F.collect_list("matching_idx")), F.lit(0)).alias("n"))


@query("a14_total_bounds", "SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM tracepoints WHERE x IS NOT NULL")
def total_bounds(t):
    line = t.tracepoints.where("x IS NOT NULL").groupBy("trace_id").agg(F.collect_list(F.struct("x", "y")).alias("line"))
    b = G.bounds(F.col("line"))
    return line.agg(F.min(b["min_x"]).alias("min_x"), F.min(b["min_y"]).alias("min_y"), F.max(b["max_x"]).alias("max_x"), F.max(b["max_y"]).alias("max_y"))


def legs(t):
    nodes = F.array(F.col("first_node"), F.col("first_node") + 1, F.col("first_node") + 1 + F.col("leg_idx") % 2)
    return t.trace_legs.withColumn("nodes", nodes)


@query(
    "m5_node_chains",
    """WITH l AS (SELECT trace_id, matching_idx, leg_idx, first_node AS f FROM trace_legs), c AS (SELECT trace_id, matching_idx, list(f ORDER BY leg_idx) AS f FROM l GROUP BY 1, 2)
SELECT trace_id, matching_idx, CASE len(f) WHEN 1 THEN f[1] || ',' || (f[1] + 1) || ',' || (f[1] + 1) WHEN 2 THEN f[1] || ',' || (f[1] + 1) || ',' || (f[1] + 1) || ',' || (f[1] + 2) || ',' || (f[1] + 3)
ELSE f[1] || ',' || (f[1] + 1) || ',' || (f[1] + 1) || ',' || (f[1] + 2) || ',' || (f[1] + 3) || ',' || (f[1] + 3) END AS nodes FROM c""",
)
def chains(t):
    return M.node_chains(legs(t)).withColumn("nodes", F.array_join("nodes", ","))


#: The same points with waypoints in order, so that each leg has one start.
adapter("ordered_points", "SELECT trace_id, idx, matching_idx, CASE WHEN matching_idx IS NOT NULL THEN CAST(idx % 4 AS INT) END AS waypoint_idx, x, y, distance FROM tracepoints")


def _foot(x: str, y: str, p: str) -> str:
    """SQL of the foot of a point on the segment u-v, in degrees: columns ``{p}x, {p}y``."""
    t = f"CASE WHEN dx * dx + dy * dy = 0 OR ({x} - ux) * dx + ({y} - uy) * dy <= 0 THEN 0.0 WHEN ({x} - ux) * dx + ({y} - uy) * dy >= dx * dx + dy * dy THEN 1.0 ELSE (({x} - ux) * dx + ({y} - uy) * dy) / (dx * dx + dy * dy) END"
    return f"CASE {t} WHEN 0 THEN ux WHEN 1 THEN vx ELSE ux + {t} * dx END AS {p}x, CASE {t} WHEN 0 THEN uy WHEN 1 THEN vy ELSE uy + {t} * dy END AS {p}y"


def _known(over: str) -> str:
    return f"CASE WHEN max(CASE WHEN segment_length_m IS NULL THEN 1 ELSE 0 END) OVER {over} = 0 THEN sum(segment_length_m) OVER {over} END"


SEGMENTS = f"""nxt AS (SELECT trace_id, matching_idx, waypoint_idx AS leg_idx, x, y, lead(x) OVER o AS next_x, lead(y) OVER o AS next_y FROM ordered_points WHERE matching_idx IS NOT NULL WINDOW o AS (PARTITION BY trace_id ORDER BY idx)),
pieces AS (SELECT trace_id, matching_idx, leg_idx, CAST(0 AS INT) AS leg_segment_idx, first_node AS u, first_node + 1 AS v FROM trace_legs UNION ALL SELECT trace_id, matching_idx, leg_idx, 1, first_node + 1, first_node + 1 + leg_idx % 2 FROM trace_legs),
placed AS (SELECT *, vx - ux AS dx, vy - uy AS dy FROM (SELECT p.*, CAST(u % 360 - 180 AS DOUBLE) AS ux, CAST(u % 170 - 85 AS DOUBLE) AS uy, CAST(v % 360 - 180 AS DOUBLE) AS vx, CAST(v % 170 - 85 AS DOUBLE) AS vy, x, y, next_x, next_y FROM pieces p LEFT JOIN nxt USING (trace_id, matching_idx, leg_idx))),
feet AS (SELECT *, {_foot('x', 'y', 'b')}, {_foot('next_x', 'next_y', 'f')} FROM placed),
ends AS (SELECT *, CASE leg_segment_idx WHEN 0 THEN bx ELSE ux END AS sx, CASE leg_segment_idx WHEN 0 THEN b_y ELSE uy END AS sy, CASE leg_segment_idx WHEN 1 THEN fx ELSE vx END AS ex, CASE leg_segment_idx WHEN 1 THEN fy ELSE vy END AS ey FROM (SELECT * EXCLUDE ("by"), "by" AS b_y FROM feet)),
lens AS (SELECT *, {HAV.format(x1='sx', y1='sy', x2='ex', y2='ey')} AS segment_length_m, {HAV.format(x1='ux', y1='uy', x2='sx', y2='sy')} AS start_offset_m, {HAV.format(x1='ex', y1='ey', x2='vx', y2='vy')} AS end_offset_m FROM ends),
segs AS (SELECT *, {_known('l')} AS leg_cumulative_m, {_known('m')} AS matching_cumulative_m FROM lens WINDOW l AS (PARTITION BY trace_id, matching_idx, leg_idx ORDER BY leg_segment_idx ROWS UNBOUNDED PRECEDING), m AS (PARTITION BY trace_id, matching_idx ORDER BY leg_idx, leg_segment_idx ROWS UNBOUNDED PRECEDING))"""


def segments(t):
    nodes = legs(t).select(F.explode("nodes").alias("node_id")).distinct()
    nodes = nodes.select("node_id", (F.col("node_id") % 360 - 180).cast("double").alias("x"), (F.col("node_id") % 170 - 85).cast("double").alias("y"))
    return M.leg_segments(t.ordered_points, legs(t), nodes)


@query("m7_leg_segments", f"WITH {SEGMENTS} SELECT trace_id, matching_idx, leg_idx, leg_segment_idx, u, v, round(sx, 6) AS sx, round(ey, 6) AS ey, round(segment_length_m, 2) AS segment_length_m, round(start_offset_m, 2) AS start_offset_m, round(end_offset_m, 2) AS end_offset_m FROM segs")
def leg_segments(t):
    rounded = [F.round(c, n).alias(c) for c, n in (("sx", 6), ("ey", 6), ("segment_length_m", 2), ("start_offset_m", 2), ("end_offset_m", 2))]
    return segments(t).select("trace_id", "matching_idx", "leg_idx", "leg_segment_idx", "u", "v", *rounded)


ALONG = f"""steps AS (SELECT trace_id, idx, matching_idx, waypoint_idx, CASE WHEN row_number() OVER o = 1 THEN 0 ELSE {HAV.format(x1='lag(x) OVER o', y1='lag(y) OVER o', x2='x', y2='y')} END AS d FROM ordered_points WINDOW o AS (PARTITION BY trace_id ORDER BY idx)),
along AS (SELECT trace_id, matching_idx, waypoint_idx AS leg_idx, CASE WHEN max(CASE WHEN d IS NULL THEN 1 ELSE 0 END) OVER o = 0 THEN sum(d) OVER o END AS distance_along FROM steps WINDOW o AS (PARTITION BY trace_id ORDER BY idx ROWS UNBOUNDED PRECEDING))"""


@query(
    "m10_match_rows",
    f"""WITH {SEGMENTS}, {ALONG}, r AS (SELECT segs.*, distance_along + leg_cumulative_m AS e, distance_along + leg_cumulative_m - segment_length_m AS s, CAST(trace_id % 4 AS INT) AS direction, trace_id % 3 = 0 AS reversed_input
 FROM segs LEFT JOIN (SELECT * FROM along WHERE matching_idx IS NOT NULL) USING (trace_id, matching_idx, leg_idx))
SELECT trace_id, matching_idx, leg_idx, leg_segment_idx, u AS osm_u, v AS osm_v, trace_id % 50 AS route_id, direction, reversed_input, CAST(0.9 AS DOUBLE) AS matching_confidence,
 round(CASE WHEN reversed_input AND direction IN (2, 3) THEN 1e6 - s WHEN reversed_input THEN e ELSE s END, 1) AS start_m, round(CASE WHEN reversed_input AND direction IN (2, 3) THEN 1e6 - e WHEN reversed_input THEN s ELSE e END / 1609.34, 3) AS end_mi FROM r""",
)
def rows(t):
    features = t.tracepoints.groupBy("trace_id").agg(F.lit(1e6).alias("length_m")).select("trace_id", (F.col("trace_id") % 50).alias("route_id"), (F.col("trace_id") % 4).cast("int").alias("direction"), (F.col("trace_id") % 3 == 0).alias("reversed_input"), "length_m")
    confidence = t.trace_legs.select("trace_id", "matching_idx").distinct().withColumn("confidence", F.lit(0.9))
    got = M.match_rows(segments(t), t.ordered_points, features, confidence)
    return got.select("trace_id", "matching_idx", "leg_idx", "leg_segment_idx", "osm_u", "osm_v", "route_id", "direction", "reversed_input", "matching_confidence", F.round("start_dist_along_m", 1).alias("start_m"), F.round("end_dist_along_mi", 3).alias("end_mi"))


@query("m3_feature_metadata", f"SELECT trace_id, CAST(count(*) AS INT) AS n_points, CASE WHEN count(*) > 1 THEN round(sum(d), 2) ELSE -1 END AS length_m FROM (SELECT trace_id, {HAV.format(x1='lag(x) OVER o', y1='lag(y) OVER o', x2='x', y2='y')} AS d FROM tracepoints WHERE x IS NOT NULL WINDOW o AS (PARTITION BY trace_id ORDER BY idx)) GROUP BY trace_id")
def metadata(t):
    return M.feature_metadata(features(t)).select("trace_id", "n_points", F.round("length_m", 2).alias("length_m"))


def features(t):
    line = t.tracepoints.where("x IS NOT NULL").groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("idx", "x", "y"))).alias("l"))
    return line.select("trace_id", F.array(F.transform("l", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))).alias("parts"))


@query("m1_flattened_features", "SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY idx) - 1 AS INT) AS idx, x, y FROM tracepoints WHERE x IS NOT NULL")
def flattened(t):
    return M.trace_points(features(t))


@query("s14_parsed_responses", "SELECT trace_id, idx, CASE WHEN x IS NOT NULL THEN matching_idx END AS matching_idx, CASE WHEN matching_idx IS NOT NULL THEN x END AS x FROM tracepoints WHERE trace_id % 5 > 0")
def parsed(t):
    return M.parse_responses(bodies(t))[0].select("trace_id", "idx", "matching_idx", "x")


def bodies(t):
    """A stored response of each trace: all its points, those without a match or a place as null."""
    point = F.when(
        F.col("x").isNotNull() & F.col("matching_idx").isNotNull(),
        F.struct(F.array("x", "y").alias("location"), "distance", F.col("matching_idx").alias("matchings_index"), F.col("waypoint_idx").alias("waypoint_index")),
    )
    listed = t.tracepoints.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("idx", point.alias("p")))).alias("l"))
    whole = F.struct(F.when(F.col("trace_id") % 5 > 0, "Ok").otherwise("NoMatch").alias("code"), F.col("l.p").alias("tracepoints"), F.array().cast("array<string>").alias("matchings"))
    return listed.select("trace_id", F.to_json(whole).alias("body"))


@query("m2_response_errors", "SELECT DISTINCT trace_id, 'NoMatch' AS code FROM tracepoints WHERE trace_id % 5 = 0")
def errors(t):
    return M.parse_responses(bodies(t))[3].select("trace_id", "code")


@query("m10_first_success", "SELECT id, min(attempt) AS attempt FROM (SELECT o_orderkey AS id, 0 AS attempt FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 AND o_orderkey % 4 <> 1 AND o_orderkey % 4 < 1) GROUP BY id")
def success(t):
    f = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).cast("int").alias("direction"), F.array(F.lit(1), F.lit(2)).alias("coordinates"))
    tried = M.attempts(f).withColumn("ok", F.when(F.col("attempt") == 0, F.col("id") % 2 == 0).otherwise(F.col("id") % 3 == 0))
    return M.first_success(tried, ["id"]).select("id", "attempt")


# -- a lattice of streets and traces along it
def lattice(t):
    n = t.spark.range(0, 20)
    xy = n.select(F.col("id").alias("i")).crossJoin(n.select(F.col("id").alias("j")))  # a fixed lattice of 20 x 20 nodes
    node = lambda i, j: (i * 100 + j).cast("long")
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    e = xy.select("i", "j", step.alias("s")).where((F.col("i") + F.col("s.a")).between(0, 19) & (F.col("j") + F.col("s.b")).between(0, 19))
    k = 100.0
    return e.select(node(F.col("i"), F.col("j")).alias("u"), node(F.col("i") + F.col("s.a"), F.col("j") + F.col("s.b")).alias("v"), F.lit(0).cast("long").alias("key"), (F.col("i") * k).alias("x1"), (F.col("j") * k).alias("y1"), ((F.col("i") + F.col("s.a")) * k).alias("x2"), ((F.col("j") + F.col("s.b")) * k).alias("y2"))


def lattice_traces(t):
    c = t.customer.select(F.col("c_custkey").alias("trace_id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("idx"))
    r = F.col("trace_id") * 7 % 15
    turn = F.when(F.col("idx") < 5, F.col("idx")).otherwise(5)
    return c.select("trace_id", "idx", (r * 100.0 + 30 + turn * 80 + F.col("trace_id") % 5).alias("x"), ((F.col("trace_id") % 12) * 100.0 + F.when(F.col("idx") > 5, (F.col("idx") - 5) * 80).otherwise(0) + F.col("idx") % 3).alias("y"))


@query("m0_map_match")
def map_match(t):
    return M.match(lattice_traces(t), lattice(t), reach=300.0)


CANDIDATES = """WITH n AS (SELECT range AS i FROM range(20)), s(a, b) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)),
e AS (SELECT p.i * 100 + q.i AS u, (p.i + a) * 100 + q.i + b AS v, CAST(p.i * 100 AS DOUBLE) AS x1, CAST(q.i * 100 AS DOUBLE) AS y1, a, b FROM n p, n q, s WHERE p.i + a BETWEEN 0 AND 19 AND q.i + b BETWEEN 0 AND 19),
p AS (SELECT c_custkey AS trace_id, CAST(range AS INT) AS idx, CAST(c_custkey * 7 % 15 * 100 + 30 + least(range, 5) * 80 + c_custkey % 5 AS DOUBLE) AS x,
      CAST(c_custkey % 12 * 100 + CASE WHEN range > 5 THEN (range - 5) * 80 ELSE 0 END + range % 3 AS DOUBLE) AS y FROM customer, range(10)),
c AS (SELECT *, least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), ((x - x1) * a + (y - y1) * b) / 100)) AS t FROM p, e),
d AS (SELECT *, sqrt(pow(x - x1 - 100 * a * t, 2) + pow(y - y1 - 100 * b * t, 2)) AS distance FROM c)"""


@query("m0_candidates", f"{CANDIDATES} SELECT trace_id, count(*) AS n, round(sum(distance), 4) AS distance FROM d WHERE distance <= 15 GROUP BY trace_id")
def candidates_of_traces(t):
    found = M.candidates(lattice_traces(t), lattice(t))
    return found.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("distance"), 4).alias("distance"))


@query("m0_candidate_rows", f"{CANDIDATES} SELECT trace_id, idx, u, v, CAST(0 AS BIGINT) AS key, round(distance, 6) AS distance, round(t, 6) AS t FROM d WHERE distance <= 15")
def candidate_rows(t):
    found = M.candidates(lattice_traces(t), lattice(t))
    return found.select("trace_id", "idx", "u", "v", "key", F.round("distance", 6).alias("distance"), F.round("t", 6).alias("t"))


@query("g17_frechet", "SELECT s_suppkey, CAST(3 * (s_suppkey % 5) AS DOUBLE) AS frechet FROM supplier")
def frechet(t):
    line = lambda d: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(i.cast("double").alias("x"), (F.col("s_suppkey") % 5 * i * d).cast("double").alias("y")))
    return M.frechet(t.supplier.select("s_suppkey", line(1).alias("a"), line(2).alias("b")), "a", "b").select("s_suppkey", "frechet")


# -- geometry
@query("g4b_sphere_distance", f"SELECT trace_id, idx, round({HAV.format(x1='x', y1='y', x2='x + 1', y2='y / 2')}, 3) AS metres FROM tracepoints")
def sphere(t):
    return t.tracepoints.select("trace_id", "idx", F.round(G.sphere_distance(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") / 2), 3).alias("metres"))


NOT_OPPOSITE = "x IS NOT NULL AND NOT (x = -175 AND y = -40)"  # the one point that an azimuthal projection cannot show


@query("g2_projection_round_trip", f"SELECT trace_id, idx, x, y FROM tracepoints WHERE {NOT_OPPOSITE}")
def projection(t):
    p = t.tracepoints.where(NOT_OPPOSITE).withColumn("p", G.laea(F.col("x"), F.col("y"), 5.0, 40.0))
    back = G.laea_inverse(F.col("p.x"), F.col("p.y"), 5.0, 40.0)
    turn = F.pmod(F.round("b.x", 4) + 180, F.lit(360.0)) - 180  # 180 west is 180 east
    return p.withColumn("b", back).select("trace_id", "idx", turn.alias("x"), F.round("b.y", 4).alias("y"))


def _q(sine: str) -> str:
    """SQL of the authalic function of a sine, on the ellipsoid of WGS 84."""
    return f"((1 - 0.0066943799901413165) * ({sine} / (1 - 0.0066943799901413165 * {sine} * {sine}) + ln((1 + 0.08181919084262149 * {sine}) / (1 - 0.08181919084262149 * {sine})) / (2 * 0.08181919084262149)))"


@query(
    "g2_projected",
    f"""WITH c AS (SELECT asin({_q("sin(radians(40))")} / {_q("1.0")}) AS b0, 6378137.0 * sqrt({_q("1.0")} / 2) AS r, cos(radians(40)) / sqrt(1 - 0.0066943799901413165 * pow(sin(radians(40)), 2)) * 6378137.0 AS m),
p AS (SELECT trace_id, idx, radians(x - 5) AS l, asin({_q("sin(radians(y))")} / {_q("1.0")}) AS b, b0, r, m / (r * cos(b0)) AS d FROM tracepoints, c WHERE {NOT_OPPOSITE}),
k AS (SELECT *, r * sqrt(2 / (1 + sin(b0) * sin(b) + cos(b0) * cos(b) * cos(l))) AS k FROM p)
SELECT trace_id, idx, round(k * d * cos(b) * sin(l), 1) AS east, round(k / d * (cos(b0) * sin(b) - sin(b0) * cos(b) * cos(l)), 1) AS north FROM k""",
)
def projected(t):
    p = t.tracepoints.where(NOT_OPPOSITE).withColumn("p", G.laea(F.col("x"), F.col("y"), 5.0, 40.0))
    return p.select("trace_id", "idx", F.round("p.x", 1).alias("east"), F.round("p.y", 1).alias("north"))


@query(
    "g7_along_bend",
    """WITH f AS (SELECT event_id, x, y, least(greatest(x, 0), 500) AS f1, least(greatest(y, 0), 400) AS f2 FROM event_points),
d AS (SELECT *, pow(x - f1, 2) + y * y AS d1, pow(x - 500, 2) + pow(y - f2, 2) AS d2 FROM f), a AS (SELECT event_id, CASE WHEN d1 <= d2 THEN f1 ELSE 500 + f2 END AS along FROM d)
SELECT event_id, CAST(along AS DOUBLE) AS along, round(least(along, 500), 6) AS x, round(greatest(along - 500, 0), 6) AS y FROM a""",
)
def along_bend(t):
    """A line with a bend: 500 to the east, then 400 to the north."""
    line = F.array(G.point(F.lit(0), F.lit(0)), G.point(F.lit(500), F.lit(0)), G.point(F.lit(500), F.lit(400)))
    rows = t.event_points.withColumn("along", G.locate(F.col("x"), F.col("y"), line))
    at = G.interpolate(line, F.col("along") / 900)
    return rows.select("event_id", "along", F.round(at["x"], 6).alias("x"), F.round(at["y"], 6).alias("y"))


@query("g7_locate_and_interpolate", "SELECT s_suppkey, CAST(least(s_suppkey % 12, 10) AS DOUBLE) AS along, CAST(2 + least(s_suppkey % 12, 10) AS DOUBLE) AS x FROM supplier")
def locate(t):
    line = F.array(G.point(F.lit(2), F.lit(1)), G.point(F.lit(12), F.lit(1)))
    at = G.locate((2 + F.col("s_suppkey") % 12).cast("double"), F.lit(5.0), line)
    return t.supplier.select("s_suppkey", at.alias("along"), G.interpolate(line, at / 10)["x"].alias("x"))


@query("g6_shortest_line", "SELECT s_suppkey, CAST(least(s_suppkey % 12, 10) AS DOUBLE) AS fx, CAST(4 AS DOUBLE) AS metres FROM supplier")
def shortest_line(t):
    line = F.array(G.point(F.lit(0), F.lit(1)), G.point(F.lit(10), F.lit(1)))
    x = F.least(F.col("s_suppkey") % 12, F.lit(10)).cast("double")
    return t.supplier.select("s_suppkey", G.shortest_line(x, F.lit(5.0), line)[0]["x"].alias("fx"), G.distance(x, F.lit(5.0), line).alias("metres"))


@query("g3_buffered_region", "SELECT s_suppkey, (s_suppkey % 10) * 1000.0 <= 3218.688 AS inside FROM supplier")
def buffered(t):
    from wayfault.operators.spatial_join import polygon_literal

    box = polygon_literal([[(-500, -500), (0, -500), (0, 500), (-500, 500), (-500, -500)]])
    return t.supplier.select("s_suppkey", G.within_miles((F.col("s_suppkey") % 10 * 1000.0), F.lit(0.0), box, 2.0).alias("inside"))


@query("g13_substring", "SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 5 + 1 > s_suppkey % 3 THEN s_suppkey % 5 + 2 - s_suppkey % 3 END AS INT) AS n FROM supplier")
def substring(t):
    line = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: G.point(i, i))
    cut = G.substring(line, (F.col("s_suppkey") % 3).cast("int"), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return t.supplier.select("s_suppkey", F.when(cut.isNotNull(), F.size(cut)).alias("n"))


@query("g12_reverse", "SELECT s_suppkey, CAST(s_suppkey AS DOUBLE) AS x FROM supplier")
def reverse(t):
    return t.supplier.select("s_suppkey", G.reverse_line(F.array(G.point(F.lit(0), F.lit(0)), G.point(F.col("s_suppkey"), F.lit(0))))[0]["x"].alias("x"))


@query(
    "g11_simple_parts",
    """SELECT s_suppkey AS u, part_idx, start_idx, end_idx FROM supplier JOIN (VALUES (0, 0, 0, 3), (1, 0, 0, 3), (1, 1, 3, 4), (2, 0, 0, 2), (2, 1, 2, 3), (3, 0, 0, 1), (3, 1, 1, 2)) p(kind, part_idx, start_idx, end_idx) ON s_suppkey % 4 = kind""",
)
def simple_parts(t):
    """A plain line, a ring, a line that crosses itself, and one that runs back over itself."""
    from wayfault.operators.spans import split_simple

    lines = [[(0, 0), (1, 0), (1, 1), (3, 1)], [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)], [(0, 0), (2, 2), (2, 0), (0, 2)], [(0, 0), (2, 0), (1, 0)]]
    at = F.array(*[F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in line]) for line in lines])
    edges = t.supplier.select(F.col("s_suppkey").alias("u"), F.lit(0).alias("v"), F.lit(0).alias("key"), F.get(at, (F.col("s_suppkey") % 4).cast("int")).alias("geometry"))
    return split_simple(edges).select("u", "part_idx", "start_idx", "end_idx")
