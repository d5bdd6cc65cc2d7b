"""Queries on incident events: filters, intervals, windows, categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfault.functions import scalars as S
from wayfault.operators import intervals as I
from wayfault.operators import spatial_join as J
from wayfault.plans.registry import adapter, query

adapter(
    "incidents",
    """SELECT user_id AS u, user_id % 7 AS v, CAST(0 AS BIGINT) AS key, CAST(event_id AS STRING) AS event_id, ts AS start_date_time,
       CASE WHEN event_id % 11 = 0 THEN '2 hours' ELSE NULL END AS event_interval, CAST(floor(value) AS BIGINT) * 10 AS estimated_duration_mins,
       CASE WHEN event_id % 3 = 0 THEN 'all lanes affected' WHEN event_id % 3 = 1 THEN 'left lane' ELSE NULL END AS lanes_detail,
       CASE WHEN event_id % 4 = 0 THEN 'Closed' WHEN event_id % 4 = 1 THEN 'partly blocked' ELSE 'open' END AS lanes_status,
       CASE event_type WHEN 'error' THEN 'Weather Hazard' WHEN 'purchase' THEN 'Construction' WHEN 'click' THEN 'MAINTENANCE' ELSE 'incident' END AS sub_category,
       CASE WHEN event_id % 5 = 0 THEN 'Flood repair' WHEN event_id % 5 = 1 THEN 'work on Washout Road' WHEN event_id % 5 = 2 THEN 'Washout Rd washout repair'
            WHEN event_id % 5 = 3 THEN 'washout rd and WASHOUT road' ELSE NULL END AS description
       FROM events""",
)

RELEVANT = """(upper(sub_category) = 'WEATHER HAZARD' OR (upper(sub_category) IN ('CONSTRUCTION', 'MAINTENANCE')
 AND regexp_matches(regexp_replace(description, '(washout rd)|(washout road)', '', 'i'), 'flood|washout', 'i')))"""
END = "start_date_time + coalesce(CAST(event_interval AS INTERVAL), to_minutes(estimated_duration_mins))"
COLLECTED = f"""collected AS (SELECT u, v, key, event_id, start_date_time AS s, {END} AS e,
 (lanes_detail ILIKE '%ALL LANES%' AND (lanes_status ILIKE '%CLOSED%' OR lanes_status ILIKE '%BLOCKED%')) AS closed,
 upper(sub_category) = 'WEATHER HAZARD' AS flooded, upper(sub_category) IN ('CONSTRUCTION', 'MAINTENANCE') AS repairs FROM incidents WHERE {RELEVANT})"""


def _hours(name: str, where: str) -> str:
    """SQL for ``outage_hours`` over the collected events, by sweeping end points: intervals that are open are counted, and an island ends where none is.

    ``{name}_d`` are the distinct intervals, ``{name}_m`` the islands that last, ``{name}_g`` all islands with the number of their intervals.
    """
    same = "m.u = d.u AND m.v = d.v AND m.key = d.key AND d.s BETWEEN m.ms AND m.me"
    return f"""{name}_d AS (SELECT DISTINCT u, v, key, event_id, s, e FROM collected WHERE {where}),
{name}_p AS (SELECT u, v, key, s AS moment, 1 AS step FROM {name}_d WHERE e > s UNION ALL SELECT u, v, key, e, -1 FROM {name}_d WHERE e > s),
{name}_o AS (SELECT u, v, key, moment, sum(sum(step)) OVER (PARTITION BY u, v, key ORDER BY moment) AS still_open FROM {name}_p GROUP BY u, v, key, moment),
{name}_c AS (SELECT *, count(*) FILTER (still_open = 0) OVER (PARTITION BY u, v, key ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closings FROM {name}_o),
{name}_m AS (SELECT u, v, key, min(moment) AS ms, max(moment) AS me FROM {name}_c GROUP BY u, v, key, closings),
{name}_w AS (SELECT m.u, m.v, m.key, m.ms, m.me, list(d.event_id) AS ids FROM {name}_m m JOIN {name}_d d ON {same} GROUP BY m.u, m.v, m.key, m.ms, m.me),
{name}_g AS (SELECT *, row_number() OVER (PARTITION BY u, v, key ORDER BY first_start) AS island_id FROM (SELECT u, v, key, ms AS first_start, me AS last_end, len(ids) AS n FROM {name}_w
 UNION ALL SELECT u, v, key, s, max(e), count(*) FROM {name}_d d WHERE NOT EXISTS (SELECT 1 FROM {name}_m m WHERE {same}) GROUP BY u, v, key, s)),
{name} AS (SELECT u, v, key, list_sort(flatten(list(ids))) AS ids, count(*) AS n, round(sum(epoch(me) - epoch(ms)) / 3600.0, 2) AS hours FROM {name}_w GROUP BY u, v, key)"""


def collected(t):
    pairs = t.incidents.select("u", "v", "key", "event_id")
    return I.collected_events(pairs, t.incidents.drop("u", "v", "key"))


@query("a2_outage_hours", f"WITH {COLLECTED}, {_hours('x', 'true')} SELECT u, v, key, array_to_string(ids, ',') AS ids, n AS n_intervals, hours FROM x")
def outage_hours(t):
    got = I.outage_hours(collected(t), I.EDGE, "start_ts", "end_ts", "event_id")
    return got.withColumn("ids", F.array_join("ids", ","))


def intervals_of(t):
    return collected(t).select(*I.EDGE, "event_id", "start_ts", "end_ts").distinct()


@query("w4_islands", f"WITH {COLLECTED}, {_hours('x', 'true')} SELECT u, v, key, CAST(island_id AS BIGINT) AS island_id, CAST(n AS BIGINT) AS n, first_start, last_end FROM x_g")
def island_table(t):
    rows = I.islands(intervals_of(t), I.EDGE, "start_ts", "end_ts")
    return rows.groupBy(*I.EDGE, "island_id").agg(F.count(F.lit(1)).alias("n"), F.min("start_ts").alias("first_start"), F.max("end_ts").alias("last_end"))


STARTS = "starts AS (SELECT u, v, key, s, count(*) AS n, count(e) AS known FROM x_d GROUP BY u, v, key, s)"


@query("w1_running_end", f"WITH {COLLECTED}, {_hours('x', 'true')}, {STARTS} SELECT a.u, a.v, a.key, a.s AS start_ts, max(b.e) AS running_end FROM starts a JOIN x_d b ON a.u = b.u AND a.v = b.v AND a.key = b.key AND b.s <= a.s GROUP BY a.u, a.v, a.key, a.s")
def running_end(t):
    return I.running_end(intervals_of(t), I.EDGE, "start_ts", "end_ts")


@query(
    "w2_previous_end",
    f"""WITH {COLLECTED}, {_hours('x', 'true')}, {STARTS}, p AS (SELECT a.u, a.v, a.key, a.s AS start_ts, a.n, a.known, coalesce(max(b.e), TIMESTAMP '1970-01-01') AS previous_end
FROM starts a LEFT JOIN x_d b ON a.u = b.u AND a.v = b.v AND a.key = b.key AND b.s < a.s GROUP BY a.u, a.v, a.key, a.s, a.n, a.known)
SELECT u, v, key, start_ts, previous_end, CASE WHEN start_ts > previous_end AND (n = 1 OR known = 0) THEN 1 ELSE 0 END AS begins FROM p""",
)
def previous_end(t):
    return I.previous_end(intervals_of(t), I.EDGE, "start_ts", "end_ts")


@query(
    "a1_merged_intervals",
    f"""WITH {COLLECTED}, {_hours('x', 'true')} SELECT u, v, key, CAST(g.island_id AS BIGINT) AS island_id, array_to_string(list_sort(w.ids), ',') AS ids, w.ms AS merged_start, w.me AS merged_end
FROM x_w w JOIN x_g g USING (u, v, key) WHERE g.first_start = w.ms""",
)
def merged(t):
    got = I.merged_intervals(intervals_of(t), I.EDGE, "start_ts", "end_ts", "event_id")
    return got.withColumn("ids", F.array_join(F.array_sort("ids"), ","))


@query(
    "j2_hours_by_category",
    f"""WITH {COLLECTED}, {_hours('x', 'true')}, {_hours('b', 'closed')}, {_hours('c', 'flooded')}, {_hours('d', 'repairs')}
SELECT x.u, x.v, x.key, array_to_string(x.ids, ',') AS all_events_ids, x.n AS all_incidents_count, x.hours AS all_total_duration_hours,
 coalesce(array_to_string(b.ids, ','), '') AS road_closed_events_ids, coalesce(b.n, 0) AS road_closed_incidents_count, coalesce(b.hours, 0) AS road_closed_total_duration_hours,
 coalesce(array_to_string(c.ids, ','), '') AS road_flooded_events_ids, coalesce(c.n, 0) AS road_flooded_incidents_count, coalesce(c.hours, 0) AS road_flooded_total_duration_hours,
 coalesce(array_to_string(d.ids, ','), '') AS road_repairs_events_ids, coalesce(d.n, 0) AS road_repairs_incidents_count, coalesce(d.hours, 0) AS road_repairs_total_duration_hours
FROM x LEFT JOIN b USING (u, v, key) LEFT JOIN c USING (u, v, key) LEFT JOIN d USING (u, v, key) ORDER BY x.u, x.v, x.key DESC""",
)
def by_category(t):
    out = I.hours_by_category(collected(t))
    names = ["all_events_ids", *[f"{c}_events_ids" for c in I.CATEGORIES]]
    out = out.withColumnRenamed("all_incidents_count", "all_incidents_count").withColumnsRenamed({"all_total_duration_hours": "all_total_duration_hours"})
    return out.withColumns({n: F.array_join(n, ",") for n in names}).orderBy("u", "v", F.desc("key"))


@query("p3_relevant_events", f"SELECT event_id, sub_category, description FROM incidents WHERE {RELEVANT}")
def relevant(t):
    return t.incidents.where(S.relevant_event(F.col("sub_category"), F.col("description"))).select("event_id", "sub_category", "description")


@query(
    "p4_event_flags",
    """SELECT event_id, (lanes_detail ILIKE '%ALL LANES%' AND (lanes_status ILIKE '%CLOSED%' OR lanes_status ILIKE '%BLOCKED%')) AS event_closed_road,
 upper(sub_category) = 'WEATHER HAZARD' AS road_flooded, upper(sub_category) IN ('CONSTRUCTION', 'MAINTENANCE') AS road_repairs FROM incidents""",
)
def flags(t):
    c = F.upper("sub_category")
    return t.incidents.select("event_id", S.closed_road(F.col("lanes_detail"), F.col("lanes_status")).alias("event_closed_road"), (c == "WEATHER HAZARD").alias("road_flooded"), c.isin("CONSTRUCTION", "MAINTENANCE").alias("road_repairs"))


@query("f22_event_end", f"SELECT event_id, start_date_time AS start_ts, {END} AS end_ts FROM incidents")
def ends(t):
    return t.incidents.select("event_id", F.col("start_date_time").alias("start_ts"), S.event_end(F.col("start_date_time"), F.col("event_interval"), F.col("estimated_duration_mins")).alias("end_ts"))


@query("j1_pairs_with_events", f"WITH {COLLECTED} SELECT event_id, u, v, key, s AS start_ts, e AS end_ts FROM collected")
def pairs_with_events(t):
    return collected(t).select("event_id", "u", "v", "key", "start_ts", "end_ts")


@query("o2_order", "SELECT DISTINCT u, v, key FROM incidents ORDER BY u, v, key DESC")
def ordered(t):
    return t.incidents.select("u", "v", "key").distinct().orderBy("u", "v", F.desc("key"))


# -- pairing of events with two kinds of spans
adapter(
    "event_points",
    "SELECT event_id, CAST(event_id * 37 % 1009 AS DOUBLE) AS x, CAST(event_id * 53 % 997 AS DOUBLE) AS y FROM events",
)
adapter(
    "span_lines",
    """SELECT p_partkey AS u, p_partkey + 1 AS v, CAST(0 AS BIGINT) AS key, CAST(p_size % 3 AS INT) AS span_idx, p_size % 4 = 0 AS bridge,
       CAST(p_partkey * 41 % 1000 AS DOUBLE) AS x1, CAST(p_partkey * 59 % 980 AS DOUBLE) AS y1,
       CAST(p_partkey * 41 % 1000 + p_size AS DOUBLE) AS x2, CAST(p_partkey * 59 % 980 + 50 - p_size AS DOUBLE) AS y2 FROM part""",
)
#: Squared distance of a point to a segment, exact in whole numbers up to the projection's quotient.
SEGMENT = """CASE WHEN (x - x1) * (x2 - x1) + (y - y1) * (y2 - y1) <= 0 THEN (x - x1) * (x - x1) + (y - y1) * (y - y1)
 WHEN (x - x1) * (x2 - x1) + (y - y1) * (y2 - y1) >= (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) THEN (x - x2) * (x - x2) + (y - y2) * (y - y2)
 ELSE ((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)) * ((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) END"""
WITHIN = 12.5


def spans(t):
    p = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    return t.span_lines.withColumn("line", F.array(p("x1", "y1"), p("x2", "y2"))).drop("x1", "y1", "x2", "y2")


@query("j7_dwithin", f"SELECT u, v, key, span_idx, event_id, round(sqrt({SEGMENT}), 6) AS distance FROM span_lines, event_points WHERE {SEGMENT} <= {WITHIN * WITHIN}")
def dwithin(t):
    got = J.within_distance(spans(t), t.event_points, WITHIN, ["u", "v", "key", "span_idx"], ["event_id"], digits=6)
    return got.select("u", "v", "key", "span_idx", "event_id", "distance")


TWO_PASS = f"""a AS (SELECT u, v, key, span_idx, event_id, 'NONBRIDGE' AS kind FROM span_lines, event_points WHERE NOT bridge AND {SEGMENT} <= {WITHIN * WITHIN}),
rest AS (SELECT * FROM event_points WHERE event_id NOT IN (SELECT event_id FROM a)),
b AS (SELECT u, v, key, span_idx, event_id, 'BRIDGE' AS kind FROM span_lines, rest WHERE bridge AND {SEGMENT} <= {WITHIN * WITHIN}),
pairs AS (SELECT * FROM a UNION ALL SELECT * FROM b)"""


def two_pass(t):
    s = spans(t)
    return J.two_pass_pairs(s.where("not bridge"), s.where("bridge"), t.event_points, WITHIN, ["u", "v", "key", "span_idx"], ["event_id"])


def two_pass_kinds(t):
    s = spans(t)
    return J.two_pass_kinds(s.where("not bridge"), s.where("bridge"), t.event_points, WITHIN, ["event_id"])


@query("j8_two_pass_pairing", f"WITH {TWO_PASS} SELECT u, v, key, span_idx, event_id, kind AS road_span_type FROM pairs")
def two_pass_pairing(t):
    return two_pass(t).select("u", "v", "key", "span_idx", "event_id", "road_span_type")


@query("j8_unpaired_events", f"WITH {TWO_PASS} SELECT event_id FROM event_points WHERE event_id NOT IN (SELECT event_id FROM pairs)")
def unpaired(t):
    return t.event_points.join(two_pass_kinds(t), "event_id", "left_anti").select("event_id")


@query(
    "a4_paired_with",
    f"WITH {TWO_PASS} SELECT e.event_id, p.event_id IS NOT NULL AS was_paired, CASE WHEN p.n = 2 THEN 'BOTH' ELSE p.kind END AS paired_with FROM event_points e LEFT JOIN (SELECT event_id, count(DISTINCT kind) AS n, min(kind) AS kind FROM pairs GROUP BY 1) p ON e.event_id = p.event_id",
)
def paired_with(t):
    return J.pairing_summary(t.event_points, two_pass_kinds(t), "event_id").select("event_id", "was_paired", "paired_with")


@query("u1_concat_disjoint", f"WITH {TWO_PASS} SELECT kind AS road_span_type, count(*) AS n FROM pairs GROUP BY 1")
def concat_disjoint(t):
    return two_pass(t).groupBy("road_span_type").agg(F.count(F.lit(1)).alias("n"))
