"""Queries on linear-referenced inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfault.functions import scalars as S
from wayfault.operators import linear_reference as L
from wayfault.plans.registry import adapter, query

adapter(
    "lrs_events",
    """SELECT DISTINCT l_partkey AS event_route_id, CAST(l_linenumber * 10 AS DOUBLE) AS from_measure, CAST(l_linenumber * 10 + l_quantity AS DOUBLE) AS to_measure,
       l_suppkey % 5 AS code, l_suppkey % 100 * 10 + l_suppkey % 10 AS functional_class, l_suppkey AS structure, CASE WHEN l_returnflag = 'R' THEN 'retired' ELSE NULL END AS to_date,
       l_linenumber % 2 AS dd_id, CAST(floor(l_extendedprice) AS BIGINT) AS from_date FROM lineitem""",
)
adapter("culvert_points", "SELECT DISTINCT l_partkey AS event_route_id, CAST(l_linenumber * 10 + l_suppkey % 7 AS DOUBLE) AS measure, l_suppkey AS structure, CASE WHEN l_returnflag = 'R' THEN 'retired' ELSE NULL END AS to_date FROM lineitem")
adapter(
    "lrs_matches",
    """SELECT o_orderkey AS _idx_, o_custkey % 200 AS u, o_orderkey % 211 AS v, o_orderkey AS key, o_custkey AS route_id, CAST(o_orderkey % 50 AS DOUBLE) AS min_from_mi, CAST(o_orderkey % 50 + o_custkey % 30 - 10 AS DOUBLE) AS max_to_mi
       FROM orders""",
)
adapter("class_types", "SELECT DISTINCT CASE WHEN s_suppkey % 7 = 0 THEN -1 - s_suppkey ELSE s_suppkey % 100 * 10 + s_suppkey % 10 END AS type_id, CAST(s_suppkey % 100 * 10 + s_suppkey % 10 AS STRING) AS type_functional_class, CASE WHEN s_suppkey % 3 = 0 THEN 'Y' ELSE 'N' END AS federal_aid_flag, s_suppkey % 4 AS class_hierarchy FROM supplier")
adapter("domains", "SELECT CAST(r_regionkey AS BIGINT) AS domain_type_id, r_name AS domain_index FROM region")
adapter("domain_entries", "SELECT CAST(n_regionkey AS BIGINT) AS entry_type_id, CAST(n_nationkey % 5 AS BIGINT) AS entry_id, min(n_name) AS description FROM nation GROUP BY 1, 2")
adapter("structures", "SELECT CASE WHEN s_suppkey % 9 = 0 THEN -1 - s_suppkey ELSE s_suppkey END AS structure, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_suppkey % 10 END AS rating, s_name AS structure_name FROM supplier")

ON = "a.route_id = b.event_route_id AND greatest(a.min_from_mi, a.max_to_mi) > least(b.from_measure, b.to_measure) AND least(a.min_from_mi, a.max_to_mi) < greatest(b.from_measure, b.to_measure) AND b.to_date IS NULL"
MI = "least(greatest(a.min_from_mi, a.max_to_mi), greatest(b.from_measure, b.to_measure)) - greatest(least(a.min_from_mi, a.max_to_mi), least(b.from_measure, b.to_measure))"
AT = "a.route_id = b.event_route_id AND b.measure BETWEEN least(a.min_from_mi, a.max_to_mi) AND greatest(a.min_from_mi, a.max_to_mi) AND b.to_date IS NULL"
OVERLAPS = f"ov AS (SELECT a._idx_, {MI} AS overlap_mi, b.* FROM lrs_matches a JOIN lrs_events b ON {ON})"


@query("j11_interval_overlap", f"WITH {OVERLAPS} SELECT _idx_, from_measure, to_measure, code, overlap_mi FROM ov")
def interval_overlap(t):
    return L.overlap_join(t.lrs_matches, t.lrs_events, width=25.0).select("_idx_", "from_measure", "to_measure", "code", "overlap_mi")


@query("f17_overlap_length", f"WITH {OVERLAPS} SELECT _idx_, sum(overlap_mi) AS overlap_mi, count(*) AS n FROM ov GROUP BY 1")
def overlap_sum(t):
    return L.overlap_join(t.lrs_matches, t.lrs_events).groupBy("_idx_").agg(F.sum("overlap_mi").alias("overlap_mi"), F.count(F.lit(1)).alias("n"))


@query("j12_point_in_interval", f"SELECT DISTINCT a._idx_, b.measure, b.structure FROM lrs_matches a JOIN culvert_points b ON {AT}")
def point_in_interval(t):
    return L.point_join(t.lrs_matches, t.culvert_points).select("_idx_", "measure", "structure").distinct()


CLASS = f"""SELECT DISTINCT a._idx_, {MI} AS overlap_mi, b.functional_class, d.f AS federal_class, c.federal_aid_flag, c.class_hierarchy
FROM lrs_matches a JOIN lrs_events b ON {ON} LEFT JOIN class_types c ON b.functional_class = c.type_id
LEFT JOIN (VALUES (1, 1), (2, 2), (4, 3), (6, 4), (7, 5), (8, 6), (9, 7)) d(s, f) ON CAST(c.type_functional_class AS INT) % 10 = d.s"""


def classes(t):
    return L.functional_class(t.lrs_matches, t.lrs_events, t.class_types)


@query("j13_class_lookup", CLASS)
def class_lookup(t):
    return classes(t)


@query("a6_distinct_overlaps", f"WITH {OVERLAPS} SELECT DISTINCT _idx_, functional_class FROM ov")
def distinct_overlaps(t):
    return L.overlap_join(t.lrs_matches, t.lrs_events).select("_idx_", "functional_class").distinct()


def _coded(domain: str) -> str:
    return f"""SELECT DISTINCT a._idx_, {MI} AS overlap_mi, b.code, d.description FROM lrs_matches a JOIN lrs_events b ON {ON}
LEFT JOIN domains c ON c.domain_index = '{domain}' LEFT JOIN domain_entries d ON c.domain_type_id = d.entry_type_id AND b.code = d.entry_id"""


@query("j14_domain_lookup", _coded("ASIA"))
def strategic(t):
    return L.coded_overlaps(t.lrs_matches, t.lrs_events, "code", "ASIA", t.domains, t.domain_entries)


@query("j14_domain_without_rows", _coded("NOWHERE"))
def truck(t):
    return L.coded_overlaps(t.lrs_matches, t.lrs_events, "code", "NOWHERE", t.domains, t.domain_entries)


BRIDGES = f"SELECT i._idx_, s.structure, s.rating, s.structure_name FROM (SELECT DISTINCT a._idx_, b.structure FROM lrs_matches a JOIN lrs_events b ON {ON}) i JOIN structures s ON i.structure = s.structure"
CULVERTS = f"SELECT i._idx_, s.structure, s.rating, s.structure_name FROM (SELECT DISTINCT a._idx_, b.structure FROM lrs_matches a JOIN culvert_points b ON {AT}) i JOIN structures s ON i.structure = s.structure"


@query("j15_inventory_chain", BRIDGES)
def bridges(t):
    return L.structures_along(t.lrs_matches, t.lrs_events, t.structures, "structure").select("_idx_", "structure", "rating", "structure_name")


@query("m14_culverts_within", CULVERTS)
def culverts(t):
    return L.structures_at(t.lrs_matches, t.culvert_points, t.structures, "structure").select("_idx_", "structure", "rating", "structure_name")


@query("a7_longest_overlap", f"SELECT DISTINCT ON (_idx_) * FROM ({CLASS}) ORDER BY _idx_, overlap_mi DESC, functional_class")
def longest(t):
    """The SQL leaves open which of the types of one number counts; here the first by flag and hierarchy does, so that the result does not vary."""
    return L.longest_overlap(classes(t), ties=("functional_class", "federal_class", "federal_aid_flag", "class_hierarchy"))


@query("a8_lowest_rating", f"SELECT DISTINCT ON (_idx_) * FROM ({BRIDGES}) ORDER BY _idx_, rating NULLS LAST, structure")
def lowest(t):
    return L.lowest_rating(bridges(t), "rating", ties=("structure",))


COUNTS = f"WITH {OVERLAPS} SELECT DISTINCT ON (_idx_, from_measure) _idx_, from_measure, overlap_mi, dd_id, from_date FROM ov ORDER BY _idx_, from_measure, dd_id, from_date DESC, overlap_mi"


@query("a9_latest_count", COUNTS)
def counts(t):
    return L.latest_count(L.overlap_join(t.lrs_matches, t.lrs_events)).select("_idx_", "from_measure", "overlap_mi", "dd_id", "from_date")


@query(
    "j16_enriched_matches",
    f"""WITH f AS (SELECT DISTINCT ON (_idx_) * FROM ({CLASS}) ORDER BY _idx_, overlap_mi DESC, functional_class),
s AS (SELECT DISTINCT ON (_idx_) * FROM ({_coded("ASIA")}) ORDER BY _idx_, overlap_mi DESC, code), b AS (SELECT DISTINCT ON (_idx_) * FROM ({BRIDGES}) ORDER BY _idx_, rating NULLS LAST, structure),
c AS (SELECT DISTINCT ON (_idx_) * FROM ({CULVERTS}) ORDER BY _idx_, rating NULLS LAST, structure)
SELECT DISTINCT m._idx_, m.u, m.v, m.key, m.route_id, f.overlap_mi AS fclass_overlap_mi, f.federal_class AS fclass_federal_class, s.code AS strategic_code, s.description AS strategic_description,
b.structure AS bridge_structure, b.rating AS bridge_rating, c.structure AS culvert_structure FROM lrs_matches m LEFT JOIN f USING (_idx_) LEFT JOIN s USING (_idx_) LEFT JOIN b USING (_idx_) LEFT JOIN c USING (_idx_)""",
)
def enriched(t):
    parts = {"fclass": longest(t), "strategic": L.longest_overlap(strategic(t), ties=("code",)), "bridge": lowest(t), "culvert": L.lowest_rating(culverts(t), "rating", ties=("structure",))}
    return L.enriched(t.lrs_matches, parts).select("_idx_", "u", "v", "key", "route_id", "fclass_overlap_mi", "fclass_federal_class", "strategic_code", "strategic_description", "bridge_structure", "bridge_rating", "culvert_structure")


# -- matches of base pairs, best route, reverse fill
adapter(
    "match_rows",
    """SELECT l_partkey % 60 AS osm_u, l_suppkey % 60 AS osm_v, l_orderkey % 40 AS route_id, CAST(l_linenumber AS DOUBLE) AS start_dist_along_mi, CAST(l_linenumber + l_quantity / 100 AS DOUBLE) AS end_dist_along_mi,
       CAST(l_orderkey % 4 AS INT) AS direction, l_linenumber % 2 = 0 AS reversed_input, CAST(l_linenumber AS DOUBLE) / 8 AS matching_confidence FROM lineitem""",
)
adapter("match_edges", "SELECT CAST(a AS BIGINT) AS u, CAST((a * 7 + 1) % 60 AS BIGINT) AS v, CAST(0 AS BIGINT) AS key, CAST(0.5 AS DOUBLE) AS length_mi FROM (SELECT DISTINCT p_partkey % 60 AS a FROM part) WHERE a <> (a * 7 + 1) % 60 UNION SELECT CAST((a * 7 + 1) % 60 AS BIGINT), CAST(a AS BIGINT), CAST(0 AS BIGINT), CAST(0.5 AS DOUBLE) FROM (SELECT DISTINCT p_partkey % 30 AS a FROM part) WHERE a <> (a * 7 + 1) % 60")
EDGE_MATCHES = """em AS (SELECT e.u, e.v, e.key, m.route_id, m.reversed_input, least(start_dist_along_mi, end_dist_along_mi) AS from_mi, greatest(start_dist_along_mi, end_dist_along_mi) AS to_mi,
 least(greatest((greatest(start_dist_along_mi, end_dist_along_mi) - least(start_dist_along_mi, end_dist_along_mi)) / e.length_mi, 0), 1) AS r, m.direction, m.matching_confidence
 FROM match_rows m JOIN match_edges e ON m.osm_u = e.u AND m.osm_v = e.v),
es AS (SELECT *, r * matching_confidence * CASE WHEN direction = 0 AND reversed_input THEN 0.925 ELSE 1 END AS score FROM em),
g AS (SELECT u, v, key, route_id, reversed_input, min(from_mi) AS min_from_mi, max(to_mi) AS max_to_mi, least(greatest(round(sum(r), 6), 0), 1) AS ratio_covered, round(sum(score), 6) AS score, round(abs(sum(score) - 1), 6) AS penalty FROM es GROUP BY 1, 2, 3, 4, 5),
best AS (SELECT DISTINCT ON (u, v, key) * FROM g ORDER BY u, v, key, penalty, route_id, reversed_input)"""


def edge_matches(t):
    edges = t.match_edges.withColumn("merged_edges", F.array(F.struct("u", "v")))
    return L.matches_to_edges(t.match_rows, edges)


@query("j21_matches_to_edges", f"WITH {EDGE_MATCHES} SELECT u, v, key, route_id, count(*) AS n, round(sum(score), 6) AS score FROM es GROUP BY 1, 2, 3, 4")
def to_edges(t):
    return edge_matches(t).groupBy("u", "v", "key", "route_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("score"))


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("ratio_covered", "score", "penalty") if c in df.columns})


@query("a5_match_rollup", f"WITH {EDGE_MATCHES} SELECT * FROM g")
def rollup(t):
    return _rounded(L.rolled_up(edge_matches(t)))


def best(t):
    return L.one_each(_rounded(L.rolled_up(edge_matches(t))), L.EDGE, [F.asc("penalty"), F.asc("route_id"), F.asc("reversed_input")])


@query("a10_best_route", f"WITH {EDGE_MATCHES} SELECT * FROM best")
def best_route(t):
    return best(t)


FILLED = """filled AS (SELECT u, v, key, route_id, min_from_mi, max_to_mi, ratio_covered, score, reversed_input, 'direct' AS match_type FROM best
 UNION ALL SELECT e.u, e.v, e.key, b.route_id, b.max_to_mi, b.min_from_mi, b.ratio_covered, NULL, NOT b.reversed_input, 'filled_reverse' FROM match_edges e JOIN best b ON e.u = b.v AND e.v = b.u AND e.key = b.key
 WHERE NOT EXISTS (SELECT 1 FROM best x WHERE x.u = e.u AND x.v = e.v AND x.key = e.key))"""


@query("j20_reverse_fill", f"WITH {EDGE_MATCHES}, {FILLED} SELECT * FROM filled")
def reverse_fill(t):
    return L.fill_reverse(best(t), t.match_edges)


@query("m13_numbered_matches", f"WITH {EDGE_MATCHES}, {FILLED} SELECT row_number() OVER (ORDER BY u, v, key) - 1 AS _idx_, u, v, key, match_type FROM filled")
def numbered(t):
    return L.numbered_matches(L.fill_reverse(best(t), t.match_edges)).select("_idx_", "u", "v", "key", "match_type")


@query("j22_unmatched", "SELECT DISTINCT event_route_id FROM lrs_events WHERE event_route_id NOT IN (SELECT route_id FROM lrs_matches)")
def unmatched(t):
    return t.lrs_events.join(t.lrs_matches, F.col("event_route_id") == F.col("route_id"), "left_anti").select("event_route_id").distinct()


@query("a12_matching_rate", "SELECT *, CASE WHEN total > 0 THEN matched / total ELSE 0 END AS rate FROM (SELECT count(DISTINCT event_route_id) FILTER (event_route_id IN (SELECT route_id FROM lrs_matches)) AS matched, count(DISTINCT event_route_id) AS total FROM lrs_events)")
def rate(t):
    matched = t.lrs_events.join(t.lrs_matches, F.col("event_route_id") == F.col("route_id"), "left_semi")
    return L.matching_rate(matched, t.lrs_events, ["event_route_id"])


@query("f19_match_score", f"WITH {EDGE_MATCHES} SELECT u, v, route_id, direction, reversed_input, round(r, 6) AS ratio, round(score, 6) AS score FROM es")
def match_score(t):
    return edge_matches(t).select("u", "v", "route_id", "direction", "reversed_input", F.round("ratio_covered", 6).alias("ratio"), F.round("score", 6).alias("score"))


@query("f18_federal_class", "SELECT type_id, d.f AS federal_class FROM class_types LEFT JOIN (VALUES (1, 1), (2, 2), (4, 3), (6, 4), (7, 5), (8, 6), (9, 7)) d(s, f) ON CAST(type_functional_class AS INT) % 10 = d.s")
def federal(t):
    return t.class_types.select("type_id", S.federal_class(F.col("type_functional_class")).alias("federal_class"))


@query("f20_reversal_plan", "SELECT o_orderkey AS id, CASE WHEN d IS NULL OR d = 0 THEN 'false,true' WHEN d = 1 THEN 'false' WHEN d IN (2, 3) THEN 'true' ELSE '' END AS attempts FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE o_orderkey % 6 END AS d FROM orders)")
def reversal(t):
    d = F.when(F.col("o_orderkey") % 6 != 5, F.col("o_orderkey") % 6)
    return t.orders.select(F.col("o_orderkey").alias("id"), F.array_join(S.reversal_plan(d).cast("array<string>"), ",").alias("attempts"))


@query(
    "f21_repaired_distances",
    """SELECT route_id, direction, reversed_input, CASE WHEN reversed_input AND direction IN (2, 3) THEN 100 - s WHEN reversed_input THEN e ELSE s END AS start_mi,
CASE WHEN reversed_input AND direction IN (2, 3) THEN 100 - e WHEN reversed_input THEN s ELSE e END AS end_mi FROM (SELECT *, start_dist_along_mi AS s, end_dist_along_mi AS e FROM match_rows)""",
)
def repaired(t):
    r = S.repaired_distances(F.col("start_dist_along_mi"), F.col("end_dist_along_mi"), F.lit(100.0), F.col("direction"), F.col("reversed_input"))
    return t.match_rows.select("route_id", "direction", "reversed_input", r["start"].alias("start_mi"), r["end"].alias("end_mi"))
