"""Queries that show the row-level functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfault.functions import scalars as S
from wayfault.operators import linear_reference as L
from wayfault.operators import tables as B
from wayfault.operators import validation as V
from wayfault.plans import network_adapters  # noqa: F401
from wayfault.plans.registry import adapter, query
from wayfault.sources import regions as RG


def _class(h: str) -> str:
    """SQL for the class of one highway value."""
    h = f"lower(trim({h}))"
    cases = " ".join(f"WHEN starts_with({h}, '{p}') THEN {c}" for p, c in S.ROAD_CLASSES if p != "service")
    return f"CASE {cases} WHEN starts_with({h}, 'service') THEN CASE WHEN service = 'driveway' THEN 8.0 ELSE 7.0 END END + CASE WHEN ends_with({h}, 'link') THEN 0.25 ELSE 0 END"


CLASSES = f"c AS (SELECT *, {_class('h1')} AS c1, {_class('h2')} AS c2 FROM edge_tags)"


def tagged(t):
    e = t.edge_tags.withColumn("highway", F.filter(F.array("h1", "h2"), lambda x: x.isNotNull()))
    return e.select("*", S.road_class(F.col("highway"), F.array("service")).alias("rc")).select("*", "rc.*").drop("rc")


@query(
    "f5_road_class",
    f"""WITH {CLASSES} SELECT u, v, key, CAST(floor(least(c1, c2)) AS INT) AS edge_min_roadclass, CAST(floor(greatest(c1, c2)) AS INT) AS edge_max_roadclass,
CASE WHEN c1 IS NULL AND c2 IS NULL THEN NULL WHEN c2 IS NULL OR c1 <= c2 THEN lower(h1) ELSE lower(h2) END AS edge_highest_highway_type,
CASE WHEN c1 IS NULL AND c2 IS NULL THEN NULL WHEN c2 IS NULL OR c1 >= c2 THEN lower(h1) ELSE lower(h2) END AS edge_lowest_highway_type FROM c""",
)
def road_class(t):
    return tagged(t).select("u", "v", "key", "edge_min_roadclass", "edge_max_roadclass", "edge_highest_highway_type", "edge_lowest_highway_type")


@query("p1_major_roads", f"WITH {CLASSES} SELECT u, v, key FROM c WHERE floor(least(c1, c2)) BETWEEN 0 AND 4 AND u % 2 = 0")
def major(t):
    return B.major_roads(tagged(t).withColumn("_intersects_region_", F.col("u") % 2 == 0)).select("u", "v", "key")


@query("p2_region_filter", "SELECT u, v, key FROM edges WHERE u % 2 = 0")
def region_filter(t):
    return B.in_region(t.edges.withColumn("_intersects_region_", F.col("u") % 2 == 0)).select("u", "v", "key")


@query("p5_edge_id_text", "SELECT u, v, key, '(' || u || ', ' || v || ', ' || key || ')' AS edge_id FROM edges")
def edge_ids(t):
    return t.edges.select("u", "v", "key", S.edge_id_text(F.col("u"), F.col("v"), F.col("key")).alias("edge_id"))


@query("p6_frequency", "SELECT p_partkey, CASE WHEN l < 14 THEN '100 YEAR' WHEN l IS NOT NULL THEN '500 YEAR' END AS frequency FROM (SELECT p_partkey, CASE WHEN p_size % 20 = 0 THEN NULL ELSE p_size % 20 - 1 END AS l FROM part)")
def frequency(t):
    return t.part.select("p_partkey", S.flood_frequency(F.when(F.col("p_size") % 20 != 0, F.col("p_size") % 20 - 1)).alias("frequency"))


@query("p7_prefixed_columns", "SELECT u, v, key, travel_time AS e001_travel_time, length AS e001_length FROM edges")
def prefixed(t):
    return B.add_prefix(t.edges, "e001_", ["u", "v", "key"])


@query("p8_rounded", "SELECT u, v, key, round(length / 7.0, 3) AS length, round(travel_time / 1000.0, 3) AS travel_time FROM edges")
def rounded(t):
    rows = t.edges.select("u", "v", "key", (F.col("length") / 7.0).alias("length"), (F.col("travel_time") / 1000.0).alias("travel_time"))
    return B.rounded(rows, ["length", "speed_kph", "travel_time"])


@query("p9_search_text", "SELECT u, v, key, concat_ws(' ', name, ref, u || ',' || v) AS search_text FROM edge_tags")
def search_text(t):
    return t.edge_tags.select("u", "v", "key", B.search_text("name", "ref", F.concat_ws(",", "u", "v")).alias("search_text"))


@query("p10_measures", "SELECT u, v, key, CASE WHEN bridge = 'yes' THEN travel_time END AS bridge_seconds, length AS metres FROM edge_tags")
def measures(t):
    return B.measures(t.edge_tags, ["u", "v", "key"], {"bridge_seconds": ("travel_time", "bridge = 'yes'"), "metres": ("length", None)})


@query("p11_select_except", "SELECT * EXCLUDE (length) FROM edges")
def select_except(t):
    return B.select_except(t.edges, "length")


@query("p12_rail_filter", "SELECT s_suppkey, owner FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'ABC Railroad' WHEN 1 THEN NULL WHEN 2 THEN 'state' ELSE 'RAILROAD x' END AS owner FROM supplier) WHERE NOT regexp_matches(coalesce(owner, ''), '^.*RAILROAD.*', 'is')")
def rail(t):
    o = F.when(F.col("s_suppkey") % 4 == 0, "ABC Railroad").when(F.col("s_suppkey") % 4 == 2, "state").when(F.col("s_suppkey") % 4 == 3, "RAILROAD x")
    return B.without_rail(t.supplier.select("s_suppkey", o.alias("owner")), "owner")


@query("p13_defaults", "SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_size END, 0) AS n, coalesce(CASE WHEN p_size > 40 THEN p_brand END, '') AS ids FROM part")
def defaults(t):
    rows = t.part.select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_size")).alias("n"), F.when(F.col("p_size") > 40, F.array("p_brand")).alias("ids"))
    return B.with_defaults(rows, ["n", "ids"]).withColumn("ids", F.array_join("ids", ","))


@query("f1_first_or_null", "SELECT u, v, key, coalesce(ref, name) AS first FROM edge_tags")
def first(t):
    return t.edge_tags.select("u", "v", "key", S.first_or_null(F.filter(F.array("ref", "name"), lambda x: x.isNotNull())).alias("first"))


@query("f2_bridge_value", "SELECT u, v, key, CASE WHEN bridge = 'yes' OR u % 7 = 0 THEN 'yes' WHEN bridge <> 'no' THEN bridge END AS bridge FROM edge_tags")
def bridge(t):
    return t.edge_tags.select("u", "v", "key", S.bridge_value(F.array("bridge", F.when(F.col("u") % 7 == 0, "yes"))).alias("bridge"))


@query("f3_is_paved", "SELECT u, v, key, coalesce(lower(surface) NOT IN ('gravel', 'dirt'), true) AS is_paved FROM edge_tags")
def paved(t):
    return t.edge_tags.select("u", "v", "key", S.is_paved(F.array("surface")).alias("is_paved"))


CAND = """cand AS (SELECT u, v, key, least(floor(least(c1, c2)), 9) + CASE WHEN ref IS NULL THEN 1 ELSE 0 END + CASE WHEN name IS NULL THEN 0.5 ELSE 0 END + CASE WHEN ref IS NULL AND name IS NULL THEN 100 ELSE 0 END AS penalty,
coalesce(nullif(concat_ws('/', ref, name), ''), '<' || CASE WHEN c2 IS NULL OR c1 <= c2 THEN lower(h1) ELSE lower(h2) END || '>') AS full_name FROM c WHERE c1 IS NOT NULL OR c2 IS NOT NULL)"""


def named(t):
    return tagged(t).where("edge_min_roadclass IS NOT NULL")


@query("f6_best_name", f"WITH {CLASSES}, {CAND} SELECT u, arg_min(full_name, (penalty, full_name)) AS best_name FROM cand GROUP BY u")
def best_names(t):
    return S.best_name(named(t), ["u"])


@query(
    "f7_cross_names",
    f"""WITH {CLASSES}, {CAND}, road AS (SELECT u, v, arg_min(full_name, (penalty, full_name)) AS road_name FROM cand GROUP BY u, v),
f AS (SELECT r.u, r.v, arg_min(full_name, (penalty, full_name)) FILTER (full_name <> road_name OR starts_with(full_name, '<')) AS from_name FROM road r JOIN cand c ON c.u = r.u GROUP BY r.u, r.v),
d AS (SELECT r.u, r.v, arg_min(full_name, (penalty, full_name)) FILTER (full_name <> road_name OR starts_with(full_name, '<')) AS to_name FROM road r JOIN cand c ON c.u = r.v GROUP BY r.u, r.v)
SELECT u, v, road_name, f.from_name, d.to_name FROM road LEFT JOIN f USING (u, v) LEFT JOIN d USING (u, v)""",
)
def cross_names(t):
    from wayfault.operators.paths import street_names

    return street_names(named(t)).select("u", "v", "road_name", "from_name", "to_name").distinct()


@query(
    "f8_speeds",
    """WITH s AS (SELECT u, v, key, length, lower(h1) AS h, CASE maxspeed WHEN '50' THEN 50.0 WHEN '30 mph' THEN 30 * 1.60934 END AS own FROM edge_tags), m AS (SELECT h, avg(own) AS mean FROM s GROUP BY h),
d AS (SELECT h, coalesce(mean, CASE h WHEN 'motorway' THEN 100 WHEN 'primary' THEN 60 WHEN 'residential' THEN 50 WHEN 'living_street' THEN 35 WHEN 'service' THEN 30 END) AS typical FROM m),
a AS (SELECT h, coalesce(typical, (SELECT avg(typical) FROM d)) AS typical FROM d)
SELECT u, v, key, round(coalesce(own, typical), 6) AS speed_kph, round(length / 1000.0 / coalesce(own, typical) * 3600, 6) AS travel_time FROM s JOIN a USING (h)""",
)
def speeds(t):
    e = t.edge_tags.withColumn("highway", F.array(F.lower("h1"))).withColumn("maxspeed", F.when(F.col("maxspeed").isNotNull(), F.array("maxspeed")))
    s = S.add_edge_speeds(e)
    return s.select("u", "v", "key", F.round("speed_kph", 6).alias("speed_kph"), F.round(S.travel_time(F.col("length"), F.col("speed_kph")), 6).alias("travel_time"))


@query("f4_length_mi", "SELECT u, v, key, round(CAST(length AS DOUBLE) * 0.0006213712, 6) AS length_mi FROM edges")
def length_mi(t):
    return t.edges.select("u", "v", "key", S.length_mi(F.col("length")).alias("length_mi"))


UNIT = "CASE p_size % 6 WHEN 0 THEN 'FT' WHEN 1 THEN 'Miles' WHEN 2 THEN 'NP' WHEN 3 THEN 'm' WHEN 4 THEN 'u.s. survey feet' ELSE NULL END"


@query("f15_length_units", f"SELECT p_partkey, CASE WHEN val = -9999 THEN NULL ELSE round(CAST(val AS DOUBLE) * CASE unit WHEN 'FT' THEN 0.3048 WHEN 'Miles' THEN 1609.344 WHEN 'm' THEN 1 WHEN 'u.s. survey feet' THEN 0.3048006096 END, 6) END AS metres FROM (SELECT p_partkey, {UNIT} AS unit, CASE WHEN p_partkey % 10 = 0 THEN -9999 ELSE p_size END AS val FROM part)")
def lengths(t):
    v = F.when(F.col("p_partkey") % 10 == 0, -9999.0).otherwise(F.col("p_size").cast("double"))
    return t.part.select("p_partkey", F.round(S.length_to_meters(v, F.expr(UNIT)), 6).alias("metres"))


@query("f16_velocity_units", "SELECT p_partkey, CASE WHEN val IN (-9999, -8888) THEN NULL ELSE round(CAST(val AS DOUBLE) * CASE p_size % 3 WHEN 0 THEN 0.3048 WHEN 1 THEN 1 END, 6) END AS mps FROM (SELECT *, CASE p_partkey % 9 WHEN 0 THEN -9999 WHEN 1 THEN -8888 ELSE p_size END AS val FROM part)")
def velocities(t):
    v = F.when(F.col("p_partkey") % 9 == 0, -9999.0).when(F.col("p_partkey") % 9 == 1, -8888.0).otherwise(F.col("p_size").cast("double"))
    unit = F.when(F.col("p_size") % 3 == 0, "FPS").when(F.col("p_size") % 3 == 1, "Meters per Second").otherwise("NP")
    return t.part.select("p_partkey", F.round(S.velocity_to_mps(v, unit), 6).alias("mps"))


@query("f9_extract_version", "SELECT p_partkey, nullif(regexp_extract(name, '[^0-9]([0-9]{6})\\.osm\\.pbf$', 1), '') AS version FROM (SELECT p_partkey, 'us-' || (250000 + p_size) || CASE WHEN p_size % 2 = 0 THEN '.osm.pbf' ELSE '.pbf' END AS name FROM part)")
def versions(t):
    name = F.concat(F.lit("us-"), (250000 + F.col("p_size")).cast("string"), F.when(F.col("p_size") % 2 == 0, ".osm.pbf").otherwise(".pbf"))
    return t.part.select("p_partkey", S.extract_version(name).alias("version"))


REGION_FILE = "CASE n_nationkey % 4 WHEN 0 THEN '/d/nonservice-roadways-buffer-10mi-County-' || (36001 + n_nationkey) || '_us-250101.osm.pbf' WHEN 1 THEN 'state-' || n_nationkey WHEN 2 THEN 'x-state-0' || n_nationkey || '.gpkg' ELSE 'elsewhere' END"


@query(
    "f10_region_name_parse",
    f"""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'nonservice-roadways-' WHEN 2 THEN 'x-' END AS prefix, CASE n_nationkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 0 WHEN 2 THEN 0 END AS buffer_mi,
CASE n_nationkey % 4 WHEN 0 THEN 'county' WHEN 3 THEN NULL ELSE 'state' END AS geolevel, CASE n_nationkey % 4 WHEN 0 THEN '' || (36001 + n_nationkey) WHEN 1 THEN '' || n_nationkey WHEN 2 THEN '0' || n_nationkey END AS geoid,
CASE n_nationkey % 4 WHEN 0 THEN 'buffer-10mi-county-' || (36001 + n_nationkey) WHEN 1 THEN 'state-' || n_nationkey WHEN 2 THEN 'state-0' || n_nationkey END AS region FROM nation""",
)
def region_names(t):
    p = S.region_name_parts(F.expr(REGION_FILE))
    return t.nation.select("n_nationkey", p.alias("p")).select("n_nationkey", "p.*")


@query("f11_region_name", "SELECT n_nationkey, CASE WHEN n_regionkey > 0 THEN 'buffer-' || n_regionkey || 'mi-' ELSE '' END || 'county-' || (36001 + n_nationkey) AS region FROM nation")
def region_name(t):
    return t.nation.select("n_nationkey", S.region_name(F.lit("County"), (36001 + F.col("n_nationkey")).cast("string"), F.col("n_regionkey")).alias("region"))


@query("f12_region_parameters", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '99' WHEN n_nationkey % 4 = 0 THEN '' || (36001 + n_nationkey) WHEN n_nationkey % 4 = 1 THEN '' || n_nationkey WHEN n_nationkey % 4 = 2 THEN '0' || n_nationkey END AS geoid, CASE n_nationkey % 4 WHEN 0 THEN 10 WHEN 3 THEN NULL ELSE 0 END AS buffer_mi FROM nation")
def region_parameters(t):
    p = S.region_parameters(F.expr(REGION_FILE), F.when(F.col("n_nationkey") % 3 == 0, "99"), F.lit(None).cast("int"))
    return t.nation.select("n_nationkey", p["geoid"].alias("geoid"), p["buffer_mi"].alias("buffer_mi"))


@query("s8_county_code", "SELECT n_nationkey, CAST(n_nationkey + 1 AS INT) AS county_code FROM nation")
def county(t):
    return t.nation.select("n_nationkey", S.county_code(F.format_string("36%03d", 2 * F.col("n_nationkey") + 1)).alias("county_code"))


@query("f23_numeric_coercion", "SELECT p_partkey, TRY_CAST(CASE WHEN p_size % 3 = 0 THEN 'n/a' ELSE '' || p_size END AS DOUBLE) AS size FROM part")
def coercion(t):
    return t.part.select("p_partkey", B.as_number(F.when(F.col("p_size") % 3 == 0, "n/a").otherwise(F.col("p_size").cast("string"))).alias("size"))


@query("f24_literal_list", "SELECT p_partkey, CAST(p_size AS BIGINT) + p_partkey AS total FROM part")
def literal_list(t):
    parsed = B.literal_list(F.concat(F.lit("("), "p_size", F.lit(", "), "p_partkey", F.lit(")")))
    return t.part.select("p_partkey", F.aggregate(parsed, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("f25_detour_differences", "SELECT u, v, CASE WHEN u % 3 > 0 THEN CAST(travel_time AS DOUBLE) END AS difference_sec, CASE WHEN u % 3 > 0 THEN CAST(length AS DOUBLE) * 0.5 END AS difference_miles, CASE WHEN u % 3 > 0 AND travel_time > 0 THEN CAST(2 AS DOUBLE) END AS ratio FROM edges")
def differences(t):
    base, detour = F.col("travel_time").cast("double"), F.when(F.col("u") % 3 > 0, F.col("travel_time") * 2.0)
    return t.edges.select("u", "v", S.detour_differences(base, detour, F.col("length").cast("double"), F.col("length") * 1.5).alias("d")).select("u", "v", "d.*")


@query("f26_clamp", "SELECT p_partkey, least(greatest(p_size / 20.0 - 0.5, 0), 1) AS confidence FROM part")
def clamp(t):
    return t.part.select("p_partkey", S.clamp(F.col("p_size") / 20.0 - 0.5).alias("confidence"))


@query("f27_any", "SELECT c_nationkey, bool_or(c_acctbal < 0) AS any_negative FROM customer GROUP BY 1")
def any_(t):
    return t.customer.groupBy("c_nationkey").agg(F.exists(F.collect_list("c_acctbal"), lambda x: x < 0).alias("any_negative"))


# -- sequences, concatenation, validation
@query("w6_sequence", "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS _id_ FROM customer")
def sequence(t):
    return L.with_sequence(t.customer.select("c_mktsegment", "c_custkey"), ["c_mktsegment", "c_custkey"], "_id_", 1).select("c_custkey", "_id_")


@query("o1_index_sort", "SELECT u, v, key, travel_time FROM edges ORDER BY u, v, key")
def index_sort(t):
    return B.index_sorted(t.edges.select("u", "v", "key", "travel_time"))


@query("o3_first_by_penalty", f"WITH {CLASSES}, {CAND} SELECT v, CAST(min(penalty) AS DOUBLE) AS penalty FROM cand GROUP BY v")
def first_by_penalty(t):
    c = S.name_candidate(F.col("edge_min_roadclass"), F.col("ref"), F.col("name"), F.col("edge_highest_highway_type"))
    return named(t).groupBy("v").agg(F.min(c).alias("b")).select("v", "b.penalty")


@query("o5_first_edge", "SELECT u, min(v) AS v FROM edges GROUP BY u")
def first_edge(t):
    return B.first_of_each(t.edges, "u", ["v", "key"]).select("u", "v")


@query("u2_checked_concat", "SELECT c_custkey AS id, c_name AS name, NULL AS balance FROM customer UNION ALL SELECT -1 - s_suppkey, s_name, s_acctbal FROM supplier")
def checked_concat(t):
    a, b = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), t.supplier.select((-1 - F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return V.require_key(a.unionByName(b, allowMissingColumns=True), ["id"])


@query("u3_set_algebra", "SELECT DISTINCT u, v FROM edges WHERE u % 2 = 0 AND (u, v) NOT IN (SELECT v, u FROM edges) UNION SELECT u, v FROM edges WHERE v % 7 = 0")
def set_algebra(t):
    return B.either(B.one_way(t.edges).where("u % 2 = 0"), t.edges.where("v % 7 = 0"), ["u", "v"])


@query("v1_key_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def key_violations(t):
    return V.key_violations(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("v2_lost_and_gained", "SELECT DISTINCT o_custkey, 'lost' AS side FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)")
def lost(t):
    return V.lost_and_gained(t.orders, t.orders.where("o_orderkey % 2 = 0"), ["o_custkey"])


@query("v3_orphans", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 > 0)")
def orphans(t):
    return V.foreign_key_violations(t.orders, t.customer.where("c_custkey % 5 > 0").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])


@query("a16_fingerprint", "SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(md5(u || chr(31) || v || chr(31) || key), 1, 12) AS BIGINT)) AS VARCHAR) AS hash FROM edges")
def fingerprints(t):
    V.require_unchanged(t.edges, t.edges.orderBy(F.desc("u")), ["u", "v", "key"])
    return V.fingerprint(t.edges, ["u", "v", "key"])


@query("v5_domain", "SELECT DISTINCT event_type FROM events")
def domain(t):
    return V.require_domain(t.events, "event_type", t.events.select("event_type"), "event_type").select("event_type").distinct()


@query("v7_schema", "SELECT 'u' AS name, 'bigint' AS type UNION ALL SELECT 'v', 'bigint' UNION ALL SELECT 'key', 'bigint'")
def schema(t):
    e = V.require_columns(t.edges, {"u": "bigint", "v": "bigint", "key": "bigint"})
    return t.spark.createDataFrame([(c, k) for c, k in e.dtypes if c in ("u", "v", "key")], "name string, type string")


# -- regions
adapter("regions", "SELECT CAST(36001 + n_nationkey AS STRING) AS geoid, 'county' AS geolevel, n_name AS name FROM nation UNION ALL SELECT CAST(36 + r_regionkey AS STRING), 'state', r_name FROM region")


@query("s2_region_boundary", "SELECT geoid, name FROM regions WHERE geoid = '36003'")
def boundary(t):
    return RG.boundary(t.regions, "36003").select("geoid", "name")


@query("s3_prefix_scan", "SELECT geoid FROM regions WHERE geolevel = 'county' AND geoid LIKE '3600%'")
def prefix_scan(t):
    return RG.with_prefix(t.regions, "3600", "county")


@query("s13_geolevel_probe", "SELECT DISTINCT geolevel FROM regions WHERE geoid = '38'")
def probe(t):
    return t.spark.createDataFrame([(RG.geolevel_of(t.regions, "38"),)], "geolevel string")


@query("s16_inline_table", "SELECT * FROM (VALUES (1, 1), (2, 2), (4, 3), (6, 4), (7, 5), (8, 6), (9, 7)) t(suffix, federal_class)")
def inline(t):
    return S.inline_table(t.spark, list(S.FEDERAL_CLASS.items()), "suffix int, federal_class int")


@query("s10_registered_table", "SELECT u, count(*) AS n FROM edges GROUP BY u")
def registered(t):
    B.register(t.spark, {"wayfault_edges": t.edges})
    return t.spark.sql("SELECT u, count(*) AS n FROM wayfault_edges GROUP BY u")
