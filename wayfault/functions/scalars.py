"""Row-level functions on columns: tags, names, classes, units, codes and identifiers.

All are built-in expressions.  A tag that may have several values is an array of strings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Road classes by the start of the highway tag, in the order in which they are tried.
ROAD_CLASSES = [
    ("motorway", 0.0), ("trunk", 1.0), ("primary", 2.0), ("secondary", 3.0), ("tertiary", 4.0), ("residential", 5.0), ("living_street", 5.5), ("unclassified", 6.0), ("service", 7.0),
]
#: Service tags (by their start) of minor roads, and the class that these have.
MINOR_SERVICES, MINOR_CLASS, LINK_PENALTY = ["parking", "driveway", "drive-through"], 8.0, 0.25
#: Surfaces that count as unpaved.
UNPAVED = ["compacted", "dirt", "dirt/sand", "earth", "fine_gravel", "gravel", "mud", "sand", "unpaved"]
#: Metres in a unit of length, by code and by name.
LENGTH_UNITS = {
    "CM": 0.01, "FT": 0.3048, "IN": 0.0254, "KM": 1000.0, "M": 1.0, "MI": 1609.344, "MM": 0.001, "USFT": 0.3048006096,
    "CENTIMETERS": 0.01, "FEET": 0.3048, "INCHES": 0.0254, "KILOMETERS": 1000.0, "METERS": 1.0, "MILES": 1609.344, "MILLIMETERS": 0.001, "U.S. SURVEY FEET": 0.3048006096,
}
#: Metres per second in a unit of velocity, by code and by name.
VELOCITY_UNITS = {"FPS": 0.3048, "FEET PER SECOND": 0.3048, "MPS": 1.0, "METERS PER SECOND": 1.0}
NOT_POPULATED = ["NP", "NOT POPULATED"]
LENGTH_MISSING, VELOCITY_MISSING = [-9999.0], [-9999.0, -8888.0]
#: Default speeds (km/h) by highway tag.
DEFAULT_SPEEDS = {"motorway": 100, "trunk": 100, "primary": 60, "secondary": 60, "tertiary": 60, "residential": 50, "unclassified": 40, "living_street": 35, "service": 30}
#: Federal class by the last digit of the state's code.
FEDERAL_CLASS = {1: 1, 2: 2, 4: 3, 6: 4, 7: 5, 8: 6, 9: 7}
#: Fixed value: risk levels from this one on belong to the rarer flood.
RARE_FLOOD_LEVEL = 14
MILES_PER_METER = 0.0006213712
REVERSED_PENALTY = 0.925


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


# -- tags
def first_or_null(tags: Column) -> Column:
    """First element of an array; null if empty or null."""
    return F.try_element_at(tags, F.lit(1))


def bridge_value(tags: Column) -> Column:
    """The bridge tag of a road: ``yes`` if among its values, else the first that is not ``no``, else null."""
    positive = F.filter(tags, lambda x: x.isNotNull() & (x != "no"))
    return F.when(F.array_contains(positive, "yes"), F.lit("yes")).otherwise(first_or_null(positive))


def is_paved(surfaces: Column) -> Column:
    """False if any surface is an unpaved one; true if none is or none is known."""
    lowered = F.transform(F.filter(surfaces, lambda x: x.isNotNull()), F.lower)
    return F.coalesce(~F.arrays_overlap(lowered, F.array(*map(F.lit, UNPAVED))), F.lit(True))


def road_class_value(highway: Column, services: Column) -> Column:
    """Class of one highway value, with its decimals; null if it has none. The last service value decides a service road."""
    last = F.try_element_at(services, F.lit(-1))
    minor = reduce(lambda a, b: a | b, [F.startswith(last, F.lit(s)) for s in MINOR_SERVICES])
    out = F.when(F.lit(False), F.lit(0.0))
    for prefix, value in ROAD_CLASSES:
        own = F.when(minor, MINOR_CLASS).otherwise(value) if prefix == "service" else F.lit(value)
        out = out.when(F.startswith(highway, F.lit(prefix)), own)
    return out + F.when(F.endswith(highway, F.lit("link")), LINK_PENALTY).otherwise(0.0)


def road_class(highways: Column, services: Column) -> Column:
    """Struct ``roadclass, edge_min_roadclass, edge_max_roadclass, roadtype, edge_highest_highway_type, edge_lowest_highway_type``.

    Of equal classes the first value names the type.
    """
    ranked = F.transform(highways, lambda h, i: F.struct(road_class_value(F.lower(F.trim(h)), services).alias("c"), i.alias("i"), F.lower(F.trim(h)).alias("t")))
    known = F.filter(ranked, lambda r: r["c"].isNotNull())
    low = F.array_min(known)
    high = F.array_max(F.transform(known, lambda r: F.struct(r["c"].alias("c"), (-r["i"]).alias("i"), r["t"].alias("t"))))
    least, most = F.floor(low["c"]).cast("int"), F.floor(high["c"]).cast("int")
    return F.struct(
        least.alias("roadclass"), least.alias("edge_min_roadclass"), most.alias("edge_max_roadclass"),
        low["t"].alias("roadtype"), low["t"].alias("edge_highest_highway_type"), high["t"].alias("edge_lowest_highway_type"),
    )


def last_ref(refs: Column) -> Column:
    """The last ref that is not empty."""
    return F.try_element_at(F.filter(refs, lambda x: x.isNotNull() & (x != "")), F.lit(-1))


def first_name(names: Column) -> Column:
    """The first name that is not empty."""
    return first_or_null(F.filter(names, lambda x: x.isNotNull() & (x != "")))


def full_name(ref: Column, name: Column) -> Column:
    """``ref/name``, or the one that there is; null if neither."""
    r, n = F.nullif(ref, F.lit("")), F.nullif(name, F.lit(""))
    return F.nullif(F.concat_ws("/", r, n), F.lit(""))


def name_candidate(roadclass: Column, ref: Column, name: Column, highway_type: Column) -> Column:
    """Struct ``penalty, name`` of an edge; the smallest of several is the best name."""
    full = full_name(ref, name)
    penalty = roadclass + F.when(F.nullif(ref, F.lit("")).isNull(), 1.0).otherwise(0.0) + F.when(F.nullif(name, F.lit("")).isNull(), 0.5).otherwise(0.0)
    return F.struct((penalty + F.when(full.isNull(), 100.0).otherwise(0.0)).alias("penalty"), F.coalesce(full, F.concat(F.lit("<"), highway_type, F.lit(">"))).alias("name"))


def best_name(edges: DataFrame, keys: list[str], omit: str | None = None) -> DataFrame:
    """``keys, best_name`` of the edges of each key; needs ``edge_min_roadclass, ref, name, edge_highest_highway_type``.

    ``omit``: a column with a name that may not be chosen; placeholders of unnamed roads always may.
    """
    candidate = name_candidate(F.col("edge_min_roadclass"), F.col("ref"), F.col("name"), F.col("edge_highest_highway_type"))
    if omit:
        candidate = F.when(F.col(omit).isNull() | ~F.coalesce(full_name(F.col("ref"), F.col("name")) == F.col(omit), F.lit(False)), candidate)
    return edges.groupBy(*keys).agg(F.min(candidate).alias("_best")).select(*keys, F.col("_best.name").alias("best_name"))


# -- speeds, lengths, units
def speed_kph(maxspeed: Column) -> Column:
    """Mean of the parsable speeds of a tag; ``mph`` values are converted."""
    number = lambda s: F.regexp_extract(s, r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    values = F.filter(F.transform(maxspeed, lambda s: number(s) * F.when(s.contains("mph"), 1.60934).otherwise(1.0)), lambda v: v.isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(values) > 0, total / F.size(values))


def add_edge_speeds(edges: DataFrame, defaults: dict[str, float] = DEFAULT_SPEEDS) -> DataFrame:
    """``speed_kph``: the edge's own, else the mean of its highway type, else the type's default, else the overall mean."""
    rows = edges.withColumn("_own", speed_kph(F.col("maxspeed"))).withColumn("_type", first_or_null(F.col("highway")))
    by_type = rows.groupBy("_type").agg(F.avg("_own").alias("_mean"))  # as many rows as there are types
    filled = by_type.withColumn("_filled", F.coalesce("_mean", F.try_element_at(_map({k: float(v) for k, v in defaults.items()}), F.col("_type"))))
    overall = filled.agg(F.avg("_filled").alias("_overall"))
    types = filled.crossJoin(F.broadcast(overall)).select(F.col("_type").alias("_t"), F.coalesce("_filled", "_overall").alias("_typical"))
    joined = rows.join(F.broadcast(types), rows["_type"].eqNullSafe(types["_t"]), "left")
    return joined.withColumn("speed_kph", F.coalesce("_own", "_typical")).drop("_own", "_type", "_t", "_typical")


def travel_time(length_m: Column, kph: Column) -> Column:
    """Seconds."""
    return length_m / 1000 / kph * 3600


def length_mi(length_m: Column, precision: int = 6) -> Column:
    return F.round(length_m * MILES_PER_METER, precision)


def _converted(value: Column, unit: Column, factors: dict[str, float], missing: list[float], what: str) -> Column:
    u = F.upper(F.trim(unit))
    factor = F.try_element_at(_map(factors), u)
    bad = F.raise_error(F.concat(F.lit(f"unknown unit of {what}: "), unit)).cast("double")
    return F.when(value.isNull() | value.isin(missing) | u.isin(NOT_POPULATED) | u.isNull(), F.lit(None).cast("double")).when(factor.isNull(), bad).otherwise(value * factor)


def length_to_meters(value: Column, unit: Column) -> Column:
    """Null for missing data or an unpopulated unit; an unknown unit is an error."""
    return _converted(value, unit, LENGTH_UNITS, LENGTH_MISSING, "length")


def velocity_to_mps(value: Column, unit: Column) -> Column:
    return _converted(value, unit, VELOCITY_UNITS, VELOCITY_MISSING, "velocity")


# -- levels, codes, scores
def flood_frequency(level: Column) -> Column:
    return F.when(level < RARE_FLOOD_LEVEL, "100 YEAR").when(level.isNotNull(), "500 YEAR")


def federal_class(code: Column) -> Column:
    """Federal functional class of a state's code, by its last digit."""
    return F.try_element_at(_map(FEDERAL_CLASS), (code.try_cast("int") % 10))


def overlap_length(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Length that two intervals, either of which may be descending, have in common."""
    return F.least(F.greatest(a_from, a_to), F.greatest(b_from, b_to)) - F.greatest(F.least(a_from, a_to), F.least(b_from, b_to))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNull(), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def coverage(from_mi: Column, to_mi: Column, edge_mi: Column) -> Column:
    """Share of an edge that a match covers; null without a positive length."""
    return F.when(edge_mi > 0, clamp((to_mi - from_mi) / edge_mi))


def match_score(ratio: Column, confidence: Column, direction: Column, reversed_: Column) -> Column:
    return ratio * confidence * F.when((direction == 0) & reversed_, REVERSED_PENALTY).otherwise(1.0)


def reversal_plan(direction: Column) -> Column:
    """Which ways to try a feature of a direction code: array of flags, true for reversed."""
    return F.when(direction.isNull() | (direction == 0), F.array(F.lit(False), F.lit(True))).when(direction == 1, F.array(F.lit(False))).when(direction.isin(2, 3), F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))


def repaired_distances(start: Column, end: Column, length: Column, direction: Column, reversed_: Column) -> Column:
    """Struct ``start, end`` along the feature: flipped for reverse directions, swapped for a reversed two-way feature."""
    flip, swap = reversed_ & direction.isin(2, 3), reversed_ & ~F.coalesce(direction.isin(2, 3), F.lit(False))
    return F.struct(F.when(flip, length - start).when(swap, end).otherwise(start).alias("start"), F.when(flip, length - end).when(swap, start).otherwise(end).alias("end"))


def detour_differences(base_sec: Column, detour_sec: Column, base_mi: Column, detour_mi: Column) -> Column:
    """Struct ``difference_sec, difference_miles, ratio``, rounded to 3; null without both paths, no ratio without a positive base."""
    both = base_sec.isNotNull() & detour_sec.isNotNull()
    return F.struct(
        F.when(both, F.round(detour_sec - base_sec, 3)).alias("difference_sec"), F.when(both, F.round(detour_mi - base_mi, 3)).alias("difference_miles"),
        F.when(both & (base_sec > 0), F.round(detour_sec / base_sec, 3)).alias("ratio"),
    )


# -- identifiers and regions
def edge_id_text(u: Column, v: Column, key: Column) -> Column:
    return F.concat(F.lit("("), u.cast("string"), F.lit(", "), v.cast("string"), F.lit(", "), key.cast("string"), F.lit(")"))


def extract_version(filename: Column) -> Column:
    """The six digits of an extract's file name; null if it has none."""
    return F.nullif(F.regexp_extract(filename, r"[^0-9](\d{6})\.osm\.pbf$", 1), F.lit(""))


REGION_NAME = r"^(?:(.*-)?buffer-(\d+)mi-|(.*-)?)(state|county|mpo|cousub|place|uac|zcta)-(\d+)(?:[_.].*)?$"


def region_name_parts(path: Column) -> Column:
    """Struct ``prefix, buffer_mi, geolevel, geoid, region`` of a regional file's name; nulls if it is none, buffer 0 by default."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    part = lambda i: F.nullif(F.regexp_extract(name, REGION_NAME, i), F.lit(""))
    level, geoid, buffer = part(4), part(5), part(2).cast("int")
    region = F.concat(F.when(buffer.isNotNull(), F.concat(F.lit("buffer-"), buffer.cast("string"), F.lit("mi-"))).otherwise(""), level, F.lit("-"), geoid)
    return F.struct(F.coalesce(part(1), part(3)).alias("prefix"), F.when(geoid.isNotNull(), F.coalesce(buffer, F.lit(0))).alias("buffer_mi"), level.alias("geolevel"), geoid.alias("geoid"), region.alias("region"))


def region_name(geolevel: Column, geoid: Column, buffer_mi: Column) -> Column:
    """Name of a region, with its buffer if that is positive; a buffer that is no whole number is an error."""
    whole = F.when(buffer_mi.isNull() | (buffer_mi == F.floor(buffer_mi)), F.floor(buffer_mi).cast("string")).otherwise(F.raise_error(F.lit("a buffer is a whole number of miles")).cast("string"))
    return F.lower(F.concat(F.when(buffer_mi > 0, F.concat(F.lit("buffer-"), whole, F.lit("mi-"))).otherwise(""), geolevel, F.lit("-"), geoid))


def region_parameters(path: Column, geoid: Column, buffer_mi: Column) -> Column:
    """Struct ``geoid, buffer_mi``: those given, else those in the file's name."""
    parts = region_name_parts(path)
    return F.struct(F.coalesce(geoid, parts["geoid"]).alias("geoid"), F.coalesce(buffer_mi, parts["buffer_mi"]).alias("buffer_mi"))


def county_code(geoid: Column) -> Column:
    """The inventory's county number of a five-digit county id: the odd county numbers in order."""
    number = F.substring(geoid, 3, 3).try_cast("int")
    return F.when((F.length(geoid) == 5) & (number % 2 == 1), F.floor((number + 1) / 2).cast("int")).otherwise(F.raise_error(F.concat(F.lit("unknown county: "), F.coalesce(geoid, F.lit("null")))).cast("int"))


# -- event predicates
def relevant_event(category: Column, description: Column) -> Column:
    """Weather hazards, and works whose description speaks of floods or washouts once the first naming of a road so called is left out."""
    cleaned = F.regexp_replace(description, r"(?is)^(.*?)(?:washout rd|washout road)", "$1")
    works = F.upper(category).isin("CONSTRUCTION", "MAINTENANCE")
    return (F.upper(category) == "WEATHER HAZARD") | (works & cleaned.rlike("(?i)flood|washout"))


def closed_road(lanes_detail: Column, lanes_status: Column) -> Column:
    return F.ilike(lanes_detail, F.lit("%ALL LANES%")) & (F.ilike(lanes_status, F.lit("%CLOSED%")) | F.ilike(lanes_status, F.lit("%BLOCKED%")))


def event_end(start: Column, interval: Column, minutes: Column) -> Column:
    """End of an event: its interval (text), or else its estimated minutes, after the start."""
    by_minutes = F.timestamp_add("SECOND", F.round(minutes * 60).cast("int"), start)
    stated = F.regexp_extract(interval, r"(?i)^\s*(\d+)", 1).cast("int")
    unit = F.upper(F.regexp_extract(interval, r"(?i)(minute|hour|day|second)s?\s*$", 1))
    by_text = F.when(unit == "SECOND", F.timestamp_add("SECOND", stated, start)).when(unit == "MINUTE", F.timestamp_add("MINUTE", stated, start)).when(unit == "HOUR", F.timestamp_add("HOUR", stated, start)).when(unit == "DAY", F.timestamp_add("DAY", stated, start))
    return F.when(interval.isNotNull(), by_text).otherwise(by_minutes)


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of constants."""
    return spark.createDataFrame(rows, schema)
