"""Linear-referenced inventories: interval joins on route and milepoint, attribute pulls, best matches per edge.

An interval may be descending.  Interval joins are equi-joins on the route with the overlap as a residual condition; with a
``width`` both sides are listed under the milepoint bins that they touch, so a long or popular route is split, and a pair is
kept in one bin only: the first one that both touch.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfault.functions import scalars as S
from wayfault.operators.scratch import cut
from wayfault.operators.validation import require_key

EDGE = ["u", "v", "key"]


def low(a: Column, b: Column) -> Column:
    return F.least(a, b)


def high(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _binned(df: DataFrame, lo: Column, hi: Column, width: float) -> DataFrame:
    first, last = F.floor(lo / width).cast("long"), F.floor(hi / width).cast("long")
    return df.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_join(matches: DataFrame, events: DataFrame, width: float | None = None) -> DataFrame:
    """Matches (``route_id, min_from_mi, max_to_mi``) and current events (``event_route_id, from_measure, to_measure, to_date``) that overlap
    over more than a point, with ``overlap_mi``.
    """
    a, b = matches, events.where("to_date IS NULL")
    alo, ahi = low(F.col("min_from_mi"), F.col("max_to_mi")), high(F.col("min_from_mi"), F.col("max_to_mi"))
    blo, bhi = low(F.col("from_measure"), F.col("to_measure")), high(F.col("from_measure"), F.col("to_measure"))
    on = (F.col("route_id") == F.col("event_route_id")) & (ahi > blo) & (alo < bhi)
    if width:
        a, b = _binned(a, alo, ahi, width), _binned(b, blo, bhi, width).withColumnsRenamed({"_bin": "_bin_b", "_first": "_first_b"})
        on = on & (F.col("_bin") == F.col("_bin_b")) & (F.col("_bin") == F.greatest("_first", "_first_b"))
    out = a.join(b, on).withColumn("overlap_mi", S.overlap_length(F.col("min_from_mi"), F.col("max_to_mi"), F.col("from_measure"), F.col("to_measure")))
    return out.drop("_bin", "_first", "_bin_b", "_first_b")


def point_join(matches: DataFrame, points: DataFrame) -> DataFrame:
    """Matches and current points (``event_route_id, measure, to_date``) in their range, ends included."""
    inside = F.col("measure").between(low(F.col("min_from_mi"), F.col("max_to_mi")), high(F.col("min_from_mi"), F.col("max_to_mi")))
    return matches.join(points.where("to_date IS NULL"), (F.col("route_id") == F.col("event_route_id")) & inside)


def one_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def longest_overlap(df: DataFrame, key: str = "_idx_", ties: tuple[str, ...] = ()) -> DataFrame:
    return one_each(df, [key], [F.desc_nulls_last("overlap_mi"), *[F.asc_nulls_last(t) for t in ties]])


def lowest_rating(df: DataFrame, rating: str, key: str = "_idx_", ties: tuple[str, ...] = ()) -> DataFrame:
    """The row of each key with the lowest rating; unrated rows come last."""
    return one_each(df, [key], [F.asc_nulls_last(rating), *[F.asc_nulls_last(t) for t in ties]])


def latest_count(df: DataFrame) -> DataFrame:
    """One count for each match and start measure: smallest ``dd_id``, then latest ``from_date``."""
    return one_each(df, ["_idx_", "from_measure"], [F.asc_nulls_last("dd_id"), F.desc_nulls_last("from_date"), F.asc_nulls_last("overlap_mi")])


# -- attribute pulls: each gives ``_idx_, overlap_mi`` and the attributes of every overlap, distinct; dealt by match once, as the choice among them needs it too
def functional_class(matches: DataFrame, events: DataFrame, types: DataFrame) -> DataFrame:
    """``types``: ``type_id, type_functional_class, federal_aid_flag, class_hierarchy``."""
    got = overlap_join(matches, events).join(F.broadcast(types), F.col("functional_class") == F.col("type_id"), "left")
    return got.select("_idx_", "overlap_mi", "functional_class", S.federal_class(F.col("type_functional_class")).alias("federal_class"), "federal_aid_flag", "class_hierarchy").repartition("_idx_").distinct()


def domain_lookup(rows: DataFrame, code: str, domain: str, domains: DataFrame, entries: DataFrame) -> DataFrame:
    """``rows`` with the ``description`` of a code in a domain.

    ``domains``: ``domain_type_id, domain_index``; ``entries``: ``entry_type_id, entry_id, description``.  The domain is chosen by a constant, so
    the two small tables are reduced first; without the domain or the code the description is null.
    """
    chosen = domains.where(F.col("domain_index") == domain).join(entries, F.col("domain_type_id") == F.col("entry_type_id")).select("entry_id", "description")
    return rows.join(F.broadcast(chosen), F.col(code) == F.col("entry_id"), "left").drop("entry_id")


def coded_overlaps(matches: DataFrame, events: DataFrame, code: str, domain: str, domains: DataFrame, entries: DataFrame) -> DataFrame:
    """Strategic network or truck route of each overlap, with its description."""
    got = domain_lookup(overlap_join(matches, events), code, domain, domains, entries)
    return got.select("_idx_", "overlap_mi", code, "description").repartition("_idx_").distinct()


def structures_along(matches: DataFrame, events: DataFrame, inventory: DataFrame, number: str) -> DataFrame:
    """Inventory rows of bridges whose interval overlaps a match."""
    return overlap_join(matches, events).select("_idx_", number).repartition("_idx_").distinct().join(inventory, number)


def structures_at(matches: DataFrame, points: DataFrame, inventory: DataFrame, number: str) -> DataFrame:
    """Inventory rows of culverts that lie within a match."""
    return point_join(matches, points).select("_idx_", number).repartition("_idx_").distinct().join(inventory, number)


def enriched(matches: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """Matches (key ``_idx_``, ``u, v, key``) left-joined with one row of each part, columns prefixed by the part's name."""
    def prefixed(name: str, df: DataFrame) -> DataFrame:
        return df.select("_idx_", *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "_idx_"])

    out = reduce(lambda a, kv: a.join(prefixed(*kv), "_idx_", "left"), parts.items(), matches)
    return out.distinct()


# -- from match rows to one route per edge
def matches_to_edges(match_rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Match rows of base node pairs (``osm_u, osm_v``) on the edges that contain them.

    ``edges``: ``u, v, key, length_mi, merged_edges`` (array of ``u, v``); gives ``u, v, key, route_id, reversed_input, from_mi, to_mi,
    ratio_covered, score, direction, matching_confidence``.
    """
    base = edges.where("length_mi > 0").select(*EDGE, "length_mi", F.explode("merged_edges").alias("_m"))
    rows = match_rows.where("start_dist_along_mi IS NOT NULL AND end_dist_along_mi IS NOT NULL")
    got = rows.join(base, (F.col("osm_u") == F.col("_m.u")) & (F.col("osm_v") == F.col("_m.v")))
    a, b = F.least("start_dist_along_mi", "end_dist_along_mi"), F.greatest("start_dist_along_mi", "end_dist_along_mi")
    got = got.withColumn("from_mi", a).withColumn("to_mi", b).withColumn("ratio_covered", S.coverage(F.col("from_mi"), F.col("to_mi"), F.col("length_mi")))
    score = S.match_score(F.col("ratio_covered"), F.col("matching_confidence"), F.col("direction"), F.col("reversed_input"))
    return got.select(*EDGE, "route_id", "reversed_input", "from_mi", "to_mi", "ratio_covered", score.alias("score"), "direction", "matching_confidence")


def rolled_up(edge_matches: DataFrame) -> DataFrame:
    """One row per edge, route and way, with the penalty ``|score - 1|``."""
    out = edge_matches.groupBy(*EDGE, "route_id", "reversed_input").agg(
        F.min("from_mi").alias("min_from_mi"), F.max("to_mi").alias("max_to_mi"), F.sum("ratio_covered").alias("_ratio"), F.sum("score").alias("score"),
    )
    return out.withColumn("ratio_covered", S.clamp(F.col("_ratio"))).withColumn("penalty", F.abs(F.col("score") - 1)).drop("_ratio")


def best_route(edge_matches: DataFrame) -> DataFrame:
    """The route of each edge with the lowest penalty; ties by route and way."""
    return one_each(rolled_up(edge_matches), EDGE, [F.asc("penalty"), F.asc("route_id"), F.asc("reversed_input")])


def fill_reverse(best: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds edges without a match whose reverse has one: measures swapped, way negated, no score."""
    missing = edges.select(*EDGE).distinct().join(best, EDGE, "left_anti")
    back = best.select(F.col("v").alias("u"), F.col("u").alias("v"), "key", "route_id", F.col("max_to_mi").alias("min_from_mi"), F.col("min_from_mi").alias("max_to_mi"), "ratio_covered", F.lit(None).cast("double").alias("score"), (~F.col("reversed_input")).alias("reversed_input"))
    filled = missing.join(back, EDGE).withColumn("match_type", F.lit("filled_reverse"))
    direct = best.select(*EDGE, "route_id", "min_from_mi", "max_to_mi", "ratio_covered", "score", "reversed_input").withColumn("match_type", F.lit("direct"))
    return direct.unionByName(filled)


def numbered_matches(selected: DataFrame) -> DataFrame:
    """``_idx_`` from 0 in the order of the key."""
    return with_sequence(selected, EDGE, "_idx_", 0)


def with_sequence(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """A gapless number in global order, without gathering the rows: ranges are sorted apart and shifted by the sizes of those before."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    keyed = ranged.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33))
    keyed = cut(keyed)
    sizes = keyed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_before")
    return keyed.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i") + start).drop("_p", "_i", "_before")


def conflate(match_rows: DataFrame, edges: DataFrame, pulls: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Match rows to enriched edges: best routes, reverse fill, numbering, attribute pulls (each a function of the numbered matches)."""
    best = best_route(matches_to_edges(match_rows, edges))
    selected = numbered_matches(require_key(fill_reverse(best, edges), EDGE))
    return enriched(selected, {name: pull(selected) for name, pull in pulls.items()})


def matching_rate(matched: DataFrame, every: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of distinct keys and their ratio; 0 for an empty inventory."""
    m, t = matched.select(*keys).distinct().agg(F.count(F.lit(1)).alias("matched")), every.select(*keys).distinct().agg(F.count(F.lit(1)).alias("total"))
    return m.crossJoin(t).withColumn("rate", F.when(F.col("total") > 0, F.col("matched") / F.col("total")).otherwise(0.0))  # two single rows
