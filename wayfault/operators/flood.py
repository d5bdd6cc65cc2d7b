"""Flood hazard: ranks of zones, risk levels of spans, and the edges that flood, lose their bridges or get isolated, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfault.functions.scalars import flood_frequency
from wayfault.operators.components import components, outside_largest
from wayfault.operators.scratch import cut

EDGE = ["u", "v", "key"]
#: Flood zones with their subtype (None: without), 1 being the worst.
ZONE_RANKS = [
    ("VE", "RIVERINE FLOODWAY SHOWN IN COASTAL ZONE", 1), ("VE", "COASTAL FLOODPLAIN", 2), ("VE", None, 3), ("V", None, 4), ("AE", "RIVERINE FLOODWAY SHOWN IN COASTAL ZONE", 5),
    ("AE", "RIVERINE FLOODPLAIN IN COASTAL AREA", 6), ("AE", "FLOODWAY", 7), ("AE", "FW", 7), ("AE", "COASTAL FLOODPLAIN", 8), ("AO", "COASTAL FLOODPLAIN", 9), ("AO", None, 10), ("AE", None, 11),
    ("AH", None, 12), ("A", None, 13), ("X", "0.2 PCT ANNUAL CHANCE FLOOD HAZARD", 14), ("X", "1 PCT DEPTH LESS THAN 1 FOOT", 15), ("X", "AREA WITH REDUCED FLOOD RISK DUE TO LEVEE", 16), ("X", None, 17),
    ("OPEN WATER", None, 18),
]
ISOLATED_BEFORE = -1


def zone_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ZONE_RANKS, "zone string, subtype string, flood_risk_level int")


def with_rank(df: DataFrame, zone: str = "fld_zone", subtype: str = "zone_subty") -> DataFrame:
    """``df`` with ``flood_risk_level``; null for a pair that is not in the table."""
    ranks = F.broadcast(zone_table(df.sparkSession))  # 19 rows
    return df.join(ranks, F.col(zone).eqNullSafe(F.col("zone")) & F.col(subtype).eqNullSafe(F.col("subtype")), "left").drop("zone", "subtype")


def require_ranks(df: DataFrame, zone: str = "fld_zone", subtype: str = "zone_subty") -> DataFrame:
    """As ``with_rank``, but an unexpected pair is an error."""
    ranked = with_rank(df, zone, subtype)
    bad = F.raise_error(F.concat(F.lit("unexpected flood zone: "), F.coalesce(F.col(zone), F.lit("null")), F.lit("/"), F.coalesce(F.col(subtype), F.lit("null")))).cast("int")
    return ranked.withColumn("flood_risk_level", F.coalesce("flood_risk_level", bad))


def highest_zone(df: DataFrame, keys: list[str]) -> DataFrame:
    """Worst known zone of each key: ``keys, fld_zone, zone_subty, flood_risk_level``, nulls without any."""
    best = with_rank(df).groupBy(*keys).agg(F.min(F.when(F.col("flood_risk_level").isNotNull(), F.struct("flood_risk_level", "fld_zone", "zone_subty"))).alias("b"))
    return best.select(*keys, "b.fld_zone", "b.zone_subty", "b.flood_risk_level")


def span_levels(pairs: DataFrame, floodplains: DataFrame) -> DataFrame:
    """Smallest risk level of each span among the floodplains that it meets."""
    return pairs.join(floodplains, "floodplain_idx").groupBy(*EDGE, "span_idx").agg(F.min("flood_risk_level").alias("level"))


def edge_level(levels: DataFrame) -> DataFrame:
    """Level at which an edge is last recorded as flooded: the mildest of its spans' levels."""
    return levels.groupBy(*EDGE).agg(F.max("level").alias("level"))


def prune_bridges(flooded: DataFrame, surface: DataFrame, bridges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bridges that lose their function when ``flooded`` edges have gone, and those left.

    Nodes that flooded edges left (or led to) and that no surface edge leaves (or leads to) any more are dead ends; bridges from or
    to them are pruned, which makes further dead ends of nodes that no surface edge and no bridge serves, until nothing changes.
    """
    def dead(gone: DataFrame, left: DataFrame, column: str) -> DataFrame:
        return gone.select(column).distinct().join(left.select(column), column, "left_anti")

    pruned, working, gone = bridges.limit(0), bridges, flooded
    leaving, arriving = None, None
    while True:
        both = surface.select("u", "v") if leaving is None else working.select("u", "v").union(surface.select("u", "v"))
        new_u, new_v = dead(gone, both, "u"), dead(gone, both, "v")
        leaving = new_u if leaving is None else leaving.union(new_u)
        arriving = new_v if arriving is None else arriving.union(new_v)
        leaving, arriving = cut(leaving.distinct()), cut(arriving.distinct())
        # a bridge from a node that nothing leads to, or to a node that nothing leaves
        from_nowhere = working.join(arriving.select(F.col("v").alias("u")), "u", "left_semi").select(*EDGE)
        to_nowhere = working.join(leaving.select(F.col("u").alias("v")), "v", "left_semi").select(*EDGE)
        gone = cut(from_nowhere.union(to_nowhere).distinct())
        if gone.isEmpty():
            return pruned, working
        pruned = cut(pruned.select(*EDGE).union(gone))
        working = cut(working.join(gone, EDGE, "left_anti"))


def impacts(edges: DataFrame, surface_spans: DataFrame, bridge_spans: DataFrame, levels: DataFrame) -> DataFrame:
    """Impact columns of every edge (``u, v, key``).

    ``surface_spans``, ``bridge_spans``: their keys; ``levels``: ``u, v, key, span_idx, level`` of flooded surface spans.  At most 18 levels are
    passed, from the worst; each removes flooded edges, prunes bridges, and finds edges cut off from the largest component.
    """
    surface = cut(edges.select(*EDGE).join(surface_spans.select(*EDGE).distinct(), EDGE, "left_semi"))
    bridges = cut(edges.select(*EDGE).join(bridge_spans.select(*EDGE).distinct(), EDGE, "left_semi").join(surface, EDGE, "left_anti"))
    by_level = cut(levels.select(*EDGE, "level").distinct())
    graph = cut(_undirected(edges))
    nodes = edges.select(F.col("u").alias("node_id")).union(edges.select("v")).distinct()
    cut_off = cut(outside_largest(components(nodes, graph)))
    isolated = cut(edges.select(*EDGE).join(cut_off.select(F.col("node_id").alias("u")), "u", "left_semi").select(*EDGE).withColumn("level", F.lit(ISOLATED_BEFORE)))
    nodes = cut(nodes.join(cut_off, "node_id", "left_anti"))
    graph = cut(graph.join(cut_off.select(F.col("node_id").alias("u")), "u", "left_anti"))
    reasons = None
    for level in sorted(r.level for r in by_level.select("level").distinct().collect()):  # at most 18 values
        flooded = cut(by_level.where(F.col("level") == level).select(*EDGE))
        surface = cut(surface.join(flooded, EDGE, "left_anti"))
        pruned, bridges = prune_bridges(flooded, surface, bridges)
        now = flooded.withColumn("reason", F.lit("FLOODED")).unionByName(pruned.select(*EDGE).withColumn("reason", F.lit("BRIDGE_FUNCTIONALLY_DISCONNECTED"))).withColumn("level", F.lit(level))
        now = cut(now)
        both = now if reasons is None else reasons.unionByName(now)  # the later level stands
        reasons = cut(both.groupBy(*EDGE).agg(F.max(F.struct("level", "reason")).alias("_r")).select(*EDGE, "_r.reason", "_r.level"))
        graph = cut(graph.join(_undirected(now).select("u", "v", "key"), EDGE, "left_anti"))
        apart = outside_largest(components(nodes, graph)).select(F.col("node_id").alias("u"))
        new = surface.unionByName(bridges.select(*EDGE)).join(apart, "u", "left_semi").join(isolated, EDGE, "left_anti").select(*EDGE).withColumn("level", F.lit(level))
        isolated = cut(isolated.unionByName(new))
    if reasons is None:
        reasons = edges.select(*EDGE).limit(0).withColumn("reason", F.lit("")).withColumn("level", F.lit(0))
    return impact_columns(edges, reasons, isolated)


def _undirected(edges: DataFrame) -> DataFrame:
    """Edges without their direction: one row for both."""
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "key").distinct()


def impact_columns(edges: DataFrame, reasons: DataFrame, isolated: DataFrame) -> DataFrame:
    r = reasons.select(*EDGE, F.col("reason").alias("nonfunctional_reason"), F.col("level").alias("nonfunctional_risk_level"))
    i = isolated.select(*EDGE, F.col("level").alias("isolated_edge_risk_level"))
    out = edges.join(r, EDGE, "left").join(i, EDGE, "left").withColumn("nonfunctional_reason", F.coalesce("nonfunctional_reason", F.lit("NOT_IMPACTED")))
    level = lambda c: flood_frequency(F.col(c))
    return out.withColumn("nonfunctional_frequency", level("nonfunctional_risk_level")).withColumn("isolated_edge_frequency", level("isolated_edge_risk_level"))


def frequency(level: Column) -> Column:
    return flood_frequency(level)
