"""One row per road with the results of all analyses, and the simplified table that is published."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfault.operators.linear_reference import with_sequence
from wayfault.operators.validation import require_columns, require_key, require_same_keys

EDGE = ["u", "v", "key"]
#: Columns kept of the flood and the centrality analyses.
FLOOD_COLUMNS = ["nonfunctional_reason", "nonfunctional_risk_level", "nonfunctional_frequency", "isolated_edge_risk_level", "isolated_edge_frequency"]
CENTRALITY_COLUMNS = [
    "node_betweenness_centrality_u", "node_betweenness_centrality_v", "edge_betweenness_centrality", "closeness_centrality_u", "closeness_centrality_v", "louvain_community_u", "louvain_community_v",
]
#: Published names of columns, and the columns that they are.
PUBLISHED = {
    "openlr_roadclass": "roadclass", "redundancy_detour_seconds_diff": "redundancy_difference_sec", "road_network_edge_betweenness_centrality": "centrality_edge_betweenness_centrality",
    "flood_related_events_count": "events_all_incidents_count",
}


def in_region(edges: DataFrame) -> DataFrame:
    require_columns(edges, {"u": None, "v": None, "key": None, "_intersects_region_": "boolean"})
    return edges.where("_intersects_region_")


def prefixed(df: DataFrame, prefix: str, columns: list[str] | None = None) -> DataFrame:
    """Key and chosen columns, the latter prefixed; missing ones are left out."""
    chosen = [c for c in (columns or df.columns) if c in df.columns and c not in EDGE]
    return df.select(*EDGE, *[F.col(c).alias(prefix + c) for c in chosen])


def fuse(edges: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """Left joins of the parts (each one row per edge at most) on the key, columns prefixed by ``name_``; keys must be preserved.

    All joins share one key, so the edges are shuffled once.
    """
    base = require_key(edges, EDGE)
    out = reduce(lambda a, kv: a.join(prefixed(require_key(kv[1], EDGE), f"{kv[0]}_"), EDGE, "left"), parts.items(), base)
    return require_same_keys(base, out, EDGE)


def numbered(fused: DataFrame) -> DataFrame:
    """``_id_`` from 1 in the order of the key."""
    return with_sequence(fused, EDGE, "_id_", 1)


def search_text() -> Column:
    """Text to search an edge by: the line through its first two vertices."""
    p = lambda i: F.concat_ws(",", F.round(F.get("geometry", F.lit(i))["y"], 6).cast("string"), F.round(F.get("geometry", F.lit(i))["x"], 6).cast("string"))
    return F.concat_ws(" to ", p(0), p(1))


def simplified(fused: DataFrame) -> DataFrame:
    """The published columns; flood frequencies only of edges that flood themselves."""
    have = fused.columns
    flooded = F.when(F.col("flood_nonfunctional_reason") == "FLOODED", F.col("flood_nonfunctional_frequency")) if "flood_nonfunctional_reason" in have else F.lit(None).cast("string")
    columns = [F.col(c).alias(n) if c in have else F.lit(None).cast("string").alias(n) for n, c in PUBLISHED.items()]
    return fused.select(*EDGE, *columns, flooded.alias("flooding_vulnerability_frequency"), *(["geometry"] if "geometry" in have else []))
