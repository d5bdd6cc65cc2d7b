"""The analyses as flows of operators: base network, redundancy, flood impact, event hours, centrality, conflation, and their fusion.

Every flow takes and returns DataFrames; nothing is written between stages unless a lineage is cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfault.functions import geometry as G
from wayfault.functions import scalars as S
from wayfault.operators import centrality, flood, fusion, intervals, paths, simplify, spans, spatial_join
from wayfault.operators import linear_reference as lrs
from wayfault.operators.inventory import attribute_pulls
from wayfault.operators.scratch import cut
from wayfault.operators.validation import require_key, require_unchanged
from wayfault.sources import readers

EDGE = ["u", "v", "key"]
QUADRAT, PAIRING = 0.005, 12.5


@dataclass
class Network:
    """Nodes, base edges, and enriched edges of a region."""

    nodes: DataFrame
    base: DataFrame
    edges: DataFrame


def base_network(ways: DataFrame, nodes: DataFrame, region: Column | None = None) -> Network:
    """Ways and nodes to a simplified network with classes, names, speeds, lengths and way slices.

    ``ways``: ``osmid, node_ids, oneway`` and the tags ``highway, service, ref, name, bridge, tunnel, surface, maxspeed``, strings.
    """
    base = cut(readers.base_edges(ways, nodes))
    tags = ("osmid", "highway", "service", "ref", "name", "bridge", "tunnel", "surface", "maxspeed")
    edges = cut(simplify.oriented(simplify.simplify(base, nodes, tags), nodes))
    edges = edges.withColumn("_rc", S.road_class(F.col("highway"), F.col("service"))).select("*", "_rc.*").drop("_rc")
    edges = S.add_edge_speeds(edges.withColumn("bridge", S.bridge_value(F.col("bridge"))).withColumn("is_paved", S.is_paved(F.col("surface"))))
    edges = edges.withColumns({"travel_time": S.travel_time(F.col("length"), F.col("speed_kph")), "length_mi": S.length_mi(F.col("length"))})
    edges = edges.withColumns({"refs": F.col("ref"), "names": F.col("name")}).withColumns({"ref": S.last_ref(F.col("ref")), "name": S.first_name(F.col("name"))})
    edges = cut(edges)
    named = edges.where("edge_min_roadclass IS NOT NULL")
    edges = edges.join(paths.street_names(named), EDGE, "left")
    slices = simplify.way_slices(edges, base)
    edges = edges.join(slices.select(*EDGE, "way_along"), EDGE, "left")
    inside = F.exists("geometry", lambda p: G.in_polygon(p["x"], p["y"], region, True)) if region is not None else F.lit(True)
    return Network(nodes, base, cut(edges.withColumn("_intersects_region_", inside)))


def redundancy(network: Network, max_class: int = 4, paved_only: bool = True) -> DataFrame:
    """Detour cost of every major edge in the region."""
    targets = network.edges.where(F.col("roadclass").between(0, max_class) & F.col("_intersects_region_"))
    return paths.redundancy(network.edges, targets, paved_only)


def flood_impact(network: Network, floodplains: DataFrame, width: float = QUADRAT) -> DataFrame:
    """Impact columns of every edge from hazard polygons (``floodplain_idx, polygon, flood_risk_level``)."""
    bridges, surface = spans.bridge_spans(network.edges), cut(spans.nonbridge_spans(network.edges))
    keys = [*EDGE, "span_idx"]
    met = spatial_join.lines_in_polygons(surface.select(*keys, F.col("geometry").alias("line")), floodplains, width, keys, ["floodplain_idx"])
    levels = flood.span_levels(met, floodplains.select("floodplain_idx", "flood_risk_level"))
    edges = network.edges.select(*EDGE)
    return require_unchanged(edges, flood.impacts(edges, surface.select(*keys), bridges.select(*keys), levels), EDGE)


def event_hours(network: Network, events: DataFrame, lon0: float, lat0: float, limit: float = PAIRING) -> DataFrame:
    """Outage hours by category of each road from events (``event_id, x, y`` in degrees and the columns of ``collected_events``).

    Spans and events are projected about a centre; events are paired with spans off bridges first, the rest with bridges.
    """
    keys = [*EDGE, "span_idx"]
    flat = lambda df: df.select(*keys, G.project_line(F.col("geometry"), lon0, lat0).alias("line"))
    p = G.laea(F.col("x"), F.col("y"), lon0, lat0)
    points = events.select("event_id", p.alias("_p")).select("event_id", "_p.x", "_p.y")
    pairs = spatial_join.two_pass_pairs(flat(spans.nonbridge_spans(network.edges)), flat(spans.bridge_spans(network.edges)), points, limit, keys, ["event_id"])
    return intervals.hours_by_category(intervals.collected_events(pairs.select(*EDGE, "event_id").distinct(), events))


def network_centrality(network: Network) -> tuple[DataFrame, DataFrame]:
    """Node metrics, and edges with edge betweenness and the node metrics of both ends."""
    edges = network.edges.select(*EDGE, "travel_time")
    sums = cut(centrality.path_sums(edges))
    nodes = centrality.node_betweenness(edges, sums).join(centrality.closeness(edges, sums), "node_id").join(centrality.communities(edges), "node_id", "left")
    return nodes, centrality.on_edges(centrality.edge_betweenness(edges, sums), nodes)


def event_layers(network: Network, events: DataFrame, lon0: float, lat0: float, limit: float = PAIRING) -> dict[str, DataFrame]:
    """The layers of the event analysis: roads with hours (main output), and for quality checks the pairs, both kinds of spans, and events with how they were paired."""
    keys = [*EDGE, "span_idx"]
    flat = lambda df: df.select(*keys, G.project_line(F.col("geometry"), lon0, lat0).alias("line"))
    surface, bridges = cut(spans.nonbridge_spans(network.edges)), cut(spans.bridge_spans(network.edges))
    p = G.laea(F.col("x"), F.col("y"), lon0, lat0)
    points = events.select("event_id", p.alias("_p")).select("event_id", "_p.x", "_p.y")
    pairs = cut(spatial_join.two_pass_pairs(flat(surface), flat(bridges), points, limit, keys, ["event_id"]))
    hours = intervals.hours_by_category(intervals.collected_events(pairs.select(*EDGE, "event_id").distinct(), events))
    roads = network.edges.select(*EDGE, "geometry").join(hours, EDGE)
    back = pairs.withColumn("shortest_line", G.unproject_line(F.col("shortest_line"), lon0, lat0))
    return {
        "roads_with_hours": roads, "road_span_and_event_pairs": back, "nonbridge_spans": surface, "bridge_spans": bridges,
        "events": spatial_join.pairing_summary(events, pairs, "event_id"),
    }


def conflation(network: Network, match_rows: DataFrame, inventory: dict[str, DataFrame]) -> DataFrame:
    """Edges with the route that matches best and the attributes of the inventory's tables (as ``inventory.attribute_pulls`` names them)."""
    return require_key(lrs.conflate(match_rows, network.edges, attribute_pulls(inventory)), EDGE)


def conflation_layers(network: Network, routes: DataFrame, conflated: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The layers of conflation: edges with attributes (main output), and for quality checks all edges, all routes (``route_id``) and the unmatched ones; and the matching rate."""
    matched = conflated.select("route_id").distinct()
    layers = {
        "edges_with_attributes": network.edges.select(*EDGE, "geometry").join(conflated, EDGE), "all_edges": network.edges, "all_routes": routes,
        "unmatched_routes": routes.join(matched, "route_id", "left_anti"),
    }
    return layers, lrs.matching_rate(routes.join(matched, "route_id", "left_semi"), routes, ["route_id"])


def fused(network: Network, parts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The fused table, numbered, and its simplified form; edges of the region only."""
    edges = fusion.in_region(network.edges).drop("way_along", "merged_edges", "refs", "names")
    out = fusion.fuse(edges, parts)
    return fusion.numbered(out), fusion.simplified(out)
