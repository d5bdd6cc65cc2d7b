"""Spans of an edge: runs of its way slices that are bridges, and those that are not.

``way_along``: array of structs ``start_ratio_along, end_ratio_along, start_coord_idx, end_coord_idx, osmid, ref, name, bridge_tag, tunnel_tag,
osm_nodes``, in order along the edge.  Runs are folded within the array, so an edge's spans need no shuffle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfault.functions import geometry as G

EDGE = ["u", "v", "key"]


def is_bridge(tag: Column) -> Column:
    return F.coalesce(tag != "no", F.lit(False))


def runs(items: Column, flag) -> Column:
    """Array of arrays: consecutive elements with the same flag together."""
    n = F.size(items)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (flag(F.get(items, i)) != flag(F.get(items, i - 1))))
    cut = F.transform(starts, lambda s, k: F.slice(items, s + 1, F.coalesce(F.get(starts, k + 1), n) - s))
    return F.when(n > 0, cut).otherwise(F.slice(F.array(items), 1, 0))


def _spans(edges: DataFrame, bridge: bool) -> DataFrame:
    flag = lambda x: is_bridge(x["bridge_tag"])
    own = F.filter(runs(F.col("way_along"), flag), lambda r: flag(r[0]) == bridge)
    rows = edges.select(*EDGE, *(["geometry"] if "geometry" in edges.columns else []), F.posexplode(own).alias("span_idx", "_run"))
    r = F.col("_run")
    start, end = F.array_min(F.col("_run.start_coord_idx")), F.array_max(F.col("_run.end_coord_idx"))
    out = rows.withColumns({
        "start_coord_idx": start, "end_coord_idx": end, "start_ratio_along": F.array_min(F.col("_run.start_ratio_along")), "end_ratio_along": F.array_max(F.col("_run.end_ratio_along")),
        "osmids": F.transform(r, lambda x: x["osmid"]), "osm_nodes": F.flatten(F.transform(r, lambda x: x["osm_nodes"])),
    })
    if bridge:
        out = out.withColumns({"refs": F.col("_run.ref"), "names": F.col("_run.name"), "bridge_tags": F.col("_run.bridge_tag")})
    if "geometry" in edges.columns:
        out = out.withColumn("geometry", G.substring(F.col("geometry"), F.col("start_coord_idx"), F.col("end_coord_idx"))).where("geometry IS NOT NULL")
    return out.where("end_coord_idx > start_coord_idx").drop("_run")


def bridge_spans(edges: DataFrame) -> DataFrame:
    """A row per run of bridge slices; ``span_idx`` from 0 in each edge."""
    return _spans(edges, True)


def nonbridge_spans(edges: DataFrame) -> DataFrame:
    return _spans(edges, False)


def broken_chains(chains: DataFrame, keys: list[str], nodes: str) -> DataFrame:
    """Positions where a chain's consecutive pair (``u, v``) is listed: ``keys, pos, u, v``."""
    pairs = F.transform(F.slice(F.col(nodes), F.lit(1), F.greatest(F.size(nodes) - 1, F.lit(0))), lambda x, i: F.struct(x.alias("u"), F.get(F.col(nodes), i + 1).alias("v")))
    return chains.select(*keys, F.posexplode(pairs).alias("pos", "_p")).select(*keys, "pos", "_p.u", "_p.v")


def simple_ranges(line: list[tuple[float, float]]) -> list[tuple[int, int]]:
    """Greedy split of a line into index ranges whose parts neither cross nor touch themselves; a ring is no simple part, so it is split before it closes."""
    out, start, n = [], 0, len(line)
    while start < n - 1:
        end = start + 1
        while end + 1 < n and _extends(line, start, end):
            end += 1
        out.append((start, end))
        start = end
    return out


def _extends(line, start: int, end: int) -> bool:
    """Whether the part from ``start`` to ``end`` stays simple with the next segment."""
    a, b = line[end], line[end + 1]
    if a == b:
        return True
    for i in range(start, end - 1):
        if _meet(a, b, line[i], line[i + 1]):
            return False
    c = line[end - 1]  # the segment before may not be run back over
    cross = (a[0] - c[0]) * (b[1] - a[1]) - (a[1] - c[1]) * (b[0] - a[0])
    return not (cross == 0 and (a[0] - c[0]) * (b[0] - a[0]) + (a[1] - c[1]) * (b[1] - a[1]) < 0)


def _side(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _on(a, b, c) -> bool:
    return _side(a, b, c) == 0 and min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])


def _meet(a, b, c, d) -> bool:
    s = _side(c, d, a) * _side(c, d, b) < 0 and _side(a, b, c) * _side(a, b, d) < 0
    return s or _on(c, d, a) or _on(c, d, b) or _on(a, b, c) or _on(a, b, d)


def split_simple(edges: DataFrame) -> DataFrame:
    """``u, v, key, part_idx, start_idx, end_idx, geometry`` of the simple parts of each edge's line."""
    def ranges(lines: pd.Series) -> pd.Series:
        return lines.map(lambda line: [{"start_idx": a, "end_idx": b} for a, b in simple_ranges([(p["x"], p["y"]) for p in line])] if line is not None else None)

    cut = F.pandas_udf(ranges, "array<struct<start_idx:int,end_idx:int>>")
    rows = edges.select(*EDGE, "geometry", F.posexplode(cut("geometry")).alias("part_idx", "_r"))
    return rows.select(*EDGE, "part_idx", "_r.start_idx", "_r.end_idx", G.substring(F.col("geometry"), F.col("_r.start_idx"), F.col("_r.end_idx")).alias("geometry"))
