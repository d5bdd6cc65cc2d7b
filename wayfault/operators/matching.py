"""Map matching: a hidden Markov matcher, and the tables that a match response is made of.

The matcher (Newson and Krumm 2009) finds candidates of each trace point by a grid join in Spark; equal traces are decoded as one.  Traces with the same
surroundings are decoded in groups of bounded size, each with one copy of that part of the network, so no task holds the whole network and routes are searched once a group.

A response's tables: ``tracepoints`` (``trace_id, idx, matching_idx, waypoint_idx, x, y``; nulls for a point without a match), ``legs``
(``trace_id, matching_idx, leg_idx, nodes``) and ``matchings`` (``trace_id, matching_idx, confidence``).
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfault.functions import geometry as G
from wayfault.operators.scratch import cut
from wayfault.operators.spatial_join import dealt, expanded, shapes

SIGMA, BETA = 5.0, 10.0
RADIUS = 15.0
SLACK = 200.0
METERS_PER_MILE = 1609.34
#: Candidates that are decoded with one copy of their surroundings.
AT_ONCE = 20_000


# -- candidates and decoding
def candidates(points: DataFrame, edges: DataFrame, radius: float = RADIUS, width: float | None = None) -> DataFrame:
    """Edges within ``radius`` of each trace point (``trace_id, idx, x, y``; planar metres): distance and place along the edge.

    ``edges``: ``u, v, key, x1, y1, x2, y2``, straight.
    """
    width = width or 4 * radius
    box = [F.least("x1", "x2") - radius, F.least("y1", "y2") - radius, F.greatest("x1", "x2") + radius, F.greatest("y1", "y2") + radius]
    a = edges.withColumns(dict(zip(("_x0", "_y0", "_x1", "_y1"), box, strict=True)))
    a = a.withColumn("_cell", F.explode(G.cells_of_box(F.col("_x0"), F.col("_y0"), F.col("_x1"), F.col("_y1"), width))).select("*", F.col("_cell.cx").alias("_cx"), F.col("_cell.cy").alias("_cy"))
    b = points.withColumns({"_cx": G.cell(F.col("x"), width), "_cy": G.cell(F.col("y"), width)})
    s = {"a": {"x": F.col("x1"), "y": F.col("y1")}, "b": {"x": F.col("x2"), "y": F.col("y2")}}
    foot = G.foot(F.col("x"), F.col("y"), s)
    inside = F.col("x").between(F.col("_x0"), F.col("_x1")) & F.col("y").between(F.col("_y0"), F.col("_y1"))
    near = b.join(a, ["_cx", "_cy"]).where(inside).where(foot["d2"] <= radius * radius)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return near.select("trace_id", "idx", "x", "y", "u", "v", "key", F.sqrt(foot["d2"]).alias("distance"), foot["t"].alias("t"), F.sqrt(dx * dx + dy * dy).alias("length"))


MATCH = "trace_id long, idx int, matching_idx int, waypoint_idx int, x double, y double, u long, v long, key long, t double, nodes array<bigint>, confidence double"


def match(points: DataFrame, edges: DataFrame, radius: float = RADIUS, sigma: float = SIGMA, beta: float = BETA, reach: float = 2000.0) -> DataFrame:
    """Matched points of every trace (columns ``MATCH``): edge and place, and ``nodes``, the leg from the point before in the same matching.

    A trace is split where no candidate can be reached from the one before.  ``reach`` bounds the network that a trace is decoded on: edges
    that begin in a cell, of that width, within that distance of the box of its points with candidates.  ``confidence`` is exp(-|ln(matched length / trace length)|) of a matching.
    """
    lines = points.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("idx", "x", "y"))).alias("line"))
    kinds = cut(shapes(lines, ["line"], ["trace_id"], "_traces").select(F.array_min("_traces.trace_id").alias("_kind"), "line", "_traces"))
    found = candidates(kinds.select(F.col("_kind").alias("trace_id"), F.explode("line").alias("_p")).select("trace_id", "_p.*"), edges, radius)
    groups = cut(decoding_groups(found, reach))
    left = found.join(groups.select("trace_id", *GROUP), "trace_id")
    right = surroundings(groups, edges, reach)

    def decode(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = decoded(left, right, sigma, beta)
        columns = zip(*rows, strict=True) if rows else [()] * len(fields)
        return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64())}
    fields = [(n, types[t]) for n, t in (c.split() for c in MATCH.split(", "))]
    matched = dealt(left, *GROUP).groupBy(*GROUP).cogroup(dealt(right, *GROUP).groupBy(*GROUP)).applyInArrow(decode, MATCH)
    names = [n for n, _ in fields[1:]]
    copies = dealt(kinds.select("_kind", "_traces"), "_kind").join(dealt(matched.withColumnRenamed("trace_id", "_kind"), "_kind"), "_kind")
    return expanded(copies.select(*names, "_traces"), "_traces").select(F.col("trace_id").cast("long").alias("trace_id"), *names)


GROUP = ["_gx0", "_gx1", "_gy0", "_gy1", "_part"]


def decoding_groups(found: DataFrame, reach: float) -> DataFrame:
    """``trace_id`` and its group: the range of cells that it is decoded on, and a part, so that no group has many more than ``AT_ONCE`` candidates."""
    width = max(reach, 1.0)
    sides = [F.min("x") - reach, F.max("x") + reach, F.min("y") - reach, F.max("y") + reach]
    box = found.groupBy("trace_id").agg(*[G.cell(side, width).alias(c) for side, c in zip(sides, GROUP, strict=False)], F.count(F.lit(1)).alias("_n"))
    box = cut(box)
    parts = box.groupBy(*GROUP[:4]).agg(F.ceil(F.sum("_n") / AT_ONCE).alias("_parts"))
    return box.join(parts, GROUP[:4]).select("trace_id", *GROUP[:4], F.pmod(F.xxhash64("trace_id"), F.col("_parts")).alias("_part"))


def surroundings(groups: DataFrame, edges: DataFrame, reach: float) -> DataFrame:
    """The edges that begin in the cells of each group, once a group: its columns, ``u, v, length``."""
    width = max(reach, 1.0)
    cells = groups.select(*GROUP).distinct().select(*GROUP, F.explode(F.sequence("_gx0", "_gx1")).alias("_cx")).select("*", F.explode(F.sequence("_gy0", "_gy1")).alias("_cy"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    located = edges.select("u", "v", F.sqrt(dx * dx + dy * dy).alias("length"), G.cell(F.col("x1"), width).alias("_cx"), G.cell(F.col("y1"), width).alias("_cy"))
    return located.join(cells, ["_cx", "_cy"]).select(*[F.col(c).alias(c) for c in (*GROUP, "u", "v", "length")])


class Network:
    """Streets around a group of traces, and the routes searched on them so far."""

    def __init__(self, u: list[int], v: list[int], length: list[float]):
        self.best: dict[tuple[int, int], float] = {}
        for a, b, w in zip(u, v, length, strict=True):
            self.best[a, b] = min(w, self.best.get((a, b), math.inf))
        self.out: dict[int, list] = defaultdict(list)
        for (a, b), w in sorted(self.best.items()):
            self.out[a].append((b, w))
        self.searched: dict[int, tuple[float, dict]] = {}

    def reached(self, start: int, limit: float) -> dict[int, tuple[float, int]]:
        """Nodes within ``limit`` of a node at least, as ``_distances`` has them; those beyond are to be left out by their distance."""
        far, done = self.searched.get(start, (-math.inf, {}))
        if far < limit:
            done = _distances(start, self.out, limit)
            self.searched[start] = limit, done
        return done


COLUMNS = ("idx", "x", "y", "u", "v", "key", "distance", "t", "length")


def decoded(found: pa.Table, around: pa.Table, sigma: float, beta: float) -> list[tuple]:
    """Rows (``MATCH``) of the traces of a group; ``around``: ``u, v, length``."""
    if not found.num_rows:
        return []
    network = Network(*(around.column(c).to_pylist() for c in ("u", "v", "length")))
    at = {c: found.column(c).to_numpy() for c in ("trace_id", *COLUMNS)}
    order = np.lexsort([at[c] for c in ("key", "v", "u", "distance", "idx", "trace_id")])
    at = {c: a[order] for c, a in at.items()}
    starts = np.flatnonzero(np.diff(at["trace_id"], prepend=at["trace_id"][0] - 1)).tolist()
    rows = []
    for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
        steps: list[tuple[int, list[dict]]] = []
        for values in zip(*(at[c][a:b].tolist() for c in COLUMNS), strict=True):
            c = dict(zip(COLUMNS, values, strict=True))
            if not steps or steps[-1][0] != c["idx"]:
                steps.append((c["idx"], []))
            steps[-1][1].append(c)
        rows += _viterbi(int(at["trace_id"][a]), steps, network, sigma, beta)
    return rows


def _distances(start: int, out: dict, limit: float) -> dict[int, tuple[float, int]]:
    """Nodes within ``limit`` of a node: how far, and the node before."""
    done, queue = {}, [(0.0, start, start)]
    while queue:
        d, n, before = heapq.heappop(queue)
        if n in done:
            continue
        done[n] = (d, before)
        for m, w in out.get(n, ()):
            if m not in done and d + w <= limit:
                heapq.heappush(queue, (d + w, m, n))
    return done


def _way(reached: dict[int, tuple[float, int]], start: int, node: int) -> list[int]:
    way = [node]
    while way[-1] != start:
        way.append(reached[way[-1]][1])
    return way[::-1]


def _viterbi(trace: int, steps: list[tuple[int, list[dict]]], network: Network, sigma: float, beta: float) -> list[tuple]:
    """Rows of one trace; ``steps``: each point's candidates, the nearest first."""
    best = network.best
    rows, start = [], 0
    while start < len(steps):
        emission = lambda c: -(c["distance"] ** 2) / (2 * sigma**2)
        layers = [[(emission(c), None, [c["u"], c["v"]]) for c in steps[start][1]]]
        end = start + 1
        while end < len(steps):
            before, now = steps[end - 1][1], steps[end][1]
            gc = math.hypot(now[0]["x"] - before[0]["x"], now[0]["y"] - before[0]["y"])
            layer, limit = [], 2 * gc + SLACK
            for c in now:
                top = (-math.inf, None, [])
                for k, p in enumerate(before):
                    if layers[-1][k][0] == -math.inf:
                        continue
                    if (p["u"], p["v"], p["key"]) == (c["u"], c["v"], c["key"]) and c["t"] >= p["t"]:
                        net, got = (c["t"] - p["t"]) * c["length"], None
                    else:
                        reached = network.reached(p["v"], limit)
                        got = reached.get(c["u"])
                        if got is None or got[0] > limit:
                            continue
                        net = (1 - p["t"]) * p["length"] + got[0] + c["t"] * c["length"]
                    score = layers[-1][k][0] - abs(net - gc) / beta
                    if score > top[0]:
                        top = (score, k, [c["u"], c["v"]] if got is None else [p["u"], *_way(reached, p["v"], c["u"]), c["v"]])
                layer.append((top[0] + emission(c), top[1], top[2]))
            if all(x[0] == -math.inf for x in layer):
                break
            layers.append(layer)
            end += 1
        k = max(range(len(layers[-1])), key=lambda i: layers[-1][i][0])
        picked = []
        for n in range(len(layers) - 1, -1, -1):
            picked.append((steps[start + n], steps[start + n][1][k], layers[n][k][2] if n else None))
            k = layers[n][k][1]
        picked.reverse()
        straight = sum(math.hypot(b[1]["x"] - a[1]["x"], b[1]["y"] - a[1]["y"]) for a, b in zip(picked, picked[1:], strict=False))
        driven = sum(_length(leg, best, a, b) for (_, a, _), (_, b, leg) in zip(picked, picked[1:], strict=False))
        confidence = math.exp(-abs(math.log(driven / straight))) if straight > 0 and driven > 0 else 1.0 if straight == driven else 0.0
        number = rows[-1][2] + 1 if rows else 0
        rows += [(trace, i, number, w, c["x"], c["y"], c["u"], c["v"], c["key"], c["t"], None if leg is None else [int(x) for x in leg], confidence) for w, ((i, _), c, leg) in enumerate(picked)]
        start = end
    return rows


def _length(leg: list[int], best: dict, a: dict, b: dict) -> float:
    if (a["u"], a["v"], a["key"]) == (b["u"], b["v"], b["key"]) and leg == [b["u"], b["v"]]:
        return (b["t"] - a["t"]) * b["length"]
    inner = sum(best.get((x, y), 0.0) for x, y in zip(leg[1:-1], leg[2:-1], strict=False))
    return (1 - a["t"]) * a["length"] + inner + b["t"] * b["length"]


def attempts(features: DataFrame) -> DataFrame:
    """A row per feature and way in which it is tried, in order: ``attempt, reversed_input`` and the coordinates so turned."""
    from wayfault.functions.scalars import reversal_plan

    rows = features.select("*", F.posexplode(reversal_plan(F.col("direction"))).alias("attempt", "reversed_input"))
    return rows.withColumn("coordinates", F.when(F.col("reversed_input"), F.reverse("coordinates")).otherwise(F.col("coordinates")))


def first_success(results: DataFrame, keys: list[str]) -> DataFrame:
    """Of the attempts of a feature the first that succeeded (``ok``)."""
    w = Window.partitionBy(*keys).orderBy("attempt")
    return results.where("ok").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def trace_points(features: DataFrame) -> DataFrame:
    """``trace_id, idx, x, y`` of features with ``parts``, an array of lines: all parts' points in order."""
    flat = F.flatten(F.col("parts"))
    return features.select("trace_id", F.posexplode(flat).alias("idx", "_p")).select("trace_id", "idx", "_p.x", "_p.y")


def feature_metadata(features: DataFrame) -> DataFrame:
    """``trace_id, n_points, length_m``; the length is -1 where there is no line."""
    flat = F.flatten(F.col("parts"))
    return features.select("trace_id", F.coalesce(F.size(flat), F.lit(0)).alias("n_points"), F.when(F.size(flat) > 1, G.sphere_length(flat)).otherwise(-1.0).alias("length_m"))


# -- responses
RESPONSE = """code string, message string, tracepoints array<struct<location:array<double>,distance:double,matchings_index:int,waypoint_index:int>>,
matchings array<struct<confidence:double,legs:array<struct<annotation:struct<nodes:array<bigint>,distance:array<double>,duration:array<double>>>>>>"""


def parse_responses(responses: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tables of stored responses (``trace_id`` and JSON): tracepoints, legs, matchings, and errors of those that are not Ok."""
    parsed = responses.select("trace_id", F.from_json(column, RESPONSE).alias("r"))
    good = parsed.where("r.code = 'Ok'")
    points = good.select("trace_id", F.posexplode("r.tracepoints").alias("idx", "p"))
    points = points.select("trace_id", "idx", F.col("p.matchings_index").alias("matching_idx"), F.col("p.waypoint_index").alias("waypoint_idx"), F.get("p.location", F.lit(0)).alias("x"), F.get("p.location", F.lit(1)).alias("y"), "p.distance")
    matchings = good.select("trace_id", F.posexplode("r.matchings").alias("matching_idx", "m"))
    legs = matchings.select("trace_id", "matching_idx", F.posexplode("m.legs").alias("leg_idx", "l")).select("trace_id", "matching_idx", "leg_idx", F.col("l.annotation.nodes").alias("nodes"))
    errors = parsed.where("r.code IS NULL OR r.code <> 'Ok'").select("trace_id", F.coalesce("r.code", F.lit("unreadable")).alias("code"), F.col("r.message").alias("message"))
    return points, legs, matchings.select("trace_id", "matching_idx", F.col("m.confidence").alias("confidence")), errors


def structure_violations(points: DataFrame, legs: DataFrame) -> DataFrame:
    """``trace_id, idx, problem``: breaks in the progression of matchings and waypoints, all of them."""
    counts = legs.groupBy("trace_id", "matching_idx").agg(F.count(F.lit(1)).alias("n_legs"))
    rows = points.where("matching_idx IS NOT NULL").join(counts, ["trace_id", "matching_idx"], "left").withColumn("n_legs", F.coalesce("n_legs", F.lit(0)))
    w = Window.partitionBy("trace_id").orderBy("idx")
    rows = rows.withColumns({"pm": F.lag("matching_idx").over(w), "pw": F.lag("waypoint_idx").over(w), "pl": F.lag("n_legs").over(w), "last": F.lead("idx").over(w).isNull()})
    first, same, new = F.col("pm").isNull(), F.col("matching_idx") == F.col("pm"), F.col("matching_idx") != F.col("pm")
    problems = F.array(
        F.when(first & ((F.col("matching_idx") != 0) | (F.col("waypoint_idx") != 0)), "does not start at 0"), F.when(same & (F.col("waypoint_idx") != F.col("pw") + 1), "waypoint does not follow"),
        F.when(new & (F.col("matching_idx") != F.col("pm") + 1), "matching does not follow"), F.when(new & (F.col("waypoint_idx") != 0), "matching does not start at waypoint 0"),
        F.when(new & (F.col("pw") != F.col("pl")), "matching before ended early"), F.when((F.col("waypoint_idx") < 0) | (F.col("waypoint_idx") > F.col("n_legs")), "waypoint out of range"),
        F.when(F.col("last") & (F.col("waypoint_idx") != F.col("n_legs")), "last matching ended early"),
    )
    return rows.select("trace_id", "idx", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))


def joined_chain(lists: Column) -> Column:
    """Node lists one after the other, without the longest overlap of the end of what there is and the start of the next."""
    def add(acc: Column, nodes: Column) -> Column:
        n, m = F.size(acc), F.size(nodes)
        fits = F.filter(F.sequence(F.lit(0), F.least(n, m)), lambda k: F.slice(acc, n - k + 1, k) == F.slice(nodes, F.lit(1), k))
        return F.concat(acc, F.slice(nodes, F.array_max(fits) + 1, F.greatest(m - F.array_max(fits), F.lit(0))))

    return F.aggregate(lists, F.array().cast("array<bigint>"), add)


def node_chains(legs: DataFrame) -> DataFrame:
    """``trace_id, matching_idx, nodes``: the nodes along each matching."""
    rows = legs.groupBy("trace_id", "matching_idx").agg(F.array_sort(F.collect_list(F.struct("leg_idx", "nodes"))).alias("_l"))
    return rows.select("trace_id", "matching_idx", joined_chain(F.col("_l.nodes")).alias("nodes"))


def next_points(points: DataFrame) -> DataFrame:
    """Points with ``next_x, next_y``, of the next point of the trace that has a match, and ``has_next``, whether there is one."""
    later = Window.partitionBy("trace_id").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("matching_idx").isNotNull(), F.struct("x", "y")), ignorenulls=True).over(later)
    return points.withColumn("_n", nxt).withColumn("next_x", F.col("_n.x")).withColumn("next_y", F.col("_n.y")).withColumn("has_next", F.col("_n").isNotNull()).drop("_n")


def along_feature(points: DataFrame) -> DataFrame:
    """Points with ``distance_along``: metres from the trace's first point, null from the first unknown coordinate on."""
    w = Window.partitionBy("trace_id").orderBy("idx")
    step = F.coalesce(G.sphere_distance(F.lag("x").over(w), F.lag("y").over(w), F.col("x"), F.col("y")), F.when(F.row_number().over(w) == 1, 0.0))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("_s", step).withColumn("distance_along", F.when(F.max(F.col("_s").isNull().cast("int")).over(so_far) == 0, F.sum("_s").over(so_far))).drop("_s")


def leg_segments(points: DataFrame, legs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Segments of all legs, with the distances along leg and matching.

    ``points`` in degrees; leg k runs from waypoint k to k + 1.  The first segment of a leg begins at the foot of its tracepoint, the last ends
    at the foot of the next one.  ``nodes``: ``node_id, x, y``.
    """
    ends = next_points(points).where("matching_idx IS NOT NULL").select("trace_id", "matching_idx", F.col("waypoint_idx").alias("leg_idx"), "x", "y", "next_x", "next_y")
    pairs = F.transform(F.slice("nodes", F.lit(1), F.greatest(F.size("nodes") - 1, F.lit(0))), lambda n, i: F.struct(n.alias("u"), F.get("nodes", i + 1).alias("v")))
    rows = legs.select("trace_id", "matching_idx", "leg_idx", F.size(pairs).alias("n"), F.posexplode(pairs).alias("leg_segment_idx", "p"))
    rows = rows.select("trace_id", "matching_idx", "leg_idx", "n", "leg_segment_idx", F.col("p.u").alias("u"), F.col("p.v").alias("v"))
    at = lambda side: nodes.select(F.col("node_id").alias(side), F.col("x").alias(f"{side}x"), F.col("y").alias(f"{side}y"))
    rows = rows.join(at("u"), "u", "left").join(at("v"), "v", "left").join(ends, ["trace_id", "matching_idx", "leg_idx"], "left")
    s = F.struct(F.struct(F.col("ux").alias("x"), F.col("uy").alias("y")).alias("a"), F.struct(F.col("vx").alias("x"), F.col("vy").alias("y")).alias("b"))
    first, last = F.col("leg_segment_idx") == 0, F.col("leg_segment_idx") == F.col("n") - 1
    begin, end = G.foot(F.col("x"), F.col("y"), s), G.foot(F.col("next_x"), F.col("next_y"), s)
    rows = rows.withColumns({"sx": F.when(first, begin["x"]).otherwise(F.col("ux")), "sy": F.when(first, begin["y"]).otherwise(F.col("uy")), "ex": F.when(last, end["x"]).otherwise(F.col("vx")), "ey": F.when(last, end["y"]).otherwise(F.col("vy"))})
    d = lambda a, b: G.sphere_distance(F.col(f"{a}x"), F.col(f"{a}y"), F.col(f"{b}x"), F.col(f"{b}y"))
    rows = rows.withColumns({"segment_length_m": d("s", "e"), "start_offset_m": d("u", "s"), "end_offset_m": d("e", "v")})
    leg = Window.partitionBy("trace_id", "matching_idx", "leg_idx").orderBy("leg_segment_idx").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("trace_id", "matching_idx").orderBy("leg_idx", "leg_segment_idx").rowsBetween(Window.unboundedPreceding, 0)
    known = lambda w: F.when(F.max(F.col("segment_length_m").isNull().cast("int")).over(w) == 0, F.sum("segment_length_m").over(w))
    return rows.withColumns({"leg_cumulative_m": known(leg), "matching_cumulative_m": known(whole)}).drop("n", "ux", "uy", "vx", "vy", "x", "y", "next_x", "next_y")


def match_rows(segments: DataFrame, points: DataFrame, features: DataFrame, confidence: DataFrame) -> DataFrame:
    """Rows for ``matches_to_edges``: where each segment lies along its feature, in metres and miles, repaired for reversed features.

    ``features``: ``trace_id, route_id, direction, reversed_input, length_m``.
    """
    from wayfault.functions.scalars import repaired_distances

    starts = along_feature(points).where("matching_idx IS NOT NULL").select("trace_id", "matching_idx", F.col("waypoint_idx").alias("leg_idx"), "distance_along")
    rows = segments.join(starts, ["trace_id", "matching_idx", "leg_idx"], "left").join(features, "trace_id").join(confidence, ["trace_id", "matching_idx"], "left")
    end = F.col("distance_along") + F.col("leg_cumulative_m")
    fixed = repaired_distances(end - F.col("segment_length_m"), end, F.col("length_m"), F.col("direction"), F.col("reversed_input"))
    return rows.select(
        "trace_id", "matching_idx", "leg_idx", "leg_segment_idx", F.col("u").alias("osm_u"), F.col("v").alias("osm_v"), "route_id", fixed["start"].alias("start_dist_along_m"), fixed["end"].alias("end_dist_along_m"),
        (fixed["start"] / METERS_PER_MILE).alias("start_dist_along_mi"), (fixed["end"] / METERS_PER_MILE).alias("end_dist_along_mi"), "direction", "reversed_input", F.col("confidence").alias("matching_confidence"), "segment_length_m",
    )


def frechet(lines: DataFrame, a: str, b: str, name: str = "frechet") -> DataFrame:
    """``lines`` with the discrete Fréchet distance of two line columns; null if either has no point.

    The table of Eiter and Mannila (1994) is folded row by row as arrays.
    """
    def apart(p: Column, q: Column) -> Column:
        dx, dy = p["x"] - q["x"], p["y"] - q["y"]
        return F.sqrt(dx * dx + dy * dy)

    def next_row(row: Column, p: Column) -> Column:
        """``row``: reaches up to the point before, empty at first."""
        def cell(acc: Column, j: Column) -> Column:
            left, up, both = F.try_element_at(acc, F.lit(-1)), F.get(row, j), F.get(row, j - 1)
            first = F.size(row) == 0
            least = F.when(first, left).otherwise(F.least(left, up, both))  # nulls do not count
            return F.array_append(acc, F.greatest(apart(p, F.get(F.col(b), j)), least))

        return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.array().cast("array<double>"), cell)

    reach = F.aggregate(F.col(a), F.array().cast("array<double>"), next_row)
    return lines.withColumn(name, F.when((F.size(a) > 0) & (F.size(b) > 0), F.element_at(reach, -1)))


def describe(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles (interpolated) and maximum of each key."""
    c = F.col(column)
    got = df.groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("low"), F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"), F.max(c).alias("high"))
    return got.select(*keys, "n", "mean", "std", "low", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"), "high")
