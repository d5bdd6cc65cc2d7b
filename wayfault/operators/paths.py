"""Walks along a road, shortest paths with and without an edge, and the redundancy metric.

Paths are label-correcting joins over (query, node): every round extends the frontier by one edge, keeps the cheapest label of each
node, and is written out so that plans stay short.  Rows of a query stay with its id, so queries are spread over all tasks.  Where costs alone are
asked for, ``path_costs`` takes them from parts of whole components in memory.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from wayfault.functions import scalars as S
from wayfault.operators import network_parts as T
from wayfault.operators.scratch import cut

EDGE = ["u", "v", "key"]
BARRICADE = 1_000_000.0
HOPS = 3


def street_names(edges: DataFrame) -> DataFrame:
    """``u, v, key, road_name, from_name, to_name``; needs the columns of ``best_name``."""
    road = S.best_name(edges, ["u", "v"]).withColumnRenamed("best_name", "road_name")
    attributes = edges.select(F.col("u").alias("_at"), "edge_min_roadclass", "ref", "name", "edge_highest_highway_type")

    def crossing(end: str, name: str) -> DataFrame:
        out = road.join(attributes, F.col(end) == F.col("_at")).drop("_at")
        return S.best_name(out, ["u", "v"], omit="road_name").withColumnRenamed("best_name", name)

    return edges.select(*EDGE).join(road, ["u", "v"], "left").join(crossing("u", "from_name"), ["u", "v"], "left").join(crossing("v", "to_name"), ["u", "v"], "left")


def walk(edges: DataFrame, targets: DataFrame, upstream: bool, hops: int = HOPS) -> DataFrame:
    """``u, v, key, nodes``: up to ``hops`` nodes along the road of each target edge, against or with its direction.

    A step takes an edge with the same ref (or, without one, the same name, unknown names being the same) that has not been used in either
    direction; of several the first by node and key.
    """
    steps = edges.select(F.col("u").alias("_u"), F.col("v").alias("_v"), F.col("key").alias("_k"), F.col("ref").alias("_ref"), F.col("name").alias("_name"))
    pair = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    here = targets.select(*EDGE, F.nullif(F.col("ref"), F.lit("")).alias("ref"), "name", F.col("u" if upstream else "v").alias("at"), F.array(pair(F.col("u"), F.col("v")), pair(F.col("v"), F.col("u"))).alias("used"), F.array().cast("array<bigint>").alias("nodes"))
    near, far = ("_v", "_u") if upstream else ("_u", "_v")
    for _ in range(hops):
        same = F.when(F.col("ref").isNotNull(), F.col("_ref") == F.col("ref")).otherwise(F.col("_name").eqNullSafe(F.col("name")))
        options = here.join(steps, F.col("at") == F.col(near)).where(same & ~F.array_contains("used", pair(F.col("_u"), F.col("_v"))))
        chosen = options.groupBy(*EDGE).agg(F.min(F.struct(F.col(far).alias("node"), F.col("_k").alias("k"), F.col("_u").alias("a"), F.col("_v").alias("b"))).alias("step"))
        here = here.join(chosen, EDGE, "left").select(
            *EDGE, "ref", "name", F.col("step.node").alias("at"),
            F.when(F.col("step").isNull(), F.col("used")).otherwise(F.concat("used", F.array(pair(F.col("step.a"), F.col("step.b")), pair(F.col("step.b"), F.col("step.a"))))).alias("used"),
            F.when(F.col("step").isNull(), F.col("nodes")).otherwise(F.concat("nodes", F.array("step.node"))).alias("nodes"),
        )
    return here.select(*EDGE, "nodes")


def origins_and_destinations(edges: DataFrame, targets: DataFrame, hops: int = HOPS) -> DataFrame:
    """``u, v, key, origin, destination``: the last nodes reached up- and downstream of each target, or its own ends."""
    up, down = walk(edges, targets, True, hops), walk(edges, targets, False, hops)
    last = lambda nodes, own: F.coalesce(F.try_element_at(F.col(nodes), F.lit(-1)), F.col(own))
    both = up.withColumnRenamed("nodes", "_up").join(down.withColumnRenamed("nodes", "_down"), EDGE)
    return both.select(*EDGE, last("_up", "u").alias("origin"), last("_down", "v").alias("destination"))


def shortest_paths(edges: DataFrame, queries: DataFrame, cost: str = "travel_time", bound: float | None = None) -> DataFrame:
    """``query, cost, path``: cheapest path of each query (``query, origin, destination`` and, optionally, a barricaded edge ``bu, bv, bkey``).

    ``path``: array of ``u, v, key``; of parallel edges the cheapest; of equally cheap paths the first by their edges.  Unreachable queries have no row.
    Labels dearer than the best one known for the destination are given up.
    """
    blocked = "bu" in queries.columns
    steps = edges.select(F.col("u").alias("_u"), F.col("v").alias("_v"), F.col("key").alias("_k"), F.col(cost).cast("double").alias("_c"))
    q = queries.select("query", "origin", "destination", *(["bu", "bv", "bkey"] if blocked else []))
    edge_type = "array<struct<u:bigint,v:bigint,key:bigint>>"
    labels = q.select("query", F.col("origin").alias("node"), F.lit(0.0).alias("cost"), F.array().cast(edge_type).alias("path"))
    frontier = labels
    while True:
        grown = frontier.join(steps, F.col("node") == F.col("_u")).join(q, "query")
        price = F.col("_c")
        if blocked:
            price = F.when((F.col("_u") == F.col("bu")) & (F.col("_v") == F.col("bv")) & (F.col("_k") == F.col("bkey")), F.greatest(F.col("_c"), F.lit(BARRICADE))).otherwise(price)
        step = F.array(F.struct(F.col("_u").cast("long").alias("u"), F.col("_v").cast("long").alias("v"), F.col("_k").cast("long").alias("key")))
        grown = grown.select("query", F.col("_v").alias("node"), (F.col("cost") + price).alias("cost"), F.concat("path", step).alias("path"))
        if bound is not None:
            grown = grown.where(F.col("cost") <= bound)
        grown = grown.groupBy("query", "node").agg(F.min(F.struct("cost", "path")).alias("_b")).select("query", "node", "_b.cost", "_b.path")
        known = labels.select("query", "node", F.col("cost").alias("_old"))
        done = labels.join(q, "query").where("node = destination").select("query", F.col("cost").alias("_done"))
        better = grown.join(known, ["query", "node"], "left").where("_old IS NULL OR cost < _old")
        better = better.join(done, "query", "left").where("_done IS NULL OR cost < _done").select("query", "node", "cost", "path")
        frontier = cut(better)
        if frontier.isEmpty():
            break
        labels = cut(labels.join(frontier, ["query", "node"], "left_anti").unionByName(frontier))
    return labels.join(q, "query").where("node = destination").select("query", "cost", "path")


#: Queries that are answered with one copy of a part of the network.
AT_ONCE = 200_000


def path_costs(edges: DataFrame, queries: DataFrame, cost: str = "travel_time") -> DataFrame:
    """``query, cost`` of ``shortest_paths`` without a barricade, for queries of any number: no path is carried along.

    Components are worked on in parts that tasks hold, each with the queries that begin there; those that are larger, or have negative costs, by the rounds of ``shortest_paths``.
    """
    pairs = edges.groupBy("u", "v").agg(F.min(F.col(cost).cast("double")).alias("w")).where("w IS NOT NULL")
    parts = T.parts(pairs, "w")
    q = queries.select("query", F.col("origin").cast("long").alias("origin"), F.col("destination").cast("long").alias("destination"))
    here = q.where("origin = destination").select("query", F.lit(0.0).alias("cost"))
    away = q.where("origin <> destination")
    asked = away.join(parts.nodes.select(F.col("node_id").alias("origin"), "_part"), "origin")
    slices = cut(asked.groupBy("_part").agg(F.ceil(F.count(F.lit(1)) / AT_ONCE).alias("_slices")))
    by = ["_part", "_slice"]
    left = asked.join(slices, "_part").select("_part", F.pmod(F.xxhash64("origin"), F.col("_slices")).alias("_slice"), "query", "origin", "destination")
    copies = parts.edges.join(slices, "_part").withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1)))
    right = copies.select(*[F.col(c).cast("long").alias(c) for c in (*by, "u", "v", "component")], F.col("w").alias("w"))
    kind = queries.schema["query"].dataType

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            costs = np.full(left.num_rows, np.inf)
        else:
            costs = _costs(*(left.column(c).to_numpy() for c in ("origin", "destination")), *(right.column(c).to_numpy() for c in ("u", "v", "w", "component")))
        some = np.flatnonzero(np.isfinite(costs))
        return pa.Table.from_arrays([left.column("query").take(pa.array(some)), pa.array(costs[some])], ["query", "cost"])

    schema = Y.StructType([Y.StructField("query", kind), Y.StructField("cost", Y.DoubleType())])
    got = left.repartition(parts.number, *by).groupBy(*by).cogroup(right.repartition(parts.number, *by).groupBy(*by)).applyInArrow(run, schema)
    out = got.unionByName(here)
    if parts.rest is None:
        return out
    rest = cut(parts.rest.select("u", "v", F.lit(0).cast("long").alias("key"), "w"))
    beyond = cut(away.join(rest.select(F.col("u").alias("origin")).distinct(), "origin", "left_semi"))
    return out.unionByName(shortest_paths(rest, beyond, "w").select("query", "cost"))


def _costs(origin: np.ndarray, destination: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Cost of each query on the edges of whole components, infinite where there is no way: all pairs in components of up to ``DENSE`` nodes, single origins in larger ones."""
    out = np.full(len(origin), np.inf)
    nodes, first = np.unique(np.concatenate([u, v]), return_index=True)
    own = np.concatenate([component, component])[first]
    names, number, count = np.unique(own, return_inverse=True, return_counts=True)
    of = lambda asked: np.minimum(np.searchsorted(nodes, asked), len(nodes) - 1)
    o, d = of(origin), of(destination)
    same = (nodes[o] == origin) & (nodes[d] == destination) & (number[o] == number[d])
    dense = count[number[o]] <= T.DENSE
    at = np.flatnonzero(same & dense)
    small = count[np.searchsorted(names, component)] <= T.DENSE
    for block, far in T.distances(u[small], v[small], w[small], component[small]) if len(at) else ():
        order = np.argsort(block)
        place = lambda x, block=block, order=order: order[np.searchsorted(block, x, sorter=order)]
        mine = at[np.isin(destination[at], block)]
        if len(mine):
            out[mine] = far[place(destination[mine]), place(origin[mine]) % far.shape[1]]
    wide = np.flatnonzero(same & ~dense)
    if len(wide):
        ways: dict[int, list] = defaultdict(list)
        for a, b, c in zip(u[~small].tolist(), v[~small].tolist(), w[~small].tolist(), strict=True):
            ways[a].append((b, c))
        wide = wide[np.argsort(origin[wide], kind="stable")]
        starts = np.flatnonzero(np.diff(origin[wide], prepend=origin[wide[0]] - 1)).tolist()
        for a, b in zip(starts, [*starts[1:], len(wide)], strict=True):
            ends = destination[wide[a:b]].tolist()
            found = _from(int(origin[wide[a]]), ways, set(ends))
            out[wide[a:b]] = [found.get(n, math.inf) for n in ends]
    return out


def _from(start: int, ways: dict[int, list], ends: set[int]) -> dict[int, float]:
    """Costs from a node, until all ``ends`` are known."""
    done: dict[int, float] = {}
    queue = [(0.0, start)]
    while queue and ends:
        d, n = heapq.heappop(queue)
        if n in done:
            continue
        done[n] = d
        ends.discard(n)
        for m, w in ways.get(n, ()):
            if m not in done:
                heapq.heappush(queue, (d + w, m))
    return done


def redundancy(edges: DataFrame, targets: DataFrame, paved_only: bool = True, hops: int = HOPS) -> DataFrame:
    """What closing each target edge costs: times and miles of its base path and detour, and their differences.

    Needs ``travel_time, length_mi, ref, name``, and ``is_paved`` where unpaved edges count as barricaded; the graph itself is never changed.
    """
    price = F.when(~F.col("is_paved"), BARRICADE).otherwise(F.col("travel_time")) if paved_only else F.col("travel_time")
    costed = edges.withColumn("_cost", price.cast("double"))
    ends = cut(origins_and_destinations(edges, targets, hops).withColumn("query", F.concat_ws(",", *EDGE)))
    base = shortest_paths(costed, ends, "_cost")
    detour = shortest_paths(costed, ends.withColumnsRenamed({"u": "bu", "v": "bv", "key": "bkey"}), "_cost")

    def measured(paths: DataFrame, name: str) -> DataFrame:
        rows = paths.select("query", "path", F.explode_outer("path").alias("_e"))
        own = edges.select(*EDGE, "length_mi")
        got = rows.join(own, (F.col("_e.u") == own["u"]) & (F.col("_e.v") == own["v"]) & (F.col("_e.key") == own["key"]), "left")
        miles = got.groupBy("query").agg(F.sum("length_mi").alias("_mi"))
        return paths.join(miles, "query").select("query", F.round("cost", 3).alias(f"{name}_sec"), F.round("_mi", 3).alias(f"{name}_mi"), F.col("path").alias(f"{name}_path_edge_ids"))

    d = measured(detour, "detour")
    impassable = (F.col("detour_sec") == 0) | (F.col("detour_sec") >= BARRICADE)
    d = d.select("query", *[F.when(~impassable, F.col(c)).alias(c) for c in d.columns if c != "query"])
    out = ends.join(measured(base, "base"), "query", "left").join(d, "query", "left")
    return out.select(*EDGE, "origin", "destination", "base_sec", "base_mi", "base_path_edge_ids", "detour_sec", "detour_mi", "detour_path_edge_ids", S.detour_differences(F.col("base_sec"), F.col("detour_sec"), F.col("base_mi"), F.col("detour_mi")).alias("_d")).select("*", "_d.*").drop("_d")


def path_table(info: DataFrame, kind: str) -> DataFrame:
    """``u, v, key, path_edge_index, path_u, path_v, path_key`` of the ``base`` or ``detour`` paths."""
    rows = info.select(*EDGE, F.posexplode(f"{kind}_path_edge_ids").alias("path_edge_index", "_e"))
    return rows.select(*EDGE, "path_edge_index", F.col("_e.u").alias("path_u"), F.col("_e.v").alias("path_v"), F.col("_e.key").alias("path_key"))


def path_geometries(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Path edges with the columns of the edges that they run over, in order."""
    own = edges.select(*[F.col(c).alias(f"path_{c}" if c in EDGE else c) for c in edges.columns])
    return paths.join(own, ["path_u", "path_v", "path_key"]).orderBy(*EDGE, "path_edge_index")
