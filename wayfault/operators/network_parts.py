"""Networks by components: what happens within components is done in memory, in parts of whole components that tasks hold.

Components are found by contracting runs of edges with near node numbers first, so that the rounds of ``components`` see only what spans several runs.
Parts have about ``PART_EDGES`` edges; a component of more than ``WHOLE`` edges is in no part, and its callers have another way for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfault.operators import components as K
from wayfault.operators.scratch import cut

PART_EDGES = 50_000
WHOLE = 200_000
#: Edges that are contracted at once.
RUN = 1_000_000
#: Distances of all pairs are kept for components of so many nodes at most, and for ``CELLS`` pairs of edge and source at once.
DENSE, CELLS = 512, 4_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of undirected pairs, and the smallest node that each is connected with."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return nodes, nodes[label]
        low = np.minimum(la, lb)[open_]
        np.minimum.at(label, la[open_], low)
        np.minimum.at(label, lb[open_], low)
        while (label[label] != label).any():
            label = label[label]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept, n = [], 0

    def flush() -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in kept]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(u, v)], ["node_id", "root"])

    for batch in batches:
        kept.append(batch)
        n += batch.num_rows
        if n >= RUN:
            yield flush()
            kept, n = [], 0
    if n:
        yield flush()


def labels(edges: DataFrame) -> DataFrame:
    """``node_id, component`` of the nodes of edges ``u, v``, as ``components`` has them."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = edges.where("u IS NOT NULL AND v IS NOT NULL").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    local = cut(pairs.repartitionByRange(n, "u").mapInArrow(_runs, "node_id long, root long"))
    roots = cut(local.groupBy("node_id").agg(F.min("root").alias("component"), F.max("root").alias("_high")))
    spanning = roots.where("component < _high").select("node_id", "component")
    links = cut(local.join(spanning, "node_id").where("root <> component").select(F.col("root").alias("u"), F.col("component").alias("v")).distinct())
    if links.isEmpty():
        return roots.select("node_id", "component")
    ends = links.select(F.col("u").alias("node_id")).union(links.select("v"))
    joined = K.components(ends, links).select(F.col("node_id").alias("component"), F.col("component").alias("_whole"))
    return cut(roots.join(joined, "component", "left").select("node_id", F.coalesce("_whole", "component").alias("component")))


@dataclass
class Parts:
    """``edges``: the columns of the edges that are in parts, ``component`` and ``_part``; ``nodes``: ``node_id, component, _part`` of their nodes; ``rest``: the other edges, or None."""

    edges: DataFrame
    nodes: DataFrame
    rest: DataFrame | None
    number: int


def parts(edges: DataFrame, weight: str, whole: int = WHOLE, nodes: int | None = None) -> Parts:
    """Edges with their parts; the rest are those of components of more than ``whole`` edges or ``nodes`` nodes, or with a negative weight."""
    member = labels(edges)
    named = cut(edges.where("v IS NOT NULL").join(member.withColumnRenamed("node_id", "u"), "u"))
    sizes = cut(named.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min(weight).alias("low")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = sizes.where((F.col("n") > whole) | (F.col("low") < 0)).select("component")
    if nodes is not None:
        large = large.union(member.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > nodes).select("component")).distinct()
    large, rest = cut(large), None
    if not large.isEmpty():
        rest = named.join(large, "component", "left_semi").select(*edges.columns)
        named, member = named.join(large, "component", "left_anti"), member.join(large, "component", "left_anti")
    number = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_EDGES))
    part = F.pmod(F.xxhash64("component"), F.lit(number))
    return Parts(named.withColumn("_part", part), member.withColumn("_part", part), rest, number)


def distances(u: np.ndarray, v: np.ndarray, w: np.ndarray, component: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of components of equal size: their nodes, component by component and ascending, and a row for each of them, its distances from all nodes of its own component in the same order (infinite where there is none).

    Costs are added along the way, the edge nearest to the source first.
    """
    both, which = np.concatenate([u, v]), np.concatenate([component, component])
    nodes, first = np.unique(both, return_index=True)
    own = which[first]
    _, number, count = np.unique(own, return_inverse=True, return_counts=True)
    size = count[number]
    order = np.lexsort((nodes, own, size))
    nodes, size = nodes[order], size[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    sorted_nodes = nodes[place]
    at, to = place[np.searchsorted(sorted_nodes, u)], place[np.searchsorted(sorted_nodes, v)]
    by = np.lexsort((at, to))
    at, to, w = at[by], to[by], w[by]
    start = 0
    while start < len(nodes):
        n = int(size[start])
        same = int(np.searchsorted(size, n, "right"))
        step = n * max(1, CELLS // (n * n * 4))
        for a in range(start, same, step):
            b = min(a + step, same)
            lo, hi = np.searchsorted(to, [a, b])
            far = np.full((b - a, n), np.inf)
            far[np.arange(b - a), np.arange(b - a) % n] = 0.0
            if hi > lo:
                source, target, cost = at[lo:hi] - a, to[lo:hi] - a, w[lo:hi, None]
                starts = np.flatnonzero(np.diff(target, prepend=-1))
                ends = target[starts]
                for _ in range(n):
                    new = np.minimum.reduceat(far[source] + cost, starts, axis=0)
                    old = far[ends]
                    if not (new < old).any():
                        break
                    far[ends] = np.minimum(old, new)
            yield nodes[a:b], far
        start = same
