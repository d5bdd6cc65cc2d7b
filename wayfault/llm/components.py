"""Connected components by alternating large-star and small-star rounds.

Edges are first contracted inside each partition (a local union-find over a bounded block), so few
rounds remain, and none where all that is left is one such block.  Every round is written to the shared folder; nothing but two numbers reaches the driver.  The centre of a large star has a large share of
the edges, so smallest neighbours come by ``lookup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfault.llm.common import lookup, map_arrow, materialise

BLOCK = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges a-b and, for each, the smallest node of its component."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while True:
            short = new[new]
            if (short == new).all():
                break
            new = short
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        node, root = roots(table.column(0).to_numpy(), table.column(1).to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(node[node != root]), pa.array(root[node != root])], ["u", "v"])

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= BLOCK:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def components(edges: DataFrame) -> DataFrame:
    """``u, root`` for every node of ``edges`` (columns ``u, v``, longs) that is not its component's smallest."""
    edges = edges.where("u is not null and v is not null and u <> v")
    stars = materialise(map_arrow(edges.select("u", "v"), _contract, "u long, v long", 50_000).distinct(), "stars")
    if stars.count() <= BLOCK:  # no more than a task contracts at once in any case
        whole = map_arrow(stars.select("u", "v").coalesce(1), _contract, "u long, root long", 50_000)
        return materialise(whole.toDF("u", "root"), "stars")
    before = None
    while True:
        print_ = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if print_ == before or not print_[0]:
            return stars.select("u", F.col("v").alias("root"))
        before, n = print_, print_[0]
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")), "low", 2 * n)
        large = lookup(both, low, "u", "n", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = materialise(large, "large", 2 * n)
        least = materialise(down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least", 2 * n)
        small = lookup(down, least, "u", "n", 2 * n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars", 2 * n)


def components_named(classes: DataFrame, stars: DataFrame, key: str, n_rows: int) -> DataFrame:
    """``key, component_id, n`` of the classes ``key, least, n``: the smallest ``least`` of each component.

    A component may hold a large share of all classes, so its name comes by ``lookup``.
    """
    rooted = classes.select(key, "least", "n").join(stars.withColumnRenamed("u", key), key, "left").withColumn("root", F.coalesce("root", key))
    rooted = materialise(rooted, "rooted", n_rows)
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    names = materialise(names, "names", n_rows)
    return materialise(lookup(rooted, names, "root", "members", n_rows).select(key, "component_id", "n"), "named", n_rows)
