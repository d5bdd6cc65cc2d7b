"""Sharding by balanced label propagation.

Documents are linked through groups (equal texts, or any membership table): the members of a group are each other's neighbours,
and a neighbour's weight is 1 / (size - 1), so that links of a group are never listed; a group is
a histogram of its members' shards.  Linked documents start spread evenly and in each round want the shard
that most of their neighbours, and they themselves, are in.  Moves between each pair of shards are limited
by quotas: as many as go back the other way, and a part of the room that the receiving shard still has.
Documents without links come last and fill the shards up, so row counts differ by one at most (law ``rows``).

What the driver sees are matrices of shards by shards.  Ranks are counted within blocks of rows and shifted by the
counts of earlier blocks; no shard, group or pair of shards is gathered anywhere.

Defined results: a null text has no bytes and equals other null texts only; rows without an id and repeated rows are documents
of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfault.llm.common import id_and_text, lookup, materialise

SHARDS = 24
ROUNDS = 8
BLOCK_BITS = 8  # rows of a task are ranked in blocks of 256
GROUP_BITS = 12  # blocks are counted in groups of 4096


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` (of a written table with ``part``, ``at``: its block and place there) with ``rank``, from 0 in each value of ``by``.

    Places are ranked within blocks, and earlier blocks' counts added: those of earlier groups of blocks, then those within the group, so
    no sort holds more than a group's blocks, or the groups of a value.
    """
    local = F.row_number().over(Window.partitionBy(by, "part").orderBy("at")) - 1
    counts = rows.groupBy(by, "part").agg(F.count(F.lit(1)).alias("n")).withColumn("group", F.shiftright("part", GROUP_BITS))
    sums = counts.groupBy(by, "group").agg(F.sum("n").alias("total"))
    earlier = sums.select(by, "group", (F.sum("total").over(Window.partitionBy(by).orderBy("group")) - F.col("total")).alias("earlier"))
    inside = F.sum("n").over(Window.partitionBy(by, "group").orderBy("part")) - F.col("n")
    before = counts.withColumn("inside", inside).join(earlier, [by, "group"]).select(by, "part", (F.col("earlier") + F.col("inside")).alias("before"))
    return rows.withColumn("local", local).join(before, [by, "part"]).withColumn("rank", F.col("before") + F.col("local")).drop("local", "before")


def capacities(n: int, shards: int) -> np.ndarray:
    return np.array([n // shards + (s < n % shards) for s in range(shards)], np.int64)


def quotas(wanted: np.ndarray, loads: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Moves allowed from shard i to j: those met by moves back, and a share of j's room by demand."""
    met = np.minimum(wanted, wanted.T)
    free = np.maximum(room - loads, 0)
    extra = wanted - met
    asked = extra.sum(axis=0)
    share = np.where(asked > 0, np.minimum(1.0, free / np.maximum(asked, 1)), 0.0)
    return met + np.floor(extra * share[None, :]).astype(np.int64)


def propagate(members: DataFrame, room: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Labels of linked rows (``row, label``) and the loads of the shards.

    ``members``: ``row, part, at, grp, n`` with a row for each group that a document is in, ``n`` the group's size.
    """
    k, n_members = len(room), members.count()
    distinct = materialise(members.groupBy("row").agg(F.first("part").alias("part"), F.first("at").alias("at")).withColumn("one", F.lit(0)), "linked", n_members)
    labels = numbered(distinct, "one").select("row", "part", "at", (F.col("rank") % k).cast("int").alias("label"))
    for _ in range(rounds):
        labels = materialise(labels, "labels", n_members)
        loads = np.zeros(k, np.int64)
        for r in labels.groupBy("label").count().collect():  # at most k rows
            loads[r["label"]] = r["count"]
        placed = members.select("row", "grp", "n").join(labels.select("row", "label"), "row")
        histogram = placed.groupBy("grp").agg(F.first("n").alias("n"), F.array(*[F.sum((F.col("label") == s).cast("long")) for s in range(k)]).alias("counts"))
        near = lookup(placed.select("row", "grp"), materialise(histogram, "histograms", n_members), "grp", "n", n_members)
        weight = 1 / (F.col("n") - 1)
        scores = near.groupBy("row").agg(F.array(*[F.sum(F.col("counts")[s] * weight) for s in range(k)]).alias("scores"), F.min("grp").alias("grp"))
        # the best shard, full ones too, as quotas allow swaps; ties by a hash of the group, so that members agree
        choice = [F.struct(F.round(F.col("scores")[s], 9).alias("score"), F.xxhash64(F.lit(s), "grp").alias("tie"), F.lit(s).alias("to")) for s in range(k)]
        wants = scores.join(labels, "row").withColumn("best", F.greatest(*choice))
        wants = wants.where((F.col("best.to") != F.col("label")) & (F.col("best.score") > 0))
        moves = materialise(wants.select("row", "part", "at", "label", F.col("best.to").alias("to"), (F.col("label") * k + F.col("best.to")).alias("pair")), "moves", n_members)
        wanted = np.zeros((k, k), np.int64)
        for r in moves.groupBy("label", "to").count().collect():  # at most k * k rows
            wanted[r["label"], r["to"]] = r["count"]
        allowed = quotas(wanted, loads, room)
        if not allowed.sum():
            break
        limit = F.array(*[F.lit(int(x)) for x in allowed.ravel()])[F.col("pair")]
        moved = numbered(moves, "pair").where(F.col("rank") < limit).select("row", "to")
        labels = labels.join(moved, "row", "left").select("row", "part", "at", F.coalesce("to", "label").alias("label"))
    labels = materialise(labels, "labels", n_members)
    loads = np.zeros(k, np.int64)
    for r in labels.groupBy("label").count().collect():
        loads[r["label"]] = r["count"]
    return labels.select("row", "label"), loads


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row; equal texts are linked, counts are at most one apart."""
    text = F.col("text")
    source = id_and_text(docs, id_col, text_col)
    rows = source.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("null")).alias("grp"), F.monotonically_increasing_id().alias("row"),
    )
    rows = materialise(rows.withColumn("part", F.shiftright("row", BLOCK_BITS)).withColumn("at", F.col("row")), "rows")
    n_rows = rows.count()
    sizes = materialise(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes", n_rows)
    room = capacities(n_rows, shards)
    members = materialise(lookup(rows.select("row", "part", "at", "grp"), sizes, "grp", "n", n_rows), "members", n_rows)
    labels, loads = propagate(members, room, rounds)
    free = materialise(rows.select("row", "part", "at").join(labels, "row", "left_anti").withColumn("one", F.lit(0)), "free", n_rows)
    ends = [int(x) for x in np.cumsum(room - loads)]
    filled = numbered(free, "one").select("row", F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("rank"))).alias("label"))
    placed = materialise(rows.select("row", "part", "at", "doc_id", "size", "text_crc32").join(labels.unionByName(filled), "row"), "placed")
    return numbered(placed, "label").select("doc_id", "size", "text_crc32", F.col("label").cast("int").alias("shard"), F.col("rank").cast("long").alias("slot"))
