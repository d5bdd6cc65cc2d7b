"""Exact deduplication with a minimal perfect hash over historical distinct digests.

``history`` (already ingested) is reduced to one row per distinct digest and hashed, shard by shard,
by a minimal perfect hash: a cascade of bit arrays in which a key's slot is the rank of the first bit
that it alone set.  A slot holds the full digest, the locator of the winner and the group's size.
Distinct digests of the arrivals are looked up in the slots and compared byte by byte, as the hash
also gives foreign digests a slot; members join the historical group, nonmembers form groups of their own.

Shards are ranges of a cryptographic digest, so they are even whatever the texts are, and hold about
``SHARD_KEYS`` digests each; equal texts have been pre-aggregated before any shuffle.

Defined results: a null text counts as empty; rows without an id rank below all others; of repeated rows
(same id, same text) exactly one is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfault.llm.common import as_bytes, id_and_text, lookup, map_arrow, materialise, mix64, partition_id, place, positional, restored

SHARD_KEYS = 20_000
MIN_SHARDS = 64
GAMMA = 2.0
MAX_LEVELS = 40
GOLDEN = 0x9E3779B97F4A7C15
GROUP = "digest binary, keep_id long, keep_row long, group_size long"


def normalised_digest(text: bytes) -> bytes:
    """SHA-256 of the text with A-Z lowered; ``bytes.lower`` leaves all else as it is."""
    return hashlib.sha256(text.lower()).digest()


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = partition_id() << 40
    for batch in batches:
        n = batch.num_rows
        digests = [normalised_digest(t) for t in as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(row, row + n)), pa.array(digests, pa.binary())], ["doc_id", "row", "digest"])
        row += n


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row, digest`` of every row; ``row`` tells repeated rows apart."""
    source = id_and_text(docs, id_col, text_col)
    return map_arrow(source, _digest_batches, "doc_id long, row long, digest binary")


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte keys: n keys to slots 0 … n-1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, tail: int):
        self.sizes, self.bits, self.tail = sizes, bits, tail
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.cumsum(bits, dtype=np.int64)

    @staticmethod
    def lanes(keys: bytes) -> np.ndarray:
        return np.frombuffer(keys, "<u8").reshape(-1, 4)

    @staticmethod
    def place(lanes: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((GOLDEN * (level + 1)) & (2**64 - 1))
        return (mix64(lanes[:, level % 4] + seed) ^ mix64(lanes[:, (level + 1) % 4] ^ seed)) % np.uint64(size)

    @classmethod
    def build(cls, keys: bytes) -> tuple[PerfectHash, np.ndarray]:
        """The hash and, for each slot, the number of the key that belongs there.

        Keys that still collide after ``MAX_LEVELS`` levels take the last slots and are found by comparison.
        """
        lanes = cls.lanes(keys)
        left, sizes, parts, order = np.arange(len(lanes)), [], [], []
        while len(left) and len(sizes) < MAX_LEVELS:
            size = max(64, int(GAMMA * len(left)))
            at = cls.place(lanes[left], len(sizes), size).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            order.append(left[alone][np.argsort(at[alone])])
            sizes.append(size)
            parts.append(bits)
            left = left[~alone]
        order.append(left)
        hashed = cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint8), len(left))
        return hashed, np.concatenate(order)

    def slots(self, keys: bytes) -> np.ndarray:
        """A slot for every key, -1 where no level has a bit for it; only a comparison tells members."""
        lanes = self.lanes(keys)
        out, left = np.full(len(lanes), -1, np.int64), np.arange(len(lanes))
        for level, size in enumerate(self.sizes):
            at = self.place(lanes[left], level, int(size)).astype(np.int64) + self.starts[level]
            hit = self.bits[at] == 1
            out[left[hit]] = self.rank[at[hit]] - 1
            left = left[~hit]
        return out


INDEX = "shard int, sizes binary, bits binary, tail int, digests binary, winner_id binary, winner_known binary, winner_row binary, counts binary"


def _column(table: pa.Table, name: str, fill: int = 0) -> np.ndarray:
    return table.column(name).combine_chunks().fill_null(fill).to_numpy(zero_copy_only=False)


def _build_shard(table: pa.Table) -> pa.Table:
    keys = b"".join(table.column("digest").to_pylist())
    hashed, order = PerfectHash.build(keys)
    known = (~np.asarray(table.column("keep_id").combine_chunks().is_null())).astype(np.uint8)
    values = {
        "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
        "sizes": hashed.sizes.tobytes(),
        "bits": np.packbits(hashed.bits).tobytes(),
        "tail": pa.array([hashed.tail], pa.int32()),
        "digests": np.frombuffer(keys, "V32")[order].tobytes(),
        "winner_id": _column(table, "keep_id")[order].astype("<i8").tobytes(),
        "winner_known": known[order].tobytes(),
        "winner_row": _column(table, "keep_row")[order].astype("<i8").tobytes(),
        "counts": _column(table, "group_size")[order].astype("<i8").tobytes(),
    }
    return pa.table({k: v if isinstance(v, pa.Array) else pa.array([v], pa.binary()) for k, v in values.items()})


def _look_up_shard(index: pa.Table, arrivals: pa.Table) -> pa.Table:
    """All groups of a shard: historical ones, joined by arrivals that are members, and new ones."""
    ids, known, rows = _column(arrivals, "keep_id"), ~np.asarray(arrivals.column("keep_id").combine_chunks().is_null()), _column(arrivals, "keep_row")
    sizes, found = _column(arrivals, "group_size"), arrivals.column("digest").to_pylist()
    out: tuple[list, ...] = ([], [], [], [], [])
    fresh = np.ones(len(found), bool)
    if index.num_rows:
        cell = {name: index.column(name)[0].as_py() for name in index.column_names}
        levels = np.frombuffer(cell["sizes"], np.int64)
        bits = np.unpackbits(np.frombuffer(cell["bits"], np.uint8))[: int(levels.sum())]
        held = np.frombuffer(cell["digests"], "V32")
        h_id, h_row = np.frombuffer(cell["winner_id"], "<i8").copy(), np.frombuffer(cell["winner_row"], "<i8").copy()
        h_known, h_n = np.frombuffer(cell["winner_known"], np.uint8).astype(bool), np.frombuffer(cell["counts"], "<i8").copy()
        if found:
            slot = PerfectHash(levels, bits, cell["tail"]).slots(b"".join(found))
            last = {held[i].tobytes(): i for i in range(len(held) - cell["tail"], len(held))}
            for i, digest in enumerate(found):
                s = slot[i]
                if s >= 0 and held[s].tobytes() != digest:
                    s = -1
                if s < 0:
                    s = last.get(digest, -1)
                if s >= 0:
                    fresh[i] = False
                    h_n[s] += sizes[i]
                    if (known[i], ids[i], rows[i]) > (h_known[s], h_id[s], h_row[s]):
                        h_known[s], h_id[s], h_row[s] = known[i], ids[i], rows[i]
        for part, value in zip(out, ([x.tobytes() for x in held], h_id, h_known, h_row, h_n), strict=True):
            part.append(value)
    for part, value in zip(out, ([d for d, f in zip(found, fresh, strict=True) if f], ids[fresh], known[fresh], rows[fresh], sizes[fresh]), strict=True):
        part.append(value)
    digest = [d for part in out[0] for d in part]
    keep, has, row, n = (np.concatenate(part) for part in out[1:])
    return pa.table({"digest": pa.array(digest, pa.binary()), "keep_id": pa.array(keep.astype(np.int64), mask=~has.astype(bool)), "keep_row": pa.array(row.astype(np.int64)), "group_size": pa.array(n.astype(np.int64))})


def _groups(rows: DataFrame, shards: int) -> DataFrame:
    """One row per distinct digest with its winner (largest id) and size, and the digest's shard."""
    best = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    shard = F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long") % shards
    return best.select(shard.cast("int").alias("shard"), "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The historical index, one row per shard (columns ``INDEX``), from rows ``doc_id, row, digest``."""
    return _groups(history, shards).groupBy("shard").applyInArrow(_build_shard, INDEX)


def resolve(index: DataFrame, arrivals: DataFrame, shards: int) -> DataFrame:
    """Groups (columns ``GROUP``) of the indexed history and the arrivals together."""
    return index.groupBy("shard").cogroup(_groups(arrivals, shards).groupBy("shard")).applyInArrow(_look_up_shard, GROUP)


def groups(rows: DataFrame, historical: Column, n_rows: int) -> DataFrame:
    shards = max(MIN_SHARDS, -(-n_rows // SHARD_KEYS))
    known = F.coalesce(historical, F.lit(False))
    return resolve(build_index(rows.where(known), shards), rows.where(~known), shards)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", historical: Column | None = None) -> DataFrame:
    """Decision for every row: ``doc_id, keep_id, group_size, kept, digest``.

    ``historical``: which rows are the history, on ``doc_id``; by default the older half, ids up to the
    middle of their range.  The decisions are the same for any division.
    """
    rows = materialise(digests(docs, id_col, text_col), "digests")
    n_rows = rows.count()
    if historical is None:
        low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        historical = F.col("doc_id") <= F.lit((low + high) // 2 if low is not None else 0)
    table = materialise(groups(rows, historical, n_rows), "groups", n_rows)
    found = lookup(rows, table, "digest", "group_size", n_rows)
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Winners are semi-joined on digest and id together, so that a large group of copies is spread by id.
    """
    rows = materialise(digests(docs, id_col, text_col), "digests")
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first() or (None, None)
    n_rows = rows.count()
    table = groups(rows, F.col("doc_id") <= F.lit((low + high) // 2 if low is not None else 0), n_rows)
    winners = materialise(table.select(F.col("digest").alias("_wf_digest"), F.coalesce("keep_id", F.lit(-(2**63))).alias("_wf_id")), "winners", n_rows)
    own = positional(docs)
    tagged = with_digest(own, place(docs, text_col)).withColumn("_wf_id", F.coalesce(F.col(place(docs, id_col)).cast("long"), F.lit(-(2**63))))
    kept = tagged.join(winners, ["_wf_digest", "_wf_id"], "left_semi")
    repeats = rows.groupBy("digest", "doc_id").count().where("count > 1").limit(1).count()
    if repeats:
        kept = kept.dropDuplicates(["_wf_digest", "_wf_id"])
    return restored(kept, docs)


def with_digest(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` and the digest of the normalised text as ``_wf_digest``."""
    at = docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([normalised_digest(t) for t in as_bytes(batch.column(at).cast(pa.string()))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, "_wf_digest"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_wf_digest", T.BinaryType(), True)])
    return map_arrow(docs, add, schema)
