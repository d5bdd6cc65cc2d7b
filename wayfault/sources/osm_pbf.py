"""Reader of binary map extracts (the public protocol-buffer format of OpenStreetMap).

A file is a sequence of blobs.  The driver reads their headers only, skipping the data; ranges of whole blobs are dealt over the tasks, which
decode them with numpy, so a file of any size is read in parallel and no task holds more than one blob.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "node_id long, x double, y double, tags map<string,string>"
WAYS = "osmid long, node_ids array<bigint>, tags map<string,string>"
BLOBS_PER_TASK = 16
#: Tags of ways that are no roads for cars, and the tags that analyses use.
NOT_DRIVABLE = {
    "area": ["yes"], "motor_vehicle": ["no"], "motorcar": ["no"], "service": ["parking", "parking_aisle", "private", "emergency_access"],
    "highway": [
        "cycleway", "footway", "path", "pedestrian", "steps", "track", "corridor", "elevator", "escalator", "proposed", "construction", "bridleway", "abandoned", "platform", "raceway",
    ],
}
TAGS = ["highway", "service", "ref", "name", "bridge", "tunnel", "surface", "maxspeed"]


def _open(path: str):
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(inner)


# -- protocol buffers
def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a message's fields."""
    at, end = 0, len(data)
    while at < end:
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield key >> 3, value


def packed(data: bytes) -> np.ndarray:
    """Unsigned numbers of a packed field."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(raw < 0x80)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def signed(v: np.ndarray) -> np.ndarray:
    """Numbers that were stored with alternating signs."""
    return (v >> np.uint64(1)).astype(np.int64) ^ -(v & np.uint64(1)).astype(np.int64)


def unsigned_to_signed(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


# -- blobs
def blob_index(path: str) -> list[tuple[int, int]]:
    """Offset and size of each blob of data; nothing but headers is read."""
    out = []
    with _open(path) as f:
        total, at = f.size(), 0
        while at < total:
            f.seek(at)
            (size,) = struct.unpack(">I", f.read(4))
            head = dict(fields(f.read(size)))
            start = at + 4 + size
            if head[1] == b"OSMData":
                out.append((start, head[3]))
            at = start + head[3]
    return out


def unpacked(blob: bytes) -> bytes:
    got = dict(fields(blob))
    if 1 in got:
        return got[1]
    if 3 in got:
        return zlib.decompress(got[3])
    if 7 in got:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(got[7], max_output_size=got.get(2, 1 << 25))
    raise ValueError("a blob of unknown compression")


def block(data: bytes) -> tuple[list[str], list[bytes], int, int, int]:
    """Strings, groups, and granularity and offsets of places of a block."""
    strings, groups, granularity, lat, lon = [], [], 100, 0, 0
    for n, v in fields(data):
        if n == 1:
            strings = [s.decode("utf-8", "replace") for k, s in fields(v) if k == 1]
        elif n == 2:
            groups.append(v)
        elif n == 17:
            granularity = v
        elif n == 19:
            lat = v - (1 << 64) if v >> 63 else v
        elif n == 20:
            lon = v - (1 << 64) if v >> 63 else v
    return strings, groups, granularity, lat, lon


def nodes_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[tuple[str, str]]]]:
    strings, groups, granularity, lat0, lon0 = block(data)
    ids, xs, ys, tags = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)], []
    place = lambda v, off: (off + granularity * v) / 1e9
    for group in groups:
        for n, v in fields(group):
            if n == 2:
                got = dict(fields(v))
                own = np.cumsum(signed(packed(got.get(1, b""))))
                ids.append(own)
                ys.append(place(np.cumsum(signed(packed(got.get(8, b"")))), lat0))
                xs.append(place(np.cumsum(signed(packed(got.get(9, b"")))), lon0))
                listed, at = packed(got.get(10, b"")).tolist(), 0
                for _ in range(len(own)):
                    mine = []
                    while at < len(listed) and listed[at]:
                        mine.append((strings[listed[at]], strings[listed[at + 1]]))
                        at += 2
                    at += 1
                    tags.append(mine)
            elif n == 1:
                got = dict(fields(v))
                ids.append(np.array([unsigned_to_signed(got[1])], np.int64))
                ys.append(np.array([place(unsigned_to_signed(got[8]), lat0)]))
                xs.append(np.array([place(unsigned_to_signed(got[9]), lon0)]))
                keys, values = packed(got.get(2, b"")).tolist(), packed(got.get(3, b"")).tolist()
                tags.append([(strings[k], strings[x]) for k, x in zip(keys, values, strict=True)])
    return np.concatenate(ids), np.concatenate(xs), np.concatenate(ys), tags


def ways_of(data: bytes) -> tuple[list[int], list[np.ndarray], list[list[tuple[str, str]]]]:
    strings, groups, *_ = block(data)
    ids, refs, tags = [], [], []
    for group in groups:
        for n, v in fields(group):
            if n != 3:
                continue
            got = dict(fields(v))
            ids.append(got[1])
            refs.append(np.cumsum(signed(packed(got.get(8, b"")))))
            keys, values = packed(got.get(2, b"")).tolist(), packed(got.get(3, b"")).tolist()
            tags.append([(strings[k], strings[x]) for k, x in zip(keys, values, strict=True)])
    return ids, refs, tags


def _read(spark: SparkSession, path: str, schema: str, batch_of) -> DataFrame:
    """``batch_of`` of each blob; blobs are dealt in runs, by their place in the file."""
    index = blob_index(path)
    rows = spark.createDataFrame([(a, b) for a, b in index], "start long, size long")
    rows = rows.repartitionByRange(max(1, -(-len(index) // BLOBS_PER_TASK)), "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with _open(path) as f:
                for start, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    f.seek(start)
                    made = batch_of(unpacked(f.read(size)))
                    if made.num_rows:
                        yield made

    return rows.mapInArrow(run, schema)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """All nodes: ``node_id, x, y, tags``."""
    def made(data: bytes) -> pa.RecordBatch:
        ids, xs, ys, tags = nodes_of(data)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(xs), pa.array(ys), pa.array(tags, pa.map_(pa.string(), pa.string()))], ["node_id", "x", "y", "tags"])

    return _read(spark, path, NODES, made)


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    """All ways: ``osmid, node_ids, tags``."""
    def made(data: bytes) -> pa.RecordBatch:
        ids, refs, tags = ways_of(data)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(refs, pa.list_(pa.int64())), pa.array(tags, pa.map_(pa.string(), pa.string()))], ["osmid", "node_ids", "tags"])

    return _read(spark, path, WAYS, made)


def drivable(tags: Column) -> Column:
    """Whether a way is a road for cars."""
    out = F.try_element_at(tags, F.lit("highway")).isNotNull()
    for key, values in NOT_DRIVABLE.items():
        out = out & ~F.coalesce(F.try_element_at(tags, F.lit(key)).isin(values), F.lit(False))
    return out


def driving_network(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Ways and nodes of the roads for cars, as ``base_edges`` and the flows take them, within a bounding box (min x, min y, max x, max y).

    A way tagged one-way against its direction is turned; roundabouts are one-way.  With a box a way stays if a node of it is inside, and so do its nodes.
    """
    ways, nodes = read_ways(spark, path), read_nodes(spark, path).select("node_id", "x", "y")
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    roads = ways.where(drivable(F.col("tags")))
    back = F.coalesce(tag("oneway").isin("-1", "reverse"), F.lit(False))
    one = back | F.coalesce(tag("oneway").isin("yes", "true", "1"), F.lit(False)) | F.coalesce(tag("junction") == "roundabout", F.lit(False))
    roads = roads.select("osmid", F.when(back, F.reverse("node_ids")).otherwise(F.col("node_ids")).alias("node_ids"), one.alias("oneway"), *[tag(k).alias(k) for k in TAGS])
    if box:
        inside = nodes.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3])).select("node_id")
        hit = roads.select("osmid", F.explode("node_ids").alias("node_id")).join(inside, "node_id", "left_semi").select("osmid").distinct()
        roads = roads.join(hit, "osmid", "left_semi")
    used = roads.select(F.explode("node_ids").alias("node_id")).distinct()
    return roads, nodes.join(used, "node_id", "left_semi")
