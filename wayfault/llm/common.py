"""Helpers shared by the operators: scratch tables, Arrow batches and skew-free lookups."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A lookup key is hot when it holds at least this share of the rows, so at most 256 keys are.
HOT_SHARE = 1 / 256
FILES_PER_CORE = 2
ROWS_PER_FILE = 100_000
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``, read from the session.

    Where it is unset a local master gets a temporary one; on a cluster that is an error, as executors would write where nobody reads.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = f"file://{tempfile.mkdtemp(prefix='wayfault-')}"
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


#: Paths made within each open ``scratch_scope``.
_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/wayfault-{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that operators wrote within; use it around an action that leaves nothing to be read later, such as a write."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as ``__``) for the actions within, restored afterwards."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise_dealt(df: DataFrame, label: str) -> DataFrame:
    """``materialise`` for few bytes with much work on each: as many tasks as there are shuffle partitions, whatever these weigh."""
    with settings(df.sparkSession, spark__sql__adaptive__coalescePartitions__enabled="false"):
        return materialise(df, label)


def materialise(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    ``rows``: an upper bound of its rows, for tables of keys and numbers that cost little to make; they are written in a file for each ``ROWS_PER_FILE`` of them
    (and two per core at least), not in one per shuffle partition.
    """
    path = scratch_path(df.sparkSession, label)
    if rows is not None:
        df = df.coalesce(max(FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_FILE)))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(nullable(df.schema)).parquet(path)


#: Rows of a written table are numbered by ``monotonically_increasing_id``: the upper bits are the task that wrote them, a *part*.
PART_BITS = 33


def numbered_rows(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``row``, a number of its own for each row, written so that every later pass sees the same numbers."""
    return materialise(df.withColumn("row", F.monotonically_increasing_id()), label)


def part_of(row: str | Column) -> Column:
    return F.shiftrightunsigned(row, PART_BITS)


def by_part(df: DataFrame, label: str, *order: str) -> str:
    """Write a table with ``part``, a folder for each part; the path.  A task that reads a part's rows reads what belongs to them with ``storage.read_part``.

    So decisions about rows come to the rows, and the rows, which hold the texts, are never shuffled.
    """
    path = scratch_path(df.sparkSession, label)
    df.repartition("part").sortWithinPartitions("part", *order).write.option("compression", "zstd").partitionBy("part").parquet(path)
    return path


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def tune(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches bounded by rows and by bytes, so that long texts fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def release() -> None:
    """Give freed memory back: Spark reuses a Python worker for later stages, whose memory adds to what is kept here."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, rows: int = 1000) -> DataFrame:
    tune(df.sparkSession, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def partition_id() -> int:
    return TaskContext.get().partitionId()


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def lookup(rows: DataFrame, table: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per ``key`` and the key's number of rows in ``size``.

    Keys with at least ``HOT_SHARE`` of the rows, of which there can be no more than 256, are
    broadcast; the others, none of which is large, meet in an ordinary shuffled join.
    """
    hot = F.col(size) >= max(1000, n_rows * HOT_SHARE)
    few = F.broadcast(table.where(hot))
    large = rows.join(few, key, "inner")
    rest = rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti")
    return large.unionByName(rest.join(table.where(~hot), key, "inner"))


def positional(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named ``c0, c1, …``, so that no name of theirs clashes with another or differs in case only."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def place(docs: DataFrame, name: str) -> str:
    """What ``positional`` calls a column: the one of that very name, else the first that differs in case only."""
    names = docs.columns if name in docs.columns else [c.lower() for c in docs.columns]
    return f"c{names.index(name if name in docs.columns else name.lower())}"


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id`` (long) and ``text`` (string) of every row."""
    return positional(docs).select(F.col(place(docs, id_col)).cast("long").alias("doc_id"), F.col(place(docs, text_col)).cast("string").alias("text"))


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of ``positional(docs)``, other columns dropped, under the names of ``docs``."""
    return rows.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def drop_ids(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is not in the one column of ``gone``, with all their columns."""
    rows, ids = positional(docs), gone.toDF("_wf_id").distinct()
    return restored(rows.join(ids, F.col(place(docs, id_col)).cast("long") == F.col("_wf_id"), "left_anti"), docs)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit lanes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
