"""Best-two-fit packing of tokenised documents into sequences.

Documents are cut into pieces of at most ``capacity`` tokens.  Equal lengths are interchangeable, so the packing
is decided on the histogram of lengths, which has ``capacity`` entries at any corpus size: a bin is filled
greedily (always the longest piece that fits), then its smallest piece is replaced by the two unpacked
pieces that fill the widened gap best, if they fill it better.  The resulting pattern is used as often as
the counts allow, which is what packing bin by bin would do.  Each use takes the next pieces of
its lengths: a piece's number among those of its length is its number in its task plus those of earlier tasks,
so no task sees more than its own input and no group is gathered.

Defined results: a null or empty text is the end token alone; rows without an id and repeated rows are
packed as they are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfault.llm.common import as_bytes, id_and_text, map_arrow, materialise, partition_id
from wayfault.llm.tokenizer import default_path, load

CAPACITY = 2048
END_ID = 0
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Pieces of a document of n ids: whole if it fits, else full ones after a first that may be shorter."""
    first = n % capacity or capacity
    return [first] + [capacity] * ((n - first) // capacity)


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int) -> DataFrame:
    """Columns ``PIECE``; ``number`` counts the pieces of the same length in the task ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen, part = load(path), [0] * (capacity + 1), partition_id()
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                ids = np.append(bpe.encode(text.decode("utf-8", "replace")), np.uint32(END_ID)).astype("<u4")
                start = 0
                for k, length in enumerate(cut_lengths(len(ids), capacity)):
                    for column, value in zip(rows, (doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), seen[length]), strict=True):
                        column.append(value)
                    seen[length] += 1
                    start += length
            doc_id, piece, starts, lengths, crc, number = rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_id, pa.int64()), pa.array(piece, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(piece), pa.int32()), pa.array(number, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"],
            )

    return map_arrow(id_and_text(docs, id_col, text_col), run, PIECE)


def best_pair(left: np.ndarray, room: int) -> tuple[int, int]:
    """The two lengths among those left (counts by length) with the largest sum of at most ``room``; (0, 0) if none."""
    lengths = np.flatnonzero(left[: room + 1])
    if not len(lengths):
        return 0, 0
    below = np.zeros(room + 1, np.int64)  # the longest length left that is at most so long
    below[lengths] = lengths
    below = np.maximum.accumulate(below)
    partner = below[np.minimum(room - lengths, lengths)]
    twice = (partner == lengths) & (left[lengths] < 2)
    partner[twice] = below[lengths[twice] - 1]
    total = np.where(partner > 0, lengths + partner, 0)
    best = int(np.argmax(total))
    return (int(lengths[best]), int(partner[best])) if total[best] else (0, 0)


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of a bin, longest first) and how often each is used; ``counts`` is by length."""
    left, out = counts.astype(np.int64).copy(), []
    longest = capacity
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return out
        gap, bin_, trial, upper = capacity, [], left.copy(), longest
        while gap:
            fits = np.flatnonzero(trial[1 : min(gap, upper) + 1])
            if not len(fits):
                break
            upper = int(fits[-1]) + 1
            n = min(int(trial[upper]), gap // upper)
            bin_ += [upper] * n
            trial[upper] -= n
            gap -= n * upper
            upper -= 1
        if gap and len(bin_) > 1:
            small = bin_[-1]
            a, b = best_pair(trial, min(capacity, gap + small))
            if a + b > small:
                bin_ = sorted([*bin_[:-1], a, b], reverse=True)
        use = np.bincount(bin_, minlength=capacity + 1)
        used = np.flatnonzero(use)
        times = int((left[used] // use[used]).min())
        left[used] -= times * use[used]
        out.append((bin_, times))


class Plan:
    """Where the n-th piece of a length goes; a few numbers per pattern and length."""

    def __init__(self, patterns: list[tuple[list[int], int]], capacity: int):
        rows, taken, sequence = [], [0] * (capacity + 1), 0
        for bin_, times in patterns:
            offset = 0
            for length in dict.fromkeys(bin_):
                copies = bin_.count(length)
                rows.append((length, taken[length], sequence, copies, offset))
                taken[length] += times * copies
                offset += copies * length
            sequence += times
        self.sequences = sequence
        self.rows = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.keys = self.rows[:, 0] << 48 | self.rows[:, 1]

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = self.rows[np.searchsorted(self.keys, length << 48 | number, side="right") - 1]
        bin_, copy = np.divmod(number - row[:, 1], row[:, 3])
        return row[:, 2] + bin_, row[:, 4] + copy * length


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    spark: SparkSession = docs.sparkSession
    rows = materialise(pieces(docs, id_col, text_col, path or default_path(), capacity), "pieces")
    per_task = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r.length] = r.n
    plan = spark.sparkContext.broadcast(Plan(best_two_fit(counts, capacity), capacity))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    numbered = rows.join(per_task.select("length", "part", earlier.alias("before")), ["length", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            if not len(length):
                continue
            sequence, offset = plan.value.place(length, number)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    columns = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("number")).alias("number"))
    return map_arrow(columns, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", 20_000)
