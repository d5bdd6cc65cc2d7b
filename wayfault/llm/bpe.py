"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 16 bytes cuts a text into chunks, so that a passage shared by documents falls
into the same chunks wherever it stands.  A join of chunks is certain where a word of the pattern must end: where a visible character meets white
space, for no word has white space after its first character, and where a full-width mark meets a letter or a number, for no word
holds both.  Any other join (in text without such places) is repaired: what lies between the last certain place on its left and the
first on its right is encoded anew, as a chunk of its own, so that ids agree with those of the whole text on both sides.

Chunks that occur more than once anywhere are encoded once.  Each task lists the 128-bit digests of its chunks; digests that are listed twice
get a home, the first place where they stand; the task that reads the home encodes the chunk; and each task is handed
the ids of the shared chunks of its own part of the texts.  Digests, about a fiftieth of the texts, and ids of shared chunks, once for each part, are
shuffled; texts are not: they are written once with row numbers, so that all passes see the same rows.
A task holds the ids of the shared chunks of its part, chunks that it met lately (``CACHE_BYTES``) and one batch.

A vocabulary file that is no plain byte-level BPE has another word pattern, so its texts are never cut: each is one chunk.

Defined results: a null text counts as empty (no ids); special tokens in a text are encoded as such, as the
library does by default; rows without an id and repeated rows are results like others; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfault.llm import storage
from wayfault.llm.common import PART_BITS, as_bytes, by_part, id_and_text, map_arrow, materialise, numbered_rows, part_of
from wayfault.llm.tokenizer import ByteBpe, default_path, load

WINDOW = 16
AT_SPACE = (1 << 7) - 1  # one white space of 128 cuts
ANYWHERE = (1 << 14) - 1  # one other place of 16384
LONGEST = 1 << 16
CACHE_BYTES = 24 << 20
LISTED = 100_000  # digests of a task that are counted before they are handed on
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Pseudorandom values of the 256 bytes, from a rule.
GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte the hash of it and the 15 before, by doubling the window four times."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        new = h.copy()
        new[step:] += h[:-step] << np.uint32(step)
        h = new
    return h ^ (h >> np.uint32(15))


#: Full-width comma, full stop, and marks: neither white space, letters nor numbers.
MARKS = [m.encode() for m in "\u3001\u3002\uff0c\uff01\uff1f"]


def certain(text: bytes, data: np.ndarray) -> np.ndarray:
    """Places where words of the pattern must part: before ASCII white space, after a visible ASCII character; and between a full-width mark and a letter or number."""
    sure = np.flatnonzero(SPACE[data[1:]] & (data[:-1] > 0x20) & (data[:-1] < 0x7F)) + 1
    more = []
    for mark in MARKS:
        at = text.find(mark)
        while at >= 0:
            at += len(mark)
            after = text[at : at + 4].decode("utf-8", "ignore")[:1]
            if after and unicodedata.category(after)[0] in "LN":
                more.append(at)
            at = text.find(mark, at)
    return np.union1d(sure, np.array(more, np.int64)) if more else sure


def cuts(data: np.ndarray, sure: np.ndarray) -> list[int]:
    """Ends of the chunks of a text, the last being its end; ``sure``: its certain places."""
    n = len(data)
    if n <= 2 * WINDOW:
        return [n]
    before, here = rolling(data)[:-1], data[1:]  # the hash of what precedes a place
    space = np.zeros(n - 1, bool)
    space[sure - 1] = True
    hit = (space & (before & np.uint32(AT_SPACE) == 0)) | ((before & np.uint32(ANYWHERE) == 0) & (here & 0xC0 != 0x80))
    out, last = [], 0
    for place in [*(np.flatnonzero(hit[WINDOW:]) + WINDOW + 1).tolist(), n]:
        while place - last > LONGEST:  # forced, at the start of a character
            last += LONGEST
            while data[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        if place > last:
            out.append(place)
            last = place
    return out


def pieces(text: bytes, whole: bool = False) -> tuple[list[tuple[int, int]], int]:
    """Consecutive chunks of a text, all of whose joins are certain, and how many of them repair a join that was not."""
    n = len(text)
    if not n or whole:
        return [(0, n)] if n else [], 0
    data = np.frombuffer(text, np.uint8)
    sure = certain(text, data)
    out, start, repairs = [], 0, 0
    for end in cuts(data, sure):
        if end <= start:  # lies in a repaired stretch
            continue
        i = int(np.searchsorted(sure, end))
        if end == n or i < len(sure) and sure[i] == end:
            out.append((start, end))
            start = end
            continue
        back = max(start, int(sure[i - 1]) if i else 0)
        first = int(sure[i]) if i < len(sure) else n
        if back > start:
            out.append((start, back))
        out.append((back, first))
        repairs += 1
        start = first
    return out, repairs


Part = tuple[np.ndarray, bytes, bytes]


class ChunkEncoder:
    """Encodes texts chunk by chunk.

    ``shared``: ids (as bytes) of chunks by digest, encoded elsewhere.  ``hits``, ``given``, ``misses`` and ``repairs`` count chunks met lately, chunks
    whose ids were given, chunks encoded, and chunks that repair a join.
    """

    def __init__(self, bpe: ByteBpe, cache_bytes: int = CACHE_BYTES, shared: dict[bytes, bytes] | None = None):
        self.bpe, self.limit, self.held, self.shared = bpe, cache_bytes, 0, shared or {}
        self.cache: OrderedDict[bytes, Part] = OrderedDict()
        self.hits = self.given = self.misses = self.repairs = 0
        self.names = [str(i).encode() for i in range(bpe.size)]

    def chunk(self, piece: bytes) -> Part:
        """Ids of a chunk, their decimal list, and the bytes that they decode to."""
        got = self.cache.get(piece)
        if got is not None:
            self.hits += 1
            self.cache.move_to_end(piece)
            return got
        ids = self.shared.get(digest(piece)) if self.shared else None
        if ids is None:
            self.misses += 1
            got = self.part(piece, self.bpe.encode(piece.decode("utf-8", "replace")))
        else:
            self.given += 1
            got = self.part(piece, np.frombuffer(ids, "<u4"))
        self.cache[piece] = got
        self.held += self.cost(piece, got)
        while self.held > self.limit and len(self.cache) > 1:
            self.held -= self.cost(*self.cache.popitem(last=False))
        return got

    @staticmethod
    def cost(piece: bytes, part: Part) -> int:
        return len(piece) + part[0].nbytes + len(part[1]) + (part[2] is not piece) * len(part[2]) + 300

    def part(self, piece: bytes, ids: np.ndarray) -> Part:
        names, table, listed = self.names, self.bpe.bytes, ids.tolist()
        back = b"".join([table[i] for i in listed])
        return ids, b",".join([names[i] for i in listed]), piece if back == piece else back

    def parts(self, text: bytes) -> list[Part]:
        """Consecutive stretches of the text whose ids, one after the other, are the text's."""
        cut, repairs = pieces(text, not self.bpe.plain)
        self.repairs += repairs
        return [self.chunk(text[a:b]) for a, b in cut]

    def encode(self, text: bytes) -> np.ndarray:
        parts = self.parts(text)
        return np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, "<u4")


# -- chunks of all texts
def digest(piece: bytes) -> bytes:
    return xxhash.xxh3_128_digest(piece)


LISTS = "part long, digest binary, n long, row long, start long, size long"


def _listed(path: str):
    """The chunks of each part with the number of their occurrences and one place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = not load(path).plain
        seen: dict[tuple[int, bytes], list[int]] = {}

        def flush() -> pa.RecordBatch:
            columns = [[p for p, _ in seen], [d for _, d in seen], *([v[k] for v in seen.values()] for k in range(4))]
            types = [pa.int64(), pa.binary(), *[pa.int64()] * 4]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "digest", "n", "row", "start", "size"])
            seen.clear()
            return made

        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                for a, b in pieces(text, whole)[0]:
                    seen.setdefault((row >> PART_BITS, digest(text[a:b])), [0, row, a, b - a])[0] += 1
                if len(seen) >= LISTED:
                    yield flush()
        if seen:
            yield flush()

    return run


def _encode_at_home(homes: str, path: str):
    """Ids of the shared chunks whose home is in the rows at hand."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, table, rows = load(path), None, None, np.zeros(0, np.int64)
        for batch in batches:
            digests, made = [], []
            numbers, texts = np.asarray(batch.column(0)), batch.column(1).cast(pa.binary())
            for i, row in enumerate(numbers.tolist()):
                if row >> PART_BITS != part:
                    part = row >> PART_BITS
                    table = storage.read_part(homes, part)
                    rows = np.zeros(0, np.int64) if table is None else table.column("row").to_numpy()
                low, high = np.searchsorted(rows, row), np.searchsorted(rows, row, "right")
                if low == high:
                    continue
                text = texts[i].as_py()
                own = table.slice(low, high - low)
                for a, n, d in zip(own.column("start").to_pylist(), own.column("size").to_pylist(), own.column("digest").to_pylist(), strict=True):
                    digests.append(d)
                    made.append(bpe.encode(text[a : a + n].decode("utf-8", "replace")).tobytes())
            if digests:
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(made, pa.binary())], ["digest", "ids"])

    return run


class Shared:
    """Ids of the shared chunks of the part that a task reads."""

    def __init__(self, folder: str, encoder: ChunkEncoder):
        self.folder, self.encoder, self.part = folder, encoder, None

    def at(self, row: int) -> None:
        if row >> PART_BITS != self.part:
            self.part = row >> PART_BITS
            table = storage.read_part(self.folder, self.part)
            self.encoder.shared = {} if table is None else dict(zip(table.column("digest").to_pylist(), table.column("ids").to_pylist(), strict=True))


def prepared(docs: DataFrame, id_col: str, text_col: str, path: str) -> tuple[DataFrame, str]:
    """The texts with row numbers (``row, doc_id, text``), and the folder of each part's shared chunks."""
    rows = numbered_rows(id_and_text(docs, id_col, text_col), "texts").select("row", "doc_id", "text")
    texts = rows.select("row", "text")
    lists = materialise(map_arrow(texts, _listed(path), LISTS), "chunks")
    shared = lists.groupBy("digest").agg(F.sum("n").alias("n"), F.min(F.struct("row", "start", "size")).alias("home")).where("n > 1")
    homes = by_part(shared.select(part_of("home.row").alias("part"), "home.row", "home.start", "home.size", "digest"), "homes", "row", "start")
    encoded = materialise(map_arrow(texts, _encode_at_home(homes, path), "digest binary, ids binary"), "encoded")
    return rows, by_part(lists.select("part", "digest").distinct().join(encoded, "digest"), "shared")


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, ids`` (array of int) of every row."""
    path = path or default_path()
    rows, shared = prepared(docs, id_col, text_col, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(load(path))
        given = Shared(shared, encoder)
        for batch in batches:
            ids = []
            for row, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(2)), strict=True):
                given.at(row)
                ids.append(encoder.encode(text).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_arrow(rows, run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id`` and a column of ids; null ids give a null text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ids_col).alias("ids")), run, "doc_id long, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Digests of the ids and of the text decoded from them (columns ``RESULT``), without moving either."""
    return digests(docs, id_col, text_col, path).select(*[c.split()[0] for c in RESULT.split(", ")])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``RESULT``, and of each text how many chunks it has, and how many of these were given or met before, and not encoded again."""
    path = path or default_path()
    rows, shared = prepared(docs, id_col, text_col, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(load(path))
        given = Shared(shared, encoder)
        for batch in batches:
            counts, ids_sha, text_sha, chunks, reused = [], [], [], [], []
            for row, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(2)), strict=True):
                given.at(row)
                before = encoder.hits + encoder.given
                parts = encoder.parts(text)
                chunks.append(len(parts))
                reused.append(encoder.hits + encoder.given - before)
                parts = [p for p in parts if len(p[0])]
                counts.append(sum([len(p[0]) for p in parts]))
                ids_sha.append(hashlib.sha256(b",".join([p[1] for p in parts])).hexdigest())
                back = b"".join([p[2] for p in parts])
                text_sha.append(hashlib.sha256(back if back == text else back.decode("utf-8", "replace").encode()).hexdigest())
            columns = [batch.column(1), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha), pa.array(chunks, pa.int64()), pa.array(reused, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chunks", "n_reused"])

    return map_arrow(rows, run, RESULT + ", n_chunks long, n_reused long")
