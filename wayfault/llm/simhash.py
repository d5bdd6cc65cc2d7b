"""SimHash near-duplicates found through deletion-variant signatures.

A document's 64-bit fingerprint holds, bit by bit, the majority over the XXH64 values of its word shingles.
Two fingerprints link at ``k`` = 2 or fewer differing bits.  Ordinary block indexes cut a fingerprint into
k + 1 segments so that one is equal; here it is cut into only two halves, so that one differs by at most one
bit, and every half is indexed under its 32 one-wildcard variants (one bit deleted).  Halves that differ in at
most one bit share a variant, so an equality grouping on (position, remaining 31 bits) finds every pair;
members of a bucket are verified with the full Hamming distance.

Only distinct fingerprints are indexed, copies being classes.  A bucket never emits its pairs: its verified
links are merged on the spot and leave one row per member.  Buckets of more than ``BUCKET`` fingerprints are
dealt again by one-wildcard variants of the quarters of their other half; such a bucket agrees in at least
46 bits, so it holds fewer than 2**19 fingerprints whatever the corpus, and is linked by probing the
possible neighbours of each member instead of by pairs.

Defined results: a null text counts as empty; a text without words has fingerprint zero, which links like
any other; rows without an id take part but name no component; repeated rows share a fingerprint; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfault.llm.common import as_bytes, drop_ids, id_and_text, lookup, map_arrow, materialise, materialise_dealt
from wayfault.llm.components import components, components_named, roots

SEED = 42
BITS = 2
BUCKET = 2048
LINK_ROWS = 50_000
SLICE = 1 << 20  # bytes of text whose shingles are held at once


def shingle_hashes(text: bytes, size: int) -> bytes:
    """XXH64 (big-endian, 8 bytes each) of the word shingles of a text; ``bytes.split`` cuts at \\x20\\x09-\\x0D."""
    words = text.lower().split()
    digest = xxhash.xxh64_digest
    if len(words) <= size:
        return digest(b" ".join(words), SEED) if words else b""
    form = b" ".join([b"%b"] * size)
    return b"".join([digest(form % x, SEED) for x in zip(*[words[i:] for i in range(size)])])  # noqa: B905


def majorities(blobs: list[bytes]) -> np.ndarray:
    """The fingerprint of each list of hashes, zero where there are none."""
    counts = np.array([len(b) // 8 for b in blobs], np.int64)
    out = np.zeros(len(blobs), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    bits = np.unpackbits(np.frombuffer(b"".join(blobs), np.uint8)).reshape(-1, 64)
    ends = np.cumsum(counts[full])
    for i, start, end in zip(full, ends - counts[full], ends, strict=True):
        part, ones = bits[start:end], np.zeros(64, np.int64)
        for at in range(0, len(part), 255):  # a block's sums fit a byte
            ones += np.add.reduce(part[at : at + 255], axis=0, dtype=np.uint8)
        out[i] = np.packbits(ones * 2 > counts[i]).view(">u8")[0]
    return out


def fingerprint_texts(texts: list[bytes], size: int = 3) -> np.ndarray:
    out, held, bytes_held = [], [], 0
    for text in texts:
        held.append(shingle_hashes(text, size))
        bytes_held += len(text)
        if bytes_held >= SLICE:
            out.append(majorities(held))
            held, bytes_held = [], 0
    out.append(majorities(held))
    return np.concatenate(out)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``doc_id, fp`` of every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprint_texts(as_bytes(batch.column(1)), size).view(np.int64))], ["doc_id", "fp"])

    return map_arrow(id_and_text(docs, id_col, text_col), run, "doc_id long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """``bucket, sub, fp``: each fingerprint under its 2 x 32 one-wildcard variants."""
    at = F.explode(F.sequence(F.lit(0), F.lit(63)))
    half = F.when(F.col("at") < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp")).bitwiseAND(F.lit(0xFFFFFFFF))
    kept = half.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, at % 32)")))
    key = F.col("at").cast("long") * F.lit(1 << 32) + kept
    return fps.select("fp", at.alias("at")).select(key.alias("bucket"), F.lit(0).alias("sub"), "fp")


def sub_variants(deferred: DataFrame) -> DataFrame:
    """Members of large buckets, dealt by the one-wildcard variants of the other half's two quarters."""
    at = F.explode(F.sequence(F.lit(0), F.lit(31)))
    other = F.when(F.col("bucket") < 32 * (1 << 32), F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    quarter = F.when(F.col("at") < 16, F.shiftrightunsigned("other", 16)).otherwise(F.col("other")).bitwiseAND(F.lit(0xFFFF))
    kept = quarter.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, at % 16)")))
    rows = deferred.select("bucket", "fp", other.alias("other"), at.alias("at"))
    return rows.select("bucket", (F.col("at") * F.lit(1 << 16) + kept).cast("int").alias("sub"), "fp")


def link_pairs(fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """All links among a few distinct fingerprints, by comparing them."""
    a, b = [], []
    for at in range(0, len(fps), 256):
        near = np.bitwise_count(fps[at : at + 256, None] ^ fps[None, :]) <= bits
        i, j = np.nonzero(near)
        over = j > i + at
        a.append(fps[i[over] + at])
        b.append(fps[j[over]])
    return np.concatenate(a), np.concatenate(b)


def link_probes(fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """All links among many distinct fingerprints, by looking each possible neighbour up; linear in their number.

    Only bits in which members differ at all are flipped.
    """
    fps = np.sort(fps)
    free = np.bitwise_or.reduce(fps) & ~np.bitwise_and.reduce(fps)
    ones = [np.uint64(1 << i) for i in range(64) if int(free) >> i & 1]
    masks = ones + [x | y for n, x in enumerate(ones) for y in ones[:n]] * (bits > 1)
    a, b = [], []
    for mask in masks:
        other = fps ^ mask
        at = np.searchsorted(fps, other)
        at[at == len(fps)] = 0
        hit = (fps[at] == other) & (other > fps)
        a.append(fps[hit])
        b.append(other[hit])
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def merge_bucket(fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The linked members of a bucket and the root of each, without the pairs."""
    a, b = link_pairs(fps, bits) if len(fps) <= BUCKET else link_probes(fps, bits)
    node, root = roots(a.view(np.int64), b.view(np.int64))
    return node[node != root], root[node != root]


def _link(last: bool, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets arrive one after the other; those of the first round that are too large are passed on."""
        names = ["bucket", "u", "v", "deferred"]
        held_b, held_s, held = (np.zeros(0, np.int64) for _ in range(3))
        passing = None

        def emitted(bucket: np.ndarray, u: np.ndarray, v: np.ndarray, deferred: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(u), pa.array(v), pa.array(np.full(len(u), deferred))], names)

        def settle(b: np.ndarray, s: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole buckets: pairs at once, larger ones each for itself."""
            if not len(f):
                return
            cut = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (s[1:] != s[:-1])]))
            size = np.diff(np.concatenate([cut, [len(f)]]))
            two = cut[size == 2]
            x, y = f[two], f[two + 1]
            near = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= bits
            us, vs = [np.maximum(x, y)[near]], [np.minimum(x, y)[near]]
            for at, n in zip(cut[size > 2], size[size > 2], strict=True):
                if n > BUCKET and not last:
                    yield emitted(b[at : at + n], f[at : at + n], f[at : at + n], True)
                    continue
                node, root = merge_bucket(f[at : at + n].view(np.uint64), bits)
                us.append(node)
                vs.append(root)
            pairs = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], 1), axis=0)
            yield emitted(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1], False)

        for batch in batches:
            b, s, f = (np.asarray(c) for c in batch.columns)
            if not len(b):
                continue
            b, s, f = np.concatenate([held_b, b]), np.concatenate([held_s, s]), np.concatenate([held, f])
            if passing is not None:  # the rest of a large bucket
                same = int(np.searchsorted(b != passing, True))
                if same:
                    yield emitted(b[:same], f[:same], f[:same], True)
                b, s, f = b[same:], s[same:], f[same:]
                if not len(b):
                    held_b, held_s, held = b, s, f
                    continue
                passing = None
            open_ = len(b) - int(np.searchsorted(((b != b[-1]) | (s != s[-1]))[::-1], True))
            yield from settle(b[:open_], s[:open_], f[:open_])
            held_b, held_s, held = b[open_:], s[open_:], f[open_:]
            if len(held) > BUCKET and not last:
                passing = held_b[0]
                yield emitted(held_b, held, held, True)
                held_b, held_s, held = held_b[:0], held_s[:0], held[:0]
        yield from settle(held_b, held_s, held)

    return run


def link(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows ``u, v`` that connect exactly the fingerprints (distinct, column ``fp``) that links connect."""
    schema = "bucket long, u long, v long, deferred boolean"

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket", "sub").sortWithinPartitions("bucket", "sub", "fp")

    first = materialise_dealt(map_arrow(dealt(variants(fps)), _link(False, bits), schema, LINK_ROWS), "links")
    deferred = first.where("deferred").select("bucket", F.col("u").alias("fp"))
    second = map_arrow(dealt(sub_variants(deferred)), _link(True, bits), schema, LINK_ROWS)
    return first.where("not deferred").select("u", "v").unionByName(second.select("u", "v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, bits: int = BITS) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; a component is named by its smallest id."""
    if not 0 <= bits <= 2:
        raise ValueError("cut into two halves, one of which may differ by one bit, fingerprints can link at 0 to 2 bits")
    rows = materialise(fingerprints(docs, id_col, text_col, size), "fingerprints")
    n_rows = rows.count()
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes", n_rows)
    stars = components(link(classes.select("fp"), bits))
    return lookup(rows, components_named(classes, stars, "fp", n_rows), "fp", "n", n_rows).select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str) -> Column:
    """16 lower-case hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names their component, with all their columns; rows without an id stay."""
    gone = near_duplicates(docs, id_col, text_col).where("doc_id <> component_id").select("doc_id")
    return drop_ids(docs, gone, id_col)
