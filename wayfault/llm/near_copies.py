"""Near copies by SimHash: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Fingerprints of sets at 0.8 differ in 15 % of their bits (acos(2 J / (1 + J)) / pi), in up to 14 bits of 64.  Segments of 64 bits that
are sure to hold one with at most one differing bit would have 8 bits, and each value would hold a fixed share of all documents.  So the
fingerprint is wider, and is cut into ``SEGMENTS`` segments of ``WIDTH`` = 20 bits.  One segment differs by at most one bit with
a probability of 0.17 at 0.8, and none of 38 does with one of 0.0008; unrelated texts meet in one pair of 50,000 a segment.

Index and equality join: a segment with one bit too many or too few still agrees in one of its halves, so rows are dealt by each half, and within that
bucket the one-wildcard variants of the other half are joined by equality.  So 2 rows a segment are moved, not one for each variant.  Members of a
run of equal variants that are near in 256 bits of the fingerprint (unrelated texts never are) are candidates of each other.

Nothing ever lists the pairs of a group.  A bucket gives a forest that connects its candidates, so what it emits grows with its members; the forests of all buckets
make *families*, outside of which there are no candidates.  The sets of shingles of a family's members then meet in one task, or, if there are more than ``BLOCK`` of them or ``BLOCK_BYTES``,
in one for each pair of its blocks, where all pairs are decided exactly (intersections of all pairs are a product of matrices), and leave a forest of links again.
Equal sets are one class, so copies are not indexed twice.

A task holds one bucket: a 1024th of the texts for each half of a segment, 48 bytes each.  A run is connected whole, whatever its size: each member reached is compared
with all that are not reached yet, ``HELD`` of them at a time.

Defined results: a null text counts as empty; texts without words are equal; a text of up to five words is one shingle; rows without an id
take part but name no component and stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfault.llm.common import as_bytes, drop_ids, id_and_text, lookup, map_arrow, materialise, materialise_dealt, mix64
from wayfault.llm.components import components, components_named, roots
from wayfault.llm.simhash import LINK_ROWS, SEED, shingle_hashes

WORDS = 5
FIFTHS = 4  # similarity of at least 4 / 5
LANES = 12  # of 64 bits
SEGMENTS, WIDTH = 38, 20
HALF = WIDTH // 2
NEAR_LANES, NEAR = 4, 68  # differing bits of 256; 39 are expected at 0.8, with a deviation of 6, and 128 of unrelated texts, with one of 8
SMALL = 16
HELD = 1 << 20
BLOCK, BLOCK_BYTES = 1024, 16 << 20
COLUMNS = 2048  # of a matrix
FEW = 24
_LANES = mix64(np.arange(1, LANES + 1, dtype=np.uint64))
_TIES = np.unpackbits(mix64(_LANES).view(np.uint8)).astype(bool)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    return np.unique(np.frombuffer(shingle_hashes(text, WORDS), ">u8").astype(np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """Bit by bit the majority over the hashes, each of ``LANES`` x 64 bits; a fixed bit where there is none."""
    ones = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(hashes), 255):  # a block's sums fit a byte
        lanes = mix64(hashes[at : at + 255, None] ^ _LANES)
        ones += np.add.reduce(np.unpackbits(lanes.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones + _TIES > len(hashes)).tobytes()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= FIFTHS * (len(a) + len(b) - both)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t) for t in as_bytes(batch.column(1))]
        ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        fps = pa.array([wide_fingerprint(s) if len(s) else None for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids), fps], ["doc_id", "text", "cls", "fp"])


POSTING = "bucket int, other int, id long, " + ", ".join(f"f{k} long" for k in range(NEAR_LANES))


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class under both halves of each segment, with the other half and 256 bits of the fingerprint."""
    power = 1 << np.arange(HALF)
    names = [c.split()[0] for c in POSTING.split(", ")]
    for batch in batches:
        if not batch.num_rows:
            continue
        data = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        halves = np.unpackbits(data, axis=1)[:, : SEGMENTS * WIDTH].reshape(len(data), 2 * SEGMENTS, HALF) @ power
        lanes = np.ascontiguousarray(data[:, : 8 * NEAR_LANES]).view(np.int64)
        other = halves.reshape(len(data), SEGMENTS, 2)[:, :, ::-1].reshape(len(data), -1)
        bucket = halves + (np.arange(2 * SEGMENTS) << HALF)
        each = lambda v: np.repeat(v, 2 * SEGMENTS)
        columns = [bucket.ravel().astype(np.int32), other.ravel().astype(np.int32), each(np.asarray(batch.column(0))), *(each(lanes[:, k]) for k in range(NEAR_LANES))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def near(fps: np.ndarray, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
    """Whether members (rows of ``fps``) may be similar."""
    return np.bitwise_count(fps[i] ^ fps[j]).sum(axis=-1, dtype=np.int32) <= NEAR


def run_forest(fps: np.ndarray, run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect the members of a run exactly as being near does: each member reached claims those near to it that are not reached yet."""
    left, queue = run, []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        found = np.concatenate([left[:0] > 0, *(near(fps, at, left[k : k + HELD]) for k in range(0, len(left), HELD))])
        if found.any():
            yield np.full(int(found.sum()), at), left[found]
            queue += left[found].tolist()
            left = left[~found]


def bucket_forest(bucket: np.ndarray, other: np.ndarray, ids: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between candidates of whole buckets, by the one-wildcard variants of the other half."""
    us, vs = [ids[:0]], [ids[:0]]
    for bit in range(HALF):
        key = (bucket.astype(np.int64) << HALF) | (other & ~(1 << bit))
        order = np.argsort(key, kind="stable")
        key = key[order]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([cut, [len(key)]]))
        follow = np.repeat(cut + size - 1, size) - np.arange(len(key))  # how many members of its run come after each
        follow[np.repeat(size > SMALL, size)] = 0
        at, step = np.flatnonzero(follow >= 1), 1
        while len(at):
            i, j = order[at], order[at + step]
            ok = near(fps, i, j)
            us.append(ids[i[ok]])
            vs.append(ids[j[ok]])
            step += 1
            at = at[follow[at] >= step]
        for start, n in zip(cut[size > SMALL], size[size > SMALL], strict=True):
            for i, j in run_forest(fps, order[start : start + n]):
                us.append(ids[i])
                vs.append(ids[j])
    return np.concatenate(us), np.concatenate(vs)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets come one after the other; ``u, v`` connect their candidates, contracted to a star for each group."""
    held: list[list[np.ndarray]] = []
    us, vs, rows = [], [], 0

    def contracted() -> pa.RecordBatch:
        node, root = roots(np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2
        us.clear()
        vs.clear()
        return pa.RecordBatch.from_arrays([pa.array(node[node != root]), pa.array(root[node != root])], ["u", "v"])

    def settle(columns: list[np.ndarray]) -> None:
        u, v = bucket_forest(columns[0], columns[1], columns[2], np.stack(columns[3:], 1).view(np.uint64))
        us.append(u)
        vs.append(v)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([np.asarray(c) for c in batch.columns])
        rows += batch.num_rows
        if rows < 4 * LINK_ROWS:
            continue
        columns = [np.concatenate([h[k] for h in held]) for k in range(len(held[0]))]
        whole = int(np.searchsorted(columns[0], columns[0][-1]))
        if whole:
            settle([c[:whole] for c in columns])
            columns = [c[whole:] for c in columns]
        held, rows = [columns], len(columns[0])
        if sum(map(len, us)) >= HELD:
            yield contracted()
    if rows:
        settle([np.concatenate([h[k] for h in held]) for k in range(len(held[0]))])
    yield contracted()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``cls, hashes``: the sets of shingles."""
    for batch in batches:
        made = [shingle_set(t).tobytes() for t in as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["cls", "hashes"])


def similar_pairs(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the similar sets among ``a``, or of those of ``a`` and ``b`` that are similar to each other."""
    both = a if b is None else a + b
    if len(both) <= FEW:
        found = [(i, j) for i in range(len(a)) for j in range(*((i + 1, len(a)) if b is None else (0, len(b)))) if similar(a[i], (a if b is None else b)[j])]
        return tuple(np.array(found, np.int64).reshape(-1, 2).T)
    size = np.array([len(x) for x in both])
    owner, flat = np.repeat(np.arange(len(both)), size), np.concatenate(both)
    _, word, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[word] > 1  # what one set alone has is in no intersection
    owner, word = owner[shared], np.unique(word[shared], return_inverse=True)[1]
    order = np.argsort(word, kind="stable")
    owner, word = owner[order], word[order]
    inter = np.zeros((len(a), len(a if b is None else b)), np.float32)  # counts are exact below 2 ** 24
    for low in range(0, int(word[-1]) + 1 if len(word) else 0, COLUMNS):
        part = slice(*np.searchsorted(word, [low, low + COLUMNS]))
        m = np.zeros((len(both), COLUMNS), np.float32)
        m[owner[part], word[part] - low] = 1
        inter += m[: len(a)] @ (m if b is None else m[len(a) :]).T
    sizes = size[: len(a), None] + (size if b is None else size[len(a) :])[None]
    i, j = np.nonzero(5 * inter >= FIFTHS * (sizes - inter))
    return (i[i < j], j[i < j]) if b is None else (i, j)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``family, low, high, block, cls, hashes`` of pairs of blocks that come one after the other; ``u, v`` connect exactly what similar sets connect."""
    key, held = None, []

    def settle() -> pa.RecordBatch | None:
        first = [r for r in held if r[0] == key[1]]
        second = [r for r in held if r[0] == key[2]] if key[1] != key[2] else None
        read = lambda rows: [np.frombuffer(r[2], np.uint64) for r in rows]
        i, j = similar_pairs(read(first), read(second) if second is not None else None)
        if not len(i):
            return None
        ids, others = (np.array([r[1] for r in x], np.int64) for x in (first, first if second is None else second))
        node, root = roots(ids[i], others[j])
        return pa.RecordBatch.from_arrays([pa.array(node[node != root]), pa.array(root[node != root])], ["u", "v"])

    for batch in batches:
        for *here, block, cls, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if here != key:
                if len(held) > 1 and (made := settle()) is not None:
                    yield made
                key, held = here, []
            held.append((block, cls, hashes))
    if len(held) > 1 and (made := settle()) is not None:
        yield made


def families(classes: DataFrame) -> DataFrame:
    """``cls, family`` of the classes that are a candidate of another; similar classes are of one family."""
    postings = map_arrow(classes.where("fp is not null").select("cls", "fp"), _post, POSTING)
    dealt = postings.repartition("bucket").sortWithinPartitions("bucket", "id")
    stars = components(materialise_dealt(map_arrow(dealt, _candidates, "u long, v long", LINK_ROWS), "candidates"))
    return stars.select(F.col("u").alias("cls"), F.col("root").alias("family")).unionByName(stars.select(F.col("root").alias("cls"), F.col("root").alias("family")).distinct())


def links(rows: DataFrame, classes: DataFrame, n_rows: int) -> DataFrame:
    """``u, v`` that connect exactly the classes that similar ones connect."""
    members = materialise(families(classes), "families", n_rows)
    texts = rows.select("cls", "text").join(members.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.first("text").alias("text"))
    sets = materialise(map_arrow(texts, _sets, "cls long, hashes binary").join(members, "cls"), "sets")
    sizes = sets.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("hashes").cast("long")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    sizes = materialise(sizes.select("family", "n", blocks.alias("blocks")), "sizes", n_rows)
    dealt = lookup(sets, sizes, "family", "n", n_rows).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.select("family", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "cls", "hashes")
    return materialise_dealt(map_arrow(pairs.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high"), _decide, "u long, v long"), "links")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` of every row; a component is named by its smallest id."""
    source = id_and_text(docs, id_col, text_col)
    rows = materialise(map_arrow(source, _sketch, "doc_id long, text string, cls long, fp binary"), "sketches")
    n_rows = rows.count()
    classes = rows.groupBy("cls").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("fp").alias("fp"))
    classes = materialise(classes, "classes")
    stars = components(links(rows, classes, n_rows))
    named = components_named(classes.select("cls", "least", "n"), stars, "cls", n_rows)
    return lookup(rows.select("doc_id", "cls"), named, "cls", "n", n_rows).select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names their component, with all their columns; rows without an id stay."""
    return drop_ids(docs, near_copies(docs, id_col, text_col).where("doc_id <> component_id").select("doc_id"), id_col)
