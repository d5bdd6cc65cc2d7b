"""WARC archives of captures, with revisit records, and their index merged by loser trees.

Writing: equal payloads of at least ``MIN_REVISIT`` bytes are stored once, in the response of the largest id; the others become revisit
records that name it.  Each task writes its own archives (gzip, a member per record) to the shared folder under a
name of its attempt; only archives of tasks that ended are listed, so a repeated task does no harm.

Reading and indexing: each task reads whole archives, digests the payloads, and writes one run, sorted locally by
url key (reversed host and path) and timestamp.  External merge: the key space is divided at sampled keys, and
each task merges its interval of all runs through a loser tree, holding one batch per run.  Where there are more than ``FAN_IN``
runs, groups of them are first merged into longer runs.  The partitions of the result, one after the
other, are the globally ordered capture history.

Captures are written with row numbers first.  Moved in shuffles: digests and what is decided on them; payloads never are, as decisions are written by the part of the
captures that they are about, and the task that reads a part reads its decisions.

Defined results: a null payload is empty; a null url has no target and an empty key; a capture without an id is written, ranks below
others, and is referred to by no id; of repeated rows one is the response; an empty table gives no archives and no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfault.llm import storage
from wayfault.llm.common import PART_BITS, as_bytes, by_part, lookup, map_arrow, materialise, numbered_rows, part_of, place, positional, scratch_path

MIN_REVISIT = 1000
ARCHIVE_BYTES = 1 << 30
RUN_ROWS = 1 << 18
RANGE_ROWS = 1 << 16
FAN_IN = 256
SAMPLES = 20_000
ROW_GROUP = 4096
EPOCH = datetime(2000, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HISTORY = "url_key string, timestamp string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
NAMES = [f.split()[0] for f in HISTORY.split(", ")]


# -- records
def header_value(value: str) -> str:
    """A value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_id(page_id: int | None, url: str | None, when: datetime, digest: bytes) -> str:
    name = hashlib.sha1(repr((page_id, url, when)).encode() + digest).hexdigest()
    return f"<urn:uuid:{name[:8]}-{name[8:12]}-5{name[13:16]}-a{name[17:20]}-{name[20:32]}>"


def record(kind: str, page_id: int | None, url: str | None, when: datetime, payload: bytes, digest: bytes, refers_to: int | None = None, refers_url: str | None = None, refers_when: datetime | None = None) -> bytes:
    """A WARC/1.1 record; a revisit keeps the HTTP head only, whose Content-Length is that of the full payload."""
    stamp = lambda t: t.strftime("%Y-%m-%dT%H:%M:%SZ")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(page_id, url, when, digest),
        "WARC-Date": stamp(when),
        "WARC-Target-URI": None if url is None else header_value(url),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(digest).decode(),
        "WARC-Profile": PROFILE if kind == "revisit" else None,
        "WARC-Refers-To": record_id(refers_to, refers_url, refers_when, digest) if refers_when else None,
        "WARC-Refers-To-Target-URI": None if refers_url is None else header_value(refers_url),
        "WARC-Refers-To-Date": stamp(refers_when) if refers_when else None,
        "Capture-Id": page_id,
        "Refers-To-Capture-Id": refers_to,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head.items() if v is not None), "\r\n"]).encode() + block + b"\r\n\r\n"


def members(stream, chunk: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member."""
    offset, held = 0, b""
    while held or (held := stream.read(chunk)):
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while True:
            parts.append(unpack.decompress(held))
            if unpack.eof:
                used += len(held) - len(unpack.unused_data)
                held = unpack.unused_data
                break
            used += len(held)
            if not (held := stream.read(chunk)):
                raise ValueError(f"the archive ends within the record at {offset}")
        yield offset, used, b"".join(parts)
        offset += used


def parse(content: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of a record, headers of the HTTP response in it, and the payload."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise ValueError("a record's length is not what it says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode("utf-8").split("\r\n")[1:]), payload


# -- writing
def revisits(captures: DataFrame) -> DataFrame:
    """``part, row, response_id, response_url, response_seconds`` of the captures whose payload another one of the same payload is the response of.

    Payloads are told apart by SHA-256, whatever digest the records carry.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keys = captures.where(F.octet_length(payload) >= MIN_REVISIT).select("row", F.unhex(F.sha2(payload, 256)).alias("digest"), "page_id", "url", "seconds")
    keys = materialise(keys, "digests")
    best = keys.groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    best = materialise(best.select("digest", F.col("best.row").alias("response_row"), "n"), "equal")
    chosen = keys.join(best.select(F.col("response_row").alias("row")), "row", "left_semi")
    told = chosen.select("digest", F.col("row").alias("response_row"), F.col("page_id").alias("response_id"), F.col("url").alias("response_url"), F.col("seconds").alias("response_seconds"))
    told = materialise(told.join(best.select("digest", "n"), "digest"), "responses")
    found = lookup(keys.select("digest", "row"), told, "digest", "n", keys.count()).where("row <> response_row")
    return found.select(part_of("row").alias("part"), "row", "response_id", "response_url", "response_seconds")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> DataFrame:
    """Write the archives to ``folder``; ``archive, records`` of each.

    ``time_col``: seconds since 1970 of each capture; without it a capture's time is its id in seconds after the year 2000 began.
    Captures are written with row numbers first; which of them are revisits is decided on digests and brought to the tasks that write them.
    """
    own = positional(pages)
    col = lambda c: F.col(place(pages, c))
    when = col(time_col).cast("long") if time_col else F.lit(int(EPOCH.timestamp())) + F.pmod(F.coalesce(col(id_col).cast("long"), F.lit(0)), F.lit(10**9))
    captures = own.select(col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url"), col(html_col).cast("string").alias("html"), when.alias("seconds"))
    captures = numbered_rows(captures, "captures")
    decided = by_part(revisits(captures), "revisits", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out, name, size, count, number = None, "", 0, 0, 0
        done: list[tuple[str, int]] = []
        at_hand = Revisits(decided)
        for batch in batches:
            column = {n: batch.column(i).to_pylist() for i, n in enumerate(["page_id", "url", None, "seconds", "row"]) if n}
            for i, payload in enumerate(as_bytes(batch.column(2))):
                if out is None:
                    name = f"capture-{task.partitionId():06d}-{task.taskAttemptId():08d}-{number:04d}.warc.gz"
                    out, size, count, number = storage.writer(folder, name), 0, 0, number + 1
                found = at_hand.of(column["row"][i])
                when = datetime.fromtimestamp(column["seconds"][i] or 0, UTC)
                made = record("response" if found is None else "revisit", column["page_id"][i], column["url"][i], when, payload, hashlib.sha1(payload).digest(), *(found or ()))
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = pack.compress(made) + pack.flush()
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, count))
                    out = None
        if out is not None:
            out.close()
            done.append((name, count))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["archive", "records"])

    return materialise(map_arrow(captures.select("page_id", "url", "html", "seconds", "row"), run, "archive string, records long"), "archives")


class Revisits:
    """The decisions for the rows that a task reads, one part of the captures at a time; three numbers and a url a revisit."""

    def __init__(self, folder: str):
        self.folder, self.part = folder, None

    def of(self, row: int) -> tuple | None:
        """Id, url and time of the response of a revisit; None for a response."""
        if row >> PART_BITS != self.part:
            self.part = row >> PART_BITS
            self.table = storage.read_part(self.folder, self.part)
            self.rows = np.zeros(0, np.int64) if self.table is None else self.table.column("row").to_numpy()
        at = int(np.searchsorted(self.rows, row))
        if at == len(self.rows) or self.rows[at] != row:
            return None
        page, url, seconds = (self.table.column(c)[at].as_py() for c in ("response_id", "response_url", "response_seconds"))
        return page, url, datetime.fromtimestamp(seconds or 0, UTC)


# -- indexing
def url_key(url: str | None) -> str:
    """Reversed host and the rest, so that a host's captures and its subdomains' lie together."""
    if not url:
        return ""
    rest = header_value(url).split("://", 1)[-1]
    host, cut = rest, ""
    for i, c in enumerate(rest):
        if c in "/?#":
            host, cut = rest[:i], rest[i:]
            break
    return ",".join(reversed(host.lower().split("."))) + ")" + cut


def sort_key(entry: tuple) -> bytes:
    """Bytes that order entries by url key, timestamp, id and place."""
    key, stamp, page, *_, archive, offset, _ = entry
    return b"\x00".join([key.encode(), stamp.encode(), b"" if page is None else b"%020d" % (page + 2**63), archive.encode(), b"%020d" % offset])


def entries(folder: str, archive: str) -> Iterator[tuple]:
    """``HISTORY`` rows of an archive, read in one sequential pass."""
    with storage.reader(folder, archive) as stream:
        for offset, length, content in members(stream):
            fields, http, payload = parse(content)
            digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
            kind = fields["WARC-Type"]
            if kind == "response" and hashlib.sha1(payload).digest() != digest:
                raise ValueError(f"the payload at {offset} of {archive} is damaged")
            url, page, target = fields.get("WARC-Target-URI"), fields.get("Capture-Id"), fields.get("Refers-To-Capture-Id")
            stamp = "".join(c for c in fields["WARC-Date"] if c.isdigit())
            yield url_key(url), stamp, None if page is None else int(page), url, int(http["Content-Length"]), digest.hex(), kind, None if target is None else int(target), archive, offset, length


SCHEMA = pa.schema([("sort_key", pa.binary()), *[(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in HISTORY.split(", ")]])


class RunWriter:
    """Writes sorted entries to a run in small row groups and keeps the key of every 1024th."""

    def __init__(self, folder: str, name: str):
        self.name, self.file = name, storage.writer(folder, name)
        self.out, self.rows, self.held, self.keys = pq.ParquetWriter(self.file, SCHEMA, compression="zstd"), 0, [], []

    def add(self, key: bytes, entry: tuple) -> None:
        if self.rows % 1024 == 0:
            self.keys.append(key)
        self.rows += 1
        self.held.append((key, *entry))
        if len(self.held) >= ROW_GROUP:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.out.write_table(pa.table([pa.array(c, f.type) for c, f in zip(zip(*self.held, strict=True), SCHEMA, strict=True)], schema=SCHEMA))
            self.held = []

    def close(self) -> tuple[str, int, list[bytes]]:
        self.flush()
        self.out.close()
        self.file.close()
        return self.name, self.rows, self.keys


RUNS = "run string, records long, keys array<binary>"


def _run_rows(done: list[tuple[str, int, list[bytes]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.list_(pa.binary()))], ["run", "records", "keys"])


def index_runs(archives: DataFrame, folder: str) -> DataFrame:
    """Read the archives, each whole in one task, and write locally sorted runs; columns ``RUNS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, held = TaskContext.get(), [], []

        def spill() -> None:
            if held:
                out = RunWriter(folder, f"run-{task.partitionId():06d}-{task.taskAttemptId():08d}-{len(done):04d}.parquet")
                for key, entry in sorted(held, key=lambda x: x[0]):
                    out.add(key, entry)
                done.append(out.close())
                held.clear()

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                for entry in entries(folder, archive):
                    held.append((sort_key(entry), entry))
                    if len(held) >= RUN_ROWS:
                        spill()
        spill()
        yield _run_rows(done)

    n = max(1, archives.count())
    return materialise(map_arrow(archives.select("archive").repartition(n), run, RUNS), "runs")


# -- merging
class LoserTree:
    """Merges k sorted iterators of (key, value); each step replays one path of losers from leaf to root."""

    def __init__(self, sources: list[Iterator[tuple[bytes, tuple]]]):
        self.sources, self.k = sources, len(sources)
        self.heads = [next(s, None) for s in sources]
        self.losers = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self.replay(leaf, first=True)

    def wins(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x[0], a) < (y[0], b))

    def replay(self, leaf: int, first: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.losers[node] == -1 and first:  # wait here for the opponent
                self.losers[node] = winner
                return
            if not self.wins(winner, self.losers[node]):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple[bytes, tuple]]:
        while self.k:
            leaf = self.losers[0]
            head = self.heads[leaf]
            if head is None:
                return
            yield head
            self.heads[leaf] = next(self.sources[leaf], None)
            self.replay(leaf)


def run_slice(folder: str, name: str, low: bytes | None, high: bytes | None) -> Iterator[tuple[bytes, tuple]]:
    """Entries of a run from key ``low`` up to, not including, ``high``; row groups outside are not read."""
    with storage.reader(folder, name) as stream:
        file = pq.ParquetFile(stream)
        for g in range(file.num_row_groups):
            span = file.metadata.row_group(g).column(0).statistics
            if span is not None and span.has_min_max:
                if low is not None and span.max < low:
                    continue
                if high is not None and span.min >= high:
                    return
            columns = [c.to_pylist() for c in file.read_row_group(g).columns]
            for row in zip(*columns, strict=True):
                if (low is None or row[0] >= low) and (high is None or row[0] < high):
                    yield row[0], row[1:]


def shorten(runs: DataFrame, folder: str) -> DataFrame:
    """Merge groups of ``FAN_IN`` runs into longer ones until there are no more than that."""
    level = 0
    while (n := runs.count()) > FAN_IN:
        level += 1
        # a row for each run, so one task can order them
        groups = runs.select("run", F.floor(F.percent_rank().over(Window.orderBy("run")) * (n - 1) / FAN_IN).cast("int").alias("grp"))

        prefix = f"merged-{level:02d}"

        def run(table: pa.Table) -> pa.Table:
            task = TaskContext.get()
            out = RunWriter(folder, f"{prefix}-{table.column('grp')[0].as_py():06d}-{task.taskAttemptId():08d}.parquet")
            for key, entry in LoserTree([run_slice(folder, name, None, None) for name in sorted(table.column("run").to_pylist())]):
                out.add(key, entry)
            return pa.Table.from_batches([_run_rows([out.close()])])

        runs = materialise(groups.groupBy("grp").applyInArrow(run, RUNS), "runs")
    return runs


def merge(runs: DataFrame, folder: str) -> DataFrame:
    """The capture history, columns ``HISTORY``; partition after partition in order of url key and timestamp."""
    spark = runs.sparkSession
    runs = shorten(runs, folder)
    listed = [(r.run, r.records) for r in runs.select("run", "records").orderBy("run").collect()]  # at most FAN_IN
    total = sum(n for _, n in listed)
    ranges = max(1, -(-total // RANGE_ROWS))
    sampled = runs.select(F.explode("keys").alias("key"))
    keys = sorted({bytes(r.key) for r in sampled.orderBy(F.xxhash64("key")).limit(SAMPLES).collect()}) if ranges > 1 else []
    bounds = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []
    edges = [None, *bounds, None]
    names = [name for name, _ in listed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                held: list[tuple] = []
                for _, entry in LoserTree([run_slice(folder, name, edges[i], edges[i + 1]) for name in names]):
                    held.append(entry)
                    if len(held) >= ROW_GROUP:
                        yield _history(held)
                        held = []
                if held:
                    yield _history(held)

    return spark.range(0, len(edges) - 1, 1, len(edges) - 1).mapInArrow(run, HISTORY)


def _history(rows: list[tuple]) -> pa.RecordBatch:
    fields = list(SCHEMA)[1:]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], NAMES)


def capture_history(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive ``pages`` in ``folder`` (by default a new one in the shared folder), read the archives back and merge their index."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    storage.make_folder(folder)
    return merge(index_runs(write(pages, folder, id_col, url_col, html_col), folder), folder)
