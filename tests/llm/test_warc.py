"""Archives, their index, and the loser tree."""

import hashlib
import random

import pytest

from wayfault.llm import storage, warc


@pytest.mark.parametrize("sizes", [[], [0], [3], [5, 0, 1], [1] * 7, [40, 3, 0, 17, 9]])
def test_loser_tree(sizes):
    rng = random.Random(3)
    runs = [sorted((b"%03d" % rng.randrange(30), (i, j)) for j in range(n)) for i, n in enumerate(sizes)]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted((x for r in runs for x in r), key=lambda x: (x[0], x[1][0]))


def history(spark, rows, folder=None):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive string, row string")
    return warc.capture_history(pages, folder).collect()


def test_revisits_ties_and_nulls(spark):
    long, short = "x" * 999 + "é", "y" * 999
    rows = [
        (1, "http://b.org/a", long), (2, "http://a.org/", long), (3, None, long), (3, None, long), (4, "http://a.org/z", short), (5, "http://a.org/z", short),
        (6, "no scheme\r\nat all", None), (None, "http://a.org/", long), (7, "http://x.a.org/?q", "z" * 300_000), (8, "", ""),
    ]
    got = history(spark, [(*r, "clash", "clash") for r in rows])
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.page_id, []).append(r)
    html = {i: (h or "").encode() for i, _, h in rows}
    for i, rs in by_id.items():
        assert all((r.payload_bytes, r.payload_digest) == (len(html[i]), hashlib.sha1(html[i]).hexdigest()) for r in rs)
    assert sorted(r.record_type for r in by_id[3]) == ["response", "revisit"]
    assert all(r.record_type == "revisit" and r.refers_to == 3 for i in (1, 2, None) for r in by_id[i])
    assert all(r.record_type == "response" and r.refers_to is None for i in (4, 5, 6, 7, 8) for r in by_id[i])
    keys = [(r.url_key.encode(), r.timestamp) for r in got]
    assert keys == sorted(keys)
    assert by_id[7][0].url_key == "org,a,x)/?q"


def test_records_can_be_read_by_offset(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    for r in history(spark, [(i, f"http://h{i % 7}.com/{i}", f"<p>{i}</p>", None, None) for i in range(50)], folder):
        with storage.reader(folder, r.archive) as f:
            f.seek(r.offset)
            member = f.read(r.length)
        ((_, _, content),) = list(warc.members(__import__("io").BytesIO(member)))
        fields, _, payload = warc.parse(content)
        assert (fields["Capture-Id"], payload) == (str(r.page_id), f"<p>{r.page_id}</p>".encode())


def test_many_runs_and_ranges(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/runs"
    monkeypatch.setattr(warc, "FAN_IN", 4)
    monkeypatch.setattr(warc, "RANGE_ROWS", 3000)
    rng, all_, rows = random.Random(1), [], []
    for n in range(11):
        entries = [(f"k{rng.randrange(500):03d}", "20200101000000", rng.randrange(10**6), "u", 1, "d", "response", None, f"a{n}", i, 1) for i in range(rng.randrange(2500))]
        out = warc.RunWriter(folder, f"run-{n:02d}.parquet")
        for key, e in sorted((warc.sort_key(e), e) for e in entries):
            out.add(key, e)
        all_ += entries
        rows.append(out.close())
    runs = spark.createDataFrame([(a, b, [bytearray(k) for k in c]) for a, b, c in rows], warc.RUNS)
    merged = warc.merge(runs, folder)
    assert merged.rdd.getNumPartitions() > 1
    assert [tuple(r) for r in merged.collect()] == sorted(all_, key=warc.sort_key)


def test_revisits_name_their_response(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    rows = [(i, f"http://h{i}.com/", "same " * 300 if i % 2 else f"own {i} " * 300, None, None) for i in range(9)]
    heads = {}
    for r in history(spark, rows, folder):
        with storage.reader(folder, r.archive) as f:
            f.seek(r.offset)
            ((_, _, content),) = list(warc.members(__import__("io").BytesIO(f.read(r.length))))
        heads[r.page_id] = warc.parse(content)[0]
    assert heads[7]["WARC-Type"] == "response"
    for i in (1, 3, 5):
        assert heads[i]["WARC-Refers-To"] == heads[7]["WARC-Record-ID"] and heads[i]["WARC-Refers-To-Target-URI"] == "http://h7.com/" and heads[i]["WARC-Refers-To-Date"] == heads[7]["WARC-Date"]


def test_empty(spark):
    assert history(spark, []) == []


def test_damage_is_seen():
    made = warc.record("response", 1, "http://a/", warc.EPOCH, b"abc", hashlib.sha1(b"abc").digest(), None)
    with pytest.raises(ValueError, match="length"):
        warc.parse(made[:-6])
