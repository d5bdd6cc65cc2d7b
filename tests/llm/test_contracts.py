"""Each registered query on a whole small table against its brute-force version."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from wayfault.llm import queries, toxicity


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def run(spark, sf, name):
    return queries.QUERIES[name](spark, sf)


def test_op1(spark, sf, docs):
    rows = {r.doc_id: r for r in run(spark, sf, "op1_quality_rules").collect()}
    assert set(rows) == set(docs)
    for i, text in docs.items():
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality_counts(text), i
        assert not (r.base_failed and r.kept)
        assert r.kept == (not r.base_failed and r.rule is None)


def test_op3(spark, sf, docs):
    rows = run(spark, sf, "op3_exact_dedup").collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows} == brute.exact_groups(docs.items())
    assert all(r.kept == (r.doc_id == r.keep_id) for r in rows) and len(rows) == len(docs)


def test_op4(spark, sf, docs):
    rows = [tuple(r) for r in run(spark, sf, "op4_packing").collect()]
    n = brute.check_packing(rows, docs)
    least = math.ceil(sum(r[3] for r in rows) / 2048)
    assert least <= n <= least * 1.05 + 1


def test_op5(spark, sf, docs):
    rows = {r.doc_id: r for r in run(spark, sf, "op5_simhash").collect()}
    ids = sorted(docs)
    fps = [brute.fingerprint(docs[i]) for i in ids]
    for i, fp, c in zip(ids, fps, brute.components(fps, ids), strict=True):
        assert (rows[i].fingerprint, rows[i].component_id) == (f"{fp:016x}", c)


def test_op6(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = run(spark, sf, "op6_url_filter").collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == {i: brute.judge_url(u) for i, u in pages.items()}
    assert len(rows) == len(pages)


def test_op7(spark, sf, docs):
    rows = run(spark, sf, "op7_sharding").collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    slots, where = defaultdict(list), defaultdict(Counter)
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
        slots[r.shard].append(r.slot)
        where[docs[r.doc_id]][r.shard] += 1
    sizes = [len(slots[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    together = sum(len(c) == 1 for c in where.values() if c.total() > 1)
    assert together >= 0.9 * sum(c.total() > 1 for c in where.values())


def test_op10(spark, sf, docs):
    rows = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, sf, "op10_bpe").collect()}
    assert rows == dict(zip(docs, brute.token_digests(docs.values()), strict=True))


def test_op9(spark, sf, docs):
    """Every document once; the flag, and predictions from scores; labels of held-out rows have no influence."""
    rows = run(spark, sf, "op9_toxicity").collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    table, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    texts, y = toxicity.sample_rows(table, labels)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again, same = toxicity.sample_rows(table, turned)
    assert texts == again and y.tolist() == same.tolist()
    assert len(y) == sum(zlib.crc32(str(r.doc_id).encode()) % 5 != 0 for r in labels.collect())
