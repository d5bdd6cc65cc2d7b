"""Near copies against brute-force Jaccard similarity."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tests.llm import brute
from wayfault.llm import near_copies


def shingles(text):
    words = brute.WORD.findall(brute.lower(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def least_ids(rows):
    """The smallest id of the component of each row."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in brute.all_pairs(len(rows)):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return [least.get(find(n)) for n in range(len(rows))]


def edited(rng, words, n):
    """``words`` with ``n`` of them exchanged."""
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"x{rng.randrange(10**9)}"
    return words


def corpus():
    """Pairs around 0.8; a large group about one text, one that is a chain, and one in which few are similar; awkward rows."""
    rng, texts = random.Random(4), []
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    for n in range(120):
        base = fresh(rng.randrange(60, 200))
        texts += [base, edited(rng, base, 1 + n % 6)]
    base = fresh(150)
    texts += [edited(rng, base, rng.randrange(1, 5)) for _ in range(70)]
    for _ in range(70):
        base = edited(rng, base, 2)
        texts.append(base)
    texts += [edited(rng, base[:100], 2 + n % 3) for n in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, (900, None), (901, " \n "), (902, "one two"), (903, "ONE  two"), (None, "one two"), (None, rows[0][1]), (904, rows[1][1].upper())]


def test_near_copies(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], "doc_id long, text string, cls string, keys string").repartition(5)
    want = least_ids(rows)
    got = near_copies.near_copies(df).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, c)) for (i, _), c in zip(rows, want, strict=True))
    kept = corpus_pipeline.drop_near_copies(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(i) for (i, _), c in zip(rows, want, strict=True) if i is None or i == c)
    assert near_copies.near_copies(df.limit(0)).collect() == []


def test_no_pair_of_the_given_documents_is_missed(spark):
    """Recall at 0.8 on real texts: components equal those of all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == {i: c for (i, _), c in zip(rows, least_ids(rows), strict=True)}


def test_families_in_blocks(spark, monkeypatch):
    """A family of more members than a block holds is decided by pairs of blocks, with the same links."""
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(repr((i, c)) for (i, _), c in zip(rows, least_ids(rows), strict=True))
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    assert sorted(map(repr, map(tuple, near_copies.near_copies(df).collect()))) == want


@pytest.mark.parametrize("seed", range(4))
def test_similar_pairs_by_matrices(seed):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 2**63, 90).astype(np.uint64) for _ in range(4)]
    sets = []
    for n in range(60):
        words = base[n % 4].copy()
        words[rng.choice(90, rng.integers(0, 20), replace=False)] = rng.integers(0, 2**63, 1)[0]
        sets.append(np.unique(words))
    want = {(i, j) for i, j in brute.all_pairs(60) if near_copies.similar(sets[i], sets[j])}
    assert {(int(i), int(j)) for i, j in zip(*near_copies.similar_pairs(sets), strict=True)} == want
    a, b = sets[:35], sets[35:]
    cross = {(int(i), int(j) + 35) for i, j in zip(*near_copies.similar_pairs(a, b), strict=True)}
    assert cross == {(i, j) for i, j in want if i < 35 <= j} and len(want) > 100


def test_forests_connect_what_is_near(monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, (5, 4)).astype(np.uint64)
    fps = np.array([centres[rng.integers(0, 5)] ^ np.uint64(1) << rng.integers(0, 60, 4).astype(np.uint64) for _ in range(80)])
    fps[40:50] = rng.integers(0, 2**63, (10, 4)).astype(np.uint64)
    edges = [(int(i), int(j)) for us, vs in near_copies.run_forest(fps, np.arange(80)) for i, j in zip(us, vs, strict=True)]
    pairs = [(i, j) for i, j in brute.all_pairs(80) if near_copies.near(fps, i, np.array([j]))[0]]
    groups = lambda es: [set(map(int, np.flatnonzero(lab == r))) for lab in [labels(80, es)] for r in np.unique(lab)]
    assert sorted(map(sorted, groups(edges))) == sorted(map(sorted, groups(pairs))) and len(edges) < 80


def labels(n, edges):
    lab = np.arange(n)
    for _ in range(n):
        for i, j in edges:
            lab[[i, j]] = min(lab[i], lab[j])
    return lab
