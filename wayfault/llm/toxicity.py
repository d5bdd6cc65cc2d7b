"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as a vector of two halves: an embedding of the word, for words that the training rows tell apart, and the mean of the
embeddings of its character 3- and 4-grams, so that unseen inflections of a word are recognised.  Both start from
smoothed log-odds and are trained with the rest.  Two GRUs read a window of ``WINDOW`` words in either direction; attention
weighs their states into one vector, which a logistic unit scores.  A text's score is the largest of all its
windows, which overlap by half and cover it whole.

Training sees at most ``PER_CLASS`` toxic rows and twice as many others, those with the smallest hash of the id; a positive text is learned from
the window that scores highest at the time, negatives from several of theirs.  The model is some hundred kB, whatever
the corpus.  Scoring is one pass without a shuffle; a window's words are looked up in a bounded cache of
projected word vectors.

Padding of short windows leaves the states as they are and has no weight in the attention.

Defined results: a null text and one without words get the share of toxic rows among those learned from, at most ``EMPTY``; a null label is no label; an id with several labels
counts as toxic if one of them is; rows without an id are scored, and are never held out; repeated rows score alike; without labels
of both classes, or without words, every score is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfault.llm.common import as_bytes, id_and_text, map_arrow, nullable, place, positional, release, restored

PER_CLASS = 1500
SAMPLE_BYTES = 64 << 20  # of text of each class
WINDOW = 32
STRIDE = 16
HIDDEN = 8
DIM = 6  # of each half
GRAM_BUCKETS = 1 << 14  # numbers of 16 bits
WORDS = 4096
EPOCHS = 8
BATCH = 256
MIN_STEPS = 800
BLOCK = 2048  # windows scored at once
CACHE_WORDS = 60_000
KNOWN = 50_000  # texts whose scores a task remembers
FOLDS = 5
SMOOTHING = 3
MIN_ROWS = 3
FEW = 40
EMPTY = 0.49


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5; such rows are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character 3- and 4-grams of the words, with marks at both ends, word by word; and how many each has."""
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    data = np.frombuffer(b"".join([b"\x02%b\x03" % w for w in words]), np.uint8).astype(np.uint32)
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(data))  # characters from here to the word's end
    found, owner = [], []
    of = np.repeat(np.arange(len(words)), lengths)
    for k in (3, 4):
        if len(data) < k:
            continue
        h = np.full(len(data) - k + 1, k, np.uint32)
        for j in range(k):
            h = (h ^ data[j : j + len(h)]) * np.uint32(0x01000193)
        h = (h ^ (h >> np.uint32(15))) % np.uint32(GRAM_BUCKETS)
        ok = left[: len(h)] >= k
        found.append(h[ok])
        owner.append(of[: len(h)][ok])
    buckets, owners = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return buckets[order].astype(np.int32), np.bincount(owners, minlength=len(words))


def all_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``grams`` of a vocabulary, in blocks, as small numbers: a model's training holds the buckets of all words that it sees."""
    parts = [grams(words[at : at + BLOCK]) for at in range(0, len(words), BLOCK)]
    if not parts:
        return np.zeros(0, np.uint16), np.zeros(0, np.int32)
    return np.concatenate([b.astype(np.uint16) for b, _ in parts]), np.concatenate([n.astype(np.int32) for _, n in parts])


def means(table: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.add.reduceat(table[buckets], starts, axis=0) / counts[:, None].astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def window_starts(n: int) -> np.ndarray:
    """Starts of the windows of a text of n words: every ``STRIDE`` words, the last one ending with the text."""
    return np.minimum(np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE), max(0, n - WINDOW))


@dataclass
class Model:
    words: dict[bytes, int] = field(default_factory=dict)
    p: dict[str, np.ndarray] = field(default_factory=dict)
    trained: bool = False
    empty: float = 0.0  # the logit of a text without words

    # -- inputs
    def vectors(self, words: list[bytes]) -> np.ndarray:
        """Input vectors of words, both halves."""
        if not words:
            return np.zeros((0, 2 * DIM), np.float32)
        ids = np.array([self.words.get(w, 0) for w in words])
        return np.concatenate([self.p["word"][ids], means(self.p["gram"], *grams(words))], axis=1).astype(np.float32)

    # -- network, on input vectors ``x`` of the distinct words and ``at`` (windows x words) numbers into them; 0 is padding
    def run(self, x: np.ndarray, at: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        return self.run_projected(self.project(x), at, keep)

    def project(self, x: np.ndarray) -> np.ndarray:
        """What the words add to the gates, in both directions."""
        return x @ self.p["w"] + self.p["b"][:, None]

    def run_projected(self, projected: np.ndarray, at: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of the windows.  Padding leaves a state as it is and has no weight; a window of padding has the logit ``bo``."""
        p, h2 = self.p, 2 * HIDDEN
        n, length = at.shape
        order = np.stack([at.T, at.T[::-1]])  # direction, step, window
        real = order > 0
        full = bool(real.all())
        gates = np.stack([projected[0][order[0]], projected[1][order[1]]])
        h = np.zeros((2, n, HIDDEN), np.float32)
        states, steps = np.empty((length, n, h2), np.float32), []
        for t in range(length):
            row, g = gates[:, t], h @ p["u"] + p["c"][:, None]
            zr = 1 / (1 + np.exp(-(row[..., :h2] + g[..., :h2])))
            r = zr[..., HIDDEN:]
            new = np.tanh(row[..., h2:] + r * g[..., h2:])
            move = 1 - zr[..., :HIDDEN]
            if not full:
                move = move * real[:, t, :, None]
            if keep:
                steps.append((h, zr, new, move, g[..., h2:]))
            h = h + move * (new - h)
            states[t, :, :HIDDEN] = h[0]
            states[length - 1 - t, :, HIDDEN:] = h[1]
        e = np.tanh(states @ p["wa"] + p["ba"])
        score = e @ p["va"]
        weight = np.exp(score - score.max(axis=0)) * real[0]
        weight /= np.maximum(weight.sum(axis=0), 1e-30)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        trace = {"steps": steps, "order": order, "real": real, "states": states, "e": e, "weight": weight, "pooled": pooled} if keep else {}
        return pooled @ p["wo"] + p["bo"][0], trace

    def gradients(self, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss, gradients of the weights, and of the input vectors."""
        p, h2 = self.p, 2 * HIDDEN
        logit, s = self.run(x, at, keep=True)
        prob = sigmoid(logit)
        n = len(y)
        loss = float(-np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)))
        dl = (prob - y) / n
        states, e, weight, real = s["states"], s["e"], s["weight"], s["real"]
        g = {"wo": s["pooled"].T @ dl, "bo": np.array([dl.sum()])}
        dpooled = dl[:, None] * p["wo"]
        dstates = weight[:, :, None] * dpooled[None]
        dw = np.einsum("nh,tnh->tn", dpooled, states)
        dscore = weight * (dw - (weight * dw).sum(axis=0))
        g["va"] = np.einsum("tn,tna->a", dscore, e)
        de = dscore[:, :, None] * p["va"] * (1 - e * e)
        g["wa"], g["ba"] = np.einsum("tnh,tna->ha", states, de), de.sum(axis=(0, 1))
        dstates += de @ p["wa"].T
        ds = np.stack([dstates[..., :HIDDEN], dstates[::-1, :, HIDDEN:]])
        dgates, dinner, before = (np.empty((2, *dstates.shape[:2], w), x.dtype) for w in (3 * HIDDEN, 3 * HIDDEN, HIDDEN))
        back = p["u"].transpose(0, 2, 1)
        dh = np.zeros((2, n, HIDDEN), x.dtype)
        for t in range(len(s["steps"]) - 1, -1, -1):
            h, zr, new, move, gn = s["steps"][t]
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            dh = dh + ds[:, t]
            dn = dh * move * (1 - new * new)
            dgates[:, t, :, :HIDDEN] = dh * (h - new) * z * (1 - z) * real[:, t, :, None]
            dgates[:, t, :, HIDDEN:h2] = dn * gn * r * (1 - r)
            dgates[:, t, :, h2:] = dn
            dinner[:, t, :, :h2] = dgates[:, t, :, :h2]
            dinner[:, t, :, h2:] = dn * r
            before[:, t] = h
            dh = dh * (1 - move) + dinner[:, t] @ back
        flat = lambda v: v.reshape(2, -1, v.shape[-1])
        g["u"], g["c"] = flat(before).transpose(0, 2, 1) @ flat(dinner), flat(dinner).sum(axis=1)
        dwords = np.stack([sums_by(s["order"][d].ravel(), flat(dgates)[d], len(x)) for d in (0, 1)])
        g["w"], g["b"] = x.T @ dwords, dwords.sum(axis=1)
        return loss, g, (dwords @ p["w"].transpose(0, 2, 1)).sum(axis=0)


def sums_by(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows of each index."""
    out, order = np.zeros((n, rows.shape[1]), rows.dtype), np.argsort(index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    out[index[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Scorer:
    """Scores texts with a model; keeps the projected vectors of up to ``CACHE_WORDS`` words."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {b"": 0}  # padding
        self.tables = np.zeros((2, CACHE_WORDS // 4, 3 * HIDDEN), np.float32)

    def add(self, words: list[bytes]) -> None:
        n, first = len(self.numbers), len(self.numbers) - len(words)
        if n > self.tables.shape[1]:
            more = np.zeros((2, max(n - self.tables.shape[1], self.tables.shape[1]), 3 * HIDDEN), np.float32)
            self.tables = np.concatenate([self.tables, more], axis=1)
        self.tables[:, first:n] = self.model.project(self.model.vectors(words))

    def numbered(self, words: list[bytes]) -> np.ndarray:
        numbers = self.numbers
        try:
            return np.array([numbers[w] for w in words], np.int32)
        except KeyError:
            fresh = list(dict.fromkeys(w for w in words if w not in numbers))
            for at in range(0, len(fresh), CACHE_WORDS):
                part = fresh[at : at + CACHE_WORDS]
                for w in part:
                    numbers[w] = len(numbers)
                self.add(part)
            return np.array([numbers[w] for w in words], np.int32)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The largest score of the windows of each text."""
        return sigmoid(self.logits(texts)) if self.model.trained else np.zeros(len(texts))

    def logits(self, texts: list[bytes]) -> np.ndarray:
        best = np.full(len(texts), -np.inf, np.float64)
        if len(self.numbers) > CACHE_WORDS:
            self.clear()
        held: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            if held:
                at, owner = np.concatenate(held), np.concatenate(owners)
                for b in range(0, len(at), BLOCK):
                    logit, _ = self.model.run_projected(self.tables, at[b : b + BLOCK])
                    np.maximum.at(best, owner[b : b + BLOCK], logit)
                held.clear()
                owners.clear()

        for i, text in enumerate(texts):
            ids = self.numbered(text.lower().split())
            if not len(ids):
                best[i] = self.model.empty
                continue
            starts = window_starts(len(ids))
            if len(ids) < WINDOW:
                ids = np.concatenate([ids, np.zeros(WINDOW - len(ids), np.int32)])
            for b in range(0, len(starts), BLOCK):
                part = starts[b : b + BLOCK]
                held.append(ids[part[:, None] + np.arange(WINDOW)])
                owners.append(np.full(len(part), i))
                size += len(part)
                if size >= BLOCK:
                    flush()
                    size = 0
        flush()
        return best


def log_odds(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Smoothed log-odds of being in a positive row, from the numbers of rows of each class; 0 for what is in few rows."""
    share = n_pos / (n_pos + n_neg)
    odds = np.log((pos + SMOOTHING * share) / (neg + SMOOTHING * (1 - share)) * n_neg / n_pos)
    return np.where(pos + neg >= MIN_ROWS, odds, 0).astype(np.float32)


def train(texts: list[bytes], labels: np.ndarray, seed: int = 11) -> Model:
    """A model from texts and 0/1 labels.

    A fifth of the rows is kept apart to set the threshold.  Where that leaves fewer than ``FEW`` toxic rows apart, each fifth is
    kept apart from a model of its own, and the last model learns from all rows.
    """
    y, rng = np.asarray(labels, bool), np.random.default_rng(seed)
    fold = rng.permutation(len(y)) % 5
    few = int(y[fold == 0].sum()) < FEW
    logits, apart = np.zeros(len(y)), np.zeros(len(y), bool)
    for k in range(5 if few else 1):
        own = fold == k
        if own.any() and y[~own].any() and not y[~own].all():
            model = _learn([t for t, a in zip(texts, own, strict=True) if not a], y[~own], rng)
            logits[own] = Scorer(model).logits([t for t, a in zip(texts, own, strict=True) if a])
            apart |= own
    if few:
        model = _learn(texts, y, rng)
    if model.trained and (y & apart).any() and (~y & apart).any():
        model.p["bo"] -= np.float32(threshold(logits[y & apart], logits[~y & apart]))
    # nothing speaks for or against a text without words: it gets the share of toxic rows, and is never rejected
    share = min(float(y.mean()), EMPTY) if len(y) else 0.0
    model.empty = float(np.log(share / (1 - share))) if share else -30.0
    return model


def threshold(positive: np.ndarray, negative: np.ndarray) -> float:
    """The middle of the best thresholds, a share of false alarms costing as much as three of misses."""
    values = np.unique(np.concatenate([positive, negative]))
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    worth = (positive[None] >= cuts[:, None]).mean(axis=1) - 3 * (negative[None] >= cuts[:, None]).mean(axis=1)
    best = int(np.argmax(worth))
    low, high = values[max(0, best - 1)], values[min(best, len(values) - 1)]
    return float(low + high) / 2


def _learn(texts: list[bytes], y: np.ndarray, rng: np.random.Generator) -> Model:
    model = Model()
    if not y.any() or y.all():
        return model
    numbers: dict[bytes, int] = {b"": 0}  # padding
    docs = [np.array([numbers.setdefault(w, len(numbers)) for w in t.lower().split()], np.int32) for t in texts]
    vocab = list(numbers)[1:]
    del numbers
    if not vocab:
        return model
    n_pos, n_neg = int(y.sum()), int((~y).sum())
    seen = np.zeros((2, len(vocab) + 1), np.int64)
    for d, label in zip(docs, y, strict=True):
        seen[int(label), np.unique(d)] += 1
    odds = log_odds(seen[1, 1:], seen[0, 1:], n_pos, n_neg)
    chosen = sorted(i for i in np.argsort(-np.abs(odds), kind="stable")[:WORDS].tolist() if odds[i])
    model.words = {vocab[i]: k + 1 for k, i in enumerate(chosen)}
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    p = model.p
    p["word"] = small(len(chosen) + 1, DIM)
    p["word"][0] = 0
    p["word"][1:, 0] = odds[chosen] / 3
    buckets, counts = all_grams(vocab)
    ends = np.cumsum(counts, dtype=np.int64)
    in_rows = np.zeros((2, GRAM_BUCKETS))
    for d, label in zip(docs, y, strict=True):
        if len(d):
            in_rows[int(label), np.unique(np.concatenate([buckets[ends[i] - counts[i] : ends[i]] for i in (np.unique(d) - 1).tolist()]))] += 1
    p["gram"] = small(GRAM_BUCKETS, DIM)
    p["gram"][:, 0] = log_odds(in_rows[1], in_rows[0], n_pos, n_neg) / 1.5
    p["w"], p["u"] = small(2, 2 * DIM, 3 * HIDDEN) * 3, small(2, HIDDEN, 3 * HIDDEN) * 2
    p["b"], p["c"] = np.zeros((2, 3 * HIDDEN), np.float32), np.zeros((2, 3 * HIDDEN), np.float32)
    p["wa"], p["ba"], p["va"] = small(2 * HIDDEN, HIDDEN) * 3, np.zeros(HIDDEN, np.float32), small(HIDDEN) * 3
    p["wo"], p["bo"] = small(2 * HIDDEN) * 3, np.zeros(1, np.float32)
    model.trained = True
    # windows: those with the largest single log-odds, and some others
    word_ids = np.concatenate([[0], [model.words.get(w, 0) for w in vocab]])
    peak = np.concatenate([[0], np.add.reduceat(p["gram"][buckets, 0], ends - counts) / counts + p["word"][word_ids[1:], 0]]).astype(np.float32)
    windows, owner = [], []
    for i, d in enumerate(docs):
        if not len(d):
            continue
        ids = np.concatenate([d, np.zeros(max(0, WINDOW - len(d)), np.int32)])
        at = ids[window_starts(len(d))[:, None] + np.arange(WINDOW)]
        strength = peak[at].max(axis=1)
        pick = np.argsort(-strength, kind="stable")[:3]
        other = rng.choice(len(at), min(2, len(at)), replace=False)
        pick = np.unique(np.concatenate([pick, other]))
        windows.append(at[pick])
        owner.append(np.full(len(pick), i))
    windows, owner = np.concatenate(windows), np.concatenate(owner)
    del docs
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0

    starts = ends - counts

    def grams_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of words of the vocabulary, word by word, and how many each has."""
        n = counts[rows]
        at = np.repeat(starts[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return buckets[at], n

    def batch_inputs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words of the windows, the windows as numbers into them (0 stays padding), and their input vectors."""
        used, local = np.unique(np.concatenate([[0], at.ravel()]), return_inverse=True)
        x = np.zeros((len(used), 2 * DIM), np.float32)
        if len(used) > 1:
            x[1:] = np.concatenate([p["word"][word_ids[used[1:]]], means(p["gram"], *grams_of(used[1:] - 1))], axis=1)
        return used, local[1:].reshape(at.shape), x

    size = int(np.clip(len(windows) // 64, 32, BATCH))
    epochs = max(EPOCHS, -(-MIN_STEPS * size // len(windows)))
    for epoch in range(epochs):
        use = ~y[owner]
        strength = np.array(peak[windows].max(axis=1))
        if epoch:
            for b in range(0, len(windows), BLOCK):
                _, local, x = batch_inputs(windows[b : b + BLOCK])
                strength[b : b + BLOCK], _ = model.run(x, local)
        order = np.lexsort((-strength, owner))
        first = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
        use[first] = True  # of a positive text the window that scores highest
        rows = rng.permutation(np.flatnonzero(use))
        rate = 0.01 * 0.7 ** (EPOCHS * epoch / epochs)
        for b in range(0, len(rows), size):
            part = rows[b : b + size]
            used, local, x = batch_inputs(windows[part])
            _, g, dx = model.gradients(x, local, y[owner[part]].astype(np.float32))
            g["word"] = sums_by(word_ids[used], dx[:, :DIM], len(p["word"]))
            g["word"][0] = 0
            own, n = grams_of(used[1:] - 1)
            g["gram"] = sums_by(own, np.repeat(dx[1:, DIM:] / n[:, None], n, axis=0), GRAM_BUCKETS)
            step += 1
            for k, v in g.items():
                m, s = moments[k]
                m *= 0.9
                m += 0.1 * v
                s *= 0.999
                s += 0.001 * v * v
                p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def sample_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> tuple[list[bytes], np.ndarray]:
    """At most ``per_class`` toxic rows and twice as many others, labelled and not held out, of ``SAMPLE_BYTES`` of text each at most."""
    named = labels.select(F.col(id_col).cast("long").alias("_wf_key"), F.col(label_col).cast("int").alias("y")).where("_wf_key is not null and y is not null")
    one = named.where(~held_out(F.col("_wf_key"))).groupBy("_wf_key").agg(F.max("y").alias("y"))
    rank = lambda v, n: one.where(F.col("y") == v).orderBy(F.xxhash64("_wf_key"), "_wf_key").limit(n)
    picked = rank(1, per_class).unionByName(rank(0, 2 * per_class))
    source = id_and_text(docs, id_col, text_col).withColumnRenamed("doc_id", "_wf_key")
    rows = source.join(F.broadcast(picked), "_wf_key").dropDuplicates(["_wf_key"])
    order = Window.partitionBy("y").orderBy(F.xxhash64("_wf_key"), "_wf_key")  # at most 2 * per_class rows each
    held = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    got = rows.withColumn("held", held).where(F.col("held") <= SAMPLE_BYTES).orderBy("_wf_key").select("text", "y").toArrow()
    return as_bytes(got.column("text").combine_chunks()), got.column("y").to_numpy()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Model:
    model = train(*sample_rows(docs, labels, id_col, text_col, label_col, per_class))
    release()
    return model


def with_score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` and the score of the text as ``_wf_score``."""
    at, shared = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, known = Scorer(shared.value), {}
        for batch in batches:
            texts = as_bytes(batch.column(at).cast(pa.string()))
            keys = [xxhash.xxh3_128_digest(t) for t in texts]
            fresh = {k: t for k, t in zip(keys, texts, strict=True) if k not in known}
            found = known | dict(zip(fresh, scorer.score(list(fresh.values())).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([found[k] for k in keys], pa.float64())], [*batch.schema.names, "_wf_score"])
            known = found if len(found) <= KNOWN else {}

    return map_arrow(docs, run, T.StructType([*nullable(docs.schema).fields, T.StructField("_wf_score", T.DoubleType())]))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    scored = with_score(positional(docs), model, place(docs, text_col))
    return restored(scored.where(F.col("_wf_score") < threshold), docs)
