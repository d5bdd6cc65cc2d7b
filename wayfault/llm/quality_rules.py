"""Quality rules: a learned decision list over statistics of whole texts.

Sequential covering in the manner of IREP/RIPPER: a rule for rejection is grown condition by condition (the threshold on one
statistic with the largest information gain) on two thirds of the labelled rows and pruned on the other third, where its last
conditions go while that improves (p - n) / (p + n).  Rows that a rule covers are removed and the next rule is
learned, until a rule's precision on the pruning rows falls below ``MIN_PRECISION``.  The list becomes
one ordered Spark conditional expression, each branch a conjunction of thresholds.

Learning sees at most ``SAMPLE`` labelled rows, those with the smallest hash of the id, a bound that does
not grow with the corpus; the rules are applied to every row in one pass without a shuffle.

Defined results: a null or empty text has no words and fails the base rule; a null label is no label; rows without an id are
judged like others but cannot be labelled; an id with several labels counts as bad if one of them is; repeated rows are judged alike;
without labels of both kinds the list is empty and the base rule decides; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfault.llm.common import as_bytes, id_and_text, map_arrow, nullable, place, positional, restored

SAMPLE = 12_000
WINDOW = 5
MIN_PRECISION = 0.9
MAX_RULES = 12
MAX_CONDITIONS = 4
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks", "n_distinct", "n_lines", "n_digits")
#: Statistics that a condition may test, as SQL over the counts.
FEATURES = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "letter_share": "n_letters / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / sqrt(greatest(n_words, 1))",
    "words": "CAST(n_words AS DOUBLE)",
}
SYMBOLS = re.compile(rb"[#*$%&|<>]")
BLANK = b" \t\n\x0b\x0c\r"


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen = Counter(zip(*[words[i:] for i in range(window)]))  # noqa: B905
    if len(seen) == n:
        return 0
    end = total = 0
    for i, w in enumerate(zip(*[words[i:] for i in range(window)])):  # noqa: B905
        if seen[w] > 1:
            total += i + window - max(end, i)
            end = i + window
    return total


def repeats_possible(words: list[bytes], window: int = WINDOW) -> bool:
    """Quick exact test: a repeated window needs a position whose hash of words occurred before."""
    h = np.array([hash(w) for w in words], np.int64).view(np.uint64)
    n = len(h) - window + 1
    if n < 2:
        return False
    rolled = np.zeros(n, np.uint64)
    for i in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    rolled.sort()
    return bool((rolled[1:] == rolled[:-1]).any())


def text_counts(text: bytes) -> tuple[int, ...]:
    """The ``COUNTS`` of a text; words are runs of bytes other than \\x20 and \\x09-\\x0D."""
    words = text.split()
    if not words:
        return (0,) * len(COUNTS)
    joined = b"".join(words)
    data = np.frombuffer(joined, np.uint8)
    per_byte = np.bincount(data, minlength=256)
    chars = len(joined) - int(per_byte[0x80:0xC0].sum())
    lines = [x for x in text.split(b"\n") if x.strip(BLANK)]
    folded = text.decode("utf-8", "replace") if chars != len(joined) else ""
    upper = sum(map(str.isupper, folded)) if folded else int(per_byte[65:91].sum())
    letters = sum(map(str.isalpha, folded)) if folded else upper + int(per_byte[97:123].sum())
    return (
        len(words), chars, int(per_byte[[35, 36, 37, 38, 42, 60, 62, 124]].sum()), len(lines) - len(set(lines)),
        repeat_words(words) if repeats_possible(words) else 0, upper, letters, int(per_byte[[33, 63]].sum()), len(set(words)), len(lines), int(per_byte[48:58].sum()),
    )


def with_counts(docs: DataFrame, text_col: str, prefix: str = "_wf_") -> DataFrame:
    """``docs`` and the counts of the text, as ``prefix`` + name."""
    at = docs.columns.index(text_col)
    names = [prefix + c for c in COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([text_counts(t) for t in as_bytes(batch.column(at).cast(pa.string()))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(values[:, i]) for i in range(len(COUNTS))]], [*batch.schema.names, *names])

    schema = T.StructType([*nullable(docs.schema).fields, *[T.StructField(n, T.LongType()) for n in names]])
    return map_arrow(docs, run, schema)


def base_failed(prefix: str = "") -> Column:
    n = F.col(prefix + "n_words")
    return (n < 10) | (100 * F.col(prefix + "n_repeat_words") > 20 * n)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold

    def sql(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.covers(x)
    return out


def _best_condition(x: dict[str, np.ndarray], y: np.ndarray) -> tuple[float, Condition | None]:
    """The condition with the largest gain p1 * (log p1/(p1+n1) - log p/(p+n)) on rows ``x``, of which ``y`` are bad."""
    p, n = int(y.sum()), int((~y).sum())
    best, found = 1e-9, None
    base = np.log2(p / (p + n))
    for name, values in x.items():
        order = np.argsort(values, kind="stable")
        v, bad = values[order], y[order]
        ends = np.flatnonzero(np.concatenate([v[1:] != v[:-1], [False]]))  # between two values
        if not len(ends):
            continue
        below_p = np.cumsum(bad)[ends]
        below = ends + 1
        for above, pp, all_ in ((False, below_p, below), (True, p - below_p, p + n - below)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pp > 0, pp * (np.log2(pp / all_) - base), -1)
            i = int(np.argmax(gain))
            if gain[i] > best:
                best, found = float(gain[i]), Condition(name, above, float((v[ends[i]] + v[ends[i] + 1]) / 2))
    return best, found


def grow(x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS and y.any() and not y.all():
        _, condition = _best_condition(x, y)
        if condition is None:
            break
        rule = (*rule, condition)
        inside = condition.covers(x)
        x, y = {k: v[inside] for k, v in x.items()}, y[inside]
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        c = covered(r, x)
        return (int((c & y).sum()) - int((c & ~y).sum())) / max(1, int(c.sum()))

    return max((rule[:n] for n in range(len(rule), 0, -1)), key=worth) if rule else rule


def learn(x: dict[str, np.ndarray], y: np.ndarray, seed: int = 7) -> list[Rule]:
    """The decision list for rejection from rows with statistics ``x``; ``y``: whether a row is bad."""
    rules: list[Rule] = []
    left = np.ones(len(y), bool)
    rng = np.random.default_rng(seed)
    while len(rules) < MAX_RULES:
        pick = rng.random(len(y)) < 2 / 3
        growing, pruning = left & pick, left & ~pick
        if (y & growing).sum() < 3 or not (~y & growing).any():
            break
        part = lambda m: ({k: v[m] for k, v in x.items()}, y[m])  # noqa: B023, E731
        rule = prune(grow(*part(growing)), *part(pruning))
        inside = covered(rule, x) & left
        held = inside & pruning
        if not rule or held.sum() < 1 or (held & y).sum() / held.sum() < MIN_PRECISION or (inside & y).sum() / inside.sum() < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~inside
    return rules


def expression(rules: list[Rule], prefix: str = "") -> Column:
    """Number of the first rule that covers a row, as one ordered conditional; null where none does."""
    out = None
    for i, rule in enumerate(rules):
        test = F.expr(" AND ".join(f"({_sql(c, prefix)})" for c in rule))
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(None).cast("int") if out is None else out


def _sql(c: Condition, prefix: str) -> str:
    test = c.sql().replace(c.feature, f"({FEATURES[c.feature]})", 1)
    for name in sorted(COUNTS, key=len, reverse=True):
        test = re.sub(rf"(?<![\w]){name}\b", f"`{prefix}{name}`", test)
    return test


def features(counts: np.ndarray) -> dict[str, np.ndarray]:
    """``FEATURES`` of rows of ``COUNTS``."""
    c = dict(zip(COUNTS, counts.astype(float).T, strict=True))
    words, lines, letters, chars = (np.maximum(c[k], 1) for k in ("n_words", "n_lines", "n_letters", "word_chars"))
    return {
        "word_length": c["word_chars"] / words, "symbol_share": c["n_symbols"] / words, "mark_share": c["n_marks"] / words, "upper_share": c["n_upper"] / letters,
        "letter_share": c["n_letters"] / chars, "digit_share": c["n_digits"] / chars, "dup_line_share": c["n_dup_lines"] / lines, "repeat_share": c["n_repeat_words"] / words,
        "distinct_share": c["n_distinct"] / np.sqrt(words), "words": c["n_words"],
    }


def sample_labels(labels: DataFrame, id_col: str, label_col: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids (``_wf_key, _wf_bad``), those with the smallest hash."""
    named = labels.select(F.col(id_col).cast("long").alias("_wf_key"), F.col(label_col).cast("int").alias("y")).where("_wf_key is not null and y is not null")
    one = named.groupBy("_wf_key").agg((F.min("y") == 0).alias("_wf_bad"))
    return one.orderBy(F.xxhash64("_wf_key"), "_wf_key").limit(limit)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = SAMPLE) -> list[Rule]:
    """The decision list learned from at most ``limit`` labelled rows (label 0: bad)."""
    picked = sample_labels(labels, id_col, label_col, limit)
    source = id_and_text(docs, id_col, text_col).withColumnRenamed("doc_id", "_wf_key")
    rows = with_counts(source.join(F.broadcast(picked), "_wf_key"), "text").select("_wf_key", "_wf_bad", *["_wf_" + c for c in COUNTS])
    got = rows.dropDuplicates(["_wf_key"]).orderBy("_wf_key").limit(limit).toArrow()
    if not got.num_rows:
        return []
    counts = np.stack([got.column("_wf_" + c).to_numpy() for c in COUNTS], 1)
    y = got.column("_wf_bad").to_numpy().astype(bool)
    fails = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])  # the base rule has these already
    counts, y = counts[~fails], y[~fails]
    return learn(features(counts), y) if len(y) else []


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with the counts, ``_wf_base_failed``, ``_wf_rule`` (which rule rejects, else null) and ``_wf_kept``."""
    out = with_counts(docs, text_col).withColumn("_wf_base_failed", base_failed("_wf_"))
    out = out.withColumn("_wf_rule", expression(rules, "_wf_"))
    return out.withColumn("_wf_kept", ~F.col("_wf_base_failed") & F.col("_wf_rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    judged = judge(positional(docs), fit(docs, labels, id_col, text_col), place(docs, text_col))
    return restored(judged.where("_wf_kept"), docs)
