"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in turn; each step fits a tree of at most four leaves to one
feature's bins and adds it, damped, to that feature's lookup table. Then the pairs of features
whose joint cuts explain most of what is left get two-way tables in the same way. A text's
score is the logistic of the sum of its bins' entries.

Learning takes a bounded sample: about ``SAMPLE_ROWS`` labelled rows at most, drawn by a hash
of doc_id; several labels of one doc_id count as the smallest, several texts as the one with
the largest features. Every text is scored from all its words.

Null text: read as empty, which is scored like any other. Null doc_id or label: not learned
from. Nothing to learn from: score 0.5. Repeated rows get equal results.
"""

from __future__ import annotations

import operator
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import add_columns, held_out, in_training, text_buffers

SAMPLE_ROWS = 20_000
SEED = 29
BINS = 32
COARSE = 8
ROUNDS = 120
PAIRS = 8
PAIR_ROUNDS = 40
RATE = 0.15
CUTOFF = 0.3
FEATURES = ("words", "word_size", "longest_word", "distinct_words", "top_word", "repeated_next", "distinct_lines", "line_words",
            "lower", "upper", "digits", "blanks", "breaks", "full_stops", "commas", "exclamations", "bars", "symbols", "other_marks", "beyond_ascii",
            "all_capital_words", "marked_words")
#: Class of each byte: lower, upper, digits, blanks, breaks, full stops, commas, exclamations, bars, symbols, other marks, beyond ASCII.
CLASS = np.full(256, 10)
CLASS[128:] = 11
for number, members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",", b"!", b"|", b"#$%&*@^~<>{}[]")):
    CLASS[list(members)] = number


def text_features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    data, offsets = text_buffers(column)
    n = len(column)
    sizes = np.diff(offsets)
    marks = np.bincount(np.repeat(np.arange(n), sizes) * 12 + CLASS[data], minlength=n * 12).reshape(n, 12) / np.maximum(sizes, 1)[:, None]
    rows = np.zeros((n, 10))
    for i, text in enumerate(column.fill_null("").to_pylist()):
        words = text.split()
        if not words:
            continue
        lines = text.split("\n")
        k, counts = len(words), Counter(words)
        rows[i] = (np.log1p(k), sum(map(len, words)) / k, np.log1p(max(map(len, counts))), len(counts) / k, max(counts.values()) / k,
                   sum(map(operator.eq, words, words[1:])) / k, len(set(lines)) / len(lines), np.log1p(k / len(lines)),
                   sum(c for w, c in counts.items() if w.isupper()) / k, sum(c for w, c in counts.items() if not w[-1].isalnum()) / k)
    return np.c_[rows[:, :8], marks, rows[:, 8:]]


def leaves(gradient: np.ndarray, weight: np.ndarray, depth: int = 2) -> np.ndarray:
    """Entries of a shallow tree over ordered bins."""
    if depth:
        g, h = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
        whole_g, whole_h = gradient.sum(), weight.sum()
        gain = g**2 / (h + 1) + (whole_g - g) ** 2 / (whole_h - h + 1) - whole_g**2 / (whole_h + 1)
        if len(gain) and gain.max() > 1e-9:
            cut = int(gain.argmax()) + 1
            return np.r_[leaves(gradient[:cut], weight[:cut], depth - 1), leaves(gradient[cut:], weight[cut:], depth - 1)]
    return np.full(len(gradient), gradient.sum() / (weight.sum() + 1))


def quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The best pair of cuts through a two-way table: its gain, and the entries of its four parts."""
    def below(table):
        return np.cumsum(np.cumsum(table, 0), 1)

    g, h = below(gradient), below(weight)
    parts = [(t[:-1, :-1], t[:-1, -1:] - t[:-1, :-1], t[-1:, :-1] - t[:-1, :-1], t[-1, -1] - t[:-1, -1:] - t[-1:, :-1] + t[:-1, :-1]) for t in (g, h)]
    gain = sum(a**2 / (b + 1) for a, b in zip(*parts, strict=True))
    r, c = np.unravel_index(int(gain.argmax()), gain.shape)
    entry = [a[r, c] / (b[r, c] + 1) for a, b in zip(*parts, strict=True)]
    table = np.empty(gradient.shape)
    table[: r + 1, : c + 1], table[: r + 1, c + 1 :], table[r + 1 :, : c + 1], table[r + 1 :, c + 1 :] = entry
    return float(gain[r, c]), table


class Additive:
    """Cuts of each feature, lookup tables, and tables of feature pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]
        self.coarse = [np.unique(np.quantile(c, np.arange(1, COARSE) / COARSE)) for c in x.T]
        share = np.clip(y.mean(), 0.01, 0.99)
        self.start = float(np.log(share / (1 - share)))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        total = np.full(len(y), self.start)
        bins = self.bins(x, self.cuts)

        def left():
            p = 1 / (1 + np.exp(-total))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for b, entries in zip(bins, self.tables, strict=True):
                g, h = left()
                step = RATE * leaves(np.bincount(b, g, len(entries)), np.bincount(b, h, len(entries)))
                entries += step
                total += step[b]
        wide = self.bins(x, self.coarse)

        def table_of(i, j):
            n, m = len(self.coarse[i]) + 1, len(self.coarse[j]) + 1
            at = wide[i] * m + wide[j]
            g, h = left()
            return at, np.bincount(at, g, n * m).reshape(n, m), np.bincount(at, h, n * m).reshape(n, m)

        able = [i for i, c in enumerate(self.coarse) if len(c)]
        gains = sorted(((quadrants(*table_of(i, j)[1:])[0], i, j) for i, j in combinations(able, 2)), reverse=True)
        self.pairs = [(i, j, np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1))) for _, i, j in gains[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for i, j, entries in self.pairs:
                at, g, h = table_of(i, j)
                step = RATE * quadrants(g, h)[1]
                entries += step
                total += step.ravel()[at]

    @staticmethod
    def bins(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for b, entries in zip(self.bins(x, self.cuts), self.tables, strict=True):
            total += entries[b]
        wide = self.bins(x, self.coarse)
        for i, j, entries in self.pairs:
            total += entries[wide[i], wide[j]]
        return 1 / (1 + np.exp(-total))


def with_features(df: DataFrame, name: str, text: str = "text") -> DataFrame:
    def scan(column):
        x = text_features(column)
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))]

    return add_columns(df, text, f"`{name}` array<double>", lambda: scan)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality") -> Additive | None:
    """Learn from the training rows that have a label 0 or 1; None where there are none."""
    known = labels.filter(in_training() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"))
    n = known.count()
    if not n:
        return None
    share = int(min(1, SAMPLE_ROWS / n) * (1 << 30))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < share)
    # the drawn rows are few whatever the table's size: SAMPLE_ROWS ids and labels
    rows = with_features(documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"), "x").groupBy("doc_id").agg(F.max("x").alias("x"), F.min("y").alias("y"))
    sample = sorted(rows.collect(), key=lambda r: r.doc_id)
    return Additive(np.array([r.x for r in sample]), np.array([r.y for r in sample], float)) if sample else None


def predict(df: DataFrame, model: Additive | None, text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """``df`` with ``score`` and ``predicted``."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def scan(column):
        score = held.value.score(text_features(column)) if held.value else np.full(len(column), 0.5)
        return [pa.array(score, pa.float64()), pa.array((score >= cutoff).astype(np.int32))]

    return add_columns(df, text, "score double, predicted int", lambda: scan)


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn on the labelled training rows and score all documents."""
    model = fit(documents, labels)
    return predict(documents.select("doc_id", "text").withColumn("held_out", held_out()), model).drop("text")
