import itertools
import math
import zlib

import numpy as np
import pyarrow as pa

from tablewright.llm import QUERIES, quality
from tablewright.llm.quality import CUTOFF, FEATURES, Additive, classify, leaves, quadrants, text_features

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in QUERIES["op10_quality"](spark, FOLDER).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= CUTOFF) for d, r in rows.items())
    held = [d for d in labels if rows[d].held_out]
    good, bad = [rows[d].score for d in held if labels[d]], [rows[d].score for d in held if not labels[d]]
    area = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    right = np.mean([rows[d].predicted == labels[d] for d in held])
    assert area >= 0.9 and right >= 0.9, (area, right)


def test_pairs_learn_what_single_features_cannot():
    rnd = np.random.default_rng(1)
    x = rnd.uniform(-1, 1, (4000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = Additive(x, y)
    assert {model.pairs[0][0], model.pairs[0][1]} == {0, 1}
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_trees():
    assert np.allclose(leaves(np.array([9.0, 9, -9, -9]), np.array([1.0, 1, 1, 1])), [6, 6, -6, -6])
    gain, table = quadrants(np.array([[5.0, -5], [-5, 5]]), np.ones((2, 2)))
    assert np.allclose(table, [[2.5, -2.5], [-2.5, 2.5]]) and gain == 50


def test_edges(spark):
    x = text_features(pa.array([None, "", "\n", "A a a.", "w " * 50_000]))
    assert x.shape == (5, len(FEATURES)) and np.isfinite(x).all() and (x[0] == 0).all() and (x[1] == 0).all()
    docs = spark.createDataFrame([(1, None, 0.5), (None, "text", 0.5), (2, "", 0.5), (2, "", 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.score, r.predicted) for r in classify(docs, none).collect()] == [(0.5, 1)] * 4
    some = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 0), (2, None, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in classify(docs, some).collect())
    assert classify(docs.limit(0), some).collect() == []


def plain_features(text):
    """The features of one text, each by its own definition."""
    data, words, lines = (text or "").encode(), (text or "").split(), (text or "").split("\n")
    classes = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",", b"!", b"|", b"#$%&*@^~<>{}[]"]
    shares = [sum(b in c for b in data) for c in classes]
    beyond = sum(b > 127 for b in data)
    shares = [s / max(len(data), 1) for s in [*shares, len(data) - sum(shares) - beyond, beyond]]
    if not words:
        return [0.0] * 8 + shares + [0.0, 0.0]
    k = len(words)
    return [math.log1p(k), sum(len(w) for w in words) / k, math.log1p(max(len(w) for w in words)), len(set(words)) / k,
            max(words.count(w) for w in set(words)) / k, sum(words[i] == words[i + 1] for i in range(k - 1)) / k,
            len(set(lines)) / len(lines), math.log1p(k / len(lines)), *shares,
            sum(w.isupper() for w in words) / k, sum(not w[-1].isalnum() for w in words) / k]


def quantile(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    low = int(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


def plain_model(rows, ys, rounds, pair_rounds):
    """The whole fit, row by row; gives back the function that scores a row."""
    n, width = len(rows), len(rows[0])
    cuts, coarse = ([sorted({quantile([r[f] for r in rows], i / b) for i in range(1, b)}) for f in range(width)] for b in (quality.BINS, quality.COARSE))
    share = min(max(sum(ys) / n, 0.01), 0.99)
    start = math.log(share / (1 - share))
    tables = [[0.0] * (len(c) + 1) for c in cuts]

    def place(cut, value):
        return sum(c < value for c in cut)

    def folded(total, at, size):
        g, h = [0.0] * size, [0.0] * size
        for i in range(n):
            p = 1 / (1 + math.exp(-total[i]))
            g[at[i]] += ys[i] - p
            h[at[i]] += p * (1 - p)
        return g, h

    def gain(*parts):
        return sum(sum(g) ** 2 / (sum(h) + 1) for g, h in parts)

    def tree(g, h, depth):
        if depth and len(g) > 1:
            best = max(range(1, len(g)), key=lambda c: (gain((g[:c], h[:c]), (g[c:], h[c:])), -c))
            if gain((g[:best], h[:best]), (g[best:], h[best:])) - gain((g, h)) > 1e-9:
                return tree(g[:best], h[:best], depth - 1) + tree(g[best:], h[best:], depth - 1)
        return [sum(g) / (sum(h) + 1)] * len(g)

    def four(g, h, high, wide):
        best = None
        for r in range(1, high + 1):
            for c in range(1, wide + 1):
                quarter = [(i >= r) * 2 + (j >= c) for i in range(high) for j in range(wide)]
                parts = [([x for x, at in zip(g, quarter) if at == q], [x for x, at in zip(h, quarter) if at == q]) for q in range(4)]
                found = (gain(*parts), [sum(a) / (sum(b) + 1) for a, b in parts], quarter)
                best = found if best is None or found[0] > best[0] + 1e-12 else best
        return best[0], [best[1][q] for q in best[2]]

    bins = [[place(cuts[f], r[f]) for r in rows] for f in range(width)]
    total = [start] * n
    for _ in range(rounds):
        for f in range(width):
            step = [quality.RATE * s for s in tree(*folded(total, bins[f], len(tables[f])), 2)]
            tables[f] = [a + b for a, b in zip(tables[f], step)]
            total = [t + step[b] for t, b in zip(total, bins[f])]
    able = [f for f in range(width) if coarse[f]]

    def joint(a, b, row):
        return place(coarse[a], row[a]) * (len(coarse[b]) + 1) + place(coarse[b], row[b])

    def shape(a, b):
        return len(coarse[a]) + 1, len(coarse[b]) + 1

    gains = sorted(((four(*folded(total, [joint(a, b, r) for r in rows], math.prod(shape(a, b))), *shape(a, b))[0], a, b)
                    for a, b in itertools.combinations(able, 2)), reverse=True)
    pairs = {(a, b): [0.0] * math.prod(shape(a, b)) for _, a, b in gains[:quality.PAIRS]}
    for _ in range(pair_rounds):
        for (a, b), entries in pairs.items():
            at = [joint(a, b, r) for r in rows]
            step = [quality.RATE * s for s in four(*folded(total, at, len(entries)), *shape(a, b))[1]]
            pairs[a, b] = [x + y for x, y in zip(entries, step)]
            total = [t + step[i] for t, i in zip(total, at)]

    def score(row):
        t = start + sum(tables[f][place(cuts[f], row[f])] for f in range(width)) + sum(e[joint(a, b, row)] for (a, b), e in pairs.items())
        return 1 / (1 + math.exp(-t))

    return score


def test_whole_query_like_a_plain_version(spark, monkeypatch):
    for name, value in (("ROUNDS", 4), ("PAIR_ROUNDS", 2), ("PAIRS", 3), ("BINS", 8), ("COARSE", 3)):
        monkeypatch.setattr(quality, name, value)
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op10_quality"](spark, folder).collect()}
    features = {d: plain_features(t) for d, t in texts.items()}
    assert np.allclose(text_features(pa.array(list(texts.values()))), list(features.values()))
    learned = [d for d in sorted(labels) if d in texts and labels[d] in (0, 1) and zlib.crc32(str(d).encode()) % 5]
    score = plain_model([features[d] for d in learned], [labels[d] for d in learned], 4, 2)
    assert set(got) == set(texts) and len(learned) > 20
    assert all(abs(got[d].score - score(features[d])) < 1e-9 for d in texts)
