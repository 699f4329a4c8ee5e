"""Language ID by a linear-chain conditional random field over the words of a text.

Each word has prefix, suffix, character n-gram, whole-word and lexicon features (hashed);
learned transitions tie neighbouring words, so that text in several languages is labelled word
by word. Forward-backward gives the probability of each language at each word; a text's
language is the one with the largest share of its words.

A chain only says which of its languages is likeliest. How well a text fits the language found is
told apart from that, by evidence that is not normalised: ``familiar`` is the share of the
text's letter trigrams, word edges included, that the training texts of that language hold more
than once. Text of a language not learned, or of no language, has few of them.

Learning takes a bounded sample of whole texts, drawn by a hash of the row: about ``DOCS_PER_LANGUAGE``
distinct texts of each language, fewer if they come to more than ``CHARS_PER_LANGUAGE`` characters.
Every text is predicted from all its words. A table's distinct languages are its label
set; more than ``MOST_LANGUAGES`` are an error.

Null text, and text without a letter: ``und``, score 0. Null lang or doc_id: not learned from,
but predicted. With nothing to learn from every text is ``und``. Ties go to the language that
comes first in code point order. Repeated rows get equal results, and equal texts are learned from once.
Columns of the input named like a new one are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import add_columns, gather, held_out, in_training

DOCS_PER_LANGUAGE = 500
CHARS_PER_LANGUAGE = 4_000_000
MOST_LANGUAGES = 200
BUCKETS = 1 << 16
#: Places for the trigrams of a language, as a power of two.
TRIGRAM_BITS = 20
#: Words of one language that stand together in a training sequence; two such runs make one.
RUN = 12
EPOCHS = 4
SEED = 17
#: Words a task remembers before it starts anew.
WORDS_KEPT = 100_000
SEGMENT = 128
WORD = re.compile(r"[^\W\d_]+")


AFFIXES = (1, 2, 3, 4)


def mixed(h: np.ndarray, kind: int) -> np.ndarray:
    """Buckets of 64-bit codes, apart for each kind of feature."""
    h = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)


def word_features(words: list[str], blank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of lower-case words, the lexicon left out; where there is none, ``blank``.

    One row for each word (whole word, prefixes, suffixes), two for each of its characters and
    edges (bigram and trigram that begin there), where each word's characters begin, and the
    place of each trigram among those of a language, -1 where none begins.
    """
    sizes = np.array([len(w) for w in words]) + 2
    starts = np.cumsum(sizes) - sizes
    code = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    left = np.repeat(sizes, sizes) - (np.arange(len(code)) - np.repeat(starts, sizes))  # characters from here to the edge
    place = np.uint64(1_000_003)
    ahead = np.r_[code, np.zeros(max(AFFIXES), np.uint64)]
    pair = code * place + ahead[1 : len(code) + 1]
    triple = pair * place + ahead[2 : len(code) + 2]
    grams = np.stack([np.where(left > 1, mixed(pair, 1), blank), np.where(left > 2, mixed(triple, 2), blank)])
    whole = np.add.reduceat((code + np.uint64(1)) * (left.astype(np.uint64) * place) ** np.uint64(3), starts)
    each = [mixed(whole, 3)]
    for n in AFFIXES:
        for kind, at in ((4 + n, starts + 1), (14 + n, starts + sizes - 1 - n)):
            h = np.zeros(len(words), np.uint64)
            for i in range(n):
                h = h * place + ahead[np.maximum(at, 0) + i]
            each.append(np.where(sizes - 2 >= n, mixed(h, kind), blank))
    places = ((triple * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TRIGRAM_BITS)).astype(np.int64)
    return np.stack(each, 1), grams, starts, np.where(left > 2, places, -1)


class Chain:
    """Weights of features and transitions, and the lexicon of each language."""

    def __init__(self, langs: list[str]):
        self.langs, self.lexicon = langs, {}
        self.blank = BUCKETS + len(langs)
        self.weights = np.zeros((self.blank + 1, len(langs)), np.float32)  # the last row stays 0
        self.moves = np.zeros((len(langs), len(langs)))
        self.trigrams = np.zeros(((1 << TRIGRAM_BITS) + 1, len(langs)), bool)  # the last row stays false

    def listed(self, words: list[str]) -> np.ndarray:
        """The lexicon feature of each word."""
        return np.array([BUCKETS + self.lexicon[w] if w in self.lexicon else self.blank for w in words])

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The score of each word in each language, and how many of its trigrams the language has."""
        each, grams, starts, places = word_features(words, self.blank)
        total = self.weights[each].sum(1) + self.weights[self.listed(words)]
        for ids in grams:
            total += np.add.reduceat(self.weights[ids], starts)
        return total * shrink(words)[:, None], np.add.reduceat(self.trigrams[places].astype(np.int32), starts)

    def marginals(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of each label at each word of a run of texts; ``first`` marks where a text begins.

        Exact forward-backward. The whole run is one chain whose state is forgotten where a text
        begins. It is cut into segments that are advanced side by side: first their transfer
        matrices, then the states at the cuts, then the states within.
        """
        n, k = scores.shape
        cut = -(-n // SEGMENT)
        e = np.ones((cut * SEGMENT, k))
        e[:n] = np.exp(scores - scores.max(1, keepdims=True))
        e = e.reshape(cut, SEGMENT, k).transpose(1, 0, 2).copy()
        begins = np.ones(cut * SEGMENT, bool)  # what fills up the last segment forgets too
        begins[:n] = first
        begins = [np.flatnonzero(b) for b in begins.reshape(cut, SEGMENT).T]
        step = np.exp(self.moves - self.moves.max())

        def ahead_by(state, s):
            moved = (state.reshape(-1, k) @ step).reshape(state.shape)
            if len(begins[s]):
                moved[begins[s]] = state[begins[s]].sum(-1, keepdims=True) / k
            moved *= e[s] if state.ndim == 2 else e[s][:, None]
            if s % 4 == 3:  # before the numbers get too small
                moved /= moved.max(tuple(range(1, state.ndim)), keepdims=True)
            return moved

        whole = np.tile(np.eye(k), (cut, 1, 1))
        for s in range(SEGMENT):
            whole = ahead_by(whole, s)
        forward, backward = np.empty((cut, k)), np.empty((cut, k))
        state = np.full(k, 1 / k)
        for c in range(cut):
            forward[c] = state
            state = state @ whole[c]
            state /= state.sum()
        state = np.ones(k)
        for c in range(cut - 1, -1, -1):
            backward[c] = state
            state = whole[c] @ state
            state /= state.sum()
        alpha, state = np.empty_like(e), forward
        for s in range(SEGMENT):
            alpha[s] = state = ahead_by(state, s)
        state = backward
        for s in range(SEGMENT - 1, -1, -1):
            alpha[s] *= state
            onward = state * e[s]
            state = onward @ step.T
            if len(begins[s]):
                state[begins[s]] = onward[begins[s]].sum(-1, keepdims=True) / k
            if s % 4 == 0:
                state /= state.max(-1, keepdims=True)
        out = alpha.transpose(1, 0, 2).reshape(-1, k)[:n]
        return out / out.sum(1, keepdims=True)


def shrink(words: list[str]) -> np.ndarray:
    """Long words have more features: their sum is scaled back to that of a common word."""
    return 12 / np.maximum(12, np.array([len(w) for w in words]))


def train(texts: list[str], labels: list[int], langs: list[str]) -> Chain:
    """Maximum likelihood by AdaGrad over sequences of two runs, each from a text of one language."""
    chain, k = Chain(langs), len(langs)
    draw = np.random.default_rng(SEED)
    each = [WORD.findall(t.lower()) for t in texts]
    counts: dict[str, np.ndarray] = {}
    for words, y in zip(each, labels, strict=True):
        for w in words:
            counts.setdefault(w, np.zeros(k))[y] += 1
    chain.lexicon = {w: int(c.argmax()) for w, c in counts.items() if c.sum() >= 5 and c.max() >= 0.9 * c.sum()}
    place = {w: i for i, w in enumerate(counts)}
    runs = []
    for words, y in zip(each, labels, strict=True):
        if words:
            words = [place[w] for w in (words if len(words) >= RUN else (words * RUN)[:RUN])]  # a short text is repeated to a run's length
            ends = [*range(RUN, len(words) + 1, RUN)]
            runs += [(words[z - RUN : z], y) for z in (ends if ends[-1] == len(words) else [*ends, len(words)])]
    if not runs:
        return chain
    blank, vocabulary = chain.blank, list(counts)
    each_word, grams, starts, places = word_features(vocabulary, blank)
    lengths = np.diff(np.r_[starts, grams.shape[1]])
    times = np.stack(list(counts.values()))
    for y in range(k):
        chain.trigrams[:-1, y] = np.bincount(places[places >= 0], np.repeat(times[:, y], lengths)[places >= 0], minlength=1 << TRIGRAM_BITS) > 1
    # the features of each word one after the other: of the whole, then of each place
    fixed = np.c_[each_word, chain.listed(vocabulary)]
    sizes = fixed.shape[1] + 2 * lengths
    begins = np.cumsum(sizes) - sizes
    features = np.empty(int(sizes.sum()), np.int64)
    features[(begins[:, None] + np.arange(fixed.shape[1])).ravel()] = fixed.ravel()
    inner = np.repeat(begins + fixed.shape[1] - 2 * (np.cumsum(lengths) - lengths), 2 * lengths) + np.arange(grams.size)
    features[inner] = grams.T.ravel()
    small = shrink(vocabulary)
    ids, ys = np.array([r[0] for r in runs]), np.array([r[1] for r in runs])
    weights, seen = np.zeros((blank + 1, k)), np.full((blank + 1, k), 1e-6)
    moves, moved = np.zeros((k, k)), np.full((k, k), 1e-6)
    for _ in range(EPOCHS):
        order = draw.permutation(len(ids))
        pairs = order[: len(order) // 2 * 2].reshape(-1, 2) if len(order) > 1 else np.array([[0, 0]])
        for batch in np.array_split(pairs, -(-len(pairs) // 512)):
            words = ids[batch].reshape(len(batch), -1)
            gold = np.repeat(ys[batch], RUN, axis=1)
            m, n = words.shape
            flat, count = gather(features, begins[words.ravel()], sizes[words.ravel()]), sizes[words.ravel()]
            score = np.add.reduceat(weights[flat], np.cumsum(count) - count).reshape(m, n, k) * small[words][..., None]
            e, step = np.exp(score - score.max(-1, keepdims=True)), np.exp(moves)
            alpha, beta = np.empty((n, m, k)), np.empty((n, m, k))
            alpha[0] = e[:, 0] / e[:, 0].sum(-1, keepdims=True)
            for t in range(1, n):
                a = (alpha[t - 1] @ step) * e[:, t]
                alpha[t] = a / a.sum(-1, keepdims=True)
            beta[n - 1] = 1
            expected = np.zeros((k, k))
            for t in range(n - 1, 0, -1):
                b = e[:, t] * beta[t]
                both = alpha[t - 1][:, :, None] * step * b[:, None, :]
                expected += (both / both.sum((1, 2), keepdims=True)).sum(0)
                beta[t - 1] = b @ step.T
                beta[t - 1] /= beta[t - 1].sum(-1, keepdims=True)
            p = (alpha * beta).transpose(1, 0, 2)
            p /= p.sum(-1, keepdims=True)
            gap = (p - np.eye(k)[gold]) * small[words][..., None] / m
            each_gap = np.repeat(gap.reshape(-1, k), count, axis=0)
            grad = np.stack([np.bincount(flat, each_gap[:, c], minlength=blank + 1) for c in range(k)], 1) + 1e-7 * weights
            grad[blank] = 0
            seen += grad**2
            weights -= 0.3 * grad / np.sqrt(seen)
            true = np.bincount((gold[:, :-1] * k + gold[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
            grad = (expected - true) / m
            moved += grad**2
            moves -= 0.3 * grad / np.sqrt(moved)
    chain.weights, chain.moves = weights.astype(np.float32), moves
    return chain


def fit(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Chain | None:
    """Learn from the training rows of ``df``; None where there are none."""
    rows = df.filter(in_training(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    found = rows.groupBy(lang).agg(F.count(F.lit(1)), F.sum(F.length(F.col(text)))).limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; '{lang}' is no column of languages")
    if not found:
        return None
    shares = {r[0]: min(1.0, DOCS_PER_LANGUAGE / r[1], CHARS_PER_LANGUAGE / max(1, r[2])) for r in found}
    langs = sorted(shares)
    draw = F.pmod(F.xxhash64(F.col(doc_id), F.col(text), F.lit(SEED)), F.lit(1 << 30))
    share = F.coalesce(*[F.when(F.col(lang) == x, F.lit(int(shares[x] * (1 << 30)))) for x in langs])
    # copies of a text are drawn all or none, and count once
    sample = rows.filter(draw < share).select(F.col(lang).alias("y"), F.col(text).alias("x")).distinct()
    pairs = sorted((r.x, r.y) for r in sample.collect())
    return train([x for x, _ in pairs], [langs.index(y) for _, y in pairs], langs)


def predict(df: DataFrame, chain: Chain | None, text: str = "text", spans: bool = False) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``familiar``; with ``spans`` the runs of words of one language too."""
    held = df.sparkSession.sparkContext.broadcast(chain)
    fields = "lang_pred string, score double, familiar double" + ", lang_spans array<struct<first:int,last:int,lang:string>>" * spans

    def factory():
        model = held.value
        known: dict[str, int] = {}
        rows = np.zeros((0, 1))

        def scan(column):
            nonlocal rows
            each = [WORD.findall(t.lower()) if t else [] for t in column.to_pylist()]
            sizes = np.array([len(x) for x in each])
            n = int(sizes.sum())
            if model is None or not n:
                blank = [pa.array(["und"] * len(each)), pa.array([0.0] * len(each)), pa.array([0.0] * len(each))]
                return blank + [pa.array([[]] * len(each), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())])))] * spans
            if len(known) > WORDS_KEPT:
                known.clear()
            words = [w for x in each for w in x]
            new = [w for w in dict.fromkeys(words) if w not in known]
            if new:
                letter = np.array([w.isalpha() or any(map(str.isalpha, w)) for w in new])
                score, familiar = model.scores(new)
                added = np.c_[score * letter[:, None], letter, familiar * letter[:, None], letter * [len(w) for w in new]]
                rows = np.r_[rows[: len(known)], added] if known else added
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            found = rows[np.fromiter(map(known.__getitem__, words), np.int64, n)]
            filled = np.flatnonzero(sizes)
            at = (np.cumsum(sizes) - sizes)[filled]
            first = np.zeros(n, bool)
            first[at] = True
            k = len(model.langs)
            chance = model.marginals(found[:, :k], first)
            total = np.add.reduceat(chance * found[:, k : k + 1], at)
            count = np.add.reduceat(found[:, k:], at)
            langs, scores, fits = ["und"] * len(each), [0.0] * len(each), [0.0] * len(each)
            for i, sums, c in zip(filled.tolist(), total, count, strict=True):
                if c[0]:
                    best = int(sums.argmax())
                    langs[i], scores[i], fits[i] = model.langs[best], float(min(1.0, sums[best] / c[0])), float(c[1 + best] / c[-1])
            out = [pa.array(langs), pa.array(scores), pa.array(fits)]
            if spans:
                best, ends = chance.argmax(1), np.cumsum(sizes)
                runs = []
                for i, z in enumerate(ends.tolist()):
                    a = z - int(sizes[i])
                    cuts = [a, *(a + 1 + np.flatnonzero(np.diff(best[a:z]))).tolist(), z] if z > a else [a]
                    runs.append([{"first": x - a, "last": y - a - 1, "lang": model.langs[best[x]]} for x, y in zip(cuts, cuts[1:], strict=False)])
                out.append(pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))))
            return out

        return scan

    return add_columns(df, text, fields, factory)


def identify(df: DataFrame) -> DataFrame:
    """Learn on the training rows of the documents ``df`` and predict all of them."""
    chain = fit(df)
    return predict(df.select("doc_id", "text").withColumn("held_out", held_out()), chain).drop("text")
