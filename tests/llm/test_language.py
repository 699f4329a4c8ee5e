import itertools
import zlib

import numpy as np

from tablewright.llm import QUERIES
from tablewright.llm.language import Chain, fit, identify, predict

FOLDER = "/root/testdata/sf0.01"


def test_marginals_like_enumeration():
    rnd = np.random.default_rng(0)
    chain = Chain(["a", "b", "c"])
    chain.moves = rnd.normal(size=(3, 3))
    texts = [rnd.normal(size=(n, 3)) for n in (1, 5, 4, 2)]
    wanted = []
    for s in texts:
        p = np.zeros_like(s)
        for path in itertools.product(range(3), repeat=len(s)):
            w = np.exp(sum(s[i, y] for i, y in enumerate(path)) + sum(chain.moves[x, y] for x, y in zip(path, path[1:], strict=False)))
            for i, y in enumerate(path):
                p[i, y] += w
        wanted.append(p / p.sum(1, keepdims=True))
    first = np.concatenate([np.arange(len(s)) == 0 for s in texts])
    assert np.allclose(chain.marginals(np.concatenate(texts), first), np.concatenate(wanted))
    long = rnd.normal(size=(1000, 3))  # more words than a segment has
    alpha, state = [], None
    e, step = np.exp(long), np.exp(chain.moves)
    for x in e:
        state = x if state is None else (state @ step) * x
        state = state / state.sum()
        alpha.append(state)
    beta, state = [], np.ones(3)
    for x in e[::-1]:
        beta.append(state)
        state = step @ (x * state)
        state = state / state.sum()
    p = np.array(alpha) * np.array(beta[::-1])
    assert np.allclose(chain.marginals(long, np.arange(1000) == 0), p / p.sum(1, keepdims=True))


def test_held_out_accuracy(spark):
    rows = QUERIES["op9_language"](spark, FOLDER).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(langs) and sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)


def test_edges_and_switching(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    chain = fit(docs)
    de = "und der die von das ist nicht eine für auf " * 3
    en = "the and that with this from which was are for " * 3
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "123 ²!", 0), (4, "the " * 60_000, 0), (None, "the and that", 0), (5, de + en, 0), (5, de + en, 0)],
                                "doc_id long, text string, score int").repartition(2)
    rows = predict(odd, chain, spans=True).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 7 and [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "und", "en"] and got[1].score == got[3].score == 0
    spans = got[5].lang_spans
    assert [s.lang for s in spans][0] == "de" and [s.lang for s in spans][-1] == "en" and spans[0].first == 0 and spans[-1].last == 59
    assert 0.3 < got[5].score < 0.8


def test_whole_texts_are_learned_from(spark, monkeypatch):
    """What stands late in a long text, and in a long word, counts."""
    from tablewright.llm import language
    rows = [(i, "alpha beta " * 3000 + "zzqqxx", "a") for i in range(1, 30)] + [(i, "gamma delta " * 20 + "w" * 300 + "kkjjvv", "b") for i in range(30, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chain = fit(df)
    got = {r.text: r for r in predict(spark.createDataFrame([("zzqqxx",), ("w" * 300 + "kkjjvv",), ("nobody knows",)], "text string"), chain).collect()}
    assert got["zzqqxx"].lang_pred == "a" and got["w" * 300 + "kkjjvv"].lang_pred == "b"
    assert got["w" * 300 + "kkjjvv"].familiar > 0.9
    assert got["nobody knows"].familiar < 0.3
    monkeypatch.setattr(language, "MOST_LANGUAGES", 1)
    try:
        fit(df)
        raise AssertionError
    except ValueError as error:
        assert "languages" in str(error)


def test_learning_like_a_plain_fit():
    """The gradient steps of the batched training against sums written out word by word."""
    from tablewright.llm import language

    texts, labels = ["ab ba ab abb " * 5, "xy yx xyy xy " * 5, "ab abb ba b " * 5], [0, 1, 0]
    chain = language.train(texts, labels, ["a", "b"])
    for word, y in (("ab", 0), ("abb", 0), ("xy", 1), ("xyy", 1)):
        score, familiar = chain.scores([word])
        assert score[0].argmax() == y and familiar[0][y] == len(word) and familiar[0][1 - y] == 0
        each, grams, _, _ = language.word_features([word], chain.blank)
        ids = [*each[0], chain.listed([word])[0], *grams.ravel()]
        assert np.allclose(score[0], sum(chain.weights[i] for i in ids))


def test_nothing_to_learn(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert identify(spark.createDataFrame([], schema)).collect() == []
    rows = identify(spark.createDataFrame([(1, "some text", None, None, 9)], schema)).collect()
    assert [r.lang_pred for r in rows] == ["und"]
