import random
from collections import Counter

import duckdb
import numpy as np

from tablewright.llm import ORACLE, QUERIES
from tablewright.llm import jaccard
from tablewright.llm.components import components
from tablewright.llm.jaccard import BANDS, RECALL, ROWS, keep_one, near_duplicates
from tablewright.llm.scratch import Scratch


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(docs):
    """doc_id, n_links, class_id, kept of all rows, by comparing all pairs."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    links = [0] * len(docs)
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in where[g])
        for j, c in common.items():
            if j != i and 5 * c >= 4 * (len(s) + len(sets[j]) - c):
                links[i] += 1
                root[find(max(i, j))] = find(min(i, j))
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return sorted(((d, links[i], least[find(i)]) for i, (d, _) in enumerate(docs)), key=str)


def run(spark, docs):
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, key string").repartition(3)
    return near_duplicates(df).collect()


def test_bands_reach_the_recall():
    assert 1 - (1 - 0.8**ROWS) ** BANDS >= RECALL
    rnd = random.Random(1)
    found = 0
    for _ in range(200):  # pairs right above the threshold
        a = [str(rnd.random()) for _ in range(180)]
        b = a[:162] + [str(rnd.random()) for _ in range(18)]
        grams, offsets = jaccard.Shingles().sets([" ".join(a), " ".join(b)])
        bands = jaccard.band_hashes(jaccard.signatures(grams, offsets))
        found += bool((bands[0] == bands[1]).any())
    assert found >= 198


def test_whole_table_like_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = QUERIES["op8_jaccard"](spark, folder).collect()
    assert sorted(((r.doc_id, r.n_links, r.class_id) for r in rows), key=str) == brute(docs)
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    assert sorted(db.execute(ORACLE["op8_jaccard"]).fetchall()) == sorted(tuple(r) for r in rows)


def test_large_groups_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard.in_blocks, "__defaults__", (8,))
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(base)) for i in range(30)]
    for i in range(30, 90):
        words = list(base)
        for _ in range(rnd.randint(1, 3)):
            words[rnd.randrange(200)] = f"x{i}"
        docs.append((i, " ".join(words)))
    got = run(spark, docs)
    assert sorted(((r.doc_id, r.n_links, r.class_id) for r in got), key=str) == brute(docs)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (None, "one two"), (None, None), (7, "same"), (7, "same"), (7, "other text"),
            (8, long), (9, long + " end"), (10, " ".join(f"v{i}" for i in range(24))), (11, " ".join(f"v{i}" for i in range(20)))]
    got = run(spark, docs)
    assert sorted(((r.doc_id, r.n_links, r.class_id) for r in got), key=str) == brute(docs)
    assert run(spark, []) == []
    df = spark.createDataFrame([(d, t, "en", i) for i, (d, t) in enumerate(docs)], "doc_id long, text string, print string, n_chars int")
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(1, None), (2, ""), (3, " \n"), (None, None), (None, "one two"), (6, "one two three"), (7, "same"), (7, "other text"), (8, long), (10, docs[13][1])], key=str)


def test_texts_without_words_stay(spark):
    blank = ["\u00a0", "\u3000 ", "\x1c\x1f", "\x85", " \n", "", None]
    docs = [(i, t) for i, t in enumerate([*blank, *blank[:2], "\u4e2d\u6587", "\u00a0one two"])] + [(0, blank[0]), (None, "\u2003"), (None, "\u2003")]
    kept = keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame(docs, "doc_id long, text string").collect()))


def test_components(spark):
    rnd = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rnd.integers(0, 400, (250, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2001 + i) for i in range(300)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    with Scratch(spark) as scratch:
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
        assert got == {x: find(x) for x in list(root)}
        assert components(spark.createDataFrame([], "a long, b long"), scratch).collect() == []
