import re
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm import ORACLE, QUERIES
from pyspark.sql import functions as F

from tablewright.llm import mixing
from tablewright.llm.mixing import apportion, mix

SCHEMA = "doc_id long, text string, source string, taken string, lang string"


def water(sizes):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, left = set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        rest = left - sum(2 * sizes[s] for s in full)
        level = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if level[s] > 2 * sizes[s]}
        if not over:
            return {**{s: 2.0 * sizes[s] for s in full}, **level}
        full |= over


def check(rows, near):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = water(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= near(want[s]), (s, taken[s], want[s])


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = mix(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts) and all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])) for r in rows)
    check(rows, lambda t: 0.005 * t)


def test_like_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    wanted = sorted(db.execute(ORACLE["op6_mixing"]).fetchall())
    got = QUERIES["op6_mixing"](spark, folder)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(tuple(r) for r in got.collect()) == wanted
    assert sorted(tuple(r) for r in QUERIES["op6_mixing"](spark, folder).collect()) == wanted


def test_edges(spark):
    words = "w " * 50_000
    docs = [(1, None, "a", "x", "l"), (2, "", "a", "x", "l"), (3, "one two\tthree", "b", None, "l"), (3, "one two\tthree", "b", None, "l"), (4, words, None, "x", "l"),
            (None, "x y", "é", "x", "l"), (5, "a\xa0b c", "Z", "x", None)]
    rows = mix(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(rows) == 7 and {r.lang for r in rows} == {"l", None}
    assert {r.doc_id: r.size for r in rows} == {1: 0, 2: 0, 3: 3, 4: 50_000, None: 2, 5: 2}
    check(rows, lambda t: max(2, 0.005 * t))
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [(r.taken, r.target) for r in mix(spark.createDataFrame(docs[:2], SCHEMA)).collect()] == [(0, 0.0)] * 2


def test_reads_cut_differently(spark, tmp_path):
    docs = [(i, f"d{i} " * (1 + i % 7), "ab"[i % 2], "x", "l") for i in range(400)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(docs, SCHEMA).repartition(8).write.parquet(path)
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    mixed = mix(spark.read.parquet(path))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        spark.conf.set("spark.sql.files.openCostInBytes", "16k")
        rows = mixed.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert sorted((r.doc_id, r.size, r.text) for r in rows) == [(i, 1 + i % 7, t) for i, t, *_ in docs]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=12), st.integers(0, 500))
def test_apportionment_like_the_definition(spark, weights, seats):
    weights = [*weights, 1]
    df = spark.createDataFrame([(i, w, seats) for i, w in enumerate(weights)], "k long, w long, seats long")
    got = {r.k: r.got for r in apportion(df, [], "k", "w", "seats", "got").collect()}
    have = [0] * len(weights)
    for _ in range(seats):
        have[max(range(len(weights)), key=lambda i: (weights[i] / (2 * have[i] + 1), -i))] += 1
    assert [got[i] for i in range(len(weights))] == have


def test_whole_documents_by_quotas_of_shards(spark, monkeypatch):
    """From the first document on: each shard takes its Sainte-Laguë quota of blocks, round and round, and cuts one document at most."""
    import hashlib

    monkeypatch.setattr(mixing, "OWN_SHARD_WORDS", 300)
    docs = [(i, "w " * (1 + i * 7 % 40), f"s{i % 4}") for i in range(260)]
    df = spark.createDataFrame([(*d, "x", "en") for d in docs], SCHEMA)
    plan = {r.source: r for r in mixing.targets(df.select("source", F.regexp_count("text", F.lit(mixing.WORD)).cast("long").alias("size")), own_shards=True).collect()}
    got = {r.doc_id: r.taken for r in mix(df, from_first=True).collect()}
    size = {d: len(t.split()) for d, t, _ in docs}
    for source, p in plan.items():
        assert p.shards == max(1, -(-p.source_size // 300)) > 1
        shards = {}
        for d in size:
            if f"s{d % 4}" == source:
                draw = hashlib.md5(f"mix-7|{d}".encode()).hexdigest()
                shards.setdefault(int(draw[:15], 16) % p.shards, []).append((draw, d))
        words = {k: sum(size[d] for _, d in v) for k, v in shards.items()}
        quotas = dict.fromkeys(words, 0)
        for _ in range(p.blocks):
            best = max(sorted(words), key=lambda k: words[k] / (2 * quotas[k] + 1))
            quotas[best] += 1
        for k, each in shards.items():
            left = min(quotas[k] * p.block, 2 * words[k])
            want = dict.fromkeys((d for _, d in each), 0)
            for _, d in sorted(each) * 2:
                want[d] += min(left, size[d])
                left -= min(left, size[d])
            assert {d: got[d] for d in want} == want and sum(n % size[d] > 0 for d, n in want.items()) <= 1
