import math

import duckdb
import numpy as np
import pytest

from tablewright.llm import ORACLE, QUERIES, near_vectors
from tablewright.llm.near_vectors import near_duplicates
from tablewright.llm.search import search
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, cell string"


def good(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute_links(rows, least=0.98):
    """(vec_id, n_links, component) of (vec_id, vector, label) rows, all pairs."""
    able = [i for i, (_, v, y) in enumerate(rows) if y is not None and good(v)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    groups = {}
    for i in able:
        groups.setdefault((rows[i][2], len(rows[i][1])), []).append(i)
    for at in groups.values():
        x = np.array([rows[i][1] for i in at], np.float32).astype(float)
        norm = np.sqrt((x * x).sum(1))
        near = x @ x.T / norm[:, None] / norm >= least
        np.fill_diagonal(near, False)
        for a, b in zip(*np.nonzero(near), strict=True):
            i, j = at[a], at[b]
            links[i] += 1
            root[find(max(i, j))] = find(min(i, j))
    least_id = {}
    for i, (d, _, _) in enumerate(rows):
        r, old = find(i), least_id.get(find(i))
        least_id[r] = d if old is None else old if d is None else min(old, d)
    return sorted(((d, links[i], least_id[find(i)]) for i, (d, _, _) in enumerate(rows)), key=str)


def linked(spark, rows):
    df = spark.createDataFrame([(d, v, y, "x") for d, v, y in rows], SCHEMA).repartition(3)
    got = near_duplicates(df).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)


def clustered(n, width=24, seed=0):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(n // 6, width))
    rows = []
    for i in range(n):
        v = base[rnd.integers(len(base))] + rnd.normal(size=width) * rnd.choice([0.02, 0.1, 0.2, 0.5])
        rows.append((i, [float(np.float32(x)) for x in v * rnd.uniform(0.1, 9)], int(rnd.integers(3))))
    return rows


@pytest.mark.parametrize("block", [512, 16])
def test_links_like_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    rows = clustered(600)
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(40)] + [(2000 + i, rows[0][1], rows[0][2]) for i in range(50)]
    assert linked(spark, rows) == brute_links(rows)


@pytest.mark.parametrize("centres", [1, 3])
def test_cells_cut_again_lose_no_link(spark, monkeypatch, centres):
    monkeypatch.setattr(near_vectors, "MOST_CENTRES", centres)
    rows = clustered(900, seed=3)
    index = near_vectors.Index(np.array([v for _, v, _ in rows]), 40)
    assert index.parts == -(-40 // centres)
    unit = near_vectors.unit_rows(np.array([v for _, v, _ in rows]))[0]
    _, _, row, cell, home = index.place(unit, float(np.sqrt(0.04)))
    assert sorted(row[home]) == list(range(len(rows))) and len(set(cell.tolist())) > 30
    probed, own = {}, dict(zip(row[home].tolist(), cell[home].tolist(), strict=True))
    for r, c in zip(row.tolist(), cell.tolist(), strict=True):
        probed.setdefault(r, set()).add(c)
    near = unit @ unit.T >= 0.98
    assert all(own[j] in probed[i] for i, j in zip(*np.nonzero(near), strict=True))
    assert linked(spark, rows) == brute_links(rows)


def test_doubles_stay_doubles(spark):
    df = spark.createDataFrame([(20, [1e39, 1.0], 1), (1, [2e39, 2.0], 1), (2, [1e39, -1e39], 1)], "vec_id long, embedding array<double>, label int")
    got = {(r.query_id, r.vec_id): r.score for r in search(df, F.col("vec_id") % 20 == 0, 2).collect()}
    assert got == {(20, 1): 2e39 * 1e39 + 2.0, (20, 2): 1e39 * 1e39 - 1e39}
    assert sorted((r.vec_id, r.n_links) for r in near_duplicates(df).collect()) == [(1, 1), (2, 0), (20, 1)]


def test_links_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in QUERIES["op3_near_vectors"](spark, folder).collect()), key=str)
    assert got == brute_links(rows)
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    assert sorted((r[:3] for r in db.execute(ORACLE["op3_near_vectors"]).fetchall()), key=str) == got


ODD = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, float("nan")], 1), (5, [1.0, None], 1), (6, [float("inf"), 1.0], 1), (7, [1.0, 2.0], None), (8, [1.0, 2.0], None),
       (9, [1.0, 2.0], 1), (10, [2.0, 4.0], 1), (11, [1.0, 2.0, 0.0], 1), (None, [1.0, 2.0], 1), (12, [1.0, 2.0], 2), (13, [1.0, 2.0], 1), (13, [1.0, 2.0], 1), (14, [-1.0, -2.0], 1)]


def test_links_edges(spark):
    assert linked(spark, ODD) == brute_links(ODD)
    assert linked(spark, []) == [] and linked(spark, ODD[:8]) == brute_links(ODD[:8])


def brute_search(rows, k):
    """{query row: [(vec_id, score)]} with every row but the query's own."""
    able = [(i, d, np.array(v, np.float32).astype(float)) for i, (d, v, _) in enumerate(rows) if good(v)]
    width = max((len(v) for _, _, v in able), default=0)
    able = [(i, d, np.pad(v, (0, width - len(v)))) for i, d, v in able]
    out = []
    for i, d, v in able:
        if d is not None and d % 20 == 0:
            near = sorted(((-float((v * w).sum()), e is None, e or 0, e) for j, e, w in able if j != i), key=lambda t: t[:3])[:k]
            out += [(d, r + 1, e, -s) for r, (s, _, _, e) in enumerate(near)]
    return out


def searched(spark, rows, k):
    df = spark.createDataFrame([(d, v, y, "x") for d, v, y in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in search(df, F.col("vec_id") % 20 == 0, k).collect()), key=str)


def test_search_edges(spark):
    rows = [(20 * d if d else d, v, y) for d, v, y in ODD]
    got, want = searched(spark, rows, 4), sorted(brute_search(rows, 4), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    assert searched(spark, [], 20) == [] and searched(spark, [(20, [1.0], 1)], 20) == []


def test_search_recall(spark):
    for folder, least in (("/root/testdata/sf0.01", 0.97),):
        rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
        got, want = [tuple(r) for r in QUERIES["op7_search"](spark, folder).collect()], brute_search(rows, 20)
        assert len(got) == len(want) and len(set(g[:2] for g in got)) == len(got)
        assert len({(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}) >= least * len(want)
        vectors = {d: np.array(v, np.float32).astype(float) for d, v, _ in rows}
        assert all(abs(s - (vectors[q] * vectors[v]).sum()) < 1e-12 for q, _, v, s in got)
        best = sorted(got, key=lambda g: (g[0], g[1]))
        assert all(a[0] != b[0] or (a[3], -a[2]) >= (b[3], -b[2]) for a, b in zip(best, best[1:], strict=False))


def test_search_returns_as_many_as_asked_for(spark):
    import random

    draw = random.Random(2)
    rows = [(i, [draw.gauss(0, 1) for _ in range(8)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [r.query_id for r in search(df, F.col("vec_id") % 1000 == 0, 1000).collect()]
    assert sorted(got) == [0] * 1000 + [1000] * 1000 + [2000] * 1000


def test_search_many_copies_and_lengths(spark):
    rnd = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rnd.normal(size=16).astype(np.float32) * rnd.choice([0.5, 1, 3])], 0) for i in range(2500)]
    rows += [(5000 + i, rows[0][1], 0) for i in range(300)]
    got, want = searched(spark, rows, 20), brute_search(rows, 20)
    assert len({(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}) >= 0.95 * len(want)
