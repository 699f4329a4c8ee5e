import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tablewright.llm import QUERIES, packing
from tablewright.llm.packing import pack, sequences, tokenize
from tablewright.llm.patterns import Plan, enumerate_patterns, nnls, plan

PATH = public_tokenizers.path("word_bpe_49k.json")


def library(texts):
    tool = Tokenizer.from_file(PATH)
    return [e.ids + [1] for e in tool.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def holds(rows, capacity):
    """Each sequence is filled without gaps from 0 and not over its capacity; returns how many there are."""
    placed = defaultdict(list)
    for sequence, offset, length in rows:
        placed[sequence].append((offset, length))
    for each in placed.values():
        at = 0
        for offset, length in sorted(each):
            assert offset == at
            at += length
        assert at <= capacity
    return len(placed)


def test_patterns_are_all_there_are():
    parts = [1, 2, 3, 5, 8, 12]
    want = {tuple(sorted(c, reverse=True)) for n in (1, 2, 3) for c in product(parts, repeat=n) if sum(c) == 12}
    got = enumerate_patterns(12, parts)
    assert set(got) == want and len(got) == len(want)


def test_nnls_meets_its_conditions():
    rnd = np.random.default_rng(4)
    for _ in range(20):
        matrix, goal = rnd.integers(0, 3, (12, 40)).astype(float), rnd.integers(0, 50, 12).astype(float)
        x = nnls(matrix, goal)
        slope = matrix.T @ (goal - matrix @ x)
        assert (x >= 0).all() and (slope <= 1e-5).all() and (np.abs(slope[x > 0]) <= 1e-5).all()


@pytest.mark.parametrize("seed,capacity,n", [(1, 1, 5), (2, 7, 400), (3, 100, 3000), (4, 4096, 5000), (5, 4096, 1), (6, 30, 0)])
def test_plan(seed, capacity, n):
    rnd = np.random.default_rng(seed)
    sizes = np.minimum(capacity, 1 + (rnd.lognormal(-2, 1, n) * capacity).astype(int))
    counts = np.bincount(sizes, minlength=capacity + 1)
    lines, many = plan(counts, capacity)
    rows, ends = [], {}
    for k in reversed(range(len(lines["n"]))):
        length, start, sequence, of, offset = (int(lines[c][k]) for c in ("length", "start", "sequence", "n", "offset"))
        for j in range(ends.get(length, int(counts[length])) - start):
            rows.append((sequence + j % of, offset + j // of * length, length))
        ends[length] = start
    assert Counter(r[2] for r in rows) == Counter(sizes.tolist())
    assert holds(rows, capacity) == many
    best = Plan(counts, capacity)
    best.best_fit()
    assert many <= 1.01 * best.sequences + 1 and many >= -(-sizes.sum() // capacity)


def test_pieces_like_the_library(spark):
    rnd = random.Random(8)
    mixed = ["".join(rnd.choices("ab 's'D\n\t.1é²Σς☃😀_-ßİ́\x1c <", k=60)) for _ in range(200)]
    texts = [None, "", " ", "It's  We'LL\n\n x.", "a<|endoftext|>b", "A<|startoftext|>.", "Straße. ΑΣ. ΑΣ", "z" * 9000, "word, " * 20_000, "same", "same", *mixed]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, length string").repartition(3)
    got = defaultdict(list)
    for r in sorted(tokenize(df, PATH).collect(), key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(got[r.doc_id]) == 4096 * r.piece and r.length == len(r.ids) <= 4096 and r.text == texts[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        got[r.doc_id] += r.ids
    assert [got[i] for i in range(len(texts))] == library(texts)


def test_words_with_signs_and_digits_without_the_library(monkeypatch):
    texts = ["Haus&&& the.%%% (12-34), ÉTÉ!! ŁÓDŹ", None, "", " \n", "x", "y\n" + "unbelievable" * 3 + "**", "the the", "été"]
    want = [i for ids in library(texts) for i in ids]
    tool = packing.WordIds(PATH)
    monkeypatch.setattr(tool, "ids_of", lambda words: pytest.fail(f"the library saw {words}"))
    flat, offsets = tool.encode(pa.array(texts), 1)
    assert flat.tolist() == want and np.diff(offsets).tolist() == [len(ids) for ids in library(texts)]


@pytest.mark.parametrize("spread", [packing.SPREAD, np.uint64(0)])
def test_words_of_all_kinds_like_the_library(spread, monkeypatch):
    tool = packing.WordIds(PATH)
    monkeypatch.setattr(packing, "SPREAD", spread)  # with 0 different words come to one number
    tool.merges = packing.EndedWords(PATH, "</w>")
    rnd = random.Random(11)
    pools = ["abAB éÉ12.,&%-\n ", "'<|>st \t\x00\x1c\x7f\x85\xa0²½×÷ªµ", "İıŁłȺȾɏɐ\u0301Σςσ日本😀ß", "thereunbeliev ", "".join(map(chr, range(0x250)))]
    texts = ["".join(rnd.choices(rnd.choice(pools) + rnd.choice(pools), k=rnd.randrange(120))) for _ in range(1500)]
    texts += ["a\0", "a", "12345678abcdefgh", "12345678", "abcdefghijklmnop", "abcdefghijklmnopq", "<|endoftext|>", "<|ENDOFTEXT|>", "don't DON'T ,'s"]
    flat, offsets = tool.encode(pa.array(texts).slice(1), 1)
    assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == library(texts[1:])


def test_a_vocabulary_that_keeps_spaces(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a b  c.\n d", "x y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    tool = Tokenizer.from_file(path)
    assert {r.doc_id: r.ids for r in tokenize(df, path).collect()} == {i: [*tool.encode(t).ids, 1] for i, t in enumerate(texts)}


def test_pack_and_put_together(spark):
    rnd = random.Random(2)
    rows = [(i, (n := 50 if i % 3 == 0 else rnd.randint(1, 100)), [i] * n, "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, length int, ids array<int>, offset string").repartition(7)
    packed = pack(df, 100)
    out = packed.collect()
    assert sorted(r.doc_id for r in out) == list(range(2000))
    many = holds([(r.sequence_id, r.offset, r.length) for r in out], 100)
    assert many <= 1.02 * sum(r[1] for r in rows) / 100
    whole = sequences(packed).collect()
    assert len(whole) == many and Counter(x for r in whole for x in r.ids) == Counter({r[0]: r[1] for r in rows})


def test_empty_and_wrong(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack(tokenize(df, PATH)).collect() == []
    for bad in (0, 101, None):
        with pytest.raises(Exception, match="length not from 1 to 100"):
            pack(spark.createDataFrame([(bad,)], "length long"), 100)
    with pytest.raises(ValueError):
        pack(df, 0, "doc_id")


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ids = dict(zip(texts, library(texts.values()), strict=True))
    rows = QUERIES["op11_packing"](spark, folder).collect()
    seen = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == seen[r.doc_id] == r.piece * 4096 and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        assert r.length == min(4096, len(ids[r.doc_id]) - r.start)
        seen[r.doc_id] += r.length
    assert seen == {d: len(i) for d, i in ids.items()}
    assert holds([(r.sequence_id, r.offset, r.length) for r in rows], 4096) <= 1.005 * sum(seen.values()) / 4096 + 1
