import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tablewright.llm import QUERIES, alignment
from tablewright.llm.alignment import align, groups, linked_pairs, overlaps
from tablewright.llm.bpe import byte_symbols
from tablewright.llm.sparse import Rows, product

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def dense(rows):
    out = np.zeros((rows.height, rows.width), int)
    for r in range(rows.height):
        for k in range(rows.starts[r], rows.starts[r + 1]):
            out[r, rows.columns[k]] += rows.values[k]
    return out


def sparse(matrix):
    row, column = np.nonzero(matrix)
    return Rows(np.r_[0, np.cumsum(np.bincount(row, minlength=len(matrix)))], column, matrix[row, column], matrix.shape[1])


@pytest.mark.parametrize("entries", [1, 7, 1 << 20])
def test_products(monkeypatch, entries):
    monkeypatch.setattr("tablewright.llm.sparse.ENTRIES", entries)
    rnd = np.random.default_rng(5)
    for shape in ((4, 6, 5), (1, 1, 1), (9, 3, 8), (3, 0, 2), (0, 2, 2)):
        a = rnd.integers(0, 3, shape[:2]) * rnd.integers(0, 2, shape[:2])
        b = rnd.integers(0, 3, shape[1:]) * rnd.integers(0, 2, shape[1:])
        assert (dense(product(sparse(a), sparse(b))) == a @ b).all() and (dense(sparse(a).transpose()) == a.T).all()


def test_links_of_sizes():
    got = dense(overlaps(np.array([2, 3, 1]), np.array([1, 1, 4])))
    assert got.tolist() == [[1, 1, 0], [0, 0, 3], [0, 0, 1]]
    a, b = groups(np.array([2, 3, 1]), np.array([1, 1, 4]))
    assert dense(product(a, b.transpose())).tolist() == [[1, 1, 0], [0, 0, 1], [0, 0, 1]]


def brute(texts):
    """Whole texts by the libraries, every pair of tokens compared."""
    tool = Tokenizer.from_file(PATHS[0])
    tool.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    symbols = byte_symbols()
    with open(PATHS[0], encoding="utf-8") as file:
        a_bytes = {i: bytes(symbols[c] for c in t) for t, i in json.load(file)["model"]["vocab"].items() if i != 50256}

    def spans(ids, of):
        out, at = [], 0
        for i in ids:
            out.append((at, at := at + len(of(i))))
        return out

    def b_bytes(i):
        t = piece.id_to_piece(i)
        return bytes([int(t[3:5], 16)]) if piece.is_byte(i) else t.replace("▁", " ").encode()

    found, pairs = [], Counter()
    for text in texts:
        a = b = []
        if text:
            a, b = tool.encode(" " + text, add_special_tokens=False).ids, piece.encode(text)
            if not b"".join(map(a_bytes.get, a)) == b"".join(map(b_bytes, b)) == (" " + text).encode():
                a = b = []
        sa, sb = spans(a, a_bytes.get), spans(b, b_bytes)
        links, j = [], 0
        for x, (s, e) in zip(a, sa, strict=True):
            while j and sb[j][0] > s:
                j -= 1
            k = j
            while k < len(sb) and sb[k][0] < e:
                if sb[k][1] > s:
                    links.append((x, b[k]))
                k += 1
            j = max(k - 1, 0)
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        parts, shared, i, j = [], 0, 0, 0
        for c in cuts:
            to = next(k for k in range(i, len(sa)) if sa[k][1] == c) + 1, next(k for k in range(j, len(sb)) if sb[k][1] == c) + 1
            left, right = a[i : to[0]], b[j : to[1]]
            i, j = to
            parts.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
            shared += len(left) * len(right)
        pairs.update(links)
        found.append((len(a), len(b), len(cuts), links, ";".join(parts), shared))
    best = defaultdict(int)
    for (_, y), n in pairs.items():
        best[y] = max(best[y], n)
    rows = [(na, nb, ng, len(links), sum(pairs[p] == best[p[1]] for p in links), sum(pairs[p] for p in links),
             hashlib.sha256(g.encode()).hexdigest() if g else "", shared) for na, nb, ng, links, g, shared in found]
    return rows, [f[4] for f in found], pairs, best


def rows_of(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.n_shared) for r in df.collect()}


TEXTS = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\nb", "a\n\nb \n c\n", "\ta\x1cb \x1c!\x1d\x85z　y", "x\0y \0", "a);\r\nb {\r x\r", "\r", "a▁b", "▁", "<|endoftext|> <s></s><unk><0x41>",
         "naïve 北京 🙂🙂 Straße", "same text", "same text", "q" * 5000, "word, " * 3000 + "\nEnd", "İ́ é"]


@pytest.mark.parametrize("limit,cut", [(32 << 20, True), (60, True), (32 << 20, False)])
def test_like_brute_force(spark, monkeypatch, limit, cut):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", limit)
    if not cut:
        monkeypatch.setattr(alignment.vocabularies(*PATHS), "cuts", False)
    rnd = random.Random(6)
    texts = TEXTS + ["".join(rnd.choices(["ab", "the", " ", " ", "\n", "é", "_", "1", ".", " ", "Ж"], k=80)) for _ in range(150)]
    block = alignment.Block(alignment.vocabularies(*PATHS))
    _, counts, lines = block.add([t or "" for t in texts])
    want, strings, pairs, best = brute(texts)
    assert lines == strings and [tuple(c) for c in counts.tolist()] == [(*w[:4], w[7]) for w in want]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, align_block string").repartition(3)
    out = align(df, *PATHS)
    assert rows_of(out) == dict(enumerate(want)) and {r.doc_id: r.groups for r in out.collect()} == dict(enumerate(strings))
    assert {r.align_block for r in out.collect()} == {"x"}
    assert {(r.a_id, r.b_id): (r.n, r.best) for r in linked_pairs(df, *PATHS).collect()} == {p: (n, n == best[p[1]]) for p, n in pairs.items()}


def test_empty_table(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string"), *PATHS).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert rows_of(QUERIES["op13_alignment"](spark, folder)) == dict(zip(texts, brute(texts.values())[0], strict=True))
