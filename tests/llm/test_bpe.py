import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from tablewright.llm import QUERIES
from tablewright.llm.bpe import decode, encode

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    tool = Tokenizer.from_file(PATH)
    coded = [tool.encode(t or "", add_special_tokens=False).ids for t in texts]
    return coded, [tool.decode(ids, skip_special_tokens=False) for ids in coded]


def check(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    rows = {r.doc_id: r for r in decode(encode(df, PATH), PATH).collect()}
    ids, decoded = library(texts)
    assert [rows[i].ids for i in range(len(texts))] == ids
    assert [rows[i].decoded for i in range(len(texts))] == decoded
    assert {r.doc_id: r.decoded for r in encode(df, PATH, decoded="decoded").collect()} == dict(enumerate(decoded))


def test_like_the_library(spark):
    rnd = random.Random(3)
    mixed = ["".join(rnd.choices("ab 's'd\n\t1é²☃😀_-ß", k=50)) for _ in range(200)]
    check(spark, [None, "", " ", "aaaaaaa", "it's  we'll\n\n x", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "z" * 30_000,
                  "word " * 20_000, "same", "same", *mixed])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert decode(encode(df, PATH), PATH).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ids, decoded = library(texts.values())
    wanted = {d: (len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
              for d, i, t in zip(texts, ids, decoded, strict=True)}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op4_bpe"](spark, folder).collect()}
    assert got == wanted
