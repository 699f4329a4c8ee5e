import hashlib
import random
from collections import Counter, defaultdict

import pytest
from test_jaccard import brute as near_brute
from test_lines import brute as lines_brute
from test_mixing import water

import corpus_pipeline
from tablewright.llm import language

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and returned, as rows."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        before = docs.columns
        stage(spark, docs, FOLDER).write.parquet(path)
        result = spark.read.parquet(path)
        assert name == "tokens" or result.columns == before
        out[name] = (docs.collect(), result.collect())
        docs = result
    return out


def test_language(spark, stages):
    before, after = stages["language"]
    chain = language.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    found = language.predict(spark.createDataFrame(before), chain).collect()
    want = {r.doc_id: r.lang_pred for r in found if r.lang_pred != "und" and r.familiar >= 0.5}
    assert {r.doc_id: r.lang for r in after} == want and len(after) > 0.95 * len(before)
    assert {r.doc_id: r.text for r in after} == {r.doc_id: r.text for r in before if r.doc_id in want}


# Sentences of languages that the documents do not have, and text of none.
FOREIGN = {
    "finnish": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "turkish": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "russian": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "japanese": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
    "alphabet": " ".join("abcdefghijklmnopqrstuvwxyz" * 3),
    "code": "def fn xq_val int32 ptr0 ret cfg_load argv npos strcpy memcpy tmpbuf idx jmp kwargs vtbl mov eax ebx xor",
}


def test_language_rejects_what_it_does_not_know(spark, stages):
    before, after = stages["language"]
    draw = random.Random(5)
    texts = {**FOREIGN, "letters": " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(3, 9))) for _ in range(80))}
    clean = [r for r in before if r.lang in ("en", "de") and len(r.text.split()) > 200][:40]
    switched = [" ".join(x.text.split()[:100] + y.text.split()[:100]) for x, y in zip(clean, clean[1:]) if x.lang != y.lang]
    assert len(switched) > 5
    rows = [(10**6 + i, t, None, "probe", len(t)) for i, t in enumerate([*texts.values(), *switched])]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), True)
    kept = {r.doc_id for r in corpus_pipeline.identify(spark, docs, FOLDER).collect()}
    assert not kept & {10**6 + i for i in range(len(texts))}
    assert kept >= {10**6 + len(texts) + i for i in range(len(switched))}
    # of the documents all stay that have a language and hold little but words
    plain = {r.doc_id for r in before if r.text and sum(map(str.isalpha, r.text.replace(" ", ""))) > 0.8 * len(r.text.replace(" ", ""))}
    assert len(plain) > 800 and kept >= plain


def test_lines(stages):
    before, after = stages["lines"]
    want = {d: t for d, gone, t in lines_brute([(r.doc_id, r.text) for r in before], 50) if t.strip() or not gone}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)


def test_near_copies(stages):
    before, after = stages["near copies"]
    want = {c for _, _, c in near_brute([(r.doc_id, r.text) for r in before])}
    assert sorted(r.doc_id for r in after) == sorted(want)


def test_mix(stages):
    before, after = stages["mix"]
    size = {r.doc_id: len(r.text.split()) for r in before}
    sizes, got = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r.source] += size[r.doc_id]
    texts = {r.doc_id: r.text for r in before}
    taken = defaultdict(int)
    for r in after:
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        got[r.source] += len(r.text.split())
        taken[r.doc_id] += len(r.text.split())
    assert all(n <= 2 * size[d] for d, n in taken.items()) and max(Counter(r.doc_id for r in after).values()) <= 2
    for s, t in water(sizes).items():
        assert abs(got[s] - t) <= 0.005 * t, (s, got[s], t)


def test_mix_cuts_one_document_of_a_shard(stages):
    before, after = stages["mix"]
    size = {r.doc_id: len(r.text.split()) for r in before}
    for source in {r.source for r in before}:
        draws = {r.doc_id: hashlib.md5(f"mix-7|{r.doc_id}".encode()).hexdigest() for r in before if r.source == source}
        assert sum(size[d] for d in draws) <= 1_000_000  # one shard
        order = sorted(draws, key=lambda d: (draws[d], d))
        got = defaultdict(int)
        for r in after:
            if r.source == source:
                got[r.doc_id] += len(r.text.split())
        # the run of the words taken, round by round from the first document on
        left, want = sum(got.values()), defaultdict(int)
        for d in order * 2:
            want[d] += min(left, size[d])
            left -= min(left, size[d])
        assert left == 0 and got == {d: n for d, n in want.items() if n}
        assert sum(n % size[d] > 0 for d, n in got.items()) <= 1


def test_tokens(stages):
    before, after = stages["tokens"]
    assert len(after) == len(before) and all(r.exact and r.n_tokens == len(r.ids) > 0 for r in after)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None, "a"), (2, "", "en", "s", 0, "b"), (None, "the and of to in that is", "en", None, 9, "c"), (3, "the and of to in that is", None, "s", 9, "d"),
            (3, "the and of to in that is", "en", "s", 9, "e"), (4, "the with from this " * 9000, "en", "s", 1, "f"), (5, "12 34", "en", "s", 1, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, runs string")
    for data in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            data = stage(spark, data, FOLDER)
        data.collect()
