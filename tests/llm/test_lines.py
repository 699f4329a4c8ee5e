import hashlib
import random
import re

import duckdb

from tablewright.llm import ORACLE, QUERIES
from tablewright.llm.lines import blocks_of, dedup_lines, digest

SPACE = " \t\n\x0b\x0c\r"


def brute(docs, least):
    """doc_id, deleted lines and text, from all blocks of all documents (doc_ids unique)."""
    first, gone = {}, {}
    for d, text in sorted(docs, key=lambda x: (x[0] is not None, x[0])):
        lines = (text or "").split("\n")
        words = [len(re.findall(f"[^{SPACE}]+", x)) for x in lines]
        filled = [i for i, n in enumerate(words) if n]
        gone[d] = set()
        for a in range(len(filled)):
            total, z = 0, a
            while z < len(filled) and total < least:
                total += words[filled[z]]
                z += 1
            if total < least:
                break
            block = tuple(lines[i].strip(SPACE) for i in filled[a:z])
            begin, end = filled[a], filled[z - 1] + 1
            if block not in first:
                first[block] = (d, end)
                continue
            if first[block][0] == d:
                begin = max(begin, first[block][1])
            gone[d] |= set(range(begin, end))
    return sorted(((d, sorted(gone[d]), "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone[d])) for d, t in docs), key=str)


def run(spark, docs, least):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, runs string, mark int").repartition(3)
    out = dedup_lines(df, least=least)
    assert out.columns == ["doc_id", "text", "mark", "runs"]
    return sorted(((r.doc_id, [i for s in r.runs for i in range(s.begin, s.end)], r.text or "") for r in out.collect()), key=str)


def test_random_lines_like_brute_force(spark):
    rnd = random.Random(4)
    pool = [" ".join(f"w{rnd.randint(0, 30)}" for _ in range(rnd.randint(1, 6))) for _ in range(40)]
    docs = [(d, "\n".join(rnd.choice(["", " "]) if rnd.random() < 0.1 else rnd.choice(pool[: 10 + d % 30]) + rnd.choice(["", "", " \t"]) for _ in range(rnd.randint(0, 60)))) for d in range(60)]
    docs += [(100 + i, docs[i][1] + "\nend " + docs[i + 1][1]) for i in range(20)]
    for least in (8, 20):
        assert run(spark, docs, least) == brute(docs, least)


def test_edges(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    docs = [(None, passage), (1, None), (2, ""), (3, "\n\n"), (4, f"start\n{passage}\nend"), (5, f"  {passage} "), (6, "\n".join(["same line here"] * 30_000)),
            (7, "\n".join([passage] * 3)), (8, passage.replace(" ", "\n")), (9, "x\n" + passage.replace(" ", "\n")), (10, " ".join(f"p{i}" for i in range(49)))]
    assert run(spark, docs, 50) == brute(docs, 50)
    assert run(spark, [], 50) == []
    twice = run(spark, [(1, passage), (2, passage), (2, passage), (3, "other")], 50)
    assert [t for _, _, t in twice] == [passage, "", "", "other"]


def test_winnowing_keeps_one_mark_for_neighbours():
    marks = blocks_of("\n".join(f"a{i} b c d e" for i in range(100)), 50)
    assert len(marks) == 91 and 10 <= sum(m[1] for m in marks) <= 40 and {m[0] for m in marks} == {m[0] for m in marks if m[1]}


def test_whole_table_and_sql(spark):
    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    rows = sorted(tuple(r) for r in QUERIES["op5_lines"](spark, folder).collect())
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    wanted = brute(docs, 50)
    assert [(d, n, h) for d, n, _, h in rows] == sorted((d, len(gone), hashlib.sha256(t.encode()).hexdigest()) for d, gone, t in wanted)
    result = db.execute(ORACLE["op5_lines"])
    assert [c[0] for c in result.description] == digest(dedup_lines(spark.createDataFrame([], "doc_id long, text string"))).columns
    assert sorted(result.fetchall()) == rows and sum(n for _, n, _, _ in rows) > 50
