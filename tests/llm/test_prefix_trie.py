import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import ORACLE, QUERIES, prefix_trie
from tablewright.llm.parentheses import Parentheses
from tablewright.llm.prefix_trie import conversation_trie
from tablewright.llm.running import running
from tablewright.llm.scratch import Scratch


def balanced(rnd, n):
    bits, depth = [True], 1
    while len(bits) < 2 * n:
        down = depth and (rnd.random() < 0.5 or len(bits) + depth >= 2 * n)
        bits.append(not down)
        depth += -1 if down else 1
    return np.array(bits)


@pytest.mark.parametrize("seed,n", [(1, 1), (2, 5), (3, 40), (4, 700), (5, 20_000)])
def test_parentheses(seed, n):
    bits = balanced(random.Random(seed), n)
    tree, stack, want = Parentheses(bits), [], {}
    for i, b in enumerate(bits.tolist()):
        if b:
            stack.append(i)
        else:
            want[stack.pop()] = i
    opens = tree.opens()
    closes = tree.find_close(opens)
    assert dict(zip(opens.tolist(), closes.tolist(), strict=True)) == want
    leaves = tree.leaves_between(opens, closes)
    for k in random.Random(0).sample(range(len(opens)), min(50, len(opens))):
        assert leaves[k] == sum(bits[i] and not bits[i + 1] for i in range(opens[k], closes[k]))


def test_deep_chain():
    bits = np.r_[np.ones(50_000, bool), np.zeros(50_000, bool)]
    tree = Parentheses(bits)
    assert (tree.find_close(tree.opens()) == 99_999 - np.arange(50_000)).all()


def test_running(spark):
    rows = [(0, i, 1) for i in range(500)] + [(g, 0, g) for g in range(1, 40)] + [(99, i, 2) for i in range(700)]
    with Scratch(spark) as scratch:
        df = spark.createDataFrame(rows, "g long, i long, v long").repartition(5)
        out = running(scratch, df, "g", [F.col("i")], {"total": "v"}).collect()
    want, at = {}, defaultdict(int)
    for g, i, v in sorted(rows):
        at[g] += v
        want[g, i] = at[g]
    assert {(r.g, r.i): r.total for r in out} == want and len(out) == len(rows)


def brute(turns):
    """Every node as a tuple of turns, every subtree gone through."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, path in whole.items():
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        saved[node] = sum(saved[k] for k in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(children[n]), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()) for n, m in members.items())


def got(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == columns
    return sorted(tuple(-1 if c == "parent_conv_id" and r[c] is None else r[c] for c in columns) for r in df.collect())


def table(spark, turns, parts=3):
    rows = [(*t, "x", 1) for t in turns]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string, depth int").repartition(parts)


def random_turns(seed, convs, longest, words):
    rnd = random.Random(seed)
    out = []
    for _ in range(convs):
        c = rnd.randrange(3 * convs) * rnd.choice([1, 1, 50])
        out += [(c, t, rnd.choice("ua"), rnd.choice(words)) for t in range(rnd.randint(1, longest))]
    # turn numbers of a conversation drawn twice: only distinct texts may share a number, so that order is told by role and text alone
    seen, kept = set(), []
    for t in out:
        if t[:2] not in seen:
            seen.add(t[:2])
            kept.append(t)
    return kept


@pytest.mark.parametrize("steps,seed", [(1, 1), (9, 2), (1 << 19, 3)])
def test_like_brute_force(spark, monkeypatch, steps, seed):
    monkeypatch.setattr(prefix_trie, "SHARD_STEPS", steps)
    turns = random_turns(seed, 120, 9, ["", "a", "bé😀", None])
    assert got(conversation_trie(table(spark, turns))) == brute(turns)


@pytest.mark.parametrize("steps", [3])
def test_copies_and_growing_ones(spark, monkeypatch, steps):
    """A third of all conversations alike, one with many turns twice, each longer than the one before."""
    monkeypatch.setattr(prefix_trie, "SHARD_STEPS", steps)
    same = [(c, t, "u", f"same {t}") for c in range(1000, 1060) for t in range(4)]
    long = [(c, t, "a", f"long {t}") for c in (4003, 4103) for t in range(300)]
    growing = [(7000 + k, t, "a", f"grow {t}") for k in range(40) for t in range(k + 1)]
    turns = same + long + growing
    assert got(conversation_trie(table(spark, turns, 5))) == brute(turns)


def test_edges(spark):
    assert conversation_trie(table(spark, [], 1)).collect() == []
    assert conversation_trie(table(spark, [(None, 0, "u", "a")])).collect() == []
    one = [(0, 0, "u", "a")]
    assert got(conversation_trie(table(spark, one))) == brute(one)
    turnless = [(c, 0, "u", "a") for c in (101, 103, 104) if zlib.crc32(str(c).encode()) % 6]
    assert turnless and got(conversation_trie(table(spark, turnless))) == brute(turnless) and len(brute(turnless)) == 1
    odd = [(c, t, r, x) for c in (-250, -200, -201, 7, 8, 12) for t, r, x in [(None, None, None), (None, "a", "x"), (0, "u", "x"), (0, "a", "x"), *[(k, "u", "y") for k in (1, 1, 2, 3, 4, 5)]]]
    assert got(conversation_trie(table(spark, odd))) == brute(odd)


def test_query_like_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    turns = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    assert got(QUERIES["op12_prefix_trie"](spark, folder)) == brute(turns)
    assert "op12_prefix_trie" in ORACLE
