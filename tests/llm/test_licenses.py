import re
from itertools import product

import pytest

from tablewright.llm import QUERIES, licenses
from tablewright.llm.license_rules import RULES
from tablewright.llm.licenses import resolve, rules, scan_licenses, scan_text

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def brute(text):
    """Base columns from the words, one by one."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in at}))


def scanned(spark, texts):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, score int").repartition(3)
    rows = {r.doc_id: r for r in scan_licenses(df).collect()}
    return [rows[i] for i in range(len(texts))]


TEXTS = [None, "", "...", "The MIT License", "mit\nLICENSE mit-license; MITlicense", "éMIT license, mit licenseé", "Apache License, Version 2.0",
         "GNU General Public License, version 3. general public license", "KK mit license", "x " * 40_000 + "released under the MIT license",
         "same mit license", "same mit license", "ohne lizenz", "\x7fmit\x00license\x80"]


def test_base_columns_like_brute_force(spark):
    for text, r in zip(TEXTS, scanned(spark, TEXTS), strict=True):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), text
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_rules(spark):
    assert len(rules()[1]) >= 200
    texts = ["Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
             "released under CC BY-NC 4.0", "nothing here", "SPDX-License-Identifier: BSD-3-Clause"]
    got = [r.labels for r in scanned(spark, texts)]
    assert got == ["apache,apache-2.0", "gpl,gpl-3.0", "cc-by-nc-4.0", "", "bsd-3-clause"]


def test_containment():
    found = [(3, 0, 6, "a"), (1, 2, 4, "b"), (2, 4, 8, "c"), (1, 0, 9, "d"), (3, 0, 6, "a")]
    assert resolve(found, 10) == [(3, 0, 6, "a"), (1, 0, 9, "d"), (2, 4, 8, "c")]


def test_containment_like_comparing_all():
    import random

    rnd = random.Random(3)
    for _ in range(200):
        found = [(rnd.randint(1, 3), a := rnd.randint(0, 30), a + rnd.randint(1, 9), rnd.choice("ab")) for _ in range(rnd.randint(0, 40))]
        kept = []
        for d in sorted(set(found), key=lambda d: (-d[0], d[1] - d[2], d[1], d[3])):
            if not any(k[1] <= d[1] and k[2] >= d[2] for k in kept):
                kept.append(d)
        assert resolve(found, 40) == sorted(kept, key=lambda d: (d[1], d[2], d[3]))


def test_many_detections_in_one_text():
    import time

    began = time.process_time()
    places, labels, found = scan_text(b"released under the mit license. " * 200_000)
    assert len(places) == 200_000 and labels == {"mit"} and len(found) >= 200_000
    assert time.process_time() - began < 60


def test_empty_and_query(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in QUERIES["op1_licenses"](spark, folder).collect()}
    for d in spark.read.parquet(f"{folder}/documents.parquet").collect():
        r = rows[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(d.text)


def branches(parsed):
    """A sample of each way through a parsed pattern."""
    ways = []
    for op, arg in parsed:
        match str(op):
            case "LITERAL":
                ways.append([chr(arg)])
            case "ANY":
                ways.append(["x"])
            case "IN":
                ways.append([chr(a) if str(o) == "LITERAL" else "4" for o, a in arg])
            case "SUBPATTERN":
                ways.append(branches(arg[3]))
            case "BRANCH":
                ways.append([w for b in arg[1] for w in branches(b)])
            case "MAX_REPEAT":
                once = branches(arg[2])
                ways.append([*([""] if arg[0] == 0 else []), *once])
            case "ASSERT_NOT":
                pass
            case _:
                raise ValueError(op)
    return ["".join(w) for w in product(*ways)]


class Everywhere:
    """A gate that lets every rule run."""

    def iter(self, text):
        return [(0, range(len(rules()[1])))]


def test_the_gate_hides_no_branch(monkeypatch):
    texts = []
    for n, line in enumerate(RULES.strip().splitlines()):
        pattern = line.split(" ", 3)[3]
        for sample in branches(re._parser.parse(pattern)):
            assert n in {i for _, numbers in rules()[0].iter(sample) for i in numbers}, (line, sample)
            texts.append(sample)
    gated = [scan_text(t.encode()) for t in texts]
    monkeypatch.setattr(licenses, "rules", lambda table=rules()[1]: (Everywhere(), table))
    assert len(texts) > 2000 and gated == [scan_text(t.encode()) for t in texts]


@pytest.mark.parametrize("text, label", [
    ("licensed under the Server Side Public License", "sspl-1.0"), ("released under the Open Font License", "ofl-1.1"), ("PSF License", "python-2.0"),
    ("This software contains proprietary information", "proprietary"), ("Creative Commons Attribution-Non-Commercial 4.0", "cc-by-nc-4.0"),
    ("Creative Commons Attribution-Share Alike 3.0", "cc-by-sa-3.0"), ("Library General Public License version 2.1", "lgpl-2.1"),
    ("see the license file: MIT license", "mit"), ("released under the Public Domain Dedication and License", "pddl"),
    ("Creative Commons Attribution No Derivatives 4.0", "cc-by-nd-4.0")])
def test_branches_without_the_first_keyword(text, label):
    assert label in {d[3] for d in scan_text(text.encode())[2]}


def brute_detections(text):
    """Every rule over the whole text without a gate; a detection goes if one of a better rule, or a longer
    one of an equal rule, holds all its words. Labels, score and (first, last, label, priority)."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    joined = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))
    found = set()
    for line in RULES.strip().splitlines():
        priority, label, _, pattern = line.split(" ", 3)
        for m in re.finditer(rf"(?<![^ ])(?:{pattern})(?![^ ])", joined):
            first = joined[: m.start()].count(" ")
            found.add((-int(priority), -len(m.group().split(" ")), first, label))
    kept = []
    for priority, size, first, label in sorted(found):
        if not any(f <= first and l >= first - size - 1 for f, l, _, _ in kept):
            kept.append((first, first - size - 1, label, -priority))
    doubt = 1.0
    for d in kept:
        doubt *= 1 - {4: 0.99, 3: 0.95, 2: 0.8, 1: 0.4}[d[3]]
    return ",".join(sorted({d[2] for d in kept} | set(filter(None, brute(text)[4].split(","))))), 1 - doubt, sorted(kept)


def test_detections_like_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [d.text for d in docs.collect()] + [t for t in TEXTS if len(t or "") < 1000]
    mixed = ["Licensed under the Apache License, Version 2.0; the GNU General Public License version 3 or later, and CC BY-SA 4.0. MIT License",
             "SPDX-License-Identifier: BSD-3-Clause. GNU Lesser General Public License version 2.1, Mozilla Public License 2.0 " * 7]
    texts += mixed
    hits = 0
    for text, r in zip(texts, scanned(spark, texts), strict=True):
        labels, score, kept = brute_detections(text)
        assert r.labels == labels and abs(r.score - score) < 1e-12, text
        assert sorted((d.first, d.last, d.label, d.priority) for d in r.detections) == kept
        hits += len(kept)
    assert hits > 20
