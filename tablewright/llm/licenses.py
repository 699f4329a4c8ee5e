"""License scans by ordered signature rules.

A text is cut into words (A-Z lower-cased, every other ASCII character that is no letter or
digit parts words). One pass of a keyword automaton tells which rules may hold; only those
patterns run, over the words joined by one space. Overlapping detections are resolved by
priority, then length: what lies within the interval of a detection taken before is dropped.
Base phrases are counted at every place their words stand one after the other, whatever the
rules say.

Null text: read as empty, no words, score 0. A text is scanned whole. Rows are independent,
so repeated rows get equal results and an empty table gives an empty one. Columns of the input named
like a new one are replaced.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.llm.common import add_columns, text_buffers
from tablewright.llm.license_rules import RULES

# The base phrases and their labels.
BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Trust in a detection by the priority of its rule.
TRUST = {4: 0.99, 3: 0.95, 2: 0.8, 1: 0.4}
FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,first:int,last:int,priority:int>>"
PART_OF_WORD = np.isin(np.arange(256), np.r_[ord("0") : ord("9") + 1, ord("A") : ord("Z") + 1, ord("a") : ord("z") + 1, 128:256])


@functools.lru_cache(1)
def rules():
    """The automaton from keywords to rule numbers, and the rules in order."""
    table, by_keyword = [], {}
    for line in RULES.strip().splitlines():
        priority, label, keywords, pattern = line.split(" ", 3)
        for keyword in keywords.split("|"):
            by_keyword.setdefault(keyword, []).append(len(table))
        table.append((int(priority), label, re.compile(rf"(?<!\S)(?:{pattern})(?!\S)")))
    automaton = ahocorasick.Automaton()
    for keyword, numbers in by_keyword.items():
        automaton.add_word(keyword, numbers)
    automaton.make_automaton()
    return automaton, table


def resolve(found: list[tuple[int, int, int, str]], n_words: int) -> list[tuple[int, int, int, str]]:
    """Of (priority, first, end, label) those that no detection taken before contains, by place.

    A tree of maxima over the starts that occur tells the furthest end of those taken that
    begin at a place or before, so n detections take n log n steps.
    """
    found = sorted(set(found), key=lambda d: (-d[0], d[1] - d[2], d[1], d[3]))
    rank = {first: i + 1 for i, first in enumerate(sorted({d[1] for d in found}))}
    reach, kept = [0] * (len(rank) + 1), []
    for detection in found:
        _, first, end, _ = detection
        i, furthest = rank[first], 0
        while i:
            furthest = max(furthest, reach[i])
            i &= i - 1
        if furthest < end:
            kept.append(detection)
            i = rank[first]
            while i < len(reach):
                reach[i] = max(reach[i], end)
                i += i & -i
    return sorted(kept, key=lambda d: (d[1], d[2], d[3]))


def scan_text(raw: bytes) -> tuple:
    """Base places, base labels, and the detections that stand."""
    automaton, table = rules()
    low = raw.lower()
    hits = {n for _, numbers in automaton.iter(low.decode("utf-8", "replace")) for n in numbers}
    if not hits and b"license" not in low:
        return [], set(), []
    words = [w.decode("utf-8", "replace") for w in WORD.findall(low)]
    joined = " ".join(words)
    places, labels = [], set()
    for phrase, label in BASE.items():
        at = [i for i, w in enumerate(words) if w == phrase[0] and tuple(words[i : i + len(phrase)]) == phrase]
        places += at
        labels |= {label} if at else set()
    starts = np.cumsum([0] + [len(w) + 1 for w in words])
    found = []
    for n in sorted(hits):
        priority, label, pattern = table[n]
        for m in pattern.finditer(joined):
            first, end = np.searchsorted(starts, [m.start(), m.end()], side="left")
            found.append((priority, int(first), int(end), label))
    return places, labels, resolve(found, len(words))


def scan_licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` and, for each text, its words, base places, labels, score and detections."""

    def scan(column):
        data, offsets = text_buffers(column)
        inside = PART_OF_WORD[data]
        begins = inside & ~np.r_[False, inside[:-1]]
        firsts = offsets[:-1][np.diff(offsets) > 0]
        begins[firsts] = inside[firsts]
        total = np.r_[0, np.cumsum(begins, dtype=np.int32)]
        rows = []
        raw = data.tobytes()
        for a, b, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), (total[offsets[1:]] - total[offsets[:-1]]).tolist(), strict=True):
            places, base, found = scan_text(raw[a:b])
            doubt = 1.0
            for d in found:
                doubt *= 1 - TRUST[d[0]]
            rows.append({"n_words": n, "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
                         "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {d[3] for d in found})),
                         "score": 1 - doubt, "detections": [{"label": d[3], "first": d[1], "last": d[2] - 1, "priority": d[0]} for d in found]})
        kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(),
                 "labels": pa.string(), "score": pa.float64(),
                 "detections": pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("priority", pa.int32())]))}
        return [pa.array([r[k] for r in rows], t) for k, t in kinds.items()]

    return add_columns(df, text, FIELDS, lambda: scan)
