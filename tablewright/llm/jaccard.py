"""N-gram Jaccard join by MinHash banding.

Texts are sets of five-word n-grams; a text of one to four words is one n-gram of all its
words (words are lower-cased and parted by white space). Texts with the same set are one class,
kept once with its number of copies. Bands and rows are chosen so that a pair at the threshold
shares a band with at least ``RECALL`` probability. Classes are shuffled on their band hashes;
in a band's bucket, pairs whose signatures are far below the threshold are passed over (the
margin is over five standard deviations), the others are joined into groups. A group's whole
n-gram sets are then brought together once and every pair in it is verified on them, so links
are exact and none below the threshold is kept.

Large buckets and groups are dealt into blocks by a hash, and every two blocks meet in a task
of their own; a task gives counts and a spanning forest, never the pairs. So no bucket is too
large to be whole, none is capped, and memory is that of two blocks.

Null and empty texts: no n-grams, no links, a class of their own. Null doc_id: a row like any
other, ids below come from the rest of its class if there are any. Repeated rows are copies.
An empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import add_columns, fresh
from tablewright.llm.components import components, local_roots
from tablewright.llm.scratch import Scratch

WORDS = 5
#: The least similarity of a link, as a fraction.
LEAST = (4, 5)
RECALL = 0.9998
#: Values of a signature that are kept, as 16 bits each, to pass over pairs in a bucket.
SKETCH = 96
#: Pairs whose sketches agree in a smaller share are far from a similarity of 0.8.
SKETCH_LEAST = 0.58
#: Rows of a block, on average.
BLOCK = 256
WORDS_KEPT = 100_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def choose_bands(threshold: float, recall: float, rows: range = range(3, 11)) -> tuple[int, int]:
    """(bands, rows) with the fewest chance collisions that 200 hashes afford at this recall."""
    fits = [(math.ceil(math.log(1 - recall) / math.log(1 - threshold**r)), r) for r in rows]
    return max((f for f in fits if f[0] * f[1] <= 200), key=lambda f: f[1])


BANDS, ROWS = choose_bands(LEAST[0] / LEAST[1], RECALL)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(32))


class Shingles:
    """Hashes of the n-grams of texts; remembers the hashes of words."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def sets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct n-gram hashes of all texts one after the other, and the row offsets."""
        each = [t.lower().split() for t in texts]
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        for w in {w for ws in each for w in ws}.difference(self.known):
            self.known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        sizes = np.array([len(ws) for ws in each], np.int64)
        flat = np.fromiter((self.known[w] for ws in each for w in ws), np.uint64, int(sizes.sum()))
        row = np.repeat(np.arange(len(texts)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # words from here to the text's end
        first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
        padded = np.r_[flat, np.zeros(WORDS, np.uint64)]
        grams = np.zeros(len(flat), np.uint64)
        for i in range(WORDS):
            grams = np.where(left > i, mixed(grams + padded[i : len(flat) + i]) * MIX[0], grams)
        grams = mixed(grams)
        begins = (left >= WORDS) | (first & (left < WORDS))
        grams, row = grams[begins], row[begins]
        order = np.lexsort((grams, row))
        grams, row = grams[order], row[order]
        new = np.r_[True, (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])] if len(row) else np.zeros(0, bool)
        grams, row = grams[new], row[new]
        return grams, np.r_[0, np.cumsum(np.bincount(row, minlength=len(texts)))]


def signatures(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values, one row for each text that has n-grams."""
    draw = np.random.default_rng(20)
    odd = draw.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), BANDS * ROWS), np.uint32)
    for i in range(BANDS * ROWS if len(starts) else 0):
        out[:, i] = np.minimum.reduceat(x * odd[i] + add[i], starts)
    return out


def band_hashes(values: np.ndarray) -> np.ndarray:
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(values), BANDS)).copy()
    for r in range(ROWS):
        h = mixed(h + values[:, r::ROWS].astype(np.uint64) + np.uint64(1)) * MIX[0]
    return h.view(np.int64)


def sign(df: DataFrame, text: str) -> DataFrame:
    """``df`` with key (digest of the n-gram set, null if there is none), grams, bands and sketch."""

    def factory():
        shingles = Shingles()

        def scan(column):
            grams, offsets = shingles.sets(column.fill_null("").to_pylist())
            sizes = np.diff(offsets)
            raw = grams.tobytes()
            keys = [xxhash.xxh3_128_hexdigest(raw[8 * a : 8 * b]) if b > a else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            values = signatures(grams, offsets)
            bands, place = band_hashes(values), np.cumsum(sizes > 0) - 1
            sketch = (values[:, :SKETCH] & np.uint32(0xFFFF)).astype(np.uint16)
            filled = (sizes > 0).tolist()
            return [pa.array(keys, pa.string()), pa.array(sizes.astype(np.int32)),
                    pa.array([bands[p] if f else None for f, p in zip(filled, place, strict=True)], pa.list_(pa.int64())),
                    pa.array([sketch[p].tobytes() if f else None for f, p in zip(filled, place, strict=True)], pa.binary())]

        return scan

    return add_columns(df, text, "key string, grams int, bands array<bigint>, sketch binary", factory)


def grouped(batches, names: list[str], work, most: int = 1024):
    """Call ``work`` on Arrow tables of whole groups (rows equal in ``names``, which stand together):
    as many groups as have ``most`` rows, or one larger one."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        columns = [table.column(c).to_numpy() for c in names]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if table.num_rows else np.zeros(0, int)
        at = 0
        while len(change) and at < change[-1]:
            to = int(change[max(np.searchsorted(change, at + most, side="right") - 1, np.searchsorted(change, at, side="right"))])
            yield from work(table.slice(at, to - at))
            at = to
        rest = table.slice(at)
    if rest is not None and rest.num_rows:
        yield from work(rest.combine_chunks())


def in_blocks(df: DataFrame, key: str, size: str, by: str, block: int = BLOCK) -> DataFrame:
    """Each row once for each task it takes part in: ``lo``, ``hi`` (the two blocks) and ``own`` (its block).

    A key with ``size`` rows has a block for every ``block`` rows.
    """
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(F.col(by), F.lit(3)), blocks).cast("int")
    placed = df.withColumn("own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select(*df.columns, "own", F.least("own", "_other").alias("lo"), F.greatest("own", "_other").alias("hi"))
    return placed.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi", by)


def near_in_buckets(members: DataFrame) -> DataFrame:
    """Spanning forest (a, b) of the pairs of each bucket whose sketches and sizes are near enough."""

    def work(table):
        band, lo, hi, own, ids, grams = (table.column(c).to_numpy() for c in ("band", "lo", "hi", "own", "id", "grams"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, SKETCH)
        new = np.r_[True, (band[1:] != band[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
        group = np.cumsum(new) - 1
        left, right = [], []
        here = np.arange(len(ids))
        for d in range(1, len(ids)):
            here = here[here + d < len(ids)]
            here = here[group[here] == group[here + d]]
            if not len(here):
                break
            a, b = here, here + d
            near = (own[a] != own[b]) | (lo[a] == hi[a])
            small, large = np.minimum(grams[a], grams[b]), np.maximum(grams[a], grams[b])
            near &= small.astype(np.int64) * LEAST[1] >= large.astype(np.int64) * LEAST[0]
            a, b = a[near], b[near]
            near = (sketch[a] == sketch[b]).mean(1) >= SKETCH_LEAST if len(a) else np.zeros(0, bool)
            left.append(a[near])
            right.append(b[near])
        nodes, place = np.unique(ids, return_inverse=True)
        if left:
            root = local_roots(place[np.concatenate(left)], place[np.concatenate(right)], len(nodes))
            moved = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["a", "b"])

    return members.mapInArrow(lambda batches: grouped(batches, ["band", "lo", "hi"], work), "a bigint, b bigint")


def verified(members: DataFrame) -> DataFrame:
    """(id, links, root) for the rows of each group's tasks that have a link there: exact similarities."""

    def work(table):
        columns = [table.column(c).to_numpy() for c in ("comp", "lo", "hi")]
        cuts = np.r_[0, np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1, table.num_rows]
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if z - a > 1:
                yield from task(table.slice(a, z - a))

    def task(table):
        ids, own, copies, lo, hi = (table.column(c).to_numpy() for c in ("id", "own", "copies", "lo", "hi"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        row = np.repeat(np.arange(len(sets)), sizes)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        rank = np.cumsum(np.r_[True, flat[1:] != flat[:-1]]) - 1
        shared = np.bincount(rank) > 1
        row, rank = row[shared[rank]], (np.cumsum(shared) - 1)[rank[shared[rank]]]
        common = np.zeros((len(sets), len(sets)), np.int64)
        for begin in range(0, int(shared.sum()), 4096):  # rank is sorted, so a run of n-grams is a slice
            part = slice(*np.searchsorted(rank, [begin, begin + 4096]))
            dense = np.zeros((len(sets), 4096), np.float32)
            dense[row[part], rank[part] - begin] = 1
            common += (dense @ dense.T).astype(np.int64)
        union = sizes[:, None] + sizes[None, :] - common
        link = (common * LEAST[1] >= union * LEAST[0]) & ~np.eye(len(sets), dtype=bool)
        if lo[0] != hi[0]:
            link &= own[:, None] != own[None, :]
        if link.any():
            root = local_roots(*np.nonzero(np.triu(link)), len(sets))
            some = np.flatnonzero(link.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array((link @ copies)[some]), pa.array(ids[root[some]])], names=["id", "links", "root"])

    return members.mapInArrow(lambda batches: grouped(batches, ["comp", "lo", "hi"], work), "id bigint, links bigint, root bigint")


def shingle_sets(df: DataFrame, text: str) -> DataFrame:
    def factory():
        shingles = Shingles()

        def scan(column):
            grams, offsets = shingles.sets(column.fill_null("").to_pylist())
            return [pa.array([grams[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())]

        return scan

    return add_columns(df, text, "shingles binary", factory).drop(text)


def link(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, print (hash of the text), n_links, class_id and first.

    ``n_links`` counts the other documents linked directly, copies included; ``class_id`` is
    the smallest doc_id reachable over links; ``first`` is true for the smallest
    (doc_id, print) of the class, the one to keep.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("print"))
    signed = scratch.keep(sign(named, "text").drop("text"))
    classes = signed.filter("key is not null").groupBy("key").agg(
        F.min(F.struct("doc_id", "print")).alias("rep"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("grams").alias("grams"),
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = scratch.keep(classes.withColumn("id", F.monotonically_increasing_id()))
    banded = classes.select("id", F.explode("bands").alias("band"))
    shared = scratch.keep(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    # sorted merges at every size: Spark splits their hot keys, and nothing is broadcast that grows
    members = banded.join(shared.hint("merge"), "band").join(classes.select("id", "grams", "sketch").hint("merge"), "id")
    groups = scratch.keep(components(near_in_buckets(in_blocks(members, "band", "n", "id")), scratch).select(F.col("node").alias("id"), F.col("root").alias("comp")))
    sizes = scratch.keep(groups.groupBy("comp").agg(F.count(F.lit(1)).alias("n")))
    chosen = groups.join(sizes, "comp").join(classes.select("id", "copies", "rep"), "id")
    chosen = scratch.keep(chosen.select("id", "comp", "n", "copies", F.col("rep.doc_id").alias("rep_id"), F.col("rep.print").alias("rep_print")))
    texts = named.join(chosen.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("print") == F.col("rep_print")))
    texts = texts.groupBy("id").agg(F.first("comp").alias("comp"), F.first("n").alias("n"), F.first("copies").alias("copies"), F.first("text").alias("text"))
    found = scratch.keep(verified(in_blocks(shingle_sets(texts, "text"), "comp", "n", "id", BLOCK // 2)))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    reps = classes.select("id", "key", "rep", "least", "copies").join(roots.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left")
    reps = scratch.keep(reps.withColumn("root", F.coalesce("root", "id")))
    heads = scratch.keep(reps.groupBy("root").agg(F.min("least").alias("class_id"), F.min("rep").alias("head")))
    resolved = scratch.keep(reps.join(heads, "root").select(F.col("key").alias("_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"), "class_id", "head"))
    # a row without n-grams gets a key of its own, so that these rows do not meet in one task
    alone = F.coalesce("key", F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    rows = signed.select("doc_id", "print", alone.alias("key")).join(resolved.hint("merge"), F.col("key") == F.col("_key"), "left")
    first = F.coalesce(F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("print") == F.col("head.print")), F.lit(True))
    return rows.select("doc_id", "print", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
                       F.when(F.col("_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), first.alias("first"),
                       F.col("_key").isNotNull().alias("able"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_links, class_id and kept for each document."""
    with Scratch(docs.sparkSession) as scratch:
        return scratch.result(link(docs, scratch).select("doc_id", "n_links", "class_id", F.col("first").alias("kept")))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest (doc_id, hash of text).

    Rows equal in doc_id and text count as one; documents without words all stay.
    """
    with Scratch(docs.sparkSession) as scratch:
        mark, an_id, a_print = (fresh(docs, c) for c in ("text_print", "kept_id", "kept_print"))
        # whether a text has words is decided in one place, by its n-grams
        found = scratch.result(link(docs, scratch).filter("first or not able").select(F.col("doc_id").alias(an_id), F.col("print").alias(a_print), "able").distinct())
        kept, wordless = found.filter("able").drop("able"), found.filter("not able").drop("able")
        hashed = docs.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
        same = F.col("doc_id").eqNullSafe(F.col(an_id)) & (F.col(mark) == F.col(a_print))
        some = hashed.join(kept.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", mark])
        # a text with visible ASCII has words and need not be moved
        rest = hashed.filter(~F.coalesce(F.col("text").rlike("[!-~]"), F.lit(False))).join(wordless.hint("merge"), same, "left_semi")
        return some.unionByName(rest).select(*docs.columns)


#: The same rows in DuckDB's SQL, by comparing all pairs that share an n-gram; for small tables with unique doc_ids.
SQL = f"""
with recursive d as materialized (select row_number() over () as r, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') as w from documents),
s as materialized (select distinct r, unnest(case when len(w) = 0 then [] when len(w) < {WORDS} then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) end) as g from d),
n as materialized (select r, count(*) as n from s group by r),
c as (select a.r as a, b.r as b, count(*) as c from s a join s b on a.g = b.g and a.r <> b.r group by all),
links as materialized (select a, b from c join n x on x.r = a join n y on y.r = b where {LEAST[1]} * c >= {LEAST[0]} * (x.n + y.n - c)),
reach as (select r as a, r as b from d union select reach.a, links.b from reach join links on reach.b = links.a),
m as (select a, count(*) as n from links group by a),
k as (select reach.a, min(d.doc_id) as class_id from reach join d on d.r = reach.b group by reach.a)
select doc_id, coalesce(m.n, 0) as n_links, class_id, doc_id is not distinct from class_id as kept
from d left join m on m.a = d.r left join k on k.a = d.r
"""
