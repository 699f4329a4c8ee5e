"""Embedding near-dedup by product quantisation.

Vectors with the same label and content are one class, kept once with its number of copies.
Unit vectors go to the nearest of the coarse centroids; what is left of them is coded by the
nearest codeword in each subspace. A search for links probes the inverted lists with tables of
subspace distances, and what these cannot rule out is compared exactly.

Nothing is lost. A vector within distance r of another can only lie in cells whose borders
come within r of it, and those are the cells probed. A list entry is ruled out only if its
table distance exceeds r by more than its own coding error. Centroids and codewords are fitted
on a bounded sample (``SAMPLE`` vectors at most); a poor fit costs time, not links. Cells grow with
the square root of the table: beyond ``MOST_CENTRES`` centroids each cell is cut again, by the nearest of
further centroids of what is left, with the same rule for borders.

Lists and the vectors that probe them are dealt into blocks by a hash, and every block of a
list meets every block of its probers in a task of its own; a task gives counts and a spanning
forest, never the pairs.

Null labels, and vectors that are null, empty, zero or hold a null or non-finite component,
link with nothing; vectors of different lengths do not link. Repeated rows are copies. A row
whose vec_id is null takes part; a class of such rows only has a null id. An empty table gives
an empty one. Columns beside vec_id, label and embedding are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.components import components, local_roots
from tablewright.llm.jaccard import grouped
from tablewright.llm.scratch import Scratch
from tablewright.llm.vectors import inner, matrix, padded, usable

LEAST_COSINE = 0.98
SAMPLE = 8192
MOST_CENTRES = 1024
SUBSPACES = 16
CODEWORDS = 256
#: Centroids near a vector whose borders with the others are looked at.
BORDERS = 8
BLOCK = 512
SEED = 41
#: Room for rounding in distances between unit vectors.
SLACK = 1e-4
#: Vectors whose parts of cells are looked at together.
PROBED = 4096


def lloyd(x: np.ndarray, k: int, rounds: int, draw: np.random.Generator) -> np.ndarray:
    """k-means centres; an empty one takes a drawn vector."""
    centres = x[draw.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = nearest(x, centres)[0]
        counts = np.bincount(own, minlength=len(centres))
        order = np.argsort(own, kind="stable")
        filled = np.flatnonzero(counts)
        sums = np.add.reduceat(x[order], (np.cumsum(counts) - counts)[filled])
        centres = x[draw.choice(len(x), len(centres))].copy()
        centres[filled] = sums / counts[filled, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre, and all squared distances."""
    d = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
    return d.argmin(1), d


class Cells:
    """Centroids, and which of their cells come within reach of a vector."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        self.between = np.sqrt(np.maximum(nearest(centres, centres)[1], 1e-12))

    def probe(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        own, d = nearest(x, self.centres)
        near = np.argsort(d, axis=1)[:, :BORDERS]
        probe = np.ones(d.shape, bool)
        for i in near.T:  # the border with cell j is (d_j - d_i) / (2 |c_i c_j|) away
            probe &= d - np.take_along_axis(d, i[:, None], 1) <= 2 * (reach + SLACK) * self.between[i]
        probe[np.arange(len(own)), own] = True
        return own, probe


class Index:
    """Coarse centroids, further ones that cut each cell, and, for each subspace, codewords of what is left."""

    def __init__(self, sample: np.ndarray, cells: int):
        draw = np.random.default_rng(SEED)
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.coarse = Cells(lloyd(unit, min(cells, MOST_CENTRES, len(unit)), 8, draw))
        self.centres = self.coarse.centres
        left = unit - self.centres[nearest(unit, self.centres)[0]]
        self.words = [lloyd(part, CODEWORDS, 6, draw) for part in self.split(left).transpose(1, 0, 2)]
        #: Parts of a cell; as many as bring the cells to the number asked for, one centroid to a vector of the sample at most.
        self.parts = min(-(-cells // len(self.centres)), len(left))
        self.fine = Cells(lloyd(left, self.parts, 8, draw)) if self.parts > 1 else None

    def split(self, x: np.ndarray) -> np.ndarray:
        wide = -(-x.shape[1] // SUBSPACES) * SUBSPACES
        return np.pad(x, ((0, 0), (0, wide - x.shape[1]))).reshape(len(x), SUBSPACES, -1)

    def place(self, unit: np.ndarray, reach: float) -> tuple[np.ndarray, ...]:
        """Codes and coding error of each vector; then row, cell and whether it is the row's own, for each cell that comes within ``reach``."""
        own, probe = self.coarse.probe(unit, reach)
        rest = self.split(unit - self.centres[own])
        codes = np.stack([nearest(rest[:, s], w)[0] for s, w in enumerate(self.words)], 1).astype(np.uint8)
        coded = np.stack([w[codes[:, s]] for s, w in enumerate(self.words)], 1)
        error = np.sqrt(((rest - coded) ** 2).sum((1, 2)))
        row, cell = np.nonzero(probe)
        home = own[row] == cell
        if self.fine is not None:
            rows, cells, homes = [], [], []
            for at in range(0, len(row), PROBED):
                r, c, h = row[at:at + PROBED], cell[at:at + PROBED], home[at:at + PROBED]
                part, near = self.fine.probe(unit[r] - self.centres[c], reach)
                i, j = np.nonzero(near)
                rows.append(r[i])
                cells.append(c[i] * self.parts + j)
                homes.append(h[i] & (part[i] == j))
            row, cell, home = (np.concatenate([*x, np.zeros(0, t)]) for x, t in ((rows, np.intp), (cells, np.intp), (homes, bool)))
        return codes, error, row, cell, home

    def table(self, unit: np.ndarray, cell: int) -> np.ndarray:
        """Squared distance of each vector's part, taken from the cell's centroid, to each codeword: (vectors, subspaces, codewords)."""
        rest = self.split(unit - self.centres[cell // self.parts])
        return np.stack([np.pad(np.maximum(nearest(rest[:, s], w)[1], 0), ((0, 0), (0, CODEWORDS - len(w)))) for s, w in enumerate(self.words)], 1).astype(np.float32)


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt(inner(x, x))
    return x / norm[:, None], norm


def link(vectors: DataFrame, scratch: Scratch, least: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links and component_id of each row."""
    reach = float(np.sqrt(2 - 2 * least))
    able = F.col("label").isNotNull() & usable("embedding")
    named = vectors.select("vec_id", "label", "embedding").withColumn("able", able)
    prints = [F.when(F.col("able"), F.xxhash64(F.lit(i), F.col("label"), F.col("embedding"))) for i in (1, 2)]
    named = named.withColumns({"h1": prints[0], "h2": prints[1]})
    classes = named.filter("able").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = classes.withColumn("size", F.size("embedding"))
    flat, width = padded(classes, "embedding")
    classes = scratch.keep(flat.withColumn("id", F.monotonically_increasing_id()))
    n = classes.count()
    spark = vectors.sparkSession
    if not n:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    share = int(min(1, SAMPLE / n) * (1 << 30))
    drawn = classes.filter(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) < share).select("id", "embedding").collect()
    if not drawn:
        drawn = classes.select("id", "embedding").limit(1).collect()
    sample = np.array([r.embedding for r in sorted(drawn, key=lambda r: r.id)], np.float64)
    cells = max(1, round(np.sqrt(n) / 8))
    index = spark.sparkContext.broadcast(Index(sample, cells))

    def place(batches):
        for batch in batches:
            x = matrix(batch.column("embedding"), width)
            codes, error, row, cell, home = index.value.place(unit_rows(x)[0], reach)
            kept = [batch.column(c).take(pa.array(row)) for c in ("label", "size", "id", "copies", "embedding")]
            codes = pa.array([c.tobytes() for c in codes], pa.binary()).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*kept, codes, pa.array(error[row]), pa.array(cell.astype(np.int32)), pa.array(home)],
                                             names=["label", "size", "id", "copies", "embedding", "codes", "error", "cell", "home"])

    label, embedding = (classes.schema[c].dataType.simpleString() for c in ("label", "embedding"))
    probing = scratch.keep(classes.select("label", "size", "id", "copies", "embedding").mapInArrow(
        place, f"label {label}, size int, id bigint, copies bigint, embedding {embedding}, codes binary, error double, cell int, home boolean"))
    key = ["label", "size", "cell"]
    counts = scratch.keep(probing.groupBy(*key).agg(F.count(F.lit(1)).alias("n_probing"), F.count_if("home").alias("n_listed")).filter("n_listed > 0 and n_probing > 1"))
    dealt = probing.join(counts, key).withColumn("drawn", F.xxhash64("id", F.lit(5)))
    lists, probes = F.ceil(F.col("n_listed") / BLOCK).cast("int"), F.ceil(F.col("n_probing") / BLOCK).cast("int")
    listed = dealt.filter("home").withColumns({"lo": F.pmod("drawn", lists).cast("int"), "hi": F.explode(F.sequence(F.lit(0), probes - 1)), "listed": F.lit(True)})
    asking = dealt.withColumns({"hi": F.pmod("drawn", probes).cast("int"), "lo": F.explode(F.sequence(F.lit(0), lists - 1)), "listed": F.lit(False)})
    columns = [*key, "lo", "hi", "listed", "id", "copies", "embedding", "codes", "error"]
    tasks = listed.select(*columns).union(asking.select(*columns)).repartition(*key, "lo", "hi").sortWithinPartitions(*key, "lo", "hi", "listed", "id")

    def work(table):
        columns = [table.column(c).to_numpy() for c in (*key, "lo", "hi")]
        cuts = np.r_[0, np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1, table.num_rows]
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield from task(table.slice(a, z - a))

    def task(table):
        listed = table.column("listed").to_numpy()
        ids, copies, error = (table.column(c).to_numpy() for c in ("id", "copies", "error"))
        x = matrix(table.column("embedding"), width)
        unit, norm = unit_rows(x)
        asks, lists = np.flatnonzero(~listed), np.flatnonzero(listed)
        if not len(asks) or not len(lists):
            return
        codes = np.frombuffer(b"".join(table.column("codes").take(pa.array(lists)).to_pylist()), np.uint8).reshape(-1, SUBSPACES)
        tables = index.value.table(unit[asks], int(table.column("cell")[0].as_py()))
        far = np.zeros((len(asks), len(lists)), np.float32)
        for s in range(SUBSPACES):
            far += tables[:, s][:, codes[:, s]]
        i, j = np.nonzero(far <= ((reach + error[lists] + SLACK) ** 2)[None, :])
        i, j = asks[i], lists[j]
        other = ids[i] != ids[j]
        i, j = i[other], j[other]
        good = inner(x[i], x[j]) / (norm[i] * norm[j]) >= least
        i, j = i[good], j[good]
        if len(i):
            nodes, place = np.unique(ids, return_inverse=True)
            root = local_roots(place[i], place[j], len(nodes))
            links = np.bincount(place[i], copies[j], len(nodes)).astype(np.int64)
            some = np.flatnonzero((links > 0) | (root != np.arange(len(nodes))))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(links[some]), pa.array(nodes[root[some]])], names=["id", "links", "root"])

    found = scratch.keep(tasks.mapInArrow(lambda batches: grouped(batches, [*key, "lo", "hi"], work), "id bigint, links bigint, root bigint"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    reps = classes.select("id", "h1", "h2", "least", "copies").join(roots.withColumnRenamed("node", "id"), "id", "left").join(sums, "id", "left")
    reps = scratch.keep(reps.withColumn("root", F.coalesce("root", "id")))
    heads = reps.groupBy("root").agg(F.min("least").alias("component"))
    resolved = scratch.keep(reps.join(heads, "root").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component"))
    linked = named.filter("able").join(resolved, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    return linked.unionByName(named.filter("not able").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vec_id, embedding and label."""
    with Scratch(vectors.sparkSession) as scratch:
        return scratch.result(link(vectors, scratch, least).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


#: The same rows in DuckDB's SQL, by comparing all pairs; for small tables.
SQL = f"""
with recursive e as materialized (select row_number() over () as r, vec_id, label, embedding::double[] as v from embeddings),
able as materialized (select * from e where label is not null and v is not null
  and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
links as materialized (select a.r as a, b.r as b from able a join able b on a.label = b.label and len(a.v) = len(b.v) and a.r <> b.r
  where list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= {LEAST_COSINE}),
reach as (select r as a, r as b from e union select reach.a, links.b from reach join links on reach.b = links.a),
n as (select a, count(*) as n from links group by a),
c as (select reach.a, min(e.vec_id) as component_id from reach join e on e.r = reach.b group by reach.a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id is not distinct from component_id as kept
from e left join n on n.a = e.r left join c on c.a = e.r
"""
