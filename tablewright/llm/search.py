"""Approximate nearest neighbours by collision counting.

Each vector is projected on ``PROJECTIONS`` lines (random orthogonal bases, one after the
other); a line keeps its block's projections as one sorted array. A query opens a window around
its own projection on every line; a vector inside is a collision. Windows widen by a factor
(virtual rehashing: no second index; only the entries a window gains are counted) until enough vectors of the block collide on a share
``THRESHOLD`` of the lines, and these are verified by exact inner products in double precision.

For the largest inner product, vectors get one more component that lifts all to one length;
the nearest to the query is then the one with the largest product.

Vectors are dealt into blocks of about ``BLOCK`` by a hash, queries into blocks of ``QUERIES``,
and every two blocks meet in a task of their own; the k best of each task are merged by a
ranking window over k rows of each block. Every vector is indexed. In every block at least a
share ``VERIFIED`` of the vectors, and ``LEAST_VERIFIED`` or k if that is more, is verified; recall at 20 is above
0.9 even where vectors have no structure, which is the worst case.

Vectors that are null, empty, zero or hold a null or non-finite component take no part;
shorter vectors count as filled up with zeros. Equal products go by smaller vec_id, null last. A
null vec_id is no query. Columns beside vec_id and embedding are read only by the condition on queries. Repeated rows are rows of their own, each a candidate of the other. An
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.jaccard import grouped
from tablewright.llm.scratch import Scratch
from tablewright.llm.vectors import inner, matrix, padded, usable

PROJECTIONS = 128
THRESHOLD = 0.8
WIDEN = 1.06
VERIFIED = 0.12
LEAST_VERIFIED = 150
BLOCK = 4096
QUERIES = 1024
SEED = 53
#: Entries of a window from which it is read as a slice, not entry by entry.
SLICED = 128


def lines(width: int) -> np.ndarray:
    """Random directions; each ``width`` of them are orthogonal."""
    draw = np.random.default_rng(SEED)
    bases = [np.linalg.qr(draw.normal(size=(width, width)))[0] * np.sqrt(width) for _ in range(-(-PROJECTIONS // width))]
    return np.concatenate(bases, 1)[:, :PROJECTIONS]


class Block:
    """A block's vectors in the order of their projections, line by line."""

    def __init__(self, projected: np.ndarray):
        order = np.argsort(projected, axis=0, kind="stable")
        self.values = np.take_along_axis(projected, order, 0).T.copy()
        self.order = order.T.ravel()
        self.projected = projected
        self.met = np.empty(order.size, np.intp)

    def places(self, at: np.ndarray, side: str) -> np.ndarray:
        """Where each query's value stands in the sorted array of each line, the arrays one after the other: (queries, lines)."""
        n = len(self.projected)
        return np.stack([line * n + np.searchsorted(v, at[:, line], side) for line, v in enumerate(self.values)], 1)

    def collisions(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each vector stands in the windows between such places."""
        lengths = end - begin
        total = int(lengths.sum())
        if total > SLICED * len(begin):
            met = np.concatenate([self.order[a:z] for a, z in zip(begin.tolist(), end.tolist(), strict=True)], out=self.met[:total])
        else:
            met = self.order[np.repeat(begin - np.cumsum(lengths) + lengths, lengths) + np.arange(total)]
        return np.bincount(met, minlength=len(self.projected)).astype(np.uint8)

    def first_reach(self, centre: np.ndarray, least: int, wanted: int) -> float:
        """The least, over some queries, of the reaches at which ``wanted`` vectors collide on ``least`` lines."""
        some = centre[:: max(1, len(centre) // 8)][:8]
        need = [np.partition(np.abs(self.projected - c), least - 1, axis=1)[:, least - 1] for c in some]
        return float(min(np.partition(t, wanted - 1)[wanted - 1] for t in need))

    def candidates(self, centre: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each query with the vectors to verify, ``k`` and the query itself at least.

        Counters stay as a window widens; only the entries it gains on both sides are visited.
        """
        n = len(self.projected)
        wanted = min(n, max(LEAST_VERIFIED, int(np.ceil(VERIFIED * n)), k + 1))
        least = int(np.ceil(THRESHOLD * len(self.values)))
        reach = max(self.first_reach(centre, least, wanted), 1e-9)
        low, high = self.places(centre - reach, "left"), self.places(centre + reach, "right")
        counts = np.stack([self.collisions(begin, end) for begin, end in zip(low, high, strict=True)])
        left = np.arange(len(centre))
        while len(left):
            waiting = []
            for q in left.tolist():
                near = np.flatnonzero(counts[q] >= least)
                if len(near) >= wanted:
                    yield q, near
                else:
                    waiting.append(q)
            left, reach = np.array(waiting, np.intp), reach * WIDEN
            wider = self.places(centre[left] - reach, "left"), self.places(centre[left] + reach, "right")
            for q, begin, end in zip(waiting, *wider, strict=True):
                counts[q] += self.collisions(np.concatenate([begin, high[q]]), np.concatenate([low[q], end]))
            low[left], high[left] = wider


def verified(x: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and inner products of the k largest, and of all that tie with the last."""
    score = inner(x, np.broadcast_to(query, x.shape))
    if len(score) <= k:
        return np.arange(len(score)), score
    at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at, score[at]


def best(query: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best: largest score, then smallest id."""
    order = np.lexsort((row, vec_id, -score, query))
    q = query[order]
    begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.r_[begin, len(q)]))
    return order[rank < k]


def search(vectors: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k largest inner products of each query row."""
    with Scratch(vectors.sparkSession) as scratch:
        able, width = padded(vectors.select("vec_id", "embedding", F.coalesce(queries, F.lit(False)).alias("asks")).filter(usable("embedding")), "embedding")
        rows = scratch.keep(able.withColumn("row", F.monotonically_increasing_id()))
        square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        n, asked, longest = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(square)).first()
        blocks, asks = max(1, -(-n // BLOCK)), max(1, -(-asked // QUERIES))
        held = vectors.sparkSession.sparkContext.broadcast((lines(width + 1), float(longest or 1)))
        drawn = F.xxhash64("row", F.lit(SEED))
        spread = F.explode(F.sequence(F.lit(0), F.lit(asks - 1)))
        listed = rows.select(F.pmod(drawn, F.lit(blocks)).cast("int").alias("lo"), spread.alias("hi"), F.lit(False).alias("asks"), "row", "vec_id", "embedding")
        spread = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        asking = rows.filter("asks").select(spread.alias("lo"), F.pmod(drawn, F.lit(asks)).cast("int").alias("hi"), F.lit(True).alias("asks"), "row", "vec_id", "embedding")
        tasks = listed.union(asking).repartition("lo", "hi").sortWithinPartitions("lo", "hi", "asks", "row")

        def work(table):
            los, his = table.column("lo").to_numpy(), table.column("hi").to_numpy()
            cuts = np.r_[0, np.flatnonzero((los[1:] != los[:-1]) | (his[1:] != his[:-1])) + 1, table.num_rows]
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield from task(table.slice(a, z - a))

        def task(table):
            asks, row = table.column("asks").to_numpy(), table.column("row").to_numpy()
            q, v = np.flatnonzero(asks), np.flatnonzero(~asks)
            if not len(q) or not len(v):
                return
            x = matrix(table.column("embedding"), width)
            ids = table.column("vec_id")
            key = np.array([np.iinfo(np.int64).max if i is None else i for i in ids.to_pylist()], np.int64)
            directions, square = held.value
            data = x[v].astype(np.float64) / np.sqrt(square)
            lifted = np.c_[data, np.sqrt(np.maximum(0, 1 - (data**2).sum(1)))]
            unit = x[q].astype(np.float64)
            unit /= np.sqrt((unit**2).sum(1, keepdims=True))
            pairs = [(np.zeros(0, np.intp), np.zeros(0, np.intp), np.zeros(0))]
            for asker, near in Block(lifted @ directions).candidates(np.c_[unit, np.zeros(len(q))] @ directions, k):
                i, near = q[asker], v[near]
                near = near[row[near] != row[i]]
                at, score = verified(x[near], x[i], k)
                pairs.append((np.full(len(at), i), near[at], score))
            i, j, score = (np.concatenate(column) for column in zip(*pairs, strict=True))
            top = best(i, score, key[j], row[j], k)
            i, j = pa.array(i[top]), pa.array(j[top])
            yield pa.RecordBatch.from_arrays([pa.array(row[i.to_numpy()]), ids.take(i).combine_chunks(), ids.take(j).combine_chunks(), pa.array(row[j.to_numpy()]), pa.array(score[top])],
                                             names=["asker", "query_id", "vec_id", "row", "score"])

        id_type = rows.schema["vec_id"].dataType.simpleString()
        found = tasks.mapInArrow(lambda batches: grouped(batches, ["lo", "hi"], work), f"asker bigint, query_id {id_type}, vec_id {id_type}, row bigint, score double")
        order = Window.partitionBy("asker").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return scratch.result(ranked.select("query_id", "rank", "vec_id", "score"))
