"""Records of text files that run over line breaks, read by many tasks.

Spark cuts a large file into splits at any line. Whether a split begins inside a quoted cell,
or how deep inside brackets, is told by what stands before it. So each split is read twice. The
first pass works out what the split does to any state it may begin in: two outcomes for a
quoted cell or a string (begun inside or outside), and a change of depth for brackets. These are
put together file by file, a short row for each split, which gives the state each split
begins in. The second pass cuts the split into records. What stands before its first record
border belongs to a record begun earlier, and its last record may go on in the next split; these
leftovers, two for each split at most, are joined in the order of the file.

CSV is read in lines, and a line ends a record unless it ends inside quotes. JSON arrays are read in
stretches up to a closing brace, so that one long line is many stretches, and a brace that
leads back to depth 1 ends an element.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.sources.scratch import cut_lineage

SPLIT = "file long, start long"
WHOLE, HEAD, TAIL = 0, 1, 2


class CsvLines:
    """State: whether a line begins inside a quoted cell."""

    unit_end, joiner, begin = "\n", "\n", (False,)
    fields = "out0 boolean, out1 boolean"

    def __init__(self, sep: str = ",", quote: str = '"', escape: str = '"'):
        q, e = re.escape(quote), re.escape(escape)
        inside = rf"(?:[^{q}]|{q}{q})*" if escape == quote else rf"(?:[^{q}{e}]|{e}.)*"
        self.quote = quote
        # a quoted cell, closed, and what stands between it and the next delimiter; or an unquoted one
        self.closed = re.compile(rf"(?:{q}{inside}{q}(?!{q})[^{re.escape(sep)}]*|(?!{q})[^{re.escape(sep)}]*)(?:{re.escape(sep)}|$)", re.S)
        self.rest = re.compile(rf"{inside}{q}(?!{q})[^{re.escape(sep)}]*(?:{re.escape(sep)}|$)", re.S)

    def open_after(self, line: str, inside: bool) -> bool:
        """Whether a line that begins inside quotes, or outside, ends inside."""
        at = 0
        if inside:
            hit = self.rest.match(line)
            if not hit:
                return True
            at = hit.end()
            if at == len(line):
                return False
        while at < len(line):
            hit = self.closed.match(line, at)
            if not hit:
                return True
            if hit.end() == at:
                break
            at = hit.end()
        return False

    def outcomes(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each line whether it ends inside quotes if it begins outside, and if inside."""
        quoted = pc.match_substring(units, self.quote).to_numpy(zero_copy_only=False)
        out, within = np.zeros(len(units), bool), np.ones(len(units), bool)
        at = np.flatnonzero(quoted)
        for i, line in zip(at.tolist(), units.take(pa.array(at)).to_pylist(), strict=True):
            out[i], within[i] = self.open_after(line, False), self.open_after(line, True)
        return out, within

    def whole_split(self, units: Iterator[pa.Array]) -> tuple:
        state = [False, True]
        for part in units:
            out, within = self.outcomes(part)
            # only lines that do not leave both states as they are matter
            for i in np.flatnonzero(out | ~within).tolist():
                state = [bool(within[i]) if s else bool(out[i]) for s in state]
        return tuple(state)

    def then(self, state: tuple, split) -> tuple:
        return (bool(split.out1 if state[0] else split.out0),)

    def inside(self, state: tuple) -> bool:
        return state[0]

    def ends(self, units: pa.Array, state: tuple) -> tuple[np.ndarray, tuple]:
        """Which lines end a record, and the state after the last."""
        out, within = self.outcomes(units)
        ends, now = np.empty(len(units), bool), state[0]
        changes, at = np.flatnonzero(out | ~within), 0
        for i in changes.tolist():
            ends[at:i] = not now
            now = bool(within[i]) if now else bool(out[i])
            ends[i] = not now
            at = i + 1
        ends[at:] = not now
        return ends, (now,)


class JsonElements:
    """State: inside a string, and the depth of brackets."""

    unit_end, joiner, begin = "}", "", (False, 0)
    fields = "flips boolean, deeper0 long, deeper1 long"

    def changes(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether a stretch changes sides of a string, and the change of depth if it begins outside, and inside, one."""
        bare = pc.replace_substring_regex(units, r"(?s)\\.", "")
        flips = pc.count_substring(bare, '"').to_numpy(zero_copy_only=False) % 2 == 1

        def depth(text: pa.Array) -> np.ndarray:
            text = pc.replace_substring_regex(text, r'(?s)"[^"]*("|$)', "")
            up, down = (sum(pc.count_substring(text, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in cs) for cs in ("[{", "]}"))
            return up - down

        return flips, depth(bare), depth(pc.replace_substring_regex(bare, r'(?s)^[^"]*("|$)', ""))

    def run(self, units: pa.Array, inside: bool) -> tuple[np.ndarray, np.ndarray]:
        """The change of depth of each stretch with the brace after it, and whether it ends inside a string."""
        flips, out, within = self.changes(units)
        after = (np.cumsum(flips) + inside) % 2 == 1
        before = np.r_[inside, after[:-1]] if len(after) else after
        return np.where(before, within, out) - ~after, after

    def whole_split(self, units: Iterator[pa.Array]) -> tuple:
        inside, depth = [False, True], [0, 0]
        for part in units:
            for k in (0, 1):
                change, after = self.run(part, inside[k])
                depth[k] += int(change.sum())
                inside[k] = bool(after[-1]) if len(after) else inside[k]
        return inside[0], *depth

    def then(self, state: tuple, split) -> tuple:
        return bool(state[0] != split.flips), int(state[1] + (split.deeper1 if state[0] else split.deeper0))

    def inside(self, state: tuple) -> bool:
        return state[0] or state[1] > 1

    def ends(self, units: pa.Array, state: tuple) -> tuple[np.ndarray, tuple]:
        change, after = self.run(units, state[0])
        depth = state[1] + np.cumsum(change)
        return (depth == 1) & ~after, (bool(after[-1]), int(depth[-1])) if len(depth) else state


Kind = CsvLines | JsonElements


def _units(spark: SparkSession, paths: str | list[str], kind: Kind) -> DataFrame:
    """Lines or stretches in order, with the split they are from; a file is known by a digest of its path."""
    return spark.read.text(paths, lineSep=kind.unit_end).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Array]]:
    """The units of one split after the other, in pieces."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = (batch.column(c).to_numpy() for c in ("file", "start"))
        edges = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield int(file[a]), int(start[a]), batch.column("value").slice(a, b - a)


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Iterator[pa.Array]]]:
    runs = _runs(batches)
    ahead = next(runs, None)
    while ahead is not None:
        file, start = ahead[:2]

        def pieces():
            nonlocal ahead
            while ahead is not None and ahead[:2] == (file, start):
                now, ahead = ahead[2], None
                ahead = next(runs, None)
                yield now

        yield file, start, pieces()


def _begins(units: DataFrame, kind: Kind) -> dict[tuple[int, int], tuple]:
    """The state in which each split begins, but for those that begin as a file does."""
    names = [f.split(" ")[0] for f in kind.fields.split(", ")]

    def summaries(batches):
        for file, start, pieces in _splits(batches):
            yield pa.RecordBatch.from_pylist([dict(zip(["file", "start", *names], [file, start, *kind.whole_split(pieces)], strict=True))])

    state = ", ".join(f"s{i} long" for i in range(len(kind.begin)))

    def fold(splits: pd.DataFrame) -> pd.DataFrame:
        now, rows = kind.begin, []
        for split in splits.sort_values("start").itertuples():
            rows.append((split.file, split.start, *map(int, now)))
            now = kind.then(now, split)
        return pd.DataFrame(rows, columns=["file", "start", *[f"s{i}" for i in range(len(kind.begin))]])

    found = units.mapInArrow(summaries, f"{SPLIT}, {kind.fields}").groupBy("file").applyInPandas(fold, f"{SPLIT}, {state}")
    types = [type(v) for v in kind.begin]
    rows = found.collect()  # one short row for each split
    begins = {(r[0], r[1]): tuple(t(v) for t, v in zip(types, r[2:], strict=True)) for r in rows}
    return {k: v for k, v in begins.items() if v != kind.begin}


def records(spark: SparkSession, paths: str | list[str], kind: Kind) -> DataFrame:
    """``value``, the text of each record, and ``first``, whether it is the first of its file."""
    units = _units(spark, paths, kind)
    begins = spark.sparkContext.broadcast(_begins(units, kind))  # one short entry for each split

    def cut(batches):
        for file, start, pieces in _splits(batches):
            state = begins.value.get((file, start), kind.begin)
            head, first, held = kind.inside(state), start == 0, []
            for units in pieces:
                if kind.unit_end != "\n":
                    units = pc.binary_join_element_wise(units, kind.unit_end, "")
                ends, state = kind.ends(pc.utf8_slice_codeunits(units, 0, -1) if kind.unit_end != "\n" else units, state)
                at = np.flatnonzero(ends) + 1
                if not len(at):
                    held.append(units)
                    continue
                whole = pa.chunked_array([*held, units.slice(0, int(at[-1]))], pa.string()).combine_chunks()
                before = sum(map(len, held))
                offsets = np.r_[0, at + before]
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), whole), kind.joiner)
                n = len(texts)
                kinds, firsts = np.zeros(n, np.int32), np.zeros(n, bool)
                if head:
                    kinds[0], head = HEAD, False
                elif first:
                    firsts[0] = True
                first = False
                held = [units.slice(int(at[-1]))] if at[-1] < len(units) else []
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, file)), pa.array(np.full(n, start)), pa.array(kinds), pa.array(firsts), texts], names=NAMES)
            if held:
                text = kind.joiner.join(pa.chunked_array(held, pa.string()).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([start]), pa.array([HEAD if head else TAIL], pa.int32()), pa.array([first and not head]),
                                                  pa.array([text])], names=NAMES)

    found = units.mapInArrow(cut, f"{SPLIT}, kind int, first boolean, value string")
    leftovers = cut_lineage(found.filter(F.col("kind") > WHOLE))
    order = Window.partitionBy("file").orderBy("start", "kind")
    chained = leftovers.withColumn("chain", F.count_if(F.col("kind") == TAIL).over(order))
    parts = F.sort_array(F.collect_list(F.struct("start", "kind", "value"))).getField("value")
    joined = chained.groupBy("file", "chain").agg(F.array_join(parts, kind.joiner).alias("value"), F.bool_or("first").alias("first"))
    return found.filter(F.col("kind") == WHOLE).select("value", "first").unionByName(joined.select("value", "first"))


NAMES = ["file", "start", "kind", "first", "value"]


def array_elements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``value``: the objects of files that hold one JSON array each, one to a row and to a line."""
    found = records(spark, paths, JsonElements()).select("value")
    # an object begins at its brace; a line break can only be white space between its parts
    text = F.regexp_replace(F.regexp_replace("value", r"^[^{]*", ""), r"[\r\n]+", " ")
    return found.select(text.alias("value")).filter("value <> ''")


def csv_records(spark: SparkSession, paths: str | list[str], sep: str, quote: str, escape: str) -> DataFrame:
    """``value``: the records of CSV files, blank ones left out, and ``first``."""
    found = records(spark, paths, CsvLines(sep, quote, escape))
    return found.select(F.regexp_replace("value", "\r$", "").alias("value"), "first").filter(F.trim("value") != "")

