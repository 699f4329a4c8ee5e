"""Rows cut into consecutive parts whenever a running sum reaches a threshold.

The sum starts again at 0 after each cut, so it is a fold over the rows in order, not a
window sum. It still runs in parallel, key or no key. The rows are range-partitioned by
(key, order), so a key with much of the data covers many partitions. For each of those one
task works out how an incoming sum leaves the partition: a step function of that sum, with
no more steps than the rows of about one part, or with negative values the rows it takes to
make up for the deepest fall as well. The steps are rows, range-partitioned by the sums that
one stretch hands to the next, so that the functions of two neighbours are composed by looking
up each outcome of the first among the steps of the second; a tree of such pairs covers a key.
The sums at the partition borders are read off it, and a second pass numbers the rows.

Sums are whole numbers: values and threshold are scaled by a power of ten, so no result
depends on how many partitions there are or in which order they are put together.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from decimal import ROUND_CEILING, Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.text import col
from tablewright.operators.ordering import total_order
from tablewright.sources.scratch import cut_lineage, with_place

# Steps of all chains that the driver takes itself, at 24 bytes each; more are composed as rows.
FEW_STEPS = 1 << 20
STEP_BATCH = 1 << 16
# Digits after the point that floating point and text cells may have if the caller names no scale.
DEFAULT_SCALE = 6
# Beyond any sum, with room to add two of them.
LIMIT = 1 << 61


class Steps(NamedTuple):
    """What a stretch of rows does to an incoming sum ``s``.

    Below ``low[0]`` nothing is cut and ``s + total`` leaves. From ``low[i]`` up to the next
    entry, ``out[i]`` leaves and ``cuts[i]`` parts were closed.
    """

    total: int
    low: np.ndarray
    out: np.ndarray
    cuts: np.ndarray


NO_ROWS = Steps(0, *[np.zeros(0, dtype=np.int64)] * 3)


def _first_reaching(sums: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each row i the first row j >= i with ``sums[j] >= wanted[i]``, else the row count."""
    n = len(sums)
    if n == 0 or np.all(np.diff(sums) >= 0):
        return np.maximum(np.searchsorted(sums, wanted, side="left"), np.arange(n))
    # Negative values: from the back, keep the rows whose sum beats every sum before them.
    found, rows, negated = np.empty(n, dtype=np.int64), [], []
    for i in range(n - 1, -1, -1):
        while rows and sums[rows[-1]] <= sums[i]:
            rows.pop()
            negated.pop()
        rows.append(i)
        negated.append(-sums[i])
        # Sums fall along ``rows``, so the last one still high enough is the nearest row.
        at = bisect_right(negated, -wanted[i])
        found[i] = rows[at - 1] if at else n
    return found


def steps_of(values: np.ndarray, threshold: int, floor: int = -LIMIT) -> Steps:
    """The step function of a stretch of rows, for incoming sums from ``floor`` up."""
    n = len(values)
    if n == 0:
        return NO_ROWS
    sums = np.cumsum(values)
    before = np.concatenate(([0], sums[:-1]))
    close = _first_reaching(sums, before + threshold)
    # follow[i]: where the part that starts at row i leads, by doubling, until the last
    # part start whose part stays open; n stands for "nothing open".
    rows = np.arange(n + 1)
    follow, cuts = rows.copy(), np.zeros(n + 1, dtype=np.int64)
    shut = close < n
    follow[:n][shut] = close[shut] + 1
    cuts[:n][shut] = 1
    while True:
        further = follow[follow]
        if np.array_equal(further, follow):
            break
        cuts = cuts + cuts[follow]
        follow = further
    open_sum = sums[-1] - np.append(before, sums[-1])
    record = np.maximum.accumulate(sums)
    first = np.flatnonzero(np.concatenate(([True], record[1:] > record[:-1])))[::-1]
    start = follow[first + 1]
    return _thinned(int(sums[-1]), threshold - sums[first], open_sum[start], 1 + cuts[first + 1], floor)


def _thinned(total: int, low: np.ndarray, out: np.ndarray, cuts: np.ndarray, floor: int) -> Steps:
    """Steps below ``floor`` are left out and neighbours with one outcome become one step."""
    if len(low) > 1:
        reach = max(int(np.searchsorted(low, floor, side="right")) - 1, 0)
        low, out, cuts = low[reach:], out[reach:], cuts[reach:]
        new = np.concatenate(([True], (out[1:] != out[:-1]) | (cuts[1:] != cuts[:-1])))
        low, out, cuts = low[new], out[new], cuts[new]
    return Steps(total, low, out, cuts)


def then(a: Steps, b: Steps, floor: int = -LIMIT) -> Steps:
    """The step function of ``a``'s rows followed by ``b``'s."""
    ceiling = a.low[0] if len(a.low) else LIMIT
    shifted = b.low - a.total
    early = shifted < ceiling
    at = np.searchsorted(b.low, a.out, side="right") - 1
    cut = at >= 0
    out, cuts = a.out + b.total, a.cuts.copy()
    out[cut] = b.out[at[cut]]
    cuts[cut] += b.cuts[at[cut]]
    return _thinned(a.total + b.total, np.concatenate((shifted[early], a.low)),
                    np.concatenate((b.out[early], out)), np.concatenate((b.cuts[early], cuts)), floor)


def apply_steps(f: Steps, incoming: int) -> tuple[int, int]:
    at = int(np.searchsorted(f.low, incoming, side="right")) - 1
    return (incoming + f.total, 0) if at < 0 else (int(f.out[at]), int(f.cuts[at]))


def fold(values: np.ndarray, carry: int, closed: int, threshold: int,
         parts: np.ndarray | None = None) -> tuple[int, int]:
    """Run over rows in order from a known sum; ``parts`` takes the part number of each."""
    at, width = 0, 256
    while at < len(values):
        window = values[at:at + width]
        sums = np.cumsum(np.concatenate(([carry], window)))[1:]
        hits = sums >= threshold
        stop = int(hits.argmax())
        used = stop + 1 if hits[stop] else len(window)
        if parts is not None:
            parts[at:at + used] = closed + 1
        at += used
        if hits[stop]:
            carry, closed, width = 0, closed + 1, max(64, min(width, 2 * used))
        else:
            carry, width = int(sums[-1]), min(2 * width, 1 << 16)
    return carry, closed


def _runs(keys: pa.Array) -> list[tuple[str, int, int]]:
    """Stretches of equal neighbouring keys as (key, from, to)."""
    n = len(keys)
    borders = np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1
    edges = [0, *borders.tolist(), n]
    return [(keys[lo].as_py(), lo, hi) for lo, hi in zip(edges[:-1], edges[1:])]


BORDER_ARROW = pa.schema([
    ("pid", pa.int32()), ("first_key", pa.string()), ("last_key", pa.string()), ("single", pa.bool_()),
    ("carry", pa.int64()), ("closed", pa.int64()), ("steps", pa.int64()), ("change", pa.int64()), ("peak", pa.int64()),
    ("trough", pa.int64()), ("fall", pa.int64()), ("low", pa.int64()), ("out", pa.int64()), ("cuts", pa.int64())])
BORDER_SCHEMA = ("pid int, first_key string, last_key string, single boolean, carry bigint, closed bigint, steps bigint, "
                 "change bigint, peak bigint, trough bigint, fall bigint, low bigint, out bigint, cuts bigint")


class Swing(NamedTuple):
    """How a plain running total moves over a stretch of rows: its change, highest and lowest
    point, both counting the start, and its deepest fall from an earlier point."""

    change: int = 0
    peak: int = 0
    trough: int = 0
    fall: int = 0

    def and_then(self, later: Swing) -> Swing:
        return Swing(self.change + later.change, max(self.peak, self.change + later.peak),
                     min(self.trough, self.change + later.trough),
                     min(self.fall, later.fall, self.change + later.trough - self.peak))


def swing_of(values: np.ndarray) -> Swing:
    sums = np.concatenate(([0], np.cumsum(values)))
    return Swing(int(sums[-1]), int(sums.max()), int(sums.min()), int((sums - np.maximum.accumulate(sums)).min()))


def _border(batches: Iterator[pa.RecordBatch], threshold: int, floor: int) -> Iterator[pa.RecordBatch]:
    """One row per partition: its first and last key, the open sum of the last key's rows
    counted from this partition's start, and the swing of all its values. Where it holds one
    key only, a row for each step of its step function follows."""
    pid, first, last, single, moved = None, None, None, True, 0.0
    head, held, carry, closed, swing = NO_ROWS, [], 0, 0, Swing()
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, values = batch.column("key"), batch.column("value").to_numpy(zero_copy_only=False)
        runs = _runs(keys)
        moved += float(np.abs(values.astype(np.float64)).sum())
        if moved >= LIMIT:
            raise OverflowError("the values of a partition add up to more than fits; use a smaller scale")
        swing = swing.and_then(swing_of(values))
        if pid is None:
            pid, first, last = batch.column("pid")[0].as_py(), runs[0][0], runs[0][0]
        if single and len(runs) == 1 and runs[0][0] == last:
            held.append(values)
            # Enough rows at once that composing costs no more than the rows themselves.
            if sum(map(len, held)) >= max(1 << 16, len(head.low)):
                head, held = then(head, steps_of(np.concatenate(held), threshold, floor), floor), []
        else:
            single, head, held = False, NO_ROWS, []
        key, lo, hi = runs[-1]
        if key != last:
            last, carry, closed = key, 0, 0
        carry, closed = fold(values[lo:hi], carry, closed, threshold)
    if pid is not None:
        if held:
            head = then(head, steps_of(np.concatenate(held), threshold, floor), floor)
        yield pa.RecordBatch.from_pylist([{"pid": pid, "first_key": first, "last_key": last, "single": single,
                                           "carry": carry, "closed": closed, "steps": len(head.low),
                                           **swing._asdict()}], BORDER_ARROW)
        for at in range(0, len(head.low), STEP_BATCH):
            cells = {"low": head.low[at:at + STEP_BATCH], "out": head.out[at:at + STEP_BATCH],
                     "cuts": head.cuts[at:at + STEP_BATCH]}
            n = len(cells["low"])
            cells["pid"] = np.full(n, pid, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cells[f.name]) if f.name in cells else pa.nulls(n, f.type)
                                              for f in BORDER_ARROW], schema=BORDER_ARROW)


Node = tuple[int, int]
State = tuple[int, int]


def _applied(steps: DataFrame, totals: dict[Node, int], states: dict[Node, State]) -> dict[Node, State]:
    """The sum and count leaving each node of a level that the given ones enter."""
    if not states:
        return {}
    asked = steps.sparkSession.createDataFrame([(*node, carry) for node, (carry, _) in states.items()],
                                               "chain int, spot int, carry bigint")
    found = (steps.join(F.broadcast(asked), ["chain", "spot"]).filter(F.col("low") <= F.col("carry"))
             .groupBy("chain", "spot").agg(F.max(F.struct("low", "out", "cuts")).alias("step")).collect())
    hits = {(r["chain"], r["spot"]): r["step"] for r in found}
    return {node: (hits[node]["out"], closed + hits[node]["cuts"]) if node in hits else (carry + totals[node], closed)
            for node, (carry, closed) in states.items()}


class Late(NamedTuple):
    """A step of the later node of a pair, the last one met so far in the order of sums."""

    chain: int = -1
    parent: int = -1
    out: int = 0
    cuts: int = 0


def _passed_on(batch: pa.RecordBatch, last: Late, floor: int) -> tuple[pa.RecordBatch, Late]:
    """Steps of paired nodes, in the order of the sums between the two, as steps of the pair.

    What leaves the earlier node by a step enters the later one by the last of its steps
    before, or passes it uncut. Steps of the later node count as well for sums that pass the
    earlier one uncut.
    """
    cell = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
    late, low, out, cuts = cell["late"], cell["low"], cell["out"], cell["cuts"]
    met = {name: np.concatenate(([value], cell[name])) for name, value in last._asdict().items()}
    at = np.maximum.accumulate(np.where(np.concatenate(([True], late)), np.arange(len(late) + 1), 0))
    entered = at[1:]
    cut = (met["chain"][entered] == cell["chain"]) & (met["parent"][entered] == cell["parent"])
    kept = ~late | (low - cell["early_total"] < cell["ceiling"])
    steps = np.flatnonzero(late)
    # A step is idle if the next one of its node already holds for the lowest sum there is.
    idle = ((low[steps[1:]] - cell["early_total"][steps[1:]] <= floor) & (cell["chain"][steps[1:]] == cell["chain"][steps[:-1]])
            & (cell["parent"][steps[1:]] == cell["parent"][steps[:-1]]))
    kept[steps[:-1][idle]] = False
    result = pd.DataFrame({"chain": cell["chain"], "spot": cell["parent"], "low": np.where(late, low - cell["early_total"], low),
                           "out": np.where(late, out, np.where(cut, met["out"][entered], out + cell["late_total"])),
                           "cuts": np.where(late, cuts, cuts + np.where(cut, met["cuts"][entered], 0))})[kept]
    if floor == 0:
        # Without negative values (cuts, out) never falls as the sum grows, so equal ones are one step.
        result = result.sort_values("low").drop_duplicates(["chain", "spot", "out", "cuts"])
    return (pa.RecordBatch.from_pandas(result, STEP_ARROW, preserve_index=False),
            Late(*(int(met[name][at[-1]]) for name in Late._fields)))


STEP_ARROW = pa.schema([("chain", pa.int32()), ("spot", pa.int32()), ("low", pa.int64()), ("out", pa.int64()), ("cuts", pa.int64())])
STEP_SCHEMA = "chain int, spot int, low bigint, out bigint, cuts bigint"


def _composed(steps: DataFrame, totals: dict[Node, int], floor: int) -> tuple[DataFrame, dict[Node, int]]:
    """One level up: each two neighbouring nodes of a chain as one.

    The steps are range-partitioned by (pair, sum between the two nodes), so those of one pair
    may lie in many partitions; the driver hands each partition the last step of the later node before it.
    """
    spark = steps.sparkSession
    first = steps.filter("spot % 2 = 0").groupBy("chain", "spot").agg(F.min("low").alias("low")).collect()
    ceilings = {(r["chain"], r["spot"]): r["low"] for r in first}
    pairs = spark.createDataFrame(
        [(c, s // 2, totals[c, s], totals[c, s + 1], ceilings.get((c, s), LIMIT))
         for c, s in totals if s % 2 == 0 and (c, s + 1) in totals],
        "chain int, parent int, early_total bigint, late_total bigint, ceiling bigint")
    nodes = steps.withColumn("parent", F.expr("spot div 2").cast("int")).join(F.broadcast(pairs), ["chain", "parent"], "left")
    alone = nodes.filter("ceiling is null").select("chain", F.col("parent").alias("spot"), "low", "out", "cuts")
    late = F.expr("spot % 2 = 1")
    order = ["chain", "parent", "between", F.col("late").desc(), "low"]
    laid = cut_lineage(nodes.filter("ceiling is not null")
                       .withColumns({"late": late, "between": F.when(late, F.col("low")).otherwise(F.col("out"))})
                       .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
                       .sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()))
    ends = (laid.filter("late").groupBy("pid")
            .agg(F.max_by(F.struct("chain", "parent", "out", "cuts"), F.struct("chain", "parent", "between")).alias("step")).collect())
    ends = sorted((r["pid"], Late(*r["step"])) for r in ends)
    pids, lasts = [pid for pid, _ in ends], [Late(), *(step for _, step in ends)]

    def passed_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is None:
                last = lasts[bisect_left(pids, batch.column("pid")[0].as_py())]
            result, last = _passed_on(batch, last, floor)
            yield result

    above: dict[Node, int] = {}
    for (c, s), total in totals.items():
        above[c, s // 2] = above.get((c, s // 2), 0) + total
    return cut_lineage(laid.mapInArrow(passed_on, STEP_SCHEMA).unionByName(alone)), above


def _by_tree(steps: DataFrame, totals: dict[Node, int], entries: dict[int, State], floor: int) -> dict[Node, State]:
    """The sum and count leaving each node: up a tree of pairs composing step functions, down
    again with the sums that enter."""
    levels = [(cut_lineage(steps), totals)]
    while any(spot for _, spot in levels[-1][1]):
        levels.append(_composed(*levels[-1], floor))
    entering = {(chain, 0): state for chain, state in entries.items()}
    final = _applied(*levels[-1], entering)
    for rows, below in reversed(levels[:-1]):
        entering = {(c, 2 * s): state for (c, s), state in entering.items()}
        first = {(c, s): state for (c, s), state in entering.items() if (c, s + 1) in below}
        entering.update({(c, s + 1): state for (c, s), state in _applied(rows, below, first).items()})
    return {node: entering[node[0], node[1] + 1] if (node[0], node[1] + 1) in entering else final[node[0], 0]
            for node in totals}


def _in_turn(steps: DataFrame, totals: dict[Node, int], entries: dict[int, State]) -> dict[Node, State]:
    """The same on the driver, for ``FEW_STEPS`` steps at most."""
    held = steps.toArrow().to_pandas().sort_values("low")
    functions = {node: rows for node, rows in held.groupby(["chain", "spot"])}
    leaving, state = {}, (0, 0)
    for node in sorted(totals):
        carry, closed = entries[node[0]] if node[1] == 0 else state
        rows = functions.get(node)
        f = Steps(totals[node], *(NO_ROWS[1:] if rows is None else [rows[c].to_numpy() for c in ("low", "out", "cuts")]))
        after, more = apply_steps(f, carry)
        state = leaving[node] = (after, closed + more)
    return leaving


def _entries(borders: DataFrame, floor: int) -> dict[int, tuple[int, int]]:
    """``pid -> (sum, closed parts)`` brought into each partition that goes on with a key of
    the one before. The driver sees one short row per partition, and the steps only if they are few."""
    rows = sorted(borders.filter(F.col("low").isNull())
                  .select("pid", "first_key", "last_key", "single", "carry", "closed", "steps", "change").collect(),
                  key=lambda r: r["pid"])
    places, totals, chain_entries, leaves, goes_on = {}, {}, {}, {}, {}
    chain, spot, count = -1, 0, 0
    for before, row in zip([None, *rows], rows):
        goes_on[row["pid"]] = before is not None and before["last_key"] == row["first_key"]
        if row["single"] and goes_on[row["pid"]]:
            if before["pid"] in leaves:
                chain, spot = chain + 1, 0
                chain_entries[chain] = leaves[before["pid"]]
            places[row["pid"]], totals[chain, spot] = (chain, spot), row["change"]
            spot, count = spot + 1, count + row["steps"]
        else:
            leaves[row["pid"]] = (row["carry"], row["closed"])
    if places:
        named = borders.sparkSession.createDataFrame([(pid, *node) for pid, node in places.items()], "pid int, chain int, spot int")
        steps = (borders.filter(F.col("low").isNotNull()).join(F.broadcast(named), "pid")
                 .select("chain", "spot", "low", "out", "cuts"))
        leaving = (_in_turn(steps, totals, chain_entries) if count <= FEW_STEPS
                   else _by_tree(steps, totals, chain_entries, floor))
        leaves.update({pid: leaving[node] for pid, node in places.items()})
    return {row["pid"]: leaves[before["pid"]] for before, row in zip(rows, rows[1:]) if goes_on[row["pid"]]}


def _deepest_fall(borders: DataFrame) -> int:
    swing = Swing()
    for row in sorted(borders.filter(F.col("low").isNull()).select("pid", *Swing._fields).collect(), key=lambda r: r["pid"]):
        swing = swing.and_then(Swing(*row[1:]))
        if max(swing.peak, -swing.trough) >= LIMIT:
            raise OverflowError("the running total grows beyond what fits; use a smaller scale")
    return swing.fall


def _number(batches: Iterator[pa.RecordBatch], threshold: int, entries: dict, part: str) -> Iterator[pa.RecordBatch]:
    last, carry, closed = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column("__value").to_numpy(zero_copy_only=False)
        runs = _runs(batch.column("__key"))
        if last is None:
            last = runs[0][0]
            carry, closed = entries.get(batch.column("__pid")[0].as_py(), (0, 0))
        numbers = np.empty(len(values), dtype=np.int64)
        for key, lo, hi in runs:
            if key != last:
                last, carry, closed = key, 0, 0
            carry, closed = fold(values[lo:hi], carry, closed, threshold, numbers[lo:hi])
        kept = batch.drop_columns(["__key", "__value", "__pid"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(numbers)], names=[*kept.schema.names, part])


def whole_numbers(df: DataFrame, column: str, scale: int | None) -> tuple[Column, int]:
    """The cells of a column times ten to the scale, as whole numbers, and the scale.

    Null and NaN are 0. A cell with more digits after the point than the scale allows, or too
    large to be exact, is an error.
    """
    dtype, c = df.schema[column].dataType, col(column)
    exact = isinstance(dtype, (T.IntegralType, T.DecimalType))
    if scale is None:
        scale = dtype.scale if isinstance(dtype, T.DecimalType) else 0 if exact else DEFAULT_SCALE
    name = column.replace("'", "")
    fail = F.raise_error(F.concat(F.lit(f"no whole number with {scale} digits after the point in {name}: "), c.cast("string")))
    if exact:
        shifted = c.cast("decimal(38,18)") * F.lit(Decimal(10) ** scale)
        fits = (shifted == F.floor(shifted)) & (F.abs(shifted) < F.lit(float(LIMIT)))
    else:
        # A double equals the quotient only if it is the one nearest to that decimal.
        number = F.nanvl(c.try_cast("double"), F.lit(0.0))
        shifted = F.rint(number * F.lit(10.0 ** scale))
        fits = (shifted / F.lit(10.0 ** scale) == number) & (F.abs(shifted) <= F.lit(float(1 << 53)))
    return F.coalesce(F.when(shifted.isNull() | fits, shifted).otherwise(fail.cast("double")).cast("bigint"), F.lit(0).cast("bigint")), scale


def chunk_cumulative(df: DataFrame, column: str, threshold: float | Decimal, order_by: Sequence[str | Column],
                     partition_by: Sequence[str] = (), part: str = "part_idx",
                     partitions: int | None = None, scale: int | None = None) -> DataFrame:
    """Number the parts 1, 2, …: a row that brings the running sum of ``column`` to the
    threshold closes its part and the sum starts again at 0. Null and NaN add 0.

    Rows go in the order of ``order_by``, ties by all other columns, over the whole table
    or per ``partition_by`` key. Write the result with ``partition_by(df, [part], …)``.
    Sums are exact: ``scale`` says how many digits after the point values may have (a decimal
    column's own scale, 0 for integers, else 6), and a value with more is an error. The rows are
    dealt into ``partitions``, by default the session's number of shuffle partitions; the result
    is the same for any number.
    """
    if not threshold > 0:
        raise ValueError("the threshold must be positive")
    spark = df.sparkSession
    keys = [col(k) for k in partition_by]
    value, scale = whole_numbers(df, column, scale)
    threshold = int((Decimal(str(threshold)) * Decimal(10) ** scale).to_integral_value(ROUND_CEILING))
    # The input place comes last in the order: equal copies of a row can be divided by it.
    order = [*keys, *total_order(df, order_by), F.col("__place")]
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = (with_place(df, "__place")
            .repartitionByRange(count, *order).sortWithinPartitions(*order).drop("__place")
            .withColumns({"__key": F.to_json(F.struct(*keys)) if keys else F.lit(""),
                          "__value": value, "__pid": F.spark_partition_id()}))
    laid = cut_lineage(laid)
    cells = laid.select(F.col("__pid").alias("pid"), F.col("__key").alias("key"), F.col("__value").alias("value"))

    def borders_from(floor: int) -> DataFrame:
        return cut_lineage(cells.mapInArrow(lambda batches: _border(batches, threshold, floor), BORDER_SCHEMA))

    # An open sum is never below the deepest fall of the plain running total, which is 0
    # without negative values. Step functions are kept for sums from there up only.
    floor = 0
    borders = borders_from(floor)
    fall = _deepest_fall(borders)
    if fall < 0:
        floor = fall
        borders = borders_from(floor)
    entries = _entries(borders, floor)
    schema = T.StructType([*df.schema.fields, T.StructField(part, T.LongType())])
    return laid.mapInArrow(lambda batches: _number(batches, threshold, entries, part), schema)
