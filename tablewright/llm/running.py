"""Sums that run along the rows of each group, for groups larger than a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewright.llm.scratch import Scratch


def running(scratch: Scratch, df: DataFrame, group: str, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with, for each ``new: old`` of ``sums``, the sum of ``old`` (long, 0 or more) over the group's rows so far.

    Rows are dealt out by ranges of group and order, so a large group lies in several tasks;
    each adds up its own, and what a group has in earlier tasks is added from one row for each task.
    """
    kept = list(df.columns)
    dealt = df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    extra = StructType.fromDDL(", ".join([*[f"`{c}` long" for c in sums], "_task long, _row long"]))

    def run(batches):
        task, row, last, carry = TaskContext.get().partitionId(), 0, None, dict.fromkeys(sums, 0)
        for batch in batches:
            key = batch.column(group).to_numpy(zero_copy_only=False)
            first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
            begin = np.flatnonzero(first)
            of = np.cumsum(first) - 1
            out = []
            for new, old in sums.items():
                value = batch.column(old).to_numpy(zero_copy_only=False).astype(np.int64)
                run = np.cumsum(value)
                run = run - (run - value)[begin][of]
                if len(key) and key[0] == last:
                    run[of == 0] += carry[new]
                if len(key):
                    carry[new] = int(run[-1])
                out.append(pa.array(run, pa.int64()))
            if len(key):
                last = key[-1]
            places = pa.array(np.arange(row, row + len(key)), pa.int64())
            row += len(key)
            yield pa.RecordBatch.from_arrays([*batch.columns, *out, pa.array(np.full(len(key), task), pa.int64()), places], names=[*batch.schema.names, *extra.names])

    # on disk: ranges drawn again could cut elsewhere
    rows = scratch.keep(dealt.mapInArrow(run, StructType([*dealt.schema.fields, *extra.fields])))
    last = rows.groupBy("_task").agg(F.max(F.struct("_row", F.col(group).alias("_group"), *sums)).alias("end")).select("_task", "end.*")
    # tasks follow one another: what a task passes on is what its last group has so far
    onward = Window.orderBy("_task")
    passed = last.withColumn("_next", F.lead("_task").over(onward)).filter("_next is not null")
    whole = Window.partitionBy("_group").orderBy("_task")
    passed = passed.select("_next", "_group", *[F.sum(c).over(whole).alias(f"_{c}") for c in sums])
    both = (rows[group] == passed["_group"]) & (rows["_task"] == passed["_next"])
    return rows.join(passed, both, "left").select(*kept, *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums])
