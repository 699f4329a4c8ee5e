"""Union, pivot, unpivot, explode, and output split by value."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.text import col
from tablewright.operators.aggregates import aggregate
from tablewright.operators.drift import common_type
from tablewright.operators.ordering import total_order


def merge(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of frames with the same columns."""
    if not frames:
        raise ValueError("nothing to merge")
    return reduce(lambda a, b: a.unionByName(b), frames)


def pivot(df: DataFrame, index: Sequence[str], on: str, values: str, aggregate_with: str = "first",
          order_by: Sequence[str] = (), columns: Sequence | None = None) -> DataFrame:
    """Rows to columns; the new columns are sorted and an absent cell is null.

    ``columns`` names the values of ``on`` when they are known and saves the job that finds
    them. ``first`` and ``last`` go by ``order_by``; any unknown aggregate means first.
    """
    kind, v = aggregate_with.lower(), col(values)
    if kind in ("sum", "mean", "min", "max", "count"):
        cell = aggregate(v, kind)
    else:
        rank = F.struct(*total_order(df.drop(*index, on), order_by))
        cell = F.max_by(v, rank) if kind == "last" else F.min_by(v, rank)
    grouped = df.groupBy(*[col(c) for c in index])
    wide = (grouped.pivot(on, list(columns)) if columns else grouped.pivot(on)).agg(cell)
    made = sorted(c for c in wide.columns if c not in index)
    return wide.select(*[col(c) for c in [*index, *made]])


def unpivot(df: DataFrame, index: Sequence[str], on: Sequence[str] = (), variable_name: str = "variable",
            value_name: str = "value") -> DataFrame:
    """Columns to rows; no ``on`` means every column outside the index. Mixed column types
    go to the narrowest type that holds them all."""
    columns = list(on) or [c for c in df.columns if c not in index]
    shared = reduce(common_type, [df.schema[c].dataType for c in columns])
    typed = df.select(*[col(c) for c in index], *[col(c).cast(shared).alias(c) for c in columns])
    return typed.unpivot([col(c) for c in index], [col(c) for c in columns], variable_name, value_name)


def explode_column(df: DataFrame, column: str, delimiter: str | None = None) -> DataFrame:
    """One row per item of a delimited text, of a bracketed list in text, or of an array."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        items = col(column)
    elif delimiter is not None:
        items = F.split(col(column), re.escape(delimiter) if delimiter else "")
    else:
        items = F.split(F.regexp_replace(col(column), r'[\[\]"]', ""), ",")
    return df.withColumn(column, F.explode_outer(items))


FOLDER = "by_{}"


def split_by(df: DataFrame, column: str, path: str, fmt: str = "parquet", **options) -> None:
    """One folder per value of a column, in one pass over the input."""
    partition_by(df, [column], path, fmt, **options)


def partition_by(df: DataFrame, columns: Sequence[str], path: str, fmt: str = "parquet",
                 mode: str = "overwrite", **options) -> None:
    """Folders ``by_column=value/…`` with whole rows in the files, so that types, empty texts
    and nulls read back as they were; see :func:`read_partitioned`. The rebalance hint gathers
    each value's rows into few files and lets the adaptive planner cut a value that is too big
    for one task."""
    folders = [FOLDER.format(c) for c in columns]
    copied = df.withColumns({f: col(c).cast("string") for f, c in zip(folders, columns)})
    copied.hint("rebalance", *folders).write.format(fmt).mode(mode).options(**options).partitionBy(*folders).save(path)


def read_partitioned(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """The rows that :func:`partition_by` wrote, without the folders' names."""
    df = spark.read.format(fmt).options(**options).load(path)
    return df.drop(*[c for c in df.columns if c.startswith(FOLDER.format("")) and c[len(FOLDER.format("")):] in df.columns])
