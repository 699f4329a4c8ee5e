"""Sorting, first rows, positions, duplicates. Spark rows have no order of their own, so
every operator here names the columns that give it; ties go by all remaining columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.text import col
from tablewright.sources.scratch import cut_lineage, with_place


def sort(df: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Order by one column, nulls last both ways. Equal values go by all other columns, so a
    value that fills much of the table is spread over several range partitions."""
    first = col(by).desc_nulls_last() if descending else col(by).asc_nulls_last()
    return df.orderBy(first, *[col(c) for c in orderable(df) if c != by])


def orderable(df: DataFrame) -> list[str]:
    """Columns Spark can sort by."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def total_order(df: DataFrame, order_by: Sequence[str | Column]) -> list[Column]:
    """The order columns followed by every other sortable one, so that only equal rows tie."""
    named = [c for c in order_by if isinstance(c, str)]
    return [*[col(c) if isinstance(c, str) else c for c in order_by],
            *[col(c) for c in orderable(df) if c not in named]]


def with_position(df: DataFrame, order_by: Sequence[str | Column], position: str = "position") -> DataFrame:
    """Number the rows 1, 2, … in a global order without a single-task window."""
    # Equal copies of a row are told apart by their input place and so can be split too.
    return numbered(with_place(df, "__place").orderBy(*total_order(df, order_by), "__place").drop("__place"), position)


def numbered(ordered: DataFrame, position: str = "position") -> DataFrame:
    """Number the rows of a sorted frame 1, 2, … in its order.

    The sorted rows are checkpointed, which fixes their partitions; a row's position is
    its place in its partition plus the sizes of the partitions before it. The only table
    broadcast holds one row per partition.
    """
    spot = F.monotonically_increasing_id()
    placed = cut_lineage(ordered).withColumn("__spot", spot)
    part = F.shiftright("__spot", 33)
    sizes = placed.groupBy(part.alias("__part")).count().collect()
    starts, total = [], 0
    for row in sorted(sizes, key=lambda r: r["__part"]):
        starts.append((row["__part"], total))
        total += row["count"]
    offsets = ordered.sparkSession.createDataFrame(starts, "__part long, __start long")
    return (placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
            .withColumn(position, F.col("__start") + F.col("__spot").bitwiseAND((1 << 33) - 1) + 1)
            .drop("__spot", "__part", "__start"))


#: Rows that each partition may hand on to one task.
HANDED_ON = 64
#: One row in so many is looked at to find how far the first rows of an order reach.
SAMPLED = 1024


def _comparable(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def _at(df: DataFrame, n: int, keys: Sequence[str]) -> list | None:
    """The ``n``-th row of ``df`` (its columns ``keys``) in order; None if there are fewer rows."""
    rows = df.select(*[col(k) for k in keys])
    if n <= HANDED_ON:
        found = rows.orderBy(*[col(k) for k in keys]).limit(n).collect()
        return list(found[-1]) if len(found) == n else None
    placed = with_position(_reaching(rows, n, keys), keys, "__position")
    found = placed.filter(F.col("__position") == n).drop("__position").collect()
    return list(found[0]) if found else None


def _up_to(schema: T.StructType, keys: Sequence[str], bound: Sequence) -> tuple[Column, Column]:
    """Whether a row comes before the bound in the order of ``keys``, and whether it is equal to it."""
    before, equal = F.lit(False), F.lit(True)
    for key, value in reversed(list(zip(keys, bound, strict=True))):
        c = col(key)
        if isinstance(schema[key].dataType, T.TimestampType):
            c = F.unix_micros(c)
        v = F.lit(value)
        less = F.lit(False) if value is None else c.isNull() | (c < v)
        before, equal = less | (c.eqNullSafe(v) & before), c.eqNullSafe(v) & equal
    return before, equal


def _bound(df: DataFrame, n: int, keys: Sequence[str]) -> list | None:
    """A value of ``keys`` that about ``n`` rows do not pass, or some more, told by a sample of one row in ``SAMPLED``."""
    share = n / SAMPLED
    reach = math.ceil(share + 4 * math.sqrt(share) + 8)
    drawn = df.withColumn("__draw", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SAMPLED))).filter("__draw = 0")
    exact = [F.unix_micros(col(k)).alias(k) if isinstance(df.schema[k].dataType, T.TimestampType) else col(k) for k in keys]
    return _at(drawn.select(*exact), reach, keys)


def _reaching(df: DataFrame, n: int, keys: Sequence[str], done: Sequence[str] = ()) -> DataFrame:
    """The rows of ``df`` up to a bound that holds the first ``n``; ties at the bound are cut by the other columns in turn."""
    told = []
    for k in keys:  # what Spark sorts by, but Python cannot hand back, ends the bound
        if not _comparable(df.schema[k].dataType):
            break
        told.append(k)
    bound = _bound(df, n, told) if told else None
    if bound is None:
        return df
    before, equal = _up_to(df.schema, told, bound)
    counts = df.agg(F.count_if(before).alias("before"), F.count_if(equal).alias("equal")).first()
    if counts["before"] + counts["equal"] < n:
        return df  # the sample fell short
    done = [*done, *told]
    rest = [k for k in orderable(df) if k not in done]
    if counts["before"] >= n or counts["equal"] <= max(n, SAMPLED) or not rest:
        return df.filter(before | equal)
    return df.filter(before).unionByName(_reaching(df.filter(equal), n - counts["before"], rest, done))


def head(df: DataFrame, n: int, order_by: Sequence[str | Column]) -> DataFrame:
    """The first ``n`` rows of an order; ties go by all other columns.

    Up to ``HANDED_ON`` rows each partition hands on its own first ones, and nothing is
    written. For more, a sample of the order columns tells a bound that a few more rows than ``n`` do
    not pass, itself found in this way; counts make sure of it. Only rows up to the bound are sorted,
    over all tasks, and cut by position, so neither the table nor ``n`` rows of each partition move.
    An order given as column expressions has no such bound; all rows are sorted.
    """
    if n <= HANDED_ON:
        return df.orderBy(*total_order(df, order_by)).limit(max(n, 0))
    near = _reaching(df, n, list(dict.fromkeys(order_by))) if all(isinstance(c, str) for c in order_by) and order_by else df
    return with_position(near, order_by, "__position").filter(F.col("__position") <= n).drop("__position")


def top_groups(df: DataFrame, by: Sequence[str], k: int, out: str = "n") -> DataFrame:
    """The ``k`` most frequent groups; equal counts go by the group's own values."""
    counts = df.groupBy(*[col(c) for c in by]).agg(F.count("*").alias(out))
    return counts.orderBy(F.desc(out), *[col(c) for c in by]).limit(k)


def deduplicate(df: DataFrame, subset: Sequence[str] | None = None, keep: str = "first",
                order_by: Sequence[str] = ()) -> DataFrame:
    """One row per key, the first or last in ``order_by``; no subset compares whole rows.
    Null keys are equal.

    ``row_number() = 1`` lets Spark keep one row per key and input partition before the
    shuffle, so a key that holds much of the data arrives as a handful of rows.
    """
    if not subset:
        return df.dropDuplicates()
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first' or 'last'")
    order = total_order(df.drop(*subset), [c for c in order_by if c not in subset])
    if keep == "last":
        order = [c.desc() for c in order]
    ranked = Window.partitionBy(*[col(c) for c in subset]).orderBy(*(order or [F.lit(1)]))
    return df.withColumn("__rank", F.row_number().over(ranked)).filter(F.col("__rank") == 1).drop("__rank")
