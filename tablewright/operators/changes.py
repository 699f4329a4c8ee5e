"""Change capture and table maintenance: delta, upsert, sync, history of versions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.text import col
from tablewright.operators.drift import union_with_drift
from tablewright.operators.joins import anti_join, any_null, spread_join
from tablewright.operators.ordering import deduplicate


class Delta(NamedTuple):
    upserts: DataFrame
    deletes: DataFrame
    sync: DataFrame


def delta(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> Delta:
    """``upserts`` is the whole source, ``deletes`` the target rows whose keys it lacks, and
    ``sync`` both together: rows gone from the source are kept."""
    deletes = anti_join(target, source, keys)
    return Delta(source, deletes, source.unionByName(deletes, allowMissingColumns=True))


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], order_by: Sequence[str] = (),
           schema_drift: bool = False) -> DataFrame:
    """The target after insert-or-update on ``keys``.

    Of source rows with one key the last in ``order_by`` counts. A column the source lacks
    keeps its value. A null key equals nothing, so such source rows are all inserted. With
    only key columns in the source, rows already there stay as they are.
    """
    extra = [c for c in source.columns if c not in target.columns]
    if extra and not schema_drift:
        raise ValueError(f"columns not in the target: {extra}")
    # Null keys are all kept and others once each; no row of the source is in both branches.
    latest = deduplicate(source.filter(~any_null(keys)), keys, keep="last", order_by=order_by)
    rows = latest.unionByName(source.filter(any_null(keys)))
    changes = [c for c in source.columns if c not in keys]
    tagged = rows.select(*[col(k).alias(f"__k_{i}") for i, k in enumerate(keys)],
                         F.struct(F.lit(True).alias("__is"), *[col(c) for c in changes]).alias("__new"))
    joined = spread_join(target, tagged, keys, [f"__k_{i}" for i in range(len(keys))], "outer")
    names = [*target.columns, *extra]
    types = {**{f.name: f.dataType for f in source.schema.fields},
             **{f.name: f.dataType for f in target.schema.fields}}

    def merged(name: str) -> Column:
        if name in keys:
            new, taken = F.col(f"__k_{list(keys).index(name)}"), F.col("__in_left").isNull()
        elif name in changes:
            new, taken = F.col("__new")[name], F.col("__in_right").isNotNull()
        else:
            return col(name).alias(name)
        old = col(name) if name in target.columns else F.lit(None)
        return F.when(taken, new.cast(types[name])).otherwise(old.cast(types[name])).alias(name)

    return joined.select(*[merged(c) for c in names])


def sync(target: DataFrame, source: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """The target made equal to the source: missing keys inserted, shared ones updated, others
    deleted. Target columns the source lacks keep their values; an empty source changes nothing."""
    if source.isEmpty():
        return target
    latest = deduplicate(source, keys, keep="last", order_by=order_by)
    kept = [c for c in target.columns if c not in source.columns]
    if not kept:
        return latest.select(*[col(c) for c in target.columns],
                             *[col(c) for c in source.columns if c not in target.columns])
    old = deduplicate(target.select(*[col(c) for c in [*keys, *kept]]), keys, keep="last")
    old = old.select(*[col(k).alias(f"__k_{i}") for i, k in enumerate(keys)], *[col(c) for c in kept])
    same = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(f"__k_{i}")) for i, k in enumerate(keys)])
    return latest.join(old, same, "left").select(
        *[col(c) for c in target.columns], *[col(c) for c in source.columns if c not in target.columns])


def sync_counts(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many keys a sync inserts, updates and deletes. Keys of both sides are
    folded in one shuffle; null keys are equal."""
    cols = [col(k) for k in keys]
    sides = (source.select(*cols, F.lit(True).alias("__s"), F.lit(False).alias("__t"))
             .unionByName(target.select(*cols, F.lit(False).alias("__s"), F.lit(True).alias("__t"))))
    seen = sides.groupBy(*cols).agg(F.bool_or("__s").alias("s"), F.bool_or("__t").alias("t"))
    any_source = F.count_if("s") > 0
    return seen.agg(F.count_if(F.col("s") & ~F.col("t")).alias("inserted"),
                    F.count_if(F.col("s") & F.col("t")).alias("updated"),
                    F.when(any_source, F.count_if(~F.col("s") & F.col("t"))).otherwise(0).alias("deleted"))


def _is_active(schema: T.StructType, name: str) -> Column:
    """Whether a history row is the current one; a missing mark counts as current."""
    if name not in schema.names:
        return F.lit(True)
    dtype = schema[name].dataType
    if isinstance(dtype, T.BooleanType):
        mark = col(name)
    elif isinstance(dtype, T.StringType):
        mark = col(name).isin("true", "1")
    else:
        mark = col(name) == 1
    return F.coalesce(mark, F.lit(True))


def scd2(source: DataFrame, target: DataFrame | None, keys: Sequence[str], valid_from_value: str,
         compare_columns: Sequence[str] | None = None, valid_from_col: str = "valid_from",
         valid_to_col: str = "valid_to", is_current_col: str = "is_current") -> DataFrame:
    """History of versions (slowly changing dimension, type 2).

    A new key opens a row; a changed one closes the old row and opens a new one; an
    unchanged one stays; a key gone from the source is closed; closed rows pass through.
    Null keys are equal. A key twice in the source, or current twice in the target, is an
    error. Source and current target rows meet in one aggregate on the keys, so there is
    one shuffle and no join.
    """
    marks = [valid_from_col, valid_to_col, is_current_col]
    opened = {valid_from_col: F.lit(valid_from_value), valid_to_col: F.lit(None).cast("string"),
              is_current_col: F.lit(True)}
    if target is None:
        return source.withColumns(opened)
    mark_types = {m: target.schema[m].dataType if m in target.columns else t
                  for m, t in zip(marks, (T.StringType(), T.StringType(), T.BooleanType()))}
    names = [*target.columns, *[c for c in source.columns if c not in target.columns],
             *[m for m in marks if m not in target.columns]]
    types = {**{f.name: f.dataType for f in source.schema.fields},
             **{f.name: f.dataType for f in target.schema.fields}, **mark_types}

    def shaped(df: DataFrame, row_of) -> Column:
        return F.struct(*[row_of(c).cast(types[c]).alias(c) for c in names])

    def from_source(name: str) -> Column:
        if name in opened:
            return opened[name]
        return col(name) if name in source.columns else F.lit(None)

    def from_target(name: str) -> Column:
        return col(name) if name in target.columns else F.lit(None)

    active = _is_active(target.schema, is_current_col)
    key_names = [f"__k_{i}" for i in range(len(keys))]

    def side(df: DataFrame, tag: str, row: Column) -> DataFrame:
        return df.select(*[col(k).cast(types[k]).alias(n) for k, n in zip(keys, key_names)],
                         *[(row if t == tag else F.lit(None).cast(T.StructType(
                             [T.StructField(c, types[c]) for c in names]))).alias(t) for t in ("s", "t")])

    both = side(source, "s", shaped(source, from_source)).unionByName(
        side(target.filter(active), "t", shaped(target, from_target)))
    # Partitioned by key first, both steps of the aggregate share one sort.
    per_key = both.repartition(*key_names).groupBy(*key_names).agg(
        F.count("s").alias("ns"), F.count("t").alias("nt"),
        F.any_value("s", True).alias("s"), F.any_value("t", True).alias("t"))
    fail = F.raise_error(F.concat(F.lit("key not unique: "), F.to_json(F.struct(*key_names))))
    checked = per_key.withColumn("ns", F.when((F.col("ns") > 1) | (F.col("nt") > 1), fail.cast("long"))
                                 .otherwise(F.col("ns"))).filter(F.col("ns") >= 0)
    compared = list(compare_columns) if compare_columns else [c for c in source.columns if c not in marks]
    changed = reduce(lambda a, b: a | b, [~F.col("s")[c].eqNullSafe(F.col("t")[c]) for c in compared], F.lit(False))
    closing = {valid_to_col: F.lit(valid_from_value), is_current_col: F.lit(False)}
    closed = F.struct(*[(closing[c].cast(types[c]) if c in closing else F.col("t")[c]).alias(c) for c in names])
    versions = (F.when(F.col("t").isNull(), F.array(F.col("s")))
                .when(F.col("s").isNull(), F.array(closed))
                .when(changed, F.array(closed, F.col("s")))
                .otherwise(F.array(F.col("t"))))
    result = checked.select(F.inline(versions))
    past = target.filter(~active).select(shaped(target, from_target).alias("r")).select("r.*")
    return past.unionByName(result)


def schema_drift_upsert(target: DataFrame, source: DataFrame, keys: Sequence[str],
                        order_by: Sequence[str] = ()) -> DataFrame:
    """Upsert after both sides were widened to hold new columns and wider types."""
    shape = union_with_drift(target, source).schema
    wide_target = target.select(*[(col(f.name) if f.name in target.columns else F.lit(None)).cast(f.dataType)
                                  .alias(f.name) for f in shape.fields])
    wide_source = source.select(*[col(c).cast(shape[c].dataType).alias(c) for c in source.columns])
    return upsert(wide_target, wide_source, keys, order_by)
