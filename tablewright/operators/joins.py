"""Equi joins and dictionary lookups.

No broadcast hint is set on data: Spark broadcasts a side only when its own size estimate, or
the size seen at run time, is under ``autoBroadcastJoinThreshold``. The hinted sides list the
hot keys, of which there is one for every ``HOT_ROWS`` rows of a table at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.text import col
from tablewright.sources.scratch import cut_lineage

# Rows of one key that go to one task of an outer join; a key with more is dealt over several.
HOT_ROWS = 1_000_000
KEY = "__key_{}"


def _as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys once each: the partial step of the aggregate folds a hot key before the shuffle.

    Grouped by a hash beside the keys, the result is not laid out as a join on the keys
    wants it, so the join shuffles it once more. Only a join between two plain shuffles is
    split by the adaptive planner when the other side has a hot key.
    """
    cols = [col(k) for k in keys]
    return df.select(*cols, F.xxhash64(*cols).alias("__spread")).distinct().select(*cols)


def any_null(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [col(k).isNull() for k in keys])


def _hot(df: DataFrame, keys: Sequence[str], names: Sequence[str], count: str) -> DataFrame | None:
    """Keys with more than ``HOT_ROWS`` rows and how many tasks they take, null if there are none.

    Reads the keys only. The list is worked out once and kept, so that both sides of a join go by the same one.
    """
    if df.isStreaming:
        return None
    cols = [col(k).alias(n) for k, n in zip(keys, names)]
    counted = df.select(*cols).groupBy(*names).agg(F.count("*").alias(count)).filter(F.col(count) > HOT_ROWS)
    kept = cut_lineage(counted.withColumn(count, F.ceil(F.col(count) / HOT_ROWS).cast("int")))
    return None if kept.isEmpty() else F.broadcast(kept)


def _drawn(df: DataFrame) -> Column:
    """A hash of the whole row, the same whenever a task runs again."""
    return F.xxhash64(*[col(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))])


def spread_join(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], how: str) -> DataFrame:
    """A left or outer join of frames without common columns; ``__in_left`` and ``__in_right``
    are true where the side has the row, else null.

    Spark splits a hot key on the left of a left join by itself, but on no other side of these
    joins. So a hot key's rows are dealt over several tasks by a hash, and the other side's rows
    of that key go to each of them; where such a copy finds nothing, it is the others that
    count. The hot keys are found first, from the keys of the side alone; without any the join is Spark's own.
    """
    outer, names = how != "left", [f"__h_{i}" for i in range(len(left_on))]
    marked = left.withColumn("__in_left", F.lit(True)), right.withColumn("__in_right", F.lit(True))
    condition = [col(x) == col(y) for x, y in zip(left_on, right_on)]
    shown = [*[col(c) for c in [*left.columns, *right.columns]], "__in_left", "__in_right"]
    hot_left = _hot(left, left_on, names, "__n") if outer else None
    hot_right = _hot(right, right_on, names, "__n")
    if hot_left is None and hot_right is None:
        return marked[0].join(marked[1], condition, "full" if outer else "left").select(*shown)
    sides = []
    for df, here, on, own_hot, far_hot, own, far, mark in (
            (left, marked[0], left_on, hot_left, hot_right, "__ls", "__rs", "__in_left"), (right, marked[1], right_on, hot_right, hot_left, "__rs", "__ls", "__in_right")):
        keyless = any_null(on)
        same = [col(k) == F.col(n) for k, n in zip(on, names)]
        dealt = F.when(keyless, F.pmod(_drawn(df), F.lit(1024))).cast("int") if outer or mark == "__in_right" else F.lit(None).cast("int")
        if own_hot is not None:
            here = here.join(own_hot, same, "left").withColumn(
                own, F.coalesce(dealt, F.pmod(_drawn(df), F.coalesce("__n", F.lit(1))).cast("int"))).drop("__n", *names)
        else:
            here = here.withColumn(own, F.coalesce(dealt, F.lit(0)))
        if far_hot is not None:
            here = here.join(far_hot.withColumnRenamed("__n", f"{mark}_n"), same, "left").drop(*names).withColumn(
                far, F.explode(F.sequence(F.lit(0), F.coalesce(f"{mark}_n", F.lit(1)) - 1)))
        else:
            here = here.withColumns({far: F.lit(0), f"{mark}_n": F.lit(None).cast("int")})
        sides.append(here.withColumnsRenamed({"__ls": f"__ls{mark}", "__rs": f"__rs{mark}"}))
    a, b = sides
    condition += [F.col(f"{s}__in_left") == F.col(f"{s}__in_right") for s in ("__ls", "__rs")]
    joined = a.join(b, condition, "full" if outer else "left")
    useless = (F.col("__in_right").isNull() & F.col("__in_left_n").isNotNull()) | (F.col("__in_left").isNull() & F.col("__in_right_n").isNotNull())
    return joined.filter(~useless).select(*shown)


def join(left: DataFrame, right: DataFrame, left_on: str | Sequence[str],
         right_on: str | Sequence[str] | None = None, how: str = "inner") -> DataFrame:
    """Join on equal keys; null keys never match and an unknown ``how`` means inner.

    The right key columns are dropped, other clashing right columns get the suffix
    ``_right``, and an outer join fills the key column from either side. A hot key is dealt
    over several tasks: by the adaptive planner in an inner join, else by :func:`spread_join`.
    """
    lk = _as_list(left_on)
    rk = _as_list(right_on) if right_on is not None else lk
    keys = [KEY.format(i) for i in range(len(lk))]
    values = [c for c in right.columns if c not in rk]
    names = {c: f"{c}_right" if c in left.columns else c for c in values}
    slim = right.select(*[col(k).alias(key) for k, key in zip(rk, keys)],
                        *[col(c).alias(names[c]) for c in values])
    if how not in ("left", "outer", "full"):
        joined = left.join(slim, [col(k) == F.col(key) for k, key in zip(lk, keys)], "inner")
        return joined.select(*[col(c) for c in [*left.columns, *names.values()]])
    joined = spread_join(left, slim, lk, keys, how)
    from_right = dict(zip(lk, keys)) if how != "left" else {}
    return joined.select(*[(F.when(F.col("__in_left"), col(c)).otherwise(F.col(from_right[c])) if c in from_right else col(c)).alias(c)
                           for c in left.columns], *[col(c) for c in names.values()])


def lookup(df: DataFrame, dictionary: DataFrame, source_key: str, lookup_key: str,
           lookup_value: str) -> DataFrame:
    """Add one column of a dictionary. A key listed twice repeats the row; a miss gives null."""
    return join(df, dictionary.select(*dict.fromkeys([lookup_key, lookup_value])), source_key, lookup_key, "left") \
        if lookup_key != lookup_value else \
        join(df, dictionary.select(col(lookup_key).alias("__k"), col(lookup_value)), source_key, "__k", "left")


def anti_join(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose keys are absent from ``other``; rows with a null key stay."""
    return df.join(distinct_keys(other, keys), list(keys), "left_anti").select(*[col(c) for c in df.columns])
