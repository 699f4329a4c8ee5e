"""Column cleaning: derive, fill, drop, rename, select, cast."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.text import NUMBER_PATTERN, col, date_text, java_pattern
from tablewright.operators.joins import join
from tablewright.operators.ordering import deduplicate, sort

def derive(df: DataFrame, columns: Mapping[str, Column | str]) -> DataFrame:
    """Add columns in order; a later one may use an earlier one. Values are columns or SQL text."""
    for name, expression in columns.items():
        df = df.withColumn(name, F.expr(expression) if isinstance(expression, str) else expression)
    return df


def if_else(condition: Column, then: Column, otherwise: Column) -> Column:
    """A null condition counts as false."""
    return F.when(condition, then).otherwise(otherwise)


def _typed_literal(value: object) -> object:
    """A fill value given as text becomes an integer, a float, a boolean or stays text."""
    if not isinstance(value, str):
        return value
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(value, value)


def fill_na(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace nulls. A text fill on a column of another type turns that column to text."""
    filled = {}
    for name, raw in values.items():
        if name not in df.columns:
            raise ValueError(f"column '{name}' not found")
        value, dtype, c = _typed_literal(raw), df.schema[name].dataType, col(name)
        if isinstance(dtype, T.StringType):
            filled[name] = F.coalesce(c, F.lit(str(raw)))
        elif isinstance(value, str) or isinstance(value, bool) != isinstance(dtype, T.BooleanType):
            filled[name] = F.coalesce(c.cast("string"), F.lit(str(raw)))
        elif isinstance(value, float) and isinstance(dtype, T.IntegralType):
            filled[name] = F.coalesce(c.cast("double"), F.lit(value))
        else:
            filled[name] = F.coalesce(c, F.lit(value))
    return df.withColumns(filled) if filled else df


def drop_na(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def clean(df: DataFrame, *, right: DataFrame | None = None, left_on: str | None = None,
          right_on: str | None = None, how_join: str = "left", derive_columns: Mapping | None = None,
          fill: Mapping | None = None, drop_nulls: bool = False, rename_columns: Mapping | None = None,
          select_columns: Sequence[str] | None = None, dedup: bool = False,
          dedup_on: Sequence[str] | None = None, dedup_order: Sequence[str] = (), keep: str = "first",
          sort_by: str | None = None, sort_descending: bool = False) -> DataFrame:
    """All cleaning steps as one lazy plan, in a fixed order:
    join, derive, fill, drop, rename, select, deduplicate, sort."""
    if right is not None:
        if not left_on or not right_on:
            raise ValueError("a join needs both left_on and right_on")
        df = join(df, right, left_on, right_on, how_join if how_join in ("inner", "left", "outer") else "left")
    if derive_columns:
        df = derive(df, derive_columns)
    if fill:
        df = fill_na(df, fill)
    if drop_nulls:
        df = drop_na(df)
    if rename_columns:
        df = rename(df, rename_columns)
    if select_columns:
        df = df.select(*[col(c) for c in select_columns])
    if dedup or dedup_on:
        df = deduplicate(df, dedup_on, keep=keep, order_by=dedup_order)
    if sort_by:
        df = sort(df, sort_by, descending=sort_descending)
    return df


# Accepted names of the cast targets.
CAST_TARGETS = {
    "integer": "bigint", "int": "bigint", "i64": "bigint",
    "float": "double", "double": "double", "f64": "double",
    "boolean": "boolean", "bool": "boolean",
    "string": "string", "str": "string", "varchar": "string",
}


# The texts that parse as each type.
CAST_TEXTS = {"bigint": r"^[+-]?\d+$", "double": NUMBER_PATTERN, "boolean": "(?i)^(true|false)$"}


def cast_column(c: Column, target: str, from_text: bool = False) -> Column:
    kind, _, fmt = target.partition(":")
    kind = kind.strip().lower()
    if kind == "date":
        fmt = fmt or "%Y-%m-%d"
        return F.try_to_timestamp(date_text(c, fmt), F.lit(java_pattern(fmt))).cast("date")
    if kind == "datetime":
        fmt = fmt or "%Y-%m-%d %H:%M:%S"
        return F.try_to_timestamp(date_text(c, fmt), F.lit(java_pattern(fmt))).cast("timestamp_ntz")
    if kind not in CAST_TARGETS:
        raise ValueError(f"unsupported cast target '{target}'")
    target = CAST_TARGETS[kind]
    result = c.try_cast(target)
    # Looked at first, a misfit text costs no failed parse, and texts that only Spark would
    # read, as '1d' or 'yes', stay misfits.
    return F.when(c.rlike(CAST_TEXTS[target]), result) if from_text and target in CAST_TEXTS else result


def type_cast(df: DataFrame, casts: Mapping[str, str]) -> DataFrame:
    """Change column types; text that does not parse becomes null."""
    missing = [c for c in casts if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.withColumns({
        name: cast_column(col(name), target, isinstance(df.schema[name].dataType, T.StringType))
        for name, target in casts.items()})


# Bits for what a filled cell reads as.
INTEGER, WIDE, NUMBER, TRUTH, TEXT = 1, 2, 4, 8, 16


def _kind(c: Column) -> Column:
    """The bit of a cell: an integer, one too wide for bigint, a number, a truth value or text."""
    # a cast that fails is dear: it is tried where digits of that length fit and, first looked for, there is no point; else digits are compared
    size, most = F.length(c), "9223372036854775807"
    number = F.when((size < 19) | ((size == 19) & (c <= most)), c.try_cast("bigint"))
    digits = F.regexp_replace(c, r"^[+-]?0*|\s+$", "")
    fits = (F.length(digits) < 19) | ((F.length(digits) == 19) & (digits <= F.when(c.startswith("-"), "9223372036854775808").otherwise(most)))
    return (F.when(c == "", None).when(~c.contains(".") & (number.cast("string") == c), INTEGER)
            .when((size >= 19) & c.rlike(r"^[1-9]\d{18,}\z"), F.when((size > 19) | (c > most), WIDE).otherwise(INTEGER))
            .when(c.rlike(CAST_TEXTS["bigint"]), F.when(fits, INTEGER).otherwise(WIDE))
            .when(c.rlike(r"^-?\d+\.\d+$"), NUMBER).when(c.rlike(CAST_TEXTS["double"]), NUMBER)
            .when(c.rlike(CAST_TEXTS["boolean"]), TRUTH).when(c.isNotNull(), TEXT))


#: Rows that are looked at first, and characters of a cell: a column with a text cell there is text, and is not looked at again.
FIRST_LOOK = 1000
LOOKED_AT = 100


def _plain_text(cell: str | None) -> bool:
    """Whether a cell, or the start of a long one, is no number and no truth value."""
    return bool(cell) and len(cell) < LOOKED_AT and not re.search("|".join(CAST_TEXTS.values()).replace("(?i)", ""), cell, re.I)


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns turned to integer, float or boolean where every filled cell fits, in one
    pass over the rows. Integers too wide for bigint, and dates, stay text.

    The pass reads only the columns that the first ``FIRST_LOOK`` rows do not show to be text.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    look = df.select(*[F.left(col(n), F.lit(LOOKED_AT)) for n in names]).limit(FIRST_LOOK).collect()
    open_yet = [n for i, n in enumerate(names) if not any(_plain_text(row[i]) for row in look)]
    if not open_yet:
        return df
    found = df.agg(*[F.bit_or(_kind(col(n))).alias(f"k{i}") for i, n in enumerate(open_yet)]).first()
    targets = {INTEGER: "bigint", NUMBER: "double", INTEGER | NUMBER: "double", TRUTH: "boolean"}
    kinds = {n: targets.get(found[f"k{i}"]) for i, n in enumerate(open_yet)}
    return df.withColumns({n: F.when(col(n) != "", col(n)).cast(t) for n, t in kinds.items() if t})
