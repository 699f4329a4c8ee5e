"""Row filters over untyped cells: one predicate on a column or on the whole line."""

from __future__ import annotations

import datetime
import re
from decimal import ROUND_CEILING, ROUND_FLOOR, Context, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.text import col, is_number_text, looks_numeric, strip

# Accepted spellings of the comparison operators.
COMPARISONS = {
    "greater_than": "gt", "gt": "gt",
    "greater_or_equal": "gte", "greater_than_or_equal": "gte", "gte": "gte",
    "less_than": "lt", "lt": "lt",
    "less_or_equal": "lte", "less_than_or_equal": "lte", "lte": "lte",
}
NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.FloatType, T.DoubleType)


def compare(kind: str, left: Column, right: Column) -> Column:
    if kind == "gt":
        return left > right
    if kind == "gte":
        return left >= right
    if kind == "lt":
        return left < right
    return left <= right


def _compare_text(kind: str, cell: Column, value: str) -> Column:
    """Numbers where both sides read as numbers, text in byte order otherwise."""
    as_text = compare(kind, cell, F.lit(value))
    if not is_number_text(value):
        return as_text
    number = cell.try_cast("double")
    as_number = ~F.isnan(number) & compare(kind, number, F.lit(float(value)))
    return F.when(looks_numeric(cell), as_number).otherwise(as_text)


def _below(value: Decimal, scale: int, rounding: str) -> Decimal:
    return value.quantize(Decimal(1).scaleb(-scale), rounding, Context(prec=100))


def _bound(value: Decimal, dtype: T.DataType) -> Column | bool:
    """A literal of the column's type, or whether all its values are below."""
    bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}.get(type(dtype))
    top = Decimal(10) ** (dtype.precision - dtype.scale) - Decimal(1).scaleb(-dtype.scale) if bits is None else Decimal(2 ** (bits - 1) - 1)
    low = -top if bits is None else -top - 1
    if not low <= value <= top:
        return bool(value > top)
    return F.lit(int(value) if bits else value).cast(dtype)


def _compare_typed(kind: str, c: Column, value: str, dtype: T.DataType) -> Column | None:
    """The same on a typed column, kept in a form that reaches the Parquet scan; None where
    only the texts can be compared."""
    if isinstance(dtype, NUMERIC_TYPES):
        if not is_number_text(value) or value.lower().strip("+-") in ("nan", "inf", "infinity"):
            return None
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            hit = compare(kind, c, F.lit(float(value))) & ~F.isnan(c)
        else:
            # The nearest value of the column's grid, so that the column itself is compared.
            scale = dtype.scale if isinstance(dtype, T.DecimalType) else 0
            number = Decimal(value)
            if number.adjusted() > 60:
                hit = c.isNotNull() & F.lit((number > 0) == (kind in ("lt", "lte")))
            else:
                bound = _bound(_below(number, scale, ROUND_FLOOR if kind in ("gt", "lte") else ROUND_CEILING), dtype)
                hit = compare(kind, c, bound) if isinstance(bound, Column) else c.isNotNull() & F.lit(bound == (kind in ("lt", "lte")))
    elif isinstance(dtype, T.DateType) and _canonical(value, dtype) is not None:
        hit = compare(kind, c, _canonical(value, dtype))
    elif isinstance(dtype, T.TimestampNTZType) and _canonical(value, T.DateType()) is not None:
        # Texts of times begin with the date and are longer.
        hit = compare("gte" if kind in ("gt", "gte") else "lt", c, F.lit(f"{value} 00:00:00").cast(dtype))
    elif isinstance(dtype, T.TimestampNTZType) and _canonical(value, dtype) is not None:
        hit = compare(kind, c, _canonical(value, dtype))
    elif isinstance(dtype, T.TimestampType) and any(_canonical(value, t) is not None for t in (T.DateType(), T.TimestampNTZType())):
        # Texts are in the session's zone and go back an hour once a year; a day around the bound reaches the scan.
        bound, day = F.lit(value).cast(dtype), F.expr("interval 1 day")
        near = c >= bound - day if kind in ("gt", "gte") else c <= bound + day
        exact = compare(kind, c.cast("string"), F.lit(value))
        return (near | c.isNull()) & F.coalesce(exact, F.lit(True)) if kind in ("lt", "lte") else near & exact
    else:
        return None
    empty_hit = "" < value if kind == "lt" else "" <= value if kind == "lte" else False
    return (hit | c.isNull()) if empty_hit else hit


# How cells of these types are written as text.
TEXTS = {T.DateType: r"[0-9]{4}-[0-9]{2}-[0-9]{2}", T.TimestampNTZType: r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{0,5}[1-9])?",
         T.BooleanType: "true|false"}
TYPED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, *TEXTS)


def _canonical(value: str, dtype: T.DataType) -> Column | None:
    """The literal whose text in a column of this type is ``value``; None if there is none."""
    if type(dtype) in TEXTS:
        if not re.fullmatch(TEXTS[type(dtype)], value):
            return None
        if not isinstance(dtype, T.BooleanType):
            try:
                datetime.datetime.fromisoformat(value)
            except ValueError:
                return None
        return F.lit(value).cast(dtype)
    scale = dtype.scale if isinstance(dtype, T.DecimalType) else 0
    if not re.fullmatch(r"-?(0|[1-9][0-9]*)" + (rf"\.[0-9]{{{scale}}}" if scale else ""), value) or value.startswith("-") and not value.strip("-0."):
        return None
    bound = _bound(Decimal(value), dtype)
    return bound if isinstance(bound, Column) else None


def _among(c: Column, values: list[str], dtype: T.DataType) -> Column:
    """Whether the cell's text is one of the values, on a typed column; true or false, never null."""
    literals = [x for x in (_canonical(v, dtype) for v in values if v) if x is not None]
    hit = c.eqNullSafe(literals[0]) if len(literals) == 1 else c.isNotNull() & c.isin(literals) if literals else F.lit(False)
    return (hit | c.isNull()) if "" in values else hit


def predicate(df: DataFrame, operator: str, value: str = "", column: str | None = None,
              column_index: int | None = None, delimiter: str = ",") -> Column:
    """The condition of :func:`filter_rows` as a column."""
    op = operator.strip().lower()
    if column is not None and column not in df.columns:
        raise ValueError(f"column '{column}' not found")
    if column is None and column_index is not None:
        if column_index < 0:
            raise ValueError("column_index must not be negative")
        column = df.columns[column_index] if column_index < len(df.columns) else None
        target = col(column) if column is not None else F.lit("")
    elif column is not None:
        target = col(column)
    else:
        target = F.concat_ws(delimiter, *[F.coalesce(col(c).cast("string"), F.lit("")) for c in df.columns])
    value = str(value)
    if column is not None:
        dtype = df.schema[column].dataType
        if op in COMPARISONS:
            typed = _compare_typed(COMPARISONS[op], target, value, dtype)
            if typed is not None:
                return typed
        if isinstance(dtype, T.AtomicType) and not isinstance(dtype, (T.StringType, T.BinaryType, T.CharType, T.VarcharType)):
            if op in ("is_null", "is_empty"):
                return target.isNull()
            if op in ("is_not_null", "is_not_empty"):
                return target.isNotNull()
        if isinstance(dtype, TYPED) and not (isinstance(dtype, T.DecimalType) and dtype.scale > 6):
            if op in ("equals", "not_equals"):
                hit = _among(target, [value], dtype)
                return hit if op == "equals" else ~hit
            if op in ("in", "not_in"):
                hit = _among(target, [item.strip() for item in value.split(",")], dtype)
                return hit if op == "in" else ~hit
    cell = F.coalesce(strip(target), F.lit(""))
    if op in COMPARISONS:
        return _compare_text(COMPARISONS[op], cell, value)
    if op == "equals":
        return cell == value
    if op == "not_equals":
        return cell != value
    if op == "contains":
        return cell.contains(value)
    if op == "not_contains":
        return ~cell.contains(value)
    if op == "starts_with":
        return cell.startswith(value)
    if op == "ends_with":
        return cell.endswith(value)
    if op == "regex":
        return cell.rlike(value)
    if op in ("is_null", "is_empty"):
        return cell == ""
    if op in ("is_not_null", "is_not_empty"):
        return cell != ""
    if op in ("in", "not_in"):
        hit = cell.isin([item.strip() for item in value.split(",")])
        return hit if op == "in" else ~hit
    raise ValueError(f"unknown filter operator '{operator}'")


def filter_rows(df: DataFrame, operator: str, value: str = "", column: str | None = None,
                column_index: int | None = None, delimiter: str = ",") -> DataFrame:
    """Keep the rows whose cell meets the condition. Cells are trimmed and null reads as ''.

    Without a column the whole row is tested, its cells joined by ``delimiter``.
    """
    return df.filter(predicate(df, operator, value, column, column_index, delimiter))
