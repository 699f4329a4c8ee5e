"""Union of tables whose columns have drifted apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.text import col


def _level(dtype: T.DataType) -> int:
    """Place in the order boolean < integer < float < text; 0 is unknown."""
    if isinstance(dtype, T.NullType):
        return 0
    if isinstance(dtype, T.BooleanType):
        return 1
    if isinstance(dtype, T.IntegralType):
        return 2
    return 3 if isinstance(dtype, T.NumericType) else 4


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type of the order that holds both; equal types stay as they are."""
    if a == b:
        return a
    level = max(_level(a), _level(b))
    if 0 in (_level(a), _level(b)):
        return b if _level(a) == 0 else a
    return {1: T.BooleanType(), 2: T.LongType(), 3: T.DoubleType()}.get(level, T.StringType())


def _widen(df: DataFrame, schema: T.StructType) -> DataFrame:
    def fit(field: T.StructField):
        if field.name not in df.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        if df.schema[field.name].dataType == field.dataType:
            return col(field.name)
        return col(field.name).cast(field.dataType).alias(field.name)

    return df.select(*[fit(f) for f in schema.fields])


def widened_schema(a: T.StructType, b: T.StructType) -> T.StructType:
    """Columns of ``a`` then the new ones of ``b``, each wide enough for both."""
    others = {f.name: f.dataType for f in b.fields}
    fields = [T.StructField(f.name, common_type(f.dataType, others[f.name]) if f.name in others else f.dataType)
              for f in a.fields]
    names = {f.name for f in a.fields}
    return T.StructType(fields + [T.StructField(f.name, f.dataType) for f in b.fields if f.name not in names])


def union_with_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both; a column only one side has is null for the other."""
    schema = widened_schema(a.schema, b.schema)
    return _widen(a, schema).unionByName(_widen(b, schema))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows in the columns and types of an existing table."""
    return _widen(df, schema)
