"""What the two vector operators share: usable vectors, and exact numbers on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def usable(column: str) -> Column:
    """True for vectors that are not null or empty, have no null or non-finite component, and are not zero."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def padded(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Vectors as arrays of one length, short ones filled up with zeros; the length. Floats stay
    floats, numbers of any other kind become doubles."""
    width = df.agg(F.max(F.size(column))).first()[0] or 0
    kind = "float" if isinstance(df.schema[column].dataType.elementType, T.FloatType) else "double"
    v = F.col(column).cast(f"array<{kind}>")
    return df.withColumn(column, F.concat(v, F.array_repeat(F.lit(0).cast(kind), F.lit(width) - F.size(column)))), width


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column, floats as float32 and doubles as float64."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision; the same for equal rows wherever they stand."""
    out = np.empty(len(a))
    for i in range(0, len(a), 100_000):
        out[i : i + 100_000] = (a[i : i + 100_000].astype(np.float64) * b[i : i + 100_000]).sum(1)
    return out
