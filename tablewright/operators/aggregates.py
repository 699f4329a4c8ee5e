"""Group aggregates, single metrics, histograms. All fold partially before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.text import col
from tablewright.operators.ordering import head

# Upper bounds of the latency histogram.
BUCKET_BOUNDS = (0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0)


def aggregate(c: Column, operation: str) -> Column:
    op = operation.lower()
    if op == "sum":
        return F.coalesce(F.sum(c), F.lit(0))
    if op in ("mean", "avg"):
        return F.avg(c)
    if op == "min":
        return F.min(c)
    if op == "max":
        return F.max(c)
    if op == "count":
        return F.count(c)
    raise ValueError(f"unknown aggregate '{operation}'")


def groupby(df: DataFrame, by: Sequence[str], column: str, operation: str) -> DataFrame:
    """One aggregate per group, named ``<column>_<operation>``. Null is a group and the sum
    of nothing is 0."""
    return df.groupBy(*[col(c) for c in by]).agg(
        aggregate(col(column), operation).alias(f"{column}_{operation.lower()}"))


def metric(df: DataFrame, column: str, operation: str, pattern: str | None = None,
           limit_rows: int | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """One row with one column ``value``; ``limit_rows`` looks at the first rows only."""
    if column not in df.columns:
        raise ValueError(f"column '{column}' not found")
    if limit_rows is not None:
        df = head(df, limit_rows, order_by)
    c, op = col(column), operation.lower()
    if op == "null_count":
        value = F.count_if(c.isNull())
    elif op == "n_unique":
        value = F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("long")), F.lit(0))
    elif op == "approx_n_unique":
        value = F.hll_sketch_estimate(F.hll_sketch_agg(_sketchable(df, column), F.lit(SKETCH_BITS))) + F.coalesce(F.max(c.isNull().cast("long")), F.lit(0))
    elif op in ("match_regex", "non_match_regex"):
        if not pattern:
            raise ValueError(f"'{op}' needs a pattern")
        hit = c.cast("string").rlike(pattern)
        value = F.count_if(hit if op == "match_regex" else ~hit)
    else:
        value = aggregate(c, op)
    return df.agg(value.alias("value"))


#: Two to this power are the counters of a sketch; an estimate is off by about 1.04 / sqrt(counters), 0.4 %.
SKETCH_BITS = 16


def _sketchable(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    return col(column) if isinstance(kind, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)) else col(column).cast("string")


def unique_sketch(df: DataFrame, column: str, by: Sequence[str] = (), out: str = "sketch") -> DataFrame:
    """A sketch of the distinct values of ``column`` for each group: of one size, whatever the number of rows.
    Keep sketches of parts, such as days, and put them together with :func:`merge_sketches`. Nulls do not count."""
    return df.groupBy(*[col(b) for b in by]).agg(F.hll_sketch_agg(_sketchable(df, column), F.lit(SKETCH_BITS)).alias(out))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = (), sketch: str = "sketch") -> DataFrame:
    """Sketches of parts put together for each group, as if made from all their rows at once."""
    return sketches.groupBy(*[col(b) for b in by]).agg(F.hll_union_agg(col(sketch)).alias(sketch))


def sketched_counts(sketches: DataFrame, sketch: str = "sketch", out: str = "n_unique") -> DataFrame:
    """The estimated number of distinct values in place of each sketch."""
    return sketches.withColumn(out, F.hll_sketch_estimate(col(sketch))).drop(sketch)


def count_by(df: DataFrame, labels: Sequence[str], out: str = "n") -> DataFrame:
    return df.groupBy(*[col(c) for c in labels]).agg(F.count("*").alias(out))


def _bucket_counts(df: DataFrame, column: str, by: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    c = col(column)
    return df.groupBy(*[col(b) for b in by]).agg(
        *[F.count_if(c <= F.lit(float(b))).alias(f"__le_{i}") for i, b in enumerate(bounds)],
        F.count(c).alias("__total"), F.coalesce(F.sum(c), F.lit(0.0)).alias("__sum"))


def histogram(df: DataFrame, column: str, by: Sequence[str] = (),
              bounds: Sequence[float] = BUCKET_BOUNDS) -> DataFrame:
    """Cumulative bucket counts ``le``/``bucket_count`` with the ``total`` and ``total_sum`` of the group."""
    rows = [F.struct(F.lit(str(float(b))).alias("le"), F.col(f"__le_{i}").alias("bucket_count"))
            for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("__total").alias("bucket_count")))
    counts = _bucket_counts(df, column, by, bounds)
    return counts.select(*[col(b) for b in by], F.col("__total").alias("total"),
                         F.col("__sum").alias("total_sum"), F.inline(F.array(*rows)))


def histogram_quantiles(df: DataFrame, column: str, quantiles: Sequence[float], by: Sequence[str] = (),
                        bounds: Sequence[float] = BUCKET_BOUNDS) -> DataFrame:
    """Quantiles read off the cumulative buckets, linear within a bucket, as a dashboard does.

    The state per group is one count per bound, whatever the number of rows. A rank beyond
    the last bound gives the last bound.
    """
    edges = [float(b) for b in bounds]

    def value(q: float) -> Column:
        rank = F.lit(q) * F.col("__total")
        result = F.lit(edges[-1])
        for i in reversed(range(len(edges))):
            below = F.col(f"__le_{i - 1}") if i else F.lit(0)
            low = edges[i - 1] if i else min(edges[0], 0.0)
            inside = F.col(f"__le_{i}") - below
            share = F.when(inside > 0, (rank - below) / inside).otherwise(F.lit(0.0))
            result = F.when(F.col(f"__le_{i}") >= rank, F.lit(low) + F.lit(edges[i] - low) * share).otherwise(result)
        return F.when(F.col("__total") > 0, result)

    counts = _bucket_counts(df, column, by, bounds)
    return counts.select(*[col(b) for b in by],
                         *[value(q).alias(f"p{round(q * 100, 6):g}".replace(".", "_")) for q in quantiles])
