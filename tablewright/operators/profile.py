"""Column statistics of a whole table and a check of its header."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.text import col, looks_numeric, strip


# A column's texts are ranked in so many parts first, each giving its smallest.
RANK_PARTS = 256
# Rows that tell how far the smallest texts of a column may reach.
FIRST_LOOK = 1000


def profile(df: DataFrame, samples: int = 5) -> DataFrame:
    """One row per column: rows, nulls, distinct texts, number statistics, sample values.

    Counts and number statistics fold to one row per column before their shuffle. Distinct
    texts are counted by digests of 128 bits. The samples are the smallest texts: the first rows show
    a text that as many do not pass, and only texts up to it are folded and shuffled. Where they show too
    few, all of the column's are: it has few texts, or a rare value besides. A table without
    rows has a row of zeros for each column.
    """
    text = [F.coalesce(col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]

    def cells_of(rows: DataFrame) -> DataFrame:
        return rows.select(*text).unpivot([], [col(c) for c in df.columns], "column", "cell")

    cells = cells_of(df)
    trimmed = strip(F.col("cell"))
    number = F.when(looks_numeric(trimmed), trimmed.try_cast("double"))
    x = F.col("number")
    stats = cells.select("column", (trimmed == "").alias("blank"), number.alias("number")).groupBy("column").agg(
        F.count("*").alias("total_rows"), F.count_if("blank").alias("nulls"), F.count(x).alias("__n"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("__mean"), F.stddev_pop(x).alias("__std"))
    digests = cells.select("column", F.xxhash64("cell").alias("a"), F.xxhash64(F.lit(1), "cell").alias("b")).distinct()
    uniques = digests.groupBy("column").agg(F.count("a").alias("uniques"))
    look = cells_of(df.limit(FIRST_LOOK)).distinct()
    rank = F.row_number().over(Window.partitionBy("column").orderBy("cell"))
    bounds = look.withColumn("__rank", rank).filter(F.col("__rank") == samples).select("column", F.col("cell").alias("__bound"))
    near = cells.join(F.broadcast(bounds), "column", "left").filter(F.col("__bound").isNull() | (F.col("cell") <= F.col("__bound")))
    distinct = near.select("column", "cell").distinct().withColumn("__part", F.pmod(F.xxhash64("cell"), F.lit(RANK_PARTS)))

    def smallest(rows: DataFrame, *within: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("column", *within).orderBy("cell"))
        return rows.withColumn("__rank", rank).filter(F.col("__rank") <= samples)

    picked = (smallest(smallest(distinct, "__part").drop("__rank"))
              .groupBy("column").agg(F.array_sort(F.collect_list("cell")).alias("samples")))
    # Each side has one row per column of the table, so broadcasting it is bounded.
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    whole = names.join(F.broadcast(stats), "column", "left").join(F.broadcast(uniques), "column", "left").join(
        F.broadcast(picked), "column", "left")
    share = F.round(F.try_divide(F.col("nulls"), F.col("total_rows")) * 100, 1)
    none = F.array().cast("array<string>")
    return whole.select("column", F.when(F.col("__n") > 0, "numeric").otherwise("text").alias("type"),
                        F.coalesce("total_rows", F.lit(0)).alias("total_rows"), F.coalesce("nulls", F.lit(0)).alias("nulls"),
                        F.coalesce(share, F.lit(0.0)).alias("null_pct"), F.coalesce("uniques", F.lit(0)).alias("uniques"),
                        "min", "max", F.round("__mean", 2).alias("mean"), F.round("__std", 2).alias("std"),
                        F.coalesce("samples", none).alias("samples"))


def names_in(expected: str | Iterable[str]) -> list[str]:
    """Names given one by one, as the text of a JSON array, or parted by commas."""
    if isinstance(expected, str):
        text = expected.strip()
        listed = json.loads(text) if text[:1] == "[" and text[-1:] == "]" and '"' in text else text.split(",")
        return [str(name).strip() for name in listed]
    return [*expected]


def schema_check(df: DataFrame, expected: str | Iterable[str]) -> dict:
    """Which names of ``expected`` the table lacks, and which it has besides; those do no harm."""
    actual, wanted = df.columns, names_in(expected)
    absent = set(wanted).difference(actual)
    beside = set(actual).difference(wanted)
    return dict(ok=not absent, actual=actual, expected=wanted, missing=sorted(absent, key=wanted.index),
                extra=sorted(beside, key=actual.index))


def require_schema(df: DataFrame, expected: str | Iterable[str]) -> DataFrame:
    """``df`` itself, or an error that names the missing columns."""
    report = schema_check(df, expected)
    if not report["ok"]:
        raise ValueError(f"missing columns: {report['missing']}, extra: {report['extra']}")
    return df
