"""Derive, filter and average in one scan: no step writes a file in between."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.aggregates import metric
from tablewright.operators.clean import derive, if_else
from tablewright.operators.filters import filter_rows
from tablewright.plans.registry import query, table


def mean_tax(df: DataFrame, price: str, size: str) -> DataFrame:
    """Mean of a two-rate tax on the rows whose ``size`` is above 18."""
    p = F.col(price)
    taxed = derive(df, {"tax": if_else(p >= 50000, p * 0.3, p * 0.15)})
    return metric(filter_rows(taxed, "greater_than", "18", column=size), "tax", "mean")


@query("flagship_mean_tax", """
    select round(avg(case when l_extendedprice >= 50000 then l_extendedprice * 0.3
                          else l_extendedprice * 0.15 end), 4) as value
    from lineitem where l_quantity > 18""")
def flagship(spark, folder):
    return mean_tax(table(spark, folder, "lineitem"), "l_extendedprice", "l_quantity").select(
        F.round("value", 4).alias("value"))
