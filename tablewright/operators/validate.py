"""Typed rules that divide rows into valid ones and quarantine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tablewright.functions.text import col
from tablewright.operators.filters import compare

# Accepted spellings of the ordering rules.
ORDERINGS = {
    "greater_than": "gt", ">": "gt", "greater_than_or_equal": "gte", ">=": "gte",
    "less_than": "lt", "<": "lt", "less_than_or_equal": "lte", "<=": "lte",
}


def rule_condition(rule: dict) -> Column:
    """One rule ``{column, operator, value}`` as a three-valued condition."""
    c, op, value = col(rule["column"]), str(rule["operator"]).lower(), rule.get("value")
    if op in ("equals", "=="):
        return c == F.lit(value)
    if op in ("not_equals", "!="):
        return c != F.lit(value)
    if op in ORDERINGS:
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ValueError(f"rule '{op}' needs a number")
        return compare(ORDERINGS[op], c, F.lit(value))
    if op in ("contains", "regex", "matches"):
        return c.rlike(str(value))
    if op == "starts_with":
        return c.startswith(str(value))
    if op == "ends_with":
        return c.endswith(str(value))
    if op == "is_null":
        return c.isNull()
    if op == "is_not_null":
        return c.isNotNull()
    raise ValueError(f"unknown rule operator '{rule['operator']}'")


def all_rules(rules: list[dict]) -> Column:
    return reduce(lambda a, b: a & b, [rule_condition(r) for r in rules], F.lit(True))


def validate(df: DataFrame, rules: list[dict], null_policy: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """``(valid, quarantine)``. A row whose rules come out null goes to quarantine;
    ``null_policy="drop"`` leaves it out of both."""
    if null_policy not in ("quarantine", "drop"):
        raise ValueError("null_policy is 'quarantine' or 'drop'")
    ok = all_rules(rules)
    bad = ~F.coalesce(ok, F.lit(False)) if null_policy == "quarantine" else ~ok
    return df.filter(ok), df.filter(bad)


def flag_valid(df: DataFrame, rules: list[dict], flag: str = "is_valid") -> DataFrame:
    """Rows with a true/false flag: one pass over the input serves both outputs when the
    result is written with ``partitionBy(flag)``."""
    return df.withColumn(flag, F.coalesce(all_rules(rules), F.lit(False)))


def observe_validation(df: DataFrame, rules: list[dict], name: str = "validation") -> tuple[DataFrame, Observation]:
    """Flagged rows plus an observation of the counts, filled while the rows are written."""
    seen = Observation(name)
    flagged = flag_valid(df, rules)
    return flagged.observe(seen, F.count_if("is_valid").alias("valid"),
                           F.count_if(~F.col("is_valid")).alias("quarantined")), seen


def observe_rows(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """Rows plus an observation of their number, as after a filter, filled by the pass itself."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("matched")), seen


def validation_counts(df: DataFrame, rules: list[dict]) -> DataFrame:
    ok = F.coalesce(all_rules(rules), F.lit(False))
    return df.agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("quarantined"))
