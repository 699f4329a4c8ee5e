"""Personal data made unreadable, column by column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.masking import fnv1a64, mask, mask_email
from tablewright.functions.text import col

REDACTED = "[REDACTED]"


def _hidden(c: Column, strategy: str) -> Column:
    if strategy == "hash":
        return fnv1a64(c)
    if strategy == "mask":
        return mask(c)
    if strategy == "mask_email":
        return mask_email(c)
    return F.when(c.isNotNull(), F.lit(REDACTED))


def anonymize(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """``rules`` maps a column to ``hash``, ``mask``, ``mask_email`` or ``replace``; any other
    word replaces too. The columns become text and nulls stay null."""
    missing = [c for c in rules if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.withColumns({name: _hidden(col(name), strategy) for name, strategy in rules.items()})
