"""Text made from a row by filling a template."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.text import col


# Names that stand for the time of the run, and how it is written.
CLOCK = {"CURRENT_YEAR": "yyyy", "TODAY": "yyyy-MM-dd", "NOW": "yyyy-MM-dd HH:mm:ss"}


def render_template(df: DataFrame, template: str, out: str, constants: dict[str, str] | None = None) -> DataFrame:
    """Fill ``${name}`` with the row's column, a constant, or the time of the run (``TODAY``,
    ``NOW``, ``CURRENT_YEAR``); unknown names stay as written. A null cell is written ``None``."""
    constants = constants or {}
    pieces = []
    for i, piece in enumerate(re.split(r"\$\{([^}]+)\}", template)):
        if i % 2 == 0:
            if piece:
                pieces.append(F.lit(piece))
        elif piece in df.columns:
            pieces.append(F.coalesce(col(piece).cast("string"), F.lit("None")))
        elif piece in CLOCK and piece not in constants:
            pieces.append(F.date_format(F.current_timestamp(), CLOCK[piece]))
        else:
            pieces.append(F.lit(str(constants.get(piece, "${" + piece + "}"))))
    return df.withColumn(out, F.concat(*pieces) if pieces else F.lit(""))
