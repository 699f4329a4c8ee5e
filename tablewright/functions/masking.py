"""Masks and digests for personal data. Null stays null in all of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the 64-bit FNV-1a hash.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3


def mask(c: Column) -> Column:
    """First and last character kept, the rest starred; one or two characters are all starred."""
    s = c.cast("string")
    n = F.length(s)
    inner = F.concat(F.left(s, F.lit(1)), F.repeat(F.lit("*"), n - 2), F.right(s, F.lit(1)))
    return F.when(n <= 2, F.repeat(F.lit("*"), n)).otherwise(inner)


def mask_email(c: Column) -> Column:
    """The part before the first ``@`` masked, the rest kept; without ``@`` all is masked."""
    s = c.cast("string")
    at = F.instr(s, "@")
    return F.when(at > 0, F.concat(mask(F.left(s, at - 1)), s.substr(at, F.length(s)))).otherwise(mask(s))


def fnv_digests(texts: pd.Series) -> pd.Series:
    """FNV-1a of each text over its UTF-8 bytes, as 16 hex digits.

    All texts of the batch advance one byte at a time together. They are ordered by
    length, so the texts still running are a prefix and the work is the sum of lengths.
    """
    data = pa.array(texts, type=pa.large_string(), from_pandas=True)
    size = len(data)
    offsets = np.frombuffer(data.buffers()[1], dtype=np.int64, count=size + 1 + data.offset)[data.offset:]
    raw = data.buffers()[2]
    body = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    starts, sorted_lengths = offsets[:-1][order], lengths[order]
    state = np.full(size, FNV_OFFSET, dtype=np.uint64)
    longest = int(sorted_lengths[0]) if size else 0
    running = np.searchsorted(-sorted_lengths, -np.arange(longest), side="left")
    for k in range(longest):
        live = running[k]
        state[:live] = (state[:live] ^ body[starts[:live] + k]) * np.uint64(FNV_PRIME)
    digests = np.empty(size, dtype=np.uint64)
    digests[order] = state
    hexed = pd.Series([f"{d:016x}" for d in digests.tolist()], index=texts.index, dtype=object)
    return hexed.where(texts.notna(), None)


def fnv1a64(c: Column) -> Column:
    """FNV-1a digest. The multiply wraps at 64 bits, which Spark's own arithmetic does not
    offer outside interpreted array functions, so it runs on Arrow batches in numpy."""

    @F.pandas_udf("string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield fnv_digests(texts)

    return digest(c.cast("string"))
