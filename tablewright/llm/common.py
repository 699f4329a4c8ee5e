"""Helpers that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one call of a scanner sees; a longer single text is a call of its own.
SLICE_BYTES = 1 << 20


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many leading underscores as it takes not to be a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column; null is read as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def text_slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` bytes of text, a longer text alone."""
    ends = np.cumsum(np.diff(text_buffers(batch.column(text))[1])) if batch.num_rows else np.zeros(0, np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def add_columns(df: DataFrame, text: str, fields: str, factory: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """``df`` with the columns ``fields`` made from its text column, batch by batch.

    ``factory`` runs once in each task and returns the scanner; it takes a text column and
    returns one array for each field. Columns of ``df`` named like a field are replaced.
    """
    extra = StructType.fromDDL(fields)
    names = {f.name.lower() for f in extra}
    source = df.select(*[c for c in df.columns if c.lower() not in names or c == text])
    keep = [c for c in source.columns if c.lower() not in names]
    schema = StructType([source.schema[c] for c in keep] + list(extra))

    def run(batches):
        scan = factory()
        for batch in batches:
            for part in text_slices(batch, text):
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + scan(part.column(text)), names=schema.names)

    return source.mapInArrow(run, schema)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``values[s : s + n]`` one after the other."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def in_training(doc_id: str = "doc_id"):
    """True for rows whose crc32(doc_id as text) mod 5 is not 0; a null id is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0, F.lit(False))


def held_out(doc_id: str = "doc_id"):
    """True for rows whose crc32(doc_id as text) mod 5 is 0; a null id counts as the empty text (crc32 0)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0
