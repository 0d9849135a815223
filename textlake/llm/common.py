"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; lower() suffices, and is faster, where every character is one byte."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text; a null text counts as empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


#: What operators keep in a worker from task to task.
CACHES: list[dict] = []


def trim() -> None:
    """Give memory that is free back to the system: workers live on, and share a machine with the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def keep_only(own: dict | None) -> None:
    """Drop what operators other than the one that begins here have left in this worker."""
    left = [c for c in CACHES if c is not own and c]
    for c in left:
        c.clear()
    if left:
        gc.collect()
        trim()


def texts_of(column: pa.Array) -> list:
    """The texts as Python has them. Spark keeps bytes that are no UTF-8 in strings; they become U+FFFD here, for all operators."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def text_slices(parts: Iterator[pa.RecordBatch], column: str = "text", most: int = 4_000_000, own: dict | None = None) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with their texts, of about `most` bytes each: what a task holds does not depend on how long
    the texts of a batch are. own: the operator's cache, the only one that stays."""
    keep_only(own)
    for part in parts:
        if not part.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(part[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), part.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            piece = part.slice(a, b - a)
            yield piece, texts_of(piece[column])
    trim()
