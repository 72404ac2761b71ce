"""Small column and Arrow helpers used by the corpus operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_path(path: str) -> str:
    """``path`` with the spelling of a local URI that pyarrow accepts."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return path


def free_prefix(columns: list[str], wanted: str = "_") -> str:
    """``wanted``, with underscores before it until no column begins with it, case aside."""
    while any(c.lower().startswith(wanted.lower()) for c in columns):
        wanted = "_" + wanted
    return wanted


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z and nothing else.

    ``lower`` agrees with that on pure ASCII and is much cheaper than
    ``translate``, so the latter only sees the other strings.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pure = F.length(column) == F.octet_length(column)
    return F.when(pure, F.lower(column)).otherwise(F.translate(column, upper, lower))


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the n + 1 offsets between them.

    Nulls take no bytes.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def by_bytes(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` bytes; a longer text is alone."""
    out, first, n = [], 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        out.append((first, last))
        first = last
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(start, start + length)``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
