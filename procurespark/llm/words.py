"""Word boundaries of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each run of bytes that are ``inside``; runs end where texts end."""
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    starts[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(offsets, first, side="right") - 1


def codes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each stretch of bytes, equal where they are, and what each number stands for."""
    # Stretches and the gaps between them alternate in one array, without copying bytes.
    cuts = np.empty(2 * len(starts) + 1, np.int64)
    cuts[0:-1:2], cuts[1::2], cuts[-1] = starts, ends, ends[-1] if len(ends) else 0
    both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
    coded = both.take(pa.array(np.arange(0, 2 * len(starts), 2))).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
