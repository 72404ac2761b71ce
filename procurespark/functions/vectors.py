"""Vectors: the hashing embedder, cosine similarity, embedding provenance."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from procurespark.functions.text import BLANK_CLASS

DIMENSIONS = 1024
#: Rows that a task holds with the places of all their tokens at once.
ROWS = 512
HASH_MODEL = "hashing-1024"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"[{BLANK_CLASS}]+"), lambda t: t != "")


def _slots(tokens: pa.Array) -> np.ndarray:
    """Each token's place: its SHA-1 modulo DIMENSIONS, taken once for each different token."""
    coded = tokens.dictionary_encode()
    known = np.array([((d := hashlib.sha1(t.encode()).digest())[-2] << 8 | d[-1]) % DIMENSIONS for t in coded.dictionary.to_pylist()], np.int64)
    return known[coded.indices.to_numpy(zero_copy_only=False)] if len(tokens) else np.zeros(0, np.int64)


def _weights(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and weight of each filled slot, from a list of tokens for each row: counts scaled to length 1."""
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    pair, n = np.unique(np.repeat(np.arange(len(tokens)), lengths) * DIMENSIONS + _slots(tokens.flatten()), return_counts=True)
    row = pair // DIMENSIONS
    square = np.bincount(row, n.astype(np.float64) ** 2, len(tokens))
    return row, pair % DIMENSIONS, n / np.sqrt(square[row])


def hash_embedding(text: Column) -> Column:
    """Token counts by slot, scaled to length 1; a zero vector for no tokens."""

    def made(held: pa.Array) -> pa.Array:
        row, slot, weight = _weights(held)
        flat = np.zeros(len(held) * DIMENSIONS)
        flat[row * DIMENSIONS + slot] = weight
        return pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32) * DIMENSIONS), pa.array(flat))

    return F.arrow_udf(made, "array<double>", PythonEvalType.SQL_SCALAR_ARROW_UDF)(tokens(text))


def sparse_embedding(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, slot, weight`` of the hashing embedder, a row for each filled slot; nothing is shuffled."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(0, len(batch), ROWS):
                ids, held = batch.column(0).slice(x, ROWS), batch.column(1).slice(x, ROWS)
                row, slot, weight = _weights(held)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(slot.astype(np.int32)), pa.array(weight)], ["id", "slot", "weight"])

    return docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("held")).mapInArrow(made, f"id {dict(docs.dtypes)[id_col]}, slot int, weight double")


def is_stale(model: Column, text_hash: Column, current_model: Column | str, current_text: Column) -> Column:
    """Whether a stored vector is of another model or text, or of none that is known."""
    current = current_model if isinstance(current_model, Column) else F.lit(current_model)
    return ~(model.eqNullSafe(current) & text_hash.eqNullSafe(F.sha2(current_text, 256)))


def embedder(provider: str, clients: dict[str, Callable[[Column], Column]] | None = None) -> Callable[[Column], Column]:
    """The embedder of a provider: the hashing one, or a client's function (a Pandas UDF, say) under its name."""
    known = {"dev": hash_embedding} | (clients or {})
    if provider not in known:
        raise ValueError(f"no embedder {provider!r}; there are {', '.join(sorted(known))}")
    return known[provider]
