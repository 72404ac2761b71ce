"""Token counts: Arrow functions that return lengths only.

Batches are made by bytes, not rows, and long texts are cut where no token can
span the cut, so memory doesn't depend on the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procurespark.llm.encoding import encoder
from procurespark.llm.shared import by_bytes, flat_text

BATCH_BYTES = 16 << 20


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, UTF-8 ``n_bytes``, ``n_tokens`` and ``over_limit`` for each row of ``docs``.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows
    are counted each; other columns, whatever their names, are not read. An empty table
    gives an empty result.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            _, offsets = flat_text(texts)
            for a, b in by_bytes(offsets, BATCH_BYTES):
                n = encoder(vocabulary).counts(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets[a : b + 1])), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
