"""Ranked lexical search by presence masks.

Documents are reduced to the terms that a block of items asks for. In each task, and for
each item, documents are grouped by the mask of the item's terms that they hold. A mask's
highest possible score is known without looking at its documents: each term held counts at
its best in the batch. Masks are evaluated from the highest of these down, until the next
lies below the score of the k-th best document, which no document of a later mask can
reach. Each task passes on its k best of each item, and a window ranks those.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procurespark.llm.shared import by_bytes, flat_text, ranges
from procurespark.llm.words import codes_of, word_spans
from procurespark.storage import checkpointed

BATCH_BYTES = 1 << 20
#: Documents whose masks are grouped at once.
BATCH_DOCS = 8192
#: Masks that are evaluated between two looks at the k-th best score.
STEP = 64
TOP = 10
NO_ID = np.iinfo(np.int64).max

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


@dataclass
class Block:
    """Items that are searched for together; ``held`` has the numbers and repeats of each one's terms."""

    items: list[tuple[int, int | None]]  # key and id
    held: list[tuple[np.ndarray, np.ndarray]]
    terms: pa.Array
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """A code for each term in order, the terms that codes stand for, and the text of each."""
    starts, ends, owner = word_spans(_TERM[data], offsets)
    code, known = codes_of(_LOWER[data], starts, ends)
    return code, known, owner


def _block(rows: list[tuple[int, int | None, str]]) -> Block:
    data, offsets = flat_text(pa.array([t for *_, t in rows], pa.string()))
    code, known, owner = _terms(data, offsets)
    held = [np.unique(code[owner == k], return_counts=True) for k in range(len(rows))]
    return Block([(key, item) for key, item, _ in rows], held, known)


def _blocks(items: DataFrame, most: int) -> Iterator[Block]:
    """Blocks of about ``most`` characters; the driver holds one at a time."""
    held, size, key = [], 0, 0
    for item, text in items.orderBy("item_id", "text").toLocalIterator():
        held.append((key, item, text or ""))
        key, size = key + 1, size + len(text or "")
        if size >= most:
            yield _block(held)
            held, size = [], 0
    if held:
        yield _block(held)


def _postings(terms: pa.Array) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``doc_id, n, term, tf``: how many terms a text has, and those of ``terms`` with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_text(batch.column("text"))
            for a, b in by_bytes(offsets, BATCH_BYTES):
                code, known, owner = _terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                number = pc.fill_null(pc.index_in(known, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                of = number[code] if len(code) else code
                pair, tf = np.unique(owner[of >= 0] * len(terms) + of[of >= 0], return_counts=True)
                at = np.searchsorted(pair, np.arange(b - a + 1, dtype=np.int64) * len(terms)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a), pa.array(np.bincount(owner, minlength=b - a)),
                        pa.ListArray.from_arrays(pa.array(at), pa.array((pair % len(terms)).astype(np.int32))), pa.ListArray.from_arrays(pa.array(at), pa.array(tf.astype(np.int32))),
                    ],
                    ["doc_id", "n", "term", "tf"],
                )

    return run


def distinct_masks(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A column of ``present`` (terms by documents) for each different mask, and the mask of each document."""
    bits = np.packbits(present, axis=0)
    words = np.zeros((-(-len(bits) // 8) * 8, bits.shape[1]), np.uint8)
    words[: len(bits)] = bits
    first, code = np.zeros(1, np.int64), np.zeros(bits.shape[1], np.int64)
    for k in range(0, len(words), 8):
        _, own = np.unique(np.ascontiguousarray(words[k : k + 8].T).view(np.uint64)[:, 0], return_inverse=True)
        _, first, code = np.unique(code * (own.max() + 1) + own, return_index=True, return_inverse=True)
    return first, code


class _Best:
    """The k best of an item so far, by score and then by id."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """The score that a document must reach."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        some = score >= self.least
        score, ids = np.concatenate([self.score, score[some]]), np.concatenate([self.id, ids[some]])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]


def search_batch(block: Block, best: list[_Best], ids: np.ndarray, at: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
    """Brings ``best`` up to date with documents whose terms and impacts stand between the offsets ``at``."""
    doc = np.repeat(np.arange(len(ids)), np.diff(at))
    order = np.argsort(term, kind="stable")
    doc, impact = doc[order], impact[order]
    held = np.bincount(term, minlength=len(block.terms))
    starts = np.cumsum(held) - held
    most = np.zeros(len(block.terms), np.int64)
    some = np.flatnonzero(held)
    if len(some):
        most[some] = np.maximum.reduceat(impact, starts[some])
    for (terms, repeats), found in zip(block.held, best, strict=True):
        there = held[terms] > 0
        terms, weight = terms[there], (block.weight[terms] * repeats)[there]
        if not len(terms) or int(weight @ most[terms]) < found.least:
            continue
        at_term = ranges(starts[terms], held[terms])
        row, column = np.repeat(np.arange(len(terms)), held[terms]), doc[at_term]
        present = np.zeros((len(terms), len(ids)), bool)
        present[row, column] = True
        first, code = distinct_masks(present)
        bound = (weight * most[terms]) @ present[:, first]
        masks = np.flatnonzero(bound >= found.least)
        masks = masks[np.argsort(-bound[masks], kind="stable")]
        by_mask = np.argsort(code, kind="stable")
        size = np.bincount(code, minlength=len(first))
        begin = np.cumsum(size) - size
        impacts = None
        for k in range(0, len(masks), STEP):
            step = masks[k : k + STEP]
            if bound[step[0]] < found.least:
                break
            if impacts is None:
                impacts = np.zeros(present.shape, np.int64)
                impacts[row, column] = impact[at_term]
            docs = by_mask[ranges(begin[step], size[step])]
            found.add(weight @ impacts[:, docs], ids[docs])


def _searched(block: Block, total: int, length: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in block.items]
        for batch in batches:
            for x in range(0, len(batch), BATCH_DOCS):
                part = batch.slice(x, BATCH_DOCS)
                ids = pc.fill_null(part.column("doc_id"), NO_ID).to_numpy(zero_copy_only=False)
                n = part.column("n").to_numpy()
                terms, tf = part.column("term"), part.column("tf").flatten().to_numpy().astype(np.int64)
                at = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))]).astype(np.int64)
                m = 100 - 75 + (75 * n * total) // max(length, 1)
                impact = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, np.diff(at)))
                search_batch(block, best, ids, at, terms.flatten().to_numpy().astype(np.int64), impact)
        key = np.repeat([key for key, _ in block.items], [len(b.id) for b in best])
        item = pa.array([item for (_, item), b in zip(block.items, best, strict=True) for _ in b.id], pa.int64())
        ids, score = (np.concatenate([getattr(b, c) for b in best]) for c in ("id", "score"))
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), item, pa.array(ids, mask=ids == NO_ID), pa.array(score)], ["key", "item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_chars: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents that score highest for each row of ``items``, all with a score above 0 if they are fewer.

    A term's weight falls with the documents that hold it; what its occurrences count falls with
    the document's length against the mean. Equal scores go by ascending id. A null or empty
    text has no terms, finds nothing and is found by nothing; null ids come after all others;
    repeated rows of ``docs`` are documents of their own; each row of ``items`` is ranked for itself, so
    rows with one id give that many rankings; other columns are not read; an empty table
    gives an empty result. Items are taken in blocks of about ``block_chars`` characters, which
    bounds what is broadcast; each block passes over the texts once.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    found, of_corpus = None, None
    for block in _blocks(asked, block_chars):
        if not len(block.terms):
            continue
        # The texts are read once; of each only the terms that the block asks for are kept.
        held = checkpointed(picked.mapInArrow(_postings(block.terms), "doc_id long, n long, term array<int>, tf array<int>"))
        if of_corpus is None:
            of_corpus = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        total, length = of_corpus
        block.weight = np.zeros(len(block.terms), np.int64)
        for term, df in held.select(F.explode("term").alias("term")).groupBy("term").count().toLocalIterator():  # at most the block's terms
            block.weight[term] = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
        own = held.filter(F.size("term") > 0).mapInArrow(_searched(block, total, length, k), "key long, item_id long, doc_id long, score long")
        found = own if found is None else found.unionByName(own)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


#: DuckDB SQL of ``search`` with the defaults over documents and benchmark.
SEARCH_SQL = r"""
WITH cut AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM cut GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
corpus AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM size),
asked AS (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), weighed AS (
    SELECT item_id, term, (count(*) * floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE)))::BIGINT AS w FROM asked JOIN df USING (term), corpus GROUP BY item_id, term, nn, df
), scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll))))::BIGINT AS score
    FROM weighed JOIN tf USING (term) JOIN size USING (doc_id), corpus GROUP BY item_id, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0
) WHERE rank <= 10
"""
