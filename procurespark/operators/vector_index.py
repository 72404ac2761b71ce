"""An index of vectors: cells, coded residuals, and exact re-ranking.

Vectors at length one fall into the cell of the nearest centre. What is left of them is cut
into stretches, each replaced by the number of the nearest of 256 patterns, a byte. A query is held against the
codes of its nearest cells by looking up sums in a small table, and only the best by that are
compared as they are. Centres and patterns are fitted on a bounded sample; every vector is coded.

Queries meet codes in blocks of a bounded number of rows, however crowded a cell is; nothing but
the sample and the fitted model, whose size the parameters bound, passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procurespark.operators.knn import CHUNK, _block, _matrix, _unit
from procurespark.storage import checkpointed

PATTERNS = 256
ROUNDS = 12
#: Rows of queries and of codes that meet in a task.
QUERY_BLOCK, CODE_BLOCK = 2048, 65_536


@dataclass
class Model:
    """Centres of cells, and the patterns of each stretch of ``width`` dimensions."""

    centres: np.ndarray
    patterns: np.ndarray  # stretches, PATTERNS, width
    width: int

    def padded(self, m: np.ndarray) -> np.ndarray:
        return np.pad(m, ((0, 0), (0, self.patterns.shape[0] * self.width - m.shape[1])))

    def cells(self, unit: np.ndarray) -> np.ndarray:
        return _nearest(unit, self.centres)

    def codes(self, unit: np.ndarray, cell: np.ndarray) -> np.ndarray:
        left = self.padded(unit - self.centres[cell])
        cut = left.reshape(len(left), -1, self.width)
        return np.stack([_nearest(cut[:, s], self.patterns[s]).astype(np.uint8) for s in range(cut.shape[1])], axis=1) if len(left) else np.zeros((0, cut.shape[1]), np.uint8)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (centres * centres).sum(axis=1)
    parts = [np.argmin(square[None, :] - 2 * (rows[k : k + CHUNK] @ centres.T), axis=1) for k in range(0, len(rows), CHUNK)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _fitted(rows: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's centres of ``rows``; a centre that loses all rows takes a random one."""
    centres = rows[rng.choice(len(rows), min(n, len(rows)), replace=False)]
    for _ in range(ROUNDS):
        of = _nearest(rows, centres)
        size = np.bincount(of, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, of, rows)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], rows[rng.integers(0, len(rows), len(centres))])
    return centres


def fit(vectors: DataFrame, n_cells: int = 64, width: int = 4, sample: int = 20_000, vector_col: str = "embedding", seed: int = 42) -> Model | None:
    """A model fitted on at most ``sample`` vectors; None if there is no vector. ``sample`` vectors pass through the driver."""
    held = vectors.filter(F.col(vector_col).isNotNull()).select(F.xxhash64(vector_col, F.lit(seed)).alias("by"), F.col(vector_col).cast("array<double>").alias("v"))
    taken = held.orderBy("by").limit(sample).toArrow()
    if not taken.num_rows:
        return None
    rng, unit = np.random.default_rng(seed), _unit(_matrix(taken.column("v").combine_chunks()))
    centres = _fitted(unit, n_cells, rng)
    left = unit - centres[_nearest(unit, centres)]
    stretches = -(-left.shape[1] // width)
    left = np.pad(left, ((0, 0), (0, stretches * width - left.shape[1]))).reshape(len(left), stretches, width)
    some = [_fitted(left[:, s], PATTERNS, rng) for s in range(stretches)]
    return Model(centres, np.stack(some), width)


def coded(vectors: DataFrame, model: Model, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The index: ``id, cell, code`` of each vector. Rows with a null vector are left out; it may be written by cell and read back."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column(1)))
            cell = shared.value.cells(unit) if len(batch) else np.zeros(0, np.int64)
            code = shared.value.codes(unit, cell) if len(batch) else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], ["id", "cell", "code"])

    return vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col)).mapInArrow(run, "id long, cell int, code binary")


def _probing(shared, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            near = np.argsort(-(_unit(_matrix(batch.column(1))) @ shared.value.centres.T), axis=1)[:, :probes]
            at = pa.array(np.repeat(np.arange(len(batch)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(near.ravel().astype(np.int32))], ["id", "v", "cell"])

    return run


def _met(shared, keep: int, skip_self: bool):
    """The ``keep`` codes of a block that promise most for each query."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model: Model = shared.value
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(left) and len(right):
            cell = left.column("cell")[0].as_py()
            asked, ids, queries = _unit(_matrix(left.column("v").combine_chunks())), right.column("id").to_numpy(), left.column("id").to_numpy()
            code = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(right), -1)
            for x in range(0, len(asked), 64):
                part = asked[x : x + 64]
                cut = model.padded(part).reshape(len(part), -1, model.width)
                promise = np.repeat((part @ model.centres[cell])[:, None], len(ids), axis=1)
                for s in range(code.shape[1]):
                    promise += (cut[:, s] @ model.patterns[s].T)[:, code[:, s]]
                if skip_self:
                    promise[ids[None, :] == queries[x : x + 64, None]] = -np.inf
                best = np.argpartition(-promise, min(keep, len(ids)) - 1, axis=1)[:, :keep]
                row = np.repeat(np.arange(len(part)), best.shape[1])
                value = promise[row, best.ravel()]
                some = np.isfinite(value)
                out.append((queries[x : x + 64][row][some], ids[best.ravel()][some], value[some]))
        q, i, p = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": q, "id": i, "promise": p})

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (_unit(_matrix(batch.column(c))) for c in ("q", "v"))
        distance = 1.0 - np.round((a * b).sum(axis=1), 12) if len(batch) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array(distance)], ["query_id", "id", "distance"])


def search(index: DataFrame, model: Model | None, vectors: DataFrame, queries: DataFrame, k: int = 20, probes: int = 64, rerank: int = 50, id_col: str = "id", vector_col: str = "embedding", skip_self: bool = True) -> DataFrame:
    """``query_id, id, distance, rank`` of about the k nearest of each query; of equal distances the smaller id goes first.

    ``probes`` cells are looked at by their codes, and ``rerank`` vectors of each query compared as they are,
    whatever the number of vectors. Vectors without clusters need all cells, as their neighbours may be in any; with
    clusters a few do. Null vectors find nothing.
    """
    spark = vectors.sparkSession
    if model is None:
        return spark.createDataFrame([], "query_id long, id long, distance double, rank int")
    shared = spark.sparkContext.broadcast(model)
    plain = lambda df, name: df.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias(name), F.col(vector_col))
    asked = checkpointed(plain(queries, "id").withColumnRenamed(vector_col, "v").mapInArrow(_probing(shared, probes), f"id long, v {dict(queries.dtypes)[vector_col]}, cell int"))
    blocks = lambda df, size, name: df.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = F.broadcast(blocks(asked, QUERY_BLOCK, "n").join(blocks(index, CODE_BLOCK, "m"), "cell"))  # at most a row for each cell
    spread = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
    left = asked.join(sizes, "cell").withColumn("q", _block(F.col("n"), 1)).withColumn("o", spread("m")).select("cell", "q", "o", "id", "v")
    right = index.join(sizes, "cell").withColumn("o", _block(F.col("m"), 2)).withColumn("q", spread("n")).select("cell", "q", "o", "id", "code")
    promised = left.groupBy("cell", "q", "o").cogroup(right.groupBy("cell", "q", "o")).applyInArrow(_met(shared, rerank, skip_self), "query_id long, id long, promise double")
    best = Window.partitionBy("query_id").orderBy(F.desc("promise"), "id")
    chosen = promised.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= rerank).select("query_id", "id")
    pairs = chosen.join(plain(vectors, "id").withColumnRenamed(vector_col, "v"), "id").join(plain(queries, "query_id").withColumnRenamed(vector_col, "q"), "query_id")
    found = pairs.select("query_id", "id", "q", "v").mapInArrow(_exact, "query_id long, id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
