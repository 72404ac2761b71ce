"""Nearest neighbours by cosine distance.

A task holds a bounded group of queries and their best k, and vectors stream past it; a
window ranks what the tasks kept. Nothing passes through the driver. ``nearest`` is exact: every vector
meets every group of queries. ``nearest_by_cell`` only has vectors of near cells
of a k-means model meet, each cell in blocks of a bounded number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procurespark.storage import checkpointed

BLOCK = 4096
CHUNK = 1024
CELLS = 4_194_304
NEIGHBOURS = "query_id long, id long, distance double"


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows at length 1; a zero row stays, so that its similarity is 0."""
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def best_of(ids: np.ndarray, queries: np.ndarray, similarity: np.ndarray, k: int, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k most similar columns of each row by distance, then id."""
    similarity = np.round(similarity, 12)  # so that equal vectors tie
    if skip_self:
        similarity = np.where(ids[None, :] == queries[:, None], -np.inf, similarity)
    k = min(k, similarity.shape[1])
    bound = np.partition(similarity, -k, axis=1)[:, -k]
    row, column = np.nonzero((similarity >= bound[:, None]) & np.isfinite(similarity))
    # Of those at the bound, which may be very many copies of one vector, the smallest ids stay.
    order = np.lexsort((ids[column], -similarity[row, column], row))
    row, column = row[order], column[order]
    some = np.arange(len(row)) - np.searchsorted(row, row) < k
    row, column = row[some], column[some]
    return queries[row], ids[column], 1.0 - similarity[row, column]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _compare(k: int, skip_self: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(left) and len(right):
            a, b = _unit(_matrix(left.column("v").combine_chunks())), _unit(_matrix(right.column("v").combine_chunks()))
            q, ids = left.column("id").to_numpy(), right.column("id").to_numpy()
            out += [best_of(ids, q[x : x + CHUNK], a[x : x + CHUNK] @ b.T, k, skip_self) for x in range(0, len(q), CHUNK)]
        q, i, d = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": q, "id": i, "distance": d})

    return run


def _block(n: Column | int, seed: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), n if isinstance(n, Column) else F.lit(n)).cast("int")


#: A task holds at most so many numbers of queries' vectors and so many queries, and work is dealt to this many tasks, where there is enough.
HELD, QUERIES, TASKS = 16_777_216, 65_536, 36


class _Best:
    """The k best of each query of a task among the vectors that have come by.

    Single precision tells which pairs may be among them; those are compared in double precision.
    """

    def __init__(self, ids: np.ndarray, unit: np.ndarray, k: int, skip_self: bool):
        self.ids, self.unit, self.k, self.skip = ids, unit, k, skip_self
        self.rough, self.slack = unit.astype(np.float32), 1.2e-7 * (unit.shape[1] + 16)  # above what rounding can amount to
        self.bound = np.full(len(ids), -np.inf)  # the k-th best similarity so far
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # row, id, similarity
        self.loose: list[tuple] = []
        self.n = 0

    def _exactly(self, row: np.ndarray, column: np.ndarray, unit: np.ndarray) -> np.ndarray:
        step = max(1, CELLS // max(1, unit.shape[1]))
        parts = [np.einsum("ij,ij->i", self.unit[row[x : x + step]], unit[column[x : x + step]]) for x in range(0, len(row), step)]
        return np.round(np.concatenate(parts), 12) if parts else np.zeros(0)  # so that equal vectors tie

    def meet(self, ids: np.ndarray, unit: np.ndarray) -> None:
        step, rough = max(1, CELLS // max(1, len(ids))), unit.astype(np.float32).T
        for x in range(0, len(self.ids), step):
            similarity = self.rough[x : x + step] @ rough
            least = (self.bound[x : x + step] - self.slack).astype(np.float32)
            at = np.flatnonzero(similarity >= least[:, None])
            if len(at) > 2 * self.k * len(similarity) and similarity.shape[1] > self.k:
                low = np.partition(similarity, -self.k - 1, axis=1)[:, -self.k - 1] - np.float32(2 * self.slack)  # one more, as a query may be its own best
                at = np.flatnonzero(similarity >= np.maximum(low, least)[:, None])
            row, column = np.divmod(at, len(ids))
            row, other = row + x, ids[column]
            found = self._exactly(row, column, unit)
            some = found >= self.bound[row]
            if self.skip:
                some &= other != self.ids[row]
            self.loose.append((row[some], other[some], found[some]))
            self.n += int(some.sum())
            if self.n > 4 * self.k * len(self.ids) + 1_000_000:
                self.settle()

    def settle(self) -> None:
        row, other, found = (np.concatenate(x) for x in zip(self.best, *self.loose, strict=True))
        order = np.lexsort((other, -found, row))
        row, other, found = row[order], other[order], found[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        some = place < self.k
        last = place == self.k - 1
        self.bound[row[last]] = found[last]
        self.best, self.loose, self.n = (row[some], other[some], found[some]), [], 0

    def found(self) -> pa.RecordBatch:
        self.settle()
        row, other, similarity = self.best
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(other), pa.array(1.0 - similarity)], ["query_id", "id", "distance"])


def _streamed(k: int, skip_self: bool):
    """Vectors pass the queries of each task, which come first (``side`` 0) and are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = [], None
        for batch in batches:
            side = batch.column(0).to_numpy(zero_copy_only=False)
            first = int(np.searchsorted(side, 1))
            ids, unit = batch.column(1).to_numpy(zero_copy_only=False), _unit(_matrix(batch.column(2)))
            if first:
                asked.append((ids[:first], unit[:first]))
            if first == len(side) or not asked:
                continue
            if best is None:
                best = _Best(*(np.concatenate(x) for x in zip(*asked, strict=True)), k, skip_self)
            best.meet(ids[first:], unit[first:])
            if best.n > best.k * len(best.ids):
                best.settle()
        if best is not None:
            yield best.found()

    return run


def _dealt(asked: DataFrame, offered: DataFrame, n_asked: int, n_offered: int, width: int, k: int, skip_self: bool, block: int) -> DataFrame:
    """``query_id, id, distance, rank`` of queries and vectors (``id, v``), in a number of groups of each."""
    most = max(1, min(block, HELD // max(1, width)))
    n = max(min(TASKS, -(-n_asked // min(most, CHUNK))), -(-n_asked // most), 1)
    m = max(1, min(-(-TASKS // n), -(-n_offered // BLOCK)))
    spread = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    left = asked.select(F.lit(0).alias("side"), "id", "v", _block(n, 1).alias("q"), spread(m).alias("o"))
    right = offered.select(F.lit(1).alias("side"), "id", "v", _block(m, 2).alias("o"), spread(n).alias("q")).select(left.columns)
    dealt = left.unionByName(right).repartitionById(n * m, F.col("q") * m + F.col("o")).sortWithinPartitions("side")
    return _ranked(dealt.select("side", "id", "v").mapInArrow(_streamed(k, skip_self), NEIGHBOURS), k)


def _of_copies(asked: DataFrame, offered: DataFrame, width: int, k: int, skip_self: bool, block: int) -> DataFrame:
    """As ``_dealt``, each different vector compared once and standing for its k + 1 smallest ids, which are all that a list can hold of them."""
    once = lambda df: checkpointed(df.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"))
    named = lambda df, kinds: df.join(kinds.withColumnRenamed("id", "kind"), "v").select("kind", "id")
    kinds, shown = once(asked), once(offered)
    smallest = Window.partitionBy("kind").orderBy("id")
    first = named(offered, shown).withColumn("_n", F.row_number().over(smallest)).filter(F.col("_n") <= k + 1).drop("_n")
    near = _dealt(kinds, shown, kinds.count(), shown.count(), width, k + 1, False, block).withColumnRenamed("id", "kind").drop("rank")
    lists = _ranked(near.join(first, "kind").select("query_id", "id", "distance"), k + 1).withColumnRenamed("query_id", "kind").drop("rank")
    own = named(asked, kinds).withColumnRenamed("id", "query_id").join(lists, "kind").select("query_id", "id", "distance")
    return _ranked(own.filter(F.col("query_id") != F.col("id")) if skip_self else own, k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20, id_col: str = "id", vector_col: str = "embedding", skip_self: bool = True, block: int = QUERIES) -> DataFrame:
    """``query_id, id, distance, rank``: the k vectors nearest to each query, itself left out.

    Rows with a null vector take no part; a zero vector is at distance 1 from all; of equal
    distances the smaller id goes first; no queries or no vectors give no rows. A task holds at most about ``block`` queries
    with their k best, and vectors stream past them, so every vector is shuffled once for each group of queries: 36 times up to
    36 blocks. Only where queries are few are vectors dealt to several tasks too. Where most vectors are copies of others, each is compared once.
    """
    kind = "array<double>" if dict(queries.dtypes)[vector_col] != dict(vectors.dtypes)[vector_col] else dict(vectors.dtypes)[vector_col]

    def held(df: DataFrame) -> DataFrame:
        return df.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))

    asked, offered = held(queries), held(vectors)
    of_asked = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    of_offered = offered.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("v")).alias("kinds")).first()
    width = of_asked["width"] or 1
    if of_offered["kinds"] * 2 < of_offered["n"]:
        return _of_copies(asked, offered, width, k, skip_self, block)
    return _dealt(asked, offered, of_asked["n"], of_offered["n"], width, k, skip_self, block)


def cells(vectors: DataFrame, n_cells: int, id_col: str = "id", vector_col: str = "embedding", sample: int = 100_000, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """``id, v, cell`` of each vector and the cells' centres; the model is fitted on at most about ``sample`` vectors."""
    unit = F.transform(vector_col, lambda x: F.coalesce(F.try_divide(x.cast("double"), F.sqrt(F.aggregate(vector_col, F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double")))), F.lit(0.0)))
    held = vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), unit.alias("v"))
    features = held.select("id", "v", array_to_vector("v").alias("features"))
    model = KMeans(k=n_cells, seed=seed, maxIter=10).fit(features.sample(min(1.0, sample / max(1, held.count())), seed))
    return model.transform(features).select("id", "v", F.col("prediction").alias("cell")), np.array(model.clusterCenters())


def nearest_by_cell(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, n_cells: int = 64, probes: int = 44, id_col: str = "id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """As ``nearest`` of ``queries`` (all vectors, if None), comparing each only with those of the ``probes`` cells nearest to it.

    Every vector is in the index. However crowded a cell is, its vectors and queries are
    compared in blocks. The defaults find 0.9 or more of the neighbours even where vectors have
    no clusters; where they have, fewer probes do.
    """
    placed, centres = cells(vectors, n_cells, id_col, vector_col)
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(centres)  # n_cells vectors

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1))
            near = np.argsort(-(m @ shared.value.T), axis=1)[:, : min(probes, len(shared.value))]
            at = np.repeat(np.arange(len(batch)), near.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(near.ravel().astype(np.int32))], ["id", "v", "cell"])

    placed = checkpointed(placed)
    asking = placed if queries is None else placed.join(queries.select(F.col(id_col).cast("long").alias("id")), "id", "left_semi")
    asked = checkpointed(asking.select("id", "v").mapInArrow(probe, "id long, v array<double>, cell int"))
    blocks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = F.broadcast(blocks(asked, "n").join(blocks(placed, "m"), "cell"))  # at most n_cells rows
    spread = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
    left = asked.join(sizes, "cell").withColumn("q", _block(F.col("n"), 1)).withColumn("o", spread("m")).select("cell", "q", "o", "id", "v")
    right = placed.join(sizes, "cell").withColumn("o", _block(F.col("m"), 2)).withColumn("q", spread("n")).select("cell", "q", "o", "id", "v")
    return _ranked(left.groupBy("cell", "q", "o").cogroup(right.groupBy("cell", "q", "o")).applyInArrow(_compare(k, True), NEIGHBOURS), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row, ``recall``: the share of the exact neighbours that were found."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
