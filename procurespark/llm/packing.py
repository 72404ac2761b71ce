"""Best-fit packing of token pieces by exact complements.

How pieces fit depends on their lengths alone, of which there are at most ``capacity``.
So the plan is made on counts by length: for each length, from the longest, single,
pair and triple sums of available lengths that fill its gap exactly are looked up and
used as often as their counts allow; what is left is placed by best fit. The plan says
how often each combination is made. Each piece then finds its place from its rank
among the pieces of its length, in parallel, without any order over all pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procurespark.llm.encoding import PASSING_PIECES, crc32_of, encoder, forget, with_end
from procurespark.llm.shared import by_bytes, flat_text, ranges
from procurespark.storage import checkpointed

BATCH_BYTES = 4 << 20
BUCKETS = 256


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int | None, capacity: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", passing: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every text.

    A sequence longer than ``capacity`` is cut into pieces of it, the first of which
    takes the remainder; others are one piece. A text without ids gives no piece; a null text
    is empty; null ids stay null; repeated rows are cut each; other columns are not read; an
    empty table gives no piece. ``passing``: a task's encoder ends with it, for less memory and more time.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = flat_text(batch.column(1))
            for a, b in by_bytes(offsets, BATCH_BYTES):
                numbers, bounds = with_end(*encoder(vocabulary, PASSING_PIECES if passing else None).ids(batch.column(1).slice(a, b - a)), end_id)
                total = np.diff(bounds)
                pieces = -(-total // capacity)
                owner = np.repeat(np.arange(b - a), pieces)
                piece = ranges(np.zeros(b - a, np.int64), pieces)
                lead = total - (np.maximum(pieces, 1) - 1) * capacity
                start = np.where(piece > 0, lead[owner] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, lead[owner])
                at = bounds[:-1][owner] + start
                held = [numbers[x : x + n] for x, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0).slice(a, b - a).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([crc32_of(x) for x in held], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([x.astype("<u4").tobytes() for x in held], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    def cut_and_forget(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from cut(batches)
        finally:
            forget(vocabulary)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(cut_and_forget if passing else cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def packing_plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths and how often each is made, using up ``counts[length]``.

    Exact combinations come first, longest piece first; the rest by best fit decreasing.
    With few pieces, exact triples or pairs can use up what fills other gaps better, so
    the plans with at most three, two, one and no complements are made and the one
    with the fewest sequences is taken.
    """
    plans = [_plan(counts, capacity, most) for most in (3, 2, 1, 0)]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def _plan(counts: np.ndarray, capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """A plan that fills gaps exactly with at most ``most`` complements."""
    left = counts.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(*lengths: int) -> bool:
        """Makes a combination as often as it can; False if it can't."""
        times = min(int(left[x]) // lengths.count(x) for x in set(lengths))
        if times:
            for x in lengths:
                left[x] -= times
            plan.append((lengths, times))
        return times > 0

    for longest in range(capacity, 0, -1):
        if not left[longest]:
            continue
        gap = capacity - longest
        if not gap:
            use(longest)
            continue
        if most >= 1 and gap <= longest and left[gap]:
            use(longest, gap)
        sizes = np.arange(1, min(gap, longest + 1) if most >= 2 else 1)
        low = sizes[(sizes <= gap - sizes) & (gap - sizes <= longest)]  # pairs, the most plentiful first
        for x in low[np.argsort(-np.minimum(left[low], left[gap - low]), kind="stable")].tolist():
            if not left[longest] or not use(longest, gap - x, x) and not min(left[x], left[gap - x]):
                break
        for a in range(min(gap - 2, longest), (gap - 1) // 3, -1) if most >= 3 and left[longest] else ():  # triples a >= b >= c
            if not left[longest]:
                break
            if not left[a]:
                continue
            rest = gap - a
            low = np.arange(max(1, rest - a), rest // 2 + 1)
            for c in low[(left[low] > 0) & (left[rest - low] > 0)].tolist():
                if not (left[longest] and left[a]):
                    break
                use(longest, a, rest - c, c)
    # Best fit decreasing of what is left, equal bins at once: open bins by the room they have.
    open_bins: dict[int, dict[tuple[int, ...], int]] = {}
    for size in range(capacity, 0, -1):
        need = int(left[size])
        while need:
            room = next((r for r in range(size, capacity) if open_bins.get(r)), capacity)
            if room == capacity:
                each = capacity // size
                bins, held = max(1, need // each), min(need, each)
                combination = (size,) * held
            else:
                before, have = open_bins[room].popitem()
                bins = min(have, need)
                if have > bins:
                    open_bins[room][before] = have - bins
                held, combination = 1, (*before, size)
            need -= bins * held
            after = capacity - sum(combination)
            into = open_bins.setdefault(after, {})
            into[combination] = into.get(combination, 0) + bins
    for room in sorted(open_bins):
        plan += sorted(open_bins[room].items())
    return plan


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """For each place in each combination: length, first rank and number of its pieces, first sequence, offset."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, times in plan:
        offset = 0
        for n in lengths:
            first = taken.get(n, 0)
            out.append((n, first, times, sequence, offset))
            taken[n], offset = first + times, offset + n
        sequence += times
    return out


def place_pieces(pieces: DataFrame, capacity: int, keys: list[str]) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; it is read several times and must not change.

    ``keys`` tell pieces apart; pieces equal in all of them are interchangeable, null keys are
    equal to each other, other columns come along and no pieces give no rows. The counts
    by length and the plan, of at most a few places for each length, are all that the
    driver holds. Ranks come from counts by length and hash bucket, so no length,
    however common, is ranked in one task.
    """
    spark: SparkSession = pieces.sparkSession
    buckets = max(BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    counted = salted.groupBy("length", "_bucket").count()
    found = counted.groupBy("length").agg(F.sum("count").alias("n")).collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in found:
        counts[r["length"]] = r["n"]
    slots = _slots(packing_plan(counts, capacity))
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for n, *slot in slots:
        by_length.setdefault(n, []).append(tuple(slot))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy("length", "_bucket").orderBy(*keys)
    ranked = salted.withColumn("_rank", F.row_number().over(own) - 1).join(firsts, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_first"))
    tables = {n: np.array(x, np.int64) for n, x in by_length.items()}
    shared = spark.sparkContext.broadcast(tables)
    columns = [c for c in pieces.columns if c != "length"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                own = shared.value[int(n)]
                k = np.searchsorted(own[:, 0], rank[at], side="right") - 1
                sequence[at], offset[at] = own[k, 2] + rank[at] - own[k, 0], own[k, 3]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), batch.column("length"), pa.array(sequence), pa.array(offset)], [*columns, "length", "sequence_id", "offset"])

    kinds = dict(pieces.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*columns, "length"]) + ", sequence_id long, offset long"
    return ranked.select(*columns, "length", "_rank").mapInArrow(find, schema)


def pack_tokens(docs: DataFrame, vocabulary: str, end_id: int | None = 2, capacity: int = 1024, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", passing: bool = False) -> DataFrame:
    """Places the pieces of all documents into as few sequences as the plan finds.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).
    A null text is empty and gives the end id alone; null ids stay null; repeated rows
    are packed each; other columns are not read; an empty table gives an empty result.
    ``passing``: as in ``token_pieces``.
    """
    pieces = checkpointed(token_pieces(docs, vocabulary, end_id, capacity, with_ids, id_col, text_col, passing))
    placed = place_pieces(pieces, capacity, ["doc_id", "piece", "start", "ids_crc32"])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def packed_sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids`` of pieces packed with their ids: at most ``capacity`` ids a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    # Two hex digits a byte keep the binary parts intact while they are joined.
    joined = F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), ""))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
