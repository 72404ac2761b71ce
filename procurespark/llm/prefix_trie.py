"""Conversation prefix trie with a count-min screen.

Each conversation gives a row for each of its prefixes: a digest of 128 bits and a few
numbers, never texts. A count-min sketch of the digests, of a fixed size, goes to all tasks. It never
counts too low, so an estimate of one proves that a prefix has one conversation; so have all
longer prefixes of it, and these tails become nodes where they are, without a shuffle. Only
prefixes that may be shared are shuffled, to be grouped exactly. Sums over subtrees are
taken along conversations: what a node's subtree holds is what the conversations that
pass through it hold from there on, each shared turn counted at the smallest of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procurespark.storage import checkpointed

#: The sketch: rows of counters that stop at 2, a byte each, in parts of one row of the shuffle.
ROWS = 4
PART = 1 << 16
MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93)]
NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NOTHING = hashlib.sha256(b"").hexdigest()


def _numbered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, at, d1, d2, size``: each turn's place from 0, two hashes of it and its bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    held = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), F.md5(F.encode(text, "UTF-8")).alias("tie"),
        F.xxhash64(role, text).alias("d1"), F.xxhash64(text, F.lit(7), role).alias("d2"), F.octet_length(text).cast("long").alias("size"),
    )
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "tie")
    return held.withColumn("at", F.row_number().over(order) - 1).select("conv", "at", "d1", "d2", "size")


def rebuilt(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = 5, most: int = 9) -> DataFrame:
    """``conv, at, d1, d2, size``: conversations that begin with turns of the first of their block, and a row without a place for each.

    Conversation c begins with the first h turns of c - c % ``block`` (all it has, if they are
    fewer; none, if it isn't there), and goes on with its own after the first h, where h is
    the checksum of c's decimal digits modulo ``most``.
    """
    own = checkpointed(_numbered(turns, conv_col, turn_col, role_col, text_col))
    counted = own.groupBy("conv").agg(F.count("*").alias("n"))
    h = (F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % most).cast("int")
    first = (F.col("conv") - F.col("conv") % block).alias("first")
    # At most `most` turns of each block's first go to at most `block` conversations.
    asked = counted.select("conv", h.alias("h"), first)
    asked = checkpointed(asked.join(counted.select(F.col("conv").alias("first"), F.col("n").alias("there")), "first", "left").withColumn("lead", F.least("h", F.coalesce("there", F.lit(0)))))
    lent = own.filter(F.col("at") < most - 1).withColumnRenamed("conv", "first").join(asked.select("conv", "first", "h"), "first").filter("at < h")
    kept = own.join(asked.select("conv", "h", "lead").hint("merge"), "conv").filter("at >= h").withColumn("at", (F.col("lead") + F.col("at") - F.col("h")).cast("int"))
    columns = ["conv", "at", "d1", "d2", "size"]
    none = asked.select("conv", *(F.lit(None).cast(t).alias(c) for c, t in (("at", "int"), ("d1", "long"), ("d2", "long"), ("size", "long"))))
    return lent.select(columns).unionByName(kept.select(columns)).unionByName(none)


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv, depth, a, b, pa, pb, size, ends``: each prefix of the conversations that ``rebuilt`` gives, that of depth 0 too.

    ``a, b`` are its digest and ``pa, pb`` that of the prefix before. A turn's hashes are mixed with its place,
    so the exclusive or of them tells sequences apart, and a running window makes it.
    """
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("at"))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a, b = (F.coalesce(F.bit_xor(F.when(F.col("at").isNotNull(), F.xxhash64("at", d, F.lit(k)))).over(so_far), F.lit(0)) for k, d in enumerate(("d1", "d2")))
    made = turns.withColumns({"a": a, "b": b, "depth": F.coalesce(F.col("at") + 1, F.lit(0))})
    before = lambda c: F.lag(c).over(order)
    return made.select("conv", "depth", "a", "b", before("a").alias("pa"), before("b").alias("pb"), F.coalesce("size", F.lit(0)).alias("size"), F.lead("depth").over(order).isNull().alias("ends"))


def _cells(a: np.ndarray, b: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The place of each digest in each row of a sketch ``width`` wide."""
    for mix in MIX[:ROWS]:
        x = (a ^ (b >> np.uint64(31))) * mix
        yield (((x ^ (x >> np.uint64(29))) * MIX[0] + b) >> np.uint64(20)) % np.uint64(width)


def _digests(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))


def sketch(made: DataFrame, width: int) -> Broadcast:
    """Counters of the digests ``a, b``, which stop at 2: ROWS times ``width`` bytes, whatever the number of digests."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((ROWS, width), np.uint8)
        for batch in batches:
            for row, cells in zip(held, _cells(*_digests(batch), width), strict=True):
                cell, n = np.unique(cells, return_counts=True)
                row[cell] = np.minimum(row[cell] + n, 2)
        parts = held.reshape(-1, min(PART, width))
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([parts[k].tobytes() for k in some], pa.binary())], ["part", "counters"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by part, so one part's counters are held at a time.
        part, total = None, None
        for batch in batches:
            for k, counters in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                more = np.frombuffer(counters.as_buffer(), np.uint8)
                if k != part and part is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counters"])
                total = np.minimum(total + more, 2) if k == part else more
                part = k
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counters"])

    schema = "part int, counters binary"
    summed = made.filter("depth > 0").select("a", "b").mapInArrow(counted, schema).repartition("part").sortWithinPartitions("part").mapInArrow(added, schema)
    whole = np.zeros((ROWS, width), np.uint8)
    parts = whole.reshape(-1, min(PART, width))
    for part, counters in summed.toLocalIterator():
        parts[part] = np.frombuffer(counters, np.uint8)
    return made.sparkSession.sparkContext.broadcast(whole)


def _screened(held: Broadcast, width: int):
    """``made`` with ``tail``: whether the sketch proves that this or a shorter prefix of the conversation is its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_tail = None, False  # conversations come whole and in order, but may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            conv, depth = batch.column("conv").to_numpy(), batch.column("depth").to_numpy()
            estimate = np.full(len(conv), 2, np.uint8)
            for row, cells in zip(held.value, _cells(*_digests(batch), width), strict=True):
                estimate = np.minimum(estimate, row[cells])
            proved = (estimate == 1) & (depth > 0)
            begins = np.concatenate([[True], conv[1:] != conv[:-1]])
            proved[0] |= open_tail and conv[0] == last
            seen = np.cumsum(proved)
            first = np.flatnonzero(begins)
            base = (seen - proved)[first]
            tail = seen > np.repeat(base, np.diff(np.concatenate([first, [len(conv)]])))
            last, open_tail = conv[-1], bool(tail[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tail)], [*batch.schema.names, "tail"])

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A SHA-256 of each node's conversations; rows come sorted by node and conversation, and only the hash's state is held."""
    node, state = None, None
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        rows = list(zip(*done, strict=True)) if done else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())], ["a", "b", "ends_sha256"])

    for batch in batches:
        for key in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "conv")), strict=True):
            if key[:2] != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = key[:2], hashlib.sha256(str(key[2]).encode())
            else:
                state.update(b",%d" % key[2])
        yield out()
        done = []
    if node is not None:
        done.append((*node, state.hexdigest()))
        yield out()


def prefix_trie(turns: DataFrame, width: int = 1 << 22) -> DataFrame:
    """The nodes of the trie of the conversations that ``rebuilt`` gives.

    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``, and ``proved``: whether the sketch alone told that the node has one member. The sketch takes 4 times ``width`` bytes; if the
    prefixes are many more than that, more of them are grouped exactly and the result is the same.
    """
    made = checkpointed(prefixes(turns))
    held = sketch(made, width)
    screened = checkpointed(made.mapInArrow(_screened(held, width), "conv long, depth int, a long, b long, pa long, pb long, size long, ends boolean, tail boolean"))
    shared, tails = screened.filter("NOT tail"), screened.filter("tail")
    begins = tails.withColumn("begins", (F.col("depth") == F.min("depth").over(Window.partitionBy("conv"))))

    # Exact groups of what may be shared; of a conversation in a tail only its first turn there meets them.
    entered = checkpointed(begins.filter("begins").select("conv", "depth", "pa", "pb", "ends"))
    nodes = shared.groupBy("depth", "a", "b").agg(F.count("*").alias("n_convs"), F.min("conv").alias("first"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.count_if("ends").alias("n_ends"))
    nodes = checkpointed(nodes)
    below = nodes.filter("depth > 0").groupBy("pa", "pb", (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n"))
    below = below.unionByName(entered.groupBy("pa", "pb", (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n")))
    children = below.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b"), "depth").agg(F.sum("n").alias("n_children"))
    nodes = checkpointed(nodes.join(children, ["depth", "a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    # Each turn's bytes count once for each conversation but the smallest, each leaf at the smallest that ends there.
    facts = nodes.select("depth", "a", "b", "first", "n_children")
    top = F.broadcast(facts.filter("depth = 0").select("first", "n_children"))  # one row
    along = ["conv", "depth", "a", "b", "size", "ends", "first", "n_children"]
    # The nodes are written down, so that a frequent prefix's rows can be split.
    met = shared.filter("depth > 0").join(facts.filter("depth > 0").hint("merge"), ["depth", "a", "b"]).select(along)
    met = met.unionByName(shared.filter("depth = 0").crossJoin(top).select(along))  # with one row
    own = F.col("conv") == F.col("first")
    steps = met.select("conv", "depth", "a", "b", F.when(own, 0).otherwise(F.col("size")).alias("saved"), (F.col("ends") & own & (F.col("n_children") == 0)).cast("long").alias("leaf"), F.lit(True).alias("inside"))
    steps = steps.unionByName(entered.select("conv", "depth", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("saved"), F.lit(1).cast("long").alias("leaf"), F.lit(False).alias("inside")))
    on = Window.partitionBy("conv").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = steps.select("depth", "a", "b", "inside", F.sum("saved").over(on).alias("saved"), F.sum("leaf").over(on).alias("leaf")).filter("inside")
    sums = sums.groupBy("depth", "a", "b").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))

    ending = shared.filter("ends").select("a", "b", "conv")
    ends = ending.repartition("a", "b").sortWithinPartitions("a", "b", "conv").mapInArrow(_hashed, "a long, b long, ends_sha256 string")
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("first").alias("parent_conv_id"))
    whole = nodes.join(sums, ["depth", "a", "b"]).join(ends, ["a", "b"], "left").join(parent.hint("merge"), ["depth", "pa", "pb"], "left")
    of_shared = whole.select(F.col("first").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), F.lit(False).alias("proved"))

    def alone(df: DataFrame, parent_id: Column) -> DataFrame:
        one, digest = F.lit(1).cast("long"), F.when(F.col("ends"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.lit(NOTHING))
        return df.select(F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), parent_id.alias("parent_conv_id"), one.alias("n_convs"), F.when(F.col("ends"), 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), digest.alias("ends_sha256"), F.lit(True).alias("proved"))

    of_tails = alone(begins.filter("NOT begins"), F.col("conv")).unionByName(alone(entered.join(parent.hint("merge"), ["depth", "pa", "pb"]), F.col("parent_conv_id")))
    return of_shared.unionByName(of_tails)


def conversation_trie(conversations: DataFrame, width: int = 1 << 22) -> DataFrame:
    """``prefix_trie`` of ``conv_id, turn, role, text``, each conversation rebuilt as ``rebuilt`` says.

    Turns go by number, null first; of equal ones role and then the text's hash decide, and
    repeated rows are turns of their own. Null role or text is empty; rows without a conv_id belong to no
    conversation; a conversation without turns left is a member of the root; no rows give no
    node, not even the root; other columns are not read.
    """
    return prefix_trie(rebuilt(conversations), width)


_CRC_BYTE = "xor(acc, x)"
for _ in range(8):
    _CRC_BYTE = f"list_reduce([{_CRC_BYTE}, 0], lambda v, w: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))"

#: DuckDB SQL of ``conversation_trie`` over conversations.
TRIE_SQL = f"""
WITH own AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS i
    FROM conversations WHERE conv_id IS NOT NULL
), asked AS (
    SELECT c, c - c % 5 AS first, count(*) AS n,
        xor(list_reduce([4294967295] || list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda acc, x: {_CRC_BYTE}), 4294967295) % 9 AS h
    FROM own GROUP BY c
), led AS (
    SELECT a.*, least(a.h, coalesce(f.n, 0)) AS lead FROM asked a LEFT JOIN asked f ON f.c = a.first
), turn AS (
    SELECT l.c, o.i + 1 AS depth, o.role, o.text FROM led l JOIN own o ON o.c = l.first WHERE o.i < l.h
    UNION ALL
    SELECT l.c, l.lead + o.i - l.h + 1, o.role, o.text FROM led l JOIN own o ON o.c = l.c WHERE o.i >= l.h
), prefix AS (
    SELECT c, depth, octet_length(encode(text))::BIGINT AS bytes, md5(to_json(list([role, text]) OVER (PARTITION BY c ORDER BY depth))::VARCHAR) AS k FROM turn
    UNION ALL SELECT c, 0, 0, '' FROM asked
), prefix_of AS (
    SELECT *, lag(k) OVER (PARTITION BY c ORDER BY depth) AS above, lead(k) OVER (PARTITION BY c ORDER BY depth) IS NULL AS ends FROM prefix
), node AS (
    SELECT k, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(above) AS above, any_value(bytes) AS bytes,
        sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
    FROM prefix_of GROUP BY k, depth
), kids AS (SELECT above, depth, count(*) AS n_children FROM node GROUP BY above, depth
), full_node AS (SELECT n.*, coalesce(kids.n_children, 0) AS n_children FROM node n LEFT JOIN kids ON kids.above = n.k AND kids.depth = n.depth + 1
), under AS (
    SELECT p.k, p.depth, sum((n.n_convs - 1) * n.bytes) AS saved_tokens, count(*) FILTER (n.n_children = 0) AS n_leaves
    FROM full_node n JOIN prefix p ON p.c = n.conv_id AND p.depth <= n.depth GROUP BY p.k, p.depth
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
    u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_node n JOIN under u ON u.k = n.k AND u.depth = n.depth LEFT JOIN full_node p ON p.k = n.above AND p.depth = n.depth - 1
"""
