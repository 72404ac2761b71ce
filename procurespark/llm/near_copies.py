"""Near copies by b-bit MinHash: bands give candidates, packed low bits estimate them, full sets decide.

Texts are sets of word shingles; texts with one set are one node. Of each set BANDS x ROWS
minima are taken. Two sets meet where they share all ROWS minima of a band: of pairs at a
similarity of 0.8 all but 7 in 10 billion do. Of each minimum BITS low bits are kept, packed into
five longs: the share of equal ones, corrected for those that agree by chance, estimates the
similarity by counting bits. A link is a pair that shares a band, whose estimate is no
lower than seven standard deviations below 0.8, and whose sets are similar enough.

These rules hold whatever the size of a group. How links are found:

1. In each band, texts are held against the band's first by their bits. Those that are not close to
   it are held against all others of the band, in blocks of a bounded number, until each has
   met one that the first is connected with. That gives groups of candidates.
2. In each group, each text's set is held against that of the smallest band's first it is close to, in a
   sort-merge join that adaptive execution can split. Most groups are copies of one text and done.
3. What isn't connected with a group's first then is held against all of the group, in tasks
   of a bounded number of shingles and sets: first by a few leaders, each in one pass, then by an
   inverted index on the rarest shingles of each set, of which similar sets share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurespark.llm.shared import by_bytes, flat_text, ranges
from procurespark.llm.simhash import BATCH_BYTES, SEED, _fingerprints, _joined, components, fingerprint_roots, row_key, row_order, rows_picked, shingled
from procurespark.storage import checkpointed, shuffles_removed

WORDS = 5
SIMILARITY = 0.8
BANDS = 40
ROWS = 4
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
BITS = 2
#: Longs that hold BITS bits of each minimum.
SIGNATURE = [f"s{k}" for k in range(BANDS * ROWS * BITS // 64)]
LONGS = ", ".join(f"{c} long" for c in SIGNATURE)
LOW = 0x5555555555555555
#: Equal minima that a link must have: at a similarity of 0.8 they are 136 of 160 on average, seven standard deviations over this.
CLOSE = 104
#: Texts of a band that a task compares by their bits, and shingles of a group that it holds at once.
HELD_TEXTS = 16_384
HELD = 2_000_000
#: What a set weighs beside its shingles.
SET_WEIGHT = 32
LEADERS = 16
BLOCK = 512
EXPANDED = 1 << 21


def estimate(equal: np.ndarray | int) -> np.ndarray | float:
    """The similarity that ``equal`` of the minima's low bits tell, corrected for those that agree by chance."""
    chance = 2.0**-BITS
    return (equal / (BANDS * ROWS) - chance) / (1 - chance)


def _signed(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set, given end to end, a key for each band and the packed low bits of all minima."""
    some = sizes > 0
    bounds = (np.cumsum(sizes) - sizes)[some]
    keys, packed = np.zeros((len(bounds), BANDS), np.uint64), np.zeros((len(sizes), len(SIGNATURE)), np.uint64)
    if len(bounds):
        at, own = 0, np.zeros((len(bounds), len(SIGNATURE)), np.uint64)
        for k, factors in enumerate(FACTORS):
            key = np.full(len(bounds), k, np.uint64)
            for factor in factors:
                least = np.minimum.reduceat(hashes * factor, bounds)
                key = (key ^ (key >> np.uint64(29))) * MIX + least
                own[:, at // 64] |= ((least * MIX) >> np.uint64(64 - BITS)) << np.uint64(at % 64)
                at += BITS
            keys[:, k] = key
        packed[some] = own
    return keys, packed


def _sets_of(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the different shingles of each text, end to end and sorted, and how many each has."""
    hashes, shingles, _ = shingled(data, offsets, words)
    parts = [np.unique(p) for p in np.split(hashes, np.cumsum(shingles)[:-1])]
    return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def signatures(texts: DataFrame, words: int, prints: bool = False) -> DataFrame:
    """``id, row, node, n, bands`` and the signature of each row of ``texts`` (``id, row, text``), with ``fp``, its SimHash, if asked for.

    ``node`` is a hash of the set and ``n`` its size, 0 of a null or blank text, which has no bands.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_text(batch.column("text"))
            for a, b in by_bytes(offsets, BATCH_BYTES):
                own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                flat, sizes = _sets_of(*own, words)
                keys, packed = _signed(flat, sizes)
                ends, held = np.cumsum(sizes).tolist(), flat.tobytes()
                node = np.array([xxhash.xxh64_intdigest(held[8 * (z - n) : 8 * z], SEED) for z, n in zip(ends, sizes.tolist(), strict=True)], np.uint64)
                at = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel().view(np.int64)))
                longs = [pa.array(np.ascontiguousarray(packed[:, k]).view(np.int64)) for k in range(len(SIGNATURE))]
                more = [pa.array(_fingerprints(*own).view(np.int64))] if prints else []
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("id", "row")), pa.array(node.view(np.int64)), pa.array(sizes), bands, *longs, *more], ["id", "row", "node", "n", "bands", *SIGNATURE, *(["fp"] if prints else [])])

    return texts.mapInArrow(made, f"id string, row long, node long, n long, bands array<long>, {LONGS}{', fp long' if prints else ''}")


def nodes_of(made: DataFrame) -> DataFrame:
    """One row of ``signatures`` for each different set: ``node, n, bands``, its signature and ``first``, the row that comes first."""
    return made.groupBy("node").agg(F.min(row_order()).alias("first"), *(F.any_value(c).alias(c) for c in ("n", "bands", *SIGNATURE)))


def _equal(a: str, b: str) -> Column:
    """How many of the low bits of two structs' minima agree."""
    unlike = F.lit(0)
    for c in SIGNATURE:
        x = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
        unlike = unlike + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LOW)))
    return F.lit(BANDS * ROWS) - unlike


def equal_minima(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the low bits agree, between a signature and a row of ``b`` each."""
    x = a ^ b
    return BANDS * ROWS - np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(LOW)).sum(axis=1, dtype=np.int64)


def _dealt(members: DataFrame, most: int) -> DataFrame:
    """``members`` (``group``, ``open``, ``weight`` and more) as rows of tasks ``group, x, y``, with ``side``.

    A group within ``most`` is one task. Of a larger one, open members and the others are cut
    into chunks of half that: each chunk of open ones meets each other chunk once, and no
    two chunks of the others meet.
    """
    half = lambda w: F.ceil(F.coalesce(F.sum(w), F.lit(0)) * 2 / most).cast("int")
    weight, is_open = F.col("weight"), F.col("open")
    total = members.groupBy("group").agg((F.sum(weight) <= most).alias("fits"), F.greatest(half(F.when(is_open, weight)), F.lit(1)).alias("u"), half(F.when(~is_open, weight)).alias("a"))
    # Written down, so that a very large group's rows can be split.
    cut = members.join(checkpointed(total).hint("merge"), "group")
    chunk = F.pmod(F.xxhash64("node", F.lit(1)), F.when(is_open, F.col("u")).otherwise(F.greatest("a", F.lit(1)))).cast("int")
    cut = cut.withColumn("chunk", F.when(is_open, chunk).otherwise(F.col("u") + chunk))
    others = F.when(is_open, F.col("u") + F.col("a")).otherwise(F.col("u"))
    met = cut.withColumn("other", F.explode(F.when(F.col("fits"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), others - 1))))
    x, y = F.least("chunk", "other"), F.greatest("chunk", "other")
    at = lambda c: F.when(F.col("fits"), 0).otherwise(c)
    kept = [c for c in members.columns if c not in ("group", "weight")]
    return met.select("group", at(x).alias("x"), at(y).alias("y"), at(F.when(F.col("chunk") == x, 0).otherwise(1)).alias("side"), *kept)


def _by_task(rows: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[dict[str, pa.Array]]:
    """The columns of each task's rows, which come sorted by ``key``."""
    held: list[pa.RecordBatch] = []

    def done() -> dict[str, pa.Array]:
        table = pa.Table.from_batches(held)
        return {c: table.column(c).combine_chunks() for c in table.schema.names}

    last = None
    for batch in rows:
        if not len(batch):
            continue
        keys = [batch.column(c).to_numpy() for c in key]
        cuts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = tuple(int(k[a]) for k in keys)
            if held and own != last:
                yield done()
                held = []
            held.append(batch.slice(a, b - a))
            last = own
    if held:
        yield done()


TASK = ["group", "x", "y"]


def _links(nodes: np.ndarray, label: np.ndarray, some: np.ndarray | bool = True) -> pa.RecordBatch:
    told = (label != np.arange(len(nodes))) & some
    return pa.RecordBatch.from_arrays([pa.array(nodes[label[told]]), pa.array(nodes[told])], ["a", "b"])


def close_groups(packed: np.ndarray, is_open: np.ndarray, side: np.ndarray) -> np.ndarray:
    """For each text of a band the index of one that it is connected with by close pairs of which one is open; texts that aren't open are connected.

    An open text is compared block by block and only until it meets the others' group: what else is
    close to it meets it from its own side.
    """
    n = len(packed)
    label = np.arange(n)
    main = np.flatnonzero(~is_open)
    label[main] = main[0] if len(main) else 0
    order = np.concatenate([main, np.flatnonzero(is_open)])
    two = side.any() and not side.all()
    for x in np.flatnonzero(is_open):
        for k in range(0, n, BLOCK):
            if len(main) and label[x] == label[main[0]]:
                break
            block = order[k : k + BLOCK]
            near = block[(equal_minima(packed[x], packed[block]) >= CLOSE) & (side[block] != side[x] if two else True)]
            for other in np.unique(label[near]):
                low, high = sorted((int(other), int(label[x])), key=lambda v: (bool(is_open[v]), v))
                label[label == high] = low
    return label


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b``: what connects the texts of each band."""
    for held in _by_task(batches, TASK):
        packed = np.stack([held[c].to_numpy().view(np.uint64) for c in SIGNATURE], axis=1)
        is_open = held["open"].to_numpy(zero_copy_only=False)
        yield _links(held["node"].to_numpy(), close_groups(packed, is_open, held["side"].to_numpy()), is_open)


class _Group:
    """The sets of a task and what is known of their links."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, label: np.ndarray, side: np.ndarray, packed: np.ndarray, bands: np.ndarray, least: float):
        self.n, self.sizes, self.side, self.packed, self.bands, self.least = len(sizes), sizes, side, packed, bands, least
        self.starts = np.cumsum(sizes) - sizes
        known, self.code, df = np.unique(flat, return_inverse=True, return_counts=True)
        self.df = df
        self.mark = np.zeros(len(known), bool)
        first = np.full(label.max(initial=0) + 1, self.n)
        np.minimum.at(first, label, np.arange(self.n))
        self.label = first[label]
        self.two = bool(side.any() and not side.all())

    def linked(self, x: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` (not of the label of ``x``) link with it."""
        sizes, own = self.sizes[others], self.sizes[x]
        others = others[(self.label[others] != self.label[x]) & (sizes >= self.least * own - 1e-9) & (sizes * self.least <= own + 1e-9)]
        others = others[self.side[others] != self.side[x]] if self.two else others
        if len(others):
            others = others[equal_minima(self.packed[x], self.packed[others]) >= CLOSE]
        if len(others):
            others = others[(self.bands[others] == self.bands[x]).any(axis=1)]
        if not len(others):
            return others
        shingles = self.code[self.starts[x] : self.starts[x] + own]
        self.mark[shingles] = True
        sizes = self.sizes[others]
        common = np.add.reduceat(self.mark[self.code[ranges(self.starts[others], sizes)]], np.cumsum(sizes) - sizes, dtype=np.int64)
        self.mark[shingles] = False
        return others[common >= self.least * (sizes + own - common) - 1e-9]

    def merge(self, a: list[int], b: list[int]) -> None:
        if a:
            self.label = _joined(self.n, np.array(a), np.array(b), self.label)

    def lead(self) -> np.ndarray:
        """Holds a few sets outside the largest group against all; which sets were."""
        led, everything = np.zeros(self.n, bool), np.arange(self.n)
        for _ in range(LEADERS):
            largest = np.bincount(self.label, minlength=self.n).argmax()
            left = np.flatnonzero((self.label != largest) & ~led)
            if not len(left):
                break
            x = int(left[0])
            led[x] = True
            found = self.linked(x, everything)
            self.merge([x] * len(found), found.tolist())
        return led

    def prefixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each set's shingles from the rarest on: rank, set and place, and which a set is found by and looked up by."""
        rank = np.empty(len(self.df), np.int64)
        rank[np.argsort(self.df, kind="stable")] = np.arange(len(self.df))
        owner = np.repeat(np.arange(self.n), self.sizes)
        order = np.lexsort((rank[self.code], owner))
        held = rank[self.code][order]
        place = np.arange(len(held)) - np.repeat(self.starts, self.sizes)
        size = self.sizes[owner]
        shared = self.df[self.code][order] > 1
        both = np.ceil(2 * self.least / (1 + self.least) * size - 1e-9)
        return held, owner, place, shared & (place <= size - both), shared & (place <= size - np.ceil(self.least * size - 1e-9))

    def index(self, led: np.ndarray) -> None:
        """Finds all links of sets outside the largest group that no leader's pass has found."""
        largest = np.bincount(self.label, minlength=self.n).argmax()
        left = (self.label != largest) & ~led
        if not left.any():
            return
        held, owner, place, found_by, asked_by = self.prefixes()
        for smaller_first in (True, False):
            # A set is looked up among sets no larger than it; one of each pair must be left.
            index = np.flatnonzero(found_by & (True if smaller_first else left[owner]))
            probe = np.flatnonzero(asked_by & (left[owner] if smaller_first else ~left[owner]))
            wide = int(self.sizes.max()) + 1
            by_size = held[index] * wide + self.sizes[owner[index]]
            order = np.argsort(by_size, kind="stable")
            index, by_size = index[order], by_size[order]
            # What stands before a common shingle can't be common, which also bounds the other's size.
            own = self.sizes[owner[probe]]
            most = np.minimum(own, np.floor((own - place[probe]) * (1 + self.least) / self.least - own + 1e-6))
            lo = np.searchsorted(by_size, held[probe] * wide + np.ceil(self.least * own - 1e-6).astype(np.int64))
            hi = np.maximum(lo, np.searchsorted(by_size, held[probe] * wide + most.astype(np.int64), side="right"))
            met = np.cumsum(hi - lo)
            for a, b in by_bytes(np.concatenate([[0], met]), EXPANDED) if len(probe) else []:
                p, i = np.repeat(probe[a:b], (hi - lo)[a:b]), index[ranges(lo[a:b], (hi - lo)[a:b])]
                x, y = owner[p], owner[i]
                need = self.least / (1 + self.least) * (self.sizes[x] + self.sizes[y]) - 1e-9
                fits = (self.label[x] != self.label[y]) & (np.minimum(self.sizes[x] - place[p], self.sizes[y] - place[i]) >= need)
                pairs = np.unique(x[fits] * self.n + y[fits])
                if not len(pairs):
                    continue
                xs, first = np.unique(pairs // self.n, return_index=True)
                left_of, right_of = [], []
                for own, others in zip(xs.tolist(), np.split(pairs % self.n, first[1:]), strict=True):
                    near = self.linked(own, others)
                    left_of += [own] * len(near)
                    right_of += near.tolist()
                self.merge(left_of, right_of)


def similar(flat: np.ndarray, sizes: np.ndarray, label: np.ndarray, side: np.ndarray, packed: np.ndarray, bands: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """For each set the index of one that links connect it with; sets of one ``label`` are connected already.

    Only links between different sides count, where there are two.
    """
    group = _Group(flat, sizes, label, side, packed, bands, least)
    group.index(group.lead())
    return group.label


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b``: what connects the texts of each group as far as they are similar."""
    for held in _by_task(batches, TASK):
        sets, nodes = held["held"], held["node"].to_numpy()
        sizes = np.diff(sets.offsets.to_numpy()).astype(np.int64)
        packed = np.stack([held[c].to_numpy().view(np.uint64) for c in SIGNATURE], axis=1)
        _, label = np.unique(held["label"].to_numpy(), return_inverse=True)
        yield _links(nodes, similar(sets.flatten().to_numpy().view(np.uint64), sizes, label, held["side"].to_numpy(), packed, held["bands"].flatten().to_numpy().reshape(-1, BANDS)))


def _similar_enough(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common >= SIMILARITY * (F.size(a) + F.size(b) - common) - 1e-9


def _tasks(rows: DataFrame, run) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *TASK).sortWithinPartitions(*TASK, "node").mapInArrow(run, "a long, b long")


def near_roots(first: DataFrame, texts: DataFrame, words: int = WORDS, held_texts: int = HELD_TEXTS, held: int = HELD) -> DataFrame:
    """``node, root`` of the sets that links connect with others.

    ``first`` has a row for each different set: ``node, n, bands``, its signature, and ``id, row`` of one
    row of ``texts`` (``id, row, text``) that has it.
    """
    signature = F.struct(*SIGNATURE)
    banded = first.select("node", F.explode("bands").alias("key"))
    # Written down, so that a crowded band's join shuffles both its sides and can be split.
    heads = checkpointed(banded.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("crowd")).filter("crowd > 1"))
    met = checkpointed(banded.join(heads.hint("merge"), "key").filter("head <> node").select("key", "head", "node", "crowd"))
    pairs = met.select("head", "node").distinct().join(first.select("node", signature.alias("a")), "node")
    pairs = pairs.join(first.select(F.col("node").alias("head"), signature.alias("b")).hint("merge"), "head")
    pairs = checkpointed(pairs.select("head", "node", (_equal("a", "b") >= CLOSE).alias("close")))

    # Those not close to their band's first, where the band has others still, and all that they have to meet.
    lone = met.filter("crowd > 2").join(pairs.filter("NOT close"), ["head", "node"], "left_semi").select("key", "node")
    lone = checkpointed(lone)
    close = pairs.filter("close").select(F.col("head").alias("a"), F.col("node").alias("b"))
    if not lone.isEmpty():
        asked = checkpointed(lone.select("key").distinct())
        crowd = met.select("key", "node").unionByName(heads.select("key", F.col("head").alias("node"))).join(asked.hint("merge"), "key")
        crowd = crowd.join(lone.withColumn("open", F.lit(True)).hint("merge"), ["key", "node"], "left")
        crowd = checkpointed(crowd.select(F.col("key").alias("group"), "node", F.coalesce("open", F.lit(False)).alias("open"), F.lit(1).alias("weight")))
        close = close.unionByName(_tasks(_dealt(crowd, held_texts).join(first.select("node", *SIGNATURE).hint("merge"), "node"), _close))
    roots = checkpointed(components(close))
    taken = roots.join(first.select("node", "id", "row", "bands", *SIGNATURE), "node")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_text(batch.column("text"))
            for a, b in by_bytes(offsets, BATCH_BYTES):
                flat, sizes = _sets_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                rest = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in rest), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))], [*rest, "held"])

    rows = texts.join(taken.hint("merge"), ["id", "row"]).dropDuplicates(["id", "row"]).select("root", "node", "bands", *SIGNATURE, "text")
    sets = checkpointed(rows.mapInArrow(sets_of, f"root long, node long, bands array<long>, {LONGS}, held array<long>"))

    chosen = pairs.filter("close").groupBy("node").agg(F.min("head").alias("head"))
    alike = sets.select("node", "held").join(chosen, "node").join(sets.select(F.col("node").alias("head"), F.col("held").alias("top")).hint("merge"), "head")
    sure = checkpointed(alike.filter(_similar_enough(F.col("held"), F.col("top"))).select(F.col("head").alias("a"), F.col("node").alias("b")))
    # A group is done if each text but the first is linked with a smaller one.
    known = roots.join(sure.select(F.col("b").alias("node"), F.lit(True).alias("same")), "node", "left").withColumn("same", F.col("same").isNotNull() | (F.col("node") == F.col("root")))
    still = checkpointed(known.groupBy("root").agg(F.count_if(~F.col("same")).alias("left")).filter("left > 0").select("root"))
    if still.isEmpty():
        return components(sure)
    members = checkpointed(roots.join(still.hint("merge"), "root"))
    labels = components(sure.join(members.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")).withColumnRenamed("root", "label")
    label = F.coalesce("label", "node")
    rest = members.join(labels, "node", "left").join(first.select("node", "n"), "node")
    rest = checkpointed(rest.select(F.col("root").alias("group"), "node", label.alias("label"), (label != F.col("root")).alias("open"), (F.col("n") + SET_WEIGHT).alias("weight")))
    links = _tasks(_dealt(rest, held).join(sets.drop("root").hint("merge"), "node"), _linked)
    return components(sure.unionByName(links))


def near_components(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text", held_texts: int = HELD_TEXTS, held: int = HELD) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row.

    Texts link as the module says, on sets of ``words`` words, ASCII case and white space aside; a text of
    fewer words is one shingle. ``component_id`` is the smallest id reachable. A null or blank text
    has no shingles and links with nothing, not even its like; null ids count for no component_id
    unless all of one are null; repeated rows come back each; other columns are not read; an
    empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = own.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.xxhash64("text").alias("row"), "text")
    made = checkpointed(signatures(texts, words))
    first = checkpointed(nodes_of(made.filter("n > 0")))
    roots = near_roots(first.select("node", "n", "bands", *SIGNATURE, "first.id", "first.row"), texts, words, held_texts, held)
    number = F.col("id").try_cast("long")
    lowest = first.select("node", F.col("first.number").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = checkpointed(lowest)
    named = checkpointed(lowest.groupBy("root").agg(F.min("least").alias("component_id")))
    of_node = checkpointed(lowest.join(named.hint("merge"), "root").select("node", "component_id"))
    linked = made.filter("n > 0").select("id", "n", "node").join(of_node.hint("merge"), "node").select(number.alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    blank = made.filter("n = 0").select(number.alias("doc_id"), F.col("n").alias("n_shingles"), number.alias("component_id"))
    return linked.unionByName(blank).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def firsts_of(first: DataFrame, roots: DataFrame) -> DataFrame:
    """``id, row`` of the row that comes first of each component; ``first`` has a row for each set, ``roots`` those that links connect."""
    rooted = first.select("node", "first").join(roots.hint("merge"), "node", "left")
    return rooted.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select("first.id", "first.row")


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_texts: int = HELD_TEXTS, held: int = HELD) -> DataFrame:
    """One row of each component of near copies, that of the smallest id, with all its columns.

    Texts link as the module says, on sets of WORDS words, ASCII case and white space aside. Null and
    blank texts are copies of each other. Of rows with the smallest id the text's hash decides and
    repeated rows count as one; a component of null ids only keeps one of them; other columns,
    of whatever name, come back as they are; an empty table gives an empty result.
    """
    name, row = row_key(id_col, text_col)
    texts = docs.select(name.alias("id"), row.alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    first = checkpointed(nodes_of(checkpointed(signatures(texts, WORDS))))
    roots = checkpointed(near_roots(first.select("node", "n", "bands", *SIGNATURE, "first.id", "first.row"), texts, WORDS, held_texts, held))
    return rows_picked(docs, firsts_of(first, roots), id_col, text_col)


def print_links(made: DataFrame) -> DataFrame:
    """``a, b``: what connects the sets of ``made`` (``node, fp``) by fingerprints within RADIUS bits of each other; a set may have several."""
    of = checkpointed(made.select("node", "fp").distinct())
    rooted = checkpointed(of.join(fingerprint_roots(of).hint("merge"), "fp").select("root", "node").distinct())
    # Written down, so that a component of very many sets can be split.
    tops = checkpointed(rooted.groupBy("root").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    return rooted.join(tops.hint("merge"), "root").filter("a <> node").select("a", F.col("node").alias("b"))


def keep_one_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_texts: int = HELD_TEXTS, held: int = HELD) -> DataFrame:
    """One row of each component of near copies by either measure, that of the smallest id, with all its columns.

    Texts link where their SimHash fingerprints differ in RADIUS or fewer bits, as ``simhash`` finds them, and
    where they share SIMILARITY of their sets of WORDS words, which few fingerprints so close tell; components go over links of both kinds.
    Odd rows are as in ``keep_one_similar``; a text that differs from all others but has the blank ones' fingerprint links with them.
    """
    name, row = row_key(id_col, text_col)
    with shuffles_removed(docs.sparkSession):
        texts = docs.select(name.alias("id"), row.alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        made = checkpointed(signatures(texts, WORDS, prints=True))
        close = checkpointed(print_links(made))
        first = checkpointed(nodes_of(made))
        roots = near_roots(first.select("node", "n", "bands", *SIGNATURE, "first.id", "first.row"), texts, WORDS, held_texts, held)
        links = roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(close)
        picked = checkpointed(firsts_of(first, checkpointed(components(links))))
    return rows_picked(docs, picked, id_col, text_col)


#: DuckDB SQL of ``near_components`` with the defaults over documents.
NEAR_SQL = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
    SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS n FROM texts
), shingle AS MATERIALIZED (
    SELECT DISTINCT doc_id, md5_number(concat_ws(' ', w, lead(w, 1) OVER own, lead(w, 2) OVER own, lead(w, 3) OVER own)) AS s
    FROM words WINDOW own AS (PARTITION BY doc_id ORDER BY i) QUALIFY i = 1 OR i <= n - 3
), sized AS MATERIALIZED (SELECT d.doc_id, count(s)::BIGINT AS n FROM documents d LEFT JOIN shingle USING (doc_id) GROUP BY d.doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (
    SELECT a, b FROM common JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), reach AS (
    SELECT doc_id, doc_id AS root FROM sized
    UNION
    SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.doc_id WHERE reach.root < link.b
)
SELECT s.doc_id, s.n AS n_shingles, min(root) AS component_id, s.doc_id = min(root) AS kept FROM sized s JOIN reach USING (doc_id) GROUP BY s.doc_id, s.n
"""
