"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most two bits have a variant in common that is at
most one bit away from each. The radius is 3, so half of it is one and a half bits.
Instead of all 2,081 variants within two bits, the fingerprint is seen through four
masks, each hiding another 16 bits: of three differing bits, the mask that hides the
first leaves two at most. Each fingerprint so emits 4 x 49 variants. Fingerprints are
shuffled on variants, and those that meet are verified on all 64 bits.

Only different fingerprints take part, so exact copies cost nothing. A variant's
fingerprints are its 49 sources times the 16 hidden bits, which bounds what meets;
where many meet they are linked by looking up neighbours instead of comparing pairs.
Each meeting passes on, for each fingerprint that its links connect, one link to the
first of them: what is connected stays so, and links don't grow with the square.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurespark.llm.shared import by_bytes, flat_text, free_prefix, ranges
from procurespark.storage import checkpointed

SEED = 42
WORDS = 3
RADIUS = 3
MASKS = [np.uint64(0xFFFF << (16 * k)) for k in range(4)]
BATCH_BYTES = 1 << 20
COMPARED = 24
TABULATED = 1024
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def shingled(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``size`` words, how many each text has, and a hash of each text's words.

    A text of fewer words is one shingle, one without words has none.
    """
    n = len(offsets) - 1
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~SPACES[data]
    inner = offsets[1:-1]
    # A word also ends where its text ends.
    starts_mask = word[1:-1] & ~word[:-2]
    ends_mask = word[1:-1] & ~word[2:]
    inner = inner[(inner > 0) & (inner < len(data))]
    starts_mask[inner] = word[1:-1][inner]
    ends_mask[inner - 1] = word[1:-1][inner - 1]
    starts, ends = np.flatnonzero(starts_mask), np.flatnonzero(ends_mask) + 1
    owner = np.searchsorted(offsets, starts, side="right") - 1
    # All words once more, one space after each: a shingle is then a stretch of bytes.
    lengths = ends - starts
    at = np.cumsum(lengths + 1) - lengths - 1
    spaced = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
    spaced[ranges(at, lengths)] = LOWER[data[ranges(starts, lengths)]]
    words = np.bincount(owner, minlength=n)
    first = np.cumsum(words) - words
    shingles = np.where(words >= size, words - size + 1, (words > 0).astype(np.int64))
    lead = ranges(first, shingles)
    last = np.minimum(lead + size - 1, np.repeat(first + words - 1, shingles))
    held = spaced.tobytes()
    xxh = xxhash.xxh64_intdigest
    hashes = np.array([xxh(held[a:b], SEED) for a, b in zip(at[lead].tolist(), (at[last] + lengths[last]).tolist(), strict=True)], np.uint64)
    begins = np.concatenate([at, [len(held)]])
    whole = np.array([xxh(held[a:b], SEED) for a, b in zip(begins[first].tolist(), begins[first + words].tolist(), strict=True)], np.uint64)
    return hashes, shingles, whole


def _fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SimHash of each text's word shingles."""
    hashes, shingles, _ = shingled(data, offsets, WORDS)
    out = np.zeros(len(shingles), np.uint64)
    some = np.flatnonzero(shingles)
    if len(some):
        bounds = (np.cumsum(shingles) - shingles)[some]
        for byte in range(8):
            bits = np.unpackbits(((hashes >> np.uint64(8 * byte)) & np.uint64(0xFF)).astype(np.uint8)[:, None], axis=1, bitorder="little")
            ones = np.add.reduceat(bits, bounds, axis=0, dtype=np.int32)
            over = np.packbits(2 * ones > shingles[some][:, None], axis=1, bitorder="little")[:, 0]
            out[some] |= over.astype(np.uint64) << np.uint64(8 * byte)
    return out


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed long, in place of the text.

    A null or blank text has fingerprint zero; other columns but one called ``fp`` come along;
    repeated rows stay; an empty table gives an empty result.
    """
    others = [(c, t) for c, t in docs.dtypes if c not in (text_col, "fp")]
    schema = ", ".join(f"`{c}` {t}" for c, t in [*others, ("fp", "long")])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_text(batch.column(text_col))
            for a, b in by_bytes(offsets, BATCH_BYTES):
                fp = _fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c, _ in others), pa.array(fp.view(np.int64))], [*(c for c, _ in others), "fp"])

    return docs.select(*(F.col(f"`{c}`") for c, _ in others), F.col(text_col)).mapInArrow(made, schema)


def _variants(fp: np.ndarray) -> np.ndarray:
    """The masked fingerprints and their neighbours, a row for each; the mask's number stands in the hidden bits."""
    out = []
    for k, mask in enumerate(MASKS):
        seen = (fp & ~mask) | (np.uint64(k + 1) << np.uint64(16 * k))
        flips = [np.uint64(0), *(np.uint64(1 << b) for b in range(64) if not int(mask) >> b & 1)]
        out.append(seen[:, None] ^ np.array(flips, np.uint64)[None, :])
    return np.concatenate(out, axis=1)


def _joined(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest label over what links ``a``-``b`` connect, from labels that each name a member labelled by itself.

    Only such members are hung on others, so what labels connected stays so.
    """
    while True:
        of_a, of_b = label[a], label[b]
        low = np.minimum(of_a, of_b)
        new = label.copy()
        np.minimum.at(new, of_a, low)
        np.minimum.at(new, of_b, low)
        while not np.array_equal(new, further := new[new]):
            new = further
        if np.array_equal(new, label):
            return label
        label = new


def _links_of_many(fp: np.ndarray, mask: np.uint64, shift: int, key: np.uint64) -> np.ndarray:
    """For the many fingerprints of one variant, the index of the first of each one's component."""
    hidden = ((fp & mask) >> np.uint64(shift)).astype(np.int64)
    flip = (fp & ~mask) ^ (key & ~mask)  # zero or one bit
    flips, flip_code = np.unique(np.concatenate([[np.uint64(0)], flip]), return_inverse=True)
    flip_code = flip_code[1:]
    code = hidden * len(flips) + flip_code
    order = np.argsort(code)
    ordered = code[order]
    label = np.arange(len(fp))
    _, first, back = np.unique(hidden, return_index=True, return_inverse=True)
    label = _joined(len(fp), np.arange(len(fp)), first[back], label)  # equal hidden bits: at most 2 apart
    firsts = hidden[first]
    for weight in range(1, RADIUS + 1):
        for bits in _patterns(weight):
            if weight == 1:  # at most 3 apart, whatever the rest
                at = np.minimum(np.searchsorted(firsts, hidden ^ bits), len(firsts) - 1)
                ok, other = firsts[at] == hidden ^ bits, first[at]
                label = _joined(len(fp), np.flatnonzero(ok), other[ok], label)
                continue
            for same in (True, False) if weight == 2 else (True,):
                want = (hidden ^ bits) * len(flips) + (flip_code if same else 0)
                at = np.minimum(np.searchsorted(ordered, want), len(ordered) - 1)
                ok = ordered[at] == want
                if ok.any():
                    label = _joined(len(fp), np.flatnonzero(ok), order[at[ok]], label)
    return label


@lru_cache
def _patterns(weight: int) -> list[int]:
    """All 16-bit patterns with so many bits."""
    return [x for x in range(1 << 16) if x.bit_count() == weight]


def _meet(keys: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For what links within RADIUS connect among fingerprints that share a key, each one and the first.

    ``keys`` are sorted and their runs are whole.
    """
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.concatenate([first, [len(keys)]]))
    label = np.arange(len(keys))
    run = np.repeat(np.arange(len(first)), size)
    small = size[run] <= COMPARED
    for step in range(1, COMPARED):
        a = np.flatnonzero(small[:-step] & (run[:-step] == run[step:])) if len(keys) > step else np.zeros(0, np.int64)
        if not len(a):
            break
        near = np.bitwise_count(fp[a] ^ fp[a + step]) <= RADIUS
        if near.any():
            label = _joined(len(keys), a[near], a[near] + step, label)
    for k in np.flatnonzero(size > COMPARED):
        lo, hi = first[k], first[k] + size[k]
        if hi - lo <= TABULATED:
            a, b = np.nonzero(np.bitwise_count(fp[lo:hi, None] ^ fp[None, lo:hi]) <= RADIUS)
            label[lo:hi] = lo + _joined(hi - lo, a, b, np.arange(hi - lo))
            continue
        made = np.arange(hi - lo)
        for m in range(4):  # variants of two masks may coincide; each mask links its own
            if keys[lo] & MASKS[m] == np.uint64(m + 1) << np.uint64(16 * m):
                own = np.flatnonzero(_fits(fp[lo:hi], keys[lo], m))
                made = _joined(hi - lo, own, own[_links_of_many(fp[lo:hi][own], MASKS[m], 16 * m, keys[lo])], made) if len(own) else made
        label[lo:hi] = lo + made
    linked = np.flatnonzero(label != np.arange(len(keys)))
    return fp[linked], fp[label[linked]]


def _fits(fp: np.ndarray, key: np.uint64, k: int) -> np.ndarray:
    """Which are at most one visible bit away from the key under mask ``k``."""
    return np.bitwise_count((fp ^ key) & ~MASKS[k]) <= 1


def near_links(distinct: DataFrame) -> DataFrame:
    """``a, b``: pairs that connect exactly what all links within RADIUS connect; ``distinct`` has each ``fp`` once.

    Fingerprints without a neighbour give no pair, and no fingerprints no rows.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(fp), 2048):
                keys = _variants(fp[k : k + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fp[k : k + 2048], keys.shape[1]).view(np.int64))], ["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys, fps = np.concatenate([keys, batch.column(0).to_numpy()]), np.concatenate([fps, batch.column(1).to_numpy()])
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on
            if whole:
                yield links(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield links(keys, fps)

    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        twice = np.zeros(len(keys) + 1, bool)
        twice[1:-1] = keys[1:] == keys[:-1]
        some = twice[1:] | twice[:-1]  # most variants have one fingerprint
        a, b = _meet(keys[some].view(np.uint64), fps[some].view(np.uint64)) if some.any() else (np.zeros(0, np.uint64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    emitted = distinct.select("fp").mapInArrow(emit, "key long, fp long")
    met = emitted.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node but the smallest of its component has one edge, to that smallest."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 OR down = 1 AND up = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node, root``: for each node of the links the smallest node connected with it.

    Alternates large-star and small-star steps, which take a logarithmic number of rounds
    and keep the number of links; each round is written to the shared folder. Both sides of
    each join are written down first, so that it shuffles both and a node of very many links can
    be split. Repeated links count once, links of a node to itself count for none, and no links give no rows.
    """
    edges = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        larger = both.filter(F.col("b") > F.col("a")).join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = checkpointed(larger.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        lowest = checkpointed(down.groupBy("a").agg(F.min("b").alias("m")))
        moved = down.join(lowest.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = checkpointed(moved.union(lowest.select("a", F.col("m").alias("b"))).distinct())
    own = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(own)


def fingerprint_roots(made: DataFrame) -> DataFrame:
    """``fp, root``: each fingerprint of ``made`` and the one that names its component."""
    # Few and small rows that become many: they must not be merged into a few partitions.
    parts = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = checkpointed(made.select("fp").distinct().repartition(parts, "fp"))
    roots = components(near_links(distinct)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row.

    Fingerprints link at RADIUS or fewer differing bits; component_id is the smallest id
    reachable. A null or blank text has fingerprint zero and links like any other; null
    ids count for no component_id unless all of one are null; repeated rows come back
    each; other columns are not read; an empty table gives an empty result.
    """
    made = checkpointed(fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))))
    rooted = checkpointed(fingerprint_roots(made))
    # Ids are brought down to one for each fingerprint before fingerprints meet by root.
    lowest = made.groupBy("fp").agg(F.min("doc_id").alias("first")).join(rooted, "fp")
    # Written down, so that a component of very many fingerprints can be split.
    named = checkpointed(lowest.groupBy("root").agg(F.min("first").alias("component_id")))
    of_fp = checkpointed(rooted.join(named.hint("merge"), "root").select("fp", "component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return made.join(of_fp.hint("merge"), "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """A row's id as text, empty where null, and the hash of its text."""
    return F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def row_order() -> Column:
    """What puts rows with ``id`` and ``row`` in order: the smallest id first, null ids last, then the text's hash."""
    return F.struct((F.col("id") == "").alias("none"), F.col("id").try_cast("long").alias("number"), F.col("row"), F.col("id"))


def rows_picked(docs: DataFrame, picked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each ``id, row`` of ``picked``, with all its columns; texts are shuffled once."""
    own = free_prefix(docs.columns, "_k_")
    name, row = row_key(id_col, text_col)
    keyed = docs.withColumn(f"{own}id", name).withColumn(f"{own}row", row)
    met = keyed.join(picked.select(F.col("id").alias(f"{own}id"), F.col("row").alias(f"{own}row")).hint("merge"), [f"{own}id", f"{own}row"], "left_semi")
    return met.dropDuplicates([f"{own}id", f"{own}row"]).select(*(F.col(f"`{c}`") for c in docs.columns))
