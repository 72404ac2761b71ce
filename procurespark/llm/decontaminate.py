"""Benchmark decontamination by the q-gram lemma.

A passage of m characters that a text holds with at most k edits shares at least
m + 1 - q - kq of its q-grams, all within k + 1 neighbouring diagonals. Shared q-grams are
counted in overlapping bands of diagonals, twice as wide, one of which so has them all;
bands that reach the bound are kept and verified by alignment inside the band.

The benchmark is taken in blocks of a fixed number of characters, each of which is
broadcast; one pass over the texts searches BLOCKS of them, so a task holds a bounded
part of the benchmark. Texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procurespark.llm.shared import ranges

BASE = 0x9E3779B97F4A7C15  # odd; products are taken modulo 2 ** 64
SPREAD = 0xD6E8FEB86659FD93
TABLE_BITS = 22
BLOCKS = 4
BATCH_CHARS = 1_000_000
HITS = 2_000_000


@dataclass
class Rules:
    """q: characters of a q-gram. rate: edits allowed for each character of a passage. window: items
    are searched in stretches of so many characters, each half over the next. shortest: items
    below it can't be told from changed common wording and are searched as they are, between words.
    least: shared q-grams that a band needs at any rate; short passages have fewer edits allowed for
    it. part: items are also searched in stretches of so many characters, or of four fifths of
    the item if that is less, ``stride`` or a tenth of the item apart; 0: they are not.

    With parts of 80 characters 20 apart, a stretch of 99 characters holds a whole part, which
    may have 6 edits; one of 200 holds two that don't overlap, so 13 edits leave one of them found."""

    q: int = 10
    rate: float = 0.08
    window: int = 200
    shortest: int = 30
    least: int = 8
    part: int = 0
    stride: int = 20

    def edits(self, size: int) -> int:
        return max(0, min(int(self.rate * size), (size - self.q + 1 - self.least) // self.q))

    def places(self, size: int) -> list[tuple[int, int, bool]]:
        """Start and length of each passage of an item of ``size`` characters, and whether it is only a part."""
        step = max(1, self.window // 2)
        last = max(0, size - self.window)
        whole = [(s, min(self.window, size), False) for s in sorted({*range(0, max(1, last), step), last})]
        length = max(self.shortest, min(self.part, -(-4 * size // 5)))
        if not self.part or length >= size:
            return whole
        step = min(self.stride, max(1, size // 10))
        return whole + [(s, length, True) for s in sorted({*range(0, size - length, step), size - length})]


#: What the operator searches: with parts, so that an item held in part is found.
PARTS = Rules(part=80)


@lru_cache(1)
def _lower() -> np.ndarray:
    """The lower case of each code point below 2 ** 16 that has one of a single code point, else itself."""
    cases = (chr(p).lower() if not 0xD800 <= p < 0xE000 else chr(p) for p in range(1 << 16))
    return np.array([ord(c) if len(c) == 1 else p for p, c in enumerate(cases)], np.uint32)


def normalized(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case and white space as single spaces, and where each stood."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    blank = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    points = np.where(blank, 0x20, np.where(points < 1 << 16, _lower()[np.minimum(points, 0xFFFF)], points))
    kept = np.ones(len(points), bool)
    kept[1:] = ~(blank[1:] & blank[:-1])
    at = np.flatnonzero(kept)
    return points[at], at


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q-gram at each place that has one, from hashes of half the size."""
    if len(points) < q:
        return np.zeros(0, np.uint64)
    powers = {1: points.astype(np.uint64)}
    size = 1
    while 2 * size <= q:
        half = powers[size]
        powers[2 * size] = half[:-size] * np.uint64(pow(BASE, size, 1 << 64)) + half[size:]
        size *= 2
    n, out, done = len(points) - q + 1, None, 0
    while done < q:
        step = max(s for s in powers if s <= q - done)
        part = powers[step][done : done + n]
        out = part.copy() if out is None else out * np.uint64(pow(BASE, step, 1 << 64)) + part
        done += step
    return out


@dataclass
class Index:
    """The q-grams of a block of the benchmark."""

    rules: Rules
    items: np.ndarray  # of each passage: its item
    sizes: np.ndarray
    edits: np.ndarray
    bounds: np.ndarray  # shared q-grams needed
    text: np.ndarray  # of all passages, one after another
    begin: np.ndarray  # where each passage stands there
    known: np.ndarray  # sorted hashes
    first: np.ndarray
    times: np.ndarray
    passage: np.ndarray  # of each place of a hash, by hash
    place: np.ndarray
    table: np.ndarray
    partly: np.ndarray  # of each passage: whether it is a part that an item is searched in besides
    short: dict[int, dict[bytes, list[int]]]  # items too short for edits, by length and code points


def build(items: list[tuple[int, str]], rules: Rules) -> Index | None:
    passages, partly = [], []
    short: dict[int, dict[bytes, list[int]]] = {}
    for item, text in items:
        points, _ = normalized(text.strip())
        if 0 < len(points) < rules.shortest:
            short.setdefault(len(points), {}).setdefault(points.astype(np.uint32).tobytes(), []).append(item)
        if len(points) < rules.shortest:
            continue
        for start, length, part in rules.places(len(points)):
            passages.append((item, points[start : start + length]))
            partly.append(part)
    if not passages and not short:
        return None
    if not passages:  # one that no text holds, for the shape of what follows
        passages, partly = [(-1, np.full(rules.shortest, 0xFFFFFFFE, np.uint32))], [False]
    sizes = np.array([len(p) for _, p in passages])
    edits = np.array([rules.edits(int(n)) for n in sizes])
    held = [grams(p, rules.q) for _, p in passages]
    hashes = np.concatenate(held)
    order = np.argsort(hashes, kind="stable")
    known, first, times = np.unique(hashes[order], return_index=True, return_counts=True)
    table = np.zeros(1 << TABLE_BITS, bool)
    table[_slot(known)] = True
    passage = np.repeat(np.arange(len(passages), dtype=np.int32), [len(x) for x in held])
    place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in held])
    return Index(rules, np.array([i for i, _ in passages], np.int64), sizes, edits, sizes - rules.q + 1 - rules.q * edits, np.concatenate([p for _, p in passages]), np.cumsum(sizes) - sizes, known, first, times, passage[order], place[order], table, np.array(partly), short)


def _rows(index: Index, passages: np.ndarray) -> np.ndarray:
    """Passages as rows, filled up with zeros."""
    reach = np.arange(index.rules.window)
    at = np.minimum(index.begin[passages][:, None] + reach, len(index.text) - 1)
    return np.where(reach < index.sizes[passages][:, None], index.text[at], 0).astype(np.uint32)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint64(SPREAD)) >> np.uint64(64 - TABLE_BITS)


def _bands(index: Index, points: np.ndarray, owner: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, passage and band number of each band that reaches its bound; bands count from the text's start."""
    q = index.rules.q
    hashes = grams(points, q)
    at = np.flatnonzero(index.table[_slot(hashes)])
    at = at[owner[at] == owner[at + q - 1]]
    k = np.minimum(np.searchsorted(index.known, hashes[at]), len(index.known) - 1)
    ok = index.known[k] == hashes[at]
    at, k = at[ok], k[ok]
    times = index.times[k]
    ends = np.cumsum(times)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    lo = 0
    while lo < len(at):  # as many hits at a time as fit
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HITS, side="right")))
        each = ranges(index.first[k[lo:hi]], times[lo:hi])
        where = np.repeat(at[lo:hi], times[lo:hi])
        passage = index.passage[each]
        text = owner[where]
        width = index.edits[passage] + 1
        shift = index.rules.window  # keeps diagonals that begin before the text positive
        band = (where - first[text] - index.place[each] + shift) // width
        pair = (text.astype(np.int64) * len(index.items) + passage) << 28
        keys, n = np.unique(np.concatenate([pair + band + 1, pair + band]), return_counts=True)
        held.append((keys, n))
        lo = hi
    if not held:
        return (np.zeros(0, np.int64),) * 3
    keys, n = held[0]
    if len(held) > 1:
        keys, back = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        n = np.bincount(back, np.concatenate([x for _, x in held]))
    pair, band = keys >> 28, (keys & ((1 << 28) - 1)) - 1
    enough = n >= index.bounds[pair % len(index.items)]
    pair, band = pair[enough], band[enough]
    return pair // len(index.items), pair % len(index.items), band


def align(patterns: np.ndarray, sizes: np.ndarray, texts: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits of each pattern inside its band, and the place in the text behind them.

    ``texts`` begin at the band's first diagonal; a pattern may begin on any diagonal
    of the band. Diagonals beyond a band's own width are closed.
    """
    n, most = len(patterns), int(widths.max())
    lane = np.arange(most)
    far = np.int32(1 << 20)
    closed = lane[None, :] >= widths[:, None]
    row = np.where(closed, far, 0).astype(np.int32)
    best, end = np.full(n, far, np.int32), np.zeros(n, np.int64)
    for j in range(int(sizes.max())):
        other = texts[:, j : j + most] != patterns[:, j : j + 1]
        step = row + other
        step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)
        step = np.minimum.accumulate(step - lane, axis=1) + lane
        row = np.where(closed, far, step).astype(np.int32)
        done = np.flatnonzero(sizes == j + 1)
        if len(done):
            k = row[done].argmin(axis=1)
            best[done], end[done] = row[done, k], j + 1 + k
    return best, end


def search(index: Index, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """Text, item, first and last character (end exclusive) and edits of the best place of each item in each text."""
    return [found[:5] for found in _search(index, [normalized(t) for t in texts])]


def _search(index: Index, made: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int, int, int, bool]]:
    """As ``search``, of normalized texts, with whether only a part of the item is held there."""
    sizes = np.array([len(p) for p, _ in made])
    points = np.concatenate([p for p, _ in made]) if made else np.zeros(0, np.uint32)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(made), dtype=np.int32), sizes)
    # Whole items and windows go before parts, then fewer edits.
    found: dict[tuple[int, int], tuple[bool, int, int, int]] = {}
    for t, item, a, z in _short(index, points, owner):
        at, value = made[t][1], (False, 0, a - int(first[t]), z - int(first[t]))
        value = (False, 0, int(at[value[2]]), int(at[value[3] - 1]) + 1)
        found[t, item] = min(found.get((t, item), value), value)
    text, passage, band = _bands(index, points, owner, first) if len(points) >= index.rules.q else (np.zeros(0, np.int64),) * 3
    for lo in range(0, len(text), 512):
        t, p, b = text[lo : lo + 512], passage[lo : lo + 512], band[lo : lo + 512]
        widths, size = 2 * (index.edits[p] + 1), index.sizes[p]
        start = b * (index.edits[p] + 1) - index.rules.window  # in the text, may be before it
        reach = start[:, None] + np.arange(index.rules.window + int(widths.max()))
        inside = (reach >= 0) & (reach < sizes[t][:, None])
        held = np.where(inside, points[np.clip(reach + first[t][:, None], 0, len(points) - 1)], 0xFFFFFFFF)
        rows = _rows(index, p)
        edits, end = align(rows, size, held, widths)
        some = np.flatnonzero(edits <= index.edits[p])
        if not len(some):
            continue
        # Backwards from that end: where the same edits begin.
        n = size[some]
        back = np.zeros((len(some), index.rules.window), np.uint32)
        ahead = np.full((len(some), index.rules.window + int(widths.max())), 0xFFFFFFFF, np.uint32)
        for r, x in enumerate(some):
            back[r, : n[r]] = rows[x, : n[r]][::-1]
            part = held[x, : end[x]][::-1][: ahead.shape[1]]
            ahead[r, : len(part)] = part
        _, length = align(back, n, ahead, index.edits[p[some]] + 1)
        for x, used in zip(some, length, strict=True):
            at = made[t[x]][1]
            a = int(np.clip(start[x] + end[x] - used, 0, len(at) - 1))
            z = int(np.clip(start[x] + end[x] - 1, 0, len(at) - 1))
            key, value = (int(t[x]), int(index.items[p[x]])), (bool(index.partly[p[x]]), int(edits[x]), int(at[a]), int(at[z]) + 1)
            found[key] = min(found.get(key, value), value)
    return [(t, item, a, z, edits, part) for (t, item), (part, edits, a, z) in sorted(found.items())]


def _short(index: Index, points: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Text, item and place in ``points`` of each short item that stands between words."""
    letter = np.zeros(len(points) + 2, bool)
    if index.short:
        kinds, back = np.unique(points, return_inverse=True)
        letter[1:-1] = np.array([chr(p).isalnum() for p in kinds.tolist()], bool)[back]
    for size, items in index.short.items():
        if len(points) < size:
            continue
        known = np.unique(np.concatenate([grams(np.frombuffer(raw, np.uint32), size) for raw in items]))
        hashes = grams(points, size)
        k = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        at = np.flatnonzero(known[k] == hashes)
        for a in at[owner[at] == owner[at + size - 1]].tolist():
            z = a + size
            cut = letter[a + 1] and letter[a] and a > 0 and owner[a - 1] == owner[a]
            cut |= letter[z] and letter[z + 1] and z < len(points) and owner[z] == owner[a]
            if not cut:
                for item in items.get(points[a:z].astype(np.uint32).tobytes(), ()):
                    yield int(owner[a]), item, a, z


def _parts(texts: list[str | None], overlap: int) -> Iterator[list[tuple[int, int, str]]]:
    """Row, first character and text, in lists of about BATCH_CHARS; longer texts in parts that overlap."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text or "") - overlap), BATCH_CHARS):
            part = (text or "")[at : at + BATCH_CHARS + overlap]
            held.append((row, at, part))
            size += len(part)
            if size >= BATCH_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, rules: Rules = PARTS, block_chars: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, start, stop, edits``: the best place of each item (or a stretch of ``rules.window`` of it, else of ``rules.part``) in each row of ``docs`` that holds it.

    Places are code points of the text, end exclusive. A null or empty text holds
    nothing; null ids stay null; repeated rows are each reported; items without an id or
    a text are not searched, those shorter than ``rules.shortest`` only without edits; rows of the benchmark with one id are
    one item; of places alike in edits the first is given; other columns are not read; an empty
    table or benchmark gives an empty result. Long texts are searched in overlapping parts.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, start long, stop long, edits long"
    found = None
    for blocks in _indexes(benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")), rules, block_chars):
        out = picked.mapInArrow(_reported(blocks), schema)
        found = out if found is None else found.union(out)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, rules: Rules = PARTS, block_chars: int = 1_000_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with an id or without, with all their columns; nothing is shuffled.

    A null or empty text holds nothing and stays; ids are not read, so null and repeated ones
    don't matter; repeated rows stay or go together; other columns, of whatever name, come back
    as they are; an empty table gives an empty result, an empty benchmark all rows.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    for blocks in _indexes(benchmark.select(F.coalesce(F.col(item_col).cast("long"), F.lit(-1)).alias("item"), F.col(item_text_col).alias("text")), rules, block_chars):
        docs = docs.mapInArrow(_clean(blocks, text_col), schema)
    return docs


def _indexes(benchmark: DataFrame, rules: Rules, most: int) -> Iterator[list[Broadcast]]:
    """Indexes of blocks of about ``most`` characters, BLOCKS at a time; the driver holds one block's texts."""
    context = benchmark.sparkSession.sparkContext
    held, size, blocks = [], 0, []
    for item, text in chain(benchmark.dropna().orderBy("item").toLocalIterator(), [(None, None)]):
        if held and (text is None or size >= most and item != held[-1][0]):
            index = build(held, rules)
            if index is not None:
                blocks.append(context.broadcast(index))
            held, size = [], 0
        if blocks and (text is None or len(blocks) == BLOCKS):
            yield blocks
            blocks = []
        if text is not None:
            held.append((item, text))
            size += len(text)


def _best(blocks: list[Broadcast], texts: list[str | None]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """Edits, start and end of the best place of each item by row and item."""
    best: dict[tuple[int, int], tuple[bool, int, int, int]] = {}
    for parts in _parts(texts, 4 * blocks[0].value.rules.window):
        made = [normalized(t) for _, _, t in parts]
        for block in blocks:
            for k, item, a, z, edits, part in _search(block.value, made):
                row, at, _ = parts[k]
                value = (part, edits, at + a, at + z)
                best[row, item] = min(best.get((row, item), value), value)
    return {pair: value[1:] for pair, value in best.items()}


def _reported(blocks: list[Broadcast]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = sorted((row, item, a, z, edits) for (row, item), (edits, a, z) in _best(blocks, batch.column(1).to_pylist()).items())
            columns = [pa.array([ids[r[0]] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 5))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "start", "stop", "edits"])

    return run


def _clean(blocks: list[Broadcast], text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(len(batch), bool)
            clean[[row for row, _ in _best(blocks, batch.column(text_col).to_pylist())]] = False
            yield batch.filter(pa.array(clean))

    return run
