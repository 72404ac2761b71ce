"""Token ids of whole texts, with the library calls shared by equal pieces.

A byte-level vocabulary never joins a character that isn't white space with
white space after it. So a text may be cut before each space or line end that
follows such a character. Nor does it join a letter with punctuation after it, which
parts a word from the marks behind it. Each different piece need be encoded only once.
Natural text repeats most of its pieces; the library sees the new ones.
"""

from __future__ import annotations

import ctypes
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from procurespark.llm.shared import flat_text, ranges

WINDOW_BYTES = 2 << 20
CACHED_PIECES = 700_000  # about 150 MB in each Python worker
PASSING_PIECES = 200_000  # about 40 MB, of an encoder that goes with its task
JOINED_PIECES = 2_000
PLAIN_BYTES = 1 << 20

# A cut needs a visible ASCII byte before it, or the end of a longer character that is no
# Unicode white space: those end in C2 xx, xx 80 xx, xx 81 xx or xx 9A xx.
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x0A]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[0xC2, 0x80, 0x81, 0x9A]] = True


def safe_cuts(data: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Positions in UTF-8 ``data`` before which a text may be cut without changing its tokens.

    ``marks`` are the bytes before which it may be cut after an ASCII letter.
    """
    at = np.flatnonzero(_BREAK[data])
    at = at[at > 1]
    before = data[at - 1]
    at = at[_VISIBLE[before] | ((before >= 0x80) & ~_MAYBE_SPACE[data[at - 2]])]
    mark = np.flatnonzero(marks[data])
    mark = mark[mark > 0]
    return np.concatenate([at, mark[_LETTER[data[mark - 1]]]])


class Encoder:
    """Ids of a vocabulary file: ``.json`` by tokenizers, ``.model`` by sentencepiece.

    No begin, end or added special tokens, no truncation or padding; the strings of
    special tokens inside texts are treated as the library does by default. ``most``
    pieces are known at once, CACHED_PIECES if it isn't given.
    """

    def __init__(self, path: str, most: int | None = None):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.sentencepiece = path.endswith(".model")
        self.by_piece = False
        if self.sentencepiece:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = self.library.get_piece_size()
            return
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        made = json.loads(self.library.to_str())
        split = made["pre_tokenizer"] or {}
        added = made["added_tokens"]
        self.by_piece = (
            made["normalizer"] is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in added)
        )
        if self.by_piece:
            self.bytes_of = np.zeros(max(self.library.get_vocab(True).values()) + 1, np.int64)
            for token, i in self.library.get_vocab(False).items():
                self.bytes_of[i] = len(token)  # one character stands for one byte
            self.marks = np.zeros(256, bool)
            self.marks[list(b".,;:!?)*#$%&")] = True
            for t in added:
                self.bytes_of[t["id"]] = len(t["content"].encode())
                self.marks[list(t["content"].encode())] = False
            self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.uses = np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, self.dtype), 0

    def _thin(self) -> None:
        """Keeps the pieces that more than one window had, if they are few enough."""
        known, starts, lengths, uses, pool = self.known, self.starts, self.lengths, self.uses, self.pool
        kept = [p for p, k in known.items() if uses[k] > 1]
        self._forget()
        if len(kept) <= (self.most or CACHED_PIECES) // 2:
            at = np.fromiter(map(known.__getitem__, kept), np.int64, len(kept))
            self._keep(kept, pool[ranges(starts[at], lengths[at])], lengths[at])

    @property
    def dtype(self) -> np.dtype:
        """The narrowest type that holds every id."""
        return np.dtype("<u2" if self.size <= 1 << 16 else "<u4")

    # Whole texts by the library alone.

    def _plain(self, texts: list[str]) -> list[list[int]]:
        if self.sentencepiece:
            return self.library.encode(texts, num_threads=1)
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    # Equal pieces once.

    def _learn(self, new: list[bytes]) -> None:
        """Encodes pieces and puts their ids into the pool."""
        regular, odd = [], []
        for piece in new:
            # Pieces that begin with white space and end without may stand one after another.
            ends_visibly = _VISIBLE[piece[-1]] or (len(piece) > 1 and piece[-1] >= 0x80 and not _MAYBE_SPACE[piece[-2]])
            (regular if piece[0] in b" \n" and ends_visibly else odd).append(piece)
        for k in range(0, len(regular), JOINED_PIECES):
            some = regular[k : k + JOINED_PIECES]
            ids = np.array(self._plain([b"".join(some).decode()])[0], np.int64)
            ends = np.cumsum(self.bytes_of[ids])
            last = np.searchsorted(ends, want := np.cumsum([len(p) for p in some]))
            if len(ids) and ends[-1] == want[-1] and (ends[last] == want).all():
                self._keep(some, ids, np.diff(last + 1, prepend=0))
            else:
                odd += some
        for k in range(0, len(odd), 64):
            some = odd[k : k + 64]
            found = self._plain([p.decode() for p in some])
            self._keep(some, np.array([i for x in found for i in x], np.int64), np.array([len(x) for x in found], np.int64))

    def _keep(self, pieces: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        first, n = len(self.known), len(pieces)
        while first + n > len(self.starts):
            self.starts, self.lengths, self.uses = (np.resize(x, 2 * len(x)) for x in (self.starts, self.lengths, self.uses))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.lengths[first : first + n] = lengths
        self.uses[first : first + n] = 0
        self.starts[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known.update(zip(pieces, range(first, first + n), strict=True))

    def _windows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """Cuts of consecutive stretches of ``data``; the last of one is the first of the next."""
        lo = 0
        while lo < len(data):
            hi = min(len(data), lo + WINDOW_BYTES)
            while True:
                cut = np.zeros(hi - lo + 1, bool)
                cut[safe_cuts(data[lo:hi], self.marks)] = True
                inside = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, side="right")]
                cut[inside - lo] = True
                cut[0] = True
                cut[hi - lo] |= hi == len(data)
                cuts = np.flatnonzero(cut) + lo
                if len(cuts) > 1:
                    break
                hi = min(len(data), hi + WINDOW_BYTES)  # nowhere to cut yet
            yield cuts
            lo = int(cuts[-1])

    def _codes(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The number of each piece between the cuts."""
        held = data[cuts[0] : cuts[-1]]
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts - cuts[0]), pa.py_buffer(held)])
        coded = pieces.dictionary_encode()
        different = coded.dictionary.to_pylist()
        if len(self.known) + len(different) > (self.most or CACHED_PIECES):
            self._thin()
        if new := [p for p in different if p not in self.known]:
            self._learn(new)
        numbers = np.fromiter(map(self.known.__getitem__, different), np.int64, len(different))
        self.uses[numbers] += 1
        return numbers[coded.indices.to_numpy(zero_copy_only=False)]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        data, offsets = flat_text(texts)
        out = np.zeros(len(offsets) - 1, np.int64)
        if not self.by_piece:
            for n, part in self._split_long(texts):
                out[n] += [len(x) for x in part]
            return out
        for cuts in self._windows(data, offsets):
            owner = np.searchsorted(offsets, cuts[:-1], side="right") - 1
            codes = self._codes(data, cuts)  # may put new arrays in place of self.lengths
            out += np.bincount(owner, self.lengths[codes], len(out)).astype(np.int64)
        return out

    def _split_long(self, texts: pa.Array) -> Iterator[tuple[list[int], list[list[int]]]]:
        """For other vocabularies: ids of parts of about PLAIN_BYTES and the texts they belong to.

        A long text is cut before a single space between ASCII letters. Sentencepiece
        begins each part with the mark that stands for that space, so it drops it there.
        """
        owners, parts, held = [], [], 0
        for n, text in enumerate(texts.to_pylist()):
            text, at = text or "", 0
            while at < len(text):
                end = at + PLAIN_BYTES
                while end < len(text) and not (text[end] == " " and text[end - 1].isascii() and text[end - 1].isalpha() and text[end + 1 : end + 2].isascii() and text[end + 1 : end + 2].isalpha()):
                    end += 1
                owners.append(n)
                parts.append(text[at:end])
                held += end - at
                at = end + (self.sentencepiece and end < len(text))
                if held >= PLAIN_BYTES:
                    yield owners, self._plain(parts)
                    owners, parts, held = [], [], 0
        if parts:
            yield owners, self._plain(parts)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the n + 1 offsets between the texts."""
        data, offsets = flat_text(texts)
        counted, parts = np.zeros(len(offsets) - 1, np.int64), []
        if not self.by_piece:
            for n, some in self._split_long(texts):
                np.add.at(counted, n, [len(x) for x in some])
                parts += [np.array(x, self.dtype) for x in some]
        else:
            for cuts in self._windows(data, offsets):
                owner = np.searchsorted(offsets, cuts[:-1], side="right") - 1
                codes = self._codes(data, cuts)
                lengths = self.lengths[codes]
                counted += np.bincount(owner, lengths, len(counted)).astype(np.int64)
                parts.append(self.pool[ranges(self.starts[codes], lengths)])
        return np.concatenate(parts) if parts else np.zeros(0, self.dtype), np.concatenate([[0], np.cumsum(counted)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str, most: int | None = None) -> Encoder:
    """The encoder of a vocabulary, one for each Python worker; ``most`` is for a new one."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, most)
    return _encoders[path]


def forget(path: str) -> None:
    """Gives up the worker's encoder of a vocabulary, and what it held to the system.

    Spark's workers go on to other stages, and allocators keep freed memory for themselves.
    """
    _encoders.pop(path, None)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text."""
    if end_id is None:
        return ids, offsets
    wide = ids.dtype if end_id <= np.iinfo(ids.dtype).max else np.dtype("<u4")
    return np.insert(ids.astype(wide, copy=False), offsets[1:], end_id), offsets + np.arange(len(offsets))


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
