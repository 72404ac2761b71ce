"""Token-id output: length-delimited binary records and a separate offset index.

Each data file holds frames of

    u64 length | u32 masked CRC-32C of the length | payload | u32 masked CRC-32C of the payload

all little-endian, which common record readers understand. A payload is one serialized
sequence: a byte for the width of ids (2 or 4), a byte that is 1 if an id of the document
follows, 8 bytes for it, and the token ids. The index is a Parquet table with the file,
byte offset and length of each frame, so that a shuffled read seeks to single frames.

Files belong to a task attempt; only those that the committed index names count, so
a lost executor or a repeated task leaves nothing that a reader would see twice.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procurespark.llm.checksums import crc32c, masked
from procurespark.llm.encoding import encoder, with_end
from procurespark.llm.shared import arrow_path, by_bytes, flat_text

HEAD = struct.Struct("<QI")
LEAD = struct.Struct("<BBq")
BATCH_BYTES = 4 << 20
INDEX = "part int, file string, ordinal long, doc_id long, offset long, length long, n_tokens long"


def _frames(ids: list, numbers: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Payloads framed; the frames' lengths."""
    width, data = numbers.dtype.itemsize, numbers.tobytes()
    payloads = [LEAD.pack(width, i is not None, i or 0) + data[a * width : b * width] for i, a, b in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    lengths = np.array([len(p) for p in payloads], np.int64)
    sums = masked(crc32c(np.frombuffer(b"".join(payloads), np.uint8), np.concatenate([[0], np.cumsum(lengths)])))
    heads = masked(crc32c(np.frombuffer(lengths.astype("<u8").tobytes(), np.uint8), 8 * np.arange(len(lengths) + 1)))
    framed = [HEAD.pack(n, h) + p + int(s).to_bytes(4, "little") for n, h, p, s in zip(lengths.tolist(), heads.tolist(), payloads, sums.tolist(), strict=True)]
    return framed, lengths + HEAD.size + 4


def write_token_records(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes all texts and writes them below ``path`` in ascending id order.

    A null text is empty (only the end id is written); null ids come first; rows with
    one id stand in the order of their texts, repeated rows each get a record. Other
    columns are not read. An empty table gives an index without rows and no data file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(arrow_path(path))
        context, out, at, ordinal = TaskContext.get(), None, 0, 0
        part = context.partitionId()
        name = f"part-{part:06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.rec"
        try:
            for batch in batches:
                _, offsets = flat_text(batch.column(1))
                for a, b in by_bytes(offsets, BATCH_BYTES):
                    if out is None:
                        files.create_dir(f"{root}/data", recursive=True)
                        out = files.open_output_stream(f"{root}/data/{name}")
                    own = batch.column(0).slice(a, b - a)
                    numbers, bounds = with_end(*encoder(vocabulary).ids(batch.column(1).slice(a, b - a)), end_id)
                    framed, lengths = _frames(own.to_pylist(), numbers, bounds)
                    out.write(b"".join(framed))
                    starts = at + np.cumsum(lengths) - lengths
                    n = b - a
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, part, np.int32)), pa.array([name] * n), pa.array(np.arange(ordinal, ordinal + n)), own, pa.array(starts), pa.array(lengths), pa.array(np.diff(bounds))],
                        ["part", "file", "ordinal", "doc_id", "offset", "length", "n_tokens"],
                    )
                    at, ordinal = at + int(lengths.sum()), ordinal + n
        finally:
            if out is not None:
                out.close()

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = picked.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    ordered.mapInArrow(write, INDEX).write.parquet(f"{path}/index")


def _checked(frames: list[bytes]) -> list[tuple[int | None, np.ndarray]]:
    """Ids and sequences of whole frames; raises if a checksum doesn't hold."""
    lengths = np.array([len(f) - HEAD.size - 4 for f in frames], np.int64)
    said = np.array([HEAD.unpack_from(f) for f in frames], np.uint64)
    bodies = [f[HEAD.size : -4] for f in frames]
    sums = masked(crc32c(np.frombuffer(b"".join(bodies), np.uint8), np.concatenate([[0], np.cumsum(lengths)])))
    heads = masked(crc32c(np.frombuffer(b"".join(f[:8] for f in frames), np.uint8), 8 * np.arange(len(frames) + 1)))
    ends = np.frombuffer(b"".join(f[-4:] for f in frames), "<u4")
    if (said[:, 0].astype(np.int64) != lengths).any() or (said[:, 1] != heads).any() or (ends != sums).any():
        raise ValueError("a record's checksum doesn't hold")
    out = []
    for body in bodies:
        width, known, doc_id = LEAD.unpack_from(body)
        out.append((doc_id if known else None, np.frombuffer(body, "<u2" if width == 2 else "<u4", offset=LEAD.size)))
    return out


def _stream(files: pafs.FileSystem, name: str) -> Iterator[list[bytes]]:
    """The frames of a file in order, in lists of about BATCH_BYTES."""
    with files.open_input_stream(name, buffer_size=1 << 20) as data:
        held, size = [], 0
        while head := data.read(HEAD.size):
            rest = data.read(HEAD.unpack(head)[0] + 4)
            held.append(head + rest)
            size += len(rest)
            if size >= BATCH_BYTES:
                yield held
                held, size = [], 0
        if held:
            yield held


def _row(doc_id: int | None, start: int, numbers: np.ndarray, with_ids: bool) -> tuple:
    return (doc_id, start, len(numbers), zlib.crc32(numbers.astype("<u4").tobytes()), *([numbers.astype("<u4").tobytes()] if with_ids else []))


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names, kinds = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"], [pa.int64()] * 4 + [pa.binary()]
    n = 4 + with_ids
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(n)], names[:n])


def read_token_records(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Reads the files back in order, checking all checksums.

    ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``
    (of the ids as little-endian unsigned 32-bit integers); with_ids adds them as ``ids``.
    """
    index = spark.read.parquet(f"{path}/index")
    totals = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    listed = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(arrow_path(path))
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for frames in _stream(files, f"{root}/data/{name}"):
                    rows = []
                    for doc_id, numbers in _checked(frames):
                        rows.append(_row(doc_id, start, numbers, with_ids))
                        start += len(numbers)
                    yield _batch(rows, with_ids)

    n = max(1, totals.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return listed.repartition(n).mapInArrow(read, schema)


def read_token_records_shuffled(spark: SparkSession, path: str, seed: int = 0, with_ids: bool = True) -> DataFrame:
    """All records in an order drawn from ``seed``, by seeking to the frames that the index names.

    ``position`` is the place in that order, as a hash: sorting by it gives the order over
    all partitions, which are themselves consecutive stretches of it.
    """
    index = spark.read.parquet(f"{path}/index").select(F.xxhash64(F.lit(seed), "file", "ordinal").alias("position"), "file", "offset", "length")
    ordered = index.repartitionByRange("position").sortWithinPartitions("position", "file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(arrow_path(path))
        opened: dict[str, pa.NativeFile] = {}
        for batch in batches:
            for k in range(0, len(batch), 256):
                some, frames = batch.slice(k, 256).to_pydict(), []
                for name, at, n in zip(some["file"], some["offset"], some["length"], strict=True):
                    if name not in opened:
                        if len(opened) >= 64:
                            opened.pop(next(iter(opened))).close()
                        opened[name] = files.open_input_file(f"{root}/data/{name}")
                    frames.append(opened[name].read_at(n, at))
                rows = [_row(i, 0, x, with_ids) for i, x in _checked(frames)]
                made = _batch(rows, with_ids).to_pydict() | {"position": some["position"]}
                made.pop("start")
                yield pa.RecordBatch.from_pydict(made, pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else []), ("position", pa.int64())]))

    return ordered.mapInArrow(read, "doc_id long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids + ", position long")
