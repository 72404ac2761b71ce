"""Delimited files with quoted line ends, read by many tasks.

A reader that takes quoted line ends into account must know whether a place in a file is inside a quoted
cell, so Spark's gives each file to one task. That depends only on how many quotes stand before it, as a quote within a cell is
two. One pass counts the quotes of each block of a file; their running sum tells which blocks begin inside a
cell. A second pass cuts each block into records by itself; what a block's edge cuts apart, at most two pieces of each
block, is put together again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procurespark.storage import checkpointed

PIECES = "at long, leads boolean, kind string, records array<string>"
#: Blocks that a task reads where there are very many, and bytes of records in a row.
BLOCKS = 64
ROW_BYTES = 1 << 20


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each block: whole ones, the ``head`` that ends one begun before, and the ``tail`` that goes on behind it.

    A block's lines come in order; a head that doesn't end is one of kind ``mid``. A row has one record that is
    torn or its file's first, or many of the others.
    """
    at, inside, first, lead, held = None, False, False, False, []
    out: list[tuple] = []

    def end() -> None:
        if held:
            lines = pa.concat_arrays(held)
            out.append((at, lead, "mid" if first else "tail", _joined(lines, [0, len(lines)])))

    for batch in batches:
        ats, values = batch.column("at").to_numpy(), batch.column("value")
        quotes = pc.count_substring(values, '"').to_numpy()
        cuts = [0, *(np.flatnonzero(ats[1:] != ats[:-1]) + 1).tolist(), len(ats)] if len(ats) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if ats[a] != at:
                end()
                at, inside, lead, held = int(ats[a]), batch.column("inside")[a].as_py(), batch.column("opens")[a].as_py(), []
                first = inside
            within = (inside + np.cumsum(quotes[a:b])) & 1
            inside = bool(within[-1])
            ends = np.flatnonzero(within == 0) + 1
            if not len(ends):
                held.append(values.slice(a, b - a))
                continue
            before = sum(map(len, held))
            records = _joined(pa.concat_arrays([*held, values.slice(a, ends[-1])]), [0, *(before + ends).tolist()])
            held = [values.slice(a + ends[-1], b - a - ends[-1])] if inside else []
            if first or lead:
                out.append((at, lead, "head" if first else "whole", records.slice(0, 1)))
                records = records.slice(1)
            out += [(at, False, "whole", part) for part in _parts(records)]
            first = lead = False
        yield _rows(out)
        out = []
    end()
    yield _rows(out)


def _joined(lines: pa.Array, offsets: list[int]) -> pa.Array:
    """The lines from each offset to the next as one text."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lines), "\n")


def _parts(records: pa.Array) -> list[pa.Array]:
    """``records`` cut where another ROW_BYTES begin."""
    if not len(records):
        return []
    held = np.cumsum(pc.binary_length(records).to_numpy(), dtype=np.int64) // ROW_BYTES
    cuts = [0, *(np.flatnonzero(held[1:] != held[:-1]) + 1).tolist(), len(records)]
    return [records.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _rows(out: list[tuple]) -> pa.RecordBatch:
    ats, leads, kinds, records = zip(*out, strict=True) if out else [()] * 4
    offsets = pa.array([0, *np.cumsum([len(r) for r in records]).tolist()], pa.int32())
    lists = pa.ListArray.from_arrays(offsets, pa.concat_arrays(records) if out else pa.array([], pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(ats, pa.int64()), pa.array(leads, pa.bool_()), pa.array(kinds, pa.string()), lists], ["at", "leads", "kind", "records"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``record, leads``: the records of delimited files as text, quoted line ends in them, and whether it is its file's first. Blank lines are none."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    # Small blocks are read one after the other by a task, as far as there are four tasks for each core; a block's lines stay together.
    lines = lines.coalesce(max(4 * spark.sparkContext.defaultParallelism, -(-lines.rdd.getNumPartitions() // BLOCKS)))
    quotes = lines.groupBy("file", "block").agg(F.sum(F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counted = quotes.withColumn("before", F.coalesce(F.sum("quotes").over(before), F.lit(0)))
    blocks = checkpointed(counted.select("file", "block", (F.col("before") % 2 == 1).alias("inside"), F.monotonically_increasing_id().alias("at")))
    # Broadcast, which keeps the lines in order: a row for each block (128 MB as a rule).
    placed = lines.join(F.broadcast(blocks), ["file", "block"]).select("at", "inside", (F.col("block") == 0).alias("opens"), "value")
    pieces = checkpointed(placed.mapInArrow(_cut, PIECES))
    whole = pieces.filter("kind = 'whole'").select(F.explode("records").alias("record"), "leads")
    # A file's torn records are in the order of its blocks; each begins with a tail.
    torn = pieces.filter("kind <> 'whole'").select("at", "leads", F.col("records")[0].alias("record"), (F.col("kind") == "tail").cast("int").alias("late"))
    torn = checkpointed(torn.join(F.broadcast(blocks), "at"))
    order = Window.partitionBy("file").orderBy("block", "late")
    torn = torn.withColumn("begins", F.max(F.when(F.col("late") == 1, F.col("block"))).over(order))
    joined = torn.groupBy("file", "begins").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "late", "record"))), lambda p: p["record"]), "\n").alias("record"), F.max("leads").alias("leads"))
    records = whole.unionByName(joined.select("record", "leads"))
    return records.withColumn("record", F.when(F.contains("record", F.lit("\r")), F.regexp_replace("record", "\r$", "")).otherwise(F.col("record"))).filter("record <> ''")


def read_delimited_parts(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Rows of delimited files with a header, all strings, as ``read_delimited`` gives them, each file by many tasks, as far as it has blocks.

    Files have one header, the first's. A byte order mark is dropped; of files that end inside a quoted cell the rest is one cell.
    """
    records = read_records(spark, path)
    head = records.filter("leads").select("record").orderBy("record").first()
    if head is None:
        return spark.createDataFrame([], "value string").select()
    options = {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    width = spark.range(1).select(F.schema_of_csv(F.lit(head[0]), options)).first()[0]
    columns = width.count("_c")
    schema = ", ".join(f"_c{k} string" for k in range(columns))
    names = spark.range(1).select(F.from_csv(F.lit(head[0]), schema, options).alias("h")).select("h.*").first()
    rows = records.filter("NOT leads").select(F.from_csv("record", schema, options).alias("r")).select("r.*")
    return rows.toDF(*((names[k] or f"_c{k}").removeprefix("﻿").strip() for k in range(columns)))
