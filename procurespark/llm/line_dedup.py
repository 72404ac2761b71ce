"""Line deduplication with DataFrame operations only.

Lines are exploded and hashed; a line's documents are counted by hash; lines over the
threshold are dropped everywhere but in one document; the rest is put together again
by position. Lines travel as 128-bit hashes, texts only once, to meet their positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurespark.llm.shared import ascii_lower
from procurespark.storage import checkpointed

#: The white space that is stripped from a line's ends.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with its text deduplicated, and ``n_lines`` and ``n_dropped`` added unless ``counts`` is off.

    Texts are split at line feeds; a null or empty text is one empty line and comes back
    empty. Keys of at least ``min_chars`` code points in at least ``min_docs`` documents
    lose all their lines except in the largest id that has them. Rows with the same id
    are one document for counting and lose the same lines; a null id counts as one
    document, below all others. Other columns come back as they are, but for those called
    n_lines or n_dropped where counts are added. An empty table gives an empty result.
    """
    added = ["n_lines", "n_dropped"] if counts else []
    others = [c for c in docs.columns if c != text_col and c not in added]
    rows = docs.select(
        *(F.col(f"`{c}`").alias(f"_c_{c}") for c in others),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_doc"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    ).withColumn("_row", F.xxhash64("_text"))

    lines = rows.select("_doc", "_row", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
    keyed = lines.select("_doc", "_row", "_pos", line_key(F.col("_line")).alias("_key")).filter(F.length("_key") >= min_chars)
    # Written down: texts are split and hashed once for the counts and the positions.
    hashed = checkpointed(keyed.select("_doc", "_row", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2")))

    # One row for each line and document first, so a line that all documents share is
    # counted by the tasks that hold the documents, not by one task.
    pairs = hashed.select("_h1", "_h2", "_doc").groupBy("_h1", "_h2", "_doc").agg(F.lit(1).alias("_n"))
    common = pairs.groupBy("_h1", "_h2").agg(F.count("_n").alias("_docs"), F.max("_doc").alias("_keep")).filter(F.col("_docs") >= min_docs)
    # Written down, so that the sort-merge join shuffles both its sides and adaptive
    # execution can split the rows of a frequent line.
    common = checkpointed(common)
    gone = hashed.join(common.hint("merge"), ["_h1", "_h2"]).filter(F.col("_doc") != F.col("_keep"))
    dropped = gone.groupBy("_doc", "_row").agg(F.collect_set("_pos").alias("_dropped"))

    whole = rows.withColumn("_lines", F.split("_text", "\n", -1)).drop("_text")
    met = whole.join(dropped.hint("merge"), ["_doc", "_row"], "left").withColumn("_dropped", F.coalesce("_dropped", F.array().cast("array<int>")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_dropped"))
    text = F.when(F.size("_dropped") == 0, F.array_join("_lines", "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n"))
    return met.select(
        *(text.alias(c) if c == text_col else F.col(f"`_c_{c}`").alias(c) for c in docs.columns if c not in added),
        *(F.size(held).cast("long").alias(c) for held, c in zip(("_lines", "_dropped"), added)),
    )


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of ``dedup_lines``."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


#: DuckDB SQL for ``line_dedup_digest`` over documents.
LINE_DEDUP_SQL = r"""
WITH lines AS (
    SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
    SELECT doc_id, pos, line,
        translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), common AS (
    SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keep AS gone
    FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
