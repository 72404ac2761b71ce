"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procurespark.llm.decontaminate import without_leaks
from procurespark.llm.line_dedup import dedup_lines
from procurespark.llm.near_copies import keep_one_near
from procurespark.llm.packing import pack_tokens
from procurespark.llm.quality import keep_good
from procurespark.llm.queries import END_ID, VOCABULARY
from procurespark.storage import new_path, remove


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule, or whose source does, go.

    A null text fails; null sources count together; null ids are kept or not by their text;
    repeated rows are judged alike; an empty table stays empty; other columns, of whatever
    name, come back as they are.
    """
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more have stay in the last of them; ``n_chars`` follows the text where there is one.

    A null text becomes empty; null ids count as one document, below all others; repeated
    rows lose the same lines; an empty table stays empty.
    """
    deduped = dedup_lines(docs, counts=False)
    return deduped.select(*(F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays, that with the smallest id: by op9's SimHash (three words, 3 bits), and by 0.8 of shingles of five words.

    Null and blank texts are copies of each other; a null id stays only where its component
    has no other; repeated rows count as one; an empty table stays empty.
    """
    return keep_one_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a part of one as ``decontaminate`` says, go.

    Null texts hold nothing and stay, ids are not read, repeated rows stay or go together, an
    empty table stays empty.
    """
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left and their places in sequences of 1024.

    A null text is the end id alone; null ids stay null; repeated rows are packed each; an
    empty table gives no piece. Workers keep no encoder, as they go on to other stages.
    """
    return pack_tokens(docs, VOCABULARY, end_id=END_ID, capacity=1024, passing=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express near-copy components, tokens and packing; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again.

    A stage's table is removed once the next one is written; the last, which the result reads, stays.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, "pipeline")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return docs
