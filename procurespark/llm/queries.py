"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from procurespark.llm.decontaminate import find_leaks
from procurespark.llm.lexical_search import SEARCH_SQL, search
from procurespark.llm.licenses import scan_licenses
from procurespark.llm.line_dedup import LINE_DEDUP_SQL, line_dedup_digest
from procurespark.llm.near_copies import NEAR_SQL, near_components
from procurespark.llm.packing import pack_tokens
from procurespark.llm.prefix_trie import NODES, TRIE_SQL, conversation_trie
from procurespark.llm.quality import QUALITY_SQL, quality_digest
from procurespark.llm.secrets import SECRETS_SQL, secret_digest
from procurespark.llm.simhash import simhash_components
from procurespark.llm.token_counts import token_counts
from procurespark.llm.token_records import read_token_records, write_token_records
from procurespark.llm.url_filters import RULES, URL_FILTER_SQL, filter_urls
from procurespark.storage import new_path

#: Where the vocabulary of the token operators is; a parameter of each operator.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' URLs against the fixed rules; allow is the verdict without one."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(_table(spark, sf_dir, "pages"), rules)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents; over_limit is n_tokens > 512."""
    return token_counts(_table(spark, sf_dir, "documents"), VOCABULARY, limit=512)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds with at most 8 edits in 100 characters."""
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written as binary records with an index, and read back."""
    path = new_path(spark, "token-records")
    write_token_records(_table(spark, sf_dir, "documents"), path, VOCABULARY, end_id=END_ID)
    return read_token_records(spark, path)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, with ownership over all sources."""
    return secret_digest(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more in three documents or more dropped from all but the last."""
    return line_dedup_digest(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdicts of all documents, with those of their sources."""
    return quality_digest(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return pack_tokens(_table(spark, sf_dir, "documents"), VOCABULARY, end_id=END_ID, capacity=1024)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents at 3 bits."""
    return simhash_components(_table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and accepted templates of all documents."""
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt on the first of their blocks of five."""
    return conversation_trie(_table(spark, sf_dir, "conversations")).select(*NODES)


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 0.8 of their four-word shingles."""
    return near_components(_table(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_records": op2_token_records,
    "op3_secrets": op3_secrets,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_url_filter": op7_url_filter,
    "op8_token_counts": op8_token_counts,
    "op9_simhash": op9_simhash,
    "op10_licenses": op10_licenses,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_minhash": op12_minhash,
    "op13_search": op13_search,
}

ORACLE_SQL: dict[str, str] = {
    "op3_secrets": SECRETS_SQL,
    "op4_line_dedup": LINE_DEDUP_SQL,
    "op5_quality": QUALITY_SQL,
    "op7_url_filter": URL_FILTER_SQL,
    "op11_prefix_trie": TRIE_SQL,
    "op12_minhash": NEAR_SQL,
    "op13_search": SEARCH_SQL,
}
