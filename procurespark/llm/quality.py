"""Quality rules with host-level verdicts.

Each document is held against rules. Failures are summed by host (the source), a beta
prior is fitted to all hosts' rates by moments, and each rate is shrunk with it. A host
fails where its posterior lies clearly over what the corpus as a whole does; it then
also loses the documents that pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurespark.llm.shared import by_bytes, flat_text, free_prefix
from procurespark.llm.words import codes_of, word_spans
from procurespark.storage import checkpointed

BATCH_BYTES = 1 << 20
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
WINDOW = 3
BROADCAST_BYTES = 32 << 20
RULES = ["short", "repeats", "symbols", "lines"]

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _features(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    inside = _WORD[data]
    starts, ends, owner = word_spans(inside, offsets)

    def per_text(mask: np.ndarray) -> np.ndarray:
        held = np.concatenate([[0], np.cumsum(mask)])
        return held[offsets[1:]] - held[offsets[:-1]]

    out = {
        "n_words": np.bincount(owner, minlength=n),
        "word_chars": per_text(inside & ((data & 0xC0) != 0x80)),  # bytes that begin a code point
        "n_symbols": per_text(_SYMBOL[data]),
    }
    # Lines with a word, compared as they are.
    a, b, line_owner = word_spans(data != 0x0A, offsets)
    held = np.concatenate([[0], np.cumsum(inside)])
    worded = held[b] > held[a]
    a, b, line_owner = a[worded], b[worded], line_owner[worded]
    out["n_lines"] = np.bincount(line_owner, minlength=n)
    lines, _ = codes_of(data, a, b)
    pairs = np.unique(line_owner * (len(lines) + 1) + lines) // (len(lines) + 1)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(pairs, minlength=n)
    # Words in windows that the text has twice or more.
    code, known = codes_of(data, starts, ends)
    repeated = np.zeros(len(code), bool)
    if len(code) >= WINDOW:
        at = np.flatnonzero(owner[: -WINDOW + 1] == owner[WINDOW - 1 :])
        _, two = np.unique(code[at] * (len(known) + 1) + code[at + 1], return_inverse=True)
        _, three = np.unique(two * (len(known) + 1) + code[at + 2], return_inverse=True)
        window = owner[at] * (len(at) + 1) + three
        _, back, times = np.unique(window, return_inverse=True, return_counts=True)
        again = at[times[back] > 1]
        for k in range(WINDOW):
            repeated[again + k] = True
    out["n_repeat_words"] = np.bincount(owner[repeated], minlength=n)
    return out


@dataclass(frozen=True)
class HostBar:
    """When a host fails a rule: the lower end of its posterior rate, ``deviations`` standard
    deviations under the mean, is over ``least`` and over ``ratio`` times the corpus' rate, or
    over halfway from that rate to 1 where this is less."""

    ratio: float = 3.0
    least: float = 0.2
    deviations: float = 3.0


def with_features(docs: DataFrame, text_col: str = "text", prefix: str = "_f_") -> DataFrame:
    """``docs`` and the counts of each row's text (null: none), in columns that begin with ``prefix``."""
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + ", " + ", ".join(f"`{prefix}{k}` long" for k in FEATURES)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_text(batch.column(text_col))
            for a, b in by_bytes(offsets, BATCH_BYTES):
                made = _features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(made[k].astype(np.int64)) for k in FEATURES)], [*part.schema.names, *(f"{prefix}{k}" for k in FEATURES)])

    return docs.mapInArrow(counted, schema)


def base_failed(prefix: str = "_f_") -> Column:
    """Too few words, or over half of them in repeated windows."""
    return (F.col(f"{prefix}n_words") < 50) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * F.col(f"{prefix}n_words"))


def _failures() -> dict[str, Column]:
    """What counts against a host."""
    return {
        "short": F.col("_f_n_words") < 50,
        "repeats": 100 * F.col("_f_n_repeat_words") > 50 * F.col("_f_n_words"),
        "symbols": 5 * F.col("_f_n_symbols") > F.col("_f_n_words"),
        "lines": 100 * F.col("_f_n_dup_lines") > 30 * F.col("_f_n_lines"),
    }


def host_verdicts(judged: DataFrame, bar: HostBar = HostBar()) -> DataFrame:
    """``host, n_docs, host_failed``, the shrunk rate of each rule and the largest of them, from rows with ``_host`` and features.

    The prior of a rule has the mean of all documents and, by moments, the strength that
    the spread of the hosts' rates leaves; without a spread beyond chance it is strong
    and every host gets the mean. Hosts are counted piece by piece before the shuffle.
    No rows give no rows.
    """
    counted = judged.groupBy("_host").agg(F.count("*").alias("n"), *(F.sum(r.cast("long")).alias(k) for k, r in _failures().items()))
    hosts = checkpointed(counted)
    total = hosts.agg(F.sum("n").alias("n"), F.sum(F.pow("n", F.lit(2))).alias("nn"), F.count("*").alias("h"), *(F.sum(k).alias(k) for k in RULES))
    means = {k: F.try_divide(F.col(f"t.{k}"), F.col("t.n")) for k in RULES}
    spread = hosts.alias("h").crossJoin(F.broadcast(total).alias("t")).agg(  # one row beside each host's
        *(F.sum(F.col("h.n") * F.pow(F.try_divide(F.col(f"h.{k}"), F.col("h.n")) - means[k], F.lit(2))).alias(f"s_{k}") for k in RULES)
    )
    strength = {}
    for k in RULES:
        m = F.try_divide(F.col(f"t.{k}"), F.col("t.n"))
        # Between-host variance by moments: the weighted spread less what chance gives.
        chance = m * (1 - m)
        between = F.try_divide(F.col(f"s_{k}") - (F.col("t.h") - 1) * chance, F.col("t.n") - F.try_divide(F.col("t.nn"), F.col("t.n")) - (F.col("t.h") - 1))
        strength[k] = F.when(between > 0, F.greatest(F.lit(1.0), chance / between - 1)).otherwise(F.lit(1e6))
    prior = total.alias("t").crossJoin(spread).select(*(F.coalesce(means[k], F.lit(0.0)).alias(f"m_{k}") for k in RULES), *(F.least(F.coalesce(strength[k], F.lit(1e6)), F.lit(1e6)).alias(f"v_{k}") for k in RULES))
    beside = hosts.crossJoin(F.broadcast(prior))  # one row beside each host's
    rates = beside.select(F.col("_host").alias("host"), F.col("n").alias("n_docs"), *((F.col(k) + F.col(f"m_{k}") * F.col(f"v_{k}")) / (F.col("n") + F.col(f"v_{k}")) for k in RULES), *(F.col(f"m_{k}") for k in RULES), *(F.col("n") + F.col(f"v_{k}") + 1 for k in RULES)).toDF("host", "n_docs", *(f"rate_{k}" for k in RULES), *(f"m_{k}" for k in RULES), *(f"w_{k}" for k in RULES))

    def over(k: str) -> Column:
        rate = F.col(f"rate_{k}")
        lower = rate - bar.deviations * F.sqrt(rate * (1 - rate) / F.col(f"w_{k}"))
        return lower > F.greatest(F.lit(bar.least), F.least(bar.ratio * F.col(f"m_{k}"), (F.col(f"m_{k}") + 1) / 2))

    failed = over(RULES[0])
    for k in RULES[1:]:
        failed = failed | over(k)
    return rates.select("host", "n_docs", failed.alias("host_failed"), F.greatest(*(f"rate_{k}" for k in RULES)).alias("host_rate"), *(f"rate_{k}" for k in RULES))


def _small(df: DataFrame, host: str) -> DataFrame:
    """``df``, to be broadcast if its hosts take up at most BROADCAST_BYTES, else to be shuffled."""
    size = df.agg(F.sum(F.octet_length(host) + 32).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def quality_digest(docs: DataFrame, bar: HostBar = HostBar()) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept``, ``host_failed`` and ``host_rate`` (rounded to 6 places) for each document.

    Counts are small, so they go to the shared folder once and texts are read once. A
    null text has no words and fails; null sources count together as one host, with the
    empty ones; null ids stay null; repeated rows count each; other columns are not read;
    an empty table gives an empty result.
    """
    host = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_host")
    made = checkpointed(with_features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), host, F.col("text"))).drop("text"))
    verdicts = checkpointed(host_verdicts(made, bar).select(F.col("host").alias("_host"), "host_failed", "host_rate"))
    failed = base_failed()
    return made.join(_small(verdicts, "_host"), "_host", "left").select(
        "doc_id", *(F.col(f"_f_{k}").alias(k) for k in FEATURES[:-1]), failed.alias("base_failed"), (~failed & ~F.col("host_failed")).alias("kept"), "host_failed", F.round("host_rate", 6).alias("host_rate")
    )


def keep_good(docs: DataFrame, bar: HostBar = HostBar(), text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows whose text and host pass, with all their columns, under the same rules as ``quality_digest``.

    Null texts fail; null hosts count together with empty ones; repeated rows are judged
    each and alike; other columns, of whatever name, come back as they are; an empty table
    gives an empty result. Texts are counted twice, once for their hosts and once for
    themselves, and neither shuffled nor written.
    """
    own = free_prefix(docs.columns, "_q_")
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    counted = with_features(docs.select(host.alias("_host"), F.col(text_col).alias("text"))).drop("text")
    failing = checkpointed(host_verdicts(counted, bar).filter("host_failed").select(F.col("host").alias(f"{own}host")))
    passed = with_features(docs.withColumn(f"{own}host", host), text_col, own).filter(~base_failed(own))
    return passed.join(_small(failing, f"{own}host"), f"{own}host", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


#: DuckDB SQL of ``quality_digest`` over documents.
QUALITY_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), word AS (
    SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS a FROM d
), three AS (
    SELECT doc_id, p, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY p)
), found AS (
    SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times FROM three WHERE c IS NOT NULL
), again AS (
    SELECT doc_id, count(DISTINCT p + k) AS n FROM found, range(3) r(k) WHERE times > 1 GROUP BY doc_id
), line AS (
    SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counts AS (
    SELECT d.doc_id, d.host, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(a.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0) AS n_lines
    FROM d LEFT JOIN line l USING (doc_id) LEFT JOIN again a USING (doc_id)
), broken AS (
    SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats, 5 * n_symbols > n_words AS symbols, 100 * n_dup_lines > 30 * n_lines AS lines FROM counts
), host_rule AS (
    SELECT rule, host, count(*)::DOUBLE AS n, count(*) FILTER (bad)::DOUBLE AS k
    FROM (UNPIVOT broken ON short, repeats, symbols, lines INTO NAME rule VALUE bad) GROUP BY rule, host
), total AS (
    SELECT rule, sum(n) AS n, sum(n * n) AS nn, count(*) AS h, sum(k) / sum(n) AS m FROM host_rule GROUP BY rule
), spread AS (
    SELECT t.rule, any_value(t.m) AS m, (sum(r.n * (r.k / r.n - t.m) ** 2) - (any_value(h) - 1) * any_value(m * (1 - m))) / nullif(any_value(t.n - t.nn / t.n - (h - 1)), 0) AS between
    FROM host_rule r JOIN total t USING (rule) GROUP BY t.rule
), prior AS (
    SELECT rule, m, CASE WHEN between > 0 THEN least(greatest(1, m * (1 - m) / between - 1), 1e6) ELSE 1e6 END AS v FROM spread
), rate AS (
    SELECT host, rule, m, n + v + 1 AS w, (k + m * v) / (n + v) AS rate FROM host_rule JOIN prior USING (rule)
), verdict AS (
    SELECT host, bool_or(rate - 3 * sqrt(rate * (1 - rate) / w) > greatest(0.2, least(3 * m, (m + 1) / 2))) AS host_failed, round(max(rate), 6) AS host_rate FROM rate GROUP BY host
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed, NOT (short OR repeats) AND NOT host_failed AS kept, host_failed, host_rate
FROM broken JOIN verdict USING (host)
"""
