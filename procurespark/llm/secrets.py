"""Secret scans with DataFrame operations only, judged by ownership over the corpus.

Candidates are found by patterns. Their values are hashed and counted by distinct
repositories and owners: a value that several owners hold is a widely copied example,
one that belongs to a single owner looks like a live credential, in few repositories where
those are known.
Looser patterns (bearer tokens, credentials in URLs, provider prefixes, signed tokens)
would report many examples alone; their spans are added only where ownership says live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procurespark.storage import checkpointed

#: Fixed patterns: kind, pattern, group with the value, least length of the value.
BASE_KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # shorter runs fail and touch no other match
]
ADDED_KINDS = [
    ("bearer", r"(?i)bearer\x20+([A-Za-z0-9._~+/=-]{16,})", 1, 16),
    ("url", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]+:([^\s/:@]{6,})@", 1, 6),
    ("provider", r"(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", 0, 14),
    ("signed", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
]
KINDS = [k for k, *_ in BASE_KINDS + ADDED_KINDS]

MATCH = "array<struct<rank:int,k:int,gap:bigint,size:bigint,value:string>>"


def _matches(text: Column, rank: int, pattern: str, group: int) -> Column:
    """All leftmost non-overlapping matches: each one's number, value and length, and that of what stands before it, in code points."""
    pattern_col = F.lit(pattern)
    found = F.regexp_extract_all(text, pattern_col, F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, pattern_col, F.lit(group))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("found"), values.alias("value"))
    one = F.transform(pairs, lambda x, k: F.struct(F.lit(rank).alias("rank"), k.alias("k"), F.length(x["gap"]).cast("long").alias("gap"), F.length(x["found"]).cast("long").alias("size"), x["value"].alias("value")))
    none = F.array().cast(MATCH)
    # Most texts have no match; for them only the search is done. What follows the last match is no match.
    return F.when(F.rlike(text, pattern_col), F.filter(one, lambda x: x["size"].isNotNull()).cast(MATCH)).otherwise(none)


def _joined(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    one = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(one, ",")


def scan_secrets(docs: DataFrame, max_owners: int = 1, max_repositories: int = 5, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None) -> DataFrame:
    """A row for each row of ``docs`` with its secrets and what ownership says of them.

    ``n_assign, n_access, n_hex`` count base matches; ``base`` and ``spans`` list spans as
    kind:start:end in code points by start, then kind as listed, the latter with the added
    kinds that are live; ``n_live`` and ``n_example`` count all candidates by verdict: live
    with at most ``max_owners`` owners and, where ``repository_col`` names a column, at most
    ``max_repositories`` repositories, else example. The span of a URL with a password begins at most 16
    characters before its ``://``, however long the scheme.

    A null text is empty; null owners count together with empty ones as one owner; repeated rows come back each with the same result;
    columns not named are not read, so their names can't clash; an empty table gives an
    empty result. Time and memory follow the length of a text and the number of its matches.
    """
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository_col).cast("string") if repository_col else F.lit(""), F.lit("")).alias("repository"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    all_kinds = BASE_KINDS + ADDED_KINDS
    matches = F.concat(*(_matches(F.col("text"), rank, pattern, group) for rank, (_, pattern, group, _) in enumerate(all_kinds)))
    # The texts are searched once; matches are few and go to the shared folder, with a number for each row.
    found = checkpointed(source.select("doc_id", "owner", "repository", F.monotonically_increasing_id().alias("row"), matches.alias("matches")))

    least = F.array(*(F.lit(n) for *_, n in all_kinds))
    each = found.select("row", "doc_id", "owner", "repository", F.explode("matches").alias("m")).select(
        "row", "doc_id", "owner", "repository", "m.rank", "m.k", "m.gap", "m.size", (F.length("m.value") >= F.get(least, F.col("m.rank"))).alias("long_enough"), F.sha2("m.value", 256).alias("digest")
    )
    # Places are running sums over a text's matches.
    so_far = Window.partitionBy("row", "rank").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.col("gap") + F.col("size")).over(so_far)
    placed = checkpointed(each.withColumn("stop", stop).filter("long_enough").select("row", "doc_id", "owner", "repository", "rank", (F.col("stop") - F.col("size")).alias("start"), "stop", "digest"))

    # Each step combines before its shuffle and has the hash's owners and repositories spread
    # over tasks, so a value that a third of all rows hold is counted piece by piece.
    held = placed.select("digest", "owner", "repository").distinct()
    by_owner = held.groupBy("digest", "owner").agg(F.count("*").alias("n"))
    ownership = by_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    # Written down, so that the join shuffles both its sides and a frequent value's rows can be split.
    ownership = checkpointed(ownership)
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    judged = placed.join(ownership.hint("merge"), "digest").select("row", "doc_id", "rank", F.struct("start", "rank", "stop").alias("span"), live.alias("live"))
    is_base = F.col("rank") < len(BASE_KINDS)
    of_row = judged.groupBy("row", "doc_id").agg(
        *(F.count_if(F.col("rank") == k).alias(f"n_{kind}") for k, (kind, *_) in enumerate(BASE_KINDS)),
        F.collect_list(F.when(is_base, F.col("span"))).alias("base"), F.collect_list(F.when(is_base | F.col("live"), F.col("span"))).alias("spans"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"),
    )
    columns = ["doc_id", *(f"n_{kind}" for kind, *_ in BASE_KINDS), "base", "spans", "n_live", "n_example"]
    some = of_row.withColumns({"base": _joined(F.col("base")), "spans": _joined(F.col("spans"))}).select("row", *columns)
    # Most rows have no match at all; of a few all are too short.
    few = found.filter(F.size("matches") > 0).select("doc_id", "row").join(some.select("row"), "row", "left_anti")
    none = found.filter(F.size("matches") == 0).select("doc_id", "row").unionByName(few)
    empty = {c: F.lit("") if c in ("base", "spans") else F.lit(0).cast("long") for c in columns[1:]}
    return some.select(columns).unionByName(none.select("doc_id", *(v.alias(c) for c, v in empty.items())))


def secret_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``, then the verdict counts."""
    found = scan_secrets(docs)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans", "n_live", "n_example")


def _found_sql(rank: int, kind: str, pattern: str, group: int) -> str:
    """Matches of a kind, long enough or not, and what stands before each; RE2's white space lacks the vertical tab."""
    pattern = pattern.replace(r"\s", r"\x09-\x0D\x20").replace("'", "''")
    return f"""SELECT doc_id, owner, {rank} AS rank, '{kind}' AS kind, m, v, gap, k FROM (
        SELECT doc_id, owner, unnest(m) AS m, unnest(regexp_extract_all(text, '{pattern}', {group})) AS v, unnest(string_split_regex(text, '{pattern}')[1:len(m)]) AS gap, generate_subscripts(m, 1) AS k
        FROM (SELECT *, regexp_extract_all(text, '{pattern}', 0) AS m FROM d))"""


#: DuckDB SQL of ``secret_digest`` over documents.
SECRETS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS text FROM documents),
least_of(kind, least) AS (VALUES {", ".join(f"('{kind}', {least})" for kind, _, _, least in BASE_KINDS + ADDED_KINDS)}),
found AS ({" UNION ALL ".join(_found_sql(k, *kind[:3]) for k, kind in enumerate(BASE_KINDS + ADDED_KINDS))}),
placed AS (
    SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY k) AS stop FROM found
), spans AS (
    SELECT p.doc_id, p.owner, p.rank, p.v, (p.stop - length(p.m))::BIGINT AS start, p.kind || ':' || (p.stop - length(p.m))::BIGINT || ':' || p.stop::BIGINT AS shown
    FROM placed p JOIN least_of l USING (kind) WHERE length(p.v) >= l.least
), judged AS (
    SELECT s.*, o.owners <= 1 AS live FROM spans s JOIN (SELECT v, count(DISTINCT owner) AS owners FROM spans GROUP BY v) o USING (v)
), of_doc AS (
    SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
        string_agg(shown, ',' ORDER BY start, rank) FILTER (rank < {len(BASE_KINDS)}) AS base, string_agg(shown, ',' ORDER BY start, rank) FILTER (rank < {len(BASE_KINDS)} OR live) AS spans,
        count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
    FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
    coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN of_doc USING (doc_id)
"""
