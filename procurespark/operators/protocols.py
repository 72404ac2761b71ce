"""Protocol corpus: license gate, ranking, deduplication, identity, shortlist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from procurespark.functions.scoring import rank_score
from procurespark.functions.text import UNKNOWN_LICENSE, filled, strip
from procurespark.operators.tables import key_id
from procurespark.schemas import MATERIALS, STEPS

#: Licenses whose content may be served; all others are linked to.
SERVED_LICENSES = ["CC0", "CC-BY"]


def served(license_name: Column, serving_basis: str | Column | None = None, allow: list[str] | None = None) -> Column:
    """Whether content may be served; a contract adds unknown licenses, never restricted ones."""
    allow = SERVED_LICENSES if allow is None else allow
    if isinstance(serving_basis, Column):
        return F.coalesce(license_name.isin(*allow) | ((license_name == UNKNOWN_LICENSE) & filled(serving_basis).isNotNull()), F.lit(False))
    return F.coalesce(license_name.isin(*allow, *([UNKNOWN_LICENSE] if serving_basis else [])), F.lit(False))


def license_gate(protocols: DataFrame, serving_basis: str | None = None, allow: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """What may be served and what may only be linked to."""
    ok = served(F.col("license"), serving_basis, allow)
    return protocols.filter(ok), protocols.filter(~ok)


def gated(protocols: DataFrame, serving_basis: str | None = None, allow: list[str] | None = None) -> DataFrame:
    """Rows to be stored: content only where it may be served, the contract only where it is why."""
    listed = SERVED_LICENSES if allow is None else allow
    ok = served(F.col("license"), serving_basis, allow)
    return protocols.withColumns({
        "servable": ok,
        "serving_basis": F.when(ok & ~F.coalesce(F.col("license").isin(*listed), F.lit(False)), F.lit(serving_basis)),
        "steps": F.when(ok, F.col("steps")).otherwise(F.array().cast(STEPS)),
        "materials": F.when(ok, F.col("materials")).otherwise(F.array().cast(MATERIALS)),
        "rank_score": rank_score(F.col("review")),
        "fetched_at": F.col("fetched_at").cast("string").try_cast("timestamp"),
    })


def review_order(reviewed: Column, score: Column, position: Column) -> list[Column]:
    """Peer-reviewed first, then the score, then the input's order."""
    return [F.coalesce(reviewed, F.lit(False)).desc(), score.desc(), position.asc()]


def rank_by_review(protocols: DataFrame, position: str = "position") -> DataFrame:
    return protocols.orderBy(*review_order(F.col("review.peer_reviewed"), rank_score(F.col("review")), F.col(position)))


def top_by_review(protocols: DataFrame, n: int, position: str = "position") -> DataFrame:
    return rank_by_review(protocols, position).limit(n)


def dedupe_by_doi(protocols: DataFrame, position: str = "position", score: Column | None = None) -> DataFrame:
    """One row for each identifier, case aside: that of the highest score, of equals the first; rows without one stay.

    The best of a task's rows goes into the shuffle, so an identifier of very many rows is no burden.
    """
    score = rank_score(F.col("review")) if score is None else score
    keyed = protocols.withColumn("_doi", filled(F.lower(strip(F.col("doi"))))).withColumn("_order", F.struct(score.alias("score"), negated(protocols, position)))
    best = keyed.filter(F.col("_doi").isNotNull()).groupBy("_doi").agg(F.max_by(F.struct(*(F.col(c) for c in protocols.columns)), "_order").alias("_row")).select("_row.*")
    return best.unionByName(keyed.filter(F.col("_doi").isNull()).select(*protocols.columns))


def negated(df: DataFrame, position: str) -> Column:
    """What is greatest where ``position``, a number or a struct of numbers, is least."""
    kind = df.schema[position].dataType
    return F.struct(*(-F.col(f"{position}.{f.name}") for f in kind.fields)) if isinstance(kind, StructType) else -F.col(position)


def resolve_identity(new: DataFrame, stored: DataFrame) -> DataFrame:
    """``new`` with ``existing_id``: the stored row with its identifier as written, else with its source and source id."""
    by_doi = stored.filter(filled(F.col("doi")).isNotNull()).select(F.col("doi").alias("_doi"), F.col("id").alias("_doi_hit"))
    by_key = stored.select(F.col("source").alias("_source"), F.col("source_id").alias("_source_id"), F.col("id").alias("_key_hit"))
    # Rows without an identifier would all fall to one task: they are dealt by their source's id and meet nothing.
    has = filled(F.col("doi")).isNotNull()
    meets = F.when(has, F.col("doi")).otherwise(F.xxhash64("source", "source_id").cast("string"))
    met = new.join(by_doi, (meets == F.col("_doi")) & has, "left").join(by_key, (F.col("source") == F.col("_source")) & (F.col("source_id") == F.col("_source_id")), "left")
    return met.withColumn("existing_id", F.coalesce("_doi_hit", "_key_hit")).drop("_doi", "_doi_hit", "_source", "_source_id", "_key_hit")


def upsert_protocols(stored: DataFrame, new: DataFrame, serving_basis: str | None = None, position: str = "position") -> DataFrame:
    """The next snapshot: deduplicated, identified, gated; a hit takes over all of the new row under the stored id.

    Of several new rows with one identity the last by ``position`` holds.
    """
    batch = gated(resolve_identity(dedupe_by_doi(new, position), stored), serving_basis)
    natural = F.when(filled(F.col("doi")).isNotNull(), key_id(F.lit("doi"), F.col("doi"))).otherwise(key_id(F.lit("protocol"), F.col("source"), F.col("source_id")))
    batch = batch.withColumn("id", F.coalesce("existing_id", natural))
    rows = batch.groupBy("id").agg(F.max_by(F.struct(*(F.col(c) for c in stored.columns if c != "id")), position).alias("_row")).select("id", "_row.*").select(*stored.columns)
    return stored.join(rows.select("id"), "id", "left_anti").unionByName(rows)


def upsert_counts(stored: DataFrame, new: DataFrame, serving_basis: str | None = None, position: str = "position") -> DataFrame:
    """One row: created, updated, servable, link_out_only, deduped_in_batch."""
    batch = resolve_identity(dedupe_by_doi(new, position), stored)
    ok = served(F.col("license"), serving_basis)
    counted = batch.agg(F.count("*").alias("_n"), F.count_if(F.col("existing_id").isNull()).alias("created"), F.count_if(F.col("existing_id").isNotNull()).alias("updated"), F.count_if(ok).alias("servable"), F.count_if(~ok).alias("link_out_only"))
    return counted.crossJoin(new.agg(F.count("*").alias("_all"))).select("created", "updated", "servable", "link_out_only", (F.col("_all") - F.col("_n")).alias("deduped_in_batch"))  # one row each


def version_number(version: Column) -> Column:
    """A version as a number; what is none counts as 0."""
    return F.coalesce(version.cast("string").try_cast("bigint"), F.lit(0))


def latest_versions(items: DataFrame, position: str = "position", within: list[str] | None = None) -> DataFrame:
    """The item of the highest version of each id (in each of ``within``), of equals the first; null ids go."""
    keys = [*(within or []), "id"]
    order = F.struct(version_number(F.col("version_id")).alias("version"), negated(items, position))
    rest = [c for c in items.columns if c not in keys]
    best = items.filter(F.col("id").isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, "_row.*").select(*items.columns)


def shortlist(items: DataFrame, n: int, position: str = "position", within: list[str] | None = None) -> DataFrame:
    """The best n of the latest versions (of each of ``within``), with their ``rank``; each task keeps its best n before the shuffle."""
    order = Window.partitionBy(*(within or [F.lit(0)])).orderBy(*review_order(F.col("review.peer_reviewed"), rank_score(F.col("review")), F.col(position)))
    return latest_versions(items, position, within).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def license_histogram(protocols: DataFrame) -> DataFrame:
    return protocols.groupBy("license").agg(F.count("*").alias("n"))


def dumped(protocols: DataFrame, columns: tuple[str, ...] = ("authors", "steps", "materials", "review")) -> DataFrame:
    """``protocols`` with nested columns as JSON texts, their nulls kept, as a row store holds them."""
    return protocols.withColumns({c: F.to_json(F.col(c), {"ignoreNullFields": "false"}) for c in columns})
