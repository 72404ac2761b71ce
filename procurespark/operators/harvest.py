"""A harvest run: shortlist of searched items, fetch of what is not stored, map, gate, rank."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procurespark.operators import protocols as corpus
from procurespark.sources.protocols import Access, item_review, map_protocol_service
from procurespark.storage import checkpointed


@dataclass(frozen=True)
class Harvest:
    servable: DataFrame  # best first by ``rank``
    link_out: DataFrame
    fetched: DataFrame  # id, version, payload, to be added to the store
    manifest: DataFrame  # one row


def picks(seeds: DataFrame, items: DataFrame, n_per_category: int) -> DataFrame:
    """``place, category_id, id, version, payload``: the best items of each category in the order they are wanted.

    ``seeds`` has ``category_id, queries``; ``items`` (``query, position, payload``) are what its queries found.
    """
    asked = seeds.select("category_id", F.posexplode("queries").alias("at", "query"))
    item = F.try_parse_json("payload")
    found = asked.join(items, "query").withColumn("i", item).filter(F.col("i").isNotNull())
    listed = found.select(
        "category_id", F.try_variant_get("i", "$.id", "string").alias("id"), F.try_variant_get("i", "$.version_id", "string").alias("version_id"),
        item_review(F.col("i")).alias("review"), F.struct(F.col("at").cast("long").alias("at"), F.col("position").cast("long").alias("position")).alias("position"), "payload",
    )
    best = corpus.shortlist(listed, n_per_category, within=["category_id"])
    place = F.row_number().over(Window.orderBy("category_id", "rank"))  # at most n for each of the categories
    return best.select(place.alias("place"), "category_id", "id", corpus.version_number(F.col("version_id")).cast("string").alias("version"), "payload")


def harvest(seeds: DataFrame, items: DataFrame, stored: DataFrame, fetch: Callable[[DataFrame], DataFrame], n_per_category: int, cap: int = 1000, serving_basis: str | None = None, access: Access | None = None, stamp: str | None = None) -> Harvest:
    """Fetches at most ``cap`` records that ``stored`` (``id, version, payload``) lacks, category by category, and maps all it has.

    ``fetch`` takes ``id, version, place`` and adds ``payload`` and ``error``. Failures count as errors and not
    against the cap, so further records take their place; once the cap is reached the run ends,
    and stored records behind that place stay out. Repeated picks count as stored.
    """
    if access is not None:
        access.require()
    wanted = checkpointed(picks(seeds, items, n_per_category))
    held = stored.select("id", "version", F.col("payload").alias("stored")).dropDuplicates(["id", "version"])
    known = checkpointed(wanted.join(held, ["id", "version"], "left"))
    first = known.filter(F.col("stored").isNull()).groupBy("id", "version").agg(F.min("place").alias("place"))
    asked, got, done, last = checkpointed(first), None, 0, None
    while done < cap:  # one round more only where records of the last one failed
        turn = asked.orderBy("place").limit(cap - done)
        tried = checkpointed(fetch(turn.select("id", "version", "place")))
        if tried.isEmpty():
            break
        got = tried if got is None else got.unionByName(tried)
        asked = asked.join(tried.select("place"), "place", "left_anti")
        done += tried.filter(F.col("error").isNull()).count()
    new = got if got is not None else known.limit(0).select("id", "version", "place", F.col("payload"), F.lit(None).cast("string").alias("error"))
    good = new.filter(F.col("error").isNull())
    if done >= cap:
        last = good.agg(F.max("place")).first()[0]
    within = F.lit(True) if last is None else F.col("place") <= last
    taken = known.filter(within).join(good.select("id", "version", F.col("payload").alias("fresh"), F.col("place").alias("at")), ["id", "version"], "left")
    details = taken.select("place", "id", F.coalesce("stored", "fresh").alias("detail"), "payload", (F.col("stored").isNotNull() | (F.col("fresh").isNotNull() & (F.col("at") < F.col("place")))).alias("cached"))
    mapped = map_protocol_service(details.filter(F.col("detail").isNotNull()).select(F.col("detail").alias("payload"), "place"), wanted.select("payload", F.col("place").alias("position")), keep=["place"])
    ok = corpus.served(F.col("license"), serving_basis)
    order = Window.orderBy(*corpus.review_order(F.col("review.peer_reviewed"), corpus.rank_score(F.col("review")), F.col("place")))  # at most what was shortlisted
    servable = mapped.filter(ok).withColumn("rank", F.row_number().over(order))
    counted = mapped.agg(F.count_if(ok).alias("servable"), F.count_if(~ok).alias("link_out"))
    failed = new.filter(F.col("error").isNotNull()).filter(within)
    manifest = (
        wanted.agg(F.count("*").alias("shortlisted"))
        .crossJoin(good.agg(F.count("*").alias("fetched")))
        .crossJoin(details.agg(F.count_if("cached").alias("skipped_cached")))
        .crossJoin(counted)
        .crossJoin(failed.agg(F.count("*").alias("errors")))  # one row each
        .withColumns({"serving_basis": F.lit(serving_basis), "cap": F.lit(cap), "stamp": F.lit(stamp)})
    )
    return Harvest(servable, mapped.filter(~ok), good.select("id", "version", "payload"), manifest)
