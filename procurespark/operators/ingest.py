"""Catalog ingestion as one run: extracted rows to suppliers, products, offers and equivalences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from procurespark.functions.scoring import GateBars
from procurespark.functions.text import canonical_text
from procurespark.functions.vectors import HASH_MODEL, hash_embedding
from procurespark.operators import conformance, knn, matching, tables
from procurespark.operators.evaluation import confusion, gate, predicted_kind
from procurespark.operators.snapshots import Work
from procurespark.schemas import known_tier
from procurespark.storage import checkpointed


def product_text() -> Column:
    """What a product's vector is made of."""
    return canonical_text(F.col("brand"), F.col("name"), F.col("category"), F.col("specs"))


def ingest(
    work: Work, extracted: DataFrame, supplier: str, region: str, tier: str, run_id: str, match: bool = False, embed: Callable[[Column], Column] = hash_embedding, model: str = HASH_MODEL, candidates: int = 20, buckets: int = 64
) -> DataFrame:
    """Rows of a catalog (with ``position``) into the tables of ``work``; one row of counters.

    Supplier, product and offer ids come from natural keys, so a repeated run with one
    ``run_id`` changes nothing. Only the buckets of products, offers and edges that the run's rows fall into
    are written. With ``match``, products without a vector get one and the run's
    products are matched with all others. The catalog is read once; counters are taken as it passes.
    """
    known_tier(tier)
    spark, count = extracted.sparkSession, F.count(F.lit(1))
    named = spark.createDataFrame([(supplier, region, tier, None)], "name string, region string, tier string, verified boolean")
    suppliers = work.write("suppliers", tables.upsert_suppliers(work.read("suppliers"), named))
    (supplier_id,) = suppliers.filter(F.col("name") == supplier).select("id").first()
    items = tables.normalize_products(extracted, "position").withColumns({"supplier_id": F.lit(supplier_id), "run_id": F.lit(run_id)})
    seen = Observation()
    items = work.scratch("items", items.withColumn("product_id", tables.product_id()).observe(seen, count.alias("extracted")))

    def products_of(held: DataFrame, new: DataFrame) -> DataFrame:
        merged = tables.upsert_products(held, new.drop("id"))
        return matching.embed_missing(merged, embed, product_text) if match else merged

    work.merge("products", items.withColumn("id", F.col("product_id")), products_of, "id", buckets)
    offer_id = tables.key_id(F.lit("offer"), F.col("supplier_id"), F.col("supplier_sku"))
    work.merge("offers", items.withColumn("id", offer_id), tables.upsert_offers, "id", buckets)
    own = items.select(F.col("product_id").alias("id")).distinct()
    to_match, written = own.count(), 0
    if match:
        products = work.read("products")
        made, edges = Observation(), matching.equivalences(near(products.join(own, "id", "left_semi"), products, candidates), products)
        work.merge("equivalences", work.scratch("edges", edges.observe(made, count.alias("n"))), tables.upsert_equivalences, "product_id", buckets)
        written = made.get["n"]
    n = seen.get["extracted"]
    return spark.createDataFrame([(n, n, n, to_match, written)], "extracted long, products_upserted long, offers_upserted long, products_to_match long, equivalences_written long")


def numbered(products: DataFrame) -> DataFrame:
    """``id, _n`` and ``embedding``: a number for each product, rising with its id."""
    return checkpointed(products.select("id", "embedding").orderBy("id").withColumn("_n", F.monotonically_increasing_id()))


def _named(found: DataFrame, number: DataFrame) -> DataFrame:
    names = number.select(F.col("_n"), F.col("id").alias("_name"))
    met = found.join(names.withColumnRenamed("_n", "query_id").withColumnRenamed("_name", "_q"), "query_id").join(names.withColumnRenamed("_n", "id").withColumnRenamed("_name", "_i"), "id")
    return met.select(F.col("_q").alias("query_id"), F.col("_i").alias("id"), "distance", "rank")


def near(queries: DataFrame, products: DataFrame, k: int = 20, vectors: DataFrame | None = None) -> DataFrame:
    """``query_id, id, distance, rank`` of the nearest other products by their vectors; ids are of any kind that has an order.

    ``queries`` and ``vectors`` (all products, if None) name products by ``id``; of equal distances the smaller id goes first.
    """
    number = numbered(products)
    asked = number.join(queries.select("id"), "id", "left_semi")
    held = number if vectors is None else number.join(vectors.select("id"), "id", "left_semi")
    return _named(knn.nearest(asked, held, k, "_n"), number)


def neighbour_lists(products: DataFrame, k: int = 40) -> DataFrame:
    """The nearest others of each product, more than edges need, so that ``refreshed`` can lose some."""
    return near(products, products, k)


def refreshed(lists: DataFrame, products: DataFrame, changed: DataFrame, least: int = 20, most: int = 40) -> DataFrame:
    """``lists`` brought up to date with products of which ``changed`` (``id``) have a new vector, are new or are gone.

    What is left of a list without changed products is still exact up to its last entry; changed
    products are held against all others, and those nearer than that entry enter. Lists of changed
    products, and those with fewer than ``least`` entries left where there are so many others, are made anew.
    The result holds the ``least`` nearest of each product exactly, as a full search does.
    """
    changed = checkpointed(changed.select("id").distinct())
    kept = lists.join(changed, "id", "left_anti").join(changed.withColumnRenamed("id", "query_id"), "query_id", "left_anti")
    there = products.filter(F.col("embedding").isNotNull()).select("id")
    others = there.count() - 1
    size = kept.groupBy("query_id").agg(F.count("*").alias("left"), F.max(F.struct("distance", "id")).alias("last"))
    state = there.withColumnRenamed("id", "query_id").join(size, "query_id", "left")
    state = checkpointed(state.join(changed.select(F.col("id").alias("query_id"), F.lit(True).alias("anew")), "query_id", "left"))
    anew = F.col("anew").isNotNull() | (F.coalesce("left", F.lit(0)) < min(least, others))
    again = near(state.filter(anew).select(F.col("query_id").alias("id")), products, most)
    rest = state.filter(~anew).select("query_id", "last")
    entering = near(rest.select(F.col("query_id").alias("id")), products, most, changed).join(rest, "query_id").filter(F.struct("distance", "id") < F.col("last"))
    merged = kept.join(rest.select("query_id"), "query_id", "left_semi").select("query_id", "id", "distance").unionByName(entering.select("query_id", "id", "distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    merged = merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return again.unionByName(merged)


def gated(neighbours: DataFrame, products: DataFrame, gold: DataFrame, bars: GateBars = GateBars()) -> DataFrame:
    """The gate's verdict (one row) on edges from ``neighbours``.

    ``gold`` has ``confidence`` and ``gold`` of labelled pairs; the share of products with an exact
    candidate is taken over all products.
    """
    judged = confusion(gold.withColumn("pred", predicted_kind(F.col("confidence"), 0.92, 0.80)))
    return gate(judged.crossJoin(matching.sample_exact_rate(neighbours, products, sample=None)), bars)  # one row each


def rebuild(products: DataFrame, neighbours: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All equivalences made anew, and the gate's verdict on them (one row): take the edges only if it passed."""
    return matching.equivalences(neighbours, products), gated(neighbours, products, gold)


def rebuild_store(work: Work, gold: DataFrame, changed: DataFrame | None = None, candidates: int = 20, buckets: int = 64, bars: GateBars = GateBars()) -> DataFrame:
    """Neighbours and equivalences of ``work``'s products made anew where the gate passes; its verdict (one row) with ``equivalences_written``.

    With ``changed`` (``id``), the stored neighbours are brought up to date instead of searched for, and only edges of
    products whose neighbours or own record changed are written again; the result is that of a full rebuild, which is made where
    no neighbours are stored yet. Where the gate fails, nothing is written.
    """
    products = work.read("products")
    changed = changed if work.entry("neighbours") else None
    if changed is None:
        lists = work.scratch("lists", neighbour_lists(products, 2 * candidates))
    else:
        before = work.read("neighbours")
        lists = work.scratch("lists", refreshed(before, products, changed, candidates, 2 * candidates))
    first = lists.filter(F.col("rank") <= candidates)
    verdict = checkpointed(gated(first, products, gold, bars))
    (passed,) = verdict.select("passed").first()
    if not passed:
        return verdict.withColumn("equivalences_written", F.lit(0).cast("long"))
    made = Observation()
    if changed is None:
        work.write_buckets("neighbours", lists, "query_id", buckets)
        work.write_buckets("equivalences", _edges(first, products).observe(made, F.count(F.lit(1)).alias("n")), "product_id", buckets)
        return verdict.withColumn("equivalences_written", F.lit(made.get["n"]))
    touched = conformance.changed_rows(before.select("query_id", "id", "distance", "rank"), lists.select("query_id", "id", "distance", "rank")).select(F.col("query_id").alias("product_id"))
    touched = touched.unionByName(changed.select(F.col("id").alias("product_id")))
    # A changed record changes the scores of the edges to it, too.
    touched = touched.unionByName(lists.join(changed.select("id"), "id", "left_semi").select(F.col("query_id").alias("product_id"))).distinct()
    touched = work.scratch("touched", touched)
    fresh = _edges(first.join(touched.withColumnRenamed("product_id", "query_id"), "query_id", "left_semi"), products)
    fresh = work.scratch("fresh", fresh.observe(made, F.count(F.lit(1)).alias("n")))
    # An unkept product of `touched` is a row of its own, so that buckets that only lose edges are written too.
    asked = fresh.unionByName(touched, allowMissingColumns=True)
    replaced = lambda held, new: held.join(touched, "product_id", "left_anti").unionByName(new.filter(F.col("equivalent_id").isNotNull()))
    work.merge("equivalences", asked, replaced)
    of_touched = lists.join(touched.withColumnRenamed("product_id", "query_id"), "query_id", "left_semi").unionByName(touched.withColumnRenamed("product_id", "query_id"), allowMissingColumns=True)
    work.merge("neighbours", of_touched, lambda held, new: held.join(touched.withColumnRenamed("product_id", "query_id"), "query_id", "left_anti").unionByName(new.filter(F.col("id").isNotNull())))
    return verdict.withColumn("equivalences_written", F.lit(made.get["n"]))


def _edges(neighbours: DataFrame, products: DataFrame) -> DataFrame:
    return matching.equivalences(neighbours, products).withColumn("reviewed", F.lit(False))
