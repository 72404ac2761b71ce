"""Snapshot tables: idempotent upserts and integrity checks.

Parquet has no MERGE, so an upsert makes the next snapshot from the last one and the
new rows. Ids come from natural keys, so a repeated run makes the same snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurespark.functions.text import canonical_category, filled, strip


def key_id(*parts: Column) -> Column:
    """An id in the form of a UUID from a natural key; nulls and values stay apart."""
    digest = F.sha2(F.to_json(F.array(*(F.to_json(F.struct(p.cast("string").alias("v"))) for p in parts))), 256)
    at = lambda first, n: F.substring(digest, first, n)
    return F.concat_ws("-", at(1, 8), at(9, 4), at(13, 4), at(17, 4), at(21, 12))


def normalize_products(extracted: DataFrame, *more: str) -> DataFrame:
    """Trimmed, with a canonical category; a missing cost is 0; columns in ``more`` come along."""
    return extracted.select(
        strip(F.col("supplier_sku")).alias("supplier_sku"), strip(F.col("name")).alias("name"), canonical_category(F.col("category")).alias("category"),
        strip(filled(F.col("brand"))).alias("brand"), strip(filled(F.col("mpn"))).alias("mpn"), "pack_size", F.coalesce("cost", F.lit(0.0)).alias("cost"),
        "currency", "stock", "lead_time_days", F.coalesce("specs", F.create_map().cast("map<string,string>")).alias("specs"), *more,
    )


def upsert(current: DataFrame, new: DataFrame, key: list[str], update: list[str], order: str | None = None) -> DataFrame:
    """The next snapshot of ``current``.

    Rows meet on ``key``; those of ``new`` set the columns in ``update``, others keep the stored
    values, and unmatched ones are added. Of new rows with one key the last by ``order`` holds
    (any, if they are equal or no order is given). A key with a null part matches nothing,
    so such rows are added each time. Columns of ``current`` that ``new`` lacks are null.
    """
    keyed = F.lit(True)
    for k in key:
        keyed = keyed & F.col(k).isNotNull()
    by = F.col(order) if order else F.struct(*(F.to_json(F.struct(F.col(c))) for c in new.columns))
    columns = current.columns
    rest = [c for c in new.columns if c not in key]
    # The last of a task's rows goes into the shuffle, so a key of very many rows is no burden.
    fresh = new.filter(keyed).groupBy(*key).agg(F.max_by(F.struct(*rest), by).alias("_row")).select(*key, "_row.*")
    present = [c for c in columns if c in new.columns]
    left = current.filter(keyed).select(*(F.col(c).alias(f"_o_{c}") for c in columns)).withColumn("_old", F.lit(True))
    right = fresh.select(*(F.col(c).alias(f"_n_{c}") for c in present)).withColumn("_new", F.lit(True))
    met = left.join(right, [F.col(f"_o_{k}") == F.col(f"_n_{k}") for k in key], "full")
    kinds = dict(current.dtypes)

    def value(c: str) -> Column:
        if c not in present:
            return F.col(f"_o_{c}")
        fresh_value = F.col(f"_n_{c}").cast(kinds[c])
        return F.when(F.col("_old").isNull() | (F.col("_new").isNotNull() & F.lit(c in update)), fresh_value).otherwise(F.col(f"_o_{c}"))

    loose = lambda df: df.filter(~keyed)
    added = loose(new).select(*(F.col(c).cast(kinds[c]).alias(c) if c in present else F.lit(None).cast(kinds[c]).alias(c) for c in columns))
    return met.select(*(value(c).alias(c) for c in columns)).unionByName(loose(current)).unionByName(added)


def upsert_suppliers(current: DataFrame, new: DataFrame) -> DataFrame:
    """Suppliers by name; those that are there keep their region and tier."""
    made = new.select(key_id(F.lit("supplier"), F.col("name")).alias("id"), "name", "region", "tier", F.coalesce("verified", F.lit(False)).alias("verified"))
    return upsert(current, made, ["name"], [])


def _keyless() -> Column:
    return filled(F.col("brand")).isNull() | filled(F.col("mpn")).isNull()


def product_id(position: str = "position") -> Column:
    """A product's id from brand and part number; without them from supplier, SKU, run and place in it."""
    loose = key_id(F.lit("loose"), F.col("supplier_id"), F.col("supplier_sku"), F.col("run_id"), F.col(position))
    return F.when(_keyless(), loose).otherwise(key_id(F.lit("product"), F.col("brand"), F.col("mpn")))


def upsert_products(current: DataFrame, items: DataFrame, position: str = "position") -> DataFrame:
    """Products by brand and part number: name, category and specs follow the last item; a stored vector stays, and turns stale.

    Items without brand or part number are added, under an id from supplier, SKU, run and place,
    so another run adds them again and the same one doesn't.
    """
    made = items.select(product_id(position).alias("id"), "category", "name", F.when(~_keyless(), F.col("brand")).alias("_b"), F.when(~_keyless(), F.col("mpn")).alias("_m"), "brand", "mpn", "specs", position)
    keyed = made.filter(F.col("_b").isNotNull()).drop("_b", "_m")
    loose = made.filter(F.col("_b").isNull()).select(*(F.col(c) for c in current.columns if c in made.columns))
    out = upsert(current, keyed, ["brand", "mpn"], ["name", "category", "specs"], position)
    loose = loose.join(current.select("id"), "id", "left_anti")
    return out.unionByName(loose, allowMissingColumns=True)


def upsert_offers(current: DataFrame, items: DataFrame, position: str = "position") -> DataFrame:
    """Offers by supplier and SKU; all else follows the last item, its product too."""
    made = items.withColumn("id", key_id(F.lit("offer"), F.col("supplier_id"), F.col("supplier_sku")))
    return upsert(current, made, ["supplier_id", "supplier_sku"], ["product_id", "pack_size", "cost", "currency", "stock", "lead_time_days"], position)


def upsert_equivalences(current: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs get the new confidence and kind; method and review stay; nothing is deleted."""
    return upsert(current, new.withColumn("reviewed", F.lit(False)), ["product_id", "equivalent_id"], ["confidence", "kind"])


def upsert_links(current: DataFrame, new: DataFrame) -> DataFrame:
    """Links of protocol, product and material get confidence, kind and method."""
    return upsert(current, new.withColumn("reviewed", F.lit(False)), ["protocol_id", "product_id", "material_name"], ["confidence", "kind", "method"])


def append_sourcing_request(requests: DataFrame, item: str, context: str | None, stamp: str, shop: str | None = None, customer_id: str | None = None, email: str | None = None) -> DataFrame:
    """``requests`` and a new one; who asks comes from the caller's session, never from the text of a request."""
    row = requests.sparkSession.createDataFrame([(item, context or "", shop, customer_id, email, "new", stamp)], "requested_item string, context string, shop string, customer_id string, email string, status string, created_at string")
    row = row.withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("id", key_id(F.lit("request"), *(F.col(c) for c in ("shop", "customer_id", "email", "requested_item", "context", "created_at"))))
    return requests.unionByName(row)


def ingest_report(items: DataFrame) -> DataFrame:
    """One row of counters; both upsert counts are those of items."""
    return items.agg(F.count("*").alias("extracted")).select("extracted", F.col("extracted").alias("products_upserted"), F.col("extracted").alias("offers_upserted"))


# Checks that a database would make as constraints; each returns the offending rows.


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """``key`` and ``n`` of keys that stand more than once; a key with a null part is free."""
    return df.dropna(subset=key).groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose reference has no parent."""
    keys = parent.select(F.col(parent_key).alias("_parent"))
    return df.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_parent"), "left_anti")


def cascade(df: DataFrame, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows left once parents are gone."""
    return df.join(parent.select(F.col(parent_key).alias("_parent")), F.col(column) == F.col("_parent"), "left_semi")


def outside(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose value isn't one of those allowed."""
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(*allowed))


def self_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a) == F.col(b))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the number of nulls of each column that must be filled."""
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))


def evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both, columns that one lacks null in it."""
    return old.unionByName(new, allowMissingColumns=True)
