"""Product nodes of a commerce service, as nested JSON."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procurespark.functions.text import filled, gid_tail, strip

NODE = """
    id string, title string, vendor string, productType string, tags array<string>,
    metafields struct<edges: array<struct<node: struct<namespace: string, key: string, value: string>>>>,
    variants struct<edges: array<struct<node: struct<id: string, sku: string, barcode: string, title: string, price: string, inventoryQuantity: int,
        selectedOptions: array<struct<name: string, value: string>>,
        inventoryItem: struct<unitCost: struct<amount: string, currencyCode: string>>>>>>
"""
DEFAULT_VARIANT = "Default Title"


@dataclass(frozen=True)
class CommerceOptions:
    """shop_currency where a cost names none; mpn_metafield as namespace.key; metafields of specs_namespace are specs."""

    shop_currency: str = "USD"
    mpn_metafield: str | None = None
    specs_namespace: str | None = None


def api_host(shop: str, suffix: str) -> str:
    """The host of a shop's interface: a bare handle gets ``suffix``."""
    host = shop.strip().removeprefix("https://").removeprefix("http://").rstrip("/").split("/")[0]
    return host if host.endswith(suffix) or "." in host else host + suffix


def read_nodes(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Nodes landed as JSON, one a line; ``limit`` counts products, not variants."""
    nodes = spark.read.schema(NODE).json(path)
    return nodes if limit is None else nodes.limit(limit)


def map_nodes(nodes: DataFrame, options: CommerceOptions = CommerceOptions()) -> DataFrame:
    """A product row for each variant.

    A variant without a cost takes its price, marked in specs as _cost_basis; part numbers come
    from the metafield, else the barcode; a blank SKU from the variant's id; the pack size
    from the variant's title, else its options.
    """
    blank = F.array().cast("array<struct<key:string,value:string>>")
    entries = F.filter(F.col("metafields.edges"), lambda e: filled(e["node"]["namespace"]).isNotNull() & filled(e["node"]["key"]).isNotNull() & e["node"]["value"].isNotNull())
    named = F.coalesce(F.transform(entries, lambda e: F.struct(F.concat_ws(".", e["node"]["namespace"], e["node"]["key"]).alias("key"), e["node"]["value"].alias("value"))), blank)
    flat = nodes.withColumn("_meta", named).select("*", F.explode("variants.edges").alias("_edge")).withColumn("_v", F.col("_edge.node"))

    last = lambda pairs: F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))  # noqa: E731  the last of a key holds
    metafield = F.get(F.transform(F.filter(last(F.col("_meta")), lambda p: p["key"] == F.lit(options.mpn_metafield)), lambda p: p["value"]), F.lit(0)) if options.mpn_metafield else F.lit(None).cast("string")
    prefix = f"{options.specs_namespace}."
    base = F.transform(F.filter(F.col("_meta"), lambda p: F.startswith(p["key"], F.lit(prefix))), lambda p: F.struct(F.substr(p["key"], F.lit(len(prefix) + 1)).alias("key"), p["value"].alias("value"))) if options.specs_namespace else blank
    chosen = F.coalesce(F.filter(F.transform(F.col("_v.selectedOptions"), lambda o: F.struct(o["name"].alias("key"), o["value"].alias("value"))), lambda p: filled(p["key"]).isNotNull() & filled(p["value"]).isNotNull()), blank)

    title, variant = strip(F.coalesce("title", F.lit(""))), strip(F.coalesce("_v.title", F.lit("")))
    plain = (variant == "") | (variant == DEFAULT_VARIANT)
    cost, price = F.col("_v.inventoryItem.unitCost.amount").try_cast("double"), F.col("_v.price").try_cast("double")
    basis = F.when(cost.isNotNull(), "unit_cost").when(price.isNotNull(), "sell_price_fallback")
    marked = F.when(basis.isNotNull(), F.array(F.struct(F.lit("_cost_basis").alias("key"), basis.alias("value")))).otherwise(blank)
    sku = F.coalesce(filled(strip(F.col("_v.sku"))), F.concat(F.lit("shopify:"), gid_tail(F.coalesce("_v.id", F.lit("")))))
    name = F.when(plain, title).otherwise(F.concat(title, F.lit(" - "), variant))
    pack = F.when(~plain, variant).when(F.size(F.coalesce("_v.selectedOptions", F.array().cast("array<struct<name:string,value:string>>"))) > 0, F.array_join(F.transform(last(chosen), lambda p: F.concat_ws(":", p["key"], p["value"])), " / "))
    return flat.select(
        sku.alias("supplier_sku"),
        F.coalesce(filled(name), sku).alias("name"),
        F.coalesce(filled(strip(F.col("productType"))), filled(strip(F.get("tags", F.lit(0))))).alias("category"),
        filled(strip(F.col("vendor"))).alias("brand"),
        F.coalesce(filled(metafield), filled(strip(F.col("_v.barcode")))).alias("mpn"),
        pack.alias("pack_size"),
        F.coalesce(cost, price).alias("cost"),
        F.coalesce(filled(F.col("_v.inventoryItem.unitCost.currencyCode")), F.lit(options.shop_currency)).alias("currency"),
        F.col("_v.inventoryQuantity").alias("stock"),
        F.lit(None).cast("int").alias("lead_time_days"),
        F.map_from_entries(last(F.concat(base, chosen, marked))).alias("specs"),
    )


def fallback_cost_count(products: DataFrame) -> DataFrame:
    """``n``: variants whose cost is their price."""
    return products.agg(F.count_if(F.try_element_at("specs", F.lit("_cost_basis")) == "sell_price_fallback").alias("n"))
