"""Named reads for an assistant: what a buyer may see, errors as data, and the items that an answer refers to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procurespark.functions.text import protocol_label, public_specs
from procurespark.operators import reads, tables

ITEMS = "type string, id string, label string, position long"


@dataclass
class Catalog:
    """The tables that tools read; ``sourcing_requests`` is replaced by the one that writes."""

    products: DataFrame
    offers: DataFrame
    suppliers: DataFrame
    equivalences: DataFrame
    protocols: DataFrame
    links: DataFrame
    sourcing_requests: DataFrame


Answer = tuple[DataFrame, DataFrame]


def _items(df: DataFrame, kind: str, key: str, label, position: str = "position") -> DataFrame:
    return df.select(F.lit(kind).alias("type"), F.col(key).cast("string").alias("id"), label.alias("label"), F.col(position).cast("long").alias("position"))


def _search_products(catalog: Catalog, args: dict, context: dict) -> Answer:
    page = reads.list_products(catalog.products, catalog.offers, args["query"], page_size=int(args.get("limit") or 8), positions=True)
    return reads.role_view(page, "product", "buyer"), _items(page, "product", "id", F.col("name"))


def _search_protocols(catalog: Catalog, args: dict, context: dict) -> Answer:
    page = reads.list_protocols(catalog.protocols, catalog.links, args["query"], page_size=int(args.get("limit") or 8), positions=True)
    return page.select("id", "title", "product_count", "first_author"), _items(page, "protocol", "id", protocol_label(F.col("title"), F.col("first_author")))


def _protocol_products(catalog: Catalog, args: dict, context: dict) -> Answer:
    one = _known(catalog.protocols, args["protocol_id"], "protocol")
    found = reads.protocol_materials(one, catalog.links, catalog.products, limit=50)
    listed = found.filter(F.col("rank").isNotNull())
    own = _items(one.withColumn("position", F.lit(0)), "protocol", "id", F.col("title"))
    return listed.select("protocol_title", "product_id", "product_name", "material_name", "confidence"), own.unionByName(_items(listed, "product", "product_id", F.col("product_name"), "rank"))


def _product_protocols(catalog: Catalog, args: dict, context: dict) -> Answer:
    one = _known(catalog.products, args["product_id"], "product")
    listed = reads.product_protocols(one, catalog.links, catalog.protocols, limit=50).filter(F.col("rank").isNotNull())
    own = _items(one.withColumn("position", F.lit(0)), "product", "id", F.col("name"))
    return listed.select("product_name", "protocol_id", "title"), own.unionByName(_items(listed, "protocol", "protocol_id", F.col("title"), "rank"))


def _product_detail(catalog: Catalog, args: dict, context: dict) -> Answer:
    one = _known(catalog.products, args["product_id"], "product")
    detail = reads.product_detail(catalog.products, catalog.offers, catalog.suppliers, catalog.equivalences, one.select("id"))
    shown = reads.role_view(detail, "detail", "buyer").withColumn("specs", public_specs(F.col("specs")))
    return shown, _items(detail.withColumn("position", F.lit(0)), "product", "id", F.col("name"))


def _protocols_by_material(catalog: Catalog, args: dict, context: dict) -> Answer:
    found = reads.protocols_by_material(catalog.protocols, catalog.links, args["material"], min(int(args.get("limit") or 10), 50), positions=True)
    return found.drop("position"), _items(found, "protocol", "id", F.col("title"))


def _flag_sourcing_request(catalog: Catalog, args: dict, context: dict) -> Answer:
    catalog.sourcing_requests = tables.append_sourcing_request(catalog.sourcing_requests, args["item"], args.get("context"), context["stamp"], context.get("shop"), context.get("customer_id"), args.get("email"))
    spark = catalog.sourcing_requests.sparkSession
    return spark.createDataFrame([(True, args["item"], "new")], "logged boolean, item string, status string"), spark.createDataFrame([], ITEMS)


def _known(df: DataFrame, key: str, what: str) -> DataFrame:
    one = df.filter(F.col("id").cast("string") == str(key))
    if one.isEmpty():
        raise LookupError(f"{what} not found")
    return one


#: Each tool, its arguments and which of them it must be given.
TOOLS: dict[str, tuple[Callable[[Catalog, dict, dict], Answer], dict[str, type], list[str]]] = {
    "search_products": (_search_products, {"query": str, "limit": int}, ["query"]),
    "search_protocols": (_search_protocols, {"query": str, "limit": int}, ["query"]),
    "protocol_products": (_protocol_products, {"protocol_id": str}, ["protocol_id"]),
    "product_protocols": (_product_protocols, {"product_id": str}, ["product_id"]),
    "product_detail": (_product_detail, {"product_id": str}, ["product_id"]),
    "protocols_by_material": (_protocols_by_material, {"material": str, "limit": int}, ["material"]),
    "flag_sourcing_request": (_flag_sourcing_request, {"item": str, "context": str, "email": str}, ["item"]),
}


def dispatch(spark: SparkSession, catalog: Catalog, name: str, args: dict, context: dict | None = None) -> Answer:
    """A tool's rows and the items they refer to; what goes wrong comes back as one row with ``error``.

    ``context`` says who asks and when (``shop, customer_id, stamp``); arguments can't.
    """
    try:
        if name not in TOOLS:
            raise KeyError(f"unknown tool {name!r}")
        run, kinds, needed = TOOLS[name]
        for key in needed:
            if key not in args:
                raise ValueError(f"{name} needs {key}")
        for key, value in args.items():
            if key not in kinds or not isinstance(value, kinds[key]):
                raise ValueError(f"{name} takes no {key} of this kind")
        return run(catalog, args, context or {})
    except Exception as e:  # an assistant can go on from an error
        said = e.args[0] if isinstance(e, (LookupError, ValueError)) and e.args else f"{type(e).__name__}: {e}"
        return spark.createDataFrame([(str(said),)], "error string"), spark.createDataFrame([], ITEMS)
