"""Schemas of tables and of what moves between pipeline steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EXTRACTED_PRODUCT = (
    "supplier_sku string, name string, category string, brand string, mpn string, pack_size string, cost double, currency string, stock int, lead_time_days int, specs map<string,string>"
)
REVIEW = "struct<citations:bigint,rating:double,ratings_count:bigint,views:bigint,votes:bigint,bookmarks:bigint,forks:bigint,comments:bigint,peer_reviewed:boolean>"
STEPS = "array<struct<number:int,text:string>>"
MATERIALS = "array<struct<name:string,amount:string,vendor:string,catalog_no:string>>"
RAW_PROTOCOL = f"source string, source_id string, source_uri string, title string, authors array<string>, doi string, version string, license string, steps {STEPS}, materials {MATERIALS}, review {REVIEW}, fetched_at string"

SUPPLIERS = "id string, name string, region string, tier string, verified boolean"
PRODUCTS = "id string, category string, name string, brand string, mpn string, specs map<string,string>, embedding array<double>, embedding_model string, embedding_text_hash string"
OFFERS = "id string, supplier_id string, product_id string, supplier_sku string, pack_size string, cost decimal(12,4), currency string, stock int, lead_time_days int"
EQUIVALENCES = "product_id string, equivalent_id string, confidence double, kind string, method string, reviewed boolean"
PROTOCOLS = f"id string, source string, source_id string, source_uri string, title string, authors array<string>, doi string, version string, license string, servable boolean, serving_basis string, steps {STEPS}, materials {MATERIALS}, review {REVIEW}, rank_score double, fetched_at timestamp"
LINKS = "protocol_id string, product_id string, material_name string, confidence double, kind string, method string, reviewed boolean"
SOURCING_REQUESTS = "id string, requested_item string, context string, shop string, customer_id string, email string, status string, created_at timestamp"
CUSTOMERS = "id string, tenant_id string, name string"
ORDERS = "id string, tenant_id string, customer_id string, status string, idempotency_key string"
ORDER_LINES = "id string, order_id string, product_id string, qty int, landed_cost struct<currency:string,qty:int,ex_works:double,tariff:double,duty_rate:double,freight:double,margin:double,unit_price:double,line_total:double>"
UPSTREAM_POS = "id string, supplier_id string, status string"
UPSTREAM_PO_LINES = "id string, po_id string, supplier_offer_id string, order_line_id string, qty int, cost decimal(12,4)"
SUBSTITUTIONS = "id string, order_line_id string, proposed_product_id string, reason string, status string"

#: Natural keys, none of whose rows may repeat unless a part is null.
UNIQUE_KEYS = {
    "suppliers": [["name"]],
    "products": [["brand", "mpn"]],
    "offers": [["supplier_id", "supplier_sku"]],
    "equivalences": [["product_id", "equivalent_id"]],
    "protocols": [["source", "source_id"], ["doi"]],
    "links": [["protocol_id", "product_id", "material_name"]],
    "orders": [["tenant_id", "idempotency_key"]],
}
TIERS = ["public", "authorized", "deep"]
KINDS = ["exact", "substitute"]


def known_tier(tier: str) -> None:
    """Refuses a tier that there isn't."""
    if tier not in TIERS:
        raise ValueError(f"{tier!r} is none of {', '.join(TIERS)}")


def conformed(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the columns of ``schema``: missing ones null, others dropped, types cast."""
    wanted = StructType.fromDDL(schema)
    return df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))
