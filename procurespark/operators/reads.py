"""Reads of the catalog: lists, details, links, reverse search, statistics, role views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procurespark.functions.scoring import landed_cost
from procurespark.functions.text import filled, normalize_material, percent_encoded, product_sku

#: What a buyer may see, by kind of record; anything new stays hidden.
BUYER_COLUMNS = {
    "product": ["id", "product_sku", "name", "category", "offer_count", "best_landed"],
    "detail": ["id", "product_sku", "name", "category", "specs", "equivalents"],
    "equivalent": ["id", "product_sku", "name", "confidence", "kind"],
    "landed": ["currency", "qty", "unit_price", "line_total"],
}


def bounded(value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{value} is not between {low} and {high}")
    return value


def is_buyer(role: str | None) -> bool:
    """Anything but buyer is staff."""
    return (role or "").strip().lower() == "buyer"


def role_view(df: DataFrame, kind: str, role: str | None) -> DataFrame:
    """The columns that a role may see; nested equivalents too."""
    if not is_buyer(role):
        return df
    seen = df.select(*(F.col(c) for c in BUYER_COLUMNS[kind] if c in df.columns))
    if kind == "detail" and "equivalents" in seen.columns:
        kept = BUYER_COLUMNS["equivalent"]
        seen = seen.withColumn("equivalents", F.transform("equivalents", lambda e: F.struct(*(e[c].alias(c) for c in kept))))
    return seen


def offer_summary(products: DataFrame, offers: DataFrame) -> DataFrame:
    """Products with ``offer_count`` (0 without offers), ``cheapest`` (by cost, then offer id) and its ``landed`` cost."""
    best = offers.groupBy("product_id").agg(F.count("*").alias("n"), F.min_by(F.struct("cost", "currency", F.col("id").alias("offer_id")), F.struct("cost", F.col("id"))).alias("cheapest"))
    met = products.join(best, products["id"] == best["product_id"], "left").drop("product_id")
    landed = F.when(F.col("cheapest").isNotNull(), landed_cost(F.col("cheapest.cost"), F.col("cheapest.currency"), F.col("category")))
    return met.withColumn("offer_count", F.coalesce("n", F.lit(0))).withColumn("landed", landed).drop("n")


def matching(df: DataFrame, term: str | None, columns: list[str], literal: bool = False) -> DataFrame:
    """Rows with the term in one of the columns, case aside; % and _ are wildcards unless ``literal``."""
    if not term:
        return df
    test = (lambda c: F.contains(F.lower(c), F.lit(term.lower()))) if literal else (lambda c: F.col(c).ilike(f"%{term}%"))
    found = test(columns[0])
    for c in columns[1:]:
        found = found | test(c)
    return df.filter(found)


def page_of(df: DataFrame, order: list[Column], page: int = 1, page_size: int = 20) -> DataFrame:
    bounded(page, 1, 1 << 31), bounded(page_size, 1, 100)
    return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def in_order(page: DataFrame, order: list[Column], positions: bool) -> DataFrame:
    """A page in its order again, which joins don't keep; with ``positions``, the place of each row from 0 (a page is one task's)."""
    return page.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1).orderBy("position") if positions else page.orderBy(*order)


def product_summary(summary: DataFrame) -> DataFrame:
    """The list's columns; a product has no region, its offers do."""
    return summary.select("id", product_sku(F.col("id").cast("string")).alias("product_sku"), "name", "category", "brand", "mpn", F.lit(None).cast("string").alias("region"), "offer_count", F.col("landed.unit_price").alias("best_landed"), *(["position"] if "position" in summary.columns else []))


def list_products(products: DataFrame, offers: DataFrame, q: str | None = None, category: str | None = None, page: int = 1, page_size: int = 20, order: list[Column] | None = None, positions: bool = False) -> DataFrame:
    """A page of products, newest first; only the page's offers are joined."""
    found = matching(products, q, ["name", "brand", "mpn"])
    found = found.filter(F.col("category") == category) if category else found
    order = order or [F.col("created_at").desc(), F.col("id")]
    paged = page_of(found, order, page, page_size)
    summed = offer_summary(paged, offers.join(paged.select(F.col("id").alias("product_id")), "product_id", "left_semi"))
    return product_summary(in_order(summed, order, positions))


def product_detail(products: DataFrame, offers: DataFrame, suppliers: DataFrame, edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Products (only those of ``ids``, if given) with their offers (by SKU) and equivalents (by confidence), nested."""
    if ids is not None:
        offers, edges = (df.join(ids.select(F.col("id").alias("product_id")), "product_id", "left_semi") for df in (offers, edges))
    named = suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier"), "region")
    own = offers.join(named, "supplier_id").groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("supplier_sku", "supplier", "region", "pack_size", F.col("cost").cast("double").alias("cost"), "currency", "stock", "lead_time_days"))).alias("offers"))
    other = products.select(F.col("id").alias("equivalent_id"), F.col("name").alias("_name"), F.col("brand").alias("_brand"))
    item = F.struct((-F.col("confidence")).alias("_order"), F.col("equivalent_id").alias("id"), product_sku(F.col("equivalent_id").cast("string")).alias("product_sku"), F.col("_name").alias("name"), F.col("_brand").alias("brand"), F.round("confidence", 4).alias("confidence"), "kind")
    alike = edges.join(other, "equivalent_id").groupBy("product_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda e: e.dropFields("_order")).alias("equivalents"))
    wanted = products if ids is None else products.join(ids.select("id"), "id", "left_semi")
    base = wanted.select("id", product_sku(F.col("id").cast("string")).alias("product_sku"), "name", "category", "brand", "mpn", F.coalesce("specs", F.create_map().cast("map<string,string>")).alias("specs"))
    return base.join(own.withColumnRenamed("product_id", "id"), "id", "left").join(alike.withColumnRenamed("product_id", "id"), "id", "left")


def with_links(df: DataFrame, links: DataFrame) -> DataFrame:
    """Protocols with ``product_count``, the number of their links."""
    counted = links.groupBy(F.col("protocol_id").alias("_protocol")).agg(F.count("*").alias("_n"))
    return df.join(counted, df["id"] == counted["_protocol"], "left").withColumn("product_count", F.coalesce("_n", F.lit(0))).drop("_protocol", "_n")


def list_protocols(protocols: DataFrame, links: DataFrame, q: str | None = None, page: int = 1, page_size: int = 20, positions: bool = False) -> DataFrame:
    """A page of servable protocols, most links first, then by rank."""
    found = with_links(matching(protocols.filter("servable"), q, ["title"]), links)
    order = [F.col("product_count").desc(), F.col("rank_score").desc(), F.col("id")]
    paged = in_order(page_of(found, order, page, page_size), order, positions)
    return paged.select(*(["position"] if positions else []), "id", "title", "source", F.round("rank_score", 2).alias("rank_score"), "product_count", F.get("authors", F.lit(0)).alias("first_author"))


def protocols_by_material(protocols: DataFrame, links: DataFrame, material: str, limit: int = 10, positions: bool = False) -> DataFrame:
    """Servable protocols with a material that holds the term, by rank, then links; ``total`` counts all of them.

    A blank term finds nothing.
    """
    bounded(limit, 1, 200)
    term = normalize_material(F.lit(material))
    hit = F.filter("materials", lambda m: F.contains(normalize_material(m["name"]), term))
    found = protocols.filter("servable").filter(term != "").withColumn("_hit", hit).filter(F.size("_hit") > 0)
    total = found.agg(F.count("*").alias("total"))
    order = [F.col("rank_score").desc(), F.col("product_count").desc(), F.col("id")]
    ranked = with_links(found, links).orderBy(*order).limit(limit)
    return in_order(ranked.crossJoin(F.broadcast(total)), order, positions).select(*(["position"] if positions else []), "id", "title", "product_count", F.coalesce(F.get("_hit", F.lit(0))["name"], F.lit("")).alias("matched_material"), "total")  # a page and one row


def best_links(links: DataFrame, key: str, other: str, reviewed_only: bool, limit: int) -> DataFrame:
    """The ``limit`` surest links of each ``key`` with their ``rank``; each task keeps its best before the shuffle."""
    seen = links.filter("reviewed") if reviewed_only else links
    order = Window.partitionBy(key).orderBy(F.col("confidence").desc(), other, "material_name")
    return seen.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).withColumn("confidence", F.round("confidence", 4))


def product_protocols(products: DataFrame, links: DataFrame, protocols: DataFrame, reviewed_only: bool = False, limit: int = 50) -> DataFrame:
    """Each of ``products`` with the protocols that use it, surest first: a row for each of at most ``limit`` links.

    A product without links has one row of nulls, so that it differs from an id that isn't there.
    """
    best = best_links(links, "product_id", "protocol_id", reviewed_only, bounded(limit, 1, 200))
    named = best.join(protocols.select(F.col("id").alias("protocol_id"), "title", "source_uri"), "protocol_id")
    base = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    return base.join(named, "product_id", "left").select("product_id", "product_name", "rank", "protocol_id", "title", "source_uri", "material_name", "confidence", "kind").orderBy("product_id", "rank")


def protocol_materials(protocols: DataFrame, links: DataFrame, products: DataFrame, reviewed_only: bool = False, limit: int = 100) -> DataFrame:
    """Each of ``protocols`` with its shopping list, surest first: a row for each of at most ``limit`` links, or one of nulls."""
    best = best_links(links, "protocol_id", "product_id", reviewed_only, bounded(limit, 1, 300))
    named = best.join(products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), "brand"), "product_id")
    base = protocols.select(F.col("id").alias("protocol_id"), F.col("title").alias("protocol_title"), "source_uri")
    return base.join(named, "protocol_id", "left").select("protocol_id", "protocol_title", "source_uri", "rank", "material_name", "product_id", "product_name", "brand", "confidence", "kind").orderBy("protocol_id", "rank")


def landed_for(products: DataFrame, offers: DataFrame, qty: int) -> DataFrame:
    """``id, landed``: the landed cost of ``qty`` of each product from its cheapest offer, null without one."""
    bounded(qty, 1, 1 << 31)
    found = offer_summary(products, offers)
    cost = landed_cost(F.col("cheapest.cost"), F.col("cheapest.currency"), F.col("category"), qty)
    return found.select("id", F.when(F.col("cheapest").isNotNull(), cost).alias("landed"))


def exists(df: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` with ``exists``, so that unknown and empty can be told apart."""
    known = df.select("id").withColumn("_known", F.lit(True))
    return ids.join(known, "id", "left").select(*ids.columns, F.coalesce("_known", F.lit(False)).alias("exists"))


def stats(products: DataFrame, offers: DataFrame, suppliers: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts; savings are not known and 0."""
    parts = [df.agg(F.count("*").alias(n)) for n, df in (("products", products), ("offers", offers), ("suppliers", suppliers))]
    kinds = edges.agg(F.count_if(F.col("kind") == "exact").alias("exact"), F.count_if(F.col("kind") == "substitute").alias("substitute"))
    out = parts[0].crossJoin(parts[1]).crossJoin(parts[2]).crossJoin(kinds)  # one row each
    return out.select("products", "offers", "suppliers", "exact", "substitute", (F.col("exact") + F.col("substitute")).alias("total"), F.lit(0.0).alias("avg_savings"))


def sourcing_requests(requests: DataFrame, limit: int = 50) -> DataFrame:
    """The newest requests, their time in ISO form."""
    shown = requests.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    return shown.orderBy(F.col("created_at").desc(), F.col("id")).limit(bounded(limit, 1, 200))


def ordered_references(items: DataFrame, position: str = "position") -> DataFrame:
    """Referenced items (type, id, label) once each, the first of repeated ones, in the order they came up."""
    first = items.groupBy("type", "id").agg(F.min_by(F.struct("label", F.col(position).alias("at")), position).alias("_first"))
    return first.select("type", "id", "_first.label", F.col("_first.at").alias("position")).orderBy("position")


def with_urls(items: DataFrame, protocols: DataFrame) -> DataFrame:
    """Referenced items (type, id, label) with where to go: a search for products, the source for protocols."""
    uris = protocols.select(F.col("id").alias("_id"), filled(F.col("source_uri")).alias("_uri"))
    met = items.join(uris, (F.col("type") == "protocol") & (F.col("id") == F.col("_id")), "left")
    url = F.when(F.col("type") == "product", F.concat(F.lit("/search?q="), percent_encoded(F.col("label")))).otherwise(F.col("_uri"))
    return met.withColumn("url", url).drop("_id", "_uri")
