"""Registered queries of reads, references and signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procurespark import schemas
from procurespark.functions import signatures, text, vectors
from procurespark.operators import conformance, reads, tools
from procurespark.operators import tables as snapshots
from procurespark.plans.queries import LANDED_SQL, LINKS_SQL, OFFERS_SQL, PRODUCTS_SQL, PROTOCOLS_SQL
from procurespark.plans.registry import query
from procurespark.plans.tables import dealt, links, offers, products, protocols, table


def nothing() -> Column:
    return F.lit(None).cast("string")


@query("q_landed_quantity", f"WITH {PRODUCTS_SQL}, {OFFERS_SQL}, {LANDED_SQL} SELECT id, 7 AS qty, round(works + tariff + 1.5 + margin, 4) AS unit_price, round((works + tariff + 1.5 + margin) * 7, 4) AS line_total FROM landed")
def landed_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What seven of each product cost from its cheapest offer."""
    found = reads.landed_for(products(spark, sf_dir), offers(spark, sf_dir), 7)
    return found.select("id", F.lit(7).alias("qty"), "landed.unit_price", "landed.line_total")


@query("q_products_page_ranked", f"WITH {PRODUCTS_SQL}, {OFFERS_SQL}, {LANDED_SQL} SELECT row_number() OVER (ORDER BY category, id DESC) AS rank, id, name, offer_count, round(works + tariff + 1.5 + margin, 4) AS best_landed FROM landed ORDER BY category, id DESC LIMIT 50 OFFSET 50")
def products_page_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 50 with each row's place, which shows that joins leave the page's order alone; the page is the feature."""
    page = reads.list_products(products(spark, sf_dir), offers(spark, sf_dir), page=2, page_size=50, order=[F.col("category"), F.col("id").desc()])
    placed = page.coalesce(1).withColumn("rank", F.monotonically_increasing_id() + 51)
    return placed.select("rank", "id", "name", "offer_count", "best_landed")


@query("q_public_specs", f"WITH {PRODUCTS_SQL} SELECT id, 'line=' || line || ',size=' || size AS specs FROM products")
def public_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs without the internal ones, which begin with an underscore."""
    held = products(spark, sf_dir).select("id", F.map_concat("specs", F.create_map(F.lit("_cost_basis"), F.lit("x"), F.lit("_"), F.lit("y"))).alias("specs"))
    shown = F.transform(F.array_sort(F.map_entries(text.public_specs(F.col("specs")))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return held.select("id", F.array_join(shown, ",").alias("specs"))


@query("q_protocol_label", f"WITH {PROTOCOLS_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN title ELSE title || ' (' || author || ')' END AS label FROM protocols")
def protocol_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles told apart by their first author, where there is one."""
    author = F.when(F.col("id") % 3 == 0, "").otherwise(F.get("authors", F.lit(0)))
    return protocols(spark, sf_dir).select("id", text.protocol_label(F.col("title"), author).alias("label"))


@query("q_with_urls", f"""WITH {PRODUCTS_SQL}, {PROTOCOLS_SQL} SELECT 'product' AS type, id, '/search?q=' || replace(name, ' ', '%20') || '%20~%2A' AS url FROM products
    UNION ALL SELECT 'protocol', id, CASE WHEN id % 2 = 0 THEN source_uri END FROM protocols""")
def with_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where references to products and protocols lead."""
    held = protocols(spark, sf_dir).withColumn("source_uri", F.when(F.col("id") % 2 == 0, F.col("source_uri")).otherwise(""))
    items = products(spark, sf_dir).select(F.lit("product").alias("type"), "id", F.concat("name", F.lit(" ~*")).alias("label")).unionByName(held.select(F.lit("protocol").alias("type"), "id", F.col("title").alias("label")))
    return reads.with_urls(items, held).select("type", "id", "url")


@query("q_references", "SELECT event_type AS type, user_id AS id, min_by('e' || event_id, event_id) AS label, min(event_id) AS position FROM events GROUP BY ALL")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as references to users: each type and user once, as first named."""
    items = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.col("user_id").alias("id"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("label"), F.col("event_id").alias("position"))
    return reads.ordered_references(items)


@query("q_exists", "SELECT o_custkey AS id, o_custkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer) AS is_there FROM (SELECT DISTINCT o_custkey FROM orders)")
def exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ids that orders name are there among even customers."""
    known = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 2 == 0).select(F.col("c_custkey").alias("id"))
    return reads.exists(known, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct()).withColumnRenamed("exists", "is_there")


@query("q_by_material_blank", "SELECT o_orderkey AS id, NULL::VARCHAR AS title FROM orders WHERE false")
def by_material_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term of separators alone finds nothing."""
    held = protocols(spark, sf_dir).withColumn("materials", F.array(F.struct(F.lit("any").alias("name"))))
    return reads.protocols_by_material(held, links(spark, sf_dir), " -/ 　", 100).select("id", "title")


@query("q_sourcing_requests", """WITH r AS (SELECT 'e' || event_id AS id, event_type AS requested_item, ts FROM events UNION ALL SELECT 'new', 'a rare enzyme', TIMESTAMP '2100-01-01')
    SELECT CASE WHEN id = 'new' THEN 'new' ELSE id END AS id, requested_item, CASE WHEN id = 'new' THEN 'shop-1' END AS shop, 'new' AS status, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS created_at FROM r ORDER BY ts DESC, id LIMIT 200""")
def sourcing_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request added to those that events stand for, and the newest 200 read back; the limit is the feature."""
    made = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("requested_item"), F.col("ts").alias("created_at"))
    held = schemas.conformed(made.withColumn("status", F.lit("new")), schemas.SOURCING_REQUESTS)
    grown = snapshots.append_sourcing_request(held, "a rare enzyme", None, "2100-01-01T00:00:00Z", shop="shop-1")
    shown = reads.sourcing_requests(grown, 200)
    return shown.select(F.when(F.col("id").startswith("e") & F.col("shop").isNull(), F.col("id")).otherwise("new").alias("id"), "requested_item", "shop", "status", "created_at")


def _catalog(spark: SparkSession, sf_dir: str) -> tools.Catalog:
    sold = offers(spark, sf_dir).withColumns({"supplier_sku": F.col("id").cast("string"), "pack_size": nothing(), "stock": nothing().cast("int"), "lead_time_days": nothing().cast("int")})
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("CN").alias("region"))
    edges = products(spark, sf_dir).select((F.col("id") - 1).alias("product_id"), F.col("id").alias("equivalent_id"), F.lit(0.9).alias("confidence"), F.lit("substitute").alias("kind"))
    held = products(spark, sf_dir).withColumn("created_at", F.timestamp_seconds("id"))
    return tools.Catalog(held, sold, suppliers, edges, protocols(spark, sf_dir), links(spark, sf_dir), spark.createDataFrame([], schemas.SOURCING_REQUESTS))


@query("q_tool_search_products", f"WITH {PRODUCTS_SQL}, {OFFERS_SQL}, {LANDED_SQL} SELECT id, 'ASR-' || upper(left(id::VARCHAR, 6)) AS product_sku, name, category, offer_count, round(works + tariff + 1.5 + margin, 4) AS best_landed FROM landed WHERE name ILIKE '%bolt%' ORDER BY id DESC LIMIT 8")
def tool_search_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An assistant's search, as a buyer sees it; its limit of eight is the feature."""
    return tools.dispatch(spark, _catalog(spark, sf_dir), "search_products", {"query": "bolt"})[0]


@query("q_tool_references", f"""WITH {PRODUCTS_SQL}, {LINKS_SQL}, {PROTOCOLS_SQL}, best AS (SELECT product_id, row_number() OVER (ORDER BY confidence DESC, product_id, material_name) AS rank FROM links WHERE protocol_id = 1 QUALIFY rank <= 50)
    SELECT 'protocol' AS type, '1' AS id, title AS label, 0 AS position FROM protocols WHERE id = 1 UNION ALL SELECT 'product', p.id::VARCHAR, p.name, b.rank FROM best b JOIN products p ON b.product_id = p.id""")
def tool_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an assistant's look at one protocol's shopping list refers to."""
    return tools.dispatch(spark, _catalog(spark, sf_dir), "protocol_products", {"protocol_id": "1"})[1]


@query("q_tool_error", "SELECT 'product not found' AS error UNION ALL SELECT 'unknown tool ''nothing''' UNION ALL SELECT 'search_products needs query'")
def tool_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of an assistant's reads are data."""
    held = _catalog(spark, sf_dir)
    asked = [("product_detail", {"product_id": "none"}), ("nothing", {}), ("search_products", {})]
    found = [tools.dispatch(spark, held, name, args)[0] for name, args in asked]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("q_signatures", """WITH m AS (SELECT event_id, 'event=' || event_type || 'ids=' || event_id || ',' || user_id || 'shop=s' AS message FROM events),
    inside AS (SELECT event_id, message, unhex(sha256(unhex('""" + bytes(b ^ 0x36 for b in b"key".ljust(64, b"\0")).hex() + """') || encode(message))) AS h FROM m)
    SELECT event_id, message, sha256(unhex('""" + bytes(b ^ 0x5C for b in b"key".ljust(64, b"\0")).hex() + """') || h) AS signature, event_id % 2 = 0 AS valid FROM inside""")
def signed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters, one of them twice, with a signature that holds for every second row."""
    part = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    items = F.array(part("shop", F.lit("s")), part("ids", F.col("event_id")), part("event", F.col("event_type")), part("ids", F.col("user_id")))
    made = table(spark, sf_dir, "events").select("event_id", items.alias("items")).withColumn("message", signatures.signed_message(F.col("items")))
    made = made.withColumn("signature", signatures.hmac_sha256(F.col("message"), "key"))
    given = F.when(F.col("event_id") % 2 == 0, F.col("signature")).otherwise(F.reverse("signature"))
    carried = F.concat("items", F.array(F.struct(F.lit("signature").alias("key"), given.alias("value"))))
    return made.select("event_id", "message", "signature", signatures.valid_signature(carried, "key").alias("valid"))


@query("q_leak_scan", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'cost,supplier_sku' WHEN 1 THEN '' WHEN 2 THEN 'cost' ELSE 'cost,tier' END AS leaked, p_partkey % 5 IN (1, 2, 3) AS is_foreign FROM part")
def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forbidden keys at any depth of payloads made of parts, escaped ones and beside long strings too, and traces of the commerce service."""
    k = F.col("p_partkey")
    inner = (
        F.when(k % 4 == 0, F.lit('{"offers": [{"cost": 1, "supplier_sku": "cost\\": x"}]}')).when(k % 4 == 1, F.lit('{"note": "the \\"cost\\": none", "x\\\\": ["cost"]}'))
        .when(k % 4 == 2, F.lit('{"a": {"b": [[{"cost" : null}]]}}')).otherwise(F.lit('{"c\\u006fst": 1, "a\\\\\\"": [{"ti\\u0065r": "\\\\"}]}'))
    )
    outer = (
        F.when(k % 5 == 1, F.lit('{"shopify_id": 1}')).when(k % 5 == 2, F.lit('["gid://shopify/Product/1"]')).when(k % 5 == 3, F.lit('["gid:\\/\\/shopify\\/Product\\/1"]')).otherwise(F.lit('{"text": "shopify_id"}'))
    )
    long = F.when(k % 10 == 0, F.repeat(F.lit('\\"cost\\": \\n '), 2000)).otherwise("")
    payload = F.concat(F.lit('{"name": '), F.to_json(F.struct("p_name")), F.lit(', "long": "'), long, F.lit('", "inner": '), inner, F.lit(', "outer": '), outer, F.lit("}"))
    made = dealt(table(spark, sf_dir, "part")).select(k.alias("id"), payload.alias("payload"))
    return made.select("id", F.array_join(conformance.leaked_keys(F.col("payload"), ["supplier_sku", "cost", "tier"]), ",").alias("leaked"), conformance.is_foreign(F.col("payload")).alias("is_foreign"))


@query("q_cosine", "SELECT a.vec_id AS id, round(coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 UNION ALL SELECT -1, 0.0")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the next, and a zero vector."""
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("a"))
    pairs = held.join(held.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")
    zero = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.array(F.lit(0.0), F.lit(0.0)).alias("a"), F.array(F.lit(1.0), F.lit(2.0)).alias("b"))
    return pairs.select("id", F.round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("similarity")).unionByName(zero.select("id", F.round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("similarity")))


@query("q_white_space", "SELECT p_partkey AS id, p_name AS stripped, lower(p_type) || ' ' || p_name AS material, 2 + len(string_split(p_name, ' ')) AS n_tokens FROM part")
def white_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of white space counts as such, ideographic and no-break spaces too."""
    name, kind = F.col("p_name"), F.col("p_type")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), text.strip(F.concat(F.lit("　 \t"), name, F.lit(" \x1c "))).alias("stripped"),
        text.normalize_material(F.concat(F.lit("　"), kind, F.lit("　- /"), name)).alias("material"),
        F.size(vectors.tokens(F.concat(F.lit("a　b "), name))).cast("long").alias("n_tokens"),
    )
