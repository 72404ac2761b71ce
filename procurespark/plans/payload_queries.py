"""Registered queries of protocol payloads, connectors, harvests, conformance and events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procurespark import schemas
from procurespark.functions import text, vectors
from procurespark.operators import conformance, matching
from procurespark.operators import harvest as harvests
from procurespark.operators import protocols as corpus
from procurespark.operators.snapshots import Store
from procurespark.plans.registry import query
from procurespark.plans.queries import LINKS_SQL
from procurespark.plans.tables import links, protocols, table
from procurespark.sources import connectors, paging
from procurespark.sources import protocols as payloads
from procurespark.sources.commerce import api_host
from procurespark.storage import checkpointed, new_path
from procurespark.streaming import events as flow


def nothing() -> Column:
    return F.lit(None).cast("string")


def order_text() -> Column:
    return F.col("o_orderkey").cast("string")


def order_key() -> Column:
    return F.col("o_orderkey")


def _detail_json():
    """An order as a detail payload, with every polymorphic shape somewhere; every eleventh is broken JSON."""
    blocks = F.concat(F.lit('{"blocks":[{"text":"Mix '), order_text(), F.lit('"},{"text":" "},{"text":"Wait"}]}'))
    steps = F.array(F.struct(blocks.alias("step"), nothing().alias("section")), F.struct(F.lit("").alias("step"), nothing().alias("section")), F.struct(nothing().alias("step"), F.concat(F.lit("<b>Wash &amp; "), F.col("o_orderstatus"), F.lit("</b>")).alias("section")))
    author = lambda first, last, name, user: F.struct(*(v.alias(n) for n, v in (("first_name", first), ("last_name", last), ("name", name), ("username", user))))
    authors = F.when(order_key() % 3 != 0, F.array(author(F.lit("Ann"), order_text(), nothing(), nothing()), author(nothing(), nothing(), nothing(), nothing()), author(nothing(), nothing(), F.lit("Bo"), F.lit("u"))))
    vendor_text, vendor_object = F.lit("Acme"), F.struct(F.lit("Nested").alias("name"))
    common = [
        order_key().alias("id"), F.concat(F.lit("uri-"), order_text()).alias("uri"), F.when(order_key() % 2 == 0, F.concat(F.lit("https://p.example/"), order_text())).alias("url"), F.concat(F.lit("<i>Title "), order_text(), F.lit("</i>")).alias("title"),
        F.when(order_key() % 4 != 0, F.concat(F.lit("HTTPS://doi.org/10.1/"), order_text(), F.lit("/v2"))).alias("doi"), (order_key() % 5).alias("version_id"), authors.alias("authors"), F.struct(F.lit("creator").alias("username")).alias("creator"), steps.alias("steps"),
        F.when(order_key() % 2 == 1, F.concat(F.lit('{"blocks":[{"text":"Gel"},{"text":"Kit '), order_text(), F.lit('"}]}'))).alias("materials_text"),
        F.struct(
            F.col("o_custkey").alias("number_of_views"), (order_key() % 3).alias("number_of_votes"), F.when(order_key() % 2 == 0, F.lit(4)).alias("number_of_bookmarks"), F.struct(F.lit(1).alias("private"), (order_key() % 4).alias("public"), F.lit("x").alias("note")).alias("number_of_forks"),
            (order_key() % 2).alias("number_of_protocol_comments"), F.lit(9).alias("number_of_comments"),
        ).alias("stats"),
    ]
    item = lambda vendor: F.when(order_key() % 2 == 0, F.array(F.struct(F.lit(" Buffer ").alias("name"), vendor.alias("vendor"), F.lit("").alias("catalog"), order_text().alias("sku"), F.lit("1 ml").alias("quantity"))))
    shaped = lambda vendor, license_of: F.to_json(F.struct(*common, item(vendor).alias("materials"), license_of.alias("license")))
    whole = F.when(order_key() % 4 == 0, shaped(vendor_object, F.struct(F.lit("CC BY").alias("title")))).otherwise(shaped(vendor_text, F.lit("cc0")))
    return F.when(order_key() % 11 == 0, "{broken").otherwise(whole)


DETAIL_SQL = """details AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS source_id, CASE WHEN o_orderkey % 2 = 0 THEN 'https://p.example/' || o_orderkey ELSE 'https://www.protocols.io/view/uri-' || o_orderkey END AS source_uri, 'Title ' || o_orderkey AS title,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'Ann ' || o_orderkey || ',Bo' ELSE 'creator' END AS authors, CASE WHEN o_orderkey % 4 <> 0 THEN '10.1/' || o_orderkey END AS doi, (o_orderkey % 5)::VARCHAR AS version, CASE WHEN o_orderkey % 4 = 0 THEN 'CC-BY' ELSE 'CC0' END AS license,
    '1:Mix ' || o_orderkey || chr(10) || 'Wait;3:Wash & ' || o_orderstatus AS steps, CASE WHEN o_orderkey % 2 = 0 THEN 'Buffer|1 ml|' || CASE WHEN o_orderkey % 4 = 0 THEN 'Nested' ELSE 'Acme' END || '|' || o_orderkey ELSE 'Gel;Kit ' || o_orderkey END AS materials,
    o_custkey AS views, CASE WHEN o_orderkey % 2 = 0 THEN 4 END AS bookmarks, 1 + o_orderkey % 4 AS forks, CASE WHEN o_orderkey % 2 = 1 THEN 1 ELSE 9 END AS comments, CASE WHEN o_orderkey % 7 < 3 THEN o_orderkey % 7 = 1 END AS peer_reviewed
    FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey <> 0)"""


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = table(spark, sf_dir, "orders")
    items = order.filter(order_key() % 7 < 3).select(F.to_json(F.struct(order_key().alias("id"), (order_key() % 7 == 1).cast("int").alias("peer_reviewed"))).alias("payload"), order_key().alias("position"))
    old = order.filter(order_key() % 7 < 3).select(F.to_json(F.struct(order_key().alias("id"), F.lit(1).alias("peer_reviewed"))).alias("payload"), (-order_key() - 1).alias("position"))
    return payloads.map_protocol_service(order.select(_detail_json().alias("payload")), items.unionByName(old))


@query("q_protocol_payloads", f"WITH {DETAIL_SQL} SELECT * EXCLUDE (k) FROM details")
def protocol_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested payloads, mapped; the last search item of each id lends its review flag."""
    made = _mapped(spark, sf_dir).filter("source_id <> 'uri-0'")
    step = F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["number"].cast("string"), s["text"])), ";")
    material = F.array_join(F.transform("materials", lambda m: F.concat_ws("|", m["name"], m["amount"], m["vendor"], m["catalog_no"])), ";")
    return made.select("source_id", "source_uri", "title", F.array_join("authors", ",").alias("authors"), "doi", "version", "license", step.alias("steps"), material.alias("materials"), *(f"review.{c}" for c in ("views", "bookmarks", "forks", "comments", "peer_reviewed")))


@query("q_literature_payloads", """SELECT CASE WHEN o_orderkey % 3 <> 2 THEN 'A' || o_orderkey ELSE '' END AS source_id, CASE WHEN o_orderkey % 3 <> 2 THEN 'https://europepmc.org/article/' || CASE WHEN o_orderkey % 2 = 0 THEN 'PPR' ELSE 'MED' END || '/A' || o_orderkey ELSE 'https://doi.org/10.2/' || o_orderkey END AS source_uri,
    'On ' || o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'A B,C' ELSE 'D E,F G' END AS authors, '10.2/' || o_orderkey AS doi, CASE o_orderkey % 3 WHEN 0 THEN 'CC-BY-SA' WHEN 1 THEN 'unknown' ELSE 'CC0' END AS license, o_custkey AS citations, 0 AS n_steps FROM orders""")
def literature_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as article results, mapped."""
    person = lambda n: F.struct(F.lit(n).cast("string").alias("fullName"))
    listed = F.when(order_key() % 2 == 0, F.struct(F.array(person(" A B "), person(None), person("C")).alias("author")))
    own = F.concat(F.lit("A"), order_text())
    raw = F.struct(
        F.when(order_key() % 3 == 0, own).alias("id"), F.when(order_key() % 3 == 1, own).alias("pmcid"), F.when(order_key() % 2 == 0, F.lit("ppr")).alias("source"), F.concat(F.lit("On "), F.col("o_orderpriority"), F.lit(" .. ")).alias("title"),
        listed.alias("authorList"), F.lit("D E,F G,").alias("authorString"), F.concat(F.lit("10.2/"), order_text()).alias("doi"), F.when(order_key() % 3 == 0, "CC BY-SA").when(order_key() % 3 == 1, "odd").otherwise("cc0").alias("license"), F.col("o_custkey").alias("citedByCount"),
    )
    made = payloads.map_literature_service(table(spark, sf_dir, "orders").select(F.to_json(raw).alias("payload")))
    return made.select("source_id", "source_uri", F.rtrim("title").alias("title"), F.array_join("authors", ",").alias("authors"), "doi", "license", "review.citations", F.size("steps").cast("long").alias("n_steps"))


@query("q_author_names", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Ann ' || c_name WHEN 1 THEN c_name WHEN 2 THEN 'user' || c_custkey ELSE '' END AS name FROM customer")
def author_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's name from what a record gives of it."""
    k, name = F.col("c_custkey"), F.col("c_name")
    shown = text.author_name(F.when(k % 4 == 0, "Ann"), F.when(k % 4 == 0, name), F.when(k % 4 == 1, name), F.when(k % 4 == 2, F.concat(F.lit("user"), k.cast("string"))))
    return table(spark, sf_dir, "customer").select(k.alias("id"), shown.alias("name"))


@query("q_resource_ids", "SELECT p_partkey AS id, p_partkey::VARCHAR AS tail, p_name ILIKE '%bolt%' AS kit, 'shop.example.com' AS host FROM part")
def resource_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tails of resource ids, kits by their names, and a shop's host."""
    k = F.col("p_partkey")
    kit = text.looks_like_kit(F.replace(F.upper("p_name"), F.lit("BOLT"), F.lit("a KIT")))
    return table(spark, sf_dir, "part").select(k.alias("id"), text.gid_tail(F.concat(F.lit("gid://a/B/"), k.cast("string"))).alias("tail"), kit.alias("kit"), F.lit(api_host("https://shop/", ".example.com")).alias("host"))


@query("q_raw_store", "SELECT o_orderkey::VARCHAR AS id, '1' AS version, 'stored' AS state FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey::VARCHAR, CASE WHEN o_orderkey % 3 = 0 THEN '2' ELSE '1' END, 'missing' FROM orders")
def raw_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of all orders written to the raw store, twice, and what of newer versions it lacks."""
    root = new_path(spark, "raw")
    rows = table(spark, sf_dir, "orders").select(order_text().alias("id"), F.when(order_key() % 3 == 0, "2").otherwise("1").alias("version"), F.to_json(F.struct("o_orderkey")).alias("payload"))
    old = table(spark, sf_dir, "orders").filter(order_key() % 3 == 0).select(order_text().alias("id"), F.lit("1").alias("version"), F.to_json(F.struct("o_orderkey")).alias("payload"))
    for _ in range(2):
        payloads.write_details(old, root)
    held = payloads.read_details(spark, root)
    shown = lambda df, state: df.select("id", "version", F.lit(state).alias("state"))
    return shown(held, "stored").unionByName(shown(payloads.missing_details(rows, held), "missing"))


@query("q_search_pages_store", "SELECT 'elisa' AS category, o_orderpriority AS query, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 2")
def search_pages_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority as search pages in the store, read back in order."""
    root = new_path(spark, "raw")
    order = table(spark, sf_dir, "orders")
    for name in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"):
        items = order.filter(F.col("o_orderpriority") == name).select(order_key().alias("position"), F.to_json(F.struct(order_key().alias("id"), F.col("o_orderpriority").alias("q"))).alias("payload"))
        payloads.write_search_page(items, root, "elisa", name, 1)
    read = payloads.read_search_items(spark, root).select(F.from_json("payload", "id long, q string").alias("i"), "position")
    return read.groupBy(F.lit("elisa").alias("category"), F.col("i.q").alias("query")).agg(F.count("*").alias("n"), F.max_by("i.id", "position").alias("last"))


@query("q_category_seeds", "SELECT CASE WHEN n_nationkey = 3 THEN 'western_blot' ELSE 'c' || n_nationkey END AS category_id, CASE WHEN n_nationkey = 3 THEN 'western blot|immunoblot' WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'c' || n_nationkey END AS queries FROM nation WHERE n_nationkey <> 5")
def category_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as categories: known terms, else the name before a slash, else the id; none without an id."""
    k = F.col("n_nationkey")
    cid = F.when(k == 5, " ").when(k == 3, "western_blot").otherwise(F.concat(F.lit("c"), k.cast("string")))
    rows = table(spark, sf_dir, "nation").select(cid.alias("category_id"), F.when((k % 2 == 0) | (k == 3), F.concat("n_name", F.lit(" / other"))).otherwise(" ").alias("category_name"))
    return payloads.category_seeds(rows).select("category_id", F.array_join("queries", "|").alias("queries"))


def _stopped_and_resumed(spark: SparkSession, seeds: DataFrame, pages: paging.Pages, limit: int | None = None) -> DataFrame:
    """The items of a crawl that is stopped after a round and goes on from its store."""
    path = new_path(spark, "crawls")
    paging.crawl(Store(spark, path, paging.TABLES), seeds, pages, limit, rounds=1)
    paging.crawl(Store(spark, path, paging.TABLES), seeds, pages, limit)
    return Store(spark, path, paging.TABLES).read("items")


@query("q_paged_search", "SELECT o_orderpriority AS query, o_orderkey AS item, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS position FROM orders QUALIFY position < (SELECT count(*) // 8 FROM orders)")
def paged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as the results of a search for each priority, in numbered pages, got round by round up to the connector's limit; the crawl is stopped and goes on."""
    order = table(spark, sf_dir, "orders")
    n = order.count()
    size, limit = -(-n // 12), n // 8
    place = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey")) - 1
    item = F.struct(place.alias("place"), order_key().alias("id"))
    listed = order.select("o_orderpriority", item.alias("item")).withColumn("page", F.floor(F.col("item.place") / size) + 1)
    held = listed.groupBy(F.col("o_orderpriority").alias("query"), F.col("page").cast("string").alias("cursor")).agg(F.array_sort(F.collect_list("item")).alias("items"))
    body = F.to_json(F.struct("items", F.when(F.size("items") == size, (F.col("cursor").cast("int") + 1).cast("string")).alias("next")))
    held = checkpointed(held.select("query", "cursor", body.alias("body")))
    pages = lambda cursors: cursors.join(held, ["query", "cursor"], "left").withColumn("body", F.coalesce("body", F.lit('{"items": []}')))
    found = _stopped_and_resumed(spark, order.select(F.col("o_orderpriority").alias("query"), F.lit("1").alias("cursor")).distinct(), pages, limit)
    return found.select("query", F.get_json_object("payload", "$.id").cast("long").alias("item"), "position")


@query("q_commerce_paging", "SELECT 'P' || p_partkey AS product, 'P' || p_partkey || '-' || v AS variant, v AS position FROM part, range(0, 12) r(v) WHERE v < p_partkey % 12")
def commerce_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products in pages by cursor, each with up to eleven variants in pages of four below it; products and variants go on by their own cursors."""
    part = table(spark, sf_dir, "part")
    n = part.agg(F.max("p_partkey")).first()[0]
    size = -(-n // 3)

    def fetch(query: str, parent: str | None, cursor: str | None, wanted: int | None) -> dict:
        at = int(cursor or 0)
        if parent is None:  # products of this stretch of keys; their variants begin below them
            keys = range(at + 1, min(at + size, n) + 1)
            return {"items": [{"id": f"P{k}"} for k in keys], "next": str(at + size) if at + size < n else None, "children": [{"parent": f"P{k}", "cursor": "0"} for k in keys if k % 12]}
        own = range(at, min(at + 4, int(parent[1:]) % 12))
        return {"items": [{"id": f"{parent}-{v}"} for v in own], "next": str(at + 4)}

    seeds = spark.createDataFrame([("products", None)], "query string, cursor string")
    found = _stopped_and_resumed(spark, seeds, paging.fetched_by(fetch, payloads.Access(True, True, "token")))
    variants = found.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("product"), F.get_json_object("payload", "$.id").alias("variant"), "position")
    known = part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("product"))
    return variants.join(known, "product", "left_semi")


@query("q_cursor_search", "SELECT o_orderstatus AS query, o_orderkey AS item FROM orders")
def cursor_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as the results of a search for each status by cursor, which the last page repeats; the cursor is the last key seen."""
    order = table(spark, sf_dir, "orders")
    size = -(-order.count() // 9)
    number = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy("o_orderkey")) - 1
    listed = order.select(F.col("o_orderstatus").alias("query"), F.struct(order_key().alias("id")).alias("item"), F.floor(number / size).alias("page"))
    held = listed.groupBy("query", "page").agg(F.array_sort(F.collect_list("item")).alias("items"))
    before = Window.partitionBy("query").orderBy("page")
    last = F.element_at("items", -1)["id"].cast("string")
    held = held.select("query", F.coalesce(F.lag(last).over(before), F.lit("*")).alias("cursor"), "items", F.when(F.lead("page").over(before).isNull(), F.lag(last).over(before)).otherwise(last).alias("next"))
    held = checkpointed(held.select("query", "cursor", F.to_json(F.struct("items", "next")).alias("body")))
    pages = lambda cursors: cursors.join(held, ["query", "cursor"])
    found = _stopped_and_resumed(spark, order.select(F.col("o_orderstatus").alias("query"), F.lit("*").alias("cursor")).distinct(), pages)
    return found.select("query", F.get_json_object("payload", "$.id").cast("long").alias("item"))


@query("q_fetch_each", "SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS held, CASE o_orderkey % 3 WHEN 1 THEN 'LookupError: no record ' || o_orderkey WHEN 2 THEN 'TypeError: expected a record for ' || o_orderkey || ', got list' END AS error FROM orders")
def fetch_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders fetched one by one; a third isn't there and a third is no record."""

    def fetch(one: str) -> dict:
        if int(one) % 3 == 1:
            raise LookupError(f"no record {one}")
        return {"id": int(one)} if int(one) % 3 == 0 else []

    found = connectors.fetch_each(table(spark, sf_dir, "orders").select(order_text().alias("id")), fetch)
    return found.select("id", F.get_json_object("payload", "$.id").cast("long").alias("held"), "error")


@query("q_payload_keys", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'extra,o_custkey' ELSE 'o_custkey' END AS unmapped FROM orders")
def payload_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of payloads that a mapping leaves unused."""
    payload = F.to_json(F.struct(order_key(), "o_custkey", "o_orderstatus", F.when(order_key() % 2 == 0, F.lit("x")).alias("extra")))
    return table(spark, sf_dir, "orders").select(order_key().alias("id"), F.array_join(conformance.unmapped_keys(payload, ["o_orderkey", "o_orderstatus", "title"]), ",").alias("unmapped"))


def _raw_protocols(spark: SparkSession, sf_dir: str, position: str = "o_orderkey") -> DataFrame:
    """Orders as mapped protocols, of which customers share identifiers."""
    none = F.lit(None).cast("long")
    review = F.struct(F.col("o_custkey").alias("citations"), none.cast("double").alias("rating"), *(none.alias(c) for c in ("ratings_count", "views", "votes", "bookmarks", "forks", "comments")), F.lit(None).cast("boolean").alias("peer_reviewed"))
    license_of = F.when(order_key() % 3 == 0, "CC0").when(order_key() % 3 == 1, "unknown").otherwise("CC-BY-NC")
    steps = F.array(F.struct(F.lit(1).alias("number"), F.col("o_orderpriority").alias("text")))
    made = table(spark, sf_dir, "orders").select(
        F.lit("s").alias("source"), order_text().alias("source_id"), F.lit("https://x").alias("source_uri"), F.col("o_orderpriority").alias("title"), F.array(F.lit("A")).alias("authors"), F.when(F.col("o_custkey") % 5 == 0, F.concat(F.lit("10.1/"), F.col("o_custkey").cast("string"))).alias("doi"),
        F.lit("1").alias("version"), license_of.alias("license"), steps.alias("steps"), review.alias("review"), F.when(order_key() % 2 == 0, "2026-01-02T03:04:05Z").otherwise("soon").alias("fetched_at"), F.col(position).alias("position"),
    )
    return schemas.conformed(made, schemas.RAW_PROTOCOL + ", position long")


FIRST_SQL = "first AS (SELECT * FROM orders QUALIFY o_custkey % 5 <> 0 OR row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)"


@query("q_protocol_upsert", f"""WITH {FIRST_SQL} SELECT o_orderkey::VARCHAR AS source_id, CASE o_orderkey % 3 WHEN 0 THEN 'CC0' WHEN 1 THEN 'unknown' ELSE 'CC-BY-NC' END AS license, o_orderkey % 3 <> 2 AS servable, CASE WHEN o_orderkey % 3 = 1 THEN 'deal-1' END AS serving_basis,
    CASE WHEN o_orderkey % 3 <> 2 THEN 1 ELSE 0 END AS n_steps, round(10 * ln(1 + o_custkey::DOUBLE), 6) AS rank_score, CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '2026-01-02 03:04:05' END AS fetched_at FROM first""")
def protocol_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as protocols, stored twice under a contract: one row for each identifier, content only where it may be served."""
    new = _raw_protocols(spark, sf_dir)
    once = corpus.upsert_protocols(spark.createDataFrame([], schemas.PROTOCOLS), new, "deal-1")
    twice = corpus.upsert_protocols(once, new, "deal-1")
    return twice.select("source_id", "license", "servable", "serving_basis", F.size("steps").cast("long").alias("n_steps"), F.round("rank_score", 6).alias("rank_score"), F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"))


@query("q_upsert_counts", f"WITH {FIRST_SQL} SELECT count(*) FILTER (o_orderkey % 2 = 1) AS created, count(*) FILTER (o_orderkey % 2 = 0) AS updated, count(*) FILTER (o_orderkey % 3 <> 2) AS servable, count(*) FILTER (o_orderkey % 3 = 2) AS link_out_only, (SELECT count(*) FROM orders) - count(*) AS deduped_in_batch FROM first")
def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run in which every second protocol is known by source and id."""
    new = _raw_protocols(spark, sf_dir)
    known = corpus.upsert_protocols(spark.createDataFrame([], schemas.PROTOCOLS), new.filter(F.col("position") % 2 == 0).withColumn("doi", nothing()))
    return corpus.upsert_counts(known, new, "deal-1")


@query("q_conformance", "SELECT 'content' AS rule, count(*) AS n FROM orders WHERE o_orderkey % 3 = 2 UNION ALL SELECT 'content', count(*) FROM orders WHERE o_orderkey % 3 = 1 AND false HAVING count(*) > 0 UNION ALL SELECT 'identity', count(*) FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT 'license', count(*) FROM orders WHERE o_orderkey % 9 = 1")
def conformance_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows break each rule, where content was kept, ids lost and licenses made up."""
    k = F.col("position")
    held = _raw_protocols(spark, sf_dir).withColumn("serving_basis", F.lit("deal-1"))
    spoilt = held.withColumns({"license": F.when(k % 9 == 1, "GPL").otherwise(F.col("license")), "source_id": F.when(k % 7 == 0, "").otherwise(F.col("source_id")), "steps": F.when((k % 9 == 1) & (k % 3 != 2), F.array().cast(schemas.STEPS)).otherwise(F.col("steps"))})
    return conformance.violations(spoilt).groupBy("rule").agg(F.count("*").alias("n"))


@query("q_rerun_changes", f"""WITH {FIRST_SQL}, changes AS (SELECT 'lost' AS change, o_orderkey FROM first WHERE o_orderkey % 7 < 2 UNION ALL SELECT 'added', o_orderkey FROM first WHERE o_orderkey % 7 IN (1, 2))
    SELECT change, o_orderkey::VARCHAR AS source_id FROM changes""")
def rerun_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a repeated run of all protocols changes (none), and those that one changes which loses some, alters some and doubles some."""
    new = _raw_protocols(spark, sf_dir)
    once = corpus.upsert_protocols(spark.createDataFrame([], schemas.PROTOCOLS), new)
    k = F.col("source_id").cast("long") % 7
    spoilt = once.filter(k != 0).withColumn("title", F.when(k == 1, "another").otherwise(F.col("title")))
    again = conformance.changed_rows(once, corpus.upsert_protocols(once, new))
    return again.unionByName(conformance.changed_rows(once, spoilt.unionByName(spoilt.filter(k == 2)))).select("change", "source_id")


@query("q_shortlist", """WITH latest AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey % 10, l_orderkey ORDER BY l_linenumber DESC, l_partkey, l_suppkey) = 1)
    SELECT l_orderkey % 10 AS category_id, l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey % 10 ORDER BY l_linestatus = 'F' DESC, l_quantity DESC, l_orderkey) AS rank FROM latest QUALIFY rank <= 50""")
def shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 50 of each of ten categories of orders, by their last line; the cut is the feature."""
    none = F.lit(None).cast("long")
    review = F.struct(none.alias("citations"), none.cast("double").alias("rating"), none.alias("ratings_count"), (F.col("l_quantity") * 100).cast("long").alias("views"), *(none.alias(c) for c in ("votes", "bookmarks", "forks", "comments")), (F.col("l_linestatus") == "F").alias("peer_reviewed"))
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 10).alias("category_id"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("version_id"), review.alias("review"), F.struct("l_orderkey", "l_partkey", "l_suppkey").alias("position"))
    return corpus.shortlist(items, 50, within=["category_id"]).select("category_id", "id", F.col("rank").cast("long").alias("rank"))


HARVEST_CAP = 40
HARVEST_SQL = """items AS (SELECT n_nationkey AS c, i AS position, n_nationkey * 1000 + i AS id, (i * 37) % 101 AS views FROM nation, range(30) r(i)),
    picked AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY views DESC, position) AS rank FROM items QUALIFY rank <= 8),
    placed AS (SELECT *, row_number() OVER (ORDER BY lpad(c::VARCHAR, 2, '0'), rank) AS place, id % 4 = 0 AS cached, id % 5 = 1 AND id % 4 <> 0 AS failed FROM picked),
    taken AS (SELECT *, sum((NOT cached AND NOT failed)::INT) OVER (ORDER BY place) AS done FROM placed),
    seen AS (SELECT * FROM taken WHERE done < 40 OR (done = 40 AND NOT cached AND NOT failed))"""


def _harvest(spark: SparkSession, sf_dir: str) -> harvests.Harvest:
    """A search in each nation for thirty items; a quarter of them are stored and some can't be fetched."""
    nation = table(spark, sf_dir, "nation")
    code = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    seeds = nation.select(code.alias("category_id"), F.array("n_name").alias("queries"))
    made = nation.select(F.col("n_name").alias("query"), F.col("n_nationkey").cast("long").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))).alias("position"))
    item = F.struct((F.col("n") * 1000 + F.col("position")).alias("id"), F.lit(1).alias("version_id"), F.struct((F.col("position") * 37 % 101).alias("number_of_views")).alias("stats"))
    items = made.select("query", "position", F.to_json(item).alias("payload"))
    number = F.col("n") * 1000 + F.col("position")
    stored = made.filter(number % 4 == 0).select(number.cast("string").alias("id"), F.lit("1").alias("version"), F.to_json(F.struct(number.alias("id"), F.lit("t").alias("title"), F.lit("cc0").alias("license"))).alias("payload"))

    def fetch(one: str) -> dict:
        if int(one) % 5 == 1:
            raise TimeoutError(one)
        return {"id": int(one), "title": "t", "license": "cc by" if int(one) % 2 else None}

    return harvests.harvest(seeds, items, stored, lambda ids: connectors.fetch_each(ids, fetch), 8, HARVEST_CAP, access=payloads.Access(True, True, "token"), stamp="2026-01-01T00:00:00Z")


@query("q_harvest", f"WITH {HARVEST_SQL} SELECT id::VARCHAR AS source_id, cached OR id % 2 = 1 AS servable FROM seen WHERE NOT failed")
def harvest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a harvest of at most 40 fetches maps, by what may be served; the cap is the feature."""
    run = _harvest(spark, sf_dir)
    return run.servable.select("source_id", F.lit(True).alias("servable")).unionByName(run.link_out.select("source_id", F.lit(False).alias("servable")))


@query("q_harvest_manifest", f"WITH {HARVEST_SQL} SELECT (SELECT count(*) FROM picked) AS shortlisted, count(*) FILTER (NOT cached AND NOT failed) AS fetched, count(*) FILTER (cached) AS skipped_cached, count(*) FILTER (NOT failed AND (cached OR id % 2 = 1)) AS servable, count(*) FILTER (NOT failed AND NOT cached AND id % 2 = 0) AS link_out, count(*) FILTER (failed) AS errors, 40 AS cap, '2026-01-01T00:00:00Z' AS stamp FROM seen")
def harvest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's one row of counters, written and read back."""
    path = new_path(spark, "harvests")
    payloads.write_manifest(_harvest(spark, sf_dir).manifest, path)
    read = spark.read.schema("shortlisted long, fetched long, skipped_cached long, servable long, link_out long, errors long, cap long, stamp string").json(f"{path}/manifest")
    return read


def _materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with materials: of every third each names a vendor or number somewhere, others are names alone."""
    material = lambda name, vendor, number: F.struct(name.alias("name"), nothing().alias("amount"), vendor.alias("vendor"), number.alias("catalog_no"))
    told = F.array(material(F.lit("Taq KIT"), F.lit("Acme"), F.lit("")), material(F.lit("Buffer"), F.lit(""), order_text()), material(F.lit("Water"), F.lit(""), nothing()))
    plain = F.array(material(F.col("o_orderpriority"), nothing(), nothing()), material(F.lit("centrifuge"), nothing(), nothing()), material(F.lit("maybe"), nothing(), nothing()))
    return table(spark, sf_dir, "orders").select(order_key().alias("id"), F.when(order_key() % 3 == 0, told).otherwise(plain).cast(schemas.MATERIALS).alias("materials"))


@query("q_structured_materials", "SELECT o_orderkey AS id, m.name AS name, m.role AS role FROM (SELECT o_orderkey, unnest([{'name': 'Taq KIT', 'role': 'kit'}, {'name': 'Buffer', 'role': 'reagent'}]) AS m FROM orders WHERE o_orderkey % 3 = 0)")
def structured_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials that name a vendor or number, classified by their names."""
    made = matching.structured_materials(_materials(spark, sf_dir))
    return made.select("id", F.explode("materials").alias("m")).select("id", "m.name", "m.role")


@query("q_procurement_filter", "SELECT event_id AS id, event_type AS role FROM events WHERE event_type IN ('click', 'view') AND value >= 50")
def procurement_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as classified lines: only what a lab orders, and surely enough."""
    role = F.when(F.col("event_type") == "click", "kit").when(F.col("event_type") == "view", "reagent").otherwise("equipment")
    kept = matching.procurement_filter(table(spark, sf_dir, "events").select("event_id", "event_type", role.alias("role"), (F.col("value") / 100).alias("confidence")))
    return kept.select(F.col("event_id").alias("id"), F.col("event_type").alias("role"))


@query("q_enrich", """WITH m AS (SELECT CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey // 4 END AS id, o_orderkey % 3 = 0 AS told, o_orderkey % 3 <> 0 AND o_orderpriority = '5-LOW' AS failed, o_orderpriority FROM orders)
    SELECT id, CASE WHEN told THEN 'Taq KIT|Buffer' WHEN failed THEN '5-LOW|centrifuge|maybe' ELSE o_orderpriority END AS materials, CASE WHEN failed THEN 0 WHEN told THEN 2 ELSE 1 END AS materials_out, NOT told AS llm_call, failed AS error FROM m""")
def enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials of all orders made ready for a purchase, under ids that repeat or are missing; a client classifies what names no vendor, and fails at some."""

    def classify(names: list[str]) -> list[dict]:
        if names[0] == "5-LOW":
            raise RuntimeError("no answer")
        return [{"name": n, "role": "equipment" if n == "centrifuge" else "reagent", "confidence": 0.2 if n == "maybe" else 0.9} for n in names]

    made = matching.enrich_materials(_materials(spark, sf_dir).withColumn("id", F.when(F.col("id") % 5 > 0, F.floor(F.col("id") / 4))), classify)
    return made.select("id", F.array_join(F.transform("materials", lambda m: m["name"]), "|").alias("materials"), "materials_out", "llm_call", "error")


@query("q_enrich_counts", "SELECT count(*) AS protocols, 3 * count(*) AS materials_in, 2 * count(*) FILTER (o_orderkey % 3 = 0) AS materials_out, 0 AS llm_calls, 0 AS errors FROM orders")
def enrich_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a run without a client."""
    return matching.enrich_counts(matching.enrich_materials(_materials(spark, sf_dir)))


STEPS = {("open", "click"): "confirmed", ("open", "view"): "pending_approval", ("pending_approval", "click"): "confirmed", ("confirmed", "purchase"): "paid", ("confirmed", "error"): "cancelled"}


@query("q_order_states", """SELECT user_id AS entity, list_reduce(list_prepend('open', list(event_type ORDER BY ts, event_id)), lambda s, e: CASE s || '|' || e WHEN 'open|click' THEN 'confirmed' WHEN 'open|view' THEN 'pending_approval' WHEN 'pending_approval|click' THEN 'confirmed' WHEN 'confirmed|purchase' THEN 'paid' WHEN 'confirmed|error' THEN 'cancelled' ELSE s END) AS state
    FROM events GROUP BY user_id""")
def order_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where users' events, each delivered twice, take an order."""
    made = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("event"), F.col("ts").alias("occurred_at"), F.col("event_id").alias("idempotency_key"))
    return flow.folded_state(made.unionByName(made), "open", STEPS).select("entity", "state")


@query("q_stream_states", """WITH e AS (SELECT user_id, event_type, ts, event_id FROM events), s AS (SELECT user_id, list_reduce(list_prepend('open', list(event_type ORDER BY epoch_ms(ts), event_id::VARCHAR)), lambda s, e: CASE s || '|' || e WHEN 'open|click' THEN 'confirmed' WHEN 'open|view' THEN 'pending_approval'
    WHEN 'pending_approval|click' THEN 'confirmed' WHEN 'confirmed|purchase' THEN 'paid' WHEN 'confirmed|error' THEN 'cancelled' ELSE s END) AS state, count(*) AS repeated FROM e GROUP BY user_id) SELECT user_id::VARCHAR AS entity, state, repeated FROM s""")
def stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where users' events take an order, streamed in three runs that each go on from the last; in each of the first two every event comes once, and a far event ends the time."""
    root, none = new_path(spark, "streams"), "not an order"
    made = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("entity_id"), F.col("event_type").alias("event"), F.col("ts").cast("timestamp").alias("occurred_at"), F.col("event_id").cast("string").alias("idempotency_key"))
    last = spark.createDataFrame([(none, none, none)], "entity_id string, event string, idempotency_key string").withColumn("occurred_at", F.lit("2100-01-01").cast("timestamp")).select(made.columns)
    for part in (made, made, last):
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(made.schema).parquet(f"{root}/in")
        before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            flow.run_once(flow.streamed_state(stream, "open", STEPS, lateness="4000 days").withColumn("written", F.current_timestamp()), f"{root}/out", f"{root}/state", "update")
        finally:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return flow.latest_rows(spark.read.parquet(f"{root}/out")).filter(F.col("entity") != none).select("entity", "state", F.col("repeated").cast("long").alias("repeated"))


@query("q_latest_state", "SELECT user_id AS entity_id, max_by(event_id, (ts, event_id)) AS idempotency_key, max_by(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's newest event, of events that came twice and out of order."""
    made = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("state"), F.col("ts").alias("occurred_at"), F.col("event_id").alias("idempotency_key"))
    return flow.latest_state(made.unionByName(made.withColumn("occurred_at", F.col("occurred_at") + F.expr("interval 1 hour")))).select("entity_id", "idempotency_key", "state")


@query("q_stream_once", "SELECT event_id, event_type FROM events")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed from a folder in which they lie twice, each taken once, in two runs that take what has arrived."""
    root = new_path(spark, "streams")
    made = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("occurred_at"), F.col("event_id").cast("string").alias("idempotency_key"))
    made.unionByName(made).write.parquet(f"{root}/in")
    for _ in range(2):
        stream = spark.readStream.schema(made.schema).parquet(f"{root}/in")
        flow.run_once(flow.once_only(stream, lateness="400 days"), f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out").select("event_id", "event_type")


@query("q_enrich_invalid", "SELECT o_orderkey AS id, o_orderkey % 3 > 0 AND o_orderkey % 4 > 0 AS error, CASE WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_orderkey % 4 > 0 THEN 0 ELSE 3 END AS materials_out FROM orders")
def enrich_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client whose confidences, roles or names are no such things for three quarters of its orders: these stay as they are."""

    def classify(names: list[str]) -> list[dict]:
        spoilt = {"1": {"confidence": 1.5}, "2": {"role": "gadget"}, "3": {"name": None}}.get(names[-1], {})
        return [{"name": n, "role": "reagent", "confidence": 1} | (spoilt if n == names[-1] else {}) for n in names]

    turn = (F.col("id") % 4).cast("string")
    named = F.transform("materials", lambda m: F.when(m["name"] == "maybe", m.withField("name", turn)).otherwise(m))
    return matching.enrich_materials(_materials(spark, sf_dir).withColumn("materials", named), classify).select("id", "error", "materials_out")


@query("q_category_filter", "SELECT 'C7' AS category_id, 'Nation ' || n_name AS category_name, 'Nation ' || n_name AS queries FROM nation WHERE n_nationkey = 7")
def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeds of one category among nations."""
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("category_id"), F.concat(F.lit("Nation "), F.col("n_name")).alias("category_name"))
    return payloads.category_seeds(rows, "C7").withColumn("queries", F.array_join("queries", "|"))


@query("q_source_names", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'protocols.io' WHEN 1 THEN 'europepmc' WHEN 2 THEN 'europepmc' END AS source FROM orders")
def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by their aliases, padded and in any case."""
    k = order_key() % 4
    said = F.when(k == 0, " PIO ").when(k == 1, "EPMC").when(k == 2, "pmc").otherwise("nowhere")
    return table(spark, sf_dir, "orders").select(order_key().alias("id"), payloads.source_column(said).alias("source"))


@query("q_nested_json", """SELECT o_orderkey::VARCHAR AS source_id, '["A"]' AS authors, '[{"number":1,"text":"' || o_orderpriority || '"}]' AS steps, '{"citations":' || o_custkey || ',"rating":null,"ratings_count":null,"views":null,"votes":null,"bookmarks":null,"forks":null,"comments":null,"peer_reviewed":null}' AS review FROM orders""")
def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as protocols, their nested columns as JSON."""
    return corpus.dumped(_raw_protocols(spark, sf_dir), ("authors", "steps", "review")).select("source_id", "authors", "steps", "review")


@query("q_link_report", f"WITH {LINKS_SQL} SELECT (SELECT count(*) FROM orders) AS protocols, count(DISTINCT protocol_id) AS protocols_linked, count(*) AS links, count(*) FILTER (kind = 'exact') AS exact, count(*) FILTER (kind = 'substitute') AS substitute FROM links WHERE reviewed")
def link_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a matching run whose links are the reviewed ones."""
    return matching.link_counts(links(spark, sf_dir).filter("reviewed"), protocols(spark, sf_dir))


@query("q_client_embedder", "SELECT p_partkey AS id, length(p_name)::DOUBLE AS size, len(string_split(p_name, ' '))::DOUBLE AS words FROM part")
def client_embedder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by a client's embedder, a function of Arrow batches, under its provider's name."""

    def client(name: Column) -> Column:
        return F.pandas_udf(_measured, "array<double>")(name)

    made = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), vectors.embedder("client", {"client": client})(F.col("p_name")).alias("v"))
    return made.select("id", F.get("v", F.lit(0)).alias("size"), F.get("v", F.lit(1)).alias("words"))


def _measured(names: pd.Series) -> pd.Series:
    return pd.Series([[float(len(n)), float(len(n.split(" ")))] for n in names])
