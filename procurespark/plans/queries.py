"""The registered queries over the driver's tables and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procurespark.functions import scoring, text, vectors
from procurespark.operators import evaluation, knn, matching, reads, vector_index
from procurespark.operators import protocols as corpus
from procurespark.operators import tables as snapshots
from procurespark.operators.ingest import rebuild
from procurespark.plans.registry import query
from procurespark.plans.tables import links, offers, products, protocols, table
from procurespark.sources.catalog_files import parsed_specs
from procurespark.storage import new_path
from procurespark.streaming.limiter import limit_batch

PRODUCTS_SQL = """products AS (SELECT p_partkey AS id, lower(p_type) AS category, p_name AS name, p_brand AS brand,
    CASE WHEN p_partkey % 2 = 0 THEN 'M' || (p_partkey % 40)::VARCHAR END AS mpn, p_size::VARCHAR AS size, split_part(p_name, ' ', 1) AS line FROM part)"""
OFFERS_SQL = """offers AS (SELECT l_orderkey * 100 + l_linenumber AS id, l_suppkey AS supplier_id, l_partkey AS product_id, l_extendedprice AS cost,
    CASE WHEN l_returnflag = 'R' THEN 'USD' ELSE 'CNY' END AS currency FROM lineitem)"""
LINKS_SQL = """links AS (SELECT l_orderkey AS protocol_id, l_partkey AS product_id, round(1 - l_discount, 4) AS confidence,
    CASE WHEN l_discount <= 0.05 THEN 'exact' ELSE 'substitute' END AS kind, l_linestatus = 'F' AS reviewed, 'line ' || l_linenumber AS material_name FROM lineitem)"""
PROTOCOLS_SQL = """protocols AS (SELECT o_orderkey AS id, 'Order ' || o_orderkey || ' ' || o_orderpriority AS title, o_orderstatus AS source,
    'https://orders.example/' || o_orderkey AS source_uri, o_orderpriority IN ('1-URGENT', '2-HIGH') AS servable, o_totalprice AS rank_score, 'C' || o_custkey AS author FROM orders)"""
CANON_SQL = """CASE WHEN coalesce(raw, '') = '' THEN 'uncategorized' ELSE coalesce(MAP {'molecular biology': 'molecular_biology', 'molbio': 'molecular_biology', 'pcr': 'molecular_biology',
    'qpcr': 'molecular_biology', 'consumable': 'consumables', 'consumables': 'consumables', 'plasticware': 'consumables', 'cell culture': 'cell_culture', 'antibody': 'antibodies',
    'antibodies': 'antibodies'}[lower(trim(raw))], trim(regexp_replace(lower(trim(raw)), '[^a-z0-9]+', '_', 'g'), '_')) END"""


LANDED_SQL = """best AS (SELECT product_id, count(*) AS n, min_by(cost, (cost, id)) AS cost, min_by(currency, (cost, id)) AS currency FROM offers GROUP BY product_id),
    priced AS (SELECT p.id, p.name, p.category, p.brand, coalesce(b.n, 0) AS offer_count, b.cost, b.currency, b.cost * CASE WHEN b.currency = 'USD' THEN 1.0::DOUBLE ELSE 0.14::DOUBLE END AS works, 0.27::DOUBLE AS duty
        FROM products p LEFT JOIN best b ON p.id = b.product_id),
    landed AS (SELECT *, works * duty AS tariff, (works + works * duty + 1.5::DOUBLE) * 0.2::DOUBLE AS margin FROM priced)"""


@query("q_offer_summary", f"WITH {PRODUCTS_SQL}, {OFFERS_SQL}, {LANDED_SQL} SELECT id, name, offer_count, round(cost, 4) AS cheapest_cost, currency, round(works, 4) AS ex_works, round(tariff, 4) AS tariff, round(margin, 4) AS margin, round(works + tariff + 1.5 + margin, 4) AS unit_price FROM landed")
def offer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers, cheapest offer and landed cost of every product."""
    out = reads.offer_summary(products(spark, sf_dir), offers(spark, sf_dir))
    return out.select("id", "name", "offer_count", F.round("cheapest.cost", 4).alias("cheapest_cost"), F.col("cheapest.currency").alias("currency"), F.col("landed.ex_works").alias("ex_works"), F.col("landed.tariff").alias("tariff"), F.col("landed.margin").alias("margin"), F.col("landed.unit_price").alias("unit_price"))


@query("q_products_search", f"WITH {PRODUCTS_SQL} SELECT id, name, category, brand FROM products WHERE (name ILIKE '%ring%' OR brand ILIKE '%ring%' OR mpn ILIKE '%ring%') AND category = 'economy'")
def products_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reads.matching(products(spark, sf_dir), "ring", ["name", "brand", "mpn"])
    return found.filter(F.col("category") == "economy").select("id", "name", "category", "brand")


@query("q_products_page", f"WITH {PRODUCTS_SQL}, {OFFERS_SQL}, {LANDED_SQL} SELECT id, name, category, offer_count, round(works + tariff + 1.5 + margin, 4) AS best_landed FROM landed WHERE name ILIKE '%b_lt%' ORDER BY id DESC LIMIT 20 OFFSET 20")
def products_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page, for a buyer; the page is the feature."""
    page = reads.list_products(products(spark, sf_dir), offers(spark, sf_dir), q="b_lt", page=2, order=[F.col("id").desc()])
    return reads.role_view(page, "product", "buyer").select("id", "name", "category", "offer_count", "best_landed")


@query("q_role_projection", f"WITH {PRODUCTS_SQL}, {OFFERS_SQL}, {LANDED_SQL} SELECT 'USD' AS currency, 1 AS qty, round(works + tariff + 1.5 + margin, 4) AS unit_price, round(works + tariff + 1.5 + margin, 4) AS line_total FROM landed WHERE cost IS NOT NULL")
def role_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed costs as a buyer sees them."""
    landed = reads.offer_summary(products(spark, sf_dir), offers(spark, sf_dir)).filter(F.col("landed").isNotNull()).select("landed.*")
    return reads.role_view(landed, "landed", "buyer")


@query("q_product_detail_nested", f"""WITH {PRODUCTS_SQL}, {OFFERS_SQL}, own AS (SELECT o.product_id, string_agg(o.id || ':' || s.s_name || ':' || o.currency, ',' ORDER BY o.id::VARCHAR, s.s_name, o.cost, o.currency) AS offers, count(*) AS n FROM offers o JOIN supplier s ON o.supplier_id = s.s_suppkey GROUP BY 1)
    SELECT p.id, 'ASR-' || upper(left(p.id::VARCHAR, 6)) AS product_sku, p.name, coalesce(o.offers, '') AS offers, coalesce(o.n, 0) AS n_offers, coalesce(e.id || ':' || e.name || ':' || round((e.id % 100) / 100.0::DOUBLE, 4) || ':exact', '') AS equivalents
    FROM products p LEFT JOIN own o ON p.id = o.product_id LEFT JOIN products e ON e.id = p.id + 1""")
def product_detail_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product with all its offers and their suppliers and the next product as its equivalent, nested, then shown as text."""
    held, none = products(spark, sf_dir), F.lit(None).cast("string")
    sold = offers(spark, sf_dir).withColumns({"supplier_sku": F.col("id").cast("string"), "pack_size": none, "stock": none.cast("int"), "lead_time_days": none.cast("int")})
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("CN").alias("region"))
    edges = held.select((F.col("id") - 1).alias("product_id"), F.col("id").alias("equivalent_id"), ((F.col("id") % 100) / 100.0).alias("confidence"), F.lit("exact").alias("kind"))
    made = reads.product_detail(held, sold, suppliers, edges)
    shown = lambda c, *fields: F.coalesce(F.array_join(F.transform(c, lambda o: F.concat_ws(":", *(o[f] for f in fields))), ","), F.lit(""))
    return made.select("id", "product_sku", "name", shown("offers", "supplier_sku", "supplier", "currency").alias("offers"), F.coalesce(F.size("offers"), F.lit(0)).cast("long").alias("n_offers"), shown("equivalents", "id", "name", "confidence", "kind").alias("equivalents"))


@query("q_category_canon", f"SELECT id, {CANON_SQL} AS category FROM (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN ' PCR ' WHEN 1 THEN p_type || ' / ' || p_name WHEN 2 THEN 'Cell Culture' WHEN 3 THEN '' ELSE p_brand END AS raw FROM part)")
def category_canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, " PCR ").when(k == 1, F.concat_ws(" / ", "p_type", "p_name")).when(k == 2, "Cell Culture").when(k == 3, "").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.canonical_category(raw).alias("category"))


@query("q_canonical_text_sha256", f"WITH {PRODUCTS_SQL}, t AS (SELECT id, brand || ' | ' || name || ' | ' || category || ' | line=' || line || ' | size=' || size AS canonical FROM products) SELECT id, canonical, sha256(canonical) AS digest, id % 3 <> 0 AS stale FROM t")
def canonical_text_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical texts, their hashes, and which vectors are stale if every third is current."""
    shown = text.canonical_text(F.col("brand"), F.col("name"), F.col("category"), F.col("specs"))
    made = products(spark, sf_dir).select("id", shown.alias("canonical"))
    stored = F.when(F.col("id") % 3 == 0, F.sha2("canonical", 256)).when(F.col("id") % 3 == 1, F.sha2(F.lit("old"), 256))
    return made.select("id", "canonical", F.sha2("canonical", 256).alias("digest"), vectors.is_stale(F.lit(vectors.HASH_MODEL), stored, vectors.HASH_MODEL, F.col("canonical")).alias("stale"))


@query("q_hash_embedding", r"""WITH t AS (SELECT doc_id AS id, ('0x' || right(sha1(tok), 3))::INT % 1024 AS slot FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS tok FROM documents)),
    c AS (SELECT id, slot, count(*)::DOUBLE AS n FROM t GROUP BY id, slot), l AS (SELECT id, sqrt(sum(n * n)) AS norm FROM c GROUP BY id) SELECT c.id, c.slot, round(c.n / l.norm, 6) AS weight FROM c JOIN l ON c.id = l.id""")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vectors.sparse_embedding(table(spark, sf_dir, "documents"), "doc_id", "text")
    return made.select("id", "slot", F.round("weight", 6).alias("weight"))


KNN_SQL = """pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS id, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pairs), near AS (SELECT * FROM ranked WHERE rank <= 20)"""


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return knn.nearest(held, held)


@query("q_knn_top20", f"WITH {KNN_SQL} SELECT query_id, id, round(distance, 6) AS distance, rank::INT AS rank FROM near")
def knn_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


SCORED_SQL = f"""{KNN_SQL}, v AS (SELECT vec_id AS id, 'c' || (vec_id % 4) AS category, 'b' || (vec_id % 5) AS brand, 'm' || (vec_id % 7) AS mpn, label::VARCHAR AS label, (vec_id % 3)::VARCHAR AS part FROM embeddings),
    scored AS (SELECT n.query_id, n.id, n.rank, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - n.distance) + CASE WHEN a.category = b.category THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END
        + 0.1::DOUBLE * ((a.label = b.label)::INT + (a.part = b.part)::INT) / 2 + CASE WHEN a.brand = b.brand AND a.mpn = b.mpn THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS confidence
        FROM near n JOIN v a ON n.query_id = a.id JOIN v b ON n.id = b.id)"""


def vector_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda letter, n: F.concat(F.lit(letter), (F.col("vec_id") % n).cast("string"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), cut("c", 4).alias("category"), F.lit("v").alias("name"), cut("b", 5).alias("brand"), cut("m", 7).alias("mpn"),
        F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("part"), (F.col("vec_id") % 3).cast("string")).alias("specs"),
    )


@query("q_equivalence_edges", f"WITH {SCORED_SQL} SELECT query_id AS product_id, id AS equivalent_id, round(confidence, 4) AS confidence, CASE WHEN confidence >= 0.92 THEN 'exact' ELSE 'substitute' END AS kind, 'vector+rules' AS method FROM scored WHERE confidence >= 0.80")
def equivalence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = matching.equivalences(_neighbours(spark, sf_dir), vector_products(spark, sf_dir))
    return edges.withColumn("confidence", F.round("confidence", 4))


@query("q_spec_agreement", "SELECT a.p_partkey AS id, round(((a.p_size = b.p_size)::INT + (split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1))::INT) / 2.0::DOUBLE, 6) AS agreement FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def spec_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product against the next."""
    a = products(spark, sf_dir).select("id", "specs")
    b = a.select((F.col("id") - 1).alias("id"), F.col("specs").alias("other"))
    return a.join(b, "id").select("id", F.round(scoring.spec_agreement(F.col("specs"), F.col("other")), 6).alias("agreement"))


@query("q_material_contains", r"SELECT p_partkey AS id, trim(regexp_replace(lower(p_type || '-' || p_name), '[-/\s]+', ' ', 'g')) AS material FROM part WHERE contains(trim(regexp_replace(lower(p_type || '-' || p_name), '[-/\s]+', ' ', 'g')), 'y red')")
def material_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = text.normalize_material(F.concat_ws("-", "p_type", "p_name"))
    made = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), norm.alias("material"))
    return made.filter(F.contains("material", text.normalize_material(F.lit("Y--Red"))))


BY_MATERIAL_SQL = """lines AS (SELECT l.l_orderkey AS id, l.l_linenumber AS n, p.p_type || '/' || p.p_name AS name FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
    hits AS (SELECT id, min_by(name, (n, name)) AS matched_material FROM lines WHERE contains(regexp_replace(lower(name), '[-/\\s]+', ' ', 'g'), 'economy blue') GROUP BY id)"""


@query("q_protocols_by_material", f"WITH {PROTOCOLS_SQL}, {LINKS_SQL}, {BY_MATERIAL_SQL}, counted AS (SELECT protocol_id, count(*) AS c FROM links GROUP BY protocol_id), found AS (SELECT p.id, p.title, coalesce(c.c, 0) AS product_count, h.matched_material, p.rank_score FROM protocols p JOIN hits h ON p.id = h.id LEFT JOIN counted c ON p.id = c.protocol_id WHERE p.servable) SELECT id, title, product_count, matched_material, (SELECT count(*) FROM found) AS total FROM found ORDER BY rank_score DESC, product_count DESC, id LIMIT 100")
def by_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reverse search's best 100 (its limit is the feature) and the number of all."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_type", "p_name").alias("name"))
    listed = table(spark, sf_dir, "lineitem").join(part, "l_partkey").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "name"))).alias("materials"))
    return reads.protocols_by_material(protocols(spark, sf_dir).join(listed, "id", "left"), links(spark, sf_dir), "Economy - blue", 100)


@query("q_protocols_browse", f"WITH {PROTOCOLS_SQL}, {LINKS_SQL}, counted AS (SELECT protocol_id, count(*) AS c FROM links GROUP BY protocol_id) SELECT p.id, p.title, p.source, round(p.rank_score, 2) AS rank_score, coalesce(c.c, 0) AS product_count, p.author AS first_author FROM protocols p LEFT JOIN counted c ON p.id = c.protocol_id WHERE p.servable AND p.title ILIKE '%urg%' ORDER BY product_count DESC, p.rank_score DESC, p.id LIMIT 100")
def protocols_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of the browse list."""
    return reads.list_protocols(protocols(spark, sf_dir), links(spark, sf_dir), "urg", 1, 100)


@query("q_link_counts", f"WITH {PROTOCOLS_SQL}, {LINKS_SQL} SELECT p.id, (SELECT count(*) FROM links l WHERE l.protocol_id = p.id) AS product_count FROM protocols p")
def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.with_links(protocols(spark, sf_dir), links(spark, sf_dir)).select("id", "product_count")


@query("q_links_forward", f"""WITH {PRODUCTS_SQL}, {PROTOCOLS_SQL}, {LINKS_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY confidence DESC, protocol_id, material_name) AS rank FROM links WHERE reviewed QUALIFY rank <= 50),
    named AS (SELECT b.*, p.title, p.source_uri FROM best b JOIN protocols p ON b.protocol_id = p.id)
    SELECT p.id AS product_id, p.name AS product_name, n.rank::INT AS rank, n.protocol_id, n.title, n.source_uri, n.material_name, round(n.confidence, 4) AS confidence, n.kind FROM products p LEFT JOIN named n ON p.id = n.product_id""")
def links_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product's 50 surest reviewed links (the limit is the feature) with their protocols."""
    return reads.product_protocols(products(spark, sf_dir), links(spark, sf_dir), protocols(spark, sf_dir), reviewed_only=True)


@query("q_links_reverse", f"""WITH {PRODUCTS_SQL}, {PROTOCOLS_SQL}, {LINKS_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY protocol_id ORDER BY confidence DESC, product_id, material_name) AS rank FROM links QUALIFY rank <= 100),
    named AS (SELECT b.*, p.name, p.brand FROM best b JOIN products p ON b.product_id = p.id)
    SELECT p.id AS protocol_id, p.title AS protocol_title, p.source_uri, n.rank::INT AS rank, n.material_name, n.product_id, n.name AS product_name, n.brand, round(n.confidence, 4) AS confidence, n.kind FROM protocols p LEFT JOIN named n ON p.id = n.protocol_id""")
def links_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each protocol's shopping list of 100 at most; the limit is the feature."""
    return reads.protocol_materials(protocols(spark, sf_dir), links(spark, sf_dir), products(spark, sf_dir))


LINES_SQL = """lines AS (SELECT l_orderkey AS protocol_id, l_linenumber AS position, lower(p.p_type) || ' ' || p.p_name AS name, upper(p.p_brand) AS vendor,
        CASE WHEN l_linenumber % 2 = 0 THEN 'm' || (l_partkey % 40) END AS catalog_no FROM lineitem JOIN part p ON l_partkey = p.p_partkey)"""
CANONICAL_SQL = "canonical AS (SELECT id, brand || ' | ' || name || ' | ' || category || ' | line=' || line || ' | size=' || size AS text FROM products)"


def weights_sql(name: str, table: str, key: str, text: str) -> str:
    """Slots and weights of the hashing embedder, for each key of a table, as a named query."""
    return f"""{name}_n AS (SELECT k, ('0x' || right(sha1(tok), 3))::INT % 1024 AS slot, count(*)::DOUBLE AS n FROM (SELECT {key} AS k, unnest(list_filter(regexp_split_to_array(lower({text}), '[ ]+'), lambda x: x <> '')) AS tok FROM {table}) GROUP BY ALL),
    {name} AS (SELECT k, slot, n / sqrt(sum(n * n) OVER (PARTITION BY k)) AS w FROM {name}_n)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as materials: type and name of a part, its brand, and a part number on every second one."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.upper("p_brand").alias("vendor"), F.concat_ws(" ", F.lower("p_type"), "p_name").alias("name"))
    line = table(spark, sf_dir, "lineitem").join(part.hint("merge"), "l_partkey")  # by the size of its file, a catalog of any size would be broadcast
    number = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("m"), (F.col("l_partkey") % 40).cast("string")))
    return line.select(F.col("l_orderkey").alias("protocol_id"), F.col("l_linenumber").alias("position"), "name", "vendor", number.alias("catalog_no"))


FIRST_LINES_SQL = f"""{LINES_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY protocol_id ORDER BY position, vendor, catalog_no IS NULL, catalog_no, name) AS place FROM lines),
    first AS (SELECT * FROM numbered QUALIFY row_number() OVER (PARTITION BY protocol_id, lower(name) ORDER BY place) = 1)"""


@query("q_material_lines", f"WITH {FIRST_LINES_SQL} SELECT protocol_id, name, place FROM first")
def material_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each protocol's materials once by name, the first of them."""
    return matching.material_lines(_with_materials(spark, sf_dir)).select("protocol_id", "name", (F.col("position") + 1).cast("long").alias("place"))


def _with_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as materials in order, numbered from one."""
    item = F.struct("position", "vendor", F.col("catalog_no").isNull(), "catalog_no", "name")
    listed = _lines(spark, sf_dir).groupBy(F.col("protocol_id").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("_m"))
    none = F.lit(None).cast("string")
    return listed.select("id", F.transform("_m", lambda m: F.struct(m["name"].alias("name"), none.alias("amount"), m["vendor"].alias("vendor"), m["catalog_no"].alias("catalog_no"))).alias("materials"))


@query("q_match_materials", f"""WITH {PRODUCTS_SQL}, {FIRST_LINES_SQL}, {CANONICAL_SQL},
    known AS (SELECT lower(brand) AS b, lower(mpn) AS m, min(id) AS product_id FROM products WHERE mpn IS NOT NULL GROUP BY 1, 2),
    hit AS (SELECT f.*, k.product_id FROM first f LEFT JOIN known k ON lower(f.vendor) = k.b AND lower(f.catalog_no) = k.m),
    wanted AS (SELECT DISTINCT name FROM hit WHERE product_id IS NULL),
    {weights_sql("a", "wanted", "name", "name")}, {weights_sql("b", "canonical", "id", "text")},
    near AS (SELECT a.k AS name, b.k AS id, round(sum(a.w * b.w), 12) AS similarity FROM a JOIN b USING (slot) GROUP BY ALL),
    best AS (SELECT *, CASE WHEN similarity >= 0.82 THEN 'exact' ELSE 'substitute' END AS kind FROM near WHERE similarity >= 0.75 QUALIFY row_number() OVER (PARTITION BY name ORDER BY similarity DESC, id) = 1)
    SELECT protocol_id, product_id, name AS material_name, 1.0::DOUBLE AS confidence, 'exact' AS kind, 'catalog' AS method FROM hit WHERE product_id IS NOT NULL
    UNION ALL SELECT h.protocol_id, b.id, h.name, round(b.similarity, 4), b.kind, 'vector+rules' FROM hit h JOIN best b ON h.name = b.name WHERE h.product_id IS NULL""")
def match_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all orders' lines: by catalog identity, else the nearest product by the hashing embedder."""
    held = products(spark, sf_dir)
    shown = text.canonical_text(F.col("brand"), F.col("name"), F.col("category"), F.col("specs"))
    lines = matching.material_lines(_with_materials(spark, sf_dir))
    return matching.match_materials(lines, held, matching.embedding_candidates(held, text=shown))


@query("q_exact_then_fallback", f"""WITH {PRODUCTS_SQL}, {LINES_SQL}, known AS (SELECT lower(brand) AS b, lower(mpn) AS m, min(id) AS product_id FROM products WHERE mpn IS NOT NULL GROUP BY 1, 2)
    SELECT l.protocol_id, l.position, k.product_id FROM lines l JOIN known k ON lower(l.vendor) = k.b AND lower(l.catalog_no) = k.m""")
def catalog_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of matching: lines whose vendor and number name a product; q_match_materials has the fallback too."""
    return matching.catalog_hits(_lines(spark, sf_dir), products(spark, sf_dir)).select("protocol_id", "position", "product_id")


@query("q_dedupe_max_rank", "SELECT o_orderkey AS id, doi, o_totalprice AS score FROM (SELECT *, CASE WHEN o_custkey % 5 <> 0 THEN '10.1/C' || o_custkey END AS doi FROM orders) QUALIFY doi IS NULL OR row_number() OVER (PARTITION BY lower(doi) ORDER BY o_totalprice DESC, o_orderkey) = 1")
def dedupe_max_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    doi = F.when(F.col("o_custkey") % 5 != 0, F.concat(F.lit("10.1/C"), F.col("o_custkey").cast("string")))
    made = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), doi.alias("doi"), F.col("o_totalprice").alias("score"))
    return corpus.dedupe_by_doi(made, "id", F.col("score"))


@query("q_latest_version", "SELECT l_orderkey AS id, l_linenumber AS version_id, l_partkey AS part FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey, l_suppkey) = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("version_id"), F.col("l_partkey").alias("part"), F.struct("l_partkey", "l_suppkey").alias("position"))
    return corpus.latest_versions(made).select("id", "version_id", "part")


@query("q_identity_resolution", """WITH stored AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'd' || o_orderkey END AS doi, o_orderstatus AS source, o_orderkey::VARCHAR AS source_id FROM orders),
    new AS (SELECT o_orderkey AS k, 'd' || (o_orderkey + 3) AS doi, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'X' END AS source, o_orderkey::VARCHAR AS source_id FROM orders)
    SELECT n.k, coalesce(a.id, b.id) AS existing_id FROM new n LEFT JOIN stored a ON n.doi = a.doi LEFT JOIN stored b ON n.source = b.source AND n.source_id = b.source_id""")
def identity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    stored = order.select(key.alias("id"), F.when(key % 3 == 0, F.concat(F.lit("d"), key.cast("string"))).alias("doi"), F.col("o_orderstatus").alias("source"), key.cast("string").alias("source_id"))
    new = order.select(key.alias("k"), F.concat(F.lit("d"), (key + 3).cast("string")).alias("doi"), F.when(key % 2 == 0, F.col("o_orderstatus")).otherwise("X").alias("source"), key.cast("string").alias("source_id"))
    return corpus.resolve_identity(new, stored).select("k", "existing_id")


REVIEW_SQL = """reviews AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id END AS citations, CASE WHEN event_id % 3 = 1 THEN value END AS rating, CASE WHEN event_id % 6 = 1 THEN user_id WHEN event_id % 6 = 4 THEN 0 END AS ratings_count,
    user_id AS views, (event_id % 7) AS votes, (event_id % 4) AS bookmarks, NULL::BIGINT AS forks, (event_id % 2) AS comments, CASE event_type WHEN 'view' THEN true WHEN 'click' THEN false END AS peer_reviewed FROM events),
    scores AS (SELECT *, CASE WHEN citations IS NOT NULL THEN 10.0::DOUBLE * ln(1 + citations::DOUBLE) WHEN rating IS NOT NULL AND coalesce(ratings_count, 0) <> 0 THEN rating * ln(1 + ratings_count::DOUBLE)
        ELSE bookmarks::DOUBLE * 3 + 0 + votes::DOUBLE * 2 + comments::DOUBLE + views::DOUBLE * 0.01::DOUBLE END AS score FROM reviews)"""


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    review = F.struct(
        F.when(e % 3 == 0, n).alias("citations"), F.when(e % 3 == 1, F.col("value")).alias("rating"), F.when(e % 6 == 1, n).when(e % 6 == 4, 0).alias("ratings_count"), n.alias("views"), (e % 7).alias("votes"),
        (e % 4).alias("bookmarks"), F.lit(None).cast("long").alias("forks"), (e % 2).alias("comments"), F.when(kind == "view", True).when(kind == "click", False).alias("peer_reviewed"),
    )
    return table(spark, sf_dir, "events").select("event_id", review.alias("review"))


@query("q_rank_score", f"WITH {REVIEW_SQL} SELECT event_id, round(score, 6) AS score FROM scores")
def rank_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviews(spark, sf_dir).select("event_id", F.round(scoring.rank_score(F.col("review")), 6).alias("score"))


@query("q_rank_stable", f"WITH {REVIEW_SQL} SELECT event_id FROM scores ORDER BY coalesce(peer_reviewed, false) DESC, score DESC, event_id LIMIT 200")
def rank_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 200 by review; the cut is the feature."""
    return corpus.top_by_review(_reviews(spark, sf_dir), 200, "event_id").select("event_id")


@query("q_license_gate", """SELECT doc_id, license, license IN ('CC0', 'CC-BY', 'unknown') AS servable, CASE WHEN license = 'unknown' THEN 'contract-7' END AS serving_basis, CASE WHEN license IN ('CC0', 'CC-BY', 'unknown') THEN length(text) ELSE 0 END AS content_length
    FROM (SELECT doc_id, text, CASE source WHEN 'src0' THEN 'CC0' WHEN 'src1' THEN 'CC-BY' WHEN 'src2' THEN 'CC-BY-NC' WHEN 'src3' THEN 'all-rights-reserved' ELSE 'unknown' END AS license FROM documents)""")
def license_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the license of their source, under a contract for unknown ones."""
    source = F.col("source")
    name = F.when(source == "src0", "CC0").when(source == "src1", " cc-by ").when(source == "src2", "CCBYNC").when(source == "src3", "ARR").otherwise("?")
    none = F.lit(None).cast("long")
    review = F.struct(none.alias("citations"), none.cast("double").alias("rating"), none.alias("ratings_count"), none.alias("views"), none.alias("votes"), none.alias("bookmarks"), none.alias("forks"), none.alias("comments"))
    made = table(spark, sf_dir, "documents").select("doc_id", text.license_of(name).alias("license"), F.array(F.struct(F.lit(1).alias("number"), F.col("text"))).alias("steps"), F.array().cast("array<struct<name:string,amount:string,vendor:string,catalog_no:string>>").alias("materials"), review.alias("review"), F.lit("2026-01-01T00:00:00Z").alias("fetched_at"))
    out = corpus.gated(made, "contract-7")
    return out.select("doc_id", "license", "servable", "serving_basis", F.coalesce(F.length(F.get("steps", F.lit(0))["text"]), F.lit(0)).cast("long").alias("content_length"))


@query("q_license_histogram", "SELECT CASE source WHEN 'src0' THEN 'CC0' WHEN 'src1' THEN 'CC-BY' ELSE 'unknown' END AS license, count(*) AS n FROM documents GROUP BY 1")
def license_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("source") == "src0", "cc0").when(F.col("source") == "src1", "cc by").otherwise("")
    return corpus.license_histogram(table(spark, sf_dir, "documents").select(text.license_of(name).alias("license")))


@query("q_strip_html", "SELECT page_id, trim(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&amp;', '&'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM pages")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@query("q_json_props", "SELECT event_id, (props->>'k')::INT AS k, event_id % 2 = 0 AS bad FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs parsed from JSON, and text that isn't JSON kept as it is."""
    broken = parsed_specs(F.when(F.col("event_id") % 2 == 0, "{not json").otherwise(F.col("props")))
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(parsed_specs(F.col("props")), F.lit("k")).cast("int").alias("k"), (F.try_element_at(broken, F.lit("_raw")) == "{not json").alias("_b")).select("event_id", "k", F.coalesce("_b", F.lit(False)).alias("bad"))


GOLD_SQL = f"""{SCORED_SQL}, pairs2 AS (SELECT s.confidence, CASE WHEN a.label = b.label AND a.part = b.part THEN 'exact' WHEN a.label = b.label THEN 'substitute' ELSE 'none' END AS gold FROM scored s JOIN v a ON s.query_id = a.id JOIN v b ON s.id = b.id)"""


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbour pairs with their confidence; gold says equal labels are alike."""
    view = vector_products(spark, sf_dir)
    scored = matching.scored_pairs(_neighbours(spark, sf_dir), view, view)
    same = lambda k: F.try_element_at("a.specs", F.lit(k)) == F.try_element_at("b.specs", F.lit(k))
    return scored.select("confidence", F.when(same("label") & same("part"), "exact").when(same("label"), "substitute").otherwise("none").alias("gold"))


METRICS_SQL = """count(*) FILTER (pred <> 'none' AND gold <> 'none') AS tp, count(*) FILTER (pred <> 'none' AND gold = 'none') AS fp, count(*) FILTER (pred = 'none' AND gold <> 'none') AS fn,
    count(*) FILTER (pred = 'none' AND gold = 'none') AS tn, count(*) FILTER (gold <> 'none' AND pred = gold) AS kinds"""
RATIOS_SQL = "round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(kinds / nullif(tp + fn, 0)::DOUBLE, 6) AS kind_accuracy"


def _rounded(df: DataFrame, *before: str) -> DataFrame:
    return df.select(*before, "tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "kind_accuracy")))


@query("q_confusion", f"WITH {GOLD_SQL}, p AS (SELECT gold, CASE WHEN confidence >= 0.92 THEN 'exact' WHEN confidence >= 0.80 THEN 'substitute' ELSE 'none' END AS pred FROM pairs2), m AS (SELECT {METRICS_SQL} FROM p) SELECT tp, fp, fn, tn, {RATIOS_SQL} FROM m")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _gold(spark, sf_dir).withColumn("pred", evaluation.predicted_kind(F.col("confidence"), 0.92, 0.80))
    return _rounded(evaluation.confusion(made))


@query("q_threshold_sweep", f"WITH {GOLD_SQL}, t AS (SELECT round(i * 0.05::DOUBLE, 2) AS threshold FROM range(10, 20) r(i)), p AS (SELECT threshold, gold, CASE WHEN confidence >= 0.92 THEN 'exact' WHEN confidence >= threshold THEN 'substitute' ELSE 'none' END AS pred FROM pairs2 CROSS JOIN t), m AS (SELECT threshold, {METRICS_SQL} FROM p GROUP BY threshold) SELECT threshold, tp, fp, fn, tn, {RATIOS_SQL} FROM m")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.threshold_sweep(_gold(spark, sf_dir)), "threshold")


RATE_SQL = "rate AS (SELECT (SELECT count(DISTINCT query_id) FILTER (confidence >= 0.92) FROM scored) / (SELECT count(*) FROM v)::DOUBLE AS sample_exact_rate)"


@query("q_sample_exact_rate_sampled", f"WITH {SCORED_SQL}, s AS (SELECT vec_id AS id FROM embeddings ORDER BY md5(vec_id::VARCHAR || ':42'), vec_id LIMIT 100) SELECT round(count(*) FILTER (id IN (SELECT query_id FROM scored WHERE confidence >= 0.92)) / count(*)::DOUBLE, 6) AS sample_exact_rate FROM s")
def sampled_exact_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share among 100 random products (the sample is the feature) with an exact candidate."""
    return matching.sample_exact_rate(_neighbours(spark, sf_dir), vector_products(spark, sf_dir), 100).select(F.round("sample_exact_rate", 6).alias("sample_exact_rate"))


@query("q_sample_exact_rate", f"WITH {SCORED_SQL}, {RATE_SQL} SELECT round(sample_exact_rate, 6) AS sample_exact_rate FROM rate")
def sample_exact_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of products with an exact candidate, with all products as the sample."""
    found = matching.sample_exact_rate(_neighbours(spark, sf_dir), vector_products(spark, sf_dir), sample=None)
    return found.select(F.round("sample_exact_rate", 6).alias("sample_exact_rate"))


VERDICT_SQL = f"""{GOLD_SQL}, {RATE_SQL}, p AS (SELECT gold, CASE WHEN confidence >= 0.92 THEN 'exact' WHEN confidence >= 0.80 THEN 'substitute' ELSE 'none' END AS pred FROM pairs2), m AS (SELECT {METRICS_SQL} FROM p), r AS (SELECT {RATIOS_SQL} FROM m),
    verdict AS (SELECT concat_ws(',', CASE WHEN precision < 0.9 THEN 'precision' END, CASE WHEN kind_accuracy IS NULL OR kind_accuracy < 0.75 THEN 'kind_accuracy' END, CASE WHEN sample_exact_rate > 0.4 THEN 'exact_rate' END) AS reasons FROM r, rate)"""


@query("q_gate", f"WITH {VERDICT_SQL} SELECT reasons, reasons = '' AS passed FROM verdict")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the edges of these neighbours may not be taken over, from their accuracy and their share of exact ones."""
    _, verdict = rebuild(vector_products(spark, sf_dir), _neighbours(spark, sf_dir), _gold(spark, sf_dir))
    return verdict.select(F.array_join("reasons", ",").alias("reasons"), "passed")


@query("q_rebuild", f"WITH {VERDICT_SQL} SELECT query_id AS product_id, id AS equivalent_id, round(confidence, 4) AS confidence, CASE WHEN confidence >= 0.92 THEN 'exact' ELSE 'substitute' END AS kind, reasons FROM scored, verdict WHERE confidence >= 0.80")
def rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges made anew beside the gate's reasons."""
    edges, verdict = rebuild(vector_products(spark, sf_dir), _neighbours(spark, sf_dir), _gold(spark, sf_dir))
    beside = edges.crossJoin(verdict.select(F.array_join("reasons", ",").alias("reasons")))  # one row beside each
    return beside.select("product_id", "equivalent_id", F.round("confidence", 4).alias("confidence"), "kind", "reasons")


@query("q_vector_index")
def vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by the coded index over all vectors, for ids divisible by 100; of each query 50 vectors are compared as they are. Tests hold its recall."""
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    model, path = vector_index.fit(held), new_path(spark, "vector-index")
    if model is None:
        return vector_index.search(held, None, held, held)
    vector_index.coded(held, model).write.partitionBy("cell").parquet(path)
    return vector_index.search(spark.read.parquet(path), model, held, held.filter(F.col("id") % 100 == 0))


@query("q_knn_cells", "SELECT count(*) FILTER (vec_id % 100 = 0) AS queries, true AS recall_at_least_90 FROM embeddings")
def knn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell index over all vectors, its recall measured by ids divisible by 100 against all vectors."""
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = held.filter(F.col("id") % 100 == 0)
    share = knn.recall(knn.nearest_by_cell(held, asked), knn.nearest(asked, held))
    return asked.agg(F.count("*").alias("queries")).crossJoin(share).select("queries", (F.col("recall") >= 0.9).alias("recall_at_least_90"))  # one row each


@query("q_stats", f"WITH {LINKS_SQL} SELECT (SELECT count(*) FROM part) AS products, (SELECT count(*) FROM lineitem) AS offers, (SELECT count(*) FROM supplier) AS suppliers, count(*) FILTER (kind = 'exact') AS exact, count(*) FILTER (kind = 'substitute') AS substitute, count(*) AS total, 0.0::DOUBLE AS avg_savings FROM links")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.stats(products(spark, sf_dir), offers(spark, sf_dir), table(spark, sf_dir, "supplier"), links(spark, sf_dir))


@query("q_doi_normalize", "SELECT o_orderkey AS id, '10.17504/p.' || o_orderkey AS doi FROM orders WHERE o_orderkey % 4 <> 3 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 4 = 3")
def doi_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    bare = F.concat(F.lit("10.17504/p."), k.cast("string"))
    written = F.when(k % 4 == 0, F.concat(F.lit(" HTTPS://DX.doi.org/"), bare, F.lit("/v3 "))).when(k % 4 == 1, F.concat(F.lit("doi.org/"), bare)).when(k % 4 == 2, bare).otherwise("https://doi.org/")
    return table(spark, sf_dir, "orders").select(k.alias("id"), text.normalize_doi(written).alias("doi"))


@query("q_slug", "SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'q' ELSE trim(regexp_replace(lower(p_type || ' -- ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') END AS slug FROM part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 10 == 0, "--").otherwise(F.concat_ws(" -- ", "p_type", "p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.slug(raw).alias("slug"))


@query("q_sku", "SELECT p_partkey AS id, 'ASR-' || upper(substr(md5(p_name), 1, 6)) AS sku FROM part")
def skus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.product_sku(F.md5("p_name")).alias("sku"))


@query("q_sliding_count", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n FROM events")
def sliding_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each user in the day before, without admission."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.expr("count(*) over (partition by user_id order by ts range between interval 24 hours preceding and current row)").alias("n"))


@query("q_rate_limiter", """WITH RECURSIVE hits AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    folded AS (SELECT user_id, event_id, k, true AS allowed, [us] AS held FROM hits WHERE k = 1
        UNION ALL SELECT h.user_id, h.event_id, h.k, len(list_filter(f.held, lambda x: x > h.us - 3600000000)) < 3,
            list_concat(list_filter(f.held, lambda x: x > h.us - 3600000000), CASE WHEN len(list_filter(f.held, lambda x: x > h.us - 3600000000)) < 3 THEN [h.us] ELSE []::BIGINT[] END)
        FROM folded f JOIN hits h ON f.user_id = h.user_id AND h.k = f.k + 1)
    SELECT user_id::VARCHAR AS key, event_id, allowed FROM folded""")
def rate_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hits an hour for each user."""
    return limit_batch(table(spark, sf_dir, "events"), limit=3, window=3600.0, key="user_id").select("key", "event_id", "allowed")


@query("q_upsert_idempotent", f"WITH {PRODUCTS_SQL}, new AS (SELECT brand, mpn, max_by(name, id) AS name, max_by(category, id) AS category FROM products WHERE mpn IS NOT NULL GROUP BY brand, mpn) SELECT brand, mpn, name, category, 'kept' AS embedding_model FROM new")
def upsert_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by brand and part number upserted twice; a stored column that isn't updated stays."""
    items = products(spark, sf_dir).filter(F.col("mpn").isNotNull()).select("brand", "mpn", "name", F.col("category"), F.col("id").alias("position"))
    first = items.groupBy("brand", "mpn").agg(F.lit("old").alias("name"), F.lit("old").alias("category"), F.lit("kept").alias("embedding_model"))
    again = snapshots.upsert(first, items, ["brand", "mpn"], ["name", "category"], "position")
    return snapshots.upsert(again, items, ["brand", "mpn"], ["name", "category"], "position")


@query("q_constraints", "SELECT 'duplicate_key' AS violation, count(*) AS n FROM (SELECT p_brand, p_size FROM part GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'orphan_offer', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) UNION ALL SELECT 'bad_flag', count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') UNION ALL SELECT 'self_pair', count(*) FROM lineitem WHERE l_partkey = l_suppkey")
def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows break some rules that the tables don't keep."""
    part, line, supplier = (table(spark, sf_dir, t) for t in ("part", "lineitem", "supplier"))
    found = {
        "duplicate_key": snapshots.duplicates(part, ["p_brand", "p_size"]),
        "orphan_offer": snapshots.orphans(line, "l_suppkey", supplier.filter(F.col("s_suppkey") % 2 == 0), "s_suppkey"),
        "bad_flag": snapshots.outside(line, "l_returnflag", ["A", "N"]),
        "self_pair": snapshots.self_pairs(line, "l_partkey", "l_suppkey"),
    }
    out = None
    for name, rows in found.items():
        one = rows.agg(F.lit(name).alias("violation"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("q_set_operations", "SELECT 'union' AS op, count(*) AS n FROM (SELECT l_partkey FROM lineitem UNION ALL SELECT p_partkey FROM part) UNION ALL SELECT 'intersect', count(*) FROM (SELECT l_suppkey FROM lineitem INTERSECT SELECT s_suppkey FROM supplier) UNION ALL SELECT 'except', count(*) FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_linenumber = 1)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, line, supplier = (table(spark, sf_dir, t) for t in ("part", "lineitem", "supplier"))
    named = lambda df, op: df.agg(F.lit(op).alias("op"), F.count("*").alias("n"))
    union = line.select(F.col("l_partkey").alias("k")).unionByName(part.select(F.col("p_partkey").alias("k")))
    both = line.select(F.col("l_suppkey").alias("k")).intersect(supplier.select(F.col("s_suppkey").alias("k")))
    rest = part.select(F.col("p_partkey").alias("k")).subtract(line.filter("l_linenumber = 1").select(F.col("l_partkey").alias("k")))
    return named(union, "union").unionByName(named(both, "intersect")).unionByName(named(rest, "except"))
