"""Tables, matching, protocols, reads, evaluation and streams."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from procurespark import schemas
from procurespark.functions import vectors
from procurespark.functions.text import canonical_text
from procurespark.operators import conformance, evaluation, ingest, knn, matching, reads
from procurespark.operators import protocols as corpus
from procurespark.operators import tables as snapshots
from procurespark.operators.snapshots import Store, Work, unit_of_work
from procurespark.streaming import events as idempotent
from procurespark.streaming import limiter


def rows_of(df):
    return sorted(map(str, df.collect()))


ITEMS = "supplier_id string, supplier_sku string, name string, category string, brand string, mpn string, specs map<string,string>, cost double, currency string, position int, run_id string"


def test_product_upsert_is_idempotent(spark):
    none = spark.createDataFrame([], schemas.PRODUCTS)
    items = spark.createDataFrame([("s", "1", "Old", "pcr", "B", "M", {}, 1.0, "CNY", 0, "r"), ("s", "2", "New", "pcr", "B", "M", {"a": "1"}, 1.0, "CNY", 1, "r"), ("s", "3", "Loose", "pcr", None, "M", {}, 1.0, "CNY", 2, "r")], ITEMS)
    once = snapshots.upsert_products(none, items)
    assert sorted(r.name for r in once.collect()) == ["Loose", "New"]
    stored = once.withColumn("embedding_model", F.lit("kept"))
    again = snapshots.upsert_products(stored, items.filter("brand is not null"))
    assert rows_of(again) == rows_of(stored)
    assert snapshots.duplicates(again, *schemas.UNIQUE_KEYS["products"]).count() == 0
    assert rows_of(snapshots.upsert_products(stored, items.repartition(3))) == rows_of(stored)  # the same run once more
    assert snapshots.upsert_products(stored, items.withColumn("run_id", F.lit("next"))).count() == 3  # rows without a key are added by each run


def test_offers_suppliers_edges(spark):
    offers = spark.createDataFrame([], schemas.OFFERS)
    new = spark.createDataFrame([("s", "1", "p1", 2.5, "CNY", 0), ("s", "1", "p2", 3.5, "CNY", 1)], "supplier_id string, supplier_sku string, product_id string, cost double, currency string, position int")
    (row,) = snapshots.upsert_offers(offers, new).collect()
    assert row.product_id == "p2" and float(row.cost) == 3.5
    suppliers = snapshots.upsert_suppliers(spark.createDataFrame([], schemas.SUPPLIERS), spark.createDataFrame([("A", "CN", "public", None)], "name string, region string, tier string, verified boolean"))
    again = snapshots.upsert_suppliers(suppliers, spark.createDataFrame([("A", "US", "deep", True)], "name string, region string, tier string, verified boolean"))
    assert rows_of(again) == rows_of(suppliers) and suppliers.first().verified is False
    edges = spark.createDataFrame([("a", "b", 0.8, "substitute", "manual", True), ("a", "c", 0.9, "substitute", "x", False)], schemas.EQUIVALENCES)
    fresh = spark.createDataFrame([("a", "b", 0.95, "exact", "vector+rules")], "product_id string, equivalent_id string, confidence double, kind string, method string")
    got = {r.equivalent_id: tuple(r)[2:] for r in snapshots.upsert_equivalences(edges, fresh).collect()}
    assert got == {"b": (0.95, "exact", "manual", True), "c": (0.9, "substitute", "x", False)}


def test_normalize_and_checks(spark):
    raw = spark.createDataFrame([(" s ", " n ", "PCR", "", " m ", None, None, "CNY", None, None, None)], schemas.EXTRACTED_PRODUCT)
    (row,) = snapshots.normalize_products(raw).collect()
    assert (row.supplier_sku, row.name, row.category, row.brand, row.mpn, row.cost, row.specs) == ("s", "n", "molecular_biology", None, "m", 0.0, {})
    t = spark.createDataFrame([(1, "exact"), (1, "x"), (None, None), (None, None)], "k int, kind string")
    assert snapshots.duplicates(t, ["k"]).collect() == [(1, 2)]
    assert snapshots.outside(t, "kind", schemas.KINDS).count() == 3
    assert snapshots.null_counts(t, ["k", "kind"]).first() == (2, 2)
    parent = spark.createDataFrame([(2,)], "id int")
    assert snapshots.orphans(t, "k", parent).count() == 2 and snapshots.cascade(t, "k", parent).count() == 0
    assert snapshots.evolved(t, spark.createDataFrame([(5, "new")], "k int, added string")).columns == ["k", "kind", "added"]
    assert snapshots.ingest_report(t).first() == (4, 4, 4)


def brute(m, k):
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    d = 1 - unit @ unit.T
    return {(q, i) for q in range(len(m)) for i in sorted((j for j in range(len(m)) if j != q), key=lambda j: (d[q, j], j))[:k]}


def test_nearest(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 16)) + rng.integers(0, 4, 300)[:, None] * np.eye(16)[0] * 6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(999, None)], "id long, embedding array<double>").repartition(4)
    want = brute(m, 5)
    assert {(r.query_id, r.id) for r in knn.nearest(df, df, 5, block=70).collect()} == want
    near = {(r.query_id, r.id) for r in knn.nearest_by_cell(df, None, 5, n_cells=8, probes=5, block=20).collect()}
    assert len(near & want) / len(want) >= 0.9
    ties = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(6)], "id long, embedding array<double>")
    assert {(r.query_id, r.id) for r in knn.nearest(ties, ties, 2).collect()} == {(q, i) for q in range(6) for i in [j for j in range(6) if j != q][:2]}
    assert knn.nearest(df.limit(0), df, 5).count() == 0 and knn.nearest(df, df.limit(0), 5).count() == 0
    some = df.filter(F.col("id") % 100 == 0)
    assert knn.recall(knn.nearest_by_cell(df, some, 5, n_cells=8), knn.nearest(some, df, 5)).first()[0] >= 0.9


EVAL = [
    ("cn1", "molecular_biology", "Taq DNA Polymerase", "Acme", "T1", {"units": "500"}), ("cn1b", "molecular_biology", "Taq DNA Polymerase", "Acme", "T1", {"units": "500"}),
    ("us1", "molecular_biology", "Taq DNA Polymerase", "Other", "X9", {"units": "500"}), ("cn2", "consumables", "PCR tube strip", "Tubeco", "S8", {"wells": "8"}),
]


def test_gold_evaluation(spark):
    made = spark.createDataFrame(EVAL, "key string, category string, name string, brand string, mpn string, specs map<string,string>")
    made = made.withColumn("embedding", vectors.hash_embedding(canonical_text(F.col("brand"), F.col("name"), F.col("category"), F.col("specs"))))
    gold = spark.createDataFrame([("cn1", "cn1b", "exact"), ("cn1", "us1", "substitute"), ("cn1", "cn2", "none")], "a_key string, b_key string, kind string")
    from procurespark.functions.scoring import attribute_bonus, confidence

    scored = evaluation.gold_pairs(gold, made).withColumn("confidence", confidence(vectors.cosine(F.col("a.embedding"), F.col("b.embedding")), attribute_bonus(F.col("a"), F.col("b")))).withColumnRenamed("kind", "gold")
    report = evaluation.confusion(scored.withColumn("pred", evaluation.predicted_kind(F.col("confidence"), 0.92, 0.80))).first()
    assert (report.tp, report.fp, report.fn, report.tn, report.precision, report.recall, report.f1) == (2, 0, 0, 1, 1.0, 1.0, 1.0)
    sweep = evaluation.threshold_sweep(scored).orderBy("threshold").collect()
    assert [r.threshold for r in sweep] == [round(0.05 * i, 2) for i in range(10, 20)]
    with pytest.raises(Exception, match="unknown product"):
        evaluation.gold_pairs(spark.createDataFrame([("cn1", "gone", "none")], gold.schema), made).collect()


def test_metrics(spark):
    pairs = spark.createDataFrame([("exact", "exact"), ("substitute", "substitute"), ("none", "none"), ("substitute", "none")], "pred string, gold string")
    r = evaluation.confusion(pairs).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.kind_accuracy) == (2, 1, 0, 1, 1.0)
    r = evaluation.confusion(pairs.filter("gold = 'none'")).first()
    assert (r.precision, r.recall, r.f1, r.kind_accuracy) == (0.0, 0.0, 0.0, None)
    report = spark.createDataFrame([(0.95, 0.8, 0.1), (0.5, None, 0.9)], "precision double, kind_accuracy double, sample_exact_rate double")
    assert [(r.passed, r.reasons) for r in evaluation.gate(report).collect()] == [(True, []), (False, ["precision", "kind_accuracy", "exact_rate"])]


PRODUCT = "id long, category string, name string, brand string, mpn string, specs map<string,string>"


def test_material_links(spark):
    products = spark.createDataFrame([(1, "", "TRIzol", "Invi", "T9", {}), (2, "", "TRIzol copy", "Invi", "t9", {}), (3, "", "Gel", "Q", "G", {})], PRODUCT)
    protocols = spark.createDataFrame([("p", [("TRIzol", None, " INVI ", "T9"), ("trizol", None, None, None), ("Gel", None, "Q", "G2"), (" ", None, None, None), ("Far", None, None, None)])], f"id string, materials {schemas.MATERIALS}")
    lines = matching.material_lines(protocols)
    assert [r.name for r in lines.orderBy("position").collect()] == ["TRIzol", "Gel", "Far"]
    seen = []

    def candidates(rest):
        seen.extend(r.name for r in rest.collect())
        near = spark.createDataFrame([("Gel", 3, 0.1, 1), ("Gel", 1, 0.02, 2), ("Far", 3, 0.9, 1)], "name string, product_id long, distance double, rank int")
        return rest.join(near, "name")

    got = {tuple(r)[1:] for r in matching.match_materials(lines, products, candidates).collect()}
    assert got == {(1, "TRIzol", 1.0, "exact", "catalog"), (1, "Gel", 0.98, "exact", "vector+rules")}
    assert sorted(seen) == ["Far", "Gel"]
    structured = matching.structured_materials(protocols).first().materials
    assert [(m.name, m.role) for m in structured] == [("TRIzol", "reagent"), ("Gel", "reagent")]
    lines = spark.createDataFrame([("TRIzol Reagent", "reagent", 0.9), ("low", "kit", 0.2), ("cycler", "equipment", 1.0), ("Buffer", "buffer_component", 1.0)], "name string, role string, confidence double")
    assert [r.name for r in matching.procurement_filter(lines).collect()] == ["TRIzol Reagent"]


def test_equivalences_and_backfill(spark):
    products = spark.createDataFrame([(1, "c", "a", "B", "M", {}), (2, "c", "b", "B", "M", {}), (3, "d", "e", None, None, {})], PRODUCT)
    near = spark.createDataFrame([(1, 2, 0.55), (1, 3, 0.18), (2, 3, 0.5)], "query_id long, id long, distance double")
    edges = {(r.product_id, r.equivalent_id): (round(r.confidence, 4), r.kind) for r in matching.equivalences(near, products).collect()}
    assert edges == {(1, 2): (1.0, "exact"), (1, 3): (0.82, "substitute")}
    assert matching.sample_exact_rate(near, products, 3).first()[0] == pytest.approx(1 / 3)
    assert matching.sample_exact_rate(near, products.limit(0)).first()[0] == 0.0
    stored = products.withColumn("embedding", F.when(F.col("id") == 1, F.array(F.lit(9.0)))).withColumn("embedding_model", F.lit(None).cast("string")).withColumn("embedding_text_hash", F.lit(None).cast("string"))
    embed = lambda c: F.array(F.length(c).cast("double"))
    filled = matching.embed_missing(stored, embed, lambda: F.col("name"))
    assert {r.id: r.embedding for r in filled.collect()} == {1: [9.0], 2: [1.0], 3: [1.0]}
    done = matching.backfill(filled, "m", embed, lambda: F.col("name"))
    assert {r.embedding[0] for r in done.collect()} == {1.0} and rows_of(matching.backfill(done, "m", lambda c: F.array(F.lit(0.0)), lambda: F.col("name"))) == rows_of(done)


def protocol(source_id, doi, citations, license="CC-BY", reviewed=None, position=0, source="s"):
    review = (citations, None, None, None, None, None, None, None, reviewed)
    return (source, source_id, "uri", f"T{source_id}", [], doi, None, license, [(1, "mix")], [("DNA", None, None, None)], review, "2026-01-01T00:00:00Z", position)


def frame(spark, rows):
    return spark.createDataFrame(rows, f"{schemas.RAW_PROTOCOL}, position int")


def test_protocol_upsert(spark):
    none = spark.createDataFrame([], schemas.PROTOCOLS)
    batch = frame(spark, [protocol("1", "10.1/A", 5, position=0), protocol("2", "10.1/a", 9, position=1), protocol("3", None, 1, "CC-BY-NC", position=2), protocol("4", None, 1, "unknown", position=3)])
    assert corpus.upsert_counts(none, batch).first() == (3, 0, 1, 2, 1)
    first = corpus.upsert_protocols(none, batch)
    rows = {r.source_id: r for r in first.collect()}
    assert set(rows) == {"2", "3", "4"} and rows["3"].steps == [] and rows["3"].title == "T3" and len(rows["2"].steps) == 1
    assert rows_of(corpus.upsert_protocols(first, batch)) == rows_of(first)
    assert corpus.upsert_counts(first, batch).first() == (0, 3, 1, 2, 1)
    under = {r.source_id: (r.servable, r.serving_basis) for r in corpus.upsert_protocols(first, batch, "contract").collect()}
    assert under == {"2": (True, None), "3": (False, None), "4": (True, "contract")}
    moved = corpus.upsert_protocols(first, frame(spark, [protocol("9", "10.1/a", 1, source="other")]))
    assert {r.source_id: r.id for r in moved.collect()}["9"] == rows["2"].id


def test_review_order_and_shortlist(spark):
    df = frame(spark, [protocol("a", None, 5, position=0), protocol("b", None, 5, position=1), protocol("c", None, 1, reviewed=True, position=2), protocol("d", None, 50, position=3)])
    assert [r.source_id for r in corpus.rank_by_review(df.repartition(3)).collect()] == ["c", "d", "a", "b"]
    assert [r.source_id for r in corpus.top_by_review(df, 2).collect()] == ["c", "d"]
    ok, out = corpus.license_gate(df.withColumn("license", F.when(F.col("position") < 2, "CC0")))
    assert (ok.count(), out.count()) == (2, 2)
    items = df.select(F.lit(1).alias("id"), F.col("position").cast("string").alias("version_id"), "review", "position").union(df.limit(1).select(F.lit(None).cast("int"), F.lit("x"), "review", "position"))
    assert [r.version_id for r in corpus.shortlist(items, 5).collect()] == ["3"]


def test_reads(spark):
    rows = [("1", "T1", True, 1.0, [("Taq DNA-Polymerase", None, None, None)]), ("2", "T2", True, 5.0, [("x", None, None, None), ("TAQ  dna/polymerase mix", None, None, None)]), ("3", "T3", False, 9.0, [("taq dna polymerase", None, None, None)]), ("4", "100%", True, 2.0, [("100% ethanol", None, None, None)])]
    protocols = spark.createDataFrame(rows, f"id string, title string, servable boolean, rank_score double, materials {schemas.MATERIALS}").withColumn("authors", F.array().cast("array<string>")).withColumn("source", F.lit("s"))
    links = spark.createDataFrame([("1", "p", "m", 0.9, "exact", "x", True), ("1", "q", "m", 0.8, "exact", "x", False)], schemas.LINKS)
    found = reads.protocols_by_material(protocols, links, "taq--DNA polymerase", 1).collect()
    assert [tuple(r) for r in found] == [("2", "T2", 0, "TAQ  dna/polymerase mix", 2)]
    assert [r.id for r in reads.protocols_by_material(protocols, links, "%").collect()] == ["4"]
    assert reads.protocols_by_material(protocols, links, " / ").count() == 0
    assert [(r.id, r.product_count, r.first_author) for r in reads.list_protocols(protocols, links).collect()] == [("1", 2, None), ("2", 0, None), ("4", 0, None)]
    products = spark.createDataFrame([("p", "c", "P", "B", "M", {"_cost_basis": "x"}), ("q", "c", "Q", None, None, None)], PRODUCT.replace("id long", "id string")).withColumn("created_at", F.lit(0))
    sourced = protocols.withColumn("source_uri", F.lit("u"))
    assert [(r.product_id, r.rank, r.protocol_id) for r in reads.product_protocols(products, links, sourced, True).collect()] == [("p", 1, "1"), ("q", None, None)]
    assert [(r.rank, r.product_id) for r in reads.protocol_materials(sourced.filter("id = '1'"), links, products, limit=1).collect()] == [(1, "p")]
    assert {r.id: r.exists for r in reads.exists(products, spark.createDataFrame([("p",), ("z",)], "id string")).collect()} == {"p": True, "z": False}
    offers = spark.createDataFrame([("o1", "s1", "p", "k1", None, 5.0, "CNY", 1, 1), ("o2", "s1", "p", "k2", None, 4.0, "USD", 1, 1)], schemas.OFFERS.replace("decimal(12,4)", "double"))
    listed = reads.list_products(products, offers, q="p")
    (row,) = listed.collect()
    assert (row.offer_count, row.region) == (2, None) and row.best_landed == pytest.approx((4 + 4 * 0.27 + 1.5) * 1.2)
    suppliers = spark.createDataFrame([("s1", "Sup", "CN", "public", True)], schemas.SUPPLIERS)
    edges = spark.createDataFrame([("p", "q", 0.91234, "substitute", "m", False)], schemas.EQUIVALENCES)
    detail = reads.product_detail(products, offers, suppliers, edges)
    assert detail.filter("id = 'p'").first().equivalents[0].confidence == 0.9123
    buyer = reads.role_view(detail, "detail", " Buyer ")
    hidden = {"brand", "mpn", "region", "supplier", "offers", "cost"}
    assert not hidden & {w for w in buyer.schema.simpleString().replace("<", " ").replace(":", " ").replace(",", " ").split()}
    assert not hidden & set(reads.role_view(listed, "product", "buyer").columns) and reads.role_view(listed, "product", None).columns == listed.columns
    assert reads.stats(products, offers, suppliers, edges).first() == (2, 2, 1, 0, 1, 1, 0.0)
    with pytest.raises(ValueError):
        reads.list_products(products, offers, page=0)
    items = spark.createDataFrame([("product", "p", "a b"), ("protocol", "1", "x"), ("protocol", "0", "x")], "type string, id string, label string")
    assert {r.id: r.url for r in reads.with_urls(items, protocols.withColumn("source_uri", F.lit("u"))).collect()} == {"p": "/search?q=a%20b", "1": "u", "0": None}


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), {"t": "a int"})
    assert store.read("t").count() == 0 and store.versions() == []
    with unit_of_work(store) as work:
        assert work.write("t", spark.range(3).select(F.col("id").cast("int").alias("a"))).count() == 3
        assert work.read("t").count() == 3 and store.read("t").count() == 0
    with unit_of_work(store, dry_run=True) as work:
        work.write("t", spark.range(9).select(F.col("id").cast("int").alias("a")))
    with pytest.raises(KeyError), unit_of_work(store) as work:
        work.write("t", spark.range(9).select(F.col("id").cast("int").alias("a")))
        raise KeyError
    assert store.read("t").count() == 3 and len(list((tmp_path / "store" / "data").iterdir())) == 1
    one, other = Work(store), Work(store)
    one.write("t", store.read("t").limit(2))
    other.write("u", store.read("t").limit(1))
    assert one.commit() == 2
    with pytest.raises(Exception, match="exist"):
        other.commit()
    assert store.read("t").count() == 2 and store.read("t", 1).count() == 3
    manifests = tmp_path / "store" / "manifests"
    (manifests / "00000003.json").write_text('{"tables": {"t"')
    (manifests / "00000004.json").write_text("")
    assert store.versions() == [1, 2] and store.read("t").count() == 2
    with pytest.raises(ValueError, match="can't be read"):
        store.read("t", 3)
    with unit_of_work(store) as work:
        work.write("t", spark.range(7).select(F.col("id").cast("int").alias("a")))
    assert store.newest() == 5 and store.read("t").count() == 7
    left = Work(store)  # killed before its commit
    left.write("t", spark.range(1).select(F.col("id").cast("int").alias("a")))
    assert store.vacuum(keep=2, grace=3600) == 0 and store.versions() == [2, 5]
    assert store.vacuum(keep=1, grace=0) > 0 and store.numbers() == [5]
    assert store.read("t").count() == 7 and len(list((tmp_path / "store" / "data").iterdir())) == 1


def test_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), {"b": "id long, v string"})
    put = lambda old, new: old.join(new, "id", "left_anti").unionByName(new)
    rows = lambda a, b, v: spark.range(a, b).select("id", F.lit(v).alias("v"))
    with unit_of_work(store) as work:
        assert work.merge("b", rows(0, 200, "x"), put, "id", 16) == list(range(16))
    before = store.manifest()["b"]["folders"]
    with unit_of_work(store) as work:
        touched = work.merge("b", rows(199, 201, "y"), put)
        assert work.merge("b", rows(0, 0, "z"), put) == []
    after = store.manifest()["b"]["folders"]
    assert 1 <= len(touched) <= 2 and {k for k in before if before[k] != after[k]} == set(map(str, touched))
    assert {r.id: r.v for r in store.read("b").collect()} == {i: "y" if i > 198 else "x" for i in range(201)}
    with unit_of_work(store) as work:  # a bucket that becomes empty is gone
        work.merge("b", rows(0, 201, "-"), lambda old, new: old.limit(0))
    assert store.read("b").count() == 0 and store.read("b", 2).count() == 201
    with unit_of_work(store) as work:
        work.write("plain", rows(0, 3, "x"))
        work.merge("plain", rows(2, 4, "y"), put, "id", 4)
    assert sorted((r.id, r.v) for r in store.read("plain").collect()) == [(0, "x"), (1, "x"), (2, "y"), (3, "y")]
    store.vacuum(1, 0)
    assert store.read("plain").count() == 4 and store.read("b").count() == 0


def test_lists_of_neighbours_follow_changes(spark):
    rng = np.random.default_rng(3)
    held = {f"p{k:03d}": rng.normal(size=4).tolist() for k in range(120)}
    frame = lambda h: spark.createDataFrame(list(h.items()), "id string, embedding array<double>")
    lists = ingest.neighbour_lists(frame(held), 8)
    new = {k: v for k, v in held.items() if k != "p005"} | {"p007": rng.normal(size=4).tolist(), "p200": held["p009"], "p050": None}
    changed = spark.createDataFrame([("p005",), ("p007",), ("p200",), ("p050",)], "id string")
    got = ingest.refreshed(lists, frame(new), changed, 4, 8).filter("rank <= 4")
    want = ingest.near(frame(new), frame(new), 4)
    shown = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.distance, 9)) for r in df.collect())
    assert shown(got) == shown(want)


def test_ingest_reads_its_catalog_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    schema = schemas.EXTRACTED_PRODUCT + ", position long"
    rows = [(f"s{k}", f"n{k}", "c", "b", f"m{k % 4}", None, 1.0, "CNY", None, None, None, k) for k in range(10)]
    extracted = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    store = Store(spark, str(tmp_path / "store"), {"suppliers": schemas.SUPPLIERS, "products": schemas.PRODUCTS, "offers": schemas.OFFERS, "equivalences": schemas.EQUIVALENCES})
    with unit_of_work(store) as work:
        report = ingest.ingest(work, extracted, "S", "CN", "public", "r", match=True, buckets=2)
    assert seen.value == 10 and report.first()[:4] == (10, 10, 10, 4)
    assert store.read("products").count() == 4 and store.read("equivalences").count() == report.first().equivalences_written


def test_conformance_and_leaks(spark):
    deep = 1
    for _ in range(600):
        deep = {"a": [deep]}
    rows = {
        json.dumps({"a": {"b": [{"cost": 1}]}, "t": 'say "cost": "tier"'}): (["cost"], False), json.dumps({"x": "gid://shopify/P/1", "cost ": 1}): ([], True), "{}": ([], False), None: (None, None),
        json.dumps({"x": "y" * 1_000_000, "cost": 1}): (["cost"], False), '{"c\\u006fst":1}': (["cost"], False), json.dumps({"x": '"cost": \n' * 100_000, "tier": ""}): (["tier"], False),
        '{"a\\\\": "cost", "b\\"": "gid:\\/\\/shopify/x"}': ([], True), '["cost"]': ([], False), json.dumps({"cost": deep}): (["cost"], False), '{"broken": "cost': ([], False),
    }
    df = spark.createDataFrame([(r,) for r in rows], "p string")
    assert [tuple(r) for r in df.select(conformance.leaked_keys(F.col("p"), ["tier", "cost"]), conformance.is_foreign(F.col("p"))).collect()] == list(rows.values())
    before = spark.createDataFrame([(1, {"x": "1"}), (1, {"x": "1"}), (2, None), (None, None)], "a int, b map<string,string>")
    after = spark.createDataFrame([(1, {"x": "1"}), (2, None), (3, None), (3, None)], "a int, b map<string,string>")
    assert sorted((str(r.a), r.change) for r in conformance.changed_rows(before, after).collect()) == [("1", "lost"), ("3", "added"), ("3", "added"), ("None", "lost")]
    assert conformance.changed_rows(before, before).count() == 0


def test_enrichment(spark):
    protocols = spark.createDataFrame([(1, [("Kit", None, "V", None), ("Gel", None, None, None)]), (2, [("Gel", None, None, None)]), (3, [("bad", None, None, None)]), (4, None)], f"id int, materials {schemas.MATERIALS}")

    def classify(names):
        if "bad" in names:
            raise RuntimeError
        return [{"name": n, "role": "reagent", "confidence": 0.9} for n in names]

    made = matching.enrich_materials(protocols, classify)
    assert {r.id: [m.name for m in r.materials or []] for r in made.collect()} == {1: ["Kit"], 2: ["Gel"], 3: ["bad"], 4: []}
    assert matching.enrich_counts(made).first() == (4, 4, 2, 3, 1)
    odd = spark.createDataFrame([(1, [("Gel", None, None, None)]), (1, [("Gel", None, None, None)]), (None, [("Gel", None, None, None)]), (None, [("Kit", None, "V", None)])], f"id int, materials {schemas.MATERIALS}")
    assert sorted(str(r.id) for r in matching.enrich_materials(odd, classify).collect()) == ["1", "1", "None", "None"]


def test_backfill_goes_on_and_writes_its_buckets_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    held = spark.createDataFrame([(i, f"n{i}", None, "m" if i % 10 else None, hashlib.sha256(f"n{i}".encode()).hexdigest()) for i in range(100)], "id int, name string, embedding array<double>, embedding_model string, embedding_text_hash string").withColumn("embedding", F.array(F.lit(0.0)))
    with unit_of_work(store) as work:
        work.write_buckets("products", held, "id", 64)
    embed, turns = (lambda c: F.array(F.length(c).cast("double"))), []

    def pause():
        turns.append(1)
        if len(turns) == 2:
            raise InterruptedError

    run = lambda: matching.backfill_store(store, "products", "m", embed, lambda: F.col("name"), batch=3, pause=pause)
    with pytest.raises(InterruptedError):
        run()
    left = store.read("products").filter("embedding_model is null").count()
    assert 0 < left < 10 and store.versions() == [1, 2, 3]
    done = run()
    assert done["embedded"] == left and done["total"] == 100 and left <= done["rewritten"] < 40
    assert store.read("products").filter("embedding_model is null").count() == 0 and run()["rewritten"] == 0
    assert {r.id: r.embedding for r in store.read("products").collect()} == {i: [0.0] if i % 10 else [float(len(f"n{i}"))] for i in range(100)}


def plain_limiter(hits, limit, window):
    held, out = {}, []
    for event_id, key, at in sorted(hits, key=lambda h: (h[2], h[0])):
        own = [x for x in held.get(key, []) if x > at - window]
        if ok := len(own) < limit:
            own.append(at)
        held[key] = own
        out.append((key or "", event_id, ok))
    return sorted(out)


def test_limiter(spark, tmp_path):
    random.seed(2)
    hits = [(i, random.choice(["a", "b", None]), float(random.randint(0, 300))) for i in range(200)]
    df = spark.createDataFrame(hits, "event_id long, key string, s double").withColumn("ts", F.timestamp_seconds("s"))
    want = plain_limiter(hits, 3, 60.0)
    assert sorted((r.key, r.event_id, r.allowed) for r in limiter.limit_batch(df, 3, 60.0).collect()) == want
    edge = spark.createDataFrame([(1, "k", 0.0), (2, "k", 30.0), (3, "k", 61.0), (4, "k", 61.0)], "event_id long, key string, s double").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.allowed for r in limiter.limit_batch(edge, 2).orderBy("event_id").collect()] == [True, True, True, False]
    source = str(tmp_path / "in")
    df.filter("s < 150").coalesce(1).write.parquet(source)
    stream = lambda: limiter.limit_stream(spark.readStream.schema(df.schema).parquet(source), 3, 60.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    stream()
    df.filter("s >= 150").coalesce(1).write.mode("append").parquet(source)
    stream()
    assert sorted((r.key, r.event_id, r.allowed) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_events(spark, tmp_path):
    rows = [("k1", "e", 1, "new"), ("k1", "e", 1, "new"), ("k2", "e", 3, "paid"), ("k3", "e", 2, "late"), ("k4", "f", 1, "new")]
    df = spark.createDataFrame(rows, "idempotency_key string, entity_id string, t int, state string").withColumn("occurred_at", F.timestamp_seconds("t"))
    assert {r.entity_id: r.state for r in idempotent.latest_state(df).collect()} == {"e": "paid", "f": "new"}
    life = [("1", "o", 1, "submitted"), ("1", "o", 9, "submitted"), ("2", "o", 3, "confirmed"), ("3", "o", 2, "paid"), ("4", "o", 4, "paid"), ("5", "x", 1, "resolved")]
    steps = spark.createDataFrame(life, "idempotency_key string, entity_id string, occurred_at int, event string")
    assert {r.entity: (r.state, r.refused) for r in idempotent.folded_state(steps, idempotent.ORDER_START, idempotent.ORDER_STEPS).collect()} == {"o": ("paid", 1), "x": ("open", 1)}
    df.write.parquet(str(tmp_path / "in"))
    idempotent.once_only(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("once").count() == 4


def test_streamed_states_wait_for_their_time(spark, tmp_path):
    """Events in any order within the lateness, in four runs of a query that is stopped between them; late and repeated ones are counted."""
    rng = random.Random(4)
    names = ["confirmed", "submitted", "cancelled", "paid"]
    events = [(f"k{k}", f"e{k % 5}", 1000 + 10 * k, rng.choice(names)) for k in range(80)]
    parts = [events[:40], events[40:] + events[:7]]
    for part in parts:
        rng.shuffle(part)
    parts += [[("late", "e1", 5, "paid"), ("far", "z", 10_000_000, "paid")], [("later", "e2", 6, "paid"), ("farther", "z", 20_000_000, "paid")]]
    schema, late = "idempotency_key string, entity_id string, t long, event string", []
    frame = lambda rows: spark.createDataFrame(rows, schema).withColumn("occurred_at", F.timestamp_seconds("t")).drop("t")
    for part in parts:
        frame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frame(part).schema).parquet(str(tmp_path / "in"))
        made = idempotent.streamed_state(stream, idempotent.ORDER_START, idempotent.ORDER_STEPS, lateness="1 hour").withColumn("written", F.current_timestamp())
        late.append(idempotent.run_once(made, str(tmp_path / "out"), str(tmp_path / "ck"), "update"))
    got = {r.entity: tuple(r)[1:] for r in idempotent.latest_rows(spark.read.parquet(str(tmp_path / "out"))).collect()}
    want = {r.entity: (r.state, r.refused) for r in idempotent.folded_state(frame([*events, parts[2][0]]), idempotent.ORDER_START, idempotent.ORDER_STEPS).collect()}  # that one comes before its time has passed
    assert {e: got[e][:2] for e in want} == want
    assert sum(got[e][2] for e in want) == 7 and late == [0, 0, 0, 1]


def test_vector_index_recall(spark):
    """The registered query over a whole table against brute force, and vectors with ties, nulls, zeros and clusters."""
    from procurespark.operators import vector_index
    from procurespark.plans import registry

    registry.load()
    sf = "/root/testdata/sf0.01"
    held = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = np.array(sorted(held))
    unit = np.stack([held[i] / np.linalg.norm(held[i]) for i in ids])
    want = {(int(q), int(ids[k])) for x, q in enumerate(ids) if q % 100 == 0 for k in np.lexsort((ids, np.where(ids == q, np.inf, 1 - np.round(unit @ unit[x], 12))))[:20]}
    got = registry.QUERIES["q_vector_index"](spark, sf).collect()
    assert len(got) == len(want) and len({(r.query_id, r.id) for r in got} & want) >= 0.9 * len(want)
    assert all(abs(r.distance - (1 - unit[np.searchsorted(ids, r.query_id)] @ unit[np.searchsorted(ids, r.id)])) < 1e-9 for r in got)

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 10))
    rows = [(k, (centres[k % 8] + 0.1 * rng.normal(size=10)).tolist()) for k in range(400)] + [(500, None), (501, [0.0] * 10), (502, centres[0].tolist()), (503, centres[0].tolist())]
    frame = spark.createDataFrame(rows, "id long, embedding array<double>")
    model = vector_index.fit(frame, n_cells=8)
    index = vector_index.coded(frame, model)
    found = vector_index.search(index, model, frame, frame.filter("id % 10 = 0"), k=5, probes=1, rerank=30)
    exact = knn.nearest(frame.filter("id % 10 = 0"), frame.filter("id <> 501"), 5)
    pairs = {(r.query_id, r.id) for r in exact.collect() if r.query_id != 500}
    assert len({(r.query_id, r.id) for r in found.collect()} & pairs) >= 0.9 * len(pairs)
    assert vector_index.fit(frame.filter("id = 500")) is None


def test_streamed_state_takes_what_is_due_at_once(spark, tmp_path):
    """An entity whose time passes for all its events writes one row, not one for each, and events lead on from one another."""
    rows = [(f"k{k}", "e", 1000 + k, ["submitted", "confirmed", "paid"][min(k, 2)]) for k in range(50)]
    schema = "idempotency_key string, entity_id string, t long, event string"
    for n, part in enumerate((rows, [("far", "z", 10_000_000, "paid")])):
        spark.createDataFrame(part, schema).withColumn("occurred_at", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
        made = idempotent.streamed_state(stream, idempotent.ORDER_START, idempotent.ORDER_STEPS).withColumn("written", F.current_timestamp())
        idempotent.run_once(made, str(tmp_path / "out"), str(tmp_path / "ck"), "update")
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.filter("entity = 'e' and applied > 0").count() == 1
    (row,) = idempotent.latest_rows(written.filter("entity = 'e'")).collect()
    assert (row.state, row.refused) == ("paid", 47)


def test_nearest_among_copies_and_passed_on_once(spark, monkeypatch):
    """Copies of few vectors, zero ones too, give the lists of brute force; however many vectors, a task passes on k of each query."""
    rng = np.random.default_rng(3)
    m = rng.integers(-2, 3, size=(12, 4)).astype(float)[rng.integers(0, 12, 300)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<double>").repartition(4)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    unit = np.divide(m, length, out=np.zeros_like(m), where=length > 0)
    d = 1 - np.round(unit @ unit.T, 12)
    want = {(q, i, r) for q in range(300) for r, i in enumerate(sorted((j for j in range(300) if j != q), key=lambda j: (d[q, j], j))[:5], 1)}
    assert {(r.query_id, r.id, r.rank) for r in knn.nearest(frame, frame, 5).collect()} == want
    direct = knn._dealt(*2 * [frame.withColumnRenamed("embedding", "v")], 300, 300, 4, 5, True, 70)
    assert {(r.query_id, r.id, r.rank) for r in direct.collect()} == want
    some = frame.filter("id % 50 = 0")
    assert {(r.query_id, r.id, r.rank) for r in knn.nearest(some, frame, 5).collect()} == {w for w in want if w[0] % 50 == 0}
    best = knn._Best(np.arange(3), unit[:3], 5, True)
    for x in range(0, 300, 10):
        best.meet(np.arange(x, x + 10), unit[x : x + 10])
    assert len(best.found()) == 15


def test_strings_in_one_pass_as_by_columns(spark):
    """Broken texts, escapes outside of strings, unclosed strings and odd blanks: keys and values as the column functions cut them."""
    rng = random.Random(5)
    texts = ["".join(rng.choice(['"', "\\", ":", "cost", " ", "\\u0063ost", "{", "\\n", "\n", "gid://shopify/", "é", "shopify_x"]) for _ in range(rng.randint(0, 12))) for _ in range(400)] + ['{"a\\\\": 1, "cost" : 2}', '{"x": "cost', '"cost":\\', "[" * 10_000 + '"cost":']
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None)], "id long, p string")
    by_columns = F.exists(conformance.json_keys(F.col("p")), lambda k: F.rlike(k, F.lit(conformance.FOREIGN_KEYS))) | F.exists(conformance.json_values(F.col("p")), lambda v: F.contains(v, F.lit(conformance.FOREIGN_VALUES)))
    keys = F.array_sort(F.array_intersect(conformance.json_keys(F.col("p")), F.array(F.lit("cost"), F.lit("x"))))
    made = frame.select("id", "p", conformance.leaked_keys(F.col("p"), ["cost", "x"]).alias("a"), keys.alias("b"), conformance.is_foreign(F.col("p")).alias("c"), by_columns.alias("d"))
    assert [r for r in made.collect() if r.a != r.b or r.c != r.d] == []


def test_rows_without_identifier_are_dealt_out(spark):
    """Protocols without an identifier meet by source and id, and their join's keys are not all one null."""
    new = spark.range(100).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("source_id"), F.when(F.col("id") % 5 == 0, F.concat(F.lit("d"), "id")).when(F.col("id") % 5 == 1, "").alias("doi"), F.col("id").alias("k"))
    stored = new.filter("k % 2 = 0").select(F.concat(F.lit("i"), "source_id").alias("id"), F.col("doi"), F.when(F.col("k") % 10 == 0, "other").otherwise(F.col("source")).alias("source"), "source_id")
    met = corpus.resolve_identity(new, stored)
    assert {r.k: r.existing_id for r in met.collect()} == {k: f"i{k}" if k % 2 == 0 else None for k in range(100)}
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan


def test_candidates_by_text_are_those_by_vector(spark):
    products = spark.range(300).select("id", F.concat_ws(" ", F.lit("x"), (F.col("id") % 7).cast("string"), (F.col("id") % 3).cast("string")).alias("name"), *(F.lit(c).alias(c) for c in ("category", "brand", "mpn")), F.create_map().cast("map<string,string>").alias("specs"))
    lines = spark.createDataFrame([("x 1", None, None), ("x 2 2", None, None), ("none", None, None)], "name string, vendor string, catalog_no string")
    by_vector = matching.embedding_candidates(products.withColumn("embedding", vectors.hash_embedding(F.col("name"))))(lines)
    by_text = matching.embedding_candidates(products, text=F.col("name"))(lines)
    assert rows_of(by_text.select(by_vector.columns)) == rows_of(by_vector) and by_text.count() == 60


def test_material_links_shuffled_are_those_broadcast(spark, monkeypatch):
    """Lines without a vendor or number meet nothing, whether the catalog's numbers are broadcast or shuffled, and each line comes back once."""
    products = spark.createDataFrame([(1, "", "TRIzol", "Invi", "T9", {}), (2, "", "Gel", "Q", "G", {}), (3, "", "Tip", "", "", {})], PRODUCT)
    told = [("p", 0, "TRIzol", " INVI", "t9"), (None, 0, "TRIzol", "Invi", "T9"), ("p", 1, "Gel", None, None), ("q", 0, "Gel", "Q", None), ("r", 0, "Gel", None, "G"), ("s", 0, "Gel", "", "G"), ("q", 1, "Far", "x", "y")]
    lines = spark.createDataFrame(told, "protocol_id string, position int, name string, vendor string, catalog_no string")
    near = spark.createDataFrame([("Gel", 2, 0.1, 1), ("Gel", 1, 0.02, 2), ("Far", 1, 0.9, 1), ("TRIzol", 2, 0.0, 1)], "name string, product_id long, distance double, rank int")
    want = sorted(map(str, [(p, 1, "TRIzol", 1.0, "exact", "catalog") for p in ("p", None)] + [(p, 1, "Gel", 0.98, "exact", "vector+rules") for p in ("p", "q", "r", "s")]))
    for most in (matching.BROADCAST_BYTES, 0):
        monkeypatch.setattr(matching, "BROADCAST_BYTES", most)
        links = matching.match_materials(lines, products, lambda rest: rest.join(near, "name"))
        assert sorted(str(tuple(r)) for r in links.collect()) == want
        hits = matching.catalog_hits(lines, products, "left")
        assert hits.count() == len(told) and hits.filter("product_id = 1").count() == 2 and matching.catalog_hits(lines, products).count() == 2
        assert ("BroadcastHashJoin" in hits._jdf.queryExecution().executedPlan().toString()) == (most > 0)
