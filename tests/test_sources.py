"""Readers on files written here."""

import json
import random
import zipfile
from collections import Counter

import pyarrow as pa
import pytest

from procurespark.operators.snapshots import Store
from procurespark.sources import catalog_files, commerce, connectors, delimited, paging
from procurespark.sources import protocols as payloads

CSV = '''﻿supplier_sku,name,category,brand,mpn,pack_size,cost,currency,stock,lead_time_days,specs,other
S1,"Taq, hot start",molecular biology,Acme,T1,500 U,12.5,CNY,3,7,"{""units"": ""500"", ""hot"": true}",x
S2,Tube,,,,,,CNY,,,not json,x
S3,Tip,consumable,,,,abc,CNY,,,{},x
,Nameless,,,,,1,CNY,,,{},x
'''


def test_delimited(spark, tmp_path):
    path = tmp_path / "catalog.csv"
    path.write_text(CSV, encoding="utf-8")
    rows = {r.supplier_sku: r for r in catalog_files.read_catalog(spark, str(path)).collect()}
    assert set(rows) == {"S1", "S2"}
    assert rows["S1"].name == "Taq, hot start" and rows["S1"].cost == 12.5 and rows["S1"].specs == {"units": "500", "hot": "true"} and rows["S1"].stock == 3
    assert rows["S2"].specs == {"_raw": "not json"} and rows["S2"].brand is None and rows["S2"].cost is None
    with pytest.raises(Exception, match="invalid product row"):
        catalog_files.read_catalog(spark, str(path), mode="FAILFAST").collect()
    short = tmp_path / "short.tsv"
    short.write_text("supplier_sku,name\nA,B\n")
    (row,) = catalog_files.read_catalog(spark, str(short)).collect()
    assert row.currency == "CNY" and row.specs == {}


def test_spreadsheet(spark, tmp_path):
    path = tmp_path / "book.xlsx"
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="a" sheetId="1" r:id="r1"/><sheet name="b" sheetId="2" r:id="r2"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>supplier_sku</t></si><si><t> name </t></si><si><r><t>Ta</t></r><r><t>q</t></r></si></sst>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
        book.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>cost</t></is></c></row><row r="2"><c r="A2"><v>42</v></c><c r="B2" t="s"><v>2</v></c><c r="D2"><v>1.5</v></c></row></sheetData></worksheet>')
    raw = catalog_files.read_spreadsheet(spark, str(path))
    assert raw.select("supplier_sku", "name", "cost").collect() == [("42", "Taq", "1.5")]


def test_extractor_and_dispatch(spark, tmp_path):
    path = tmp_path / "list.html"
    path.write_text("<p>Taq\nand more</p>")
    rows = catalog_files.read_catalog(spark, str(path), lambda text: [{"supplier_sku": "1", "name": text}, {"name": "no sku"}]).collect()
    assert [(r.supplier_sku, r.name, r.currency) for r in rows] == [("1", "<p>Taq\nand more</p>", "CNY")]
    with pytest.raises(ValueError):
        catalog_files.read_catalog(spark, str(path))


NODE = {
    "id": "gid://shop/Product/90", "title": "Red Ligase", "vendor": "Acme", "productType": "PCR", "tags": ["x"],
    "metafields": {"edges": [{"node": {"namespace": "custom", "key": "mpn", "value": "RL"}}, {"node": {"namespace": "spec", "key": "buffer", "value": "HF"}}, {"node": {"namespace": "spec", "key": "none", "value": None}}]},
    "variants": {"edges": [
        {"node": {"id": "gid://shop/Variant/70", "sku": "RL-9", "barcode": "4711", "title": "250 U", "price": "52.10", "inventoryQuantity": 5, "selectedOptions": [{"name": "Size", "value": "250 U"}], "inventoryItem": {"unitCost": {"amount": "13.75", "currencyCode": "USD"}}}},
        {"node": {"id": "gid://shop/Variant/71", "sku": " ", "barcode": "4712", "title": "Default Title", "price": "52.10", "inventoryQuantity": 0, "selectedOptions": [{"name": "Size", "value": "1"}], "inventoryItem": {"unitCost": None}}},
    ]},
}


def test_commerce_nodes(spark, tmp_path):
    path = tmp_path / "nodes.json"
    path.write_text(json.dumps(NODE) + "\n" + json.dumps(NODE | {"id": "2", "variants": {"edges": []}}))
    rows = commerce.map_nodes(commerce.read_nodes(spark, str(path)), commerce.CommerceOptions(mpn_metafield="custom.mpn", specs_namespace="spec"))
    a, b = rows.collect()
    assert (a.supplier_sku, a.name, a.category, a.brand, a.mpn, a.pack_size, a.cost, a.currency) == ("RL-9", "Red Ligase - 250 U", "PCR", "Acme", "RL", "250 U", 13.75, "USD")
    assert a.specs == {"buffer": "HF", "Size": "250 U", "_cost_basis": "unit_cost"}
    assert (b.supplier_sku, b.name, b.pack_size, b.cost, b.specs["_cost_basis"]) == ("shopify:71", "Red Ligase", "Size:1", 52.1, "sell_price_fallback")
    assert commerce.fallback_cost_count(rows).first().n == 1
    assert commerce.map_nodes(commerce.read_nodes(spark, str(path))).first().mpn == "4711"
    assert commerce.api_host("https://shop/", ".example.com") == "shop.example.com"


DETAIL = {
    "id": 7701, "uri": "u1", "url": None, "title": "<p>Cells &amp; media</p>", "doi": "dx.doi.org/10.9/own.abc/v3", "version_id": 3, "license": None, "peer_reviewed": None,
    "authors": [{"first_name": "Ann", "last_name": "Lee"}, {"first_name": ""}], "creator": {"username": "u"},
    "materials": [], "materials_text": '{"blocks":[{"text":"TRIzol"},{"text":" "},{"text":"Tubes\\u0000"}]}',
    "steps": [{"step": '{"blocks":[{"text":"Mix"}]}'}, {"step": ""}, {"step": None, "section": "<b>Wash</b>"}, "odd"],
    "stats": {"number_of_views": 10, "number_of_votes": 1, "number_of_bookmarks": 2, "number_of_forks": {"private": 4, "public": 5}, "number_of_protocol_comments": 0, "number_of_comments": 4},
}


def test_protocol_service(spark):
    details = spark.createDataFrame([(json.dumps(DETAIL),), ("{broken",), (json.dumps({"id": 5, "uri": "u5", "url": "https://x", "license": {"title": "CC BY"}, "materials": [{"name": "Kit", "vendor": {"name": "V"}, "sku": "9", "quantity": "1"}, {"name": "Gel", "vendor": "W", "catalog": "C"}, {"name": " "}], "creator": {"name": "Cy"}}),)], "payload string")
    items = spark.createDataFrame([(json.dumps({"id": 7701, "peer_reviewed": 0}), 1), (json.dumps({"id": 7701, "peer_reviewed": 1}), 2)], "payload string, position long")
    rows = {r.source_id: r for r in payloads.map_protocol_service(details, items).collect()}
    a, b = rows["7701"], rows["5"]
    assert (a.title, a.doi, a.version, a.license, a.authors) == ("Cells & media", "10.9/own.abc", "3", "unknown", ["Ann Lee"])
    assert [(s.number, s.text) for s in a.steps] == [(1, "Mix"), (3, "Wash")]
    assert [m.name for m in a.materials] == ["TRIzol", "Tubes"]
    assert (a.review.forks, a.review.comments, a.review.views, a.review.peer_reviewed) == (9, 4, 10, True)
    assert a.source_uri == "https://www.protocols.io/view/u1" and b.source_uri == "https://x"
    assert b.license == "CC-BY" and b.authors == ["Cy"] and [tuple(m) for m in b.materials] == [("Kit", "1", "V", "9"), ("Gel", None, "W", "C")]
    assert b.review.peer_reviewed is None


def test_literature_service(spark):
    rows = [{"id": "551", "source": "med", "title": "A title.", "authorList": {"author": [{"fullName": "A B"}, {}]}, "license": "cc by", "citedByCount": 37, "doi": "10.1/x"}, {"doi": "10.1/y", "authorString": "C D, E F", "license": "cc by-sa"}]
    a, b = payloads.map_literature_service(spark.createDataFrame([(json.dumps(r),) for r in rows], "payload string")).collect()
    assert (a.source_uri, a.title, a.authors, a.license, a.review.citations, a.steps, a.materials) == ("https://europepmc.org/article/MED/551", "A title", ["A B"], "CC-BY", 37, [], [])
    assert (b.source_uri, b.authors, b.license, b.review.citations) == ("https://doi.org/10.1/y", ["C D", "E F"], "CC-BY-SA", None)


def test_raw_store(spark, tmp_path):
    root = str(tmp_path)
    wanted = spark.createDataFrame([("1", "1", "{}"), ("2", "1", "{}")], "id string, version string, payload string")
    payloads.write_details(wanted.limit(1), root)
    payloads.write_details(wanted.limit(1), root)
    stored = payloads.read_details(spark, root)
    assert stored.count() == 1 and [r.id for r in payloads.missing_details(wanted, stored).collect()] == ["2"]
    payloads.write_search_page(spark.createDataFrame([(0, "{}"), (1, "{}")], "position long, payload string"), root, "elisa", "Sandwich ELISA", 1)
    assert payloads.read_search_items(spark, root).count() == 2


def test_sweeps_and_gates():
    assert connectors.sweepable("pmc") == "europepmc"
    with pytest.raises(ValueError, match="may not be swept"):
        connectors.sweepable("pio")
    sizes = []
    list(connectors.pages(lambda q, page, size: sizes.append(size) or {"items": [], "total_pages": 3}, "q", 10, 500))
    assert sizes == [50] and list(connectors.cursor_pages(lambda q, c, size: {"items": [1, 2, 3], "next": "x"}, "q", 2)) == [1, 2]
    with pytest.raises(PermissionError):
        connectors.search(None, "none", [], lambda q: iter(()), payloads.Access())


def test_seeds_sources_and_locks(spark):
    rows = spark.createDataFrame([("western_blot", "Western blot / x"), ("new", "New thing / y"), ("bare", ""), ("", "none")], "category_id string, category_name string")
    assert {r.category_id: r.queries for r in payloads.category_seeds(rows).collect()} == {"western_blot": ["western blot", "immunoblot"], "new": ["New thing"], "bare": ["bare"]}
    assert payloads.source_name(" EPMC ") == "europepmc"
    with pytest.raises(ValueError):
        payloads.source_name("nope")
    with pytest.raises(PermissionError):
        payloads.Access(allow_network=True).require()
    payloads.Access(True, True, "t").require()


def test_crawls_go_on_where_they_stopped(spark, tmp_path):
    """Numbered pages and cursors end as services do; a round that fails leaves what was committed."""
    sizes = {"a": 0, "b": 5, "c": 10, "d": 23}

    def by_page(query, page, size):
        n = sizes[query]
        return {"items": [{"id": k} for k in range((page - 1) * size, min(n, page * size))], "total_pages": -(-n // size)}

    def by_cursor(query, cursor, size):
        at, n = int(cursor or 0), sizes[query]
        upto = min(n, at + size)
        return {"items": [{"id": k} for k in range(at, upto)], "next": str(upto) if upto < n else cursor}

    seeds = spark.createDataFrame([(q, None) for q in sizes], "query string, cursor string")
    held = lambda store: sorted((r.query, r.position, r.payload) for r in store.read("items").collect())
    for name, page, limit in (("pages", paging.numbered(by_page, 5), None), ("cursors", paging.cursored(by_cursor, 5), 7)):
        store = Store(spark, str(tmp_path / name), paging.TABLES)
        assert paging.crawl(store, seeds, paging.fetched_by(page), limit, rounds=1) == 1
        before = held(store)

        def broken(*_):
            raise RuntimeError("no answer")

        with pytest.raises(Exception, match="no answer"):
            paging.crawl(store, seeds, paging.fetched_by(broken), limit)
        assert held(store) == before
        again = Store(spark, str(tmp_path / name), paging.TABLES)
        paging.crawl(again, seeds, paging.fetched_by(page), limit)
        assert held(again) == sorted((q, k, f'{{"id":{k}}}') for q, n in sizes.items() for k in range(n if limit is None else min(n, limit)))
        assert paging.crawl(again, seeds, paging.fetched_by(broken), limit) == 0
    with pytest.raises(PermissionError):
        paging.fetched_by(by_page, payloads.Access())


def test_pages_open_cursors_below_their_items(spark, tmp_path):
    def fetch(query, parent, cursor, wanted):
        if parent is None:
            return {"items": [{"id": "x"}, {"id": "y"}], "next": None, "children": [{"parent": "x", "cursor": None}, {"parent": "y", "cursor": "9"}]}
        return {"items": [{"of": parent, "at": cursor}], "next": "1" if cursor is None else None}

    store = Store(spark, str(tmp_path / "crawl"), paging.TABLES)
    paging.crawl(store, spark.createDataFrame([("q", None)], "query string, cursor string"), paging.fetched_by(fetch))
    got = sorted((r.parent or "", r.position, json.loads(r.payload)) for r in store.read("items").collect())
    assert got == [("", 0, {"id": "x"}), ("", 1, {"id": "y"}), ("x", 0, {"of": "x", "at": None}), ("x", 1, {"of": "x", "at": "1"}), ("y", 0, {"of": "y", "at": "9"})]


def test_delimited_files_by_many_tasks(spark, tmp_path):
    """Line ends, quotes and separators in quoted cells, with a block's edge at every place of the file."""
    rng = random.Random(3)
    plain, quoted = ["plain", "", "x" * 30, " pad "], ["a,b", "line\nend", 'say ""hi""', '""', "\n\n", "é\r\nü", "plain", ""]
    body = '\ufeffid,name,"two\nlines",d\n'
    for k in range(60):
        cells = [rng.choice(plain) if rng.random() < 0.4 else f'"{rng.choice(quoted)}"' for _ in range(3)]
        body += ",".join([f"k{k}", *cells]) + rng.choice(["\n", "\n\n"])
    path = tmp_path / "in"
    path.mkdir()
    (path / "f.csv").write_bytes(body.encode())
    want = catalog_files.read_delimited(spark, str(path / "f.csv"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for size in (7, 50, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            got = delimited.read_delimited_parts(spark, str(path / "f.csv"))
            assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
            tasks = spark.read.option("lineSep", "\n").text(str(path)).rdd.getNumPartitions()
            assert tasks > (100 if size == 7 else 1)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    (path / "f.csv").write_bytes(b'a,b\n1,"open\nand so on\n')
    assert [tuple(r)[0] for r in delimited.read_delimited_parts(spark, str(path)).collect()] == ["1"]
    (path / "f.csv").write_bytes(b"")
    assert delimited.read_delimited_parts(spark, str(path)).count() == 0
    (path / "f.csv").write_bytes(b"a,b\r\n1,2\r\n")
    (path / "g.csv").write_bytes(b"a,b\n3,4")
    assert sorted(map(tuple, delimited.read_delimited_parts(spark, str(path)).collect())) == [("1", "2"), ("3", "4")]


def test_small_blocks_are_read_by_few_tasks(spark, tmp_path):
    """A task reads many blocks, one after the other, and records go on over Arrow batches and blocks."""
    rng = random.Random(4)
    cells = ["plain", '"a,b"', '"line\nend"', '"' + "\n" * 9 + '"', '"say ""hi"""', '"x\r\ny"', ""]
    for name in ("f", "g"):
        (tmp_path / f"{name}.csv").write_bytes("".join(["id,note\n", *(f"{name}{k},{rng.choice(cells)}\n" for k in range(300))]).encode())
    want = Counter(tuple(r) for name in ("f", "g") for r in catalog_files.read_delimited(spark, str(tmp_path / f"{name}.csv")).collect())
    changed = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "0", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    kept = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        blocks = spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions()
        tasks = delimited.read_records(spark, str(tmp_path)).filter("NOT leads").rdd.getNumPartitions()
        assert 2 * tasks < blocks
        assert Counter(map(tuple, delimited.read_delimited_parts(spark, str(tmp_path)).collect())) == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    records = pa.array(["x" * 700_000, "", "y" * 700_000, "z" * 3_000_000, "w"])
    parts = delimited._parts(records)
    assert pa.concat_arrays(parts).equals(records) and len(parts) > 2


def test_long_documents_are_read_whole(spark, tmp_path):
    """A document over the extractor's limit is read piece by piece, no line cut where it has line ends."""
    lines = [f"X{n}|item number {n}" for n in range(200)]
    (tmp_path / "long.txt").write_text("\n".join(lines) + "\n" + "y" * 250)
    seen = lambda piece: [{"supplier_sku": a, "name": b} for a, _, b in (x.partition("|") for x in piece.splitlines())] if len(piece) <= 100 else []
    found = catalog_files.extract_documents(spark, str(tmp_path / "long.txt"), seen, chars=100)
    assert sorted(f"{r.supplier_sku}|{r.name}" for r in found.collect()) == sorted(lines)
