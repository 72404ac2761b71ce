"""Column builders on small rows."""

import hashlib
import hmac
import math

import pytest
from pyspark.sql import functions as F

from procurespark.functions import scoring, signatures, text, vectors


def values(spark, rows, *columns, schema="x string"):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("raw", "want"),
    [("PCR", "molecular_biology"), (" qPCR ", "molecular_biology"), ("molecular biology", "molecular_biology"), ("Plasticware", "consumables"), ("Lab / Bench -- X", "lab_bench_x"), ("", "uncategorized"), (None, "uncategorized")],
)
def test_category(spark, raw, want):
    assert values(spark, [(raw,)], text.canonical_category(F.col("x"))) == [(want,)]


def test_canonical_text(spark):
    rows = [("Acme", "Taq", "pcr", {"b": "2", "a": "1"}), (None, "Taq", "pcr", None), ("", "Taq", "", {})]
    got = values(spark, rows, text.canonical_text(*map(F.col, "abcd")), schema="a string, b string, c string, d map<string,string>")
    assert got == [("Acme | Taq | pcr | a=1 | b=2",), ("Taq | pcr",), ("Taq",)]


def test_strings(spark):
    got = values(
        spark,
        [("T4-DNA/Ligase  x",), (None,), ("",)],
        text.normalize_material(F.col("x")), text.slug(F.col("x")),
    )
    assert got == [("t4 dna ligase x", "t4-dna-ligase-x"), ("", "q"), ("", "q")]
    assert one(spark, text.strip_html(F.lit("<b>DNA</b> &amp; RNA<br/>\x00"))) == "DNA  & RNA "  # the NUL goes last
    assert one(spark, text.strip(F.lit("　\u2003 Taq\xa0 mix\u2028"))) == "Taq\xa0 mix" and one(spark, text.normalize_material(F.lit("Taq　\xa0DNA"))) == "taq dna"
    assert one(spark, vectors.tokens(F.lit("a　b\u2009c\xa0"))) == ["a", "b", "c"]
    assert one(spark, text.gid_tail(F.lit("gid://shop/Variant/22"))) == "22"
    assert one(spark, text.product_sku(F.lit("7f3a21bc-0000-4000-8000-000000000000"))) == "ASR-7F3A21"
    assert one(spark, text.search_url(F.lit("a b*~é"))) == "/search?q=a%20b%2A~%C3%A9"
    assert one(spark, text.public_specs(F.create_map(F.lit("_cost_basis"), F.lit("x"), F.lit("size"), F.lit("1")))) == {"size": "1"}
    assert one(spark, text.protocol_label(F.lit("T"), F.lit("Ann"))) == "T (Ann)" and one(spark, text.protocol_label(F.lit("T"), F.lit(""))) == "T"
    assert one(spark, text.author_name(F.lit("Ann"), F.lit(None), F.lit("n"), F.lit("u"))) == "Ann" and one(spark, text.author_name(F.lit(""), F.lit(None), F.lit(None), F.lit("u"))) == "u"


@pytest.mark.parametrize(
    ("raw", "want"),
    [("dx.doi.org/10.9/own.abc/v3", "10.9/own.abc"), ("HTTPS://doi.org/10.1/x", "10.1/x"), (" 10.1/X ", "10.1/X"), ("https://doi.org/", None), (None, None), ("", None)],
)
def test_doi(spark, raw, want):
    assert values(spark, [(raw,)], text.normalize_doi(F.col("x"))) == [(want,)]


def test_licenses(spark):
    rows = [("CC BY",), (" cc0",), ("arr",), ("cc by-sa",), (None,), ("?",)]
    assert values(spark, rows, text.license_of(F.col("x")), text.license_of(F.col("x"), text.LITERATURE_LICENSES)) == [
        ("CC-BY", "CC-BY"), ("CC0", "CC0"), ("all-rights-reserved", "unknown"), ("unknown", "CC-BY-SA"), ("unknown", "unknown"), ("unknown", "unknown"),
    ]


def test_rich_text(spark):
    rows = [('{"blocks":[{"text":" a "},{"text":""},{"text":"b"}]}',), (" plain ",), ("{broken",), (None,), ('{"blocks":[]}',), ("{}",)]
    assert values(spark, rows, text.rich_text(F.col("x"))) == [("a\nb",), ("plain",), ("{broken",), ("",), ("",), ("",)]


def product(**k):
    fields = {"category": "", "brand": None, "mpn": None, "specs": None} | k
    specs = fields["specs"]
    pairs = F.create_map(*(F.lit(x) for kv in specs.items() for x in kv)) if specs else F.lit(None)
    return F.struct(*(F.lit(fields[c]).cast("string").alias(c) for c in ("category", "brand", "mpn")), pairs.cast("map<string,string>").alias("specs"))


def test_bonus(spark):
    a = product(category="c", brand="B", mpn="M", specs={"x": "Yes", "y": "1"})
    assert one(spark, scoring.attribute_bonus(a, a)) == pytest.approx(0.65)
    assert one(spark, scoring.attribute_bonus(a, product(category="c", brand="b", mpn="M", specs={"x": "YES", "y": "2", "z": "3"}))) == pytest.approx(0.10)
    assert one(spark, scoring.attribute_bonus(product(), product())) == 0.0


def test_confidence_and_kinds(spark):
    rows = [(0.97, 0.0), (0.81, 0.0), (0.33, 0.0), (-1.0, 0.1), (float("nan"), 0.2), (0.9, 0.5), (None, 0.0)]
    score = scoring.confidence(F.col("s"), F.col("b"))
    got = values(spark, rows, score, scoring.classify(score), schema="s double, b double")
    assert got == [(0.97, "exact"), (0.81, "substitute"), (0.33, None), (0.1, None), (0.2, None), (1.0, "exact"), (0.0, None)]


def test_landed_cost(spark):
    row = one(spark, scoring.landed_cost(F.lit(50.0), F.lit("CNY"), F.lit("antibodies"), 3))
    assert row.asDict() == {"currency": "USD", "qty": 3, "ex_works": 7.0, "tariff": 1.4, "duty_rate": 0.2, "freight": 1.5, "margin": 1.98, "unit_price": 11.88, "line_total": 35.64}
    assert one(spark, scoring.landed_cost(F.lit(10.0), F.lit("USD"), F.lit("other"))).duty_rate == 0.27


@pytest.mark.parametrize(
    ("review", "want"),
    [((9, 5.0, 10, 1, 1, 1, 1, 1), 10 * math.log(10)), ((0, None, None, 9, 9, 9, 9, 9), 0.0), ((None, 4.0, 3, 1, 1, 1, 1, 1), 4 * math.log(4)), ((None, 4.0, 0, 100, 2, 3, 4, 5), 9 + 8 + 4 + 5 + 1), ((None,) * 8, 0.0)],
)
def test_rank_score(spark, review, want):
    names = "citations long, rating double, ratings_count long, views long, votes long, bookmarks long, forks long, comments long"
    assert spark.createDataFrame([review], names).select(scoring.rank_score(F.struct("*"))).first()[0] == pytest.approx(want)


def test_gate(spark):
    rows = [(0.92, 0.77, 0.33), (0.71, 0.9, 0.2), (0.99, 0.9, 0.41), (0.93, None, 0.0)]
    got = values(spark, rows, scoring.gate_reasons(*map(F.col, "pke")), schema="p double, k double, e double")
    assert got == [([],), (["precision"],), (["exact_rate"],), (["kind_accuracy"],)]


def test_vectors(spark):
    rows = [([1.0, 0.0], [0.0, 1.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])]
    assert [round(v, 9) for (v,) in values(spark, rows, vectors.cosine(F.col("a"), F.col("b")), schema="a array<double>, b array<double>")] == [0, 1, 0]
    want = [0.0] * 1024
    for t in ("taq", "dna", "taq"):
        want[int(hashlib.sha1(t.encode()).hexdigest(), 16) % 1024] += 1
    length = math.sqrt(sum(x * x for x in want))
    got = values(spark, [("Taq  DNA taq",), ("",)], vectors.hash_embedding(F.col("x")))
    assert got[0][0] == pytest.approx([x / length for x in want]) and set(got[1][0]) == {0.0}


def test_staleness(spark):
    digest = hashlib.sha256(b"t").hexdigest()
    rows = [("m", digest), ("old", digest), ("m", "x"), (None, digest), ("m", None)]
    assert values(spark, rows, vectors.is_stale(F.col("m"), F.col("h"), "m", F.lit("t")), schema="m string, h string") == [(False,), (True,), (True,), (True,), (True,)]


def test_signatures(spark):
    items = [("b", "2"), ("a", "1"), ("b", "3")]
    digest = hmac.new(b"s", b"a=1b=2,3", hashlib.sha256).hexdigest()
    rows = [([*items, ("signature", digest)],), ([*items, ("signature", "")],), (items,), ([*items, ("signature", "é")],), ([("a", "2"), ("signature", digest)],)]
    got = values(spark, rows, signatures.valid_signature(F.col("p"), "s"), schema="p array<struct<key:string,value:string>>")
    assert [v for (v,) in got] == [True, False, False, False, False]


def test_sparse_embedding_in_slices(spark, monkeypatch):
    """Rows beyond a slice get the weights that one slice of all gives; a slice holds no more rows than it may."""
    docs = spark.createDataFrame([(k, f"a b{k % 3} a c{k}") for k in range(50)], "id long, t string").coalesce(1)
    whole = {tuple(r) for r in vectors.sparse_embedding(docs, "id", "t").collect()}
    monkeypatch.setattr(vectors, "ROWS", 7)
    import pyarrow as pa

    held = [["a", f"b{k % 3}", "a", f"c{k}"] for k in range(50)]
    parts = set()
    for x in range(0, 50, vectors.ROWS):
        row, slot, weight = vectors._weights(pa.array(held).slice(x, vectors.ROWS))
        parts |= {(int(r) + x, int(s), float(w)) for r, s, w in zip(row, slot, weight, strict=True)}
    assert parts == whole
