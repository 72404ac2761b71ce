"""Protocol payloads of two services as rows of one shape, and the store of raw JSON."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procurespark.functions.text import LITERATURE_LICENSES, author_name, filled, license_of, lookup, normalize_doi, rich_text, slug, strip, strip_html, UNKNOWN_LICENSE
from procurespark.schemas import MATERIALS, RAW_PROTOCOL, STEPS, conformed

#: Short search terms of known categories.
SEARCH_TERMS = {
    "western_blot": ["western blot", "immunoblot"],
    "rt_qpcr": ["rt-qpcr", "qpcr", "real-time PCR"],
    "elisa": ["elisa"],
    "cell_culture_transfection": ["transfection", "cell culture"],
    "protein_purification": ["protein purification", "affinity purification", "affinity chromatography"],
    "immunoprecipitation": ["immunoprecipitation", "co-immunoprecipitation", "chromatin immunoprecipitation"],
    "enzyme_inhibitor_assay": ["enzyme", "inhibitor", "protease", "kinase"],
    "nucleic_acid_extraction": ["DNA extraction", "RNA extraction", "plasmid extraction"],
    "cloning_protein_expression": ["molecular cloning", "protein expression", "gibson assembly"],
}
ALIASES = {"protocols.io": "protocols.io", "protocolsio": "protocols.io", "pio": "protocols.io", "europepmc": "europepmc", "epmc": "europepmc", "pmc": "europepmc"}


@dataclass(frozen=True)
class Access:
    """What a connector needs before it may go to the network."""

    allow_network: bool = False
    licensed: bool = False
    token: str | None = None

    def require(self) -> None:
        missing = [name for name, held in (("allow_network", self.allow_network), ("licensed", self.licensed), ("token", self.token)) if not held]
        if missing:
            raise PermissionError(f"network access needs {', '.join(missing)}")


def source_name(name: str) -> str:
    """A source by one of its names."""
    try:
        return ALIASES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown protocol source {name!r}") from None


def source_column(name: Column) -> Column:
    """Sources by one of their names, null where there is no such name."""
    return lookup(ALIASES, F.lower(strip(name)), F.lit(None).cast("string"))


def _at(payload: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(payload, path, kind)


def _is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def _string_or(v: Column, path: str, key: str) -> Column:
    """A field that is a string, or an object with the string under ``key``."""
    return F.when(_is_object(_at(v, path, "variant")), _at(v, f"{path}.{key}")).otherwise(_at(v, path))


def _counter(v: Column, path: str) -> Column:
    """A whole number, or an object of numbers to be summed; booleans and others are null."""
    held = _at(v, path, "variant")
    kind = F.schema_of_variant(held)
    parts = F.filter(F.map_values(_at(v, path, "map<string,variant>")), lambda x: F.schema_of_variant(x) == "BIGINT")
    summed = F.when(F.size(parts) > 0, F.aggregate(F.transform(parts, lambda x: F.try_variant_get(x, "$", "bigint")), F.lit(0).cast("long"), lambda s, x: s + x))
    return F.when(kind == "BIGINT", _at(v, path, "bigint")).when(F.startswith(kind, F.lit("OBJECT")), summed)


def _flag(text: Column) -> Column:
    return F.when(F.lower(text).isin("true", "1"), True).when(text.isNotNull(), False)


def item_review(item: Column) -> Column:
    """What a search item (a variant) says of its reception."""
    stat = lambda name: _counter(item, f"$.stats.{name}")
    return F.struct(
        F.lit(None).cast("long").alias("citations"), F.lit(None).cast("double").alias("rating"), F.lit(None).cast("long").alias("ratings_count"),
        stat("number_of_views").alias("views"), stat("number_of_votes").alias("votes"), stat("number_of_bookmarks").alias("bookmarks"), stat("number_of_forks").alias("forks"),
        # A counter of 0 counts as missing where another may stand in.
        F.coalesce(F.nullif(stat("number_of_protocol_comments"), F.lit(0)), stat("number_of_comments")).alias("comments"),
        _flag(_at(item, "$.peer_reviewed")).alias("peer_reviewed"),
    )


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns that are computed once for each row.

    The optimizer merges projections, and so repeats an expression wherever a later one uses it; it doesn't
    merge them over a generator.
    """
    return df.withColumn("_once", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))).select("*", "_once.*").drop("_once")


def map_protocol_service(details: DataFrame, search_items: DataFrame | None = None, payload: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """Detail payloads (JSON strings) as protocols; rows whose JSON can't be read are left out.

    ``search_items`` (payloads too) lend their peer review flag, which details lack; of several
    with one id the last by ``position`` holds. Columns in ``keep`` come along. Each payload is parsed once, its fields
    are taken out once, and only then are they cleaned.
    """
    keep = keep or []
    parsed = once(details.select(payload, *(k for k in keep if k != payload)), _p=F.try_parse_json(F.col(payload))).filter(F.col("_p").isNotNull())
    p = F.col("_p")
    variants = lambda path: F.filter(F.coalesce(_at(p, path, "array<variant>"), F.array().cast("array<variant>")), _is_object)
    field = lambda v, *names: [_at(v, f"$.{n}").alias(n) for n in names]
    person_fields = ("first_name", "last_name", "name", "username")
    all_steps = F.coalesce(_at(p, "$.steps", "array<variant>"), F.array().cast("array<variant>"))
    taken = once(
        parsed,
        _id=_at(p, "$.id"), _uri=F.coalesce(_at(p, "$.uri"), F.lit("")), _url=_at(p, "$.url"), _title=_at(p, "$.title"), _doi=_at(p, "$.doi"), _reserved=_at(p, "$.reserved_doi"), _version=_at(p, "$.version_id"),
        _license=_string_or(p, "$.license", "title"), _text=_at(p, "$.materials_text"), _reviewed=_at(p, "$.peer_reviewed"), _review=item_review(p),
        _materials=F.transform(variants("$.materials"), lambda m: F.struct(*field(m, "name", "amount", "quantity", "catalog", "sku"), _string_or(m, "$.vendor", "name").alias("vendor"))),
        _steps=F.transform(all_steps, lambda s: F.struct(*field(s, "step", "section"))),
        _authors=F.transform(variants("$.authors"), lambda a: F.struct(*field(a, *person_fields))),
        _creator=F.struct(*field(_at(p, "$.creator", "variant"), *person_fields)),
    ).drop("_p")
    if search_items is not None:
        items = once(search_items.select(payload, "position"), _i=F.try_parse_json(F.col(payload)))
        items = items.select(_at(F.col("_i"), "$.id").alias("_item_id"), _at(F.col("_i"), "$.peer_reviewed").alias("_item_reviewed"), "position").filter(F.col("_item_id").isNotNull())
        last = items.groupBy("_item_id").agg(F.max_by(F.struct("_item_reviewed"), "position").alias("_last"))
        taken = taken.join(last, F.col("_id") == F.col("_item_id"), "left").withColumn("_listed", F.col("_last._item_reviewed"))
    else:
        taken = taken.withColumn("_listed", F.lit(None).cast("string"))

    stated = F.filter(
        F.transform(
            "_materials",
            lambda m: F.struct(strip(F.coalesce(m["name"], F.lit(""))).alias("name"), F.coalesce(filled(m["amount"]), m["quantity"]).alias("amount"), m["vendor"].alias("vendor"), F.coalesce(filled(m["catalog"]), m["sku"]).alias("catalog_no")),
        ),
        lambda m: m["name"] != "",
    ).cast(MATERIALS)
    none = F.lit(None).cast("string")
    person = lambda a: author_name(*(a[n] for n in person_fields))
    made = once(
        taken,
        _stated=stated,
        _lines=F.filter(F.transform(F.split(rich_text(F.col("_text")), r"\r\n|\r|\n"), strip), lambda t: t != ""),
        _made=F.transform("_steps", lambda s, i: F.struct((i + 1).alias("number"), F.coalesce(filled(rich_text(s["step"])), strip_html(s["section"])).alias("text"))),
        _people=F.filter(F.transform("_authors", person), lambda n: n != ""), _by=person(F.col("_creator")),
    )
    listed = F.transform("_lines", lambda t: F.struct(t.alias("name"), none.alias("amount"), none.alias("vendor"), none.alias("catalog_no"))).cast(MATERIALS)
    kinds = dict(details.dtypes)
    return conformed(
        made.select(
            F.lit("protocols.io").alias("source"),
            F.coalesce(filled(F.nullif("_id", F.lit("0"))), F.col("_uri")).alias("source_id"),
            F.coalesce(filled(F.col("_url")), F.concat(F.lit("https://www.protocols.io/view/"), F.col("_uri"))).alias("source_uri"),
            strip_html(F.col("_title")).alias("title"),
            F.when(F.size("_people") > 0, F.col("_people")).when(F.col("_by") != "", F.array("_by")).otherwise(F.array().cast("array<string>")).alias("authors"),
            normalize_doi(F.coalesce(filled(F.col("_doi")), F.col("_reserved"))).alias("doi"),
            F.col("_version").alias("version"),
            license_of(F.col("_license")).alias("license"),
            F.filter("_made", lambda s: s["text"] != "").cast(STEPS).alias("steps"),
            F.when(F.size("_stated") > 0, F.col("_stated")).otherwise(listed).alias("materials"),
            F.col("_review").withField("peer_reviewed", _flag(F.coalesce("_reviewed", "_listed"))).alias("review"),
            *keep,
        ),
        ", ".join([RAW_PROTOCOL, *(f"{c} {kinds[c]}" for c in keep)]),
    )


def map_literature_service(results: DataFrame, payload: str = "payload") -> DataFrame:
    """Article results (JSON strings) as protocols without steps or materials."""
    parsed = results.select(F.try_parse_json(F.col(payload)).alias("p")).filter(F.col("p").isNotNull())
    p = F.col("p")
    people = F.filter(F.transform(F.filter(F.coalesce(_at(p, "$.authorList.author", "array<variant>"), F.array().cast("array<variant>")), _is_object), lambda a: _at(a, "$.fullName")), lambda n: filled(n).isNotNull())
    people = F.transform(people, strip)
    split = F.filter(F.transform(F.split(F.coalesce(_at(p, "$.authorString"), F.lit("")), ","), strip), lambda n: n != "")
    own = F.coalesce(filled(_at(p, "$.id")), filled(_at(p, "$.pmcid")), filled(_at(p, "$.pmid")), F.lit(""))
    doi = _at(p, "$.doi")
    uri = F.when(own != "", F.concat(F.lit("https://europepmc.org/article/"), F.upper(F.coalesce(filled(_at(p, "$.source")), F.lit("MED"))), F.lit("/"), own)).when(filled(doi).isNotNull(), F.concat(F.lit("https://doi.org/"), doi)).otherwise("")
    review = F.named_struct(F.lit("citations"), _at(p, "$.citedByCount", "bigint"), *(x for n, k in (("rating", "double"), ("ratings_count", "long"), ("views", "long"), ("votes", "long"), ("bookmarks", "long"), ("forks", "long"), ("comments", "long"), ("peer_reviewed", "boolean")) for x in (F.lit(n), F.lit(None).cast(k))))
    return conformed(
        parsed.select(
            F.lit("europepmc").alias("source"), own.alias("source_id"), uri.alias("source_uri"),
            F.rtrim(strip(F.coalesce(_at(p, "$.title"), F.lit(""))), F.lit(".")).alias("title"),
            F.when(F.size(people) > 0, people).otherwise(split).alias("authors"), doi.alias("doi"),
            lookup(LITERATURE_LICENSES, F.lower(strip(F.coalesce(_at(p, "$.license"), F.lit("")))), UNKNOWN_LICENSE).alias("license"),
            F.array().cast(STEPS).alias("steps"), F.array().cast(MATERIALS).alias("materials"), review.alias("review"),
        ),
        RAW_PROTOCOL,
    )


# The raw store: details by id and version, search pages by category and query.


def write_details(details: DataFrame, root: str) -> None:
    """Adds ``id, version, payload`` rows to the store."""
    details.select("id", "version", "payload").write.mode("append").json(f"{root}/details")


def read_details(spark: SparkSession, root: str) -> DataFrame:
    """Details in the store; of repeated writes of one version, one."""
    return spark.read.schema("id string, version string, payload string").json(f"{root}/details").dropDuplicates(["id", "version"])


def write_manifest(manifest: DataFrame, root: str, name: str = "manifest") -> None:
    """The one row about a run."""
    manifest.coalesce(1).write.mode("overwrite").json(f"{root}/{name}")


def missing_details(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``wanted`` whose id and version aren't in the store."""
    return wanted.join(stored.select("id", "version"), ["id", "version"], "left_anti")


def write_search_page(items: DataFrame, root: str, category: str, query: str, page: int) -> None:
    """A page of search items, with their order."""
    name = items.sparkSession.range(1).select(slug(F.lit(query))).first()[0]
    items.select("position", "payload").write.mode("overwrite").json(f"{root}/searches/{category}/{name}-p{page}")


def read_search_items(spark: SparkSession, root: str) -> DataFrame:
    """All items of all pages; ``position`` orders them by page path and place."""
    raw = spark.read.schema("position long, payload string").option("recursiveFileLookup", True).json(f"{root}/searches")
    return raw.select(F.struct(F.col("_metadata.file_path").alias("path"), "position").alias("position"), "payload")


def category_seeds(rows: DataFrame, category: str | None = None) -> DataFrame:
    """``category_id, category_name, queries``: terms of known categories, else the name before a slash, else the id.

    With ``category`` the seeds of that id alone; if there are none, that is an error.
    """
    if category is not None:
        rows = rows.filter(strip(F.col("category_id")) == category)
        if rows.isEmpty():
            raise LookupError(f"no category {category!r}")
    cid, name = strip(F.coalesce("category_id", F.lit(""))), strip(F.coalesce("category_name", F.lit("")))
    pairs = F.create_map(*(x for k, v in SEARCH_TERMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    fallback = F.coalesce(filled(strip(F.get(F.split(name, "/"), F.lit(0)))), cid)
    return rows.filter(cid != "").select(cid.alias("category_id"), name.alias("category_name"), F.coalesce(F.try_element_at(pairs, cid), F.array(fallback)).alias("queries"))
