"""Equivalent products and the products that protocols' materials stand for."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procurespark.functions.scoring import MATERIAL_THRESHOLDS, PRODUCT_THRESHOLDS, Thresholds, attribute_bonus, classify, confidence
from procurespark.functions.text import filled, looks_like_kit, strip
from procurespark.functions.vectors import hash_embedding, is_stale
from procurespark.operators.knn import nearest
from procurespark.operators.snapshots import Store, bucket_of, unit_of_work
from procurespark.schemas import MATERIALS
from procurespark.storage import checkpointed, new_path

METHOD = "vector+rules"
#: What a line of materials can be.
ROLES = ["kit", "reagent", "consumable", "equipment", "buffer_component", "not_a_material"]
PURCHASABLE = ["kit", "reagent", "consumable"]
#: A broadcast is made on the driver, so what takes up more is shuffled.
BROADCAST_BYTES = 4_000_000
#: Rows that can't meet any are dealt to so many places of a join.
SPREAD = 1024


def _view(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(F.col("id").alias(f"{prefix}_id"), F.struct("category", "name", "brand", "mpn", "specs").alias(prefix))


def scored_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``query_id, id, distance`` with both product structs and ``confidence``."""
    met = pairs.join(_view(left, "a"), F.col("query_id") == F.col("a_id")).join(_view(right, "b"), F.col("id") == F.col("b_id"))
    return met.withColumn("confidence", confidence(1.0 - F.col("distance"), attribute_bonus(F.col("a"), F.col("b"))))


def equivalences(neighbours: DataFrame, products: DataFrame, thresholds: Thresholds = PRODUCT_THRESHOLDS) -> DataFrame:
    """Directed edges from each product to those of its neighbours that are exact or a substitute."""
    scored = scored_pairs(neighbours, products, products).withColumn("kind", classify(F.col("confidence"), thresholds))
    return scored.filter(F.col("kind").isNotNull()).select(F.col("query_id").alias("product_id"), F.col("id").alias("equivalent_id"), "confidence", "kind", F.lit(METHOD).alias("method"))


def sample_exact_rate(neighbours: DataFrame, products: DataFrame, sample: int | None = 500, seed: int = 42) -> DataFrame:
    """One row: the share of ``sample`` random products (all, if None) with an exact candidate; 0 without products.

    The sample is that of the smallest hashes of id and ``seed``, the same however the rows are dealt.
    """
    chosen = products if sample is None else products.orderBy(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(seed).cast("string"))), "id").limit(sample)
    chosen = chosen.select(F.col("id").alias("query_id"))
    exact = equivalences(neighbours, products).filter("kind = 'exact'").select(F.col("product_id").alias("query_id")).distinct().withColumn("hit", F.lit(1.0))
    return chosen.join(exact, "query_id", "left").agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0.0))), F.lit(0.0)).alias("sample_exact_rate"))


def structured_materials(protocols: DataFrame) -> DataFrame:
    """Materials that name a vendor or catalog number, classified by name with certainty."""
    kept = F.filter("materials", lambda m: filled(m["vendor"]).isNotNull() | filled(m["catalog_no"]).isNotNull())
    role = lambda m: F.when(looks_like_kit(m["name"]), "kit").otherwise("reagent")
    return protocols.withColumn("materials", F.transform(kept, lambda m: F.struct(m["name"].alias("name"), m["amount"].alias("amount"), m["vendor"].alias("vendor"), m["catalog_no"].alias("catalog_no"), role(m).alias("role"), F.lit(1.0).alias("confidence"))))


def procurement_filter(materials: DataFrame, least: float = 0.5) -> DataFrame:
    """Classified lines that a lab could order."""
    return materials.filter(F.col("role").isin(*PURCHASABLE) & (F.col("confidence") >= least))


def material_lines(protocols: DataFrame) -> DataFrame:
    """``protocol_id, position, name, vendor, catalog_no``: one line for each name of a protocol, case aside, the first."""
    lines = protocols.select(F.col("id").alias("protocol_id"), F.posexplode("materials").alias("position", "m"))
    lines = lines.select("protocol_id", "position", strip(F.coalesce("m.name", F.lit(""))).alias("name"), F.col("m.vendor").alias("vendor"), F.col("m.catalog_no").alias("catalog_no")).filter("name <> ''")
    first = lines.groupBy("protocol_id", F.lower("name").alias("_key")).agg(F.min_by(F.struct("position", "name", "vendor", "catalog_no"), "position").alias("_line"))
    return first.select("protocol_id", "_line.*")


def _sized(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its rows take up at most BROADCAST_BYTES, else for a sort-merge join.

    It is written down and measured, as Spark's estimates come from the size of compressed files, which may be far below.
    """
    held = checkpointed(df)
    width = F.lit(16 * len(held.columns) + 16)
    for name, kind in held.dtypes:
        if kind == "string":
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
    size = held.agg(F.sum(width).alias("n")).first()["n"] or 0
    return F.broadcast(held) if size <= BROADCAST_BYTES else held.hint("merge")


def catalog_hits(lines: DataFrame, products: DataFrame, how: str = "inner") -> DataFrame:
    """Lines whose vendor and catalog number name a product, case aside; of several the one with the lowest id.

    With ``how="left"`` all lines come back, with a null ``product_id`` where there is none.
    """
    known = products.select(F.lower("brand").alias("_b"), F.lower("mpn").alias("_m"), F.col("id").alias("product_id")).dropna().groupBy("_b", "_m").agg(F.min("product_id").alias("product_id"))
    both = filled(F.col("vendor")).isNotNull() & filled(F.col("catalog_no")).isNotNull()
    keyed = (lines.filter(both) if how == "inner" else lines).withColumn("_b", F.when(both, F.lower(strip(F.col("vendor"))))).withColumn("_m", F.when(both, F.lower(strip(F.col("catalog_no")))))
    # Lines without both meet nothing; were the join shuffled, they would all be one task's.
    keyed = keyed.withColumn("_s", F.when(both, 0).otherwise(F.pmod(F.xxhash64("protocol_id", "name"), F.lit(SPREAD)).cast("int")) if how == "left" else F.lit(0))
    return keyed.join(_sized(known.withColumn("_s", F.lit(0))), ["_b", "_m", "_s"], how).drop("_b", "_m", "_s")


def embedding_candidates(products: DataFrame, embed: Callable[[Column], Column] = hash_embedding, k: int = 20, text: Column | None = None) -> Callable[[DataFrame], DataFrame]:
    """Candidates for ``match_materials``: the products nearest to each different name.

    ``products`` have ``embedding``; ids are whole numbers or strings. With ``text``, they are embedded by it instead, each different text
    once: it stands for its k smallest ids, which are all that a list can hold of it.
    """

    def candidates(lines: DataFrame) -> DataFrame:
        keyed = lines.withColumn("_q", F.xxhash64("name"))
        asked = keyed.select("_q", "name").distinct().select(F.col("_q").alias("_n"), embed(F.col("name")).alias("embedding"))
        number = F.col("id") if dict(products.dtypes)["id"] == "bigint" else F.xxhash64("id")
        # Sides as large as the catalog or the lines are for sort-merge joins: Spark would broadcast them by the size of their files.
        if text is None:
            held = products.select(number.alias("_n"), F.col("id").alias("product_id"), "embedding")
            found = nearest(asked, held, k, "_n", skip_self=False).join(held.select(F.col("_n").alias("id"), "product_id").hint("merge"), "id")
        else:
            held = products.select(number.alias("_n"), F.col("id").alias("product_id"), text.alias("_text"))
            first = checkpointed(held.withColumn("_k", F.row_number().over(Window.partitionBy("_text").orderBy("_n"))).filter(F.col("_k") <= k))
            kinds = checkpointed(first.filter("_k = 1").select(F.col("_n").alias("id"), "_text"))
            met = nearest(asked, kinds.select(F.col("id").alias("_n"), embed(F.col("_text")).alias("embedding")), k, "_n", skip_self=False)
            of_text = first.select("_text", F.col("_n").alias("id"), "product_id")
            spread = met.drop("rank").join(kinds.hint("merge"), "id").drop("id").join(of_text.hint("merge"), "_text").drop("_text")
            found = spread.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).filter(F.col("rank") <= k)
        return keyed.hint("merge").join(found.select(F.col("query_id").alias("_q"), "product_id", "distance", "rank"), "_q").drop("_q")

    return candidates


def match_materials(lines: DataFrame, products: DataFrame, candidates: Callable[[DataFrame], DataFrame], thresholds: Thresholds = MATERIAL_THRESHOLDS) -> DataFrame:
    """Links of protocols to products: catalog identity first, the best candidate for the rest.

    ``candidates`` takes the different lines (``name, vendor, catalog_no``) without a catalog hit
    and returns them with ``product_id``, ``distance`` and ``rank``; only those are embedded,
    searched and scored, however many protocols have them. Lines are made once: they go to a folder of this run below the
    shared one, with their catalog hits, and the result is read from there. Only what was measured to be small is broadcast.
    """
    spark, of_line = lines.sparkSession, ["name", "vendor", "catalog_no"]
    path = new_path(spark, "material-lines")
    catalog_hits(lines.select("protocol_id", *of_line), products, "left").write.parquet(f"{path}/lines")
    told = spark.read.parquet(f"{path}/lines")
    hits = told.filter(F.col("product_id").isNotNull()).select("protocol_id", "product_id", F.col("name").alias("material_name"), F.lit(1.0).alias("confidence"), F.lit("exact").alias("kind"), F.lit("catalog").alias("method"))
    rest = told.filter(F.col("product_id").isNull()).drop("product_id")
    rest.select(*of_line).distinct().write.parquet(f"{path}/kinds")
    found = candidates(spark.read.parquet(f"{path}/kinds")).join(_view(products, "b").hint("merge"), F.col("product_id") == F.col("b_id"))
    own = F.struct(F.lit("").alias("category"), F.col("name").alias("name"), F.col("vendor").alias("brand"), F.col("catalog_no").alias("mpn"), F.create_map().cast("map<string,string>").alias("specs"))
    scored = found.withColumn("confidence", confidence(1.0 - F.col("distance"), attribute_bonus(own, F.col("b")))).withColumn("kind", classify(F.col("confidence"), thresholds)).filter(F.col("kind").isNotNull())
    best = scored.groupBy(*of_line).agg(F.max_by(F.struct("product_id", "confidence", "kind"), F.struct("confidence", -F.col("rank"))).alias("_best"))
    best = _sized(best.select(*(F.col(c).alias(f"_{c}") for c in of_line), "_best.*"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in of_line]
    chosen = rest.join(best, same[0] & same[1] & same[2])
    return hits.unionByName(chosen.select("protocol_id", "product_id", F.col("name").alias("material_name"), F.round("confidence", 4).alias("confidence"), "kind", F.lit(METHOD).alias("method")))


def embed_missing(products: DataFrame, embed: Callable, text: Callable) -> DataFrame:
    """Fills vectors that are null and leaves provenance alone, so they stay stale."""
    return products.withColumn("embedding", F.when(F.col("embedding").isNull(), embed(text())).otherwise(F.col("embedding")))


def backfill(products: DataFrame, model: str, embed: Callable, text: Callable, only_stale: bool = True) -> DataFrame:
    """Embeds again what is of another model or text and stamps model and text hash."""
    stale = is_stale(F.col("embedding_model"), F.col("embedding_text_hash"), model, text()) if only_stale else F.lit(True)
    return products.withColumn("_stale", stale).withColumns({
        "embedding": F.when(F.col("_stale"), embed(text())).otherwise(F.col("embedding")),
        "embedding_model": F.when(F.col("_stale"), F.lit(model)).otherwise(F.col("embedding_model")),
        "embedding_text_hash": F.when(F.col("_stale"), F.sha2(text(), 256)).otherwise(F.col("embedding_text_hash")),
    }).drop("_stale")


def backfill_store(store: Store, name: str, model: str, embed: Callable, text: Callable, batch: int = 100_000, pause: Callable[[], None] | None = None) -> dict[str, int]:
    """Embeds the stale rows of a table kept in buckets, about ``batch`` at a time, each batch a version of its own.

    One pass counts what is stale in each bucket; a batch then reads and writes only its own buckets (a
    bucket with more stale rows than ``batch`` is one batch), and buckets without any are not touched. An
    interrupted run goes on where it ended. ``pause`` waits between batches where the embedder wants that.
    Returns total, embedded, skipped and rewritten (rows written).
    """
    entry = store.manifest()[name]
    stale = is_stale(F.col("embedding_model"), F.col("embedding_text_hash"), model, text())
    counted = store.read(name).groupBy(bucket_of(entry["key"], entry["n"]).alias("bucket")).agg(F.count("*").alias("rows"), F.count_if(stale).alias("stale"))
    counts = sorted(map(tuple, counted.collect()))  # a row for each bucket at most
    batches: list[list[tuple]] = []
    for own in counts:
        if own[2]:
            if not batches or sum(s for *_, s in batches[-1]) + own[2] > batch:
                batches.append([])
            batches[-1].append(own)
    for k, own in enumerate(batches):
        if k and pause:
            pause()
        buckets = [b for b, *_ in own]
        with unit_of_work(store) as work:
            work.write_buckets(name, backfill(work.read(name, buckets), model, embed, text), entry["key"], entry["n"], buckets)
    total, embedded = sum(n for _, n, _ in counts), sum(s for *_, s in counts)
    return {"total": total, "embedded": embedded, "skipped": total - embedded, "rewritten": sum(n for own in batches for _, n, _ in own)}


def valid_record(record: dict) -> dict:
    """A classified line as it may be used: a name, a known role and a confidence from 0 to 1; an error otherwise."""
    name, role, sure, amount = (record.get(k) for k in ("name", "role", "confidence", "amount"))
    if not isinstance(name, str) or role not in ROLES or isinstance(sure, bool) or not isinstance(sure, (int, float)) or not 0 <= sure <= 1 or not (amount is None or isinstance(amount, str)):
        raise ValueError(f"no classified line: {record!r}")
    return {"name": name, "amount": amount, "role": role, "confidence": float(sure)}


def enrich_materials(protocols: DataFrame, classify: Callable[[list[str]], list[dict]] | None = None, least: float = 0.5) -> DataFrame:
    """Protocols (with ``id``) whose materials are what a lab could order, and ``materials_in``, ``materials_out``, ``llm_call``, ``error``.

    Materials that name a vendor or catalog number classify by themselves; others go to
    ``classify``, a client's function from names to records of name, amount, role and
    confidence, in batches of the rows' partitions. Where it fails, or returns a record that isn't valid, the materials stay as they are.
    Each row comes back once, whatever its id.
    """
    told = F.exists("materials", lambda m: filled(m["vendor"]).isNotNull() | filled(m["catalog_no"]).isNotNull())
    rows = protocols.withColumn("_told", F.coalesce(told, F.lit(False))).withColumn("materials_in", F.size(F.coalesce("materials", F.array().cast(MATERIALS))))
    orderable = lambda m: m["role"].isin(*PURCHASABLE) & (m["confidence"] >= least)
    plain = lambda m: F.struct(*(m[c].alias(c) for c in ("name", "amount", "vendor", "catalog_no")))
    sure = structured_materials(rows.filter("_told")).withColumns({"llm_call": F.lit(False), "error": F.lit(False)}).withColumn("materials", F.transform(F.filter("materials", orderable), plain).cast(MATERIALS))
    loose = rows.filter(~F.col("_told"))
    if classify is None:
        rest = loose.withColumns({"llm_call": F.lit(False), "error": F.lit(False)}).withColumn("materials", F.array().cast(MATERIALS))
    else:
        record = "struct<said:array<struct<name:string,amount:string,role:string,confidence:double>>,error:boolean>"

        def asked(names: pd.Series) -> pd.DataFrame:
            out, failed = [], []
            for own in names:
                try:
                    out.append([valid_record(r) for r in classify(list(own))])
                    failed.append(False)
                except Exception:  # one protocol's failure must not end the run
                    out.append([])
                    failed.append(True)
            return pd.DataFrame({"said": out, "error": failed})

        # A column of its row, so ids may be null or repeated; asked once, as calls aren't free.
        ask = F.pandas_udf(asked, record).asNondeterministic()
        said = loose.withColumn("_said", ask(F.transform(F.coalesce("materials", F.array().cast(MATERIALS)), lambda m: m["name"])))
        none = F.lit(None).cast("string")
        made = F.transform(F.filter("_said.said", lambda m: F.coalesce(orderable(m), F.lit(False))), lambda m: F.struct(m["name"].alias("name"), m["amount"].alias("amount"), none.alias("vendor"), none.alias("catalog_no")))
        rest = said.withColumns({"llm_call": F.lit(True), "error": F.col("_said.error")}).withColumn("materials", F.when(F.col("error"), F.col("materials")).otherwise(made.cast(MATERIALS))).drop("_said")
    both = sure.unionByName(rest).drop("_told")
    return both.withColumn("materials_out", F.when(F.col("error"), F.lit(0)).otherwise(F.size("materials")))


def enrich_counts(enriched: DataFrame) -> DataFrame:
    """One row: protocols, materials_in, materials_out, llm_calls, errors."""
    return enriched.agg(F.count("*").alias("protocols"), F.coalesce(F.sum("materials_in"), F.lit(0)).alias("materials_in"), F.coalesce(F.sum("materials_out"), F.lit(0)).alias("materials_out"), F.count_if("llm_call").alias("llm_calls"), F.count_if("error").alias("errors"))


def link_counts(links: DataFrame, protocols: DataFrame) -> DataFrame:
    """One row about a matching run: protocols, those with links, links, and links by kind."""
    counted = links.agg(F.count("*").alias("links"), F.count_if(F.col("kind") == "exact").alias("exact"), F.count_if(F.col("kind") == "substitute").alias("substitute"))
    linked = links.select("protocol_id").distinct().agg(F.count("*").alias("protocols_linked"))
    return protocols.agg(F.count("*").alias("protocols")).crossJoin(linked).crossJoin(counted)  # one row each
