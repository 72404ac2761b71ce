"""The driver's tables seen as a catalog: parts are products, line items offers and links, orders protocols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts; every second one has a part number, which parts of one brand may share."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("id"), F.lower("p_type").alias("category"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("M"), (F.col("p_partkey") % 40).cast("string"))).alias("mpn"),
        F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("line"), F.substring_index("p_name", " ", 1)).alias("specs"),
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by order and line number."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("supplier_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_extendedprice").alias("cost"), F.when(F.col("l_returnflag") == "R", "USD").otherwise("CNY").alias("currency"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as links of orders to parts, with a confidence from the discount."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("protocol_id"), F.col("l_partkey").alias("product_id"), F.round(1 - F.col("l_discount"), 4).alias("confidence"),
        F.when(F.col("l_discount") <= 0.05, "exact").otherwise("substitute").alias("kind"), (F.col("l_linestatus") == "F").alias("reviewed"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("material_name"),
    )


def protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders; urgent and high ones may be served."""
    order = table(spark, sf_dir, "orders")
    return order.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderpriority")).alias("title"), F.col("o_orderstatus").alias("source"),
        F.concat(F.lit("https://orders.example/"), F.col("o_orderkey").cast("string")).alias("source_uri"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("servable"),
        F.col("o_totalprice").alias("rank_score"), F.array(F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("authors"),
    )


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a small file dealt to all cores, where much work on each row follows: read as it is, it is one task's."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)
