"""Matching accuracy against gold pairs, threshold sweep and calibration gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurespark.functions.scoring import GateBars, gate_reasons


def confusion(pairs: DataFrame, by: list[str] | None = None, predicted: str = "pred", gold: str = "gold") -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 and kind_accuracy; a kind of ``none`` or null is negative.

    Ratios without a base are 0, except kind_accuracy, which is null without gold positives.
    """
    positive = lambda c: F.coalesce(F.col(c) != "none", F.lit(False))
    p, g = positive(predicted), positive(gold)
    counted = pairs.groupBy(*(by or [])).agg(
        F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"), F.count_if(~p & ~g).alias("tn"),
        F.count_if(g & (F.col(predicted) == F.col(gold))).alias("_kinds"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    scored = counted.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    scored = scored.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return scored.withColumn("kind_accuracy", F.try_divide(F.col("_kinds").cast("double"), (F.col("tp") + F.col("fn")).cast("double"))).drop("_kinds")


def predicted_kind(score: Column, exact: float, substitute: Column | float) -> Column:
    return F.when(score >= exact, "exact").when(score >= substitute, "substitute").otherwise("none")


def threshold_sweep(scored: DataFrame, exact: float = 0.92, score: str = "confidence") -> DataFrame:
    """``confusion`` for substitute thresholds from 0.50 to 0.95 in steps of 0.05; pairs are scored once."""
    steps = F.transform(F.sequence(F.lit(10), F.lit(19)), lambda i: F.round(i * 0.05, 2))
    spread = scored.withColumn("threshold", F.explode(steps))
    return confusion(spread.withColumn("pred", predicted_kind(F.col(score), exact, F.col("threshold"))), ["threshold"])


def gold_pairs(gold: DataFrame, products: DataFrame) -> DataFrame:
    """``gold`` (a_key, b_key, kind) with both products as structs; a key without a product is an error."""
    held = products.select(F.col("key"), F.struct(*(c for c in products.columns if c != "key")).alias("p"))
    a, b = held.select(F.col("key").alias("a_key"), F.col("p").alias("a")), held.select(F.col("key").alias("b_key"), F.col("p").alias("b"))
    met = gold.join(a, "a_key", "left").join(b, "b_key", "left")
    lost = F.col("a").isNull() | F.col("b").isNull()
    return met.filter(F.when(lost, F.raise_error(F.concat_ws(" ", F.lit("unknown product in gold pair"), "a_key", "b_key")).cast("boolean")).otherwise(True))


def gate(report: DataFrame, bars: GateBars = GateBars()) -> DataFrame:
    """``report`` (precision, kind_accuracy, sample_exact_rate) with ``reasons`` and ``passed``."""
    reasons = gate_reasons(F.col("precision"), F.col("kind_accuracy"), F.col("sample_exact_rate"), bars)
    return report.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)
