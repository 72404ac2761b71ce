"""Matching scores, review ranks, landed costs and the calibration gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Duty by category, and that of all others.
DUTY_BY_CATEGORY = {"molecular_biology": 0.25, "consumables": 0.30, "cell_culture": 0.25, "antibodies": 0.20}
DEFAULT_DUTY = 0.27


@dataclass(frozen=True)
class Thresholds:
    exact: float
    substitute: float


PRODUCT_THRESHOLDS = Thresholds(0.92, 0.80)
MATERIAL_THRESHOLDS = Thresholds(0.82, 0.75)


def spec_agreement(a: Column, b: Column) -> Column:
    """Share of common keys with equal values, case aside; 0 without common keys."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(a, empty), F.coalesce(b, empty)
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    agreeing = F.size(F.filter(shared, lambda k: F.lower(F.try_element_at(a, k)).eqNullSafe(F.lower(F.try_element_at(b, k)))))
    return F.coalesce(F.try_divide(agreeing.cast("double"), F.size(shared).cast("double")), F.lit(0.0))


def attribute_bonus(a: Column, b: Column) -> Column:
    """What category, specs, and brand with part number add; ``a`` and ``b`` are product structs."""
    said = lambda x, y: F.coalesce((x != "") & (x == y), F.lit(False))
    category = F.when(said(a["category"], b["category"]), 0.05).otherwise(0.0)
    identity = F.when(said(a["brand"], b["brand"]) & said(a["mpn"], b["mpn"]), 0.50).otherwise(0.0)
    return category + 0.10 * spec_agreement(a["specs"], b["specs"]) + identity


def confidence(similarity: Column, bonus: Column) -> Column:
    """At most 1; a similarity below 0 or undefined counts as 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(similarity, F.lit(0.0)), F.lit(0.0))) + bonus)


def classify(score: Column, thresholds: Thresholds = PRODUCT_THRESHOLDS) -> Column:
    return F.when(score >= thresholds.exact, "exact").when(score >= thresholds.substitute, "substitute")


def rank_score(review: Column) -> Column:
    """Citations first, then ratings by their number, then weighted engagement."""
    n = lambda name: F.coalesce(review[name], F.lit(0)).cast("double")
    engagement = n("bookmarks") * 3 + n("forks") * 2 + n("votes") * 2 + n("comments") + n("views") * 0.01
    rated = review["rating"].isNotNull() & (F.coalesce(review["ratings_count"], F.lit(0)) != 0)
    return (
        F.when(review["citations"].isNotNull(), 10.0 * F.log1p(review["citations"].cast("double")))
        .when(rated, review["rating"] * F.log1p(review["ratings_count"].cast("double")))
        .otherwise(engagement)
    )


def landed_cost(cost: Column, currency: Column, category: Column, qty: Column | int = 1, fx_to_usd: float = 0.14, freight: float = 1.50, margin_rate: float = 0.20) -> Column:
    """The breakdown of a price as a struct, rounded only where it is given out."""
    qty = qty if isinstance(qty, Column) else F.lit(qty)
    table = F.create_map(*(F.lit(x) for pair in DUTY_BY_CATEGORY.items() for x in pair))
    duty = F.coalesce(F.try_element_at(table, category), F.lit(DEFAULT_DUTY))
    works = cost.cast("double") * F.when(currency == "USD", 1.0).otherwise(fx_to_usd)
    tariff = works * duty
    subtotal = works + tariff + freight
    margin = subtotal * margin_rate
    unit = subtotal + margin
    return F.struct(
        F.lit("USD").alias("currency"), qty.alias("qty"), F.round(works, 4).alias("ex_works"), F.round(tariff, 4).alias("tariff"), duty.alias("duty_rate"),
        F.lit(round(freight, 4)).alias("freight"), F.round(margin, 4).alias("margin"), F.round(unit, 4).alias("unit_price"), F.round(unit * qty, 4).alias("line_total"),
    )


@dataclass(frozen=True)
class GateBars:
    precision: float = 0.90
    kind_accuracy: float = 0.75
    max_exact_rate: float = 0.40


def gate_reasons(precision: Column, kind_accuracy: Column, exact_rate: Column, bars: GateBars = GateBars()) -> Column:
    """Why a rebuild may not go ahead; empty if it may."""
    reasons = F.array(
        F.when(precision < bars.precision, "precision"),
        F.when(kind_accuracy.isNull() | (kind_accuracy < bars.kind_accuracy), "kind_accuracy"),
        F.when(exact_rate > bars.max_exact_rate, "exact_rate"),
    )
    return F.filter(reasons, lambda r: r.isNotNull())
