"""Warehouse risk, tiers and the per-warehouse choices, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright import policy as P
from lanewright.functions.numbers import lookup, or_zero, rnd


def delay_status(issues: Column, over: int = P.DELAYED_ISSUES_OVER) -> Column:
    return F.when(issues > over, "Delayed").otherwise("Normal")


def risk_score(issues: Column, breakdowns: Column, distance: Column, weight: Column) -> Column:
    score = (
        or_zero(issues) * P.ISSUE_POINTS
        + or_zero(breakdowns) * P.BREAKDOWN_POINTS
        + F.least(or_zero(distance), F.lit(P.DISTANCE_CAP)) * P.DISTANCE_POINTS
        + F.least(or_zero(weight), F.lit(P.WEIGHT_CAP)) * P.WEIGHT_POINTS
    )
    return rnd(score, 1)


def priority_bucket(score: Column) -> Column:
    expr = None
    for name, cut in P.PRIORITY_CUTS:
        expr = F.when(score >= cut, name) if expr is None else expr.when(score >= cut, name)
    return expr.otherwise(P.PRIORITY_FLOOR)


def gauge(score: Column, top: float = P.RISK_GAUGE_MAX) -> Column:
    return F.least(score / top, F.lit(1.0))


def with_risk(warehouses: DataFrame) -> DataFrame:
    """Add status, risk score, priority and gauge to a warehouse frame."""
    score = risk_score(
        F.col("transport_issue_l1y"), F.col("wh_breakdown_l3m"), F.col("dist_from_hub"), F.col("product_wg_ton")
    )
    return (
        warehouses.withColumn("status", delay_status(F.col("transport_issue_l1y")))
        .withColumn("risk_score", score)
        .withColumn("priority", priority_bucket(F.col("risk_score")))
    )


def tier(probability: Column) -> Column:
    return (
        F.when(probability < P.LOW_RISK, P.TIER_NONE)
        .when(probability < P.HIGH_RISK, P.TIER_LOW)
        .otherwise(P.TIER_FULL)
    )


def tier_confidence(probability: Column) -> Column:
    """Distance to the nearest tier edge; an edge the probability sits on does not count."""
    gaps = [
        F.when(probability != edge, F.abs(probability - edge)) for edge in (0.0, P.LOW_RISK, P.HIGH_RISK, 1.0)
    ]
    return rnd(F.least(F.lit(1.0), F.least(*gaps) / P.CONFIDENCE_SPAN), 3)


def positive_or(value: Column, default) -> Column:
    """Missing, zero and negative values take the default."""
    return F.when(value > 0, value.cast("double")).otherwise(F.lit(float(default)))


def fill_defaults(warehouses: DataFrame) -> DataFrame:
    """Defaults for a prescription request: distance, weight and capacity size."""
    size = F.col("capacity_size")
    return (
        warehouses.withColumn("dist_from_hub", positive_or(F.col("dist_from_hub"), P.DEFAULT_DISTANCE))
        .withColumn("product_wg_ton", positive_or(F.col("product_wg_ton"), P.DEFAULT_WEIGHT))
        .withColumn("capacity_size", F.when(size != "", size).otherwise(P.DEFAULT_CAPACITY))
    )


def prescribe_choices(warehouses: DataFrame) -> DataFrame:
    """Three priced choices per warehouse.  One narrow projection and an explode of three."""
    filled = fill_defaults(warehouses)
    factor = lookup(F.col("capacity_size"), P.CAPACITY_FACTOR, P.CAPACITY_FACTOR_OTHER)
    base = (F.col("dist_from_hub") * P.CHOICE_PER_DISTANCE + F.col("product_wg_ton") * P.CHOICE_PER_WEIGHT) * factor
    priced = filled.select(
        "warehouse_id",
        F.col("product_wg_ton").alias("weight"),
        rnd(F.least(F.lit(P.CHOICE_COST_CAP), base), 2).alias("cost"),
        F.greatest(F.lit(1), F.rint(F.col("dist_from_hub") / P.CHOICE_DISTANCE_PER_DAY).cast("int")).alias("days"),
    )
    choices = [
        F.struct(
            F.lit(code).alias("choice"),
            F.lit(label).alias("label"),
            F.lit(budget).alias("budget_limit"),
            (F.col("cost") if share == 1.0 else rnd(F.col("cost") * share, 2)).alias("total_cost"),
            (F.col("days") + extra).alias("expected_delay_days"),
            F.array(*[rnd(F.col("weight") * part, 1) for part in parts]).alias("allocations"),
        )
        for code, label, budget, share, extra, parts in P.CHOICES
    ]
    return priced.select("warehouse_id", F.explode(F.array(*choices)).alias("c")).select("warehouse_id", "c.*")


def choice_allocations(warehouses: DataFrame) -> DataFrame:
    """One row per warehouse, choice and allocation slot."""
    return prescribe_choices(warehouses).select(
        "warehouse_id", "choice", F.posexplode("allocations").alias("slot", "tons")
    )
