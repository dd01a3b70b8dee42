"""Aggregates behind the reports and charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewright.functions.numbers import flag, lookup, money_sum, rnd_total


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def batch_kpis(recs: DataFrame, budget: float, carbon: float) -> DataFrame:
    return recs.agg(
        F.count("*").alias("total_shipments_evaluated"),
        rnd_total(money_sum(F.col("estimated_cost_usd")), 2).alias("total_estimated_cost_usd"),
        rnd_total(money_sum(F.col("business_impact_usd")), 2).alias("total_business_impact_usd"),
        rnd_total(money_sum(F.col("delay_probability")) / F.count("*"), 4).alias("average_delay_probability"),
        rnd_total(money_sum(F.col("expected_delay_after_action_days")) / F.count("*"), 2).alias("average_expected_delay_days_after_action"),
    ).select("*", F.lit(float(budget)).alias("budget_usd"), F.lit(float(carbon)).alias("carbon_limit_kg"))


def cost_by_action(recs: DataFrame) -> DataFrame:
    return (
        recs.groupBy("recommended_action")
        .agg(rnd_total(money_sum(F.col("estimated_cost_usd")), 2).alias("total_cost"))
        .orderBy(F.col("total_cost").desc(), "recommended_action")
    )


def action_tier_pivot(recs: DataFrame, tiers: list[str]) -> DataFrame:
    return recs.groupBy("recommended_action").pivot("tier", tiers).count().fillna(0)


def cost_heatmap(lanes: DataFrame, modes: DataFrame, mode_names: list[str]) -> DataFrame:
    """Mean cost per kg by destination and mode."""
    priced = lanes.join(modes.select("mode", "cost_per_kg_usd"), "mode")
    grid = priced.groupBy("destination_country").pivot("mode", mode_names).agg(F.avg("cost_per_kg_usd"))
    return grid.select("destination_country", *[rnd_total(F.col(m), 4).alias(m.lower()) for m in mode_names])


def supplier_util_top(capacity: DataFrame, n: int = 20) -> DataFrame:
    return (
        capacity.groupBy("supplier_id")
        .agg(F.sum("current_utilization_units").alias("utilized"), F.sum("available_capacity_units").alias("available"))
        .orderBy(F.col("utilized").desc(), "supplier_id")
        .limit(n)
    )


def inventory_by_category(inventory: DataFrame) -> DataFrame:
    return (
        inventory.groupBy("product_category")
        .agg(F.sum("available_units").alias("available_units"), F.sum("safety_stock_units").alias("safety_stock_units"))
        .orderBy(F.col("available_units").desc(), "product_category")
    )


def budget_utilization(kpis: DataFrame) -> DataFrame:
    used = F.col("total_estimated_cost_usd") / F.greatest(F.col("budget_usd"), F.lit(1.0))
    return kpis.select(rnd_total(F.least(used, F.lit(1.0)) * 100, 2).alias("budget_used_pct"))


def delay_rate_by(df: DataFrame, category: str, flag_column: str) -> DataFrame:
    return (
        df.groupBy(category)
        .agg(rnd_total(F.avg(flag_column), 6).alias("delay_rate"))
        .orderBy(F.col("delay_rate").desc(), category)
    )


def class_ratio(df: DataFrame, label: str) -> DataFrame:
    """Negatives per positive, the weight of the positive class in training."""
    return df.agg(rnd_total(F.count_if(F.col(label) == 0) / F.greatest(F.count_if(F.col(label) == 1), F.lit(1)), 6).alias("class_ratio"))


def predicted_rate(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        rnd_total(F.avg("predicted_delay_flag"), 6).alias("predicted_rate"), rnd_total(F.avg("delay_probability"), 6).alias("mean_probability")
    )


def error_rate(df: DataFrame, is_error) -> DataFrame:
    rate = F.coalesce(F.try_divide(F.count_if(is_error) * 100, F.count("*")), F.lit(0.0))
    return df.agg(F.count("*").alias("total_events"), F.count_if(is_error).alias("error_events"), rnd_total(rate, 2).alias("error_rate"))


def supplier_pairing(suppliers: DataFrame, offset: int) -> DataFrame:
    """Every supplier and its paired secondary (offset + id) in the same country."""
    primary = suppliers.select(
        "supplier_id", "country", F.lit("Primary").alias("supplier_type"), (F.col("supplier_id") + offset).alias("secondary_supplier_id")
    )
    secondary = suppliers.select(
        (F.col("supplier_id") + offset).alias("supplier_id"), "country", F.lit("Secondary").alias("supplier_type"),
        F.lit(None).cast("bigint").alias("secondary_supplier_id"),
    )
    return primary.unionByName(secondary)


def priority_terms(df: DataFrame, terms: dict, priority: str = "order_priority") -> DataFrame:
    """SLA days and late penalty of the priority, from the fixed four-row table."""
    return df.withColumns(
        {
            "sla_max_delay_days": lookup(F.col(priority), {k: v[0] for k, v in terms.items()}),
            "late_penalty_pct_per_day": lookup(F.col(priority), {k: v[1] for k, v in terms.items()}),
        }
    )


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of highest order per key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, "_r.*")
