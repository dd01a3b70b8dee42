"""Shared capacities in long form, and their use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright import policy as P
from lanewright.functions.numbers import rnd_total


def capacity_by_mode(lanes: DataFrame, available_only: bool = False) -> DataFrame:
    """Weekly kg per mode over all lanes; closed lanes count too unless asked otherwise."""
    kept = lanes.filter("available") if available_only else lanes
    return kept.groupBy(F.col("mode").alias("resource_key")).agg(F.sum("weekly_capacity_kg").cast("double").alias("capacity"))


def capacity_by_supplier(capacity: DataFrame) -> DataFrame:
    return capacity.groupBy(F.col("supplier_id").cast("string").alias("resource_key")).agg(
        F.sum("available_capacity_units").cast("double").alias("capacity")
    )


def capacity_inventory(inventory: DataFrame) -> DataFrame:
    return inventory.select(
        F.concat_ws("|", "warehouse_id", "product_category").alias("resource_key"),
        F.col("usable_safety_stock_units").cast("double").alias("capacity"),
    )


def capacity_production(production: DataFrame) -> DataFrame:
    return production.filter("can_expedite").select(
        F.col("production_id").alias("resource_key"),
        (F.col("daily_capacity_units") * P.POOLED_DAYS).cast("double").alias("capacity"),
    )


def capacity_warehouse(space: DataFrame) -> DataFrame:
    """Storage room per warehouse: reported, not enforced by the joint choice."""
    return space.select(
        F.col("warehouse_id").alias("resource_key"), F.col("available_capacity_units").cast("double").alias("capacity")
    )


def capacity_table(refs: dict[str, DataFrame], enforced_only: bool = False) -> DataFrame:
    """All capacities as (resource_type, resource_key, capacity)."""
    parts = {
        "transport_mode": capacity_by_mode(refs["shipping_options"]),
        "supplier": capacity_by_supplier(refs["supplier_capacity"]),
        "inventory": capacity_inventory(refs["inventory"]),
        "production": capacity_production(refs["production_schedule"]),
    }
    if not enforced_only:
        parts["warehouse"] = capacity_warehouse(refs["warehouse_space"])
    typed = [df.select(F.lit(kind).alias("resource_type"), "resource_key", "capacity") for kind, df in parts.items()]
    return reduce(DataFrame.unionByName, typed)


def available_capacity(df: DataFrame, most: str, used: str) -> DataFrame:
    return df.withColumn("available", F.col(most) - F.col(used))


def resource_usage(chosen: DataFrame) -> DataFrame:
    """Units used per resource (``type:key``).  Three modes hold most rows; partial sums carry them."""
    return (
        chosen.filter("resource is not null")
        .groupBy("resource")
        .agg(F.sum(F.col("units").cast("decimal(18,4)")).cast("double").alias("used"))
    )


def resource_usage_join(chosen: DataFrame, capacity: DataFrame) -> DataFrame:
    """Use against capacity; a resource without a capacity row is unconstrained."""
    room = capacity.select(F.concat_ws(":", "resource_type", "resource_key").alias("resource"), "capacity")
    joined = resource_usage(chosen).join(room, "resource", "left")
    share = F.when(F.col("capacity") > 0, rnd_total(F.col("used") / F.col("capacity"), 4))
    return joined.select("resource", rnd_total(F.col("used"), 2).alias("used"), "capacity", share.alias("utilization"))
