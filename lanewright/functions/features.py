"""Shipment and order formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright import policy as P
from lanewright.functions.numbers import flag, lookup, rnd

SMALL = 1e-3  # fixed value: keeps the ratio formulas away from a zero divisor


def clamp(value: Column, low: float, high: float) -> Column:
    """Keep a value inside [low, high]; unknown stays unknown."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def floor_zero(value: Column) -> Column:
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def engineer_features(df: DataFrame) -> DataFrame:
    """Risk composite, cost per kg and supplier reliability."""
    risks = ("weather_severity", "port_congestion", "route_risk", "geopolitical_risk")
    total = sum((F.col(c) for c in risks[1:]), F.col(risks[0]))
    return df.withColumns(
        {
            "risk_composite_index": total / 4.0,
            "cost_per_kg": F.col("transportation_cost") / (F.col("shipment_weight") + SMALL),
            "supplier_reliability_score": reliability(),
        }
    )


def reliability() -> Column:
    return F.col("supplier_rating") / 5.0 * 0.5 + F.col("supplier_ontime_rate") * 0.5


def lead_time_pressure() -> Column:
    terms = [F.col(c) * w for c, w in P.LEAD_PRESSURE.items()]
    return sum(terms[1:], terms[0])


def lead_time_gap() -> Column:
    return (F.col("lead_time") - F.col("expected_lead_time")) / (F.col("expected_lead_time") + SMALL)


def inventory_days() -> Column:
    return rnd(clamp(F.col("inventory_level") / (F.col("demand_forecast") / 30.0 + SMALL), 0.0, 365.0), 1)


def transport_cost() -> Column:
    base = F.col("distance") * 0.05 + F.col("shipment_weight") * 0.02
    return rnd(base * lookup(F.col("shipping_mode"), P.TRANSPORT_MODE_FACTOR) * (F.col("fuel_price") / 3.4), 2)


def late_delivery_cost() -> Column:
    return rnd(F.col("purchase_order_value") * 0.02 + F.col("transportation_cost") * 0.10, 2)


def supplier_risk_bin() -> Column:
    """Right-closed bins of the reliability score; outside (0, 1] the bin is unknown."""
    score = reliability()
    return (
        F.when((score > 0) & (score <= 0.55), "High")
        .when((score > 0.55) & (score <= 0.75), "Medium")
        .when((score > 0.75) & (score <= 1.0), "Low")
    )


def calendar_features(df: DataFrame, date: str = "order_date") -> DataFrame:
    return df.withColumns(
        {
            "month": F.month(date),
            "quarter": F.quarter(date),
            "week": F.weekofyear(date),
            "year": F.year(date),
        }
    )


def season_flags(df: DataFrame, date: str = "order_date") -> DataFrame:
    return df.withColumns(
        {
            "is_weekend": flag(F.weekday(F.col(date)) >= 5),
            "is_holiday_season": flag(F.month(date).isin(11, 12)),
        }
    )


def derived_features(df: DataFrame) -> DataFrame:
    """All dependent shipment columns, each from columns known before it."""
    priced = df.withColumn("transportation_cost", transport_cost()).withColumn("inventory_days", inventory_days())
    return calendar_features(priced.withColumn("late_delivery_cost", late_delivery_cost()))


def logistic_delay_score(df: DataFrame, max_history: int) -> Column:
    """Delay probability from the fixed driver weights.

    ``max_history`` is the largest historical delay count of the table, one
    number from a prior aggregate.
    """
    z = F.lit(P.DELAY_INTERCEPT) + lead_time_gap() * P.DELAY_LEAD_GAP
    for column, weight, divisor in P.DELAY_DRIVERS:
        z = z + F.col(column) / divisor * weight
    z = z + F.col("historical_delay_count") / float(max_history + 1) * P.DELAY_HISTORY
    z = z + flag(F.col("production_status") == "Delayed") * P.DELAY_PRODUCTION
    z = z + flag(F.col("order_priority") == "Critical") * P.DELAY_CRITICAL
    return rnd(1.0 / (1.0 + F.exp(-z)), 4)


def delay_days(actual: Column, expected: Column) -> Column:
    return floor_zero(actual - expected)


def expected_delay_fallback(expected_lead: Column) -> Column:
    return rnd(floor_zero(expected_lead * 0.15), 1)


def is_delayed_order(actual: Column, planned: Column) -> Column:
    return flag(actual - planned > 1.0)


def order_shipping_cost() -> Column:
    return rnd(F.col("DistanceKM") * lookup(F.col("TransportMode"), P.ORDER_RATE_PER_KM) * (F.col("OrderQuantity") / 500), 2)


def planned_lead_time() -> Column:
    return rnd(F.greatest(F.lit(1.0), lookup(F.col("TransportMode"), P.ORDER_BASE_DAYS) + F.col("DistanceKM") / 800), 2)


def reorder_point(capacity: Column) -> Column:
    return F.floor(capacity * 0.15)


def units_from_weight(weight: Column, unit_kg: Column) -> Column:
    return F.greatest(F.lit(1.0), F.rint(weight / unit_kg)).cast("bigint")


def encode_ordinal(df: DataFrame, columns=None) -> DataFrame:
    """Rank of each level in its fixed order; unknown levels give -1."""
    present = [c for c in (columns or P.ORDINAL_LEVELS) if c in df.columns]
    ranks = {c: {level: i for i, level in enumerate(P.ORDINAL_LEVELS[c])} for c in present}
    return df.withColumns({c: lookup(F.col(c), ranks[c], -1) for c in present})
