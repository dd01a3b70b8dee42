"""Queries for projections, derived columns and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewright import policy as P
from lanewright.functions import features as X
from lanewright.functions import risk, text
from lanewright.functions.numbers import flag, rnd
from lanewright.operators import ranking, roi, sets
from lanewright.plans.registry import query, rounded as R

RISK_SQL = R(
    "coalesce(transport_issue_l1y, 0) * 25 + coalesce(wh_breakdown_l3m, 0) * 20"
    " + least(coalesce(dist_from_hub, 0), 100) * 0.3e0 + least(coalesce(product_wg_ton, 0), 500) * 0.05e0", 1
)
PRIORITY_SQL = "case when risk_score >= 80 then 'CRITICAL' when risk_score >= 50 then 'HIGH' when risk_score >= 20 then 'MEDIUM' else 'LOW' end"


@query("delay_status_flag", """
select warehouse_id, transport_issue_l1y, case when transport_issue_l1y > 2 then 'Delayed' else 'Normal' end as status,
       case when transport_issue_l1y > 2 then 1 else 0 end as is_delayed from {warehouses}""")
def delay_status_flag(t):
    issues = F.col("transport_issue_l1y")
    return t("warehouses").select(
        "warehouse_id", "transport_issue_l1y", risk.delay_status(issues).alias("status"), flag(issues > P.DELAYED_ISSUES_OVER).alias("is_delayed")
    )


@query("search_filter", """
select warehouse_id, zone, location_type from {warehouses}
where lower(warehouse_id) like '%rica%' or lower(zone) like '%rica%' or lower(location_type) like '%rica%'""")
def search_filter(t):
    found = text.search_filter(t("warehouses"), ["warehouse_id", "zone", "location_type"], "RICA")
    return found.select("warehouse_id", "zone", "location_type")


@query("isin_filter", """
select shipment_id, shipping_mode from {cargo} where shipment_id in (select shipment_id from {customer_orders} where priority = 'Critical')""")
def isin_filter(t):
    ids = t("customer_orders").filter("priority = 'Critical'")
    return ranking.isin_filter(t("cargo"), ids, "shipment_id").select("shipment_id", "shipping_mode")


@query("point_lookup", "select o_orderkey, o_totalprice, o_orderstatus from orders where o_orderkey = 7")
def point_lookup(t):
    return ranking.point_lookup(t("orders"), "o_orderkey", 7, ["o_orderkey"]).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("fill_defaults", """
select warehouse_id, case when dist_from_hub > 0 then dist_from_hub else 100e0 end as dist_from_hub,
       case when product_wg_ton > 0 then product_wg_ton else 15000e0 end as product_wg_ton, capacity_size from {warehouses}""")
def fill_defaults(t):
    return risk.fill_defaults(t("warehouses")).select("warehouse_id", "dist_from_hub", "product_wg_ton", "capacity_size")


@query("fillna_zero", """
select coalesce(supplier_rating, 0) as supplier_rating, coalesce(weather_severity, 0) as weather_severity,
       coalesce(quality_score, 0) as quality_score, historical_delay_count from {cargo}""")
def fillna_zero(t):
    return sets.fillna_zero(t("cargo"), ["supplier_rating", "weather_severity", "quality_score", "historical_delay_count"])


@query("dropna_rows", """
select shipment_id, supplier_rating, carrier, production_status from {cargo}
where supplier_rating is not null and carrier is not null and production_status is not null""")
def dropna_rows(t):
    return sets.dropna_rows(t("cargo").select("shipment_id", "supplier_rating", "carrier", "production_status"))


@query("warehouse_risk_score", f"select warehouse_id, {RISK_SQL} as risk_score from {{warehouses}}")
def warehouse_risk_score(t):
    return risk.with_risk(t("warehouses")).select("warehouse_id", "risk_score")


@query("priority_bucket", f"""
select warehouse_id, risk_score, {PRIORITY_SQL} as priority from (select warehouse_id, {RISK_SQL} as risk_score from {{warehouses}}) s""")
def priority_bucket(t):
    return risk.with_risk(t("warehouses")).select("warehouse_id", "risk_score", "priority")


@query("risk_gauge_pct", f"""
select warehouse_id, least(risk_score / 150, 1e0) as gauge from (select warehouse_id, {RISK_SQL} as risk_score from {{warehouses}}) s""")
def risk_gauge_pct(t):
    return risk.with_risk(t("warehouses")).select("warehouse_id", risk.gauge(F.col("risk_score")).alias("gauge"))


TIER_SQL = "case when delay_probability < 0.4e0 then 'NO_ACTION_REQUIRED' when delay_probability < 0.7e0 then 'LOW_COST_MITIGATION' else 'FULL_OPTIMIZATION' end"
GAP_SQL = ", ".join(f"case when delay_probability <> {b} then abs(delay_probability - {b}) end" for b in ("0e0", "0.4e0", "0.7e0", "1e0"))
CONFIDENCE_SQL = R(f"least(1e0, least({GAP_SQL}) / 0.2e0)", 3)


@query("classify_tier", f"select shipment_id, delay_probability, {TIER_SQL} as tier from {{delay_predictions}}")
def classify_tier(t):
    return t("delay_predictions").select("shipment_id", "delay_probability", risk.tier(F.col("delay_probability")).alias("tier"))


@query("tier_confidence", f"select shipment_id, delay_probability, {CONFIDENCE_SQL} as confidence_score from {{delay_predictions}}")
def tier_confidence(t):
    p = F.col("delay_probability")
    return t("delay_predictions").select("shipment_id", "delay_probability", risk.tier_confidence(p).alias("confidence_score"))


CHOICE_BASE_SQL = f"""
select warehouse_id, w, days, {R('least(50000e0, (d * 45 + w * 0.45e0) * f)', 2)} as cost_a from (
  select warehouse_id, w, d, greatest(1, cast(round_even(d / 120, 0) as int)) as days,
         case capacity_size when 'Large' then 1.2e0 when 'Mid' then 1e0 when 'Medium' then 1e0 else 0.85e0 end as f
  from (select warehouse_id, capacity_size, case when dist_from_hub > 0 then dist_from_hub else 100e0 end as d,
               case when product_wg_ton > 0 then product_wg_ton else 15000e0 end as w from {{warehouses}}) x) y"""
CHOICES_SQL = f"""
with base as ({CHOICE_BASE_SQL})
select warehouse_id, 'A' as choice, 'Choice A: Express Air Freight (Fast)' as label, 50000 as budget_limit, cost_a as total_cost, days as expected_delay_days from base
union all select warehouse_id, 'B', 'Choice B: Secondary Regional Supplier (Balanced)', 30000, {R('cost_a * 0.65e0', 2)}, days + 3 from base
union all select warehouse_id, 'C', 'Choice C: Economy Rail Re-route (Low Cost)', 25000, {R('cost_a * 0.38e0', 2)}, days + 8 from base"""


@query("prescribe_choices", CHOICES_SQL)
def prescribe_choices(t):
    return risk.prescribe_choices(t("warehouses")).drop("allocations")


_SHARES = {"A": (0.4, 0.3, 0.15, 0.1, 0.05), "B": (0.35, 0.35, 0.2, 0.07, 0.03), "C": (0.25, 0.25, 0.25, 0.15, 0.1)}


@query("choice_allocations", "with base as (" + CHOICE_BASE_SQL + ") " + " union all ".join(
    f"select warehouse_id, '{c}' as choice, {i} as slot, {R(f'w * {s}e0', 1)} as tons from base"
    for c, shares in _SHARES.items() for i, s in enumerate(shares)))
def choice_allocations(t):
    return risk.choice_allocations(t("warehouses"))


LATE_SQL = R("purchase_order_value * 0.02e0 + transportation_cost * 0.10e0", 2)
TRANSPORT_SQL = R(
    "(distance * 0.05e0 + shipment_weight * 0.02e0) * case shipping_mode when 'Air' then 4.5e0 when 'Road' then 1.2e0"
    " when 'Rail' then 0.9e0 when 'Sea' then 0.5e0 end * (fuel_price / 3.4e0)", 2
)
INVENTORY_DAYS_SQL = R("greatest(least(inventory_level / (demand_forecast / 30e0 + 1e-3), 365e0), 0e0)", 1)
RELIABILITY_SQL = "supplier_rating / 5e0 * 0.5e0 + supplier_ontime_rate * 0.5e0"


@query("engineer_features", f"""
select shipment_id, {R('(weather_severity + port_congestion + route_risk + geopolitical_risk) / 4e0', 6)} as risk_composite_index,
       {R('transportation_cost / (shipment_weight + 1e-3)', 6)} as cost_per_kg, {R(RELIABILITY_SQL, 6)} as supplier_reliability_score
from (select *, {TRANSPORT_SQL} as transportation_cost from {{cargo}}) c""")
def engineer_features(t):
    made = X.engineer_features(t("cargo").withColumn("transportation_cost", X.transport_cost()))
    return made.select(
        "shipment_id", *[rnd(F.col(c), 6).alias(c) for c in ("risk_composite_index", "cost_per_kg", "supplier_reliability_score")]
    )


@query("delay_days_target", f"select shipment_id, {R('greatest(lead_time - expected_lead_time, 0e0)', 4)} as delay_days from {{cargo}}")
def delay_days_target(t):
    return t("cargo").select("shipment_id", rnd(X.delay_days(F.col("lead_time"), F.col("expected_lead_time")), 4).alias("delay_days"))


@query("expected_delay_fallback", f"select shipment_id, {R('greatest(expected_lead_time * 0.15e0, 0e0)', 1)} as expected_delay_days from {{cargo}}")
def expected_delay_fallback(t):
    return t("cargo").select("shipment_id", X.expected_delay_fallback(F.col("expected_lead_time")).alias("expected_delay_days"))


PLANNED_SQL = R("greatest(1e0, case TransportMode when 'Road' then 3 when 'Rail' then 5 when 'Air' then 1 else 12 end + DistanceKM / 800)", 2)


@query("is_delayed_order", f"""
select OrderID, case when ActualLeadTimeDays - {PLANNED_SQL} > 1.0e0 then 1 else 0 end as IsDelayed from {{order_lines}}""")
def is_delayed_order(t):
    return t("order_lines").select("OrderID", X.is_delayed_order(F.col("ActualLeadTimeDays"), X.planned_lead_time()).alias("IsDelayed"))


@query("planned_lead_time", f"select OrderID, {PLANNED_SQL} as PlannedLeadTimeDays from {{order_lines}}")
def planned_lead_time(t):
    return t("order_lines").select("OrderID", X.planned_lead_time().alias("PlannedLeadTimeDays"))


@query("order_shipping_cost", f"""
select OrderID, {R("DistanceKM * case TransportMode when 'Road' then 0.08e0 when 'Rail' then 0.05e0 when 'Air' then 0.45e0 when 'Sea' then 0.02e0 end * (OrderQuantity / 500)", 2)} as ShippingCost from {{order_lines}}""")
def order_shipping_cost(t):
    return t("order_lines").select("OrderID", X.order_shipping_cost().alias("ShippingCost"))


GAP_LEAD_SQL = "((lead_time - expected_lead_time) / (expected_lead_time + 1e-3))"


@query("lead_time_gap", f"select shipment_id, {R(GAP_LEAD_SQL, 6)} as lead_time_gap from {{cargo}}")
def lead_time_gap(t):
    return t("cargo").select("shipment_id", rnd(X.lead_time_gap(), 6).alias("lead_time_gap"))


@query("logistic_delay_score", f"""
select shipment_id, {R(f'''1e0 / (1e0 + exp(-(-5.55e0 + 11.5e0 * {GAP_LEAD_SQL} + 0.8e0 * (weather_severity / 10) + 1.05e0 * (port_congestion / 10)
  + 0.75e0 * (route_risk / 10) + 0.7e0 * (geopolitical_risk / 10) + 0.5e0 * (customs_clearance_time / 20) + 0.45e0 * (inspection_delay / 15)
  + 0.6e0 * holiday_impact + 0.65e0 * (historical_delay_count / (top + 1)) - 1.3e0 * supplier_ontime_rate - 0.55e0 * (supplier_rating / 5)
  + 0.35e0 * coalesce(cast(production_status = 'Delayed' as int), 0) - 0.35e0 * (vehicle_availability / 100)
  + 0.28e0 * cast(order_priority = 'Critical' as int))))''', 4)} as delay_probability
from {{cargo}}, (select max(historical_delay_count) as top from {{cargo}}) m""")
def logistic_delay_score(t):
    cargo = t("cargo")
    top = cargo.agg(F.max("historical_delay_count")).first()[0]  # one number
    return cargo.select("shipment_id", X.logistic_delay_score(cargo, top).alias("delay_probability"))


@query("lead_time_pressure", f"""
select shipment_id, {R('''0.35e0 * weather_severity + 0.3e0 * port_congestion + 0.25e0 * route_risk + 0.2e0 * geopolitical_risk
  + 0.15e0 * customs_clearance_time + 0.1e0 * inspection_delay - 0.2e0 * (supplier_ontime_rate * 10)''', 4)} as pressure from {{cargo}}""")
def lead_time_pressure(t):
    return t("cargo").select("shipment_id", rnd(X.lead_time_pressure(), 4).alias("pressure"))


@query("inventory_days", f"select shipment_id, {INVENTORY_DAYS_SQL} as inventory_days from {{cargo}}")
def inventory_days(t):
    return t("cargo").select("shipment_id", X.inventory_days().alias("inventory_days"))


@query("transport_cost_feature", f"select shipment_id, {TRANSPORT_SQL} as transportation_cost from {{cargo}}")
def transport_cost_feature(t):
    return t("cargo").select("shipment_id", X.transport_cost().alias("transportation_cost"))


@query("late_delivery_cost", f"""
select shipment_id, {LATE_SQL} as late_delivery_cost from (select *, {TRANSPORT_SQL} as transportation_cost from {{cargo}}) c""")
def late_delivery_cost(t):
    priced = t("cargo").withColumn("transportation_cost", X.transport_cost())
    return priced.select("shipment_id", X.late_delivery_cost().alias("late_delivery_cost"))


@query("supplier_risk_bin", f"""
select shipment_id, case when s > 0 and s <= 0.55e0 then 'High' when s > 0.55e0 and s <= 0.75e0 then 'Medium' when s > 0.75e0 and s <= 1e0 then 'Low' end as supplier_risk
from (select shipment_id, {RELIABILITY_SQL} as s from {{cargo}}) c""")
def supplier_risk_bin(t):
    return t("cargo").select("shipment_id", X.supplier_risk_bin().alias("supplier_risk"))


@query("calendar_features", """
select shipment_id, cast(month(order_date) as int) as month, cast(quarter(order_date) as int) as quarter,
       cast(weekofyear(order_date) as int) as week, cast(year(order_date) as int) as year from {cargo}""")
def calendar_features(t):
    return X.calendar_features(t("cargo")).select("shipment_id", "month", "quarter", "week", "year")


@query("season_flags", """
select shipment_id, case when isodow(order_date) >= 6 then 1 else 0 end as is_weekend,
       case when month(order_date) in (11, 12) then 1 else 0 end as is_holiday_season from {cargo}""")
def season_flags(t):
    return X.season_flags(t("cargo")).select("shipment_id", "is_weekend", "is_holiday_season")


@query("reorder_check", """
select OrderID, cast(floor(WarehouseCapacity * 0.15e0) as bigint) as ReorderPoint,
       case when InventoryLevel < floor(WarehouseCapacity * 0.15e0) then 1 else 0 end as below_reorder from {order_lines}""")
def reorder_check(t):
    point = X.reorder_point(F.col("WarehouseCapacity"))
    return t("order_lines").select("OrderID", point.alias("ReorderPoint"), flag(F.col("InventoryLevel") < point).alias("below_reorder"))


@query("units_from_weight", """
select shipment_id, cast(greatest(1e0, round_even(shipment_weight / (0.5e0 + supplier_id % 9 / 2e0), 0)) as bigint) as units from {cargo}""")
def units_from_weight(t):
    unit_kg = F.lit(0.5) + F.col("supplier_id") % 9 / 2.0
    return t("cargo").select("shipment_id", X.units_from_weight(F.col("shipment_weight"), unit_kg).alias("units"))


@query("invalid_value_check", """
select 'c_acctbal' as column_name, count(case when c_acctbal < 0 then 1 end) as negatives from customer
union all select 'c_nationkey', count(case when c_nationkey < 0 then 1 end) from customer""")
def invalid_value_check(t):
    return sets.invalid_value_check(t("customer"), ["c_acctbal", "c_nationkey"])


@query("notes_valid", "select id, coalesce(length(trim(analyst_notes)) >= 10, false) as notes_valid from {decisions}")
def notes_valid(t):
    return t("decisions").select("id", text.notes_valid(F.col("analyst_notes")).alias("notes_valid"))


@query("outcome_valid", """
select id, decision_id is not null and decision_id <> 0 and actual_cost <> 0 and actual_delay_days <> 0 as form_valid from {outcomes}""")
def outcome_valid(t):
    return t("outcomes").select("id", roi.outcome_valid().alias("form_valid"))


@query("nonempty_guard", "select warehouse_id from {warehouses}")
def nonempty_guard(t):
    return ranking.nonempty_guard(t("warehouses"), "warehouses").select("warehouse_id")


def _intent_sql(table: str, key: str, prompt: str, extra: str) -> str:
    low = "lower(prompt)"
    tests = [
        f"when {' or '.join(f'contains({low}, $q${w}$q$)' for w in words)} then '{name}'".replace("$q$", "'")
        for name, words in P.INTENT_KEYWORDS
    ]
    intent = f"case {' '.join(tests)} else 'default' end"
    w, z, d, tons = "warehouse_id", "zone", "cast(dist_from_hub as string)", "format('{:,.0f}', product_wg_ton)"
    marks = {"{w}": w, "{z}": z, "{d}": d, "{t}": tons}
    replies = []
    for name, reply in P.INTENT_REPLY.items():
        expr = "'" + reply + "'"
        for mark, col in marks.items():
            expr = expr.replace(mark, f"' || {col} || '")
        replies.append(f"when '{name}' then {expr}")
    return f"""
select {key}, intent, case intent {' '.join(replies)} end as reply from (
  select {key}, {intent} as intent, warehouse_id, zone, dist_from_hub, product_wg_ton
  from (select {key}, {prompt} as prompt, {extra} from {table}) p) q""".replace("{:,.0f}", "@FMT@").replace("@FMT@", "{:,.0f}")


_PROMPT_EXTRA = "concat('WH_', {id}) as warehouse_id, {zone} as zone, cast(1 + {id} % 120 as double) as dist_from_hub, cast(1000 + {id} * 7 as double) as product_wg_ton"


@query("route_intent", _intent_sql("documents", "doc_id", "text", _PROMPT_EXTRA.replace("{id}", "doc_id").replace("{zone}", "lang")))
def route_intent(t):
    docs = t("documents").select(
        "doc_id", F.col("text").alias("prompt"), F.concat(F.lit("WH_"), F.col("doc_id").cast("string")).alias("warehouse_id"),
        F.col("lang").alias("zone"), (F.col("doc_id") % 120 + 1).cast("double").alias("dist_from_hub"),
        (F.col("doc_id") * 7 + 1000).cast("double").alias("product_wg_ton"),
    )
    return text.route_intent(docs).select("doc_id", "intent", "reply")


@query("route_intent_parts", _intent_sql("part", "p_partkey", "p_name || ' by ' || lower(p_type)", _PROMPT_EXTRA.replace("{id}", "p_partkey").replace("{zone}", "p_brand")))
def route_intent_parts(t):
    parts = t("part").select(
        "p_partkey", F.concat_ws(" by ", "p_name", F.lower("p_type")).alias("prompt"),
        F.concat(F.lit("WH_"), F.col("p_partkey").cast("string")).alias("warehouse_id"),
        F.col("p_brand").alias("zone"), (F.col("p_partkey") % 120 + 1).cast("double").alias("dist_from_hub"),
        (F.col("p_partkey") * 7 + 1000).cast("double").alias("product_wg_ton"),
    )
    return text.route_intent(parts).select("p_partkey", "intent", "reply")
