"""Queries for joins and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewright import policy as P
from lanewright.operators import capacity, options, reports, roi
from lanewright.plans.registry import query, rounded as R

POSITIVE_SQL = "o.actual_cost <= d.prescribed_cost and o.actual_delay_days <= d.expected_delay_days"


@query("decision_outcome_join", """
select o.id as outcome_id, o.decision_id, o.actual_cost, o.actual_delay_days, d.warehouse_id, d.selected_option, d.prescribed_cost, d.expected_delay_days
from {outcomes} o join {decisions} d on d.id = o.decision_id""")
def decision_outcome_join(t):
    return roi.decision_outcome_join(t("decisions"), t("outcomes"))


@query("positive_outcome", f"""
select o.id as outcome_id, {POSITIVE_SQL} as is_positive from {{outcomes}} o join {{decisions}} d on d.id = o.decision_id""")
def positive_outcome(t):
    joined = roi.decision_outcome_join(t("decisions"), t("outcomes"))
    return joined.select("outcome_id", roi.positive_outcome().alias("is_positive"))


@query("pending_outcomes", """
select id, warehouse_id, selected_option, prescribed_cost, expected_delay_days, analyst_notes, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created_at
from {decisions} where id not in (select decision_id from {outcomes}) order by id limit 5""")
def pending_outcomes(t):
    first = roi.pending_outcomes(t("decisions"), t("outcomes"), 5)
    return first.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")).drop("stage")


@query("pending_count", "select count(*) as pending_outcome_count from {decisions} where id not in (select decision_id from {outcomes})")
def pending_count(t):
    return roi.pending_count(t("decisions"), t("outcomes"))


LANE_SQL = """
select s.shipment_id, m.mode,
       case when l.available is null or not l.available
            then 'No available ' || m.mode || ' lane for ' || s.supplier_country || '->' || s.destination_country || '.' end as reason,
       l.transit_days, coalesce(l.available, false) as feasible
from {shipments} s cross join (select unnest(['Air', 'Rail', 'Sea']) as mode) m
left join {shipping_options} l on l.origin_country = s.supplier_country and l.destination_country = s.destination_country and l.mode = m.mode"""


@query("lane_lookup", LANE_SQL)
def lane_lookup(t):
    return options.lane_lookup(t("shipments"), t("shipping_options"), t("transport_modes"))


@query("rate_card_join", """
select c.shipment_id, c.shipping_mode, m.base_fee_usd, m.cost_per_kg_usd, m.co2_kg_per_kg_shipped
from {cargo} c join {transport_modes} m on m.mode = c.shipping_mode""")
def rate_card_join(t):
    joined = options.rate_card_join(t("cargo"), t("transport_modes"), "shipping_mode")
    return joined.select("shipment_id", "shipping_mode", "base_fee_usd", "cost_per_kg_usd", "co2_kg_per_kg_shipped")


@query("secondary_supplier_join", """
select s.shipment_id, p.secondary_supplier_id, p.secondary_premium_pct, b.lead_time_days as secondary_lead_days,
       c.available_capacity_units as secondary_capacity
from {shipments} s join {suppliers} p on p.supplier_id = s.supplier_id and p.secondary_supplier_id is not null
join {suppliers} b on b.supplier_id = p.secondary_supplier_id
left join {supplier_capacity} c on c.supplier_id = p.secondary_supplier_id and c.product_category = s.product_category""")
def secondary_supplier_join(t):
    joined = options.secondary_supplier_join(t("shipments"), t("suppliers"), t("supplier_capacity"))
    return joined.filter("secondary_supplier_id is not null").select(
        "shipment_id", "secondary_supplier_id", "secondary_premium_pct", "secondary_lead_days", "secondary_capacity"
    )


@query("safety_stock_join", """
select s.shipment_id, i.usable_safety_stock_units, i.holding_cost_per_unit_usd
from {shipments} s join {inventory} i on i.warehouse_id = s.warehouse and i.product_category = s.product_category""")
def safety_stock_join(t):
    joined = options.safety_stock_join(t("shipments"), t("inventory"), "inner")
    return joined.select("shipment_id", "usable_safety_stock_units", "holding_cost_per_unit_usd")


LINE_SQL = """(select * from (select *, row_number() over (partition by product_category order by production_id) as rn
  from {production_schedule} where can_expedite) x where rn = 1)"""


@query("production_line_join", f"""
select s.shipment_id, p.production_id, p.expedite_cost_per_unit_usd, p.max_expedite_days
from {{shipments}} s join {LINE_SQL} p on p.product_category = s.product_category""")
def production_line_join(t):
    joined = options.production_line_join(t("shipments"), t("production_schedule"), "inner")
    return joined.select("shipment_id", "production_id", "expedite_cost_per_unit_usd", "max_expedite_days")


@query("order_terms_join", """
select s.shipment_id, coalesce(cast(o.sla_max_delay_days as double), 8e0) as sla_days, coalesce(o.late_penalty_pct_per_day, 0.012e0) as option_penalty_pct
from {cargo} s left join {customer_orders} o on o.shipment_id = s.shipment_id""")
def order_terms_join(t):
    return options.order_terms_join(t("cargo"), t("customer_orders")).select("shipment_id", "sla_days", "option_penalty_pct")


@query("sla_penalty_lookup", """
select s.shipment_id, coalesce(cast(o.sla_max_delay_days as double), 8e0) as sla_days, coalesce(o.late_penalty_pct_per_day, 0.015e0) as assign_penalty_pct,
       coalesce(o.priority, 'Medium') as assign_priority
from {cargo} s left join {customer_orders} o on o.shipment_id = s.shipment_id""")
def sla_penalty_lookup(t):
    joined = options.order_terms_join(t("cargo"), t("customer_orders"))
    return joined.select("shipment_id", "sla_days", "assign_penalty_pct", "assign_priority")


@query("priority_terms", """
select shipment_id, order_priority, case order_priority when 'Critical' then 3 when 'High' then 5 when 'Medium' then 8 else 14 end as sla_max_delay_days,
       case order_priority when 'Critical' then 0.03e0 when 'High' then 0.02e0 when 'Medium' then 0.012e0 else 0.006e0 end as late_penalty_pct_per_day
from {cargo}""")
def priority_terms(t):
    made = reports.priority_terms(t("cargo"), P.PRIORITY_TERMS)
    return made.select("shipment_id", "order_priority", "sla_max_delay_days", "late_penalty_pct_per_day")


@query("prediction_join", """
select s.shipment_id, s.units, p.delay_probability, p.predicted_delay_flag, p.expected_delay_days
from {shipments} s join {delay_predictions} p on p.shipment_id = s.shipment_id""")
def prediction_join(t):
    joined = options.prediction_join(t("shipments"), t("delay_predictions"))
    return joined.select("shipment_id", "units", "delay_probability", "predicted_delay_flag", "expected_delay_days")


@query("lane_mode_grid", f"""
select origin_country, destination_country, m.mode, greatest({R('m.speed_days_per_1000km * km / 1000', 1)}, 5e-1) as transit_days
from (select supplier_country as origin_country, destination_country, avg(distance) as km from {{cargo}} group by 1, 2) l, {{transport_modes}} m""")
def lane_mode_grid(t):
    return options.lane_mode_grid(t("cargo"), t("transport_modes"))


@query("resource_usage_join", f"""
with used as (select resource, cast(sum(cast(units as decimal(18,4))) as double) as used from (
    select 'transport_mode:' || shipping_mode as resource, shipment_weight as units from {{cargo}}) x group by resource),
room as (select 'transport_mode:' || mode as resource, cast(sum(weekly_capacity_kg) as double) as capacity from {{shipping_options}}
         where mode <> 'Road' group by mode)
select u.resource, {R('u.used', 2)} as used, r.capacity, case when r.capacity > 0 then {R('u.used / r.capacity', 4)} end as utilization
from used u left join room r on r.resource = u.resource""")
def resource_usage_join(t):
    # Every shipment on its own mode; road has no capacity row and stays unconstrained.
    chosen = t("cargo").select(F.concat(F.lit("transport_mode:"), "shipping_mode").alias("resource"), F.col("shipment_weight").alias("units"))
    rooms = capacity.capacity_by_mode(t("shipping_options").filter("mode <> 'Road'")).withColumn("resource_type", F.lit("transport_mode"))
    return capacity.resource_usage_join(chosen, rooms)


@query("supplier_pairing", """
select s_suppkey as supplier_id, n_name as country, 'Primary' as supplier_type, s_suppkey + 90000 as secondary_supplier_id from supplier join nation on n_nationkey = s_nationkey
union all select s_suppkey + 90000, n_name, 'Secondary', null from supplier join nation on n_nationkey = s_nationkey""")
def supplier_pairing(t):
    base = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return reports.supplier_pairing(base.select(F.col("s_suppkey").alias("supplier_id"), F.col("n_name").alias("country")), P.SECONDARY_ID_OFFSET)
