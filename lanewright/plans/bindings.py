"""Domain tables as views over the given star schema.

Each view is one SELECT in the SQL subset that Spark and DuckDB share, with
``{name}`` for the tables and views it reads.  ``bind`` gives the view as a
Spark DataFrame; ``with_views`` puts the same text in front of a check query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


# Declared schemas: reading needs no footer scan.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
BASE_TABLES = tuple(SCHEMAS)

# Secondary supplier ids sit far above any primary id, whatever the scale.
SECONDARY_BASE = 900000000000

VIEWS: dict[str, str] = {}

VIEWS["supplier_volume"] = """
select l_suppkey,
       count(case when l_returnflag = 'R' then 1 end) as n_returned,
       cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity
from {lineitem} group by l_suppkey"""

VIEWS["warehouses"] = """
select concat('WH_', cast(100000 + s.s_suppkey as string)) as warehouse_id,
       case when s.s_nationkey % 2 = 0 then 'Urban' else 'Rural' end as location_type,
       case s.s_suppkey % 4 when 0 then 'Large' when 1 then 'Mid' when 2 then 'Medium' else 'Small' end as capacity_size,
       r.r_name as zone,
       cast(20 + s.s_suppkey % 60 as double) as workers_num,
       case when s.s_suppkey % 11 = 5 then null else cast((s.s_suppkey * 37) % 130 as double) end as dist_from_hub,
       cast(case when v.n_returned % 5 >= 3 then v.n_returned % 5 - 1 else 0 end as int) as transport_issue_l1y,
       cast(case when s.s_suppkey % 4 >= 2 then s.s_suppkey % 4 - 1 else 0 end as int) as wh_breakdown_l3m,
       v.quantity / 5e1 as product_wg_ton
from {supplier} s
join {nation} n on n.n_nationkey = s.s_nationkey
join {region} r on r.r_regionkey = n.n_regionkey
left join {supplier_volume} v on v.l_suppkey = s.s_suppkey"""

VIEWS["decisions"] = """
select o_orderkey as id,
       concat('WH_', cast(100000 + cast(floor(o_custkey / 15e0) as bigint) as string)) as warehouse_id,
       case o_orderkey % 3 when 0 then 'Choice A' when 1 then 'Choice B' else 'Choice C' end as selected_option,
       o_totalprice as prescribed_cost,
       cast(1 + o_orderkey % 14 as int) as expected_delay_days,
       case o_orderkey % 7 when 0 then null when 1 then '  short  ' when 2 then 'ten chars.'
            else concat('Chosen for priority ', o_orderpriority) end as analyst_notes,
       cast(o_orderdate as timestamp) as created_at,
       o_orderstatus as stage
from {orders}"""

VIEWS["outcomes"] = """
select l_orderkey * 2 + case when l_linestatus = 'O' then 1 else 0 end as id,
       l_orderkey as decision_id,
       cast(cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) as decimal(18,2)) as double) as actual_cost,
       cast(max(l_linenumber) * 2 as int) as actual_delay_days
from {lineitem} group by l_orderkey, l_linestatus"""

# One row per shipment line, from lineitem alone: the feature formulas run on it without a join.
VIEWS["cargo"] = """
select concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string),
                 cast(l_partkey as string), cast(l_suppkey as string),
                 cast(cast(round(l_extendedprice * 100) as bigint) as string)) as shipment_id,
       l_suppkey as supplier_id,
       cast(l_shipdate as date) as order_date,
       concat('Country-', cast(l_suppkey % 25 as string)) as supplier_country,
       concat('Country-', cast(l_orderkey % 25 as string)) as destination_country,
       case l_linenumber % 4 when 0 then 'Air' when 1 then 'Sea' when 2 then 'Rail' else 'Road' end as shipping_mode,
       case when l_orderkey % 29 = 0 then null else concat('Carrier-', cast(l_suppkey % 7 as string)) end as carrier,
       concat('WH-', cast(l_suppkey % 12 as string)) as warehouse,
       case l_partkey % 3 when 0 then 'Retail' when 1 then 'Wholesale' else 'Online' end as customer_type,
       case l_partkey % 4 when 0 then 'Box' when 1 then 'Pallet' when 2 then 'Crate' else 'Drum' end as packaging_type,
       case l_orderkey % 3 when 0 then 'Dry' when 1 then 'Reefer' else 'Tank' end as container_type,
       case when l_orderkey % 53 = 0 then 'Unrated' when l_suppkey % 3 = 0 then 'Low'
            when l_suppkey % 3 = 1 then 'Medium' else 'High' end as supplier_risk,
       case l_linenumber when 1 then 'Critical' when 2 then 'High' when 3 then 'Medium' else 'Low' end as order_priority,
       case when l_partkey % 31 = 0 then null when l_partkey % 3 = 0 then 'Delayed'
            when l_partkey % 3 = 1 then 'On Schedule' else 'Ahead of Schedule' end as production_status,
       case when month(l_shipdate) in (11, 12) then 1 else 0 end as holiday_impact,
       cast(l_partkey % 2 as int) as temperature_sensitive,
       cast(l_orderkey % 2 as int) as fragile,
       case when (l_partkey * 7 + l_suppkey) % 37 = 0 then null else 1 + (l_suppkey * 13 + l_partkey) % 41 / 1e1 end as supplier_rating,
       (30 + (l_suppkey * 29 + l_orderkey) % 71) / 1e2 as supplier_ontime_rate,
       case when l_orderkey % 33 = 0 then null else l_orderkey * 7 % 101 / 1e1 end as weather_severity,
       case when l_partkey % 41 = 0 then null else l_partkey * 11 % 101 / 1e1 end as port_congestion,
       (l_orderkey + l_partkey) * 13 % 101 / 1e1 as route_risk,
       l_suppkey * 17 % 101 / 1e1 as geopolitical_risk,
       case when l_orderkey % 27 = 4 then null else l_orderkey * 3 % 201 / 1e1 end as customs_clearance_time,
       l_partkey * 5 % 151 / 1e1 as inspection_delay,
       cast((l_suppkey * 3 + l_linenumber) % 9 as int) as historical_delay_count,
       cast(50 + l_partkey * 31 % 4950 as int) as inventory_level,
       cast(50 + l_orderkey * 37 % 5950 as int) as demand_forecast,
       l_orderkey * 19 % 101 / 1e1 as traffic_index,
       15e-1 + l_partkey % 46 / 1e1 as fuel_price,
       50 + (l_orderkey * 53 + l_suppkey) % 14950 / 1e0 as distance,
       case when l_orderkey % 45 = 7 then null else l_orderkey * 23 % 1001 / 1e1 end as vehicle_availability,
       case when l_partkey % 47 = 3 then null else 40 + l_partkey * 29 % 601 / 1e1 end as quality_score,
       l_extendedprice as purchase_order_value,
       l_quantity * (5 + l_partkey % 30) as shipment_weight,
       l_quantity / 1e1 as shipment_volume,
       l_quantity * (5 + l_partkey % 30) * 2 as carbon_emission,
       l_orderkey % 1001 / 1e1 as market_demand_index,
       50 + l_partkey % 1001 / 1e1 as economic_index,
       case l_linenumber % 4 when 0 then 2 when 1 then 24 when 2 then 10 else 6 end + l_partkey % 10 / 2e0 as expected_lead_time,
       case l_linenumber % 4 when 0 then 2 when 1 then 24 when 2 then 10 else 6 end + l_partkey % 10 / 2e0
         + l_orderkey * 11 % 200 / 1e1 - 5 as lead_time,
       cast((l_orderkey * 7 % 101 * 35 + l_partkey * 11 % 101 * 30 + (l_orderkey + l_partkey) * 13 % 101 * 25
             + l_suppkey * 17 % 101 * 20) / 5500 > 1e0 as int) as delay
from {lineitem}"""

VIEWS["shipments"] = """
select concat_ws('-', cast(l.l_orderkey as string), cast(l.l_linenumber as string),
                 cast(l.l_partkey as string), cast(l.l_suppkey as string),
                 cast(cast(round(l.l_extendedprice * 100) as bigint) as string)) as shipment_id,
       l.l_suppkey as supplier_id,
       sn.n_name as supplier_country,
       cn.n_name as destination_country,
       concat('WH_', cast(100000 + l.l_suppkey as string)) as warehouse,
       p.p_type as product_category,
       cast(l.l_quantity as int) as units,
       l.l_quantity * p.p_size as shipment_weight,
       l.l_extendedprice as purchase_order_value,
       cast(o.o_orderdate as date) as order_date,
       c.c_mktsegment as customer_type,
       case substr(o.o_orderpriority, 1, 1) when '1' then 'Critical' when '2' then 'High'
            when '3' then 'Medium' else 'Low' end as order_priority,
       3 + l.l_partkey % 12 / 1e0 as expected_lead_time
from {lineitem} l
join {orders} o on o.o_orderkey = l.l_orderkey
join {customer} c on c.c_custkey = o.o_custkey
join {nation} cn on cn.n_nationkey = c.c_nationkey
join {part} p on p.p_partkey = l.l_partkey
join {supplier} s on s.s_suppkey = l.l_suppkey
join {nation} sn on sn.n_nationkey = s.s_nationkey"""

VIEWS["delay_predictions"] = """
select concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string),
                 cast(l_partkey as string), cast(l_suppkey as string),
                 cast(cast(round(l_extendedprice * 100) as bigint) as string)) as shipment_id,
       (l_partkey * 7919 + l_suppkey) % 1000 / 1e3 as delay_probability,
       case when (l_partkey * 7919 + l_suppkey) % 1000 >= 500 then 1 else 0 end as predicted_delay_flag,
       (l_orderkey * 31 + l_linenumber * 7) % 200 / 1e1 as expected_delay_days
from {lineitem}"""

# Open lines have order terms on file; finished ones fall back to the defaults.
VIEWS["customer_orders"] = """
select concat('ORD-', cast(l.l_orderkey as string)) as order_id,
       concat_ws('-', cast(l.l_orderkey as string), cast(l.l_linenumber as string),
                 cast(l.l_partkey as string), cast(l.l_suppkey as string),
                 cast(cast(round(l.l_extendedprice * 100) as bigint) as string)) as shipment_id,
       case substr(o.o_orderpriority, 1, 1) when '1' then 'Critical' when '2' then 'High'
            when '3' then 'Medium' else 'Low' end as priority,
       case substr(o.o_orderpriority, 1, 1) when '1' then 3 when '2' then 5 when '3' then 8 else 14 end as sla_max_delay_days,
       case substr(o.o_orderpriority, 1, 1) when '1' then 30 when '2' then 20 when '3' then 12 else 6 end / 1e3 as late_penalty_pct_per_day,
       l.l_extendedprice as order_value_usd,
       cast(l.l_quantity as int) as units
from {lineitem} l join {orders} o on o.o_orderkey = l.l_orderkey
where l.l_linestatus = 'O'"""

VIEWS["suppliers"] = f"""
select s_suppkey as supplier_id, s_name as supplier_name, n_name as country, 'Primary' as supplier_type,
       1 + s_suppkey * 13 % 41 / 1e1 as rating, (30 + s_suppkey * 29 % 71) / 1e2 as ontime_rate,
       case when s_suppkey % 5 = 4 then null else {SECONDARY_BASE} + s_suppkey end as secondary_supplier_id,
       case when s_suppkey % 5 = 4 then null else (5 + s_suppkey % 14) / 1e2 end as secondary_premium_pct,
       cast(3 + s_suppkey % 20 as int) as lead_time_days
from {{supplier}} join {{nation}} on n_nationkey = s_nationkey
union all
select {SECONDARY_BASE} + s_suppkey, concat('Backup-', s_name), n_name, 'Secondary',
       1 + s_suppkey * 11 % 41 / 1e1, (30 + s_suppkey * 23 % 71) / 1e2,
       cast(null as bigint), cast(null as double), cast(2 + s_suppkey % 15 as int)
from {{supplier}} join {{nation}} on n_nationkey = s_nationkey
where s_suppkey % 5 <> 4"""

VIEWS["stock"] = """
select l.l_suppkey as suppkey, p.p_type as category, count(*) as n_lines,
       cast(sum(cast(l.l_quantity as decimal(18,2))) as bigint) as quantity,
       cast(sum(case when l.l_returnflag = 'R' then cast(l.l_quantity as decimal(18,2)) else 0 end) as bigint) as returned
from {lineitem} l join {part} p on p.p_partkey = l.l_partkey
group by l.l_suppkey, p.p_type"""

VIEWS["supplier_capacity"] = f"""
select {SECONDARY_BASE} + suppkey as supplier_id, category as product_category,
       quantity as max_monthly_capacity_units,
       case when (suppkey + n_lines) % 6 = 0 then quantity - 20 else returned end as current_utilization_units,
       quantity - case when (suppkey + n_lines) % 6 = 0 then quantity - 20 else returned end as available_capacity_units
from {{stock}} where (suppkey + n_lines) % 7 <> 3"""

VIEWS["inventory"] = """
select concat('WH_', cast(100000 + suppkey as string)) as warehouse_id, category as product_category,
       quantity as available_units,
       cast(floor(quantity * 2e-1) as bigint) as safety_stock_units,
       case when (suppkey + n_lines) % 5 = 0 then 25 else cast(floor(quantity * 1e-1) as bigint) end as usable_safety_stock_units,
       (15 + suppkey % 230) / 1e2 as holding_cost_per_unit_usd
from {stock} where (suppkey + n_lines) % 8 <> 1"""

VIEWS["warehouse_space"] = """
select concat('WH_', cast(100000 + l_suppkey as string)) as warehouse_id,
       concat('Region-', cast(1 + l_suppkey % 8 as string)) as location,
       cast(quantity as bigint) as max_capacity_units,
       cast(floor(quantity * (50 + l_suppkey % 40) / 1e2) as bigint) as current_utilization_units,
       cast(quantity as bigint) - cast(floor(quantity * (50 + l_suppkey % 40) / 1e2) as bigint) as available_capacity_units,
       (2 + l_suppkey % 23) / 1e2 as storage_cost_per_unit_per_day_usd
from {supplier_volume}"""

VIEWS["production_schedule"] = """
select concat('PROD-', upper(substr(p_type, 1, 4)), '-', p_brand) as production_id,
       p_type as product_category,
       cast(case when sum(p_size) % 5 = 0 then 15 else count(*) * 20 end as bigint) as daily_capacity_units,
       p_type <> 'PROMO' and sum(p_size) % 3 <> 0 as can_expedite,
       case when sum(p_size) % 3 <> 0 then (80 + sum(p_size) % 520) / 1e2 end as expedite_cost_per_unit_usd,
       cast(case when sum(p_size) % 3 <> 0 then 1 + sum(p_size) % 5 else 0 end as int) as max_expedite_days
from {part} group by p_type, p_brand"""

VIEWS["transport_modes"] = """
select 'Air' as mode, 0 as mode_no, 62e-1 as cost_per_kg_usd, 18e1 as base_fee_usd, 105e-2 as co2_kg_per_kg_shipped, 45e-2 as speed_days_per_1000km
union all select 'Sea', 1, 55e-2, 32e1, 15e-3, 31e-1
union all select 'Rail', 2, 11e-1, 15e1, 3e-2, 14e-1
union all select 'Road', 3, 185e-2, 9e1, 12e-2, 105e-2"""

# The lanes table joins the two fixed nation tables and four modes, leaving some lanes out.
VIEWS["shipping_options"] = """
select a.n_name as origin_country, b.n_name as destination_country, m.mode as mode,
       greatest(cast(round(cast(m.speed_days_per_1000km * (3 + (a.n_nationkey * 7 + b.n_nationkey * 3) % 170 / 1e1) as decimal(28,8)), 1) as double), 5e-1) as transit_days,
       cast((30 + (a.n_nationkey * 5 + b.n_nationkey * 11 + m.mode_no) % 40) * (select count(*) from {supplier}) / 1e1 as bigint) as weekly_capacity_kg,
       (a.n_nationkey + b.n_nationkey * 2 + m.mode_no) % 6 <> 5 as available
from {nation} a
join {nation} b on (a.n_nationkey + b.n_nationkey) % 9 <> 4
join {transport_modes} m on (a.n_nationkey * 3 + b.n_nationkey * 5 + m.mode_no) % 11 <> 7"""

VIEWS["order_lines"] = """
select concat('ORD-', cast(100000 + o_orderkey as string)) as OrderID,
       cast(o_orderdate as date) as OrderDate,
       cast(o_orderdate as date) + cast(2 + o_orderkey % 17 as int) as DeliveryDate,
       concat('SUP-', cast(o_custkey % 40 as string)) as SupplierID,
       case o_custkey % 5 when 0 then 'North' when 1 then 'South' when 2 then 'East' when 3 then 'West' else 'Central' end as SupplierRegion,
       concat('WH-', cast(o_custkey % 12 as string)) as WarehouseID,
       cast(5000 + o_custkey * 97 % 45000 as int) as WarehouseCapacity,
       case o_orderkey % 3 when 0 then 'Beverages' when 1 then 'Snacks' else 'Dairy' end as ProductCategory,
       case o_orderkey % 10 when 0 then 'Air' when 1 then 'Sea' when 2 then 'Sea' when 3 then 'Rail' when 4 then 'Rail' else 'Road' end as TransportMode,
       case when o_orderkey % 101 = 0 then -1e0 else 1e0 end * (50 + o_orderkey * 7 % 2950) as DistanceKM,
       cast(2 + (o_orderkey + o_custkey) % 17 as double) as ActualLeadTimeDays,
       cast(50 + o_custkey * 13 % 4950 as int) as OrderQuantity,
       case when o_orderkey % 50 = 7 then null else 5e-1 + o_orderkey * 11 % 245 / 1e1 end as UnitCost,
       case when o_orderkey % 67 = 5 then null else o_totalprice end as InventoryLevel,
       o_orderpriority as CustomerPriority
from {orders}"""

VIEWS["batch_counts"] = """
select concat('node-', cast(user_id as string)) as node, cast(year(ts) * 10000 + month(ts) * 100 + day(ts) as bigint) as batch_id,
       count(*) as total, count(case when event_type = 'error' then 1 end) as errors, cast(max(ts) as timestamp) as last_ts
from {events} group by user_id, cast(year(ts) * 10000 + month(ts) * 100 + day(ts) as bigint)"""

VIEWS["node_resets"] = """
select distinct concat('node-', cast(user_id as string)) as node, cast(year(ts) * 10000 + month(ts) * 100 + day(ts) as bigint) as batch_id
from {events} where event_type = 'signup' and value > 80"""

VIEWS["scored"] = """
select concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string),
                 cast(l_partkey as string), cast(l_suppkey as string),
                 cast(cast(round(l_extendedprice * 100) as bigint) as string)) as id,
       case when l_returnflag = 'R' then 1 else 0 end as label,
       (l_partkey * 7919 + l_suppkey * 104729 + l_orderkey) % 1000 * 6 / 1e4
         + case when l_returnflag = 'R' then 35e-2 else 0e0 end as probability
from {lineitem}"""

# A change log: every event is a commit of its user's latest state, one commit number per day.
VIEWS["commits"] = """
select cast(year(ts) * 10000 + month(ts) * 100 + day(ts) as bigint) as commit_seq, event_id as change_no,
       concat('node-', cast(user_id as string)) as node, event_type as status, value as reading
from {events}"""

# One table version per day; days whose error share is high are quarantined.
VIEWS["daily_load"] = """
select cast(year(ts) * 10000 + month(ts) * 100 + day(ts) as bigint) as seq, max(ts) as committed_at, count(*) as record_count,
       case when count(case when event_type = 'error' then 1 end) * 1e0 / count(*) > 215e-3 then 1 else 0 end as bad
from {events} group by cast(year(ts) * 10000 + month(ts) * 100 + day(ts) as bigint)"""

VIEWS["snapshot_manifest"] = """
select concat('snap-', cast(seq as string)) as snapshot_id,
       case when bad = 1 then 'warehouses_dlq_stream' else 'warehouses_main_stream' end as table_name,
       seq, committed_at,
       'snap-' || cast(lag(seq) over (partition by bad order by seq) as string) as parent_snapshot_id,
       record_count,
       case when bad = 1 then 'QUARANTINED_ANOMALY' else 'VALID' end as status,
       lead(seq) over (partition by bad order by seq) is null as is_current
from {daily_load}"""

VIEWS["allocation"] = """
select concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string),
                 cast(l_partkey as string), cast(l_suppkey as string),
                 cast(cast(round(l_extendedprice * 100) as bigint) as string)) as id,
       l_suppkey as site,
       cast(round(cast(l_extendedprice / l_quantity as decimal(28,8)), 2) as double) as unit_cost,
       l_quantity as capacity,
       cast(l_linenumber * 3 as double) as demand
from {lineitem}"""


def _needs(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", VIEWS[name])


def base_tables(names) -> set[str]:
    """The given tables behind tables or views."""
    found: set[str] = set()
    for name in names:
        found |= base_tables(_needs(name)) if name in VIEWS else {name}
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def bind(spark: SparkSession, sf_dir: str, name: str, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """A base table or a domain view as a DataFrame; ``known`` keeps what one query has bound already."""
    known = {} if known is None else known
    if name not in known:
        if name in VIEWS:
            inputs = {need: bind(spark, sf_dir, need, known) for need in dict.fromkeys(_needs(name))}
            known[name] = spark.sql(VIEWS[name], **inputs)
        else:
            known[name] = table(spark, sf_dir, name)
    return known[name]


def with_views(query: str) -> str:
    """A check query in which ``{view}`` names domain views, with those views put in front."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for need in re.findall(r"\{(\w+)\}", text):
            if need in VIEWS and need not in ordered:
                visit(VIEWS[need])
                if need not in ordered:
                    ordered.append(need)

    def plain(text: str) -> str:
        return re.sub(r"\{(\w+)\}", r"\1", text)

    visit(query)
    if not ordered:
        return plain(query)
    views = ", ".join(f"{name} as ({plain(VIEWS[name])})" for name in ordered)
    body = plain(query).strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {views}, {body[15:]}"
    if body.lower().startswith("with "):
        return f"with {views}, {body[5:]}"
    return f"with {views} {body}"
