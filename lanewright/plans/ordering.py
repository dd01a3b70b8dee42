"""Queries for ranking, paging, sampling, set operations and write-back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewright.operators import ranking, roi, sets
from lanewright.plans.joins import POSITIVE_SQL
from lanewright.plans.registry import query, rounded as R
from lanewright.plans.rows import PRIORITY_SQL, RISK_SQL


@query("priority_queue", f"""
select warehouse_id, zone, location_type, capacity_size, status, risk_score, {PRIORITY_SQL} as priority, transport_issue_l1y, wh_breakdown_l3m,
       dist_from_hub, product_wg_ton, workers_num, least(risk_score / 150, 1e0) as gauge
from (select *, case when transport_issue_l1y > 2 then 'Delayed' else 'Normal' end as status, {RISK_SQL} as risk_score from {{warehouses}}) s
order by risk_score desc, warehouse_id limit 10""")
def priority_queue(t):
    return ranking.priority_queue(t("warehouses"), 10)


@query("recent_outcomes", f"""
select o.id as outcome_id, o.decision_id, d.warehouse_id, d.selected_option, d.prescribed_cost, o.actual_cost, {R('d.prescribed_cost - o.actual_cost', 2)} as cost_saving,
       d.expected_delay_days as prescribed_delay, o.actual_delay_days as actual_delay, d.expected_delay_days - o.actual_delay_days as delay_improvement, {POSITIVE_SQL} as is_positive
from {{outcomes}} o join {{decisions}} d on d.id = o.decision_id order by o.id desc limit 10""")
def recent_outcomes(t):
    return roi.recent_outcomes(t("decisions"), t("outcomes"), 10)


@query("page_warehouses", "select warehouse_id, zone, capacity_size from {warehouses} order by warehouse_id limit 30 offset 20")
def page_warehouses(t):
    return ranking.page(t("warehouses").select("warehouse_id", "zone", "capacity_size"), ["warehouse_id"], 20, 30)


@query("page_decisions", "select id, warehouse_id, prescribed_cost from {decisions} order by id desc limit 50 offset 100")
def page_decisions(t):
    return ranking.page(t("decisions").select("id", "warehouse_id", "prescribed_cost"), [F.col("id").desc()], 100, 50, 100)


@query("first_n", "select shipment_id, supplier_id from {cargo} order by shipment_id limit 400")
def first_n(t):
    return ranking.first_n(t("cargo").select("shipment_id", "supplier_id"), "shipment_id", 400)


@query("sample_rows", """
select shipment_id, shipping_mode from {cargo}
order by cast('0x' || substr(md5(shipment_id || '|42'), 1, 13) as bigint), shipment_id limit 400""")
def sample_rows(t):
    return ranking.sample_rows(t("cargo").select("shipment_id", "shipping_mode"), ["shipment_id"], 400, 42)


@query("first_match", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey from (
  select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as rn from lineitem) x where rn = 1""")
def first_match(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return ranking.first_match(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])


@query("drop_duplicates_first", "select distinct l_orderkey, l_linenumber from lineitem")
def drop_duplicates_first(t):
    return ranking.drop_duplicates_first(t("lineitem").select("l_orderkey", "l_linenumber"))


@query("drop_duplicates_key", """
select l_suppkey, l_shipmode_key, l_extendedprice from (
  select l_suppkey, l_orderkey * 10 + l_linenumber as l_shipmode_key, l_extendedprice,
         row_number() over (partition by l_suppkey order by l_orderkey * 10 + l_linenumber, l_extendedprice) as rn from lineitem) x where rn = 1""")
def drop_duplicates_key(t):
    lines = t("lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("l_shipmode_key"), "l_extendedprice")
    return ranking.first_match(lines, ["l_suppkey"], ["l_shipmode_key", "l_extendedprice"])


@query("union_all", "select id, warehouse_id from {decisions} where stage = 'F' union all select id, warehouse_id from {decisions}")
def union_all(t):
    rows = t("decisions").select("id", "warehouse_id", "stage")
    return sets.union_all(rows.filter("stage = 'F'"), rows).select("id", "warehouse_id")


@query("key_difference", "select id, warehouse_id from {decisions} where id not in (select decision_id from {outcomes})")
def key_difference(t):
    return sets.key_difference(t("decisions").select("id", "warehouse_id"), t("outcomes").select(F.col("decision_id").alias("id")), "id")


@query("schema_check", "select count(*) as n from {cargo}")
def schema_check(t):
    from lanewright.functions.features import derived_features
    from lanewright.operators.prepare import required_columns

    return sets.schema_check(derived_features(t("cargo")), required_columns()).agg(F.count("*").alias("n"))


@query("align_columns", "select shipment_id, distance, 0 as carrier_Unseen, fragile from {cargo}")
def align_columns(t):
    return sets.align_columns(t("cargo"), ["shipment_id", "distance", "carrier_Unseen", "fragile"])


@query("append_decisions", """
with old as (select id, warehouse_id, prescribed_cost from {decisions} where stage = 'F'),
fresh as (select id as request_no, warehouse_id, prescribed_cost from {decisions} where stage <> 'F')
select * from old union all
select (select max(id) from old) + row_number() over (order by request_no), warehouse_id, prescribed_cost from fresh""")
def append_decisions(t):
    rows = t("decisions")
    columns = ["id", "warehouse_id", "prescribed_cost", "created_at"]
    new = rows.filter("stage <> 'F'").select(F.col("id").alias("request_no"), "warehouse_id", "prescribed_cost", "created_at")
    return roi.append_decisions(rows.filter("stage = 'F'").select(*columns), new, ["request_no"]).drop("created_at")


@query("append_outcomes", """
select o.id, o.decision_id, case when d.id is null then 'not found' else 'accepted' end as result
from {outcomes} o left join (select id from {decisions} where stage <> 'P') d on d.id = o.decision_id""")
def append_outcomes(t):
    accepted, rejected = roi.append_outcomes(t("decisions").filter("stage <> 'P'"), t("outcomes").select("id", "decision_id"))
    tagged = accepted.withColumn("result", F.lit("accepted")).unionByName(rejected.withColumn("result", F.lit("not found")))
    return tagged.select("id", "decision_id", "result")


@query("seed_mapping", """
select concat('WH_', cast(s_suppkey as string)) as warehouse_id, 'Urban' as location_type, 'Medium' as capacity_size, n_name as zone,
       45e0 as workers_num, 12.5e0 as dist_from_hub, 0 as transport_issue_l1y, 0 as wh_breakdown_l3m, s_acctbal as product_wg_ton, 'Normal' as status
from supplier join nation on n_nationkey = s_nationkey""")
def seed_mapping(t):
    from lanewright.sources.tables import WAREHOUSE_SEED, map_columns

    raw = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("WH_"), F.col("s_suppkey").cast("string")).alias("Ware_house_ID"),
        F.col("n_name").alias("zone"), F.col("s_acctbal").alias("Demand"),
    )
    return map_columns(raw, WAREHOUSE_SEED)
