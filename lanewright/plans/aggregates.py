"""Queries for aggregations, pivots and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewright import policy as P
from lanewright.functions import text
from lanewright.functions.numbers import rnd, rnd_total
from lanewright.operators import capacity, gram, options, prepare, profile, reports, roi
from lanewright.plans.joins import POSITIVE_SQL
from lanewright.plans.registry import money, query, rounded as R


def _totals_sql(matched: bool) -> str:
    base = "e" if matched else "d"
    return f"""
with d as (select prescribed_cost, expected_delay_days from {{decisions}}),
e as (select o.actual_cost, o.actual_delay_days, d.prescribed_cost, d.expected_delay_days, case when {POSITIVE_SQL} then 1 else 0 end as pos
      from {{outcomes}} o join {{decisions}} d on d.id = o.decision_id),
x as (select (select count(*) from d) as n_dec, (select count(*) from e) as n_out, (select sum(pos) from e) as n_pos,
             (select {money('prescribed_cost')} from {base}) as presc, (select {money('actual_cost')} from e) as act,
             (select avg(expected_delay_days) from {base}) as ae, (select avg(actual_delay_days) from e) as aa)
select n_dec as total_decisions, n_out as evaluated_outcomes, cast(n_pos as bigint) as positive_outcomes, {R('n_pos * 1e0 / n_out * 100', 1)} as positive_outcome_rate,
       {R('presc', 2)} as total_prescribed_cost, {R('act', 2)} as total_actual_cost, {R('presc - act', 2)} as total_cost_savings,
       {R('ae', 1)} as avg_prescribed_delay, {R('aa', 1)} as avg_actual_delay, {R('ae - aa', 1)} as avg_delay_improvement from x"""


ROI_SQL = _totals_sql(False)


@query("roi_totals", ROI_SQL)
def roi_totals(t):
    return roi.roi_totals(t("decisions"), t("outcomes"))


@query("roi_totals_matched", _totals_sql(True))
def roi_totals_matched(t):
    return roi.roi_totals(t("decisions"), t("outcomes"), matched=True)


BY_OPTION_SQL = f"""
select d.selected_option as "option", count(*) as "count", count(case when {POSITIVE_SQL} then 1 end) as positive,
       {R(f'count(case when {POSITIVE_SQL} then 1 end) * 1e0 / count(*) * 100', 1)} as success_rate,
       {R(money('d.prescribed_cost - o.actual_cost'), 2)} as total_savings
from {{outcomes}} o join {{decisions}} d on d.id = o.decision_id group by d.selected_option"""


@query("roi_by_option", BY_OPTION_SQL)
def roi_by_option(t):
    return roi.roi_by_option(t("decisions"), t("outcomes"))


@query("bar_pct", f"""
select b.*, {R('least(abs(total_savings) / greatest((select max(abs(total_savings)) from (' + BY_OPTION_SQL + ') c), 1e0) * 100, 100e0)', 4)} as bar_pct from ({BY_OPTION_SQL}) b""")
def bar_pct(t):
    return roi.bar_pct(roi.roi_by_option(t("decisions"), t("outcomes")))


@query("roi_pct", f"""
select o.id as outcome_id, case when d.prescribed_cost > 0 then {R('(d.prescribed_cost - o.actual_cost) / d.prescribed_cost * 100', 1)} else 0e0 end as roi_pct
from {{outcomes}} o join {{decisions}} d on d.id = o.decision_id""")
def roi_pct(t):
    joined = roi.decision_outcome_join(t("decisions"), t("outcomes"))
    saving = F.col("prescribed_cost") - F.col("actual_cost")
    return joined.select("outcome_id", roi.roi_pct(saving, F.col("prescribed_cost")).alias("roi_pct"))


_AMOUNT = "rtrim(rtrim(format('{{:,.3f}}', {x}), '0'), '.')"


@query("roi_narrative", """
select 'Out of ' || evaluated_outcomes || ' evaluated decisions, ' || positive_outcomes || ' (' || regexp_replace(cast(positive_outcome_rate as string), '\\.0$', '')
       || '%) delivered positive ROI — beating both the prescribed cost and delay targets.'
       || case when total_cost_savings > 0 then ' The AI recommendations saved a total of $' || @saved || ' vs. prescribed budget.'
               else ' Actual costs exceeded prescriptions by $' || @over || ' — consider retraining the model.' end
       || case when avg_delay_improvement > 0 then ' Shipments arrived ' || regexp_replace(cast(avg_delay_improvement as string), '\\.0$', '') || ' day(s) earlier than expected on average.'
               else ' Shipments ran ' || regexp_replace(cast(abs(avg_delay_improvement) as string), '\\.0$', '') || ' day(s) over the predicted delay on average.' end as narrative
from (""".replace("@saved", "rtrim(rtrim(format('@F', total_cost_savings), '0'), '.')").replace("@over", "rtrim(rtrim(format('@F', abs(total_cost_savings)), '0'), '.')").replace("@F", "{:,.3f}") + ROI_SQL + ") r")
def roi_narrative(t):
    return text.roi_narrative(roi.roi_totals(t("decisions"), t("outcomes")))


@query("capacity_by_mode", "select mode as resource_key, cast(sum(weekly_capacity_kg) as double) as capacity from {shipping_options} group by mode")
def capacity_by_mode(t):
    return capacity.capacity_by_mode(t("shipping_options"))


@query("capacity_by_supplier", "select cast(supplier_id as string) as resource_key, cast(sum(available_capacity_units) as double) as capacity from {supplier_capacity} group by supplier_id")
def capacity_by_supplier(t):
    return capacity.capacity_by_supplier(t("supplier_capacity"))


@query("capacity_inventory", "select warehouse_id || '|' || product_category as resource_key, cast(usable_safety_stock_units as double) as capacity from {inventory}")
def capacity_inventory(t):
    return capacity.capacity_inventory(t("inventory"))


@query("capacity_production", "select production_id as resource_key, cast(daily_capacity_units * 3 as double) as capacity from {production_schedule} where can_expedite")
def capacity_production(t):
    return capacity.capacity_production(t("production_schedule"))


@query("capacity_warehouse", "select warehouse_id as resource_key, cast(available_capacity_units as double) as capacity from {warehouse_space}")
def capacity_warehouse(t):
    return capacity.capacity_warehouse(t("warehouse_space"))


@query("capacity_table", """
select 'transport_mode' as resource_type, mode as resource_key, cast(sum(weekly_capacity_kg) as double) as capacity from {shipping_options} group by mode
union all select 'supplier', cast(supplier_id as string), cast(sum(available_capacity_units) as double) from {supplier_capacity} group by supplier_id
union all select 'inventory', warehouse_id || '|' || product_category, cast(usable_safety_stock_units as double) from {inventory}
union all select 'production', production_id, cast(daily_capacity_units * 3 as double) from {production_schedule} where can_expedite
union all select 'warehouse', warehouse_id, cast(available_capacity_units as double) from {warehouse_space}""")
def capacity_table(t):
    return capacity.capacity_table(t.many("shipping_options", "supplier_capacity", "inventory", "production_schedule", "warehouse_space"))


@query("available_capacity", "select warehouse_id, max_capacity_units - current_utilization_units as available from {warehouse_space}")
def available_capacity(t):
    return capacity.available_capacity(t("warehouse_space"), "max_capacity_units", "current_utilization_units").select("warehouse_id", "available")


@query("cost_heatmap", f"""
select destination_country, """ + ", ".join(
    f"{R(f'''avg(case when l.mode = '{m}' then m.cost_per_kg_usd end)''', 4)} as {m.lower()}" for m in P.RATE_CARD) + """
from {shipping_options} l join {transport_modes} m on m.mode = l.mode group by destination_country""")
def cost_heatmap(t):
    return reports.cost_heatmap(t("shipping_options"), t("transport_modes"), list(P.RATE_CARD))


@query("supplier_util_top", """
select supplier_id, cast(sum(current_utilization_units) as bigint) as utilized, cast(sum(available_capacity_units) as bigint) as available
from {supplier_capacity} group by supplier_id order by utilized desc, supplier_id limit 20""")
def supplier_util_top(t):
    return reports.supplier_util_top(t("supplier_capacity"), 20)


@query("inventory_by_category", """
select product_category, cast(sum(available_units) as bigint) as available_units, cast(sum(safety_stock_units) as bigint) as safety_stock_units
from {inventory} group by product_category""")
def inventory_by_category(t):
    return reports.inventory_by_category(t("inventory"))


@query("delay_rate_by", f"""
select product_category, {R('avg(predicted_delay_flag)', 6)} as delay_rate
from {{shipments}} s join {{delay_predictions}} p on p.shipment_id = s.shipment_id group by product_category""")
def delay_rate_by(t):
    return reports.delay_rate_by(options.prediction_join(t("shipments"), t("delay_predictions")), "product_category", "predicted_delay_flag")


@query("delay_rate_by_mode", f"select shipping_mode, {R('avg(delay)', 6)} as delay_rate from {{cargo}} group by shipping_mode")
def delay_rate_by_mode(t):
    return reports.delay_rate_by(t("cargo"), "shipping_mode", "delay")


@query("target_counts", "select delay, count(*) as n from {cargo} group by delay")
def target_counts(t):
    return profile.target_counts(t("cargo"), "delay")


ORDER_NUMERIC = ["WarehouseCapacity", "DistanceKM", "ActualLeadTimeDays", "OrderQuantity", "UnitCost", "InventoryLevel"]
ORDER_TEXT = ["SupplierID", "SupplierRegion", "WarehouseID", "ProductCategory", "TransportMode", "CustomerPriority"]
ORDER_OTHER = {"OrderID": "string", "OrderDate": "date", "DeliveryDate": "date"} | dict.fromkeys(ORDER_TEXT, "string")
ORDER_KIND = {"WarehouseCapacity": "int", "DistanceKM": "double", "ActualLeadTimeDays": "double", "OrderQuantity": "int", "UnitCost": "double", "InventoryLevel": "double"}


def _profile_sql() -> str:
    rows = []
    for c in ORDER_OTHER | dict.fromkeys(ORDER_NUMERIC):
        kind = ORDER_KIND.get(c) or ORDER_OTHER[c]
        common = f"""'{c}' as column_name, '{kind}' as dtype, count(*) - count({c}) as missing_count, {R(f'100e0 * (count(*) - count({c})) / count(*)', 3)} as missing_pct,
          count(distinct {c}) as unique_count, {R(f'count(distinct {c}) * 1e0 / count(*)', 4)} as cardinality_ratio"""
        if c in ORDER_KIND:
            fence = f"(select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from {{order_lines}})"
            outliers = f"count(case when {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1) then 1 end)"
            numbers = f"""{R(f'avg({c})', 4)} as mean, {R(f'median({c})', 4)} as median, {R(f'stddev_samp({c})', 4)} as std,
              cast(min({c}) as double) as minimum, cast(max({c}) as double) as maximum, {R(f'skewness({c})', 4)} as skewness,
              {outliers} as outlier_count_iqr, count(case when {c} < 0 then 1 end) as negative_value_count"""
            rows.append(f"select {common}, {numbers} from {{order_lines}}, {fence} f")
        else:
            empty = "null::double as mean, null::double as median, null::double as std, null::double as minimum, null::double as maximum, null::double as skewness, null::bigint as outlier_count_iqr, null::bigint as negative_value_count"
            rows.append(f"select {common}, {empty} from {{order_lines}}")
    return " union all ".join(rows)


@query("column_profile", _profile_sql())
def column_profile(t):
    return profile.column_profile(t("order_lines"))


@query("column_annotations", "select column_name, case column_name " + " ".join(
    "when '" + c + "' then '" + m + "'" for c, m in P.COLUMN_MEANING.items()) + """ else 'N/A' end as business_meaning, n_values
from (""" + " union all ".join(
    f"select '{c}' as column_name, count({c}) as n_values from {{order_lines}}" for c in [*ORDER_OTHER, *ORDER_NUMERIC]) + ") x")
def column_annotations(t):
    lines = t("order_lines")
    counts = lines.agg(*[F.count(c).alias(f"{c}~n_values") for c in lines.columns])
    return profile.column_annotations(profile._long(counts, lines.columns, {"n_values": "bigint"}))


@query("top_values", """
select column_name, "value", n, rank from (
  select column_name, "value", count(*) as n, cast(row_number() over (partition by column_name order by count(*) desc, "value") as int) as rank
  from (""" + " union all ".join(f"""select '{c}' as column_name, {c} as "value" from {{order_lines}} where {c} is not null""" for c in ORDER_TEXT) + """) v
  group by column_name, "value") r where rank <= 5""")
def top_values(t):
    return profile.top_values(t("order_lines"), ORDER_TEXT)


CARGO_NUMERIC = ["distance", "shipment_weight", "purchase_order_value", "weather_severity", "supplier_rating", "quality_score", "expected_lead_time"]


@query("iqr_outliers", " union all ".join(f"""
select '{c}' as column_name, count(case when {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1) then 1 end) as outliers
from {{cargo}}, (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from {{cargo}}) f""" for c in CARGO_NUMERIC))
def iqr_outliers(t):
    return profile.iqr_outliers(t("cargo"), CARGO_NUMERIC)


@query("box_stats", " union all ".join(
    f"select '{c}' as column_name, " + ", ".join(
        f"{R(f'quantile_cont({c}, {p})', 4)} as {n}" for n, p in (("minimum", 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("maximum", 1)))
    + " from {cargo}" for c in CARGO_NUMERIC))
def box_stats(t):
    return profile.box_stats(t("cargo"), CARGO_NUMERIC)


DUP_COLUMNS = "l_orderkey, l_linenumber"


@query("duplicate_count", f"select cast(sum(n - 1) as bigint) as duplicates from (select count(*) as n from lineitem group by {DUP_COLUMNS}) x")
def duplicate_count(t):
    return profile.duplicate_count(t("lineitem").select("l_orderkey", "l_linenumber"))


_SUMMARY = ["carrier", "customer_type", "fragile", "order_priority", "production_status", "shipping_mode", "supplier_risk", "weather_severity"]


@query("dataset_summary", f"""
with rows as (select {', '.join(_SUMMARY)} from {{cargo}}), d as (select distinct * from rows)
select count(*) as n_rows, cast({len(_SUMMARY)} as bigint) as n_columns, count(*) - (select count(*) from d) as n_duplicates,
       {' + '.join(f'(count(*) - count({c}))' for c in _SUMMARY)} as missing_cells,
       concat_ws(',', {', '.join(f"case when count(*) > count({c}) then '{c}' end" for c in _SUMMARY)}) as columns_with_missing,
       'fragile,weather_severity' as numeric_columns, 'carrier,customer_type,order_priority,production_status,shipping_mode,supplier_risk' as categorical_columns
from rows""")
def dataset_summary(t):
    return profile.dataset_summary(t("cargo").select(*_SUMMARY))


CORR = ["distance", "shipment_weight", "shipment_volume", "carbon_emission", "purchase_order_value", "weather_severity", "supplier_rating"]


@query("correlation_matrix", " union all ".join(
    f"select '{a}' as a, '{b}' as b, {R(f'corr({a}, {b})', 6)} as corr from {{cargo}}"
    for i, a in enumerate(CORR) for b in CORR[i + 1:]))
def correlation_matrix(t):
    return profile.correlation_matrix(t("cargo"), CORR).select("a", "b", rnd_total(F.col("corr"), 6).alias("corr"))


CORR_WIDE = [*CORR, "supplier_ontime_rate", "port_congestion", "holiday_impact", "temperature_sensitive", "fragile"]


@query("correlation_wide", f"with c as materialized (select {', '.join(CORR_WIDE)} from {{cargo}}) " + " union all ".join(
    f"select '{a}' as a, '{b}' as b, regr_count({a}, {b})::bigint as n, {R(f'corr({a}, {b})', 6)} as corr from c"
    for i, a in enumerate(CORR_WIDE) for b in CORR_WIDE[i + 1:]))
def correlation_wide(t):
    return gram.correlation_wide(t("cargo"), CORR_WIDE).withColumn("corr", rnd_total(F.col("corr"), 6))


@query("histogram", """
select cast(least(floor((distance - lo) / (hi - lo) * 30), 29) as bigint) as bin, count(*) as n
from {cargo}, (select min(distance) as lo, max(distance) as hi from {cargo}) m group by 1""")
def histogram(t):
    return profile.histogram(t("cargo"), "distance", 30)


GAPPY = ["supplier_rating", "weather_severity", "quality_score", "vehicle_availability", "customs_clearance_time", "port_congestion"]


@query("impute_median", "select shipment_id, " + ", ".join(
    f"coalesce({c}, (select median({c}) from {{cargo}})) as {c}" for c in GAPPY) + " from {cargo}")
def impute_median(t):
    cargo = t("cargo").select("shipment_id", *GAPPY)
    return prepare.impute_median(cargo, prepare.fit_medians(cargo, GAPPY))


NAMED = ["carrier", "production_status", "shipping_mode"]


@query("impute_mode", "select shipment_id, " + ", ".join(
    f"coalesce({c}, (select {c} from {{cargo}} where {c} is not null group by {c} order by count(*) desc, {c} limit 1)) as {c}" for c in NAMED) + " from {cargo}")
def impute_mode(t):
    cargo = t("cargo").select("shipment_id", *NAMED)
    return prepare.impute_mode(cargo, prepare.fit_modes(cargo, NAMED))


CLIPPED = ["shipment_weight", "purchase_order_value", "supplier_rating"]


@query("clip_iqr", "select shipment_id, " + ", ".join(
    R(f"case when {c} is not null then least(greatest({c}, {c}_lo), {c}_hi) end", 4) + f" as {c}" for c in CLIPPED) + " from {cargo}, (select " + ", ".join(
    f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as {c}_lo, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as {c}_hi"
    for c in CLIPPED) + " from {cargo}) f")
def clip_iqr(t):
    cargo = t("cargo").select("shipment_id", *CLIPPED)
    clipped = prepare.clip_iqr(cargo, profile.quartile_fences(cargo, CLIPPED))
    return clipped.select("shipment_id", *[rnd(F.col(c), 4).alias(c) for c in CLIPPED])


@query("variance_prune", """
select column_name from (select 'constant' as column_name, var_samp(1) as v from {cargo} union all select 'fragile', var_samp(fragile) from {cargo}
  union all select 'distance', var_samp(distance) from {cargo}) x where v = 0""")
def variance_prune(t):
    cargo = t("cargo").withColumn("constant", F.lit(1))
    names = prepare.zero_variance(cargo, ["constant", "fragile", "distance"])
    return t.spark.createDataFrame([(n,) for n in names], "column_name string")


@query("correlation_prune", "select distinct b as column_name from (" + " union all ".join(
    f"select '{b}' as b, corr({a}, {b}) as r from {{cargo}}" for i, a in enumerate(CORR) for b in CORR[i + 1:]) + ") x where abs(r) > 0.97")
def correlation_prune(t):
    return t.spark.createDataFrame([(n,) for n in prepare.correlated(t("cargo"), CORR)], "column_name string")


@query("class_ratio", f"select {R('count(case when delay = 0 then 1 end) * 1e0 / greatest(count(case when delay = 1 then 1 end), 1)', 6)} as class_ratio from {{cargo}}")
def class_ratio(t):
    return reports.class_ratio(t("cargo"), "delay")


@query("predicted_rate", f"select {R('avg(predicted_delay_flag)', 6)} as predicted_rate, {R('avg(delay_probability)', 6)} as mean_probability from {{delay_predictions}}")
def predicted_rate(t):
    return reports.predicted_rate(t("delay_predictions"))


@query("error_rate", f"""
select count(*) as total_events, count(case when event_type = 'error' then 1 end) as error_events,
       {R("count(case when event_type = 'error' then 1 end) * 1e2 / count(*)", 2)} as error_rate from events""")
def error_rate(t):
    return reports.error_rate(t("events"), F.col("event_type") == "error")
