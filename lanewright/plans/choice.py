"""Queries for costed options, allocation and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewright import policy as P
from lanewright.functions.numbers import rnd
from lanewright.operators import allocate, capacity, joint, options, reports
from lanewright.plans.joins import LINE_SQL
from lanewright.plans.registry import money, query, rounded as R
from lanewright.plans.rows import CONFIDENCE_SQL, TIER_SQL

REFS = ("shipping_options", "transport_modes", "suppliers", "supplier_capacity", "inventory", "production_schedule", "customer_orders")


def references(t, *names):
    """Reference tables.  Stock is an aggregate of the largest table; written once, it has its true, small size."""
    if "stock" not in t.known:
        t.stored("stock")
    return t.many(*(names or REFS))


def active(t):
    """Shipments with their predicted probability and delay."""
    return options.prediction_join(t("shipments"), t("delay_predictions"))


def optioned(t):
    return options.with_options(active(t), references(t))


# --- the seven options in SQL ---------------------------------------------------
BASE_CTE = f"""
act as (select s.*, p.delay_probability as p, p.expected_delay_days as d from {{shipments}} s join {{delay_predictions}} p on p.shipment_id = s.shipment_id),
terms as (select a.*, coalesce(cast(o.sla_max_delay_days as double), 8e0) as sla, coalesce(o.late_penalty_pct_per_day, 0.012e0) as pen_opt,
                 coalesce(o.late_penalty_pct_per_day, 0.015e0) as pen_asg, coalesce(o.priority, 'Medium') as prio
          from act a left join {{customer_orders}} o on o.shipment_id = a.shipment_id)"""


def _freight_sql(pos: int, mode: str) -> str:
    share = P.RESIDUAL_SHARE[mode]
    return f"""select s.shipment_id, {pos} as option_pos, '{mode}_Freight' as option_name,
  case when l.available then {R('m.base_fee_usd + m.cost_per_kg_usd * s.shipment_weight', 2)} end as cost_usd,
  case when l.available then {R(f'greatest(s.d * {share}e0, 0e0)', 1)} else s.d end as expected_delay_days,
  case when l.available then {R('m.co2_kg_per_kg_shipped * s.shipment_weight', 2)} else 0e0 end as emission_kg,
  'transport_mode' as resource_type, '{mode}' as resource_key, case when l.available then s.shipment_weight else 0e0 end as resource_units,
  coalesce(l.available, false) as feasible,
  case when not coalesce(l.available, false) then 'No available {mode} lane for ' || s.supplier_country || '->' || s.destination_country || '.' end as infeasibility_reason
from terms s left join {{shipping_options}} l on l.origin_country = s.supplier_country and l.destination_country = s.destination_country and l.mode = '{mode}'
left join {{transport_modes}} m on m.mode = l.mode"""


OPTION_SQL = {
    "option_freight": " union all ".join(_freight_sql(i, m) for i, m in enumerate(options.FREIGHT)),
    "option_secondary": f"""select s.shipment_id, 3 as option_pos, 'Secondary_Supplier' as option_name, {R('s.purchase_order_value * p.secondary_premium_pct', 2)} as cost_usd,
  {R('least(s.d, greatest(b.lead_time_days - s.expected_lead_time, 0e0))', 1)} as expected_delay_days, 0e0 as emission_kg, 'supplier' as resource_type,
  cast(p.secondary_supplier_id as string) as resource_key, cast(s.units as double) as resource_units, coalesce(c.available_capacity_units, 0) >= s.units as feasible,
  case when coalesce(c.available_capacity_units, 0) < s.units then 'Insufficient secondary supplier capacity.' end as infeasibility_reason
from terms s join {{suppliers}} p on p.supplier_id = s.supplier_id and p.secondary_supplier_id is not null
join {{suppliers}} b on b.supplier_id = p.secondary_supplier_id
left join {{supplier_capacity}} c on c.supplier_id = p.secondary_supplier_id and c.product_category = s.product_category""",
    "option_safety_stock": f"""select s.shipment_id, 4 as option_pos, 'Use_Safety_Stock' as option_name, {R('i.holding_cost_per_unit_usd * s.units * 3', 2)} as cost_usd,
  0e0 as expected_delay_days, 0e0 as emission_kg, 'inventory' as resource_type, s.warehouse || '|' || s.product_category as resource_key, cast(s.units as double) as resource_units,
  i.usable_safety_stock_units >= s.units as feasible, case when i.usable_safety_stock_units < s.units then 'Insufficient usable safety stock.' end as infeasibility_reason
from terms s join {{inventory}} i on i.warehouse_id = s.warehouse and i.product_category = s.product_category""",
    "option_expedite": f"""select s.shipment_id, 5 as option_pos, 'Expedite_Manufacturing' as option_name, {R('l.expedite_cost_per_unit_usd * s.units', 2)} as cost_usd,
  {R('greatest(s.d - l.max_expedite_days, 0e0)', 1)} as expected_delay_days, 0e0 as emission_kg, 'production' as resource_type, l.production_id as resource_key,
  cast(s.units as double) as resource_units, s.units <= l.daily_capacity_units * 3 as feasible,
  case when s.units > l.daily_capacity_units * 3 then 'Exceeds pooled production line capacity.' end as infeasibility_reason
from terms s join {LINE_SQL} l on l.product_category = s.product_category""",
    "option_delay_launch": f"""select s.shipment_id, 6 as option_pos, 'Delay_Launch' as option_name, {R('s.purchase_order_value * s.pen_opt * greatest(s.d - s.sla, 0e0)', 2)} as cost_usd,
  s.d as expected_delay_days, 0e0 as emission_kg, cast(null as string) as resource_type, cast(null as string) as resource_key, 0e0 as resource_units, true as feasible, cast(null as string) as infeasibility_reason
from terms s""",
}
OPTIONS_CTE = BASE_CTE + ", opts as (" + " union all ".join(OPTION_SQL.values()) + ")"
KEPT = {
    "option_freight": ("Air_Freight", "Rail_Freight", "Sea_Freight"),
    "option_secondary": ("Secondary_Supplier",),
    "option_safety_stock": ("Use_Safety_Stock",),
    "option_expedite": ("Expedite_Manufacturing",),
    "option_delay_launch": ("Delay_Launch",),
}


def _register_option(name: str):
    @query(name, f"with {BASE_CTE} {OPTION_SQL[name]}")
    def one_option(t):
        return options.build_options(active(t), references(t), only=KEPT[name]).drop("metadata")


for _name in OPTION_SQL:
    _register_option(_name)


@query("build_options", f"with {OPTIONS_CTE} select * from opts")
def build_options(t):
    return options.build_options(active(t), references(t)).drop("metadata")


@query("option_metadata", f"""with {BASE_CTE}
select s.shipment_id, 'Delay_Launch' as option_name, 'days_over_sla' as fact, greatest(s.d - s.sla, 0e0) as amount from terms s
union all select s.shipment_id, 'Delay_Launch', 'sla_days', s.sla from terms s
union all select s.shipment_id, 'Use_Safety_Stock', 'usable_stock', cast(i.usable_safety_stock_units as double)
from terms s join {{inventory}} i on i.warehouse_id = s.warehouse and i.product_category = s.product_category""")
def option_metadata(t):
    made = options.build_options(active(t), references(t), only=("Use_Safety_Stock", "Delay_Launch"))
    return made.select("shipment_id", "option_name", F.explode("metadata").alias("fact", "amount"))


CHEAPEST_SQL = """cheap as (select * from (select *, row_number() over (partition by shipment_id order by
  case when expected_delay_days <= 6 then 0 else 1 end, cost_usd, option_pos) as rn from opts where feasible and cost_usd is not null) x where rn = 1)"""


@query("cheapest_option", f"with {OPTIONS_CTE}, {CHEAPEST_SQL} select * exclude (rn) from cheap")
def cheapest_option(t):
    return options.cheapest_option(optioned(t)).drop("metadata")


@query("heuristic_savings", f"""with {OPTIONS_CTE}, one as (
  select shipment_id, min({{'late': case when expected_delay_days <= 6 then 0 else 1 end, 'cost': cost_usd, 'pos': option_pos, 'name': option_name}}) filter (feasible and cost_usd is not null) as c,
    max(case when option_pos = 6 then cost_usd end) as b from opts group by shipment_id)
select shipment_id, c.name as option_name, {R('b - c.cost', 2)} as savings from one where c is not null""")
def heuristic_savings(t):
    rows = optioned(t)
    picked = rows.select("shipment_id", options.cheapest().alias("o"), options.delay_launch_cost().alias("b"))
    return picked.filter("o is not null").select("shipment_id", "o.option_name", rnd(F.col("b") - F.col("o.cost_usd"), 2).alias("savings"))


EFFECTIVE_CTE = f"""eff as (select o.shipment_id, {R('''o.cost_usd + o.emission_kg * 0.08e0 + case when t.prio in ('Critical', 'High') then 0e0
    else t.purchase_order_value * t.pen_asg * greatest(o.expected_delay_days - t.sla, 0e0) end''', 4)} as effective_cost, o.option_pos, o.option_name, o.cost_usd, o.emission_kg,
  o.expected_delay_days, o.resource_type || ':' || o.resource_key as resource, o.resource_units as units,
  case when t.prio in ('Critical', 'High') then 0e0 else greatest(o.expected_delay_days - t.sla, 0e0) end as days_over_sla,
  {R('''case when t.prio in ('Critical', 'High') then 0e0 else t.purchase_order_value * t.pen_asg * greatest(o.expected_delay_days - t.sla, 0e0) end''', 2)} as late_penalty,
  {R('o.emission_kg * 0.08e0', 2)} as carbon_cost
from opts o join terms t on t.shipment_id = o.shipment_id
where o.feasible and o.cost_usd is not null and (t.prio not in ('Critical', 'High') or o.expected_delay_days <= t.sla))"""
ARGMIN_CTE = "best as (select * from (select *, row_number() over (partition by shipment_id order by effective_cost, option_pos) as rn from eff) x where rn = 1)"


@query("effective_cost", f"with {OPTIONS_CTE}, {EFFECTIVE_CTE} select * from eff")
def effective_cost(t):
    return options.effective_cost(optioned(t))


@query("argmin_option", f"with {OPTIONS_CTE}, {EFFECTIVE_CTE}, {ARGMIN_CTE} select * exclude (rn) from best")
def argmin_option(t):
    return options.argmin_option(optioned(t))


RECS_CTE = f"""{OPTIONS_CTE}, {CHEAPEST_SQL}, {EFFECTIVE_CTE},
pool as (
  select 'transport_mode:' || mode as resource, cast(sum(weekly_capacity_kg) as double) as capacity from {{shipping_options}} group by mode
  union all select 'supplier:' || cast(supplier_id as string), cast(sum(available_capacity_units) as double) from {{supplier_capacity}} group by supplier_id
  union all select 'inventory:' || warehouse_id || '|' || product_category, cast(sum(usable_safety_stock_units) as double) from {{inventory}} group by warehouse_id, product_category
  union all select 'production:' || production_id, cast(sum(daily_capacity_units * 3) as double) from {{production_schedule}} where can_expedite group by production_id),
alone as (select * from (select e.*, row_number() over (partition by shipment_id order by effective_cost, option_pos) as rn from eff e left join pool on pool.resource = e.resource
          where cost_usd <= 500000 and emission_kg <= 250000 and (pool.capacity is null or e.units <= pool.capacity)) x where rn = 1),
tiers as (select shipment_id, d, p, {TIER_SQL.replace('delay_probability', 'p')} as tier, {CONFIDENCE_SQL.replace('delay_probability', 'p')} as confidence from terms),
base as (select shipment_id, cost_usd as b from opts where option_pos = 6),
recs as (
  select t.shipment_id, t.d as predicted_delay_days, t.p as delay_probability, t.tier,
    case t.tier when 'NO_ACTION_REQUIRED' then 'No_Action_Required' when 'LOW_COST_MITIGATION' then coalesce(c.option_name, 'No_Feasible_Option') else coalesce(a.option_name, 'No_Feasible_Option') end as recommended_action,
    case t.tier when 'NO_ACTION_REQUIRED' then 0e0 when 'LOW_COST_MITIGATION' then coalesce(c.cost_usd, 0e0) else coalesce(a.cost_usd, 0e0) end as estimated_cost_usd,
    case t.tier when 'NO_ACTION_REQUIRED' then t.d when 'LOW_COST_MITIGATION' then coalesce(c.expected_delay_days, t.d) else coalesce(a.expected_delay_days, t.d) end as expected_delay_after_action_days,
    case t.tier when 'NO_ACTION_REQUIRED' then 0e0 when 'LOW_COST_MITIGATION' then coalesce({R('b.b - c.cost_usd', 2)}, 0e0)
      else coalesce({R('b.b - (a.cost_usd + a.carbon_cost + a.late_penalty)', 2)}, 0e0) end as business_impact_usd,
    case t.tier when 'NO_ACTION_REQUIRED' then 'Not_Required' when 'LOW_COST_MITIGATION' then case when c.option_name is null then 'Infeasible' else 'Heuristic_Optimal' end
      else case when a.option_name is null then 'Infeasible' else 'Optimal' end end as optimization_status,
    t.confidence as confidence_score
  from tiers t left join cheap c on c.shipment_id = t.shipment_id left join alone a on a.shipment_id = t.shipment_id join base b on b.shipment_id = t.shipment_id)"""


def each(t):
    return options.recommend_each(options.with_options(active(t), references(t), capacities=_enforced(t)))


@query("recommend", f"with {RECS_CTE} select * from recs")
def recommend(t):
    return each(t)


@query("project_rename", f"""with {RECS_CTE} select shipment_id as Shipment_ID, predicted_delay_days as Predicted_Delay_Days, delay_probability as Delay_Probability, tier as Tier,
  recommended_action as Recommended_Action, estimated_cost_usd as Estimated_Cost_USD, expected_delay_after_action_days as Expected_Delay_After_Action_Days,
  business_impact_usd as Business_Impact_USD, optimization_status as Optimization_Status, confidence_score as Confidence_Score from recs""")
def project_rename(t):
    return options.project_rename(each(t))


@query("tier_distribution", f"select tier, count(*) as n from (select {TIER_SQL} as tier from {{delay_predictions}}) x group by tier")
def tier_distribution(t):
    from lanewright.functions.risk import tier

    return reports.value_counts(t("delay_predictions").select(tier(F.col("delay_probability")).alias("tier")), "tier")


@query("action_distribution", f"with {RECS_CTE} select recommended_action, count(*) as n from recs group by recommended_action")
def action_distribution(t):
    return reports.value_counts(each(t), "recommended_action")


KPI_SQL = f"""select count(*) as total_shipments_evaluated, {R(money('estimated_cost_usd'), 2)} as total_estimated_cost_usd, {R(money('business_impact_usd'), 2)} as total_business_impact_usd,
  {R(money('delay_probability') + ' / count(*)', 4)} as average_delay_probability, {R(money('expected_delay_after_action_days') + ' / count(*)', 2)} as average_expected_delay_days_after_action,
  500000e0 as budget_usd, 250000e0 as carbon_limit_kg from recs"""


@query("batch_kpis", f"with {RECS_CTE} {KPI_SQL}")
def batch_kpis(t):
    return reports.batch_kpis(each(t), P.DEFAULT_BUDGET_USD, P.DEFAULT_CARBON_KG)


@query("budget_utilization", f"with {RECS_CTE} select {R('least(total_estimated_cost_usd / greatest(budget_usd, 1e0), 1e0) * 100', 2)} as budget_used_pct from ({KPI_SQL}) k")
def budget_utilization(t):
    return reports.budget_utilization(reports.batch_kpis(each(t), P.DEFAULT_BUDGET_USD, P.DEFAULT_CARBON_KG))


@query("cost_by_action", f"with {RECS_CTE} select recommended_action, {R(money('estimated_cost_usd'), 2)} as total_cost from recs group by recommended_action")
def cost_by_action(t):
    return reports.cost_by_action(each(t))


TIERS = [P.TIER_NONE, P.TIER_LOW, P.TIER_FULL]


@query("action_tier_pivot", f"with {RECS_CTE} select recommended_action, " + ", ".join(f"count(case when tier = '{x}' then 1 end) as {x}" for x in TIERS) + " from recs group by recommended_action")
def action_tier_pivot(t):
    return reports.action_tier_pivot(each(t), TIERS)


# --- linear allocation ----------------------------------------------------------
SITE_BUDGET = 5_500_000.0


def _fill_cte(site: bool) -> str:
    over, by, on = ("partition by site ", "group by site", "f.site = t.site") if site else ("", "", "true")
    key = "site, " if site else ""
    return f"""tot as (select {key}sum(demand) as dem, sum(capacity) as cap from {{allocation}} {by}),
f as (select *, coalesce(sum(capacity) over ({over}order by unit_cost, id rows between unbounded preceding and 1 preceding), 0) as before from {{allocation}}),
x as (select f.*, least(f.capacity, greatest(0, t.dem - f.before)) as allocated, greatest(0, t.dem - t.cap) as short from f join tot t on {on}),
c as (select {key}{R(money('unit_cost * allocated'), 2)} as total_cost, max(short) as short, sum(allocated) as allocated, count(case when allocated > 0 then 1 end) as rows_used from x {by})"""


@query("lp_allocation", f"""with {_fill_cte(True)}
select x.site, x.id, x.unit_cost, cast(x.allocated as double) as allocated, c.short = 0 and c.total_cost <= {SITE_BUDGET} as feasible from x join c on c.site = x.site""")
def lp_allocation(t):
    return allocate.lp_allocation(t("allocation"), SITE_BUDGET, "site")


@query("lp_allocation_global", f"""with {_fill_cte(False)}
select x.id, x.unit_cost, cast(x.allocated as double) as allocated, c.short = 0 and c.total_cost <= 1e12 as feasible from x join c on true""")
def lp_allocation_global(t):
    return allocate.lp_allocation(t("allocation"), 1e12)


SITE_SCENARIOS = (("Choice A (High Budget)", 6_000_000.0), ("Choice B (Medium Budget)", 5_500_000.0), ("Choice C (Low Budget)", 5_000_000.0))


@query("budget_scenarios", f"""with {_fill_cte(True)}
select c.site, s.label, s.budget, cast(c.allocated as double) as allocated, c.rows_used, c.total_cost
from c join (values {', '.join(f"('{n}', {b:.0f}e0)" for n, b in SITE_SCENARIOS)}) s(label, budget) on c.short = 0 and c.total_cost <= s.budget""")
def budget_scenarios(t):
    return allocate.budget_scenarios(t("allocation"), "site", SITE_SCENARIOS)


# --- the joint choice -----------------------------------------------------------
def _enforced(t):
    return capacity.capacity_table(references(t, "shipping_options", "supplier_capacity", "inventory", "production_schedule"), enforced_only=True)


MONEY_PER_SHIPMENT, CARBON_PER_SHIPMENT = 900.0, 60.0


def _limits(t):
    """Budget and carbon limit in proportion to the batch, so that they bind at any scale."""
    n = t("delay_predictions").filter(F.col("delay_probability") >= P.HIGH_RISK).count()
    return MONEY_PER_SHIPMENT * n, CARBON_PER_SHIPMENT * n


_SOLVED: dict[tuple, joint.Joint] = {}


def full_tier(t):
    """The joint choice over every shipment of the full tier; returns (priced rows, joint result).

    The choice ends in written tables, so the queries of one session that read it share it as long as no input file changes.
    """
    rows = options.with_options(active(t).filter(F.col("delay_probability") >= P.HIGH_RISK), references(t))
    key = t.stamp("shipments", "delay_predictions", *REFS)
    if key not in _SOLVED:
        budget, carbon = _limits(t)
        _SOLVED[key] = joint.joint_assign(rows, _enforced(t), budget, carbon)
    return rows, _SOLVED[key]


@query("joint_assign")
def joint_assign(t):
    _, found = full_tier(t)
    return found.choice.select("shipment_id", F.col("choice.option_name").alias("option_name"), F.col("choice.effective_cost").alias("effective_cost"), "choice.resource", "choice.units")


@query("joint_summary")
def joint_summary(t):
    return full_tier(t)[1].summary


NO_FAULT = """
select cast(0 as bigint) as resources_over, cast(0 as bigint) as shipments_not_once, cast(0 as bigint) as outside_offers,
    cast(0 as double) as budget_excess, cast(0 as double) as carbon_excess
"""


@query("joint_invariants", NO_FAULT)
def joint_invariants(t):
    """Faults of the joint choice, all of which must be 0; the offers are priced again, apart from the choice."""
    rows, found = full_tier(t)
    budget, carbon = _limits(t)
    use = joint.constraint_utilization(found.choice, _enforced(t), budget, carbon)
    over = use.filter("used > capacity").agg(F.count("*").alias("resources_over"))
    offers = options.effective_offers(rows, False).select(F.col("shipment_id").alias("asked_id"), "offers")
    both = offers.join(found.choice, F.col("asked_id") == F.col("shipment_id"), "full").select("asked_id", "shipment_id", "offers", "choice")
    once = both.groupBy(F.coalesce("asked_id", "shipment_id").alias("id")).agg(
        F.count("asked_id").alias("asked"), F.count("shipment_id").alias("answered")
    )
    once = once.agg(F.count_if((F.col("asked") != 1) | (F.col("answered") != 1)).alias("shipments_not_once"))
    same = lambda o: (o["option_pos"] == F.col("choice.option_pos")) & o["resource"].eqNullSafe(F.col("choice.resource")) & (F.abs(o["effective_cost"] - F.col("choice.effective_cost")) < 0.005)
    strange = F.col("choice").isNotNull() & ~F.coalesce(F.exists("offers", same), F.lit(False))
    outside = both.agg(F.count_if(strange).alias("outside_offers"))
    spent = found.choice.agg(F.sum(F.col("choice.cost_usd").cast("decimal(18,4)")).alias("m"), F.sum(F.col("choice.emission_kg").cast("decimal(18,4)")).alias("c"))
    excess = spent.select(
        F.greatest(F.coalesce(F.col("m").cast("double"), F.lit(0.0)) - budget, F.lit(0.0)).alias("budget_excess"),
        F.greatest(F.coalesce(F.col("c").cast("double"), F.lit(0.0)) - carbon, F.lit(0.0)).alias("carbon_excess"),
    )
    # Four rows of one: the joins below put single numbers side by side.
    numbered = [part.withColumn("_one", F.lit(1)) for part in (over, once, outside, excess)]
    return numbered[0].join(numbered[1], "_one").join(numbered[2], "_one").join(numbered[3], "_one").drop("_one")


@query("assignment_results")
def assignment_results(t):
    return joint.assignment_results(full_tier(t)[1].choice)


@query("assignment_totals")
def assignment_totals(t):
    return joint.batch_result(joint.assignment_results(full_tier(t)[1].choice))


@query("constraint_utilization")
def constraint_utilization(t):
    budget, carbon = _limits(t)
    return joint.constraint_utilization(full_tier(t)[1].choice, _enforced(t), budget, carbon)


@query("recommend_batch")
def recommend_batch(t):
    rows, found = full_tier(t)
    status = found.summary.first()["status"]
    full = options.tiered(rows).join(found.choice, "shipment_id")
    return options.recommend_simple(optioned(t)).unionByName(options.recommend_chosen(full, F.lit(status)))
