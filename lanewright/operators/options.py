"""Costed mitigation options.

A shipment has at most seven options.  They live in one array column of the
shipment row: pricing, filtering and choosing work inside the row and need no
shuffle beyond the joins that bring the reference terms in.  The array is made
by a generator of one row, which the optimizer does not merge into later
projections: the options are priced once, in compiled code, and what follows reads
finished values.  As a row has at most seven options, they are read one by one
(``each_option``): functions with a lambda would be interpreted for every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright import policy as P
from lanewright.functions.features import floor_zero
from lanewright.functions.numbers import rnd
from lanewright.functions.risk import tier, tier_confidence
from lanewright.operators.ranking import first_match
from lanewright.session import materialize, small_methods

FREIGHT = ("Air", "Rail", "Sea")
OPTION_NAMES = (
    "Air_Freight", "Rail_Freight", "Sea_Freight", "Secondary_Supplier",
    "Use_Safety_Stock", "Expedite_Manufacturing", "Delay_Launch",
)  # fixed values, in list order


# --- reference lookups --------------------------------------------------------
def rate_card_join(df: DataFrame, modes: DataFrame, mode: str = "mode") -> DataFrame:
    """Base fee, cost per kg and CO2 per kg of the mode.  A rate card has one row per mode."""
    card = modes.select(F.col("mode").alias(mode), "base_fee_usd", "cost_per_kg_usd", "co2_kg_per_kg_shipped")
    return df.join(card, mode)


def lane_terms(lanes: DataFrame, modes: DataFrame) -> DataFrame:
    """One row per (origin, destination) with a struct of terms for each freight mode.

    Lanes meet the rate card first, while both are small, so a shipment needs
    one lane join for all three modes.
    """
    keys = ["origin_country", "destination_country", "mode"]
    first = first_match(lanes, keys, ["transit_days", "weekly_capacity_kg", "available"])
    terms = F.struct(
        "available", "transit_days", "weekly_capacity_kg", "base_fee_usd", "cost_per_kg_usd", "co2_kg_per_kg_shipped"
    )
    priced = rate_card_join(first, modes).withColumn("terms", terms)
    per_mode = [F.max(F.when(F.col("mode") == m, F.col("terms"))).alias(f"lane_{m.lower()}") for m in FREIGHT]
    return priced.groupBy("origin_country", "destination_country").agg(*per_mode)


def lane_lookup(shipments: DataFrame, lanes: DataFrame, modes: DataFrame) -> DataFrame:
    """Each shipment and freight mode with its lane, or the reason there is none."""
    joined = _with_lanes(shipments, lanes, modes)
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("mode"), F.col(f"lane_{m.lower()}").alias("lane"), _no_lane(m).alias("reason"))
            for m in FREIGHT
        ]
    )
    return joined.select("shipment_id", F.explode(rows).alias("r")).select(
        "shipment_id", "r.mode", "r.reason", F.col("r.lane.transit_days").alias("transit_days"),
        F.col("r.reason").isNull().alias("feasible"),
    )


def _with_lanes(shipments: DataFrame, lanes: DataFrame, modes: DataFrame) -> DataFrame:
    terms = lane_terms(lanes, modes).select(
        F.col("origin_country").alias("supplier_country"), "destination_country", *[f"lane_{m.lower()}" for m in FREIGHT]
    )
    # Written, the side has a known size: the planner sends it whole only if that is under its broadcast limit.
    terms = materialize(terms, "lanes")
    return shipments.join(terms, ["supplier_country", "destination_country"], "left")


def _no_lane(mode: str) -> Column:
    open_lane = F.coalesce(F.col(f"lane_{mode.lower()}.available"), F.lit(False))
    reason = F.concat(F.lit(f"No available {mode} lane for "), F.col("supplier_country"), F.lit("->"), F.col("destination_country"), F.lit("."))
    return F.when(~open_lane, reason)


#: Shared capacity of the resource behind an option position, where it was brought in with the terms.
ROOMS = {0: "room_air", 1: "room_rail", 2: "room_sea", 3: "room_supplier", 4: "room_inventory", 5: "room_production"}


def pooled(capacities: DataFrame) -> DataFrame:
    """One row per resource (``type:key``) with the sum of its capacities, written once."""
    room = capacities.groupBy(F.concat_ws(":", "resource_type", "resource_key").alias("resource")).agg(F.sum("capacity").alias("capacity"))
    return materialize(room, "pooled")


def _with_room(side: DataFrame, pool: DataFrame | None, pos: int, kind: str, key: Column) -> DataFrame:
    """The small side of a terms join with the pooled capacity of its resource, so that the shipments need no join of their own for it."""
    if pool is None:
        return side
    mine = pool.filter(F.col("resource").startswith(f"{kind}:")).select(F.col("resource").alias("_r"), F.col("capacity").alias(ROOMS[pos]))
    return side.join(mine, F.concat(F.lit(f"{kind}:"), key.cast("string")) == F.col("_r"), "left").drop("_r")


def secondary_supplier_join(shipments: DataFrame, suppliers: DataFrame, capacity: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """Adds the secondary supplier's id, premium, lead time and capacity; all null without one."""
    primary = first_match(
        suppliers.select("supplier_id", "secondary_supplier_id", "secondary_premium_pct", "lead_time_days"),
        ["supplier_id"], ["secondary_supplier_id", "secondary_premium_pct", "lead_time_days"],
    )
    lead = primary.select(
        F.col("supplier_id").alias("secondary_supplier_id"), F.col("lead_time_days").alias("secondary_lead_days")
    )
    paired = (
        primary.filter("secondary_supplier_id is not null")
        .select("supplier_id", "secondary_supplier_id", "secondary_premium_pct")
        .join(lead, "secondary_supplier_id")
    )
    paired = materialize(_with_room(paired, pool, 3, "supplier", F.col("secondary_supplier_id").cast("bigint")), "pairs")
    room = first_match(
        capacity.select(F.col("supplier_id").alias("secondary_supplier_id"), "product_category", "available_capacity_units"),
        ["secondary_supplier_id", "product_category"], ["available_capacity_units"],
    ).withColumnRenamed("available_capacity_units", "secondary_capacity")
    room = materialize(room, "rooms")
    return shipments.join(paired, "supplier_id", "left").join(room, ["secondary_supplier_id", "product_category"], "left")


def safety_stock_join(shipments: DataFrame, inventory: DataFrame, how: str = "left", pool: DataFrame | None = None) -> DataFrame:
    stock = first_match(
        inventory.select(F.col("warehouse_id").alias("warehouse"), "product_category", "usable_safety_stock_units", "holding_cost_per_unit_usd"),
        ["warehouse", "product_category"], ["usable_safety_stock_units", "holding_cost_per_unit_usd"],
    )
    stock = materialize(_with_room(stock, pool, 4, "inventory", F.concat_ws("|", "warehouse", "product_category")), "stocks")
    return shipments.join(stock, ["warehouse", "product_category"], how)


def production_line_join(shipments: DataFrame, production: DataFrame, how: str = "left", pool: DataFrame | None = None) -> DataFrame:
    """The first expedite-capable line of the category."""
    line = first_match(
        production.filter("can_expedite").select(
            "product_category", "production_id", "expedite_cost_per_unit_usd", "max_expedite_days", "daily_capacity_units"
        ),
        ["product_category"], ["production_id"],
    )
    return shipments.join(_with_room(line, pool, 5, "production", F.col("production_id")), "product_category", how)


def order_terms_join(shipments: DataFrame, orders: DataFrame) -> DataFrame:
    """SLA, penalty and priority of the order.

    The option price and the assignment use different fallback penalties;
    both are kept under their own names.
    """
    terms = orders.select(
        "shipment_id",
        F.col("sla_max_delay_days").cast("double").alias("_sla"),
        F.col("late_penalty_pct_per_day").alias("_penalty"),
        F.col("priority").alias("_priority"),
    )
    return (
        shipments.join(terms, "shipment_id", "left")
        .withColumns(
            {
                "sla_days": F.coalesce("_sla", F.lit(P.OPTION_SLA_DAYS)),
                "option_penalty_pct": F.coalesce("_penalty", F.lit(P.OPTION_PENALTY_PCT)),
                "assign_penalty_pct": F.coalesce("_penalty", F.lit(P.ASSIGN_PENALTY_PCT)),
                "assign_priority": F.coalesce("_priority", F.lit(P.ASSIGN_PRIORITY)),
            }
        )
        .drop("_sla", "_penalty", "_priority")
    )


ORDER_TERMS = ("sla_days", "option_penalty_pct", "assign_penalty_pct", "assign_priority")


def prediction_join(shipments: DataFrame, predictions: DataFrame) -> DataFrame:
    return shipments.join(predictions, "shipment_id")


def lane_mode_grid(shipments: DataFrame, modes: DataFrame, distance: str = "distance") -> DataFrame:
    """Every lane in use with every mode of the rate card and its transit time.

    The distance of a lane is the average over its shipments.  The rate card
    is joined as one array row per lane through a constant-size collect.
    """
    lanes = shipments.groupBy("supplier_country", "destination_country").agg(F.avg(distance).alias("km"))
    card = modes.agg(F.collect_list(F.struct("mode", "speed_days_per_1000km")).alias("card")).scalar()
    return lanes.select(
        F.col("supplier_country").alias("origin_country"), "destination_country", "km", F.explode(card).alias("m")
    ).select(
        "origin_country", "destination_country", F.col("m.mode").alias("mode"),
        F.greatest(rnd(F.col("m.speed_days_per_1000km") * F.col("km") / 1000, 1), F.lit(0.5)).alias("transit_days"),
    )


# --- the options --------------------------------------------------------------
def _option(pos, cost, delay, emission=None, kind=None, key=None, units=None, blocked=None, reason=None, extra=None) -> Column:
    """One option struct; a blocked option keeps its row but has no cost when nothing can be priced."""
    blocked = F.lit(False) if blocked is None else blocked
    empty = F.lit(None).cast("map<string,double>")
    return F.struct(
        F.lit(pos).alias("option_pos"),
        F.lit(OPTION_NAMES[pos]).alias("option_name"),
        cost.cast("double").alias("cost_usd"),
        delay.cast("double").alias("expected_delay_days"),
        (F.lit(0.0) if emission is None else emission).alias("emission_kg"),
        F.lit(kind).cast("string").alias("resource_type"),
        (F.lit(None) if key is None else key).cast("string").alias("resource_key"),
        (F.lit(0.0) if units is None else units).cast("double").alias("resource_units"),
        (~blocked).alias("feasible"),
        (F.when(blocked, reason) if reason is not None else F.lit(None).cast("string")).alias("infeasibility_reason"),
        (empty if extra is None else extra).alias("metadata"),
    )


def _facts(**values: Column) -> Column:
    pairs = [x for name, v in values.items() for x in (F.lit(name), v.cast("double"))]
    return F.create_map(*pairs)


def option_freight(pos: int, mode: str, base: Column) -> Column:
    lane, reason, kg = F.col(f"lane_{mode.lower()}"), _no_lane(mode), F.col("shipment_weight")
    # The same as a reason that is not null, without building its text for every field that asks.
    closed = ~F.coalesce(lane["available"], F.lit(False)) & F.col("supplier_country").isNotNull() & F.col("destination_country").isNotNull()
    return _option(
        pos,
        cost=F.when(~closed, rnd(lane["base_fee_usd"] + lane["cost_per_kg_usd"] * kg, 2)),
        delay=F.when(closed, base).otherwise(rnd(floor_zero(base * P.RESIDUAL_SHARE[mode]), 1)),
        emission=F.when(closed, F.lit(0.0)).otherwise(rnd(lane["co2_kg_per_kg_shipped"] * kg, 2)),
        kind="transport_mode",
        key=F.lit(mode),
        units=F.when(closed, F.lit(0.0)).otherwise(kg),
        blocked=closed,
        reason=reason,
        extra=F.when(~closed, _facts(transit_days=lane["transit_days"], lane_capacity_kg=lane["weekly_capacity_kg"])),
    )


def option_secondary(pos: int, base: Column) -> Column:
    room = F.coalesce(F.col("secondary_capacity"), F.lit(0))
    late = F.greatest(F.col("secondary_lead_days") - F.coalesce("expected_lead_time", F.col("secondary_lead_days")), F.lit(0.0))
    made = _option(
        pos,
        cost=rnd(F.col("purchase_order_value") * F.col("secondary_premium_pct"), 2),
        delay=rnd(F.least(base, late), 1),
        kind="supplier",
        key=F.col("secondary_supplier_id").cast("bigint"),
        units=F.col("units"),
        blocked=room < F.col("units"),
        reason=F.lit("Insufficient secondary supplier capacity."),
        extra=_facts(premium_pct=F.col("secondary_premium_pct"), available_capacity=room),
    )
    return F.when(F.col("secondary_supplier_id").isNotNull(), made)


def option_safety_stock(pos: int) -> Column:
    usable = F.col("usable_safety_stock_units")
    made = _option(
        pos,
        cost=rnd(F.col("holding_cost_per_unit_usd") * F.col("units") * P.SAFETY_STOCK_PREMIUM, 2),
        delay=F.lit(0.0),
        kind="inventory",
        key=F.concat_ws("|", "warehouse", "product_category"),
        units=F.col("units"),
        blocked=usable < F.col("units"),
        reason=F.lit("Insufficient usable safety stock."),
        extra=_facts(usable_stock=usable),
    )
    return F.when(usable.isNotNull(), made)


def option_expedite(pos: int, base: Column) -> Column:
    made = _option(
        pos,
        cost=rnd(F.col("expedite_cost_per_unit_usd") * F.col("units"), 2),
        delay=rnd(floor_zero(base - F.col("max_expedite_days")), 1),
        kind="production",
        key=F.col("production_id"),
        units=F.col("units"),
        blocked=F.col("units") > F.col("daily_capacity_units") * P.POOLED_DAYS,
        reason=F.lit("Exceeds pooled production line capacity."),
        extra=_facts(max_expedite_days=F.col("max_expedite_days")),
    )
    return F.when(F.col("production_id").isNotNull(), made)


def option_delay_launch(pos: int, base: Column) -> Column:
    late = floor_zero(base - F.col("sla_days"))
    return _option(
        pos,
        cost=rnd(F.col("purchase_order_value") * F.col("option_penalty_pct") * late, 2),
        delay=base,
        extra=_facts(sla_days=F.col("sla_days"), days_over_sla=late),
    )


def with_options(
    shipments: DataFrame, refs: dict[str, DataFrame], base: str = "expected_delay_days", only: tuple[str, ...] = OPTION_NAMES,
    capacities: DataFrame | None = None,
) -> DataFrame:
    """Shipments with their terms and an ``options`` array in list order.

    ``only`` limits the options and with them the joins.  With ``capacities`` the pooled capacity behind each
    option comes in with its terms (``ROOMS``): before the options are priced a row is still narrow.
    """
    joined, delay, every = shipments, F.col(base), []
    pool = None if capacities is None else pooled(capacities)
    freight = [(i, m) for i, m in enumerate(FREIGHT) if OPTION_NAMES[i] in only]
    if OPTION_NAMES[6] in only:
        # First of all: rows that were just joined by their id meet the orders where they lie.
        joined = order_terms_join(joined, refs["customer_orders"])
    if freight:
        joined = _with_lanes(joined, refs["shipping_options"], refs["transport_modes"])
        every += [(F.lit(True), option_freight(i, mode, delay)) for i, mode in freight]
    if OPTION_NAMES[3] in only:
        joined = secondary_supplier_join(joined, refs["suppliers"], refs["supplier_capacity"], pool)
        every.append((F.col("secondary_supplier_id").isNotNull(), option_secondary(3, delay)))
    if OPTION_NAMES[4] in only:
        joined = safety_stock_join(joined, refs["inventory"], pool=pool)
        every.append((F.col("usable_safety_stock_units").isNotNull(), option_safety_stock(4)))
    if OPTION_NAMES[5] in only:
        joined = production_line_join(joined, refs["production_schedule"], pool=pool)
        every.append((F.col("production_id").isNotNull(), option_expedite(5, delay)))
    if OPTION_NAMES[6] in only:
        every.append((F.lit(True), option_delay_launch(6, delay)))
    if freight and pool is not None:
        wide = {r["resource"]: r["capacity"] for r in pool.filter(F.col("resource").startswith("transport_mode:")).collect()}  # one row per mode
        joined = joined.withColumns({ROOMS[i]: F.lit(wide.get(f"transport_mode:{m}")).cast("double") for i, m in freight})
    keep = [c for c in (*shipments.columns, *ORDER_TERMS, *ROOMS.values()) if c in joined.columns]
    return once(joined.select(*keep), "options", listed(every), joined)


def once(rows: DataFrame, name: str, value: Column, source: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``value`` as a finished column: a generator of one row keeps later filters and projections from repeating its expression."""
    small_methods(rows)
    columns = [c for c in rows.columns if c != name]
    made = (rows if source is None else source).select(*columns, value.alias("_value"))
    return made.select(*columns, F.explode(F.array("_value")).alias(name))


def listed(values: list[tuple[Column, Column]]) -> Column:
    """The values whose condition holds as an array, in order, without a lambda."""
    return F.concat(*[F.when(holds, F.array(v)).otherwise(F.array()) for holds, v in values])


def each_option(options: Column | str) -> list[Column]:
    """The options of a row by their place, null beyond the last: a row has seven at most."""
    return [F.get(options, F.lit(i)) for i in range(len(OPTION_NAMES))]


def build_options(shipments: DataFrame, refs: dict[str, DataFrame], only: tuple[str, ...] = OPTION_NAMES) -> DataFrame:
    """One row per shipment and option."""
    every = with_options(shipments, refs, only=only).select("shipment_id", F.explode("options").alias("o"))
    return every.select("shipment_id", "o.*")


def _is_usable(o: Column) -> Column:
    return o["feasible"] & o["cost_usd"].isNotNull()


def usable(options: Column | str) -> Column:
    return F.filter(options, _is_usable)


def cheapest(options: Column | str = "options") -> Column:
    """The cheapest usable option, within the lenient delay when there is any; null when none is usable.

    The least of (late, cost, place), so the first of equals stays.
    """

    def rank(place: int, o: Column) -> Column:
        late = F.when(o["expected_delay_days"] <= P.LENIENT_DELAY_DAYS, 0).otherwise(1)
        return F.when(_is_usable(o), F.struct(late.alias("late"), o["cost_usd"].alias("cost"), F.lit(place).alias("place")))

    ranks = [rank(i, o) for i, o in enumerate(each_option(options))]
    return F.get(options, F.array_min(F.array(*ranks))["place"])


def option_at(options: Column | str, pos: int) -> Column:
    return F.coalesce(*[F.when(o["option_pos"] == pos, o) for o in each_option(options)])


def cheapest_option(with_opts: DataFrame) -> DataFrame:
    picked = once(with_opts.select("shipment_id"), "o", cheapest(), with_opts)
    return picked.filter("o is not null").select("shipment_id", "o.*")


def delay_launch_cost(options: Column | str = "options") -> Column:
    return option_at(options, 6)["cost_usd"]


def effective_offers(with_opts: DataFrame, single_penalty: bool = False) -> DataFrame:
    """Adds ``offers``: the usable options with the full cost the joint choice minimises.

    Exactly one option is chosen, so the lateness beyond the SLA is that of the
    chosen option and folds into its cost.  Priorities with a hard SLA lose the
    options that break it.  ``single_penalty`` stops Delay_Launch, whose price is
    already the penalty, from paying it twice.
    """
    hard = F.col("assign_priority").isin(*P.HARD_SLA_PRIORITIES)
    over = lambda o: F.greatest(o["expected_delay_days"] - F.col("sla_days"), F.lit(0.0))

    def offer(o: Column) -> Column:
        penalty = F.when(hard, F.lit(0.0)).otherwise(F.col("purchase_order_value") * F.col("assign_penalty_pct") * over(o))
        if single_penalty:
            penalty = F.when(o["option_name"] == "Delay_Launch", F.lit(0.0)).otherwise(penalty)
        carbon = o["emission_kg"] * P.CARBON_PRICE_PER_KG
        return F.struct(
            rnd(o["cost_usd"] + carbon + penalty, 4).alias("effective_cost"),
            o["option_pos"].alias("option_pos"),
            o["option_name"].alias("option_name"),
            o["cost_usd"].alias("cost_usd"),
            o["emission_kg"].alias("emission_kg"),
            o["expected_delay_days"].alias("expected_delay_days"),
            F.when(o["resource_type"].isNotNull(), F.concat(o["resource_type"], F.lit(":"), o["resource_key"])).alias("resource"),
            o["resource_units"].alias("units"),
            F.when(hard, F.lit(0.0)).otherwise(over(o)).alias("days_over_sla"),
            rnd(penalty, 2).alias("late_penalty"),
            rnd(carbon, 2).alias("carbon_cost"),
        )

    def kept(o: Column) -> Column:
        return _is_usable(o) & (~hard | (o["expected_delay_days"] <= F.col("sla_days")))

    return once(with_opts, "offers", listed([(kept(o), offer(o)) for o in each_option("options")]))


def effective_cost(with_opts: DataFrame) -> DataFrame:
    return effective_offers(with_opts).select("shipment_id", F.explode("offers").alias("o")).select("shipment_id", "o.*")


def argmin_option(with_opts: DataFrame) -> DataFrame:
    """Per shipment the least effective cost, ties in list order: the joint choice without shared limits."""
    best = once(effective_offers(with_opts).select("shipment_id", "offers"), "o", F.array_min("offers"))
    return best.filter("o is not null").select("shipment_id", "o.*")


# --- recommendations ----------------------------------------------------------
RECOMMENDATION = (
    "shipment_id", "predicted_delay_days", "delay_probability", "tier", "recommended_action", "estimated_cost_usd",
    "expected_delay_after_action_days", "business_impact_usd", "optimization_status", "confidence_score",
)


def tiered(with_opts: DataFrame) -> DataFrame:
    p = F.col("delay_probability")
    return with_opts.withColumn("tier", tier(p)).withColumn("confidence_score", tier_confidence(p))


def _recommendation(status, action, cost, after, impact):
    return [
        "shipment_id",
        F.col("expected_delay_days").alias("predicted_delay_days"),
        "delay_probability",
        "tier",
        action.alias("recommended_action"),
        cost.alias("estimated_cost_usd"),
        after.alias("expected_delay_after_action_days"),
        impact.alias("business_impact_usd"),
        status.alias("optimization_status"),
        "confidence_score",
    ]


def _simple_terms() -> list[Column]:
    """Status, action, cost, delay and impact from ``o``, the cheapest option of the low tier."""
    none, found = F.col("tier") == P.TIER_NONE, F.col("o").isNotNull()
    saved = rnd(F.coalesce(delay_launch_cost(), F.col("o.cost_usd")) - F.col("o.cost_usd"), 2)
    return [
        F.when(none, "Not_Required").when(found, "Heuristic_Optimal").otherwise("Infeasible"),
        F.when(none, "No_Action_Required").when(found, F.col("o.option_name")).otherwise("No_Feasible_Option"),
        F.coalesce(F.col("o.cost_usd"), F.lit(0.0)),
        F.coalesce(F.col("o.expected_delay_days"), F.col("expected_delay_days")),
        F.when(found, saved).otherwise(0.0),
    ]


def _chosen_terms(status: Column) -> list[Column]:
    """The same from a ``choice`` struct (null when nothing is possible)."""
    found = F.col("choice").isNotNull()
    total = F.col("choice.cost_usd") + F.col("choice.carbon_cost") + F.col("choice.late_penalty")
    return [
        F.when(found, status).otherwise("Infeasible"),
        F.when(found, F.col("choice.option_name")).otherwise("No_Feasible_Option"),
        F.coalesce(F.col("choice.cost_usd"), F.lit(0.0)),
        F.coalesce(F.col("choice.expected_delay_days"), F.col("expected_delay_days")),
        F.when(found, rnd(F.col("baseline") - total, 2)).otherwise(0.0),
    ]


def _with_cheapest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("o", F.when(F.col("tier") == P.TIER_LOW, cheapest()))


def recommend_simple(with_opts: DataFrame) -> DataFrame:
    """Recommendations for the two tiers that need no joint choice, in one projection."""
    rows = _with_cheapest(tiered(with_opts).filter(F.col("tier") != P.TIER_FULL))
    return rows.select(*_recommendation(*_simple_terms()))


def recommend_chosen(with_choice: DataFrame, status: Column) -> DataFrame:
    """Recommendations of the full tier from a ``choice`` struct (null when nothing is possible)."""
    return with_choice.select(*_recommendation(*_chosen_terms(status)))


def recommend_each(
    with_opts: DataFrame, budget: float = P.DEFAULT_BUDGET_USD, carbon: float = P.DEFAULT_CARBON_KG, capacities: DataFrame | None = None
) -> DataFrame:
    """Every shipment on its own, as in the one-at-a-time path: no shipment takes capacity from another, but none takes more than there is.

    One pass for all tiers, so the options are joined and priced once.  The capacities come with the rows (``ROOMS``) or as a table.
    """
    from lanewright.operators.joint import by_position, fitting_offers

    full = F.col("tier") == P.TIER_FULL
    rows = _with_cheapest(effective_offers(tiered(with_opts)))
    rooms = {pos: F.col(name) for pos, name in ROOMS.items() if name in with_opts.columns}
    if rooms:
        rows = rows.withColumn("offers", F.filter("offers", lambda o: F.coalesce(o["units"], F.lit(0.0)) <= by_position(o, rooms, float("inf"))))
    elif capacities is not None:
        rows = fitting_offers(rows, capacities)
    allowed = F.filter("offers", lambda o: (o["cost_usd"] <= budget) & (o["emission_kg"] <= carbon))
    rows = rows.withColumn("choice", F.when(full, F.array_min(allowed))).withColumn("baseline", delay_launch_cost())
    terms = zip(_chosen_terms(F.lit("Optimal")), _simple_terms())
    return rows.select(*_recommendation(*[F.when(full, chosen).otherwise(simple) for chosen, simple in terms]))


def project_rename(recommendations: DataFrame) -> DataFrame:
    """Report column names."""
    titles = {
        "shipment_id": "Shipment_ID", "predicted_delay_days": "Predicted_Delay_Days", "delay_probability": "Delay_Probability",
        "tier": "Tier", "recommended_action": "Recommended_Action", "estimated_cost_usd": "Estimated_Cost_USD",
        "expected_delay_after_action_days": "Expected_Delay_After_Action_Days", "business_impact_usd": "Business_Impact_USD",
        "optimization_status": "Optimization_Status", "confidence_score": "Confidence_Score",
    }  # fixed values
    return recommendations.select(*[F.col(c).alias(t) for c, t in titles.items()])
