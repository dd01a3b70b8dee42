"""Business constants.  All of these are fixed values: results depend on them."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: warehouse risk queue -------------------------------------
ISSUE_POINTS = 25.0
BREAKDOWN_POINTS = 20.0
DISTANCE_POINTS, DISTANCE_CAP = 0.3, 100.0
WEIGHT_POINTS, WEIGHT_CAP = 0.05, 500.0
PRIORITY_CUTS = (("CRITICAL", 80.0), ("HIGH", 50.0), ("MEDIUM", 20.0))
PRIORITY_FLOOR = "LOW"
RISK_GAUGE_MAX = 150.0
DELAYED_ISSUES_OVER = 2

# --- fixed values: per-warehouse choices ------------------------------------
DEFAULT_DISTANCE, DEFAULT_WEIGHT, DEFAULT_CAPACITY = 100.0, 15000.0, "Mid"
CAPACITY_FACTOR = {"Large": 1.2, "Mid": 1.0, "Medium": 1.0}
CAPACITY_FACTOR_OTHER = 0.85
CHOICE_COST_CAP, CHOICE_PER_DISTANCE, CHOICE_PER_WEIGHT = 50000.0, 45.0, 0.45
CHOICE_DISTANCE_PER_DAY = 120.0
# (code, label, budget, cost factor on choice A, extra days, five allocation shares)
CHOICES = (
    ("A", "Choice A: Express Air Freight (Fast)", 50000, 1.0, 0, (0.4, 0.3, 0.15, 0.1, 0.05)),
    ("B", "Choice B: Secondary Regional Supplier (Balanced)", 30000, 0.65, 3, (0.35, 0.35, 0.2, 0.07, 0.03)),
    ("C", "Choice C: Economy Rail Re-route (Low Cost)", 25000, 0.38, 8, (0.25, 0.25, 0.25, 0.15, 0.1)),
)
LP_SCENARIOS = (
    ("Choice A (High Budget)", 50000.0),
    ("Choice B (Medium Budget)", 30000.0),
    ("Choice C (Low Budget)", 25000.0),
)

# --- fixed values: tiers -----------------------------------------------------
LOW_RISK, HIGH_RISK = 0.40, 0.70
TIER_NONE, TIER_LOW, TIER_FULL = "NO_ACTION_REQUIRED", "LOW_COST_MITIGATION", "FULL_OPTIMIZATION"
CONFIDENCE_SPAN = 0.20
LENIENT_DELAY_DAYS = 6.0

# --- fixed values: mitigation options ---------------------------------------
RESIDUAL_SHARE = {"Air": 0.12, "Rail": 0.55, "Sea": 0.85}
CARBON_PRICE_PER_KG = 0.08
SAFETY_STOCK_PREMIUM = 3.0
POOLED_DAYS = 3
OPTION_SLA_DAYS, OPTION_PENALTY_PCT = 8.0, 0.012
ASSIGN_SLA_DAYS, ASSIGN_PENALTY_PCT, ASSIGN_PRIORITY = 8.0, 0.015, "Medium"
HARD_SLA_PRIORITIES = ("Critical", "High")
DEFAULT_BUDGET_USD, DEFAULT_CARBON_KG = 500_000.0, 250_000.0
SECONDARY_ID_OFFSET = 90000
# mode: (cost per kg, base fee, CO2 kg per kg, days per 1000 km)
RATE_CARD = {
    "Air": (6.20, 180.0, 1.05, 0.45),
    "Sea": (0.55, 320.0, 0.015, 3.10),
    "Rail": (1.10, 150.0, 0.03, 1.40),
    "Road": (1.85, 90.0, 0.12, 1.05),
}
# priority: (SLA days, late penalty per day)
PRIORITY_TERMS = {
    "Critical": (3, 0.030),
    "High": (5, 0.020),
    "Medium": (8, 0.012),
    "Low": (14, 0.006),
}

# --- fixed values: shipment and order formulas ------------------------------
TRANSPORT_MODE_FACTOR = {"Air": 4.5, "Road": 1.2, "Rail": 0.9, "Sea": 0.5}
ORDER_RATE_PER_KM = {"Road": 0.08, "Rail": 0.05, "Air": 0.45, "Sea": 0.02}
ORDER_BASE_DAYS = {"Road": 3.0, "Rail": 5.0, "Air": 1.0, "Sea": 12.0}
LEAD_PRESSURE = {
    "weather_severity": 0.35,
    "port_congestion": 0.30,
    "route_risk": 0.25,
    "geopolitical_risk": 0.20,
    "customs_clearance_time": 0.15,
    "inspection_delay": 0.10,
    "supplier_ontime_rate": -2.0,
}
DELAY_INTERCEPT = -5.55
# (column, weight, divisor)
DELAY_DRIVERS = (
    ("weather_severity", 0.80, 10.0),
    ("port_congestion", 1.05, 10.0),
    ("route_risk", 0.75, 10.0),
    ("geopolitical_risk", 0.70, 10.0),
    ("customs_clearance_time", 0.50, 20.0),
    ("inspection_delay", 0.45, 15.0),
    ("holiday_impact", 0.60, 1.0),
    ("supplier_ontime_rate", -1.30, 1.0),
    ("supplier_rating", -0.55, 5.0),
    ("vehicle_availability", -0.35, 100.0),
)
DELAY_LEAD_GAP, DELAY_HISTORY, DELAY_PRODUCTION, DELAY_CRITICAL = 11.50, 0.65, 0.35, 0.28

# --- fixed values: feature preparation --------------------------------------
ORDINAL_LEVELS = {
    "supplier_risk": ("Low", "Medium", "High"),
    "order_priority": ("Low", "Medium", "High", "Critical"),
    "production_status": ("Delayed", "On Schedule", "Ahead of Schedule"),
}
CORRELATION_LIMIT = 0.97
IQR_SPAN = 1.5

# --- fixed values: order table meanings -------------------------------------
COLUMN_MEANING = {
    "OrderID": "Unique identifier for a purchase order; no predictive value, used for joins/traceability.",
    "OrderDate": "Date the order was placed; drives seasonality, weekday, holiday features.",
    "DeliveryDate": "Actual date goods arrived; combined with OrderDate defines realized lead time.",
    "SupplierID": "Identifies the vendor fulfilling the order; core driver of reliability/risk.",
    "SupplierRegion": "Geographic region of the supplier; proxy for logistics complexity.",
    "WarehouseID": "Destination warehouse for the order; drives capacity and regional risk.",
    "WarehouseRegion": "Geographic region of the receiving warehouse.",
    "WarehouseCapacity": "Max storage capacity (units) of the warehouse; used for inventory coverage ratios.",
    "ProductCategory": "FMCG product line; different categories have different shelf life & demand volatility.",
    "ShelfLifeDays": "Typical shelf life of the product category in days; affects urgency of delivery.",
    "TransportMode": "Mode of shipment (Road/Rail/Air/Sea); major driver of cost and lead time.",
    "DistanceKM": "Distance between supplier and warehouse; drives lead time and shipping cost.",
    "PlannedLeadTimeDays": "Expected/contracted delivery time based on mode + distance.",
    "ActualLeadTimeDays": "Realized delivery time; compared to planned to derive delay.",
    "OrderQuantity": "Units ordered; relates to demand and inventory planning.",
    "UnitCost": "Cost per unit from supplier; feeds total cost calculations.",
    "ShippingCost": "Total freight cost for the shipment.",
    "InventoryLevel": "Current stock at the destination warehouse at order time.",
    "ReorderPoint": "Inventory threshold at which replenishment should trigger.",
    "CustomerPriority": "Business priority tier of the customer/order (Standard/High/Critical).",
    "IsDelayed": "TARGET VARIABLE - 1 if shipment arrived later than planned lead time + 1 day buffer, else 0.",
}

# --- fixed values: stream remediation ---------------------------------------
MAIN_STREAM, DLQ_STREAM = "warehouses_main_stream", "warehouses_dlq_stream"


@dataclass(frozen=True)
class BreakerPolicy:
    """Error-rate limit in percent, and the counts a breaker starts or restarts from."""

    threshold: float = 2.0
    base_total: int = 1000
    base_errors: int = 5
    reset_errors: int = 4
    main_table: str = MAIN_STREAM
    dlq_table: str = DLQ_STREAM


# --- fixed values: model release gate ----------------------------------------
GATE_ACCURACY, GATE_ROC_AUC = 0.90, 0.92

# --- fixed values: analyst assistant -----------------------------------------
# The first rule with a matching keyword gives the intent.
INTENT_KEYWORDS = (
    ("choice_a", ("choice a", "air", "fast", "express")),
    ("choice_b", ("choice b", "secondary", "supplier", "balance")),
    ("choice_c", ("choice c", "rail", "economy", "cheap", "low cost")),
    ("risk", ("risk", "delay")),
)
INTENT_OTHER = "default"
ASSISTANT_WAREHOUSE, ASSISTANT_ZONE = "target warehouse", "North"
# {w} warehouse, {z} zone, {d} distance, {t} tons
INTENT_REPLY = {
    "choice_a": "Choice A (Express Air Freight) is recommended for {w} when speed is critical. It cuts delivery delay to under 2 days for this {d} km route, though it incurs the highest cost.",
    "choice_b": "Choice B (Secondary Regional Supplier) balances cost and speed for {w}. It redistributes {t} tons across nearby hubs with an estimated 5-day lead time.",
    "choice_c": "Choice C (Economy Rail Re-route) saves up to 60% in shipping costs for {w}, but adds an estimated 8 to 12 days of transit delay.",
    "risk": "The delay risk for {w} stems primarily from distance to hub ({d} km) and high inventory weight ({t} tons). Implementing Choice B mitigates 80% of bottleneck risk.",
    "default": "AI Advisor for {w} ({z} Zone, {d} km from hub): Based on SciPy optimization, Choice B is the recommended balanced option for high-volume inventory ({t} tons).",
}

# --- fixed values: ROI summary sentence --------------------------------------
ROI_NOTHING = "Log actual outcomes to unlock AI recommendation analysis and compounding business intelligence."
ROI_COUNTS = "Out of %d evaluated decisions, %d (%s%%) delivered positive ROI — beating both the prescribed cost and delay targets."
ROI_SAVED = " The AI recommendations saved a total of $%s vs. prescribed budget."
ROI_OVERSPENT = " Actual costs exceeded prescriptions by $%s — consider retraining the model."
ROI_EARLIER = " Shipments arrived %s day(s) earlier than expected on average."
ROI_LATER = " Shipments ran %s day(s) over the predicted delay on average."
