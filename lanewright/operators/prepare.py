"""Feature preparation: fitted once on training rows, applied unchanged to any later batch."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright import policy as P
from lanewright.functions.features import encode_ordinal, engineer_features
from lanewright.operators.gram import correlation_wide
from lanewright.operators.profile import correlation_matrix, quartile_fences, value_frequencies
from lanewright.operators.quantiles import exact_quantiles
from lanewright.operators.sets import align_columns, schema_check
from lanewright.session import materialize, release

NUMERIC = (
    "supplier_rating", "expected_lead_time", "historical_delay_count", "inventory_level", "inventory_days",
    "demand_forecast", "weather_severity", "traffic_index", "fuel_price", "port_congestion", "distance",
    "transportation_cost", "purchase_order_value", "vehicle_availability", "quality_score", "inspection_delay",
    "customs_clearance_time", "shipment_weight", "shipment_volume", "route_risk", "carbon_emission",
    "supplier_ontime_rate", "late_delivery_cost", "market_demand_index", "geopolitical_risk", "economic_index",
)  # fixed values
NOMINAL = (
    "supplier_country", "destination_country", "shipping_mode", "carrier", "warehouse", "customer_type",
    "packaging_type", "container_type",
)  # fixed values
BINARY = ("holiday_impact", "temperature_sensitive", "fragile")  # fixed values
CALENDAR = ("month", "quarter", "week", "year")  # fixed values
NEVER_FEATURES = ("shipment_id", "supplier_id", "order_date", "lead_time")  # fixed values
ENGINEERED = ("risk_composite_index", "cost_per_kg", "supplier_reliability_score")  # fixed values
TARGET = "delay"
UNKNOWN = "Unknown"
#: So many repeated hashes are sent to all tasks (some 30 MB); with more of them all rows are dealt out.
SENT_HASHES = 1_000_000


# --- single steps -------------------------------------------------------------
def fit_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    return {c: q[0.5] for c, q in exact_quantiles(df, columns, [0.5]).items()}


def impute_median(df: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in medians.items() if m is not None})


def fit_modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent value per column, the smallest on a tie, ``Unknown`` for an empty column."""
    best = F.min_by(F.col("value"), F.struct(-F.col("n"), F.col("value")))
    rows = value_frequencies(df, columns).groupBy("column_name").agg(best.alias("mode")).collect()  # one row per column
    found = {r["column_name"]: r["mode"] for r in rows}
    return {c: found.get(c, UNKNOWN) for c in columns}


def impute_mode(df: DataFrame, modes: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in modes.items()})


def clip_iqr(df: DataFrame, fences: dict[str, tuple[float, float] | None]) -> DataFrame:
    def clipped(c, fence):
        return F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(fence[0])), F.lit(fence[1])))

    return df.withColumns({c: clipped(c, f) for c, f in fences.items() if f is not None})


def onehot_name(column: str, value: str) -> str:
    return f"{column}_{value}"


def fit_levels(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Distinct levels per nominal column, all of them: each becomes a column of the encoded rows."""
    best = F.array_sort(F.collect_set("value")).alias("found")
    rows = value_frequencies(df, columns).groupBy("column_name").agg(best).collect()  # one row per column
    levels = {r["column_name"]: r["found"] for r in rows}
    return {c: levels.get(c, []) for c in columns}


def encode_onehot(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """One 0/1 column per fitted level; a level not seen at fit time leaves all of them 0."""
    added = [
        F.when(F.col(c) == v, 1).otherwise(0).alias(onehot_name(c, v)) for c, values in levels.items() for v in values
    ]
    return df.select(*[c for c in df.columns if c not in levels], *added)


def fit_scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation; a constant column scales by 1."""
    exprs = [e for c in columns for e in (F.avg(c).alias(f"{c}~m"), F.stddev_pop(c).alias(f"{c}~s"))]
    row = df.agg(*exprs).first()
    return {c: (row[f"{c}~m"] or 0.0, row[f"{c}~s"] or 1.0) for c in columns}


def standard_scale(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scaler.items()})


def zero_variance(df: DataFrame, columns: list[str]) -> list[str]:
    row = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] == 0]


def correlated(df: DataFrame, columns: list[str], limit: float = P.CORRELATION_LIMIT) -> list[str]:
    """Columns too close to any earlier one; a dropped column still counts for later ones."""
    close = correlation_matrix(df, columns).filter(F.abs("corr") > limit).select("b").distinct().collect()
    names = {r["b"] for r in close}  # at most one name per column
    return [c for c in columns if c in names]


def correlated_dense(df: DataFrame, columns: list[str], limit: float = P.CORRELATION_LIMIT, centres: dict[str, float] | None = None) -> list[str]:
    """The same rule for many columns: sums of blocks of rows in place of an expression for each pair."""
    close = correlation_wide(df, columns, centres).filter(F.abs("corr") > limit).select("b").distinct().collect()
    names = {r["b"] for r in close}  # at most one name per column
    return [c for c in columns if c in names]


def moments_dense(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, float], dict[str, float]]:
    """Rows, means and variances of many columns by one vector aggregate; those of a column with gaps are NaN."""
    vectors = VectorAssembler(inputCols=columns, outputCol="v", handleInvalid="keep").transform(df)
    row = vectors.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).first()["s"]  # two numbers per column
    return row["count"], dict(zip(columns, map(float, row["mean"]))), dict(zip(columns, map(float, row["variance"])))


def zero_variance_dense(df: DataFrame, columns: list[str], moments: tuple | None = None) -> list[str]:
    """The same rule as ``zero_variance`` for many columns: one vector aggregate in place of an expression each; columns with gaps are asked one by one."""
    count, _, spread = moments or moments_dense(df, columns)
    if count < 2:
        return []  # one row has no variance
    gaps = [c for c in columns if spread[c] != spread[c]]
    flat = {c for c in columns if spread[c] == 0} | set(zero_variance(df, gaps) if gaps else [])
    return [c for c in columns if c in flat]


def distinct_rows(df: DataFrame) -> DataFrame:
    """``df.dropDuplicates()`` that deals out only the rows whose hash repeats: of all others eight bytes travel."""
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    repeated = materialize(df.groupBy(hashed.alias("_hash")).count().filter("count > 1").select("_hash"), "repeated")
    n = repeated.count()
    if n == 0:
        return df
    if n > SENT_HASHES:
        return df.dropDuplicates()
    marked, sent = df.withColumn("_hash", hashed), F.broadcast(repeated)
    several = marked.join(sent, "_hash", "left_semi").drop("_hash").dropDuplicates()
    return marked.join(sent, "_hash", "left_anti").drop("_hash").unionByName(several)


# --- the whole preparation ----------------------------------------------------
@dataclass
class Preparation:
    """Everything learnt from the training rows.  All of it is small and of fixed shape."""

    medians: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)
    fences: dict = field(default_factory=dict)
    levels: dict = field(default_factory=dict)
    scaler: dict = field(default_factory=dict)
    features: list = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "Preparation":
        return Preparation(**json.loads(text))


def required_columns() -> list[str]:
    return [*NUMERIC, *NOMINAL, *BINARY, *CALENDAR, *P.ORDINAL_LEVELS]


def preprocess_fit(df: DataFrame, nominal=NOMINAL, numeric=NUMERIC) -> Preparation:
    """Learn the preparation: validate, de-duplicate, impute, clip, engineer, encode, prune, scale."""
    schema_check(df, required_columns())
    nominal, numeric = list(nominal), list(numeric)
    categories = nominal + list(P.ORDINAL_LEVELS)
    prep = Preparation()
    # Every step below passes over these rows again, so they are de-duplicated once.
    rows = materialize(distinct_rows(df), "distinct")
    prep.medians = fit_medians(rows, numeric)
    prep.modes = fit_modes(rows, categories)
    filled = impute_mode(impute_median(rows, prep.medians), prep.modes)
    prep.fences = quartile_fences(filled, numeric)
    prep.levels = fit_levels(filled, nominal)
    encoded = _encoded(filled, prep)
    candidates = [c for c in encoded.columns if c not in (*NEVER_FEATURES, TARGET)]
    # Variances, correlations and scales read the encoded rows once each, so they are worked out once.
    encoded = materialize(encoded.select(*candidates), "encoded")
    release(rows)
    moments = moments_dense(encoded, candidates)
    flat = set(zero_variance_dense(encoded, candidates, moments))
    # Identifiers and leakage columns never enter the model, so they take no part in the pruning.
    varying = [c for c in candidates if c not in flat]
    twins = set(correlated_dense(encoded, varying, centres=moments[1]))
    prep.features = [c for c in varying if c not in twins]
    prep.scaler = fit_scaler(encoded, [c for c in (*numeric, *ENGINEERED) if c in prep.features])
    release(encoded)
    return prep


def _encoded(filled: DataFrame, prep: Preparation) -> DataFrame:
    return encode_onehot(encode_ordinal(engineer_features(clip_iqr(filled, prep.fences))), prep.levels)


def preprocess_apply(df: DataFrame, prep: Preparation, keep: list[str] = ()) -> DataFrame:
    """The same steps with the fitted values: no de-duplication, no pruning, no look at the new batch's statistics."""
    filled = impute_mode(impute_median(df, prep.medians), prep.modes)
    encoded = _encoded(filled.select("*", *[F.col(c).alias(f"_keep_{c}") for c in keep]), prep)
    aligned = align_columns(encoded, [*prep.features, *[f"_keep_{c}" for c in keep]])
    scaled = standard_scale(aligned, prep.scaler)
    return scaled.withColumnsRenamed({f"_keep_{c}": c for c in keep})
