"""Queries for feature preparation, training, scoring and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lanewright import policy as P
from lanewright.functions import features as X
from lanewright.functions.numbers import flag, rnd
from lanewright.operators import learn, metrics, prepare, reports
from lanewright.plans import choice
from lanewright.plans.registry import query, rounded as R
from lanewright.session import materialize, release, shared_folder, small_methods
from lanewright.sources.tables import load_tables, table_counts

KEY = ["shipment_id"]


@query("encode_ordinal", "select shipment_id, " + ", ".join(
    f"case {c} " + " ".join(f"when '{v}' then {i}" for i, v in enumerate(levels)) + f" else -1 end as {c}" for c, levels in P.ORDINAL_LEVELS.items()) + " from {cargo}")
def encode_ordinal(t):
    return X.encode_ordinal(t("cargo")).select("shipment_id", *P.ORDINAL_LEVELS)


MODES = ("Air", "Rail", "Road", "Sea")
TYPES = ("Online", "Retail", "Wholesale")


@query("encode_onehot", "select shipment_id, " + ", ".join(
    [f"case when shipping_mode = '{m}' then 1 else 0 end as shipping_mode_{m}" for m in MODES]
    + [f"case when customer_type = '{m}' then 1 else 0 end as customer_type_{m}" for m in TYPES]) + " from {cargo}")
def encode_onehot(t):
    cargo = t("cargo").select("shipment_id", "shipping_mode", "customer_type")
    return prepare.encode_onehot(cargo, prepare.fit_levels(cargo, ["shipping_mode", "customer_type"]))


SCALED = ("distance", "purchase_order_value", "fuel_price")


@query("standard_scale", "select shipment_id, " + ", ".join(R(f"({c} - m_{c}) / s_{c}", 4) + f" as {c}" for c in SCALED) + " from {cargo}, (select " + ", ".join(
    f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in SCALED) + " from {cargo}) f")
def standard_scale(t):
    cargo = t("cargo").select("shipment_id", *SCALED)
    scaled = prepare.standard_scale(cargo, prepare.fit_scaler(cargo, list(SCALED)))
    return scaled.select("shipment_id", *[rnd(F.col(c), 4).alias(c) for c in SCALED])


_DRAW = "cast('0x' || substr(md5(shipment_id || '|42'), 1, 13) as bigint)"


@query("plain_split", f"select shipment_id, case when {_DRAW} < {int(0.2 * (1 << 52))} then 1 else 0 end as is_test from {{cargo}}")
def plain_split(t):
    return learn.plain_split(t("cargo").select("shipment_id"), KEY)


@query("stratified_split", f"""
select shipment_id, delay, case when rn - 1 < round_even(n * 0.2e0, 0) then 1 else 0 end as is_test from (
  select shipment_id, delay, row_number() over (partition by delay order by {_DRAW}, shipment_id) as rn, count(*) over (partition by delay) as n from {{cargo}}) x""")
def stratified_split(t):
    return learn.stratified_split(t("cargo").select("shipment_id", "delay"), KEY, "delay").select("shipment_id", "delay", "is_test")


CELLS_CTE = """c as (select count(case when label = 1 and probability >= 0.5 then 1 end) * 1e0 as tp, count(case when label = 0 and probability >= 0.5 then 1 end) * 1e0 as fp,
  count(case when label = 1 and probability < 0.5 then 1 end) * 1e0 as fn, count(case when label = 0 and probability < 0.5 then 1 end) * 1e0 as tn from {scored})"""
AUC_CTE = """g as (select probability, count(case when label = 1 then 1 end) as pos, count(case when label = 0 then 1 end) as neg from {scored} group by probability),
a as (select sum(pos * (coalesce(below, 0) + neg / 2e0)) / (sum(pos) * 1e0 * sum(neg)) as auc from (
  select *, sum(neg) over (order by probability rows between unbounded preceding and 1 preceding) as below from g) x)"""
METRICS_SQL = f"""{CELLS_CTE}, {AUC_CTE},
m as (select {R('(tp + tn) / (tp + tn + fp + fn)', 6)} as accuracy, {R('tp / (tp + fp)', 6)} as "precision", {R('tp / (tp + fn)', 6)} as recall,
  {R('2 * tp / (2 * tp + fp + fn)', 6)} as f1_score, {R('auc', 6)} as roc_auc from c, a)"""


@query("classification_metrics", f"with {METRICS_SQL} select * from m")
def classification_metrics(t):
    return metrics.classification_metrics(t("scored"))


@query("quality_gate", f"with {METRICS_SQL} select accuracy, roc_auc, accuracy > 0.9 and roc_auc > 0.92 as meets_target from m")
def quality_gate(t):
    return metrics.quality_gate(metrics.classification_metrics(t("scored")))


@query("confusion_matrix", """select label, predicted, count(*) as n from (
  select label, case when probability >= 0.5 then 1 else 0 end as predicted from {scored}) x group by label, predicted""")
def confusion_matrix(t):
    return metrics.confusion_matrix(t("scored"))


def _report_row(name: str, p: str, r: str, f: str, s: str) -> str:
    return f"""select '{name}' as "class", {R(p, 6)} as "precision", {R(r, 6)} as recall, {R(f, 6)} as f1_score, cast({s} as bigint) as support from v"""


@query("classification_report", f"""with {CELLS_CTE},
v as (select tn / (tn + fn) as p0, tn / (tn + fp) as r0, 2 * tn / (2 * tn + fn + fp) as f0, tn + fp as s0, tp / (tp + fp) as p1, tp / (tp + fn) as r1,
  2 * tp / (2 * tp + fp + fn) as f1, tp + fn as s1, (tp + tn) / (tp + tn + fp + fn) as acc from c)
""" + " union all ".join([
    _report_row("No Delay", "p0", "r0", "f0", "s0"), _report_row("Delay", "p1", "r1", "f1", "s1"), _report_row("accuracy", "acc", "acc", "acc", "s0 + s1"),
    _report_row("macro avg", "(p0 + p1) / 2", "(r0 + r1) / 2", "(f0 + f1) / 2", "s0 + s1"),
    _report_row("weighted avg", "(p0 * s0 + p1 * s1) / (s0 + s1)", "(r0 * s0 + r1 * s1) / (s0 + s1)", "(f0 * s0 + f1 * s1) / (s0 + s1)", "s0 + s1")]))
def classification_report(t):
    return metrics.classification_report(t("scored"))


CURVE_CTE = """g as (select probability, count(case when label = 1 then 1 end) as pos, count(case when label = 0 then 1 end) as neg from {scored} group by probability),
k as (select probability, sum(pos) over (order by probability desc) as tp, sum(neg) over (order by probability desc) as fp, sum(pos) over () as np, sum(neg) over () as nn from g)"""


@query("roc_points", f"with {CURVE_CTE} select probability, {R('fp * 1e0 / nn', 6)} as fpr, {R('tp * 1e0 / np', 6)} as tpr from k")
def roc_points(t):
    return metrics.roc_points(t("scored"))


@query("pr_points", f"""with {CURVE_CTE} select probability, {R('tp * 1e0 / (tp + fp)', 6)} as "precision", {R('tp * 1e0 / np', 6)} as recall from k""")
def pr_points(t):
    return metrics.pr_points(t("scored"))


@query("best_threshold", f"""
with h as (select probability, count(case when label = 1 then 1 end) as pos, count(case when label = 0 then 1 end) as neg from {{scored}} group by probability),
grid as (select range as k, range * 0.01e0 + 0.05e0 as thr from range(91)),
acc as (select k, thr, sum(case when probability >= thr then pos else neg end) as hit, sum(pos + neg) as n from grid, h group by k, thr)
select {R('thr', 2)} as threshold, {R('hit * 1e0 / n', 6)} as accuracy from acc order by hit desc, k limit 1""")
def best_threshold(t):
    return metrics.best_threshold(t("scored"))


@query("regression_metrics", f"""
select {R('avg(abs(actual - predicted))', 4)} as mae, {R('1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*))', 4)} as r2
from (select greatest(lead_time - expected_lead_time, 0e0) as actual, expected_lead_time * 0.15e0 as predicted from {{cargo}}) x""")
def regression_metrics(t):
    return metrics.regression_metrics(
        t("cargo").select(X.delay_days(F.col("lead_time"), F.col("expected_lead_time")).alias("actual"), (F.col("expected_lead_time") * 0.15).alias("predicted"))
    )


@query("load_reference_tables", " union all ".join(f"select '{n}' as table_name, count(*) as n_rows from {n}" for n in ("nation", "orders", "part", "region", "supplier")))
def load_reference_tables(t):
    return table_counts(load_tables(t.spark, t.sf_dir, ("nation", "orders", "part", "region", "supplier")))


@query("table_scan", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def table_scan(t):
    return t("supplier")


# --- training: rows-only, invariants in the tests -----------------------------------
_PREPARED: dict[tuple, tuple] = {}


def prepared(t):
    """(preparation, train, test): split first, fitted on the training rows only; shared within a session until an input file changes."""
    key = t.stamp("cargo")
    if key not in _PREPARED:
        small_methods(t.spread("lineitem", "l_orderkey", "l_linenumber"))
        rows = learn.plain_split(X.derived_features(t("cargo")), KEY)
        rows = materialize(rows, "cargo")
        train = rows.filter("is_test = 0").drop("is_test")
        prep = prepare.preprocess_fit(train)
        ready = materialize(_apply(rows, prep), "prepared")
        release(rows)
        _PREPARED[key] = (prep, ready.filter("is_test = 0"), ready.filter("is_test = 1"))
    return _PREPARED[key]


def _apply(rows, prep):
    days = X.delay_days(F.col("lead_time"), F.col("expected_lead_time"))
    return prepare.preprocess_apply(rows.withColumn("delay_days", days), prep, [*KEY, "delay", "delay_days", "is_test"])


@query("preprocess_fit")
def preprocess_fit(t):
    prep = prepared(t)[0]
    rows = [(c, *map(float, prep.scaler.get(c, (0.0, 1.0)))) for c in prep.features]
    return t.spark.createDataFrame(rows, "feature string, mean double, std double")


@query("preprocess_apply")
def preprocess_apply(t):
    _, train, test = prepared(t)
    return train.unionByName(test).drop("delay_days")


_MODELS: dict[tuple, object] = {}


def _fitted(t, name, train, **params):
    """A model of the prepared rows; the queries that use it share it until an input file changes."""
    key = (name, *params.values(), *t.stamp("cargo"))
    if key not in _MODELS:
        prep, rows, _ = prepared(t)
        _MODELS[key] = train(learn.assemble(rows, prep.features), name, **params)
    return _MODELS[key]


def classifier(t, **params):
    return _fitted(t, "delay", learn.train_classifier, **params)


def duration_model(t, **params):
    return _fitted(t, "delay_days", learn.train_duration, **params)


def _scored(t):
    prep, _, test = prepared(t)
    return learn.score_batch(learn.assemble(test, prep.features), classifier(t))


@query("train_classifier")
def train_classifier(t):
    made = _scored(t).select(F.col("delay").alias("label"), F.col("delay_probability").alias("probability"))
    return metrics.classification_metrics(made)


@query("score_batch")
def score_batch(t):
    return _scored(t).select("shipment_id", "delay_probability", "delay_prediction")


@query("model_quality_gate")
def model_quality_gate(t):
    """The release gate on what the trained model scores on held-out rows."""
    made = _scored(t).select(F.col("delay").alias("label"), F.col("delay_probability").alias("probability"))
    return metrics.quality_gate(metrics.classification_metrics(made))


@query("feature_importance")
def feature_importance(t):
    return learn.feature_importance(t.spark, classifier(t), prepared(t)[0].features)


@query("feature_top20")
def feature_top20(t):
    return learn.feature_top(t.spark, classifier(t), prepared(t)[0].features, 20)


@query("explain_global")
def explain_global(t):
    prep, _, test = prepared(t)
    return learn.explain_global(test, classifier(t), prep.features, KEY)


@query("train_forest")
def train_forest(t):
    prep, train, test = prepared(t)
    model = learn.train_forest(learn.assemble(train, prep.features), "delay")
    made = learn.score_batch(learn.assemble(test, prep.features), model)
    return metrics.classification_metrics(made.select(F.col("delay").alias("label"), F.col("delay_probability").alias("probability")))


@query("train_duration")
def train_duration(t):
    prep, _, test = prepared(t)
    made = learn.score_duration(learn.assemble(test, prep.features), duration_model(t))
    return metrics.regression_metrics(made.select(F.col("delay_days").alias("actual"), F.col("expected_delay_days").alias("predicted")))


@query("tune_classifier")
def tune_classifier(t):
    """30 draws in 5 folds over forests, compared on all labelled rows; the same search over boosted trees takes hours."""
    prep, train, _ = prepared(t)
    rows = learn.assemble(train, prep.features).select(*KEY, "features", "delay")
    return learn.tune_classifier(rows, "delay", KEY, parallelism=8, forest=True)[1]


def score_active(t, **params):
    """Probability and expected delay of every shipment by the two models, written once, in place of the given predictions."""
    prep, train, test = prepared(t)
    rows = learn.assemble(train.drop("delay", "delay_days").unionByName(test.drop("delay", "delay_days")), prep.features)
    both = learn.score_duration(learn.score_batch(rows, classifier(t, **params)), duration_model(t, **params))
    scores = both.select(*KEY, "delay_probability", F.col("delay_prediction").alias("predicted_delay_flag"), "expected_delay_days")
    t.known["delay_predictions"] = materialize(scores, "scores")
    return t


@query("recommend_scored")
def recommend_scored(t):
    """The whole flow: both models score the shipments, the probability sets the tier, and the tier decides between options."""
    return choice.each(score_active(t))


@query("scored_kpis")
def scored_kpis(t):
    return reports.batch_kpis(choice.each(score_active(t)), P.DEFAULT_BUDGET_USD, P.DEFAULT_CARBON_KG)


@query("model_save_load")
def model_save_load(t):
    prep, _, test = prepared(t)
    folder = f"{shared_folder(t.spark)}/model-{uuid.uuid4().hex}"
    learn.save_model(classifier(t), prep, folder, t.spark, test)
    model, again = learn.load_model(t.spark, folder)
    made = learn.score_batch(learn.assemble(test, again.features), model)
    return made.select("shipment_id", "delay_probability", "delay_prediction")


@query("warehouse_model")
def warehouse_model(t):
    """The warehouse variant: six raw features, missing ones 0, high risk above 0.4."""
    raw = t("warehouses").withColumn("is_delayed", flag(F.col("transport_issue_l1y") > P.DELAYED_ISSUES_OVER))
    cols = [F.coalesce(F.col(c), F.lit(0)).alias(c) if c in raw.columns else F.lit(0).alias(c) for c in learn.WAREHOUSE_FEATURES]
    rows = learn.assemble(raw.select("warehouse_id", "is_delayed", *cols), list(learn.WAREHOUSE_FEATURES))
    split = learn.plain_split(rows, ["warehouse_id"])
    model = learn.train_classifier(split.filter("is_test = 0"), "is_delayed")
    made = learn.score_batch(rows, model, learn.WAREHOUSE_RISK_ABOVE, strict=True)
    return made.select("warehouse_id", "delay_probability", F.col("delay_prediction").alias("is_high_risk"))
