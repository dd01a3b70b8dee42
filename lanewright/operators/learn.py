"""Training, tuning, scoring and explaining delay models with Spark ML."""

from __future__ import annotations

import random

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.functions.numbers import flag, hash52, rnd
from lanewright.operators.boosted import masked_trees, summed_changes
from lanewright.operators.ordered import running_totals
from lanewright.operators.prepare import Preparation
from lanewright.operators.ranking import sample_rows
from lanewright.session import materialize

WAREHOUSE_FEATURES = (
    "dist_from_hub", "workers_num", "product_wg_ton", "wh_breakdown_l3m", "num_refill_req_l3m", "Competitor_in_mkt",
)  # fixed values
WAREHOUSE_RISK_ABOVE = 0.4  # fixed value
SHARES = 1 << 52


def plain_split(df: DataFrame, keys: list[str], test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test`` from a hash of the key: no shuffle, and the same row always falls on the same side."""
    return df.withColumn("is_test", flag(hash52(*keys, F.lit(str(seed))) < int(test_share * SHARES)))


def stratified_split(df: DataFrame, keys: list[str], label: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: exactly the rounded share of every label, in order of a hash of the key.

    The rank within a label comes from the sliced running total, so a label with
    most of the rows is not ranked in one task.
    """
    drawn = df.withColumn("_draw", hash52(*keys, F.lit(str(seed)))).withColumn("_one", F.lit(1))
    ranked = running_totals(drawn, ["_draw", *keys], ["_one"], [label])
    sizes = df.groupBy(label).agg(F.rint(F.count("*") * test_share).alias("_size"))
    return ranked.join(sizes, label).withColumn("is_test", flag(F.col("_one_before") < F.col("_size"))).drop("_draw", "_one", "_one_before", "_size")


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight the positive class by negatives per positive."""
    n = df.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).first()
    return df.withColumn("weight", F.when(F.col(label) == 1, n["neg"] / max(n["pos"], 1)).otherwise(F.lit(1.0)))


def train_classifier(train: DataFrame, label: str, **params) -> Model:
    """Boosted trees on a ``features`` vector."""
    settings = {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "seed": 42} | params  # fixed values
    return GBTClassifier(labelCol=label, weightCol="weight", **settings).fit(class_weights(train, label))


def train_forest(train: DataFrame, label: str, **params) -> Model:
    settings = {"numTrees": 100, "seed": 42} | params  # fixed values
    return RandomForestClassifier(labelCol=label, **settings).fit(train)


def train_duration(train: DataFrame, label: str, **params) -> Model:
    settings = {
        "maxIter": 350, "maxDepth": 5, "stepSize": 0.06, "subsamplingRate": 0.85, "featureSubsetStrategy": "0.85", "minInstancesPerNode": 3, "seed": 42,
    } | params  # fixed values
    return GBTRegressor(labelCol=label, **settings).fit(train)


def search_space(n: int, seed: int = 42, forest: bool = False) -> list[dict]:
    """Random draws: depth, row share, least gain and least rows per node, with step and rounds of boosted trees or trees and column share of a forest."""
    draw = random.Random(seed)

    def own() -> dict:
        if forest:
            return {"numTrees": draw.randint(10, 30), "featureSubsetStrategy": str(round(draw.uniform(0.6, 1.0), 3))}
        return {"stepSize": draw.uniform(0.01, 0.30), "maxIter": draw.randint(150, 649)}

    return [
        own() | {
            "maxDepth": draw.randint(3, 9),
            "subsamplingRate": draw.uniform(0.6, 1.0),
            "minInfoGain": draw.uniform(0.0, 0.05),
            "minInstancesPerNode": draw.randint(1, 9),
        }
        for _ in range(n)
    ]


def tune_classifier(
    train: DataFrame, label: str, keys: list[str], draws: int = 30, folds: int = 5, parallelism: int = 4, space=None, seed: int = 42, forest: bool = False,
):
    """Random search with stratified folds on ROC AUC; returns (best model, one row per draw).

    Every draw is compared on all labelled rows, and the best one is fitted to all of them.

    A boosted fit takes some thousand Spark jobs, one after the other, and ``draws * folds`` of them take hours; a ``forest`` grows all its trees at once, in
    about as many jobs as its depth.
    """
    spark = train.sparkSession
    drawn = train.withColumn("_draw", hash52(*keys, F.lit(str(seed)))).withColumn("_one", F.lit(1))
    dealt = running_totals(drawn, ["_draw", *keys], ["_one"], [label])
    folded = class_weights(dealt, label).withColumn("fold", (F.col("_one_before") % folds).cast("int")).drop("_draw", "_one", "_one_before")
    family = RandomForestClassifier if forest else GBTClassifier
    estimator = family(labelCol=label, weightCol="weight", seed=seed)
    candidates = space or search_space(draws, seed, forest)
    maps = [{estimator.getParam(k): v for k, v in c.items()} for c in candidates]
    judge = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=maps, evaluator=judge, numFolds=folds, foldCol="fold", parallelism=parallelism, seed=seed
    )
    fitted = search.fit(materialize(folded, "folds"))
    rows = [(i, float(m), *(float(v) for v in c.values())) for i, (m, c) in enumerate(zip(fitted.avgMetrics, candidates))]
    names = ", ".join(f"{k} double" for k in candidates[0])
    return fitted.bestModel, spark.createDataFrame(rows, f"draw int, mean_auc double, {names}")


def score_batch(df: DataFrame, model: Model, threshold: float = 0.5, strict: bool = False) -> DataFrame:
    """Adds the probability to four places and the 0/1 prediction (``strict``: above, not at, the threshold)."""
    raw = vector_to_array("probability")[1]
    scored = model.transform(df).withColumn("delay_probability", rnd(raw, 4))
    hit = raw > threshold if strict else raw >= threshold
    return scored.withColumn("delay_prediction", flag(hit)).drop("rawPrediction", "probability", "prediction")


def score_duration(df: DataFrame, model: Model) -> DataFrame:
    """Expected delay days to one place, never negative."""
    scored = model.transform(df)
    return scored.withColumn("expected_delay_days", rnd(F.greatest(F.col("prediction"), F.lit(0.0)), 1)).drop("prediction")


def feature_importance(spark: SparkSession, model: Model, features: list[str]) -> DataFrame:
    weights = model.featureImportances.toArray()
    rows = [(name, float(w)) for name, w in zip(features, weights)]  # one row per feature
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def feature_top(spark: SparkSession, model: Model, features: list[str], n: int = 20) -> DataFrame:
    return feature_importance(spark, model, features).limit(n)


def explain_global(df: DataFrame, model: Model, features: list[str], keys: list[str], sample: int | None = None, seed: int = 42) -> DataFrame:
    """Mean change of the predicted probability when one feature takes another row's value.

    Runs on all rows, or on a sample of the given size; all features are perturbed and scored in one pass.  Of a boosted model a tree is asked again only for
    the features that it splits by.
    """
    picked = df.select(*keys, *features)
    if sample is not None:
        picked = sample_rows(picked, keys, sample, seed)
    counted = running_totals(picked.withColumn("_one", F.lit(1).cast("bigint")), keys, ["_one"])
    numbered = materialize(counted.withColumnRenamed("_one_before", "_row").drop("_one"), "explained")
    n = numbered.count()
    shifted = ((F.col("_row") + n // 2) % F.lit(n)).alias("_row")
    trees = masked_trees(df.sparkSession, model)
    if trees is not None:
        other = numbered.select(shifted, *[F.col(f"`{f}`").cast("double").alias(f"_o{i}") for i, f in enumerate(features)])
        own = numbered.select("_row", *[F.col(f"`{f}`").cast("double").alias(f"_f{i}") for i, f in enumerate(features)])
        both = own.join(other, "_row").drop("_row")
        change = summed_changes(both, trees, features).groupBy("feature").agg((F.sum("total") / F.sum("n")).alias("mean_abs_change"))
    else:
        change = _changes_by_copies(numbered, shifted, model, features)
    return change.orderBy(F.col("mean_abs_change").desc(), "feature")


def _changes_by_copies(numbered: DataFrame, shifted: Column, model: Model, features: list[str]) -> DataFrame:
    """The same for any model: every row is copied and scored once a feature."""
    partner = numbered.select(shifted, F.struct(*[F.col(f).cast("double").alias(f) for f in features]).alias("other"))
    base = score_batch(assemble(numbered, features), model).select("_row", F.col("delay_probability").alias("before"))
    copies = numbered.join(partner, "_row").withColumn("feature", F.explode(F.array(*map(F.lit, features))))
    swapped = copies.select("_row", "feature", *[F.when(F.col("feature") == f, F.col(f"other.{f}")).otherwise(F.col(f)).alias(f) for f in features])
    after = score_batch(assemble(swapped, features), model).select("_row", "feature", "delay_probability")
    return after.join(base, "_row").groupBy("feature").agg(F.avg(F.abs(F.col("delay_probability") - F.col("before"))).alias("mean_abs_change"))


def save_model(model: Model, prep: Preparation, folder: str, spark: SparkSession, held_out: DataFrame | None = None) -> None:
    """The model, the fitted preparation and the held-out rows under one folder."""
    PipelineModel([model]).write().overwrite().save(f"{folder}/model")
    spark.createDataFrame([(prep.to_json(),)], "preparation string").write.mode("overwrite").json(f"{folder}/preparation")
    if held_out is not None:
        held_out.write.mode("overwrite").parquet(f"{folder}/held_out")


def load_model(spark: SparkSession, folder: str) -> tuple[PipelineModel, Preparation]:
    row = spark.read.schema("preparation string").json(f"{folder}/preparation").first()
    return PipelineModel.load(f"{folder}/model"), Preparation.from_json(row["preparation"])
