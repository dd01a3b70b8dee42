import os

import pytest
from pyspark.sql import functions as F

from lanewright.functions import features as X
from lanewright.operators import gram, learn, metrics, prepare, quantiles
from lanewright.plans import choice, modelling
from lanewright.plans.bindings import bind
from lanewright.plans.registry import Inputs
from lanewright.session import materialize

SF = "/root/testdata/sf0.001"


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, probability double")


def test_metrics_on_perfect_inverted_and_tied_scores(spark):
    perfect = metrics.classification_metrics(scored(spark, [(1, 0.9), (1, 0.8), (0, 0.1)])).first()
    assert perfect["accuracy"] == 1.0 and perfect["roc_auc"] == 1.0
    inverted = metrics.classification_metrics(scored(spark, [(0, 0.9), (1, 0.1)])).first()
    assert inverted["roc_auc"] == 0.0 and inverted["precision"] == 0.0
    assert metrics.roc_auc(scored(spark, [(0, 0.5), (1, 0.5), (1, 0.5)])).first()[0] == 0.5
    assert metrics.roc_auc(scored(spark, [(1, 0.5)])).first()[0] is None


def test_best_threshold_takes_the_first_maximum(spark):
    row = metrics.best_threshold(scored(spark, [(0, 0.301), (1, 0.809), (0, 0.01), (1, 0.99)])).first()
    assert (row["threshold"], row["accuracy"]) == (0.31, 1.0)


def test_splits_are_exact_and_stable(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    parts = learn.stratified_split(df, ["k"], "y").groupBy("y", "is_test").count().collect()
    assert {(r["y"], r["is_test"]): r["count"] for r in parts} == {(0, 0): 600, (0, 1): 150, (1, 0): 200, (1, 1): 50}
    a = learn.plain_split(df.repartition(7), ["k"]).filter("is_test = 1").select("k")
    b = learn.plain_split(df, ["k"]).filter("is_test = 1").select("k")
    assert a.exceptAll(b).isEmpty() and 120 < b.count() < 280


@pytest.fixture(scope="module")
def cargo(spark):
    return materialize(X.derived_features(bind(spark, SF, "cargo")), "test-cargo")


def test_preparation_is_fitted_once_and_reused(spark, cargo):
    prep = prepare.preprocess_fit(cargo)
    again = prepare.Preparation.from_json(prep.to_json())
    made = prepare.preprocess_apply(cargo, again, ["shipment_id", "delay"])
    assert made.columns == [*prep.features, "shipment_id", "delay"] and made.count() == cargo.count()
    assert not set(prepare.NEVER_FEATURES) & set(prep.features)
    # carbon emission is twice the weight, so the later twin goes
    assert "shipment_weight" in prep.features and "carbon_emission" not in prep.features
    stats = made.agg(F.avg("distance").alias("m"), F.stddev_pop("distance").alias("s")).first()
    assert stats["m"] == pytest.approx(0, abs=1e-9) and stats["s"] == pytest.approx(1, abs=1e-9)
    odd = cargo.limit(1).withColumn("shipping_mode", F.lit("Balloon")).withColumn("supplier_rating", F.lit(None).cast("double"))
    row = prepare.preprocess_apply(odd, prep).first()
    assert sum(row[c] for c in prep.features if c.startswith("shipping_mode_")) == 0 and row["supplier_rating"] is not None
    with pytest.raises(ValueError, match="distance"):
        prepare.preprocess_fit(cargo.drop("distance"))


def test_flat_columns_are_found_by_one_vector_aggregate(spark):
    rows = spark.createDataFrame([(1.0, 2, 5.0, None, 0), (1.0, 3, None, 4.0, 0), (1.0, 2, 5.0, 6.0, 0)], "a double, b int, c double, d double, e int")
    assert prepare.zero_variance_dense(rows, rows.columns) == prepare.zero_variance(rows, rows.columns) == ["a", "c", "e"]
    assert prepare.zero_variance_dense(rows.limit(1), ["a", "b"]) == prepare.zero_variance(rows.limit(1), ["a", "b"]) == []


def test_the_preparation_deals_its_input_out(spark, monkeypatch):
    modelling._PREPARED.clear()
    seen = {}

    def stop(df, label="stage"):
        seen[label] = df._jdf.queryExecution().analyzed().toString()
        raise InterruptedError

    monkeypatch.setattr(modelling, "materialize", stop)
    with pytest.raises(InterruptedError):
        modelling.prepared(Inputs(spark, SF))
    assert "RepartitionByExpression" in seen["cargo"]


def test_the_dealt_input_fills_whole_waves_of_cores(spark):
    rows = Inputs(spark, SF).spread("lineitem", "l_orderkey", "l_linenumber")
    cores = spark.sparkContext.defaultParallelism
    waves = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // cores)
    sizes = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == waves * cores and rows.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_the_preparation_leaves_huge_methods_to_compiled_projections(spark, monkeypatch):
    modelling._PREPARED.clear()
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")

    def stop(df, label="stage"):
        raise InterruptedError

    monkeypatch.setattr(modelling, "materialize", stop)
    with pytest.raises(InterruptedError):
        modelling.prepared(Inputs(spark, SF))
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_close_columns_are_found_among_columns_with_gaps(spark):
    rows = spark.range(400).select(F.col("id").cast("double").alias("a"), (F.col("id") * F.col("id") % 17).alias("b"), F.when(F.col("id") % 5 > 0, -2.0 * F.col("id")).alias("c"))
    assert prepare.correlated_dense(rows, ["a", "b", "c"]) == prepare.correlated(rows, ["a", "b", "c"]) == ["c"]


def test_given_centres_spare_the_pass_over_the_means(spark):
    rows = spark.range(500).select(F.col("id").cast("double").alias("a"), (F.col("id") * 31 % 101 + 1e6).alias("b"), (F.col("id") % 7).alias("c"))
    count, means, spread = prepare.moments_dense(rows, rows.columns)
    assert count == 500 and means["a"] == pytest.approx(249.5) and spread["c"] == pytest.approx(rows.agg(F.var_samp("c")).first()[0])
    made = {(r["a"], r["b"]): r["corr"] for r in gram.correlation_wide(rows, rows.columns, means).collect()}
    plain = {(r["a"], r["b"]): r["corr"] for r in gram.correlation_wide(rows, rows.columns).collect()}
    assert made == pytest.approx(plain)


def test_sketches_are_no_finer_than_a_window_needs(spark, monkeypatch):
    asked, sketch = [], F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda c, p, accuracy: (asked.append(accuracy), sketch(c, p, accuracy))[1])
    rows = spark.range(60_001).select((F.col("id") * 7 % 60_001).alias("v"), F.when(F.col("id") % 3 > 0, F.lit(5)).otherwise(F.col("id")).alias("w"))
    found = quantiles.exact_quantiles(rows, ["v", "w"], [0.25, 0.5])
    assert found["v"] == {0.25: 15_000.0, 0.5: 30_000.0} and found["w"][0.5] == 5.0
    assert asked and max(asked) < 1_000


def test_a_stamp_lists_files_without_reading_them(spark, tmp_path):
    (tmp_path / "lineitem.parquet").write_bytes(b"no rows to read")
    t = Inputs(spark, str(tmp_path))
    before = t.stamp("cargo")
    (tmp_path / "lineitem.parquet").write_bytes(b"no rows to read either")
    assert t.stamp("cargo") != before


def test_classifier_passes_the_gate_on_separable_rows(spark, tmp_path):
    rows = spark.range(2000).select(
        F.col("id").cast("string").alias("k"), (F.xxhash64("id") % 1000 / 1000.0).alias("a"), (F.xxhash64(F.col("id") + 7) % 1000 / 1000.0).alias("b")
    ).withColumn("y", (F.col("a") + F.col("b") > 0).cast("int"))
    ready = learn.assemble(rows, ["a", "b"])
    split = learn.stratified_split(ready, ["k"], "y")
    model = learn.train_classifier(split.filter("is_test = 0"), "y", maxIter=10)
    made = learn.score_batch(split.filter("is_test = 1"), model)
    result = metrics.classification_metrics(made.select(F.col("y").alias("label"), F.col("delay_probability").alias("probability")))
    assert metrics.quality_gate(result).first()["meets_target"]
    learn.save_model(model, prepare.Preparation(features=["a", "b"]), str(tmp_path), spark)
    loaded, prep = learn.load_model(spark, str(tmp_path))
    assert prep.features == ["a", "b"]
    same = learn.score_batch(split.filter("is_test = 1"), loaded)
    assert same.select("k", "delay_probability").exceptAll(made.select("k", "delay_probability")).isEmpty()
    wide = rows.withColumn("c", F.lit(0.0))
    names = ["a", "b", "c"]
    explained = learn.explain_global(wide, learn.train_classifier(learn.assemble(wide, names), "y", maxIter=3), names, ["k"], 300)
    change = {r["feature"]: r["mean_abs_change"] for r in explained.collect()}
    assert change["c"] == 0 and min(change["a"], change["b"]) > 0.05
    assert {"stepSize", "maxDepth", "maxIter"} <= set(learn.search_space(2)[0])
    assert {"numTrees", "maxDepth"} <= set(learn.search_space(2, forest=True)[0])


def test_scored_flow_follows_the_stored_scores(spark):
    t = modelling.score_active(Inputs(spark, SF), maxIter=3)
    scores = {r["shipment_id"]: r for r in t("delay_predictions").collect()}
    options = {r["shipment_id"]: r for r in choice.optioned(t).select("shipment_id", "options").collect()}
    made = choice.each(t).collect()
    assert len(made) == len(scores) == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert {r["shipment_id"] for r in made} == set(scores)
    for r in made:
        score = scores[r["shipment_id"]]
        p = score["delay_probability"]
        assert r["delay_probability"] == p and score["expected_delay_days"] >= 0 and (abs(p - 0.5) < 1e-4 or score["predicted_delay_flag"] == int(p >= 0.5))
        assert r["tier"] == ("NO_ACTION_REQUIRED" if p < 0.4 else "LOW_COST_MITIGATION" if p < 0.7 else "FULL_OPTIMIZATION")
        names = {o["option_name"]: o for o in options[r["shipment_id"]]["options"]}
        if r["tier"] == "NO_ACTION_REQUIRED":
            assert (r["recommended_action"], r["estimated_cost_usd"]) == ("No_Action_Required", 0)
        elif r["recommended_action"] != "No_Feasible_Option":
            assert names[r["recommended_action"]]["feasible"] and names[r["recommended_action"]]["cost_usd"] == r["estimated_cost_usd"]


def test_models_are_made_again_when_a_file_changes(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    rows.limit(50).write.parquet(f"{tmp_path}/lineitem.parquet")
    t = Inputs(spark, str(tmp_path))
    before = t.stamp("cargo")
    assert t.stamp("cargo") == before
    rows.limit(60).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    assert t.stamp("cargo") != before


def test_the_search_compares_its_draws_on_all_labelled_rows(spark, monkeypatch):
    """More rows than the 6,000 on which the draws were once compared."""
    seen, write = {}, learn.materialize

    def watched(df, label="stage"):
        made = write(df, label)
        seen[label] = made.count()
        return made

    rows = spark.range(7_000).select(F.col("id").cast("string").alias("shipment_id"), (F.col("id") % 3).alias("a"), (F.col("id") % 2).cast("int").alias("delay"))
    prep = prepare.Preparation(features=["a"])
    monkeypatch.setattr(modelling, "prepared", lambda t: (prep, rows, None))
    monkeypatch.setattr(learn, "materialize", watched)
    monkeypatch.setattr(learn, "search_space", lambda n, seed=42, forest=False: [{"numTrees": 2, "maxDepth": 2}, {"numTrees": 1, "maxDepth": 1}])
    made = modelling.tune_classifier(Inputs(spark, SF)).collect()
    assert len(made) == 2 and seen["folds"] == 7_000


def test_only_rows_whose_hash_repeats_are_dealt_out(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a", 0.0), (1, "a", -0.0), (2, None, float("nan")), (2, None, float("nan")), (2, "None", 1.0), (3, None, None), (4, "b", 2.0)], "k int, `t.x` string, v double")
    more = rows.union(spark.range(50).select(F.col("id").cast("int"), F.lit("c"), F.col("id") / 3))
    for most in (prepare.SENT_HASHES, 0):
        monkeypatch.setattr(prepare, "SENT_HASHES", most)
        made, want = prepare.distinct_rows(more), more.dropDuplicates()
        assert made.count() == want.count() == 55 and made.exceptAll(want).isEmpty()
    alone = spark.range(100).withColumn("v", F.col("id") * 2)
    assert "Aggregate" not in prepare.distinct_rows(alone)._jdf.queryExecution().optimizedPlan().toString()


def test_the_preparation_leaves_only_its_rows_on_disk(spark, monkeypatch):
    modelling._PREPARED.clear()
    written, write = [], materialize

    def watched(df, label="stage"):
        made = write(df, label)
        written.append((label, made.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")))
        return made

    monkeypatch.setattr(modelling, "materialize", watched)
    monkeypatch.setattr(prepare, "materialize", watched)
    _, train, test = modelling.prepared(Inputs(spark, SF))
    assert [label for label, path in written if os.path.isdir(path) and label != "repeated"] == ["prepared"]
    assert train.count() + test.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_changes_of_boosted_trees_are_those_of_scored_copies(spark, monkeypatch):
    rows = spark.range(900).select(
        F.col("id").cast("string").alias("k"), *[(F.xxhash64(F.col("id") + i) % 40 / 10.0).alias(f"f{i}") for i in range(5)], F.lit(1).alias("flat"),
        F.when(F.col("id") % 6 > 0, F.col("id") % 9).alias("gaps"),
    ).withColumn("y", (F.col("f0") + F.col("f1") * F.col("f2") + F.coalesce("gaps", F.lit(20)) / 4 > 2).cast("int"))
    names = [*[f"f{i}" for i in range(5)], "flat", "gaps"]
    model = learn.train_classifier(learn.assemble(rows.fillna(20, ["gaps"]), names), "y", maxIter=6)
    got = {r["feature"]: r["mean_abs_change"] for r in learn.explain_global(rows, model, names, ["k"]).collect()}
    explained = []
    monkeypatch.setattr(learn, "masked_trees", lambda spark, model: explained.append(model))
    want = {r["feature"]: r["mean_abs_change"] for r in learn.explain_global(rows, model, names, ["k"]).collect()}
    assert explained and got == pytest.approx(want, abs=1e-9) and got["flat"] == 0 and got["f1"] > 0.01 and got["gaps"] > 0.01


def test_boosted_rows_are_not_copied_for_each_feature(spark):
    rows = spark.range(60).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).alias("a"), (F.col("id") % 5).alias("b")).withColumn("y", (F.col("a") > 3).cast("int"))
    model = learn.train_classifier(learn.assemble(rows, ["a", "b"]), "y", maxIter=1)
    plan = learn.explain_global(rows, model, ["a", "b"], ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
