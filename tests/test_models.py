"""Training, scoring, persistence and their errors."""

import pytest
from pyspark.sql import functions as F

from shipmeter.operators import features, models, scoring
from shipmeter.operators import textfeatures as tf
from shipmeter.plans import queries as plans
from shipmeter.session import scratch_path
from shipmeter.sources import fixtures

SMALL = models.ModelConfig("random_forest", rounds=10, depth=6, min_leaf=2)


@pytest.fixture(scope="module")
def prs(spark, sf_dir):
    return fixtures.pull_requests(spark, sf_dir)


@pytest.fixture(scope="module")
def forest(prs):
    return models.fit_merge_time(prs, SMALL)


def test_forest_beats_the_training_mean(spark, forest, prs):
    rows = features.training_rows(prs)
    mean = rows.agg(F.avg("merge_time_hours")).first()[0]
    baseline = rows.agg(F.avg(F.abs(F.col("merge_time_hours") - F.lit(mean)))).first()[0]
    seen = models.regression_metrics(
        forest.score(forest.wide(models.pr_table(rows, tf.PR_TEXT))), "label", "prediction"
    ).first()
    assert seen.mae < baseline
    assert forest.sizes["training_size"] + forest.sizes["test_size"] == forest.sizes["data_points"]
    assert set(forest.metrics) >= {"mae", "mse", "rmse", "r2", "mape", "residual_p05", "residual_p95"}
    assert len(forest.features) == 66


def test_every_row_is_scored_or_explained(spark, sf_dir, forest):
    faulty = plans._faulty(spark, sf_dir)
    out = scoring.score_prs(faulty, forest)
    assert out.columns == [
        "repository", "pr_number", "predicted_hours", "predicted_days", "prediction_confidence", "error",
    ]
    rows = out.collect()
    assert len(rows) == faulty.count()
    assert all((r.error is None) != (r.predicted_hours is None) for r in rows)
    assert any(r.error for r in rows)


def test_saved_models_score_alike(spark, prs, forest):
    path = scratch_path(spark, "test-model")
    models.save(forest, path)
    again = models.load(spark, path)
    one = {tuple(r) for r in scoring.score_prs(prs, forest).collect()}
    assert one == {tuple(r) for r in scoring.score_prs(prs, again).collect()}
    assert again.metrics["mae"] == forest.metrics["mae"]


def test_blocks_of_rows_score_as_the_model_does(spark, prs, forest):
    assert len(forest.forest.roots) == SMALL.rounds
    wide = forest.wide(models.pr_table(prs, tf.PR_TEXT, label=None))
    vectors = models._vectors(wide, forest.features, forest.scaling)
    plain = forest.model.transform(vectors).select("pr_number", F.col("prediction").alias("plain"))
    both = forest.score(wide).select("pr_number", "prediction").join(plain, "pr_number")
    assert both.where(F.col("prediction") == F.col("plain")).count() == prs.count() > 0
    assert not forest.score(wide).schema["prediction"].nullable


def test_a_scored_feature_cannot_be_missing(spark, prs, forest):
    wide = forest.wide(models.pr_table(prs, tf.PR_TEXT, label=None))
    with pytest.raises(Exception, match="cannot be null or NaN"):
        forest.score(wide.withColumn("additions", F.lit(None).cast("double"))).select("prediction").collect()


def test_a_forest_of_single_leaves(spark):
    rows = spark.createDataFrame([(i, 1.0, float(i)) for i in range(60)], "id long, label double, x double")
    fitted = models.fit(rows, ["x"], SMALL, None, keys=("id",))
    assert {r.prediction for r in fitted.score(rows).collect()} == {1.0}


def test_importance_is_ranked(spark, forest):
    rows = forest.importance(spark, 10).collect()
    assert len(rows) == 10 and [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)


def test_boosting_round_trip(spark, prs):
    small = models.ModelConfig("xgboost", rounds=3, depth=3, min_leaf=1, subsample=0.9)
    fitted = models.fit_merge_time(prs, small, text=None)
    path = scratch_path(spark, "test-gbt")
    models.save(fitted, path)
    assert len(models.load(spark, path, text=None).features) == 16


def test_ci_models(spark, sf_dir):
    rollup = plans._rollup(spark, sf_dir)
    fitted, errors = models.fit_ci(rollup, SMALL, min_rows=10)
    assert set(fitted) == set(models.CI_TARGETS) and errors == {}
    out = scoring.score_ci(rollup, fitted)
    row = out.first()
    assert out.count() == 15 and row.expected_attempts >= 1 and 0 <= row.success_probability <= 1
    assert row.recommendation and row.retry_risk and row.estimated_completion_time
    only = scoring.score_ci(rollup, {"success": fitted["success"]}).first()
    assert only.total_duration_hours is None and only.success_probability == row.success_probability
    path = scratch_path(spark, "test-ci")
    models.save_ci({"attempts": fitted["attempts"]}, path)
    assert set(models.load_ci(spark, path)) == {"attempts"}


def test_too_few_rows_fail_alone(spark, sf_dir, prs):
    rollup = plans._rollup(spark, sf_dir)
    fitted, errors = models.fit_ci(rollup, SMALL)
    assert fitted == {} and set(errors) == set(models.CI_TARGETS)
    assert "insufficient data: 15 rows" in errors["duration"]
    with pytest.raises(ValueError, match="insufficient data"):
        models.fit_merge_time(prs.limit(20), SMALL)


def test_leaky_columns_can_be_left_out(spark, sf_dir):
    fitted, _ = models.fit_ci(plans._rollup(spark, sf_dir), SMALL, None, exclude_leaky=True, min_rows=10)
    for target, model in fitted.items():
        assert not set(model.features) & set(features.CI_LEAKS[target])


def test_scoring_needs_a_model(prs):
    with pytest.raises(ValueError, match="must be trained"):
        scoring.score_prs(prs, None)
    with pytest.raises(ValueError, match="must be trained"):
        scoring.score_ci(prs, {})


def test_unknown_algorithm():
    with pytest.raises(ValueError, match="unsupported model type"):
        models.regressor(models.ModelConfig("svm"))


def test_full_grids_have_their_sizes():
    sizes = {n: len(models.param_grid(c)[1]) for n, c in models.PR_DEFAULTS.items()}
    assert sizes == {"random_forest": 27, "gradient_boosting": 81, "leafwise": 27}


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 1.0), (4.0, 2.0)], "label double, prediction double")
    row = models.regression_metrics(df).first()
    assert row.mae == pytest.approx(4 / 3) and row.mse == pytest.approx(2.0)
    assert row.mape == pytest.approx(75.0)
    flat = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], "label double, prediction double")
    assert models.regression_metrics(flat).first().r2 is None
    assert models.ci_metrics(flat, "attempts").first().mape == float("inf")
    assert models.ci_metrics(df, "success").first().accuracy == pytest.approx(2 / 3)


def test_tfidf_rows_have_unit_length(spark, sf_dir):
    grams = plans._grams(spark, sf_dir)
    terms = tf.collect_terms(tf.vocabulary(grams))
    norms = tf.tfidf(grams, terms, "doc_id").groupBy("doc_id").agg(F.sum(F.col("tfidf") ** 2).alias("n"))
    assert norms.where(F.abs(F.col("n") - 1) > 1e-9).count() == 0
    wide = tf.with_wide_tfidf(grams, terms, tf.PR_TEXT)
    assert wide.count() == grams.count()


def test_fit_rows_are_cut_before_whole_rows_are_read(spark):
    rows = [("o/r" if i % 3 else None, i // 2, float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "repository string, pr_number bigint, x double").repartition(4)
    keys = ["repository", "pr_number"]
    got = models.least_by_hash(df, 201, keys)
    want = df.orderBy(F.xxhash64(*keys), *keys).limit(201)
    assert [r[:2] for r in got.collect()] == [r[:2] for r in want.collect()]
    assert models.least_by_hash(df.where("false"), 5, keys).count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert any("Filter" in line and "xxhash64(" in line and "<=" in line for line in plan.splitlines())
