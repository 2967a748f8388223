"""Forests over numpy blocks against a plain grower, and that models fit all their rows."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from shipmeter.operators import forest as fo
from shipmeter.operators import models
from shipmeter.plans import queries as plans
from shipmeter.session import scratch_path

CONFIG = fo.ForestConfig(rounds=5, depth=8, min_leaf=2)


def plain_tree(x, y, w, depth, least, bins):
    """Split (feature, bin) or value by heap number, node by node."""
    out = {}

    def grow(rows, node, left):
        n, s = w[rows].sum(), (w[rows] * y[rows]).sum()
        best = (s * s / n + 1e-13 * (w[rows] * y[rows] ** 2).sum(), None)
        for f in range(len(x) if left else 0):
            for b in range(bins - 1):
                a, c = rows[x[f, rows] <= b], rows[x[f, rows] > b]
                if w[a].sum() >= least and w[c].sum() >= least:
                    score = (w[a] * y[a]).sum() ** 2 / w[a].sum() + (w[c] * y[c]).sum() ** 2 / w[c].sum()
                    best = max(best, (score, (f, b)), key=lambda p: p[0])
        out[node] = s / n if best[1] is None else best[1]
        if best[1] is not None:
            f, b = best[1]
            grow(rows[x[f, rows] <= b], 2 * node, left - 1)
            grow(rows[x[f, rows] > b], 2 * node + 1, left - 1)

    grow(np.flatnonzero(w), 1, depth)
    return out


def walked(node, value):
    out = {}

    def walk(i, name):
        left, feature, b = int(node[i]) >> 32, int(node[i]) >> 16 & 0xFFFF, int(node[i]) & 0xFFFF
        out[name] = value[i] if b == 0xFFFF else (feature, b)
        if b != 0xFFFF:
            assert left > i
            walk(left, 2 * name)
            walk(left + 1, 2 * name + 1)

    walk(0, 1)
    return out


# Whole labels make sums exact, so equal gains are ties in both and values equal to the last bit.
@pytest.mark.parametrize("n", [1, 2, 3, 40, 150, 400])
@pytest.mark.parametrize("least", [1, 2, 5])
def test_a_tree_is_that_of_a_plain_grower(n, least):
    r = np.random.default_rng(n * 10 + least)
    x = r.integers(0, 12, (4, n)).astype(np.uint8)
    x[3] = np.where(r.random(n) < 0.1, x[3], 0)
    y, w = r.integers(0, 40, n).astype(float), r.poisson(1.0, n).astype(np.uint8)
    w[0] = 1
    draws = [w, np.zeros(n, np.uint8), np.roll(w, 1), np.ones(n, np.uint8)]
    grown = fo._grower()(x, y, 0.0, draws, 7, least, [12] * 4)
    for (node, value, fall), drawn in zip(grown, draws):
        want = plain_tree(x, y, drawn.astype(float), 7, least, 12) if drawn.any() else {1: y.mean()}
        assert walked(node, value) == want
        assert len(node) == len(want) and (fall >= 0).all()


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(7)
    x = np.round(r.normal(size=(9000, 3)), 2)
    data = [(i, float(a[0] * 3 + (a[1] > 0) * 5 + a[2] ** 2), Vectors.dense(a)) for i, a in enumerate(x)]
    return spark.createDataFrame(data, ["id", "label", "features"]).repartition(3, "id").cache()


def test_a_forest_fits_what_it_sees(rows):
    model = fo.ForestGrower(CONFIG).fit(rows)
    assert model.rows == 9000 and len(model.held.roots) == 5
    error = model.transform(rows).agg(F.avg((F.col("label") - F.col("prediction")) ** 2), F.var_pop("label")).first()
    assert error[0] < error[1] / 20
    shares = model.featureImportances.toArray()
    assert shares.sum() == pytest.approx(1) and shares.argmin() == 2


def test_a_mapped_matrix_grows_the_same_trees(spark, rows, monkeypatch):
    one = fo.ForestGrower(CONFIG).fit(rows).held
    monkeypatch.setattr(fo, "HELD_BYTES", 0)
    two = fo.ForestGrower(CONFIG).fit(rows).held
    assert (one.node == two.node).all() and (one.value == two.value).all()


def test_a_forest_too_large_to_hold_scores_alike(spark, rows, monkeypatch):
    monkeypatch.setattr(fo, "_PART", 100)
    small = fo.ForestGrower(CONFIG).fit(rows)
    path = scratch_path(spark, "test-forest")
    small.write().overwrite().save(path)
    monkeypatch.setattr(fo, "HELD_NODES", 0)
    large = fo.ForestModel.load(path)
    assert large.held is None and large.nodes == len(small.held.node)
    one = small.transform(rows).withColumnRenamed("prediction", "other")
    # Ids may repeat and be null; every row keeps its columns.
    odd = rows.unionByName(rows.limit(10)).withColumn("t", F.timestamp_seconds("id")).withColumn("n", F.nullif(F.col("id") % 3, F.lit(0)))
    got = large.transform(odd)
    assert got.columns == ["id", "label", "features", "t", "n", "prediction"]
    assert not got.schema["prediction"].nullable and "Python" not in got._jdf.queryExecution().executedPlan().toString()
    both = got.join(one.select("id", "other"), "id").where(F.abs(F.col("prediction") - F.col("other")) < 1e-9)
    assert both.count() == 9010
    assert got.where("t = timestamp_seconds(id) and n <=> nullif(id % 3, 0)").count() == 9010
    again = {(r.id, r.prediction) for r in large.transform(odd).collect()}
    assert again == {(r.id, r.prediction) for r in got.collect()}
    assert large.transform(rows.where("false")).count() == 0


def test_a_forest_needs_rows_and_a_depth_it_can_name(rows):
    with pytest.raises(ValueError, match="no rows"):
        fo.ForestGrower(CONFIG).fit(rows.where("false"))
    with pytest.raises(ValueError, match="over 30"):
        models.regressor(models.ModelConfig(depth=31))


# --- no model is fitted on a part of its rows --------------------------------


def own_prs(spark, n=3200):
    i = F.col("id")
    return spark.range(n).select(
        F.lit("o/r").alias("repository"), i.alias("pr_number"), F.concat(F.lit("fix part "), i % 7).alias("title"),
        F.lit("body text").alias("body"), *[(i % k).alias(c) for k, c in ((3, "review_count"), (5, "comment_count"), (4, "commit_count"))],
        (i % 9).alias("files_changed"), (i % 101).alias("additions"), (i % 31).alias("deletions"),
        (i % 24).cast("int").alias("created_hour"), (i % 7).cast("int").alias("created_day"),
        F.lit("MEMBER").alias("author_association"), (i % 2 == 0).alias("is_draft"),
        F.timestamp_seconds(i * 3600).alias("created_at"), F.timestamp_seconds(i * 3600 + 7200).alias("merged_at"),
        (i % 101 + i % 24).cast("double").alias("merge_time_hours"), F.lit("closed").alias("pr_state"),
    )


@pytest.fixture
def many_prs(spark, monkeypatch):
    monkeypatch.setattr(plans.fixtures, "pull_requests", lambda *_: own_prs(spark))


def test_the_merge_time_forest_grows_on_all_training_rows(spark, many_prs):
    fitted = plans._merge_model(spark, "own-forest", replace(plans._FOREST, rounds=3, depth=5))
    assert fitted.sizes["training_size"] > 2000 and fitted.model.rows == fitted.sizes["training_size"]


def test_the_merge_time_booster_grows_on_all_training_rows(spark, many_prs):
    fitted = plans._merge_model(spark, "own-booster", replace(plans._LEAFWISE, rounds=1, depth=2))
    leaves = fitted.model.nodes(spark).where("feature is null")
    assert leaves.agg(F.sum("n_rows")).first()[0] == fitted.sizes["training_size"] > 2000


def test_the_ci_forests_grow_on_all_training_rows(spark, sf_dir, monkeypatch):
    some = plans._rollup(spark, sf_dir)
    many = some.crossJoin(spark.range(220)).withColumn("pr_number", F.col("pr_number") + F.col("id") * 1_000_000).drop("id")
    monkeypatch.setattr(plans, "_rollup", lambda *_: many)
    monkeypatch.setattr(plans, "_CI_FOREST", replace(plans._CI_FOREST, rounds=2, depth=3))
    for find in (plans._ci_models, plans._ci_clean_models):
        fitted, errors = find(spark, "own-runs")
        assert errors == {}
        for model in fitted.values():
            assert model.model.rows == model.sizes["training_size"] > 2000
