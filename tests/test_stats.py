"""Order statistics, outliers and the CI rollup on hostile data."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from shipmeter.operators import ci, scaling, stats
from shipmeter.operators.quantiles import percentiles, upper_median

WANTED = {f"p{p}": p / 100 for p in (0, 1, 25, 50, 75, 90, 95, 100)}


def samples():
    rng = random.Random(5)
    return {
        "one": [3.5],
        "two": [1.0, 2.0],
        "constant": [7.0] * 501,
        "skewed": [1.0] * 700 + [rng.gauss(0, 1e6) for _ in range(301)],
        "spread": [rng.uniform(-5, 5) for _ in range(20_000)],
        "negative": [-float(i) for i in range(97)],
    }


def test_percentiles_per_group(spark):
    data = samples()
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("spread", None), ("empty", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: r for r in percentiles(df, "v", WANTED, ["g"]).collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        want = np.percentile(vs, [p * 100 for p in WANTED.values()])
        assert np.allclose([got[g][n] for n in WANTED], want), g
    medians = {r.g: r.m for r in upper_median(df, "v", "m", ["g"]).collect()}
    assert medians == {g: sorted(vs)[len(vs) // 2] for g, vs in data.items()}


def test_percentiles_of_everything_and_of_nothing(spark):
    vs = samples()["skewed"]
    df = spark.createDataFrame([(v,) for v in vs], "merge_time_hours double").repartition(5)
    row = stats.merge_percentiles(df).first()
    assert np.allclose([row[f"p{p}"] for p in (25, 50, 75, 90, 95)], np.percentile(vs, [25, 50, 75, 90, 95]))
    empty = stats.merge_percentiles(df.where("false")).collect()
    assert [tuple(r) for r in empty] == [(0.0,) * 5]


def test_outlier_filters(spark):
    vs = [float(i) for i in range(100)] + [1e4, -1e4, None]
    df = spark.createDataFrame([(v,) for v in vs], "v double")
    kept = stats.filter_outliers(df, "v", "iqr").collect()
    assert sorted(r.v for r in kept) == [float(i) for i in range(100)]
    known = [v for v in vs if v is not None]
    mean, std = statistics.mean(known), statistics.stdev(known)
    kept = stats.filter_outliers(df, "v", "zscore", 2.0).collect()
    assert sorted(r.v for r in kept) == sorted(v for v in known if abs((v - mean) / std) < 2)
    flat = spark.createDataFrame([(1.0,)] * 5, "v double")
    assert stats.filter_outliers(flat, "v", "zscore").count() == 0
    with pytest.raises(ValueError, match="method"):
        stats.filter_outliers(df, "v", "mad")


def test_rollup_identities_on_a_hot_pull_request(spark):
    rng = random.Random(2)
    rows = [
        (
            "o/r",
            0 if rng.random() < 0.6 else rng.randrange(1, 20),
            i,
            rng.choice(["build", "unit-test", "Style check", None, ""]),
            rng.choice(["success", "failure", "error", "pending", None]),
            rng.choice([None, rng.uniform(1, 900)]),
        )
        for i in range(3000)
    ]
    schema = "repository string, pr_number bigint, ordinal bigint, ci_name string, ci_state string, ci_duration_seconds double"
    runs = spark.createDataFrame(rows, schema)
    got = {r.pr_number: r for r in ci.rollup_runs(runs).collect()}
    for n, r in got.items():
        mine = [x for x in rows if x[1] == n]
        names = {x[3] or "" for x in mine}
        times = [x[5] for x in mine if x[5] is not None]
        assert r.ci_total_runs == len(mine) and r.ci_unique_tests == len(names)
        assert abs(r.ci_avg_retries - len(mine) / len(names)) < 1e-9
        assert r.ci_max_retries == max(sum((x[3] or "") == name for x in mine) for name in names)
        assert r.ci_successful_runs + r.ci_failed_runs <= r.ci_total_runs
        assert abs(r.ci_total_duration - sum(times)) < 1e-6
        assert r.ci_has_lint == any("style" in (x[3] or "").lower() for x in mine)
    nested = runs.withColumn("ci_target_url", runs.ci_name)
    parts = ci.ci_parts(nested, part_span=100)
    assert parts.selectExpr("max(size(ci_data))").first()[0] <= 100
    assert ci.explode_ci(parts).count() == 3000


def test_scaled_training_columns_have_unit_variance(spark):
    rng = random.Random(4)
    rows = [("o/r", i, rng.gauss(50, 9), 1.0) for i in range(500)]
    df = scaling.with_split(spark.createDataFrame(rows, "repository string, pr_number bigint, a double, b double"))
    train = df.where("not is_test")
    out = scaling.scale(train, train, ["a", "b"], "pr_number").toPandas()
    assert abs(out.a.mean()) < 1e-9 and abs(out.a.std(ddof=0) - 1) < 1e-9
    assert (out.b == 0).all()


def test_rounded_scale_equals_rounding_afterwards(spark):
    rows = [(0.0, 1), (-0.0, 2), (None, 3), (float("nan"), 4), (2.5, 5), (-1e-9, 6)]
    df = spark.createDataFrame(rows, "a double, k int")
    for fitted in ({"a": (0.3, 0.7)}, {"a": (0.0, 1.0)}):
        late = df.select("k", *scaling.scale_by(fitted)).select("k", F.round("a", 6).alias("a"))
        early = df.select("k", *scaling.scale_by(fitted, 6))
        assert repr(sorted(early.collect())) == repr(sorted(late.collect()))
        # what 0 becomes is a number in the plan: only the other rows are rounded
        plan = early._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("round(") == 1


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(1000).selectExpr("'o/r' AS repository", "id AS pr_number")
    one = {tuple(r) for r in scaling.with_split(df.repartition(1)).collect()}
    many = {tuple(r) for r in scaling.with_split(df.repartition(9)).collect()}
    assert one == many and 120 < sum(r[2] for r in one) < 280


def test_narrowing_keeps_ranks_exact_and_intervals_small(spark, monkeypatch):
    from shipmeter.operators import quantiles

    monkeypatch.setattr(quantiles, "HELD", 40)
    monkeypatch.setattr(quantiles, "CUTS", 8)
    monkeypatch.setattr(quantiles, "_MARGIN", 0.05)  # wide first intervals, so narrowing must run
    seen = []
    narrowed = quantiles._narrowed

    def spy(held, wanted, by):
        held, wanted = narrowed(held, wanted, by)
        seen.append(held.groupBy(*by, "_i").agg(F.countDistinct("_v").alias("d")).agg(F.max("d")).first()[0])
        return held, wanted

    monkeypatch.setattr(quantiles, "_narrowed", spy)
    data = samples()
    rows = [(g, v) for g, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in percentiles(df, "v", WANTED, ["g"]).collect()}
    for g, vs in data.items():
        assert np.allclose([got[g][n] for n in WANTED], np.percentile(vs, [p * 100 for p in WANTED.values()])), g
    whole = percentiles(df.where("g = 'spread'").select("v"), "v", {"p50": 0.5}).first()["p50"]
    assert whole == pytest.approx(float(np.percentile(data["spread"], 50)))
    assert seen and max(seen) <= 40


def test_repeated_values_are_counted_not_cut(spark, monkeypatch):
    from shipmeter.operators import quantiles

    monkeypatch.setattr(quantiles, "HELD", 40)
    written, write = [], quantiles.materialize

    def spy(df, name):
        table = write(df, name)
        written.append((name, table))
        return table

    monkeypatch.setattr(quantiles, "materialize", spy)
    rows = [("a", float(i % 7)) for i in range(3000)] + [("b", 2.0)] * 1000 + [("b", float(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r.g: r.p50 for r in percentiles(df, "v", {"p50": 0.5}, ["g"]).collect()}
    assert got == {g: float(np.median([v for h, v in rows if h == g])) for g in "ab"}
    # intervals of far more than 40 rows, of fewer distinct values: one row a value, and no round of cuts
    assert "rank-cut" not in [name for name, _ in written]
    assert all(table.count() <= 40 for name, table in written if name == "rank-values")


def test_parts_of_sorted_cuts(spark):
    from shipmeter.operators.quantiles import _BLOCK, _part

    cuts = [float(2 * i) for i in range(3 * _BLOCK + 5)]
    ends = cuts[_BLOCK - 1 :: _BLOCK]
    values = [v / 2 for v in range(-3, 4 * len(cuts) + 3)]
    df = spark.createDataFrame([(v, cuts, ends) for v in values], "v double, c array<double>, e array<double>")
    got = [r.p for r in df.select("v", _part(F.col("v"), F.col("c"), F.col("e")).alias("p")).orderBy("v").collect()]
    assert got == [sum(c < v for c in cuts) + sum(c <= v for c in cuts) for v in values]
