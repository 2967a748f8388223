"""Positions and contiguous folds against a sort in one place."""

import random

from pyspark.sql import functions as F

from shipmeter.operators import folds


def test_positions_equal_a_full_sort(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abcde") if i % 7 else None, rng.randint(0, 10_000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "repo string, num long, i long").repartition(13)
    got = folds.positions(df, ["repo", "num", "i"]).select("i", "position").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    assert {r["i"]: r["position"] for r in got} == {r[2]: p for p, r in enumerate(want)}


def test_fold_sizes_as_unshuffled_kfold(spark):
    for n in (1, 4, 5, 17, 1003):
        df = spark.range(n).withColumnRenamed("id", "k")
        sizes = [r["count"] for r in folds.contiguous_folds(df, ["k"], 5).groupBy("fold").count().orderBy("fold").collect()]
        want = [n // 5 + (1 if f < n % 5 else 0) for f in range(5)]
        assert sizes == [s for s in want if s]
        bounds = folds.contiguous_folds(df, ["k"], 5).groupBy("fold").agg(F.min("k"), F.max("k")).orderBy("fold").collect()
        assert all(a[2] < b[1] for a, b in zip(bounds, bounds[1:]))


def test_no_task_gets_every_row(spark):
    df = spark.range(5000).withColumnRenamed("id", "k").repartition(8)
    plan = folds.positions(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_ci_parts_cut_by_count_whatever_the_ordinals(spark):
    from shipmeter.operators import ci

    rows = [("o/r", 1, i * 997, f"t{i % 3}", "u", "success", 1.0) for i in range(2500)]  # one hot PR, sparse ordinals
    rows += [("o/r", 2, 5000, "x", "u", "failure", None), ("o/r", 2, 5000, "a", "u", "failure", None)]
    runs = spark.createDataFrame(
        rows, "repository string, pr_number long, ordinal long, ci_name string, ci_target_url string, ci_state string, ci_duration_seconds double"
    ).repartition(6)
    got = {(r.pr_number, r.part): r.names for r in ci.ci_parts(runs, part_span=1000).select(
        "pr_number", "part", F.transform("ci_data", lambda x: x["ci_name"]).alias("names")).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    assert [len(got[1, p]) for p in range(3)] == [1000, 1000, 500]
    assert got[1, 0][:4] == ["t0", "t1", "t2", "t0"] and got[2, 0] == ["a", "x"]
