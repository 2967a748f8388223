"""No query plan contains a cross join, a nested loop or a Python node."""

import pytest

import __spark_entry__ as entry_module

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas", "FlatMapGroups")


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_plan(spark, sf_dir, name):
    df = entry_module.queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert [word for word in FORBIDDEN if word in plan] == []


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = entry_module.queries()["pr_listing"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    orders = next(line for line in plan.splitlines() if "orders.parquet" in line)
    assert "o_totalprice" not in orders.split("ReadSchema")[1]
    plan = entry_module.queries()["outliers_iqr"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_extendedprice" in plan and "Exchange" not in plan
