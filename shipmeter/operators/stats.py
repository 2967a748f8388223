"""Repository statistics, percentiles, outlier filters and store reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipmeter.functions import times
from shipmeter.operators.quantiles import percentiles
from shipmeter.schemas import PR_COUNTS

DEFAULT_PERCENTILES = (25, 50, 75, 90, 95)
STAT_FIELDS = (*PR_COUNTS, "merge_time_hours")


def merge_percentiles(
    df: DataFrame, value: str = "merge_time_hours", wanted=DEFAULT_PERCENTILES, by=()
) -> DataFrame:
    """Columns ``p25`` and so on; 0.0 for an input without values."""
    found = percentiles(df, value, {f"p{p}": p / 100 for p in wanted}, by)
    return found.na.fill(0.0, [f"p{p}" for p in wanted])


def numeric_stats(prs: DataFrame, fields=STAT_FIELDS, by=()) -> DataFrame:
    """Mean, median, population deviation, extremes: one row per group and field.

    The fields become rows first, so one pass serves them all.
    """
    by = list(by)
    pairs = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields]
    )
    rows = (
        prs.select(*by, F.explode(pairs).alias("_p"))
        .select(*by, "_p.field", "_p.value")
        .where(F.col("value").isNotNull())
    )
    keys = [*by, "field"]
    basics = rows.groupBy(*keys).agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return basics.join(percentiles(rows, "value", {"median": 0.5}, keys), keys)


def time_profile(prs: DataFrame) -> DataFrame:
    """Counts and the shares of weekend and business-hour PRs, over all rows."""
    rows = F.count("*")
    weekend = F.count_if(times.is_weekend_day(F.col("created_day")))
    business = F.count_if(times.hour_in_business_day(F.col("created_hour")))
    return prs.agg(
        rows.alias("total_prs"),
        F.count_distinct("repository").alias("unique_repositories"),
        F.coalesce(F.try_divide(weekend, rows), F.lit(0.0)).alias("weekend_prs_ratio"),
        F.coalesce(F.try_divide(business, rows), F.lit(0.0)).alias("business_hours_prs_ratio"),
    )


def filter_outliers(df: DataFrame, value: str, method: str = "iqr", factor: float = 1.5) -> DataFrame:
    """``iqr``: keep values within ``factor`` ranges of the quartiles, ends included.
    ``zscore``: keep values less than ``factor`` sample deviations from the mean; a
    zero deviation drops every row.  Null values are dropped by both.

    The limits are computed first and reach the scan as plain numbers, so the
    filter is pushed down to the files.
    """
    x = F.col(value)
    if method == "iqr":
        q = percentiles(df, value, {"q1": 0.25, "q3": 0.75}).first()
        if q.q1 is None:
            return df.where(F.lit(False))
        spread = (q.q3 - q.q1) * factor
        return df.where((x >= q.q1 - spread) & (x <= q.q3 + spread))
    if method == "zscore":
        m = df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")).first()
        if not m.std:
            return df.where(F.lit(False))
        return df.where(F.abs((x - F.lit(m.mean)) / F.lit(m.std)) < F.lit(factor))
    raise ValueError(f"method must be 'iqr' or 'zscore', not {method!r}")


def store_name(repository: Column) -> Column:
    return F.translate(repository, "/", "_")


def store_stats(stored: DataFrame) -> DataFrame:
    """PRs per repository and, with a null repository, in total."""
    return (
        stored.rollup("repository")
        .agg(F.count("*").alias("prs"), F.count_distinct("repository").alias("repositories"))
        .select("repository", store_name(F.col("repository")).alias("store_name"), "prs", "repositories")
    )


def collection_summary(prs: DataFrame, run_counts: DataFrame) -> DataFrame:
    """PRs and CI runs per repository and in total.

    ``run_counts`` has one row per pull request with ``repository`` and ``runs``.
    """
    rows = prs.select("repository", F.lit(1).alias("_prs"), F.lit(0).cast("long").alias("_runs")).unionByName(
        run_counts.select("repository", F.lit(0).alias("_prs"), F.col("runs").alias("_runs"))
    )
    return rows.rollup("repository").agg(
        F.sum("_prs").alias("prs"),
        F.sum("_runs").alias("ci_runs"),
    )
