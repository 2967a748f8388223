"""What to fetch next: keys not yet stored, keys without CI, and the fetch budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shipmeter import KEYS


def prs_to_fetch(listed: DataFrame, stored: DataFrame, keys=KEYS) -> DataFrame:
    return listed.join(stored.select(*keys), list(keys), "left_anti")


def ci_to_fetch(listed: DataFrame, stored_runs: DataFrame, keys=KEYS) -> DataFrame:
    """Listed PRs for which no run is stored."""
    return listed.join(stored_runs.select(*keys).distinct(), list(keys), "left_anti")


def fetch_budget(
    candidates: DataFrame,
    stored_counts: DataFrame,
    max_new: int,
    limit: int,
    by: str = "repository",
    id_column: str = "pr_number",
    counted: str = "merged",
) -> DataFrame:
    """The candidates a collection run takes, newest update first.

    A repository stops once ``max_new`` rows are taken or its stored rows plus
    the taken rows that are ``counted`` (merged, by default) reach ``limit``.  Other
    rows use up the first budget only.  Both budgets only shrink with position, so counts per hour tell
    which hours can matter; the others are dropped before any row is ranked, and
    a repository with very many rows is never sorted in one task.
    """
    if max_new > limit:
        raise ValueError(f"max_new ({max_new}) must not exceed limit ({limit})")
    # Rows without an update time come last.
    hour = F.coalesce(F.date_trunc("hour", F.col("updated_at")), F.timestamp_seconds(F.lit(0)))
    rows = candidates.withColumn("_hour", hour)
    merged = F.when(F.col(counted), 1).otherwise(0)
    newer = (
        Window.partitionBy(by).orderBy(F.desc("_hour")).rowsBetween(Window.unboundedPreceding, -1)
    )
    hours = (
        rows.groupBy(by, "_hour")
        .agg(F.count("*").alias("_n"), F.sum(merged).alias("_m"))
        .select(
            by,
            "_hour",
            F.coalesce(F.sum("_n").over(newer), F.lit(0)).alias("_rows_before"),
            F.coalesce(F.sum("_m").over(newer), F.lit(0)).alias("_merged_before"),
        )
        .join(stored_counts.select(by, F.col("stored").alias("_stored")), by, "left")
        .withColumn("_merged_before", F.col("_merged_before") + F.coalesce("_stored", F.lit(0)))
        .where((F.col("_rows_before") < max_new) & (F.col("_merged_before") < limit))
        .drop("_stored")
    )
    # Rows of hours that cannot matter go before the rank.  Within an hour only the
    # first max_new rows can be taken; up to 1000 of them, each map task already cuts
    # its own rows to that many.
    rows = rows.join(hours.select(by, "_hour"), [by, "_hour"], "left_semi")
    order = Window.partitionBy(by, "_hour").orderBy(F.desc_nulls_last("updated_at"), id_column)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    first = (
        rows.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= max_new)
        .withColumn("_merged_here", F.coalesce(F.sum(merged).over(earlier), F.lit(0)))
    )
    return (
        first.join(hours, [by, "_hour"])
        .withColumn("position", F.col("_rows_before") + F.col("_rank"))
        .where(
            (F.col("position") <= max_new)
            & (F.col("_merged_before") + F.col("_merged_here") < limit)
        )
        .select(*candidates.columns, "position")
    )


def needs(listed: DataFrame, stored: DataFrame, stored_runs: DataFrame, keys=KEYS) -> DataFrame:
    """Listed PRs that need their record, their CI runs or both, with ``need_pr``,
    ``need_ci`` and ``counted``: a merged PR whose record is fetched, the only kind
    that uses up the stored-row budget.  One pass over the listing, two semi flags."""
    keys = list(keys)
    have_pr = stored.select(*keys).distinct().withColumn("_have_pr", F.lit(True))
    have_ci = stored_runs.select(*keys).distinct().withColumn("_have_ci", F.lit(True))
    flagged = listed.join(have_pr, keys, "left").join(have_ci, keys, "left").select(
        *listed.columns,
        F.col("_have_pr").isNull().alias("need_pr"),
        F.col("_have_ci").isNull().alias("need_ci"),
    )
    wanted = flagged.where(F.col("need_pr") | F.col("need_ci"))
    return wanted.withColumn("counted", F.col("need_pr") & F.coalesce(F.col("merged"), F.lit(False)))


def first_stored(prs: DataFrame, n: int) -> DataFrame:
    """The ``n`` stored rows with the lowest numbers, which fixes the order of a capped read."""
    return prs.orderBy("pr_number", "repository").limit(n)


def newest_open(prs: DataFrame, k: int = 50) -> DataFrame:
    """The newest open PRs per repository; the rank is cut before the shuffle."""
    place = Window.partitionBy("repository").orderBy(F.desc("created_at"), F.desc("pr_number"))
    return (
        prs.where(F.col("state") == "open")
        .withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= k)
    )
