"""Feature tables for the merge-time and the CI models.

All blocks are columns of one ``select``; nothing is glued by row position.  A
null input stays null through the ratios and becomes 0 at the very end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipmeter.functions import times
from shipmeter.operators.ci import DURATION_COLUMNS, KIND_WORDS, OUTCOME_COLUMNS, RETRY_COLUMNS
from shipmeter.schemas import PR_COUNTS

MAX_MERGE_HOURS = 30 * 24

PR_BASIC = (*PR_COUNTS, "created_hour", "created_day", "is_draft")
PR_DERIVED = (
    "lines_changed",
    "addition_ratio",
    "files_per_addition",
    "reviews_per_commit",
    "comments_per_commit",
    "is_business_hours",
    "is_weekend",
)
PR_STRUCTURAL = (*PR_BASIC, *PR_DERIVED)

CI_BASIC = ("pr_files_changed", "pr_additions", "pr_deletions", "pr_commits", "pr_is_draft")
CI_NUMERIC = (*DURATION_COLUMNS, *OUTCOME_COLUMNS, *RETRY_COLUMNS)
CI_DERIVED = ("ci_run_per_test_ratio", "ci_duration_per_file")
CI_STRUCTURAL = (*CI_BASIC, *CI_NUMERIC, *KIND_WORDS, *CI_DERIVED)

#: The columns each CI target is computed from.
CI_LEAKS = {
    "duration": DURATION_COLUMNS + ("ci_duration_per_file",),
    "attempts": RETRY_COLUMNS + ("ci_total_runs", "ci_unique_tests", "ci_run_per_test_ratio"),
    "success": ("ci_success_rate", "ci_successful_runs", "ci_failed_runs"),
}


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def basic_pr_features() -> dict[str, Column]:
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in PR_COUNTS}
    return {
        **counts,
        "created_hour": F.col("created_hour"),
        "created_day": F.col("created_day"),
        "is_draft": _flag(F.col("is_draft")),
    }


def derived_pr_features() -> dict[str, Column]:
    """Ratios are null where a faulty row has a count of -1 and the divisor is 0."""
    added, deleted, files = F.col("additions"), F.col("deletions"), F.col("files_changed")
    commits = F.col("commit_count") + 1
    return {
        "lines_changed": added + deleted,
        "addition_ratio": F.try_divide(added, added + deleted + 1),
        "files_per_addition": F.try_divide(files, added + 1),
        "reviews_per_commit": F.try_divide(F.col("review_count"), commits),
        "comments_per_commit": F.try_divide(F.col("comment_count"), commits),
        "is_business_hours": _flag(times.hour_in_business_day(F.col("created_hour"))),
        "is_weekend": _flag(times.is_weekend_day(F.col("created_day"))),
    }


def ci_features() -> dict[str, Column]:
    runs, tests = F.coalesce("ci_total_runs", F.lit(0)), F.coalesce("ci_unique_tests", F.lit(0))
    average = F.coalesce("ci_avg_duration", F.lit(0.0))
    basic = {c: F.coalesce(F.col(c), F.lit(0)) for c in CI_BASIC[:-1]}
    return {
        **basic,
        "pr_is_draft": _flag(F.col("pr_is_draft")),
        **{c: F.coalesce(F.col(c), F.lit(0)) for c in CI_NUMERIC},
        **{c: _flag(F.col(c)) for c in KIND_WORDS},
        "ci_run_per_test_ratio": F.try_divide(runs, tests + 1),
        "ci_duration_per_file": F.try_divide(average, F.col("pr_files_changed") + 1),
    }


def select_features(df: DataFrame, features: dict[str, Column], *carried: str, fill: bool = True) -> DataFrame:
    """Carried columns and the features as doubles, missing numbers as 0."""
    columns = [c.cast("double").alias(name) for name, c in features.items()]
    out = df.select(*carried, *columns)
    return out.na.fill(0.0, list(features)) if fill else out


def pr_features(prs: DataFrame, *carried: str) -> DataFrame:
    return select_features(prs, {**basic_pr_features(), **derived_pr_features()}, *carried)


def ci_feature_table(rollup: DataFrame, *carried: str) -> DataFrame:
    return select_features(rollup, ci_features(), *carried)


def training_rows(df: DataFrame, label: str = "merge_time_hours", most: float = MAX_MERGE_HOURS) -> DataFrame:
    """Rows with a label of at most 30 days; unmerged PRs have no label and drop out."""
    return df.where(F.col(label) <= most)


def ci_labels() -> dict[str, Column]:
    """The three CI labels; null where a row is no use for that target."""
    hours = F.col("ci_total_duration") / 3600
    attempts, rate = F.col("ci_avg_retries"), F.col("ci_success_rate")
    return {
        "duration": F.when(hours > 0, hours),
        "attempts": F.when(attempts >= 0, attempts),
        "success": F.when(rate.between(0, 1), rate),
    }


def with_ci_labels(rollup: DataFrame) -> DataFrame:
    return rollup.select("*", *[c.alias(f"label_{t}") for t, c in ci_labels().items()])


def align(df: DataFrame, trained: list[str], *carried: str) -> DataFrame:
    """The trained features in their trained order; one the frame lacks is 0."""
    have = set(df.columns)
    return df.select(
        *carried,
        *[
            (F.coalesce(F.col(c), F.lit(0)) if c in have else F.lit(0)).cast("double").alias(c)
            for c in trained
        ],
    )


def feature_profile(df: DataFrame, names: list[str], text_prefix: str = "tfidf_") -> DataFrame:
    """Numbers of structural and text features, their ratio, and the rows they cover."""
    text = len([n for n in names if n.startswith(text_prefix)])
    structural = len(names) - text
    return df.agg(F.count("*").alias("rows")).select(
        "rows",
        F.lit(structural).alias("structural"),
        F.lit(text).alias("text"),
        F.lit(text / structural if structural else None).cast("double").alias("text_ratio"),
    )
