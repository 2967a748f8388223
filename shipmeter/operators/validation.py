"""Row validation: rows are split into good ones and quarantined ones, never lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipmeter.schemas import PR_COUNTS

REQUIRED = ("pr_number", "title", "review_count", "files_changed")


def pr_error() -> Column:
    """The first fault of a row, or null."""
    missing = [
        F.when(F.col(c).isNull(), F.lit(f"Missing required PR data field: {c}")) for c in REQUIRED
    ]
    negative = [
        F.when(F.col(c) < 0, F.lit(f"Field {c} must be a non-negative number")) for c in PR_COUNTS
    ]
    return F.coalesce(*missing, *negative)


def with_error(prs: DataFrame) -> DataFrame:
    return prs.withColumn("error", pr_error())


def split_valid(prs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with their ``error``."""
    checked = with_error(prs)
    return (
        checked.where(F.col("error").isNull()).drop("error"),
        checked.where(F.col("error").isNotNull()),
    )
