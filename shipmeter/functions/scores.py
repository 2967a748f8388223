"""Column functions that turn model output into classes and advice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shipmeter.functions.times import one_decimal


def filled_share(features: list[str]) -> Column:
    """Share of features that are not 0."""
    if not features:
        return F.lit(None).cast("double")
    filled = [F.when(F.col(c) != 0, 1).otherwise(0) for c in features]
    return reduce(lambda a, b: a + b, filled) / F.lit(len(filled))


def confidence(share: Column) -> Column:
    return F.when(share > 0.7, "high").when(share > 0.4, "medium").otherwise("low")


def expected_attempts(attempts: Column) -> Column:
    """At least one; halves round to the even neighbour."""
    return F.greatest(F.lit(1), F.bround(attempts).cast("long"))


def success_probability(rate: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), rate))


def likely_outcome(rate: Column) -> Column:
    """Judged on the rate before it is clipped."""
    return F.when(rate > 0.5, "success").when(rate.isNotNull(), "failure")


def completion_text(hours: Column) -> Column:
    return F.concat(
        one_decimal(hours), F.lit(" hours ("), one_decimal(hours / 24), F.lit(" days)")
    )


def likelihood_text(probability: Column) -> Column:
    return F.concat(one_decimal(probability * 100), F.lit("%"))


def retry_risk(attempts: Column) -> Column:
    return F.when(attempts > 3, "high").when(attempts > 1, "medium").when(attempts.isNotNull(), "low")


def recommendation(probability: Column) -> Column:
    return (
        F.when(probability > 0.8, "CI likely to pass with minimal issues")
        .when(probability > 0.6, "CI may require some attention")
        .when(probability > 0.4, "CI likely to need fixes before passing")
        .when(probability.isNotNull(), "CI may require significant fixes")
    )


def timeline_comparison(pr_hours: Column, ci_hours: Column) -> Column:
    return F.when(ci_hours > pr_hours, "CI may take longer than PR merge process").when(
        ci_hours.isNotNull() & pr_hours.isNotNull(), "CI should complete before PR merge"
    )


def confidence_advice(level: Column) -> Column:
    return (
        F.when(level == "high", "High confidence in merge time prediction")
        .when(level == "medium", "Medium confidence - monitor for changes")
        .when(level.isNotNull(), "Low confidence - prediction may be inaccurate")
    )
