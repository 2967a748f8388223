"""Batch scoring of pull requests and of their CI."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipmeter import KEYS
from shipmeter.functions import scores
from shipmeter.functions.times import duration_band
from shipmeter.operators.models import Fitted, ci_table, pr_table
from shipmeter.operators.validation import with_error

BATCH_COLUMNS = (
    "repository",
    "pr_number",
    "pr_title",
    "pr_url",
    "predicted_hours",
    "predicted_days",
    "time_category",
    "confidence_lower",
    "confidence_upper",
    "created_at",
    "error",
)


def _require(model: object) -> None:
    if not model:
        raise ValueError("a model must be trained before making predictions")


def score_prs(
    prs: DataFrame, model: Fitted | None, keys=KEYS, carried: tuple[str, ...] = ()
) -> DataFrame:
    """Predicted hours and days and a confidence class; a faulty row gets its fault
    in ``error`` and no prediction.  ``carried`` columns of ``prs`` are kept.

    Confidence is the share of features, text included, that are not 0 before
    scaling.
    """
    _require(model)
    table = pr_table(with_error(prs), model.text, keys, label=None, carried=("error", *carried))
    # Rated before the forest, so that past it a row is its keys and what is carried.
    level = scores.confidence(scores.filled_share(model.features))
    wide = model.wide(table).withColumn("_level", level)
    hours = F.when(F.col("error").isNull(), F.col("prediction"))
    return model.score(wide, [*keys, "_level", "error", *carried]).select(
        *keys,
        hours.alias("predicted_hours"),
        (hours / 24).alias("predicted_days"),
        F.when(F.col("error").isNull(), F.col("_level")).alias("prediction_confidence"),
        "error",
        *carried,
    )


def batch_report(
    prs: DataFrame, model: Fitted | None, url: Column, keys=KEYS
) -> DataFrame:
    """The ten columns of the batch export and the fault of a row that has one.

    The category is the band of the predicted duration, and the interval is the
    prediction plus the 5 % and 95 % quantiles of the test residuals, not below 0.
    A faulty row stays in the report without a prediction.
    """
    hours = F.col("predicted_hours")
    low = model.metrics.get("residual_p05") if model else None
    high = model.metrics.get("residual_p95") if model else None
    shown = prs.withColumns({"pr_title": F.col("title"), "pr_url": url})
    scored = score_prs(shown, model, keys, carried=("pr_title", "pr_url", "created_at"))
    return scored.select(
        "repository",
        "pr_number",
        "pr_title",
        "pr_url",
        "predicted_hours",
        "predicted_days",
        duration_band(hours).alias("time_category"),
        F.when(hours.isNotNull(), F.greatest(F.lit(0.0), hours + F.lit(low))).alias("confidence_lower"),
        F.when(hours.isNotNull(), F.greatest(F.lit(0.0), hours + F.lit(high))).alias("confidence_upper"),
        "created_at",
        "error",
    )


def shape_ci(raw: DataFrame) -> DataFrame:
    """Raw predictions ``duration``, ``attempts`` and ``success`` as they are reported."""
    duration, attempts, success = F.col("duration"), F.col("attempts"), F.col("success")
    rest = [c for c in raw.columns if c not in ("duration", "attempts", "success")]
    return raw.select(
        *rest,
        duration.alias("total_duration_hours"),
        (duration * 60).alias("total_duration_minutes"),
        F.when(attempts.isNotNull(), scores.expected_attempts(attempts)).alias("expected_attempts"),
        F.when(success.isNotNull(), scores.success_probability(success)).alias("success_probability"),
        scores.likely_outcome(success).alias("likely_outcome"),
    )


def summarize_ci(shaped: DataFrame) -> DataFrame:
    """Texts and classes drawn from reported predictions; null where a model is missing."""
    hours, attempts = F.col("total_duration_hours"), F.col("expected_attempts")
    probability = F.col("success_probability")
    return shaped.select(
        "*",
        scores.completion_text(hours).alias("estimated_completion_time"),
        scores.retry_risk(attempts).alias("retry_risk"),
        scores.likelihood_text(probability).alias("overall_success_likelihood"),
        scores.recommendation(probability).alias("recommendation"),
    )


def score_ci(rollup: DataFrame, models: Mapping[str, Fitted], keys=KEYS) -> DataFrame:
    """All available CI models over one feature table, chained in one pass."""
    _require(models)
    some = next(iter(models.values()))
    table = ci_table(rollup, some.text, keys)
    for target in ("duration", "attempts", "success"):
        if target not in models:
            table = table.withColumn(target, F.lit(None).cast("double"))
            continue
        model = models[target]
        table = model.score(model.wide(table), table.columns).withColumnRenamed("prediction", target)
    return summarize_ci(shape_ci(table.select(*keys, "duration", "attempts", "success")))


def combine(pr_scores: DataFrame, ci_scores: DataFrame, keys=KEYS) -> DataFrame:
    """PR and CI predictions side by side, compared.

    Every scored PR stays: one with a fault has ``error`` and no prediction, and one
    without CI predictions has nulls in their place.
    """
    joined = pr_scores.join(ci_scores, list(keys), "left")
    return joined.select(
        *keys,
        "predicted_hours",
        "total_duration_hours",
        "prediction_confidence",
        scores.timeline_comparison(F.col("predicted_hours"), F.col("total_duration_hours")).alias(
            "timeline_comparison"
        ),
        F.col("recommendation").alias("ci_recommendation"),
        F.when(
            F.col("prediction_confidence").isNotNull(),
            scores.confidence_advice(F.col("prediction_confidence")),
        ).alias("pr_advice"),
        "error",
    )
