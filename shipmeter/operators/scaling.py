"""Standard scaling and the train/test split."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipmeter import KEYS
from shipmeter.functions.hashing import split_bucket


def with_split(df: DataFrame, keys=KEYS, test_percent: int = 20) -> DataFrame:
    """``is_test`` by a hash of the key.

    The same row falls on the same side in every run and under any partitioning,
    which ``randomSplit`` does not promise.
    """
    return df.withColumn("is_test", split_bucket(*keys) < F.lit(test_percent))


def moments(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row ``moments``: arrays ``mean`` and ``std`` (population) in column order.

    A deviation of 0 is replaced by 1.  One vector summary instead of two
    aggregates per column keeps the plan small for wide tables.
    """
    vectors = VectorAssembler(inputCols=columns, outputCol="_v").transform(train.select(*columns))
    summary = Summarizer.metrics("mean", "variance", "count").summary(F.col("_v"))
    found = vectors.agg(summary.alias("_s")).select(
        vector_to_array("_s.mean").alias("mean"),
        vector_to_array("_s.variance").alias("_variance"),
        F.col("_s.count").alias("_n"),
    )

    def population(variance: Column) -> Column:
        std = F.sqrt(variance * (F.col("_n") - 1) / F.col("_n"))
        return F.when(std > 0, std).otherwise(1.0)

    return found.select(F.struct("mean", F.transform("_variance", population).alias("std")).alias("moments"))


def fitted_scaling(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and deviation by column, as numbers."""
    row = moments(train, columns).first()["moments"]
    return {c: (m, s) for c, m, s in zip(columns, row["mean"], row["std"])}


def scale(df: DataFrame, train: DataFrame, columns: list[str], *carried: str, digits: int | None = None) -> DataFrame:
    """Columns of ``df`` in units of ``train``, which is read first, rounded to ``digits``."""
    fitted = fitted_scaling(train, columns)
    return df.select(*carried, *scale_by({c: fitted[c] for c in columns}, digits))


def scale_by(columns: dict[str, tuple[float, float]], digits: int | None = None) -> list[Column]:
    """The same with fitted numbers.

    Rounding a double costs more than scaling it, and most text weights are 0; what 0
    becomes is rounded once, in the plan.
    """

    def scaled(x: Column, mean: float, std: float) -> Column:
        value = (x - F.lit(mean)) / F.lit(std)
        return value if digits is None else F.round(value, digits)

    def column(c: str, mean: float, std: float) -> Column:
        value = scaled(F.col(c), mean, std)
        return value if digits is None else F.when(F.col(c) == 0, scaled(F.lit(0.0), mean, std)).otherwise(value)

    return [column(c, mean, std).alias(c) for c, (mean, std) in columns.items()]
