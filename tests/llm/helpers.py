"""Rows that break careless operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, key string, score double, "
    "n_tokens long, kinds string, row string, values string, bucket long, _id string"
)

LONG = "The house by the river was painted in a very pale green last year. " * 900


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", None if text is None else len(text), 5, "k", 0.5, 7, "z", "r", "v", 9, "u")


ODD = [
    row(1, None),
    row(2, ""),
    row(3, "  \n\t "),
    row(4, "!!! ### ..."),
    row(5, "one"),
    row(6, "one two three four five six seven"),
    row(7, "one two three four five six seven"),
    row(7, "one two three four five six seven"),
    row(8, LONG),
    row(9, "x" * 5000),
    row(10, "naïve café 東京 😀 Ωμέγα don't ΣΑΣ <|endoftext|> 12,345"),
    row(None, "no id at all but some words here"),
    row(11, None, None),
]


def odd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ODD, SCHEMA)


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def docs(spark: SparkSession, texts: list) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
