"""Scans of stored documents, CSV exports and repository lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shipmeter import KEYS
from shipmeter.schemas import PULL_REQUEST, STORED_DOCUMENT

_CORRUPT = "_corrupt_record"
_TIMESTAMPS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

# A text column keeps its spaces, quotes and line breaks, and "" stays apart from
# null, which is written as \N.
CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "nullValue": "\\N",
    "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampFormat": _TIMESTAMPS,
}


def _parsed(
    spark: SparkSession, path: str, repositories: Iterable[str] | None, multi_line: bool
) -> DataFrame:
    fields = [f for f in STORED_DOCUMENT.fields] + [T.StructField(_CORRUPT, T.StringType())]
    docs = (
        spark.read.schema(T.StructType(fields))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .option("multiLine", str(multi_line).lower())
        .json(path)
    )
    return docs if repositories is None else docs.where(F.col("repository").isin(*repositories))


def scan_documents(
    spark: SparkSession,
    path: str,
    repositories: Iterable[str] | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Stored pull-request documents; ``quarantine`` has the unreadable ones.

    ``repository`` is a partition column: naming repositories prunes directories,
    and a repository without data adds no rows.  ``multi_line`` reads one
    pretty-printed document per file instead of one per line.
    """
    docs = _parsed(spark, path, repositories, multi_line)
    return docs.where(F.col(_CORRUPT).isNull() & F.col("pr_number").isNotNull()).drop(_CORRUPT)


def quarantine(
    spark: SparkSession,
    path: str,
    repositories: Iterable[str] | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """``repository`` and ``document`` (its text, null if only the number is missing) of every
    document that ``scan_documents`` leaves out."""
    docs = _parsed(spark, path, repositories, multi_line)
    bad = docs.where(F.col(_CORRUPT).isNotNull() | F.col("pr_number").isNull())
    return bad.select("repository", "pr_number", F.col(_CORRUPT).alias("document")).drop("pr_number")


def headers(docs: DataFrame, keys=KEYS) -> DataFrame:
    """One row per pull request without its runs, and ``ci_runs``, their number.

    A pull request with many runs is stored in parts; parts combine in each map
    task before the shuffle.
    """
    rest = [c for c in docs.columns if c not in (*keys, "ci_data", "part")]
    runs = F.sum(F.coalesce(F.size("ci_data"), F.lit(0))).alias("ci_runs")
    found = docs.groupBy(*keys).agg(F.any_value(F.struct(*rest)).alias("_header"), runs)
    return found.select(*keys, "_header.*", "ci_runs")


def write_documents(docs: DataFrame, path: str) -> None:
    """One JSON document per line, one directory per repository.

    Rebalancing splits a large repository over many files and packs small ones.
    """
    docs.hint("rebalance", "repository").write.partitionBy("repository").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Array columns have no CSV form and are written as JSON text."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType))]
    flat = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
    flat.write.options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = PULL_REQUEST) -> DataFrame:
    """The schema is given, so numbers and times come back as they were."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def scan_repo_list(spark: SparkSession, path: str) -> DataFrame:
    """Repository names from text: trimmed, without blank lines and ``#`` comments."""
    line = F.trim("value")
    return (
        spark.read.text(path)
        .select(line.alias("repository"))
        .where((F.col("repository") != "") & ~F.startswith(F.col("repository"), F.lit("#")))
    )
