"""Fixed schemas of stored and landed records.

A missing optional column is read as null, so "absent" and "null" are one case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CI_RUN = T.StructType(
    [
        T.StructField("ci_name", T.StringType()),
        T.StructField("ci_target_url", T.StringType()),
        T.StructField("ci_state", T.StringType()),
        T.StructField("ci_duration_seconds", T.DoubleType()),
    ]
)

PULL_REQUEST = T.StructType(
    [
        T.StructField("repository", T.StringType()),
        T.StructField("pr_number", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("review_count", T.LongType()),
        T.StructField("comment_count", T.LongType()),
        T.StructField("commit_count", T.LongType()),
        T.StructField("files_changed", T.LongType()),
        T.StructField("additions", T.LongType()),
        T.StructField("deletions", T.LongType()),
        T.StructField("created_hour", T.IntegerType()),
        T.StructField("created_day", T.IntegerType()),
        T.StructField("author_association", T.StringType()),
        T.StructField("is_draft", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("merged_at", T.TimestampType()),
        T.StructField("merge_time_hours", T.DoubleType()),
        T.StructField("pr_state", T.StringType()),
    ]
)

#: A stored document: the record, its runs, and the load columns of the store.
STORED_DOCUMENT = T.StructType(
    PULL_REQUEST.fields
    + [
        T.StructField("ci_data", T.ArrayType(CI_RUN)),
        T.StructField("_cache_hash", T.StringType()),
        T.StructField("_cached_at", T.TimestampType()),
    ]
)

JOB_DOCUMENT = T.StructType(
    [
        T.StructField(
            "status",
            T.StructType(
                [
                    T.StructField("startTime", T.StringType()),
                    T.StructField("completionTime", T.StringType()),
                ]
            ),
        )
    ]
)

PR_COUNTS = (
    "review_count",
    "comment_count",
    "commit_count",
    "files_changed",
    "additions",
    "deletions",
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to ``schema`` by name; columns the frame lacks become typed nulls."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
