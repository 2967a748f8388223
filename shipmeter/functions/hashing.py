"""Change hashes and the stable train/test hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_word(text: Column, digits: int) -> Column:
    """The first hex digits of the md5 of a text, as a long."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def pr_change_hash(ci_digest: Column | None = None) -> Column:
    """md5 of the nine fields that show a change, nulls included.

    Keys are in alphabetical order.  The instant is hashed as microseconds, so no
    session setting changes the text.  ``ci_digest`` adds the CI runs of the PR.
    """
    fields = [
        F.col("additions").cast("long").alias("additions"),
        F.col("comment_count").cast("long").alias("comment_count"),
        F.col("commit_count").cast("long").alias("commit_count"),
        F.col("deletions").cast("long").alias("deletions"),
        F.col("files_changed").cast("long").alias("files_changed"),
        F.unix_micros("merged_at").alias("merged_at"),
        F.col("pr_number").cast("long").alias("pr_number"),
        F.col("review_count").cast("long").alias("review_count"),
        F.col("title").alias("title"),
    ]
    if ci_digest is not None:
        fields.insert(0, ci_digest.alias("_ci"))
    return F.md5(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def ci_run_text() -> Column:
    """One CI run as unambiguous text, for the digest of a PR's runs."""
    return F.to_json(
        F.struct(
            F.round(F.col("ci_duration_seconds") * 1000).cast("long").alias("ci_duration_ms"),
            "ci_name",
            "ci_state",
            "ci_target_url",
        ),
        {"ignoreNullFields": "false"},
    )


def split_bucket(*keys: str, buckets: int = 100) -> Column:
    """A bucket in ``0..buckets-1`` that depends on the key alone."""
    text = F.concat_ws("#", *[F.col(k).cast("string") for k in keys])
    return F.pmod(hex_word(text, 8), F.lit(buckets)).cast("int")
