"""Pull-request records: author and merge filters, child counts, the record itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipmeter import KEYS
from shipmeter.functions import times
from shipmeter.operators.timeline import draft_time

# Login fragments that mark an automated author.
BOT_PATTERNS = (
    "[bot]",
    "bot-",
    "-bot",
    "dependabot",
    "renovate",
    "github-actions",
    "codecov",
    "greenkeeper",
    "snyk",
    "renovate-bot",
    "dependabot-preview",
    "allcontributors",
    "imgbot",
    "semantic-release-bot",
)


def is_bot(login: Column, kind: Column) -> Column:
    """Literal fragments, no patterns: ``[bot]`` is not a character class here.
    An unknown author is not a bot."""
    name = F.lower(login)
    tests = [F.contains(name, F.lit(p)) for p in BOT_PATTERNS]
    found = reduce(lambda a, b: a | b, tests)
    return F.coalesce(kind == "Bot", F.lit(False)) | F.coalesce(found, F.lit(False))


def human_prs(prs: DataFrame) -> DataFrame:
    return prs.where(~is_bot(F.col("author_login"), F.col("author_type")))


def merged_prs(prs: DataFrame) -> DataFrame:
    return prs.where(
        F.col("merged") & F.col("merged_at").isNotNull() & F.col("created_at").isNotNull()
    )


def listing(prs: DataFrame, collect_ci: bool) -> DataFrame:
    """All states when CI is wanted as well, else closed PRs only."""
    return prs if collect_ci else prs.where(F.col("state") == "closed")


def child_counts(reviews: DataFrame, comments: DataFrame, commits: DataFrame, keys=KEYS) -> DataFrame:
    """Counts of all three kinds of child in one shuffle, combined on the map side."""
    kinds = {"review_count": reviews, "comment_count": comments, "commit_count": commits}
    rows = [df.select(*keys, F.lit(name).alias("_kind")) for name, df in kinds.items()]
    return (
        reduce(DataFrame.unionByName, rows)
        .groupBy(*keys)
        .agg(*[F.count_if(F.col("_kind") == name).alias(name) for name in kinds])
    )


def net_merge_hours(created: Column, merged: Column, draft_hours: Column) -> Column:
    """Hours to merge without draft time, never below 0; null if not merged."""
    hours = times.hours_between(created, merged) - draft_hours
    return F.when(hours.isNotNull(), F.greatest(F.lit(0.0), hours))


def pr_record(
    prs: DataFrame,
    reviews: DataFrame,
    comments: DataFrame,
    commits: DataFrame,
    events: DataFrame,
    keys=KEYS,
) -> DataFrame:
    """The stored record of each pull request."""
    keys = list(keys)
    drafts = draft_time(
        prs.select(*keys, "created_at", "merged_at", F.col("draft").alias("is_draft")), events, keys
    )
    counts = child_counts(reviews, comments, commits, keys)
    joined = prs.join(counts, keys, "left").join(drafts, keys, "left")
    return joined.select(
        "repository",
        "pr_number",
        "title",
        F.coalesce("body", F.lit("")).alias("body"),
        *[
            F.coalesce(c, F.lit(0)).alias(c)
            for c in ("review_count", "comment_count", "commit_count")
        ],
        F.col("changed_files").alias("files_changed"),
        "additions",
        "deletions",
        times.created_hour(F.col("created_at")).alias("created_hour"),
        times.created_day(F.col("created_at")).alias("created_day"),
        F.coalesce("author_association", F.lit("NONE")).alias("author_association"),
        F.coalesce("draft", F.lit(False)).alias("is_draft"),
        "created_at",
        "merged_at",
        net_merge_hours(
            F.col("created_at"), F.col("merged_at"), F.coalesce("draft_time_hours", F.lit(0.0))
        ).alias("merge_time_hours"),
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of separately collected repositories; a column one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
