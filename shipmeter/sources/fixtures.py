"""Views of the given tables in the shape of pull-request and CI records.

Orders stand for pull requests, their line items for reviews, comments, commits
and timeline events, and click-stream events for CI runs.  In these tables
``pr_number`` alone identifies a pull request, so children carry it as their only
key (``PR_ID``) and no join is spent on looking up the repository.

Times load without a zone and are read as UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipmeter.functions.urls import VIEW_PREFIX

PR_ID = ("pr_number",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plus(unit: str, amount: str, ts: str) -> Column:
    return F.expr(f"timestampadd({unit}, cast({amount} as bigint), {ts})")


def pr_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key, creation and merge time of every pull request: one narrow scan."""
    return (
        table(spark, sf_dir, "orders")
        .withColumn("day", F.col("o_orderdate").cast("timestamp"))
        .select(
            F.col("o_orderkey").alias("pr_number"),
            F.col("o_custkey"),
            F.when(F.col("o_orderstatus") == "P", "open").otherwise("closed").alias("state"),
            (F.col("o_orderpriority") == "5-LOW").alias("draft"),
            "o_orderpriority",
            _plus("HOUR", "o_custkey % 24", "day").alias("created_at"),
            F.when(
                F.col("o_orderstatus") != "P",
                _plus("MINUTE", "floor(o_totalprice / 8)", "day"),
            ).alias("merged_at"),
        )
        .withColumn("updated_at", _plus("HOUR", "pr_number % 97", "created_at"))
    )


def _authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("o_custkey"),
        F.concat(F.lit("org/"), F.lower("c_mktsegment")).alias("repository"),
        F.when(key % 37 == 5, None)
        .when(key % 10 == 0, "dependabot[bot]")
        .when(key % 10 == 1, F.concat(F.lit("Robot-"), F.col("c_name")))
        .otherwise(F.col("c_name"))
        .alias("author_login"),
        F.when(key % 37 == 5, None)
        .when(key % 50 == 7, "Bot")
        .otherwise("User")
        .alias("author_type"),
        F.when(F.col("c_nationkey") % 3 == 0, "MEMBER")
        .when(F.col("c_nationkey") % 3 == 1, "CONTRIBUTOR")
        .alias("author_association"),
    )


def pr_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pr_number`` to ``repository``."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pr_number"), "o_custkey"
    )
    authors = _authors(spark, sf_dir).select("o_custkey", "repository")
    return orders.join(authors, "o_custkey").select("pr_number", "repository")


def pr_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of pull requests: key, author, state and times, without content."""
    return (
        pr_times(spark, sf_dir)
        .join(_authors(spark, sf_dir), "o_custkey")
        .withColumn("merged", F.col("merged_at").isNotNull())
        .drop("o_custkey", "o_orderpriority")
    )


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("pr_number"))
        .agg(
            F.count("*").alias("changed_files"),
            F.sum("l_quantity").cast("long").alias("additions"),
            F.sum(F.floor(F.col("l_quantity") * F.col("l_discount") * 10))
            .cast("long")
            .alias("deletions"),
            F.min("l_partkey").alias("p_partkey"),
            F.count_if(F.col("l_returnflag") == "R").alias("review_count"),
            F.count_if(F.col("l_returnflag") == "A").alias("comment_count"),
            F.count_distinct("l_suppkey").alias("commit_count"),
        )
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return lines.join(parts, "p_partkey", "left").drop("p_partkey")


def _with_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        pr_times(spark, sf_dir)
        .join(_authors(spark, sf_dir), "o_custkey")
        .join(_contents(spark, sf_dir), "pr_number", "left")
        .withColumn("title", F.col("p_name"))
        .withColumn("body", F.concat_ws(" ", "p_type", "o_orderpriority"))
    )


def raw_prs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pull requests with author, content and times, before any child count."""
    return _with_contents(spark, sf_dir).select(
        "repository",
        "pr_number",
        "state",
        "title",
        "body",
        "author_login",
        "author_type",
        "author_association",
        "draft",
        F.col("merged_at").isNotNull().alias("merged"),
        "created_at",
        "updated_at",
        "merged_at",
        "changed_files",
        "additions",
        "deletions",
    )


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collected records, with child counts and without a draft timeline.

    Orders without lines have null counts: the null cases of the feature code.
    """
    gross = (F.unix_micros("merged_at") - F.unix_micros("created_at")) / F.lit(3.6e9)
    return _with_contents(spark, sf_dir).select(
        "repository",
        "pr_number",
        "title",
        "body",
        "review_count",
        "comment_count",
        "commit_count",
        F.col("changed_files").alias("files_changed"),
        "additions",
        "deletions",
        F.hour("created_at").alias("created_hour"),
        F.weekday("created_at").alias("created_day"),
        F.coalesce("author_association", F.lit("NONE")).alias("author_association"),
        F.col("draft").alias("is_draft"),
        "created_at",
        "merged_at",
        F.when(F.col("merged_at").isNotNull(), F.greatest(F.lit(0.0), gross)).alias(
            "merge_time_hours"
        ),
        F.col("state").alias("pr_state"),
    )


def pr_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    return lines.select(F.col("l_orderkey").alias("pr_number"), F.col("l_linenumber").alias("review_id"))


def pr_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "A")
    return lines.select(F.col("l_orderkey").alias("pr_number"), F.col("l_linenumber").alias("comment_id"))


def _commit_sha(order: str, supplier: str) -> Column:
    return F.md5(F.concat_ws("-", F.col(order).cast("string"), F.col(supplier).cast("string")))


def pr_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per supplier of an order, in supplier order."""
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_suppkey")
        .distinct()
        .select(
            F.col("l_orderkey").alias("pr_number"),
            _commit_sha("l_orderkey", "l_suppkey").alias("sha"),
            F.col("l_suppkey").alias("ordinal"),
        )
    )


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeline events on the clock of the orders, at most one per order and hour."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("pr_number"), (F.col("l_partkey") % 1000).alias("event_id"))
        .agg(F.max("l_returnflag").alias("flag"))
    )
    created = pr_times(spark, sf_dir).select("pr_number", "created_at")
    return lines.join(created, "pr_number").select(
        "pr_number",
        "event_id",
        F.when(F.col("flag") == "R", "ready_for_review")
        .when(F.col("flag") == "A", "converted_to_draft")
        .otherwise("labeled")
        .alias("event"),
        _plus("HOUR", "event_id", "created_at").alias("created_at"),
    )


def timeline_prs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests on the clock of the event stream, one per user."""
    users = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("pr_number")).agg(
        F.min("ts").cast("timestamp").alias("created_at"),
        F.max("ts").cast("timestamp").alias("last_at"),
    )
    return users.select(
        "pr_number",
        "created_at",
        F.when(F.col("pr_number") % 4 != 0, F.col("last_at")).alias("merged_at"),
        (F.col("pr_number") % 3 == 0).alias("is_draft"),
    )


def timeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("pr_number"),
        "event_id",
        F.when(F.col("event_type") == "signup", "ready_for_review")
        .when(F.col("event_type") == "error", "converted_to_draft")
        .otherwise(F.col("event_type"))
        .alias("event"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def _run_name() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "signup", "build")
        .when(kind == "click", "unit-test")
        .when(kind == "view", "lint")
        .when(kind == "purchase", "deploy")
        .when(kind == "error", "e2e-test")
    )


def _run_state() -> Column:
    value = F.col("value")
    return (
        F.when(value < 60, "success")
        .when(value < 90, "failure")
        .when(value < 120, "error")
        .otherwise("pending")
    )


def _run_url() -> Column:
    path = F.concat_ws(
        "/",
        F.lit("b"),
        F.col("user_id").cast("string"),
        F.col("event_type"),
        F.get_json_object("props", "$.k"),
    )
    return (
        F.when(F.col("event_id") % 11 == 0, None)
        .when(F.col("event_id") % 13 == 0, F.concat(F.lit("https://ci.example.org/"), path))
        .otherwise(F.concat(F.lit(VIEW_PREFIX), path))
    )


def ci_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed statuses before the URL filter and before deduplication."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("pr_number"),
        F.col("event_id").alias("ordinal"),
        _run_name().alias("context"),
        _run_url().alias("target_url"),
        _run_state().alias("state"),
    )


def ci_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored CI runs, every event one run."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("pr_number"),
        F.col("event_id").alias("ordinal"),
        _run_name().alias("ci_name"),
        _run_url().alias("ci_target_url"),
        _run_state().alias("ci_state"),
        F.when(F.col("event_id") % 7 != 0, F.col("value") * 60).alias("ci_duration_seconds"),
    )


def commit_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses by commit: two of three on the last commit of the order, the rest on the first."""
    ends = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("user_id"))
        .agg(F.min("l_suppkey").alias("first"), F.max("l_suppkey").alias("last"))
    )
    return (
        table(spark, sf_dir, "events")
        .join(ends, "user_id")
        .withColumn("supplier", F.when(F.col("event_id") % 3 == 0, F.col("first")).otherwise(F.col("last")))
        .select(
            _commit_sha("user_id", "supplier").alias("sha"),
            F.col("event_id").alias("ordinal"),
            _run_name().alias("context"),
            _run_url().alias("target_url"),
            _run_state().alias("state"),
        )
    )


def ci_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed job documents by address.  A view page re-run lands a second time; the
    later landing is the valid one."""
    from shipmeter.functions.urls import job_url

    start = F.col("ts").cast("timestamp")
    end = F.timestamp_micros(
        F.unix_micros(start) + F.round(F.col("value") * 1000).cast("long") * F.lit(1_000_000)
    )

    def stamp(ts: Column) -> Column:
        return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")

    return (
        table(spark, sf_dir, "events")
        .withColumn("url", job_url(_run_url()))
        .where(F.col("url").isNotNull())
        .select(
            "url",
            F.col("event_id").alias("landed"),
            F.to_json(
                F.struct(
                    F.struct(
                        stamp(start).alias("startTime"), stamp(end).alias("completionTime")
                    ).alias("status")
                )
            ).alias("doc"),
        )
    )
