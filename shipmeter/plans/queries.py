"""Registered queries: operators over the given tables.

Each function takes a session and a table folder.  Doubles are rounded to six
places and times become text at the very end, so engines can be compared.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipmeter.functions import scores, times, urls
from shipmeter.functions.hashing import pr_change_hash
from shipmeter.operators import ci, features, folds, histboost, incremental, models, pulls, scaling, scoring, stats
from shipmeter.operators import textfeatures as tf
from shipmeter.operators import validation
from shipmeter.operators.timeline import draft_time
from shipmeter.session import materialize, prepare, scratch_path, spread
from shipmeter.sources import documents, fixtures, store
from shipmeter.sources.fixtures import PR_ID

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

_KEY = ("repository", "pr_number")


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def r6(column: str | Column, name: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 6).alias(name or column)


def iso(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


# Data that several queries of one session read: written or fitted once.
_ONCE: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]) -> object:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _ONCE:
        _ONCE[key] = make()
    return _ONCE[key]


# --- sources and sinks ------------------------------------------------------


def _documents(spark: SparkSession, sf_dir: str) -> str:
    """Stored documents as JSON lines; every 97th is cut short."""

    def write() -> str:
        nested = ci.nest_ci(
            fixtures.pull_requests(spark, sf_dir), fixtures.ci_runs(spark, sf_dir), PR_ID
        )
        text = F.to_json(F.struct(*[c for c in nested.columns if c not in ("repository", "part")]))
        cut = F.when(F.col("pr_number") % 97 == 0, F.substring(text, 1, 40)).otherwise(text)
        path = scratch_path(spark, "documents")
        nested.select("repository", cut.alias("value")).hint("rebalance", "repository").write.partitionBy(
            "repository"
        ).text(path)
        return path

    return once(spark, sf_dir, "documents", write)


@query
def scan_prs(spark, sf_dir):
    """One row per readable pull request with the number of its runs."""
    prs = documents.headers(documents.scan_documents(spark, _documents(spark, sf_dir)))
    return prs.select(*_KEY, "title", iso("created_at"), iso("merged_at"), "ci_runs")


@query
def scan_quarantine(spark, sf_dir):
    """Documents that cannot be read, by repository."""
    bad = documents.quarantine(spark, _documents(spark, sf_dir))
    return bad.groupBy("repository").agg(F.count("document").alias("documents"))


@query
def scan_ci_runs(spark, sf_dir):
    docs = documents.scan_documents(spark, _documents(spark, sf_dir))
    return ci.explode_ci(docs).withColumn("ci_duration_seconds", r6("ci_duration_seconds"))


@query
def scan_repos(spark, sf_dir):
    wanted = ["org/machinery", "org/building", "org/absent"]
    docs = documents.scan_documents(spark, _documents(spark, sf_dir), wanted)
    return documents.headers(docs).select(*_KEY, "additions", r6("merge_time_hours"))


@query
def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    documents.write_csv(fixtures.pull_requests(spark, sf_dir), path)
    back = documents.read_csv(spark, path)
    return back.select(
        *[c for c in back.columns if c not in ("created_at", "merged_at", "merge_time_hours")],
        iso("created_at"),
        iso("merged_at"),
        r6("merge_time_hours"),
    )


@query
def scan_repo_list(spark, sf_dir):
    path = scratch_path(spark, "repo-list")
    key = F.col("c_custkey")
    name = F.concat(F.lit("org/"), F.lower("c_mktsegment"), F.lit("-"), key.cast("string"))
    line = (
        F.when(key % 5 == 0, F.concat(F.lit("  "), name, F.lit("  ")))
        .when(key % 5 == 1, "")
        .when(key % 5 == 2, F.concat(F.lit("# "), name))
        .when(key % 5 == 3, F.concat(F.lit("  #"), name))
        .otherwise(name)
    )
    fixtures.table(spark, sf_dir, "customer").select(line.alias("value")).write.text(path)
    return documents.scan_repo_list(spark, path)


@query
def pr_listing(spark, sf_dir):
    rows = pulls.listing(fixtures.pr_listing(spark, sf_dir), collect_ci=False)
    return rows.select(*_KEY, "state", iso("updated_at"))


@query
def union_repos(spark, sf_dir):
    """Repositories collected separately, some without a body column."""
    prs = fixtures.pull_requests(spark, sf_dir).select(*_KEY, "title", "body")
    bare = prs.where(F.col("repository") < "org/f").drop("body")
    full = prs.where(F.col("repository") >= "org/f")
    return pulls.union_all([full, bare])


# --- store ------------------------------------------------------------------


def _stored_and_incoming(spark: SparkSession, sf_dir: str, write: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two of three PRs are stored, without runs; all arrive, some changed, some with runs.

    ``write``: both come from one written table of the records with their runs' digests, for
    loads that read them several times.
    """
    prs = fixtures.pull_requests(spark, sf_dir)
    both = store.with_ci(prs, ci.ci_digest(fixtures.ci_runs(spark, sf_dir), PR_ID), PR_ID)
    if write:
        # Runs without a record have no merge time, so ``storable`` takes none of them as stored.
        prs = both = materialize(both, "landed")
    none = F.lit(None).cast("string")
    stored = store.with_hash(
        store.storable(
            prs.where(F.col("pr_number") % 3 != 0)
            .withColumn("ci_digest", none)
            .withColumn("ci_run_count", F.lit(0).cast("long"))
        )
    )
    grown = both.withColumn(
        "additions", F.col("additions") + F.when(F.col("pr_number") % 5 == 0, 1).otherwise(0)
    )
    incoming = store.with_hash(store.storable(grown))
    return stored, incoming.select(*stored.columns)


@query
def pr_upsert(spark, sf_dir):
    stored, incoming = _stored_and_incoming(spark, sf_dir)
    merged = store.merge(stored, incoming, PR_ID)
    return merged.select(
        *_KEY, "action", "additions", "_cache_hash", F.coalesce("ci_run_count", F.lit(0)).alias("ci_run_count")
    )


@query
def clear_repo(spark, sf_dir):
    stored, _ = _stored_and_incoming(spark, sf_dir)
    return store.without_repository(stored, "org/building").select(*_KEY, "_cache_hash")


def _cycled(spark: SparkSession, sf_dir: str) -> tuple[store.Store, int]:
    """A written store: part of the PRs, then all of them twice over with runs, then one clear."""
    kept = store.Store(spark, scratch_path(spark, "store"))
    repos = fixtures.pr_repositories(spark, sf_dir)
    runs = fixtures.ci_runs(spark, sf_dir).join(repos.select("repository", "pr_number"), list(PR_ID))
    stored, incoming = _stored_and_incoming(spark, sf_dir, write=True)
    first, second, third = (datetime(2024, 6, d) for d in (1, 2, 3))
    kept.upsert(stored, first)
    kept.upsert(incoming.unionByName(incoming), second, runs)
    return kept, kept.clear("org/building", third)


@query
def store_cycle(spark, sf_dir):
    """What is left after loads, a load with every key twice, and a dropped repository."""
    kept, dropped = _cycled(spark, sf_dir)
    return kept.rows().select(
        *_KEY, "additions", "_cache_hash", F.coalesce("ci_run_count", F.lit(0)).alias("ci_run_count"),
        F.lit(dropped).cast("long").alias("dropped"),
    )


@query
def store_commits(spark, sf_dir):
    """``store_cycle`` by other loads: one that breaks between its writes, and two that
    overlap, the earlier committing last.  The store must hold what the two committed."""
    kept = store.Store(spark, scratch_path(spark, "store"))
    repos = fixtures.pr_repositories(spark, sf_dir)
    runs = fixtures.ci_runs(spark, sf_dir).join(repos.select("repository", "pr_number"), list(PR_ID))
    stored, incoming = _stored_and_incoming(spark, sf_dir, write=True)
    first, second, third = (datetime(2024, 6, d) for d in (1, 2, 3))

    def breaks() -> None:
        raise _Broken()

    try:
        kept.upsert(incoming, datetime(2024, 6, 9), runs, between=breaks)
    except _Broken:
        pass
    kept.upsert(stored, first, between=lambda: kept.upsert(incoming.unionByName(incoming), second, runs))
    dropped = kept.clear("org/building", third)
    return kept.rows().select(
        *_KEY, "additions", "_cache_hash", F.coalesce("ci_run_count", F.lit(0)).alias("ci_run_count"),
        F.lit(dropped).cast("long").alias("dropped"),
    )


@query
def store_keys(spark, sf_dir):
    """The key sets read through the store after its loads: every current key, and
    whether it has CI runs."""
    kept, _ = _cycled(spark, sf_dir)
    with_ci = kept.pr_keys(with_ci_only=True).withColumn("has_ci", F.lit(True))
    return kept.pr_keys().join(with_ci, list(_KEY), "left").select(*_KEY, F.coalesce("has_ci", F.lit(False)).alias("has_ci"))


@query
def store_first_rows(spark, sf_dir):
    """The 1000 current rows of the store with the lowest numbers, read through the store."""
    kept, _ = _cycled(spark, sf_dir)
    return incremental.first_stored(kept.rows(), 1000).select(*_KEY, "additions", "_cache_hash")


@query
def store_statistics(spark, sf_dir):
    """PRs per repository and in total of the store's current rows after its loads."""
    kept, _ = _cycled(spark, sf_dir)
    out = stats.store_stats(kept.rows())
    return out.select(
        F.coalesce("repository", F.lit("(all)")).alias("repository"),
        F.coalesce("store_name", F.lit("(all)")).alias("store_name"),
        "prs",
        "repositories",
    )


class _Broken(Exception):
    """A load that stops between its two writes."""


@query
def store_runs(spark, sf_dir):
    """CI runs read back from the store."""
    kept, _ = _cycled(spark, sf_dir)
    return kept.runs().select(*_KEY, "ordinal", "ci_name", "ci_state", r6("ci_duration_seconds"))


@query
def pr_change_hash_query(spark, sf_dir):
    prs = fixtures.pull_requests(spark, sf_dir)
    return prs.select(*_KEY, pr_change_hash().alias("change_hash"))


QUERIES["pr_change_hash"] = QUERIES.pop("pr_change_hash_query")


@query
def stored_pr_keys(spark, sf_dir):
    stored = fixtures.pr_listing(spark, sf_dir)
    runs = fixtures.ci_runs(spark, sf_dir).select(*PR_ID).distinct().withColumn("_ci", F.lit(True))
    return stored.join(runs, list(PR_ID), "left").select(
        *_KEY, F.coalesce("_ci", F.lit(False)).alias("has_ci")
    )


@query
def store_stats(spark, sf_dir):
    stored = fixtures.pr_repositories(spark, sf_dir)
    out = stats.store_stats(stored)
    return out.select(
        F.coalesce("repository", F.lit("(all)")).alias("repository"),
        F.coalesce("store_name", F.lit("(all)")).alias("store_name"),
        "prs",
        "repositories",
    )


@query
def collection_summary(spark, sf_dir):
    repos = fixtures.pr_repositories(spark, sf_dir)
    runs = fixtures.ci_runs(spark, sf_dir).groupBy(*PR_ID).agg(F.count("*").alias("runs"))
    out = stats.collection_summary(repos, runs.join(repos, list(PR_ID)))
    return out.withColumn("repository", F.coalesce("repository", F.lit("(all)")))


# --- pull requests ----------------------------------------------------------


@query
def pr_record(spark, sf_dir):
    record = pulls.pr_record(
        fixtures.raw_prs(spark, sf_dir),
        fixtures.pr_reviews(spark, sf_dir),
        fixtures.pr_comments(spark, sf_dir),
        fixtures.pr_commits(spark, sf_dir),
        fixtures.order_events(spark, sf_dir),
        PR_ID,
    )
    return record.select(
        *[c for c in record.columns if c not in ("created_at", "merged_at", "merge_time_hours")],
        iso("created_at"),
        iso("merged_at"),
        r6("merge_time_hours"),
    )


@query
def draft_time_query(spark, sf_dir):
    drafts = draft_time(
        fixtures.timeline_prs(spark, sf_dir), fixtures.timeline_events(spark, sf_dir), PR_ID
    )
    return drafts.select(*PR_ID, r6("draft_time_hours"))


QUERIES["draft_time"] = QUERIES.pop("draft_time_query")


@query
def net_merge_time(spark, sf_dir):
    prs = fixtures.timeline_prs(spark, sf_dir)
    drafts = draft_time(prs, fixtures.timeline_events(spark, sf_dir), PR_ID)
    net = pulls.net_merge_hours(F.col("created_at"), F.col("merged_at"), F.col("draft_time_hours"))
    return prs.join(drafts, list(PR_ID)).select(*PR_ID, r6(net, "merge_time_hours"))


@query
def human_prs(spark, sf_dir):
    rows = pulls.human_prs(fixtures.pr_listing(spark, sf_dir))
    return rows.select(*_KEY, "author_login")


@query
def merged_prs(spark, sf_dir):
    rows = pulls.merged_prs(fixtures.pr_listing(spark, sf_dir))
    return rows.select(*_KEY, iso("merged_at"))


@query
def created_parts(spark, sf_dir):
    created = F.col("created_at")
    return fixtures.pr_times(spark, sf_dir).select(
        "pr_number",
        times.created_hour(created).alias("created_hour"),
        times.created_day(created).alias("created_day"),
    )


@query
def business_hour_flag(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return fixtures.table(spark, sf_dir, "events").select(
        "event_id", times.is_business_hour(ts).alias("is_business_hour")
    )


@query
def business_hours_between(spark, sf_dir):
    hours = times.business_hours_between(F.col("created_at"), F.col("merged_at"))
    prs = fixtures.pr_times(spark, sf_dir).where(F.col("merged_at").isNotNull())
    return prs.select("pr_number", r6(hours, "business_hours"))


@query
def format_duration(spark, sf_dir):
    hours = F.col("value") * F.lit(0.4)
    return fixtures.table(spark, sf_dir, "events").select(
        "event_id", times.format_duration(hours).alias("duration_text")
    )


@query
def parse_duration(spark, sf_dir):
    key = F.col("o_orderkey")
    part = F.concat(
        F.when(key % 2 == 0, F.concat((key % 5).cast("string"), F.lit("h"))).otherwise(""),
        F.when(key % 3 != 0, F.concat((key % 60).cast("string"), F.lit("M"))).otherwise(""),
        F.when(key % 7 != 0, F.concat((key % 61).cast("string"), F.lit("s"))).otherwise(""),
    )
    return fixtures.table(spark, sf_dir, "orders").select(
        key.alias("pr_number"), times.parse_duration(part).alias("seconds")
    )


@query
def validate_prs(spark, sf_dir):
    return validation.with_error(_faulty(spark, sf_dir)).select(*_KEY, "error")


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests, some with negative additions, some without a title."""
    key = F.col("pr_number")
    return (
        fixtures.pull_requests(spark, sf_dir)
        .withColumn("additions", F.when(key % 50 == 0, -1).otherwise(F.col("additions")))
        .withColumn("title", F.when(key % 70 != 0, F.col("title")))
    )


# --- incremental load -------------------------------------------------------


@query
def prs_to_fetch(spark, sf_dir):
    listed = pulls.human_prs(fixtures.pr_listing(spark, sf_dir))
    stored = fixtures.pr_times(spark, sf_dir).where(F.col("pr_number") % 3 != 0)
    return incremental.prs_to_fetch(listed, stored, PR_ID).select(*_KEY)


@query
def ci_to_fetch(spark, sf_dir):
    listed = pulls.human_prs(fixtures.pr_listing(spark, sf_dir))
    return incremental.ci_to_fetch(listed, fixtures.ci_runs(spark, sf_dir), PR_ID).select(*_KEY)


@query
def fetch_budget(spark, sf_dir):
    listed = pulls.human_prs(fixtures.pr_listing(spark, sf_dir))
    stored = fixtures.pr_repositories(spark, sf_dir).where(F.col("pr_number") % 3 != 0)
    counts = stored.groupBy("repository").agg(F.count("*").alias("stored"))
    candidates = materialize(incremental.prs_to_fetch(listed, stored, PR_ID), "candidates")
    taken = incremental.fetch_budget(candidates, counts, max_new=400, limit=2_300)
    return taken.select(*_KEY, "position", "merged")


@query
def fetch_budget_both(spark, sf_dir):
    """The budget over PRs that need their record, their CI or both: records of two in
    three PRs are stored, CI only of the stored merged ones."""
    listed = pulls.human_prs(fixtures.pr_listing(spark, sf_dir))
    stored = fixtures.pr_repositories(spark, sf_dir).where(F.col("pr_number") % 3 != 0)
    merged = fixtures.pr_times(spark, sf_dir).where(F.col("merged_at").isNotNull()).select(*PR_ID)
    stored_runs = fixtures.ci_runs(spark, sf_dir).join(stored.select(*PR_ID), list(PR_ID), "left_semi").join(
        merged, list(PR_ID), "left_semi"
    )
    counts = stored.groupBy("repository").agg(F.count("*").alias("stored"))
    candidates = materialize(incremental.needs(listed, stored, stored_runs, PR_ID), "candidates")
    taken = incremental.fetch_budget(candidates, counts, max_new=400, limit=2_300, counted="counted")
    return taken.select(*_KEY, "position", "need_pr", "need_ci")


@query
def stored_prs_limit(spark, sf_dir):
    return incremental.first_stored(fixtures.pr_repositories(spark, sf_dir), 1000)


@query
def open_prs_topn(spark, sf_dir):
    rows = incremental.newest_open(fixtures.pr_listing(spark, sf_dir), 50)
    return rows.select(*_KEY, "rank", iso("created_at"))


# --- CI ---------------------------------------------------------------------


@query
def ci_runs_clean(spark, sf_dir):
    rows = ci.clean_statuses(fixtures.ci_statuses(spark, sf_dir))
    return rows.select(
        *PR_ID,
        "ordinal",
        F.col("context").alias("ci_name"),
        F.col("target_url").alias("ci_target_url"),
        F.col("state").alias("ci_state"),
    )


@query
def ci_runs_dedup(spark, sf_dir):
    rows = ci.clean_statuses(fixtures.ci_statuses(spark, sf_dir))
    return ci.first_per_url(rows, PR_ID).select(*PR_ID, "ordinal", "target_url", "context", "state")


@query
def latest_commit_statuses(spark, sf_dir):
    rows = ci.latest_commit_statuses(
        fixtures.pr_commits(spark, sf_dir), fixtures.commit_statuses(spark, sf_dir), PR_ID
    )
    return rows.select(*PR_ID, "sha", "ordinal", "context", "state")


@query
def job_url(spark, sf_dir):
    url = F.col("target_url")
    return fixtures.ci_statuses(spark, sf_dir).select("ordinal", urls.job_url(url).alias("job_url"))


@query
def job_durations(spark, sf_dir):
    runs = ci.collect_runs(
        fixtures.pr_commits(spark, sf_dir),
        fixtures.commit_statuses(spark, sf_dir),
        fixtures.ci_documents(spark, sf_dir),
        PR_ID,
    )
    return runs.withColumn("ci_duration_seconds", r6("ci_duration_seconds"))


@query
def prs_with_ci(spark, sf_dir):
    prs = fixtures.pr_repositories(spark, sf_dir)
    return ci.prs_with_ci(prs, fixtures.ci_runs(spark, sf_dir), PR_ID).select(*_KEY)


@query
def pr_ci_nested(spark, sf_dir):
    """Merged PRs with their runs; runs of other PRs keep a minimal row."""
    prs = fixtures.pr_times(spark, sf_dir).where(F.col("merged_at").isNotNull())
    nested = ci.nest_ci(prs.select(*PR_ID, "merged_at"), fixtures.ci_runs(spark, sf_dir), PR_ID)
    return nested.select(
        *PR_ID,
        iso("merged_at"),
        F.coalesce("part", F.lit(-1)).alias("part"),
        F.coalesce(F.size("ci_data"), F.lit(0)).alias("ci_runs"),
        F.array_join(F.transform("ci_data", lambda r: r["ci_name"]), ",").alias("ci_names"),
    )


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ci.ci_rollup(
        fixtures.ci_runs(spark, sf_dir), fixtures.pull_requests(spark, sf_dir), PR_ID
    )


_ROLLUP_DOUBLES = (*ci.DURATION_COLUMNS, "ci_success_rate", "ci_avg_retries")


def _rounded(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query
def ci_rollup(spark, sf_dir):
    return _rounded(_rollup(spark, sf_dir), _ROLLUP_DOUBLES)


def _rollup_part(*columns: str) -> Query:
    def part(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = ci.rollup_runs(fixtures.ci_runs(spark, sf_dir), PR_ID)
        doubles = [c for c in columns if c in _ROLLUP_DOUBLES]
        return _rounded(rows.select(*PR_ID, *columns), doubles)

    return part


for _name, _columns in {
    "ci_durations": ci.DURATION_COLUMNS,
    "ci_outcomes": ci.OUTCOME_COLUMNS,
    "ci_retries": ci.RETRY_COLUMNS,
    "ci_kind_flags": tuple(ci.KIND_WORDS),
}.items():
    _part = _rollup_part(*_columns)
    _part.__name__ = _name
    query(_part)


@query
def ci_rollup_nested(spark, sf_dir):
    parts = ci.ci_parts(fixtures.ci_runs(spark, sf_dir), PR_ID)
    return ci.rollup_nested(parts, PR_ID)


def _runs_by_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.ci_runs(spark, sf_dir).join(
        fixtures.pr_repositories(spark, sf_dir), list(PR_ID)
    )


@query
def ci_summary(spark, sf_dir):
    doubles = ("success_rate", "failure_rate")
    doubles += tuple(f"{k}_duration_seconds" for k in ("avg", "max", "min", "median"))
    runs = _runs_by_repository(spark, sf_dir).drop("ci_target_url", "ordinal")
    return _rounded(ci.ci_summary(materialize(runs, "runs")), doubles)


@query
def ci_state_distribution(spark, sf_dir):
    return ci.state_distribution(_runs_by_repository(spark, sf_dir))


@query
def ci_top_tests(spark, sf_dir):
    return ci.top_tests(fixtures.ci_runs(spark, sf_dir), 10)


@query
def ci_top_tests_by_repo(spark, sf_dir):
    return ci.top_tests_by(_runs_by_repository(spark, sf_dir), k=3)


# --- statistics -------------------------------------------------------------


@query
def repo_numeric_stats(spark, sf_dir):
    prs = fixtures.pull_requests(spark, sf_dir).select("repository", *stats.STAT_FIELDS)
    out = stats.numeric_stats(materialize(prs, "numbers"), by=["repository"])
    return out.select(
        "repository", "field", *[r6(c) for c in ("mean", "median", "std", "min", "max")]
    )


@query
def repo_time_profile(spark, sf_dir):
    out = stats.time_profile(fixtures.pull_requests(spark, sf_dir))
    return _rounded(out, ("weekend_prs_ratio", "business_hours_prs_ratio"))


def _merge_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two narrow columns, written once for the passes over them."""
    prs = fixtures.pull_requests(spark, sf_dir).select("repository", "merge_time_hours")
    return materialize(prs, "merge-times")


@query
def merge_time_percentiles(spark, sf_dir):
    out = stats.merge_percentiles(_merge_times(spark, sf_dir))
    return out.select(*[r6(c) for c in out.columns])


@query
def merge_time_percentiles_by_repo(spark, sf_dir):
    out = stats.merge_percentiles(_merge_times(spark, sf_dir), by=["repository"])
    return out.select("repository", *[r6(c) for c in out.columns if c != "repository"])


def _line_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"
    )


@query
def outliers_iqr(spark, sf_dir):
    return stats.filter_outliers(_line_prices(spark, sf_dir), "l_extendedprice", "iqr", 0.4)


@query
def outliers_zscore(spark, sf_dir):
    return stats.filter_outliers(_line_prices(spark, sf_dir), "l_extendedprice", "zscore", 1.5)


# --- features ---------------------------------------------------------------


def _feature_output(df: DataFrame, names) -> DataFrame:
    return df.select(*_KEY, *[r6(n) for n in names])


@query
def pr_basic_features(spark, sf_dir):
    prs = fixtures.pull_requests(spark, sf_dir)
    out = features.select_features(prs, features.basic_pr_features(), *_KEY, fill=False)
    return _feature_output(out, features.PR_BASIC)


@query
def pr_derived_features(spark, sf_dir):
    prs = fixtures.pull_requests(spark, sf_dir)
    out = features.select_features(prs, features.derived_pr_features(), *_KEY, fill=False)
    return _feature_output(out, features.PR_DERIVED)


@query
def pr_training_rows(spark, sf_dir):
    rows = features.training_rows(fixtures.pull_requests(spark, sf_dir))
    return rows.select(*_KEY, r6("merge_time_hours"))


@query
def pr_text(spark, sf_dir):
    prs = fixtures.pull_requests(spark, sf_dir)
    return prs.select(*_KEY, tf.pr_text(F.col("title"), F.col("body")).alias("text"))


@query
def pr_features(spark, sf_dir):
    """All 66 columns, the vocabulary fitted on every row."""
    table = models.pr_table(fixtures.pull_requests(spark, sf_dir), tf.PR_TEXT, label=None)
    table = materialize(table, "features")
    terms = tf.collect_terms(tf.vocabulary(table, tf.PR_TEXT))
    wide = tf.with_wide_tfidf(table, terms, tf.PR_TEXT)
    return _feature_output(wide, [c for c in wide.columns if c not in (*_KEY, "ngrams")])


@query
def feature_profile(spark, sf_dir):
    text = [f"tfidf_{i}" for i in range(tf.PR_TEXT.max_features)]
    out = features.feature_profile(
        fixtures.pull_requests(spark, sf_dir), [*features.PR_STRUCTURAL, *text]
    )
    return _rounded(out, ["text_ratio"])


@query
def feature_alignment(spark, sf_dir):
    trained = ["is_weekend", "additions", "tfidf_7", "addition_ratio"]
    table = features.pr_features(fixtures.pull_requests(spark, sf_dir), *_KEY)
    return _feature_output(features.align(table, trained, *_KEY), trained)


@query
def ci_features(spark, sf_dir):
    table = features.ci_feature_table(_rollup(spark, sf_dir), *_KEY)
    return _feature_output(table, features.CI_STRUCTURAL)


@query
def ci_features_text(spark, sf_dir):
    """The CI feature table with its 30 text columns; the vocabulary of PR titles is
    fitted on every row."""
    table = materialize(models.ci_table(_rollup(spark, sf_dir), tf.CI_TEXT, _KEY), "ci-features")
    terms = tf.collect_terms(tf.vocabulary(table, tf.CI_TEXT))
    wide = tf.with_wide_tfidf(table, terms, tf.CI_TEXT)
    text = [f"{tf.CI_TEXT.prefix}{i}" for i in range(tf.CI_TEXT.max_features)]
    return _feature_output(wide, [*features.CI_STRUCTURAL, *text])


@query
def ci_targets(spark, sf_dir):
    labels = features.with_ci_labels(_rollup(spark, sf_dir))
    return _feature_output(labels, [f"label_{t}" for t in models.CI_TARGETS])


@query
def train_test_split(spark, sf_dir):
    return scaling.with_split(fixtures.pr_repositories(spark, sf_dir)).select(*_KEY, "is_test")


@query
def scaled_features(spark, sf_dir):
    names = list(features.PR_STRUCTURAL)
    rows = features.pr_features(fixtures.pull_requests(spark, sf_dir), *_KEY)
    table = materialize(scaling.with_split(rows), "features")
    out = scaling.scale(table, table.where(~F.col("is_test")), names, *_KEY, "is_test")
    return out.select(*_KEY, "is_test", *[r6(n) for n in names])


@query
def scaled_all_features(spark, sf_dir):
    """All 66 columns, the vocabulary fitted on every row, scaled by the moments of the
    training rows."""
    table = materialize(models.pr_table(fixtures.pull_requests(spark, sf_dir), tf.PR_TEXT, label=None), "features")
    terms = tf.collect_terms(tf.vocabulary(table, tf.PR_TEXT))
    wide = tf.with_wide_tfidf(table, terms, tf.PR_TEXT).drop("ngrams")
    names = [*features.PR_STRUCTURAL, *[f"{tf.PR_TEXT.prefix}{i}" for i in range(tf.PR_TEXT.max_features)]]
    split = materialize(scaling.with_split(wide), "wide-features")
    out = scaling.scale(split, split.where(~F.col("is_test")), names, *_KEY, "is_test", digits=6)
    return out.select(*_KEY, "is_test", *names)


# --- text -------------------------------------------------------------------


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, spread over all cores if the files alone would not be."""
    docs = fixtures.table(spark, sf_dir, "documents").select("doc_id", "text")
    return spread(docs, "doc_id")


def _grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tf.with_ngrams(_texts(spark, sf_dir), "text").select("doc_id", "ngrams")


@query
def tokens(spark, sf_dir):
    return tf.with_tokens(_texts(spark, sf_dir), "text").select(
        "doc_id", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5")
    )


@query
def tokens_nostop(spark, sf_dir):
    words = tf.without_stop_words(tf.with_tokens(_texts(spark, sf_dir), "text"))
    return words.select(
        "doc_id", F.size("words").alias("n"), F.md5(F.array_join("words", " ")).alias("words_md5")
    )


@query
def ngrams(spark, sf_dir):
    return _grams(spark, sf_dir).select(
        "doc_id", F.size("ngrams").alias("n"), F.md5(F.array_join("ngrams", "|")).alias("ngrams_md5")
    )


@query
def vocabulary(spark, sf_dir):
    return _rounded(tf.vocabulary(_grams(spark, sf_dir)), ["idf"])


@query
def tfidf(spark, sf_dir):
    grams = _grams(spark, sf_dir)
    return _rounded(tf.tfidf(grams, tf.collect_terms(tf.vocabulary(grams)), "doc_id"), ["tfidf"])


@query
def tfidf_apply(spark, sf_dir):
    """The vocabulary of the training documents applied to all of them."""
    grams = _grams(spark, sf_dir)
    train = scaling.with_split(grams, ["doc_id"]).where(~F.col("is_test"))
    return _rounded(tf.tfidf(grams, tf.collect_terms(tf.vocabulary(train)), "doc_id"), ["tfidf"])


@query
def text_weighting(spark, sf_dir):
    grams = _grams(spark, sf_dir)
    long = tf.tfidf(grams, tf.collect_terms(tf.vocabulary(grams, tf.CI_TEXT)), "doc_id")
    return _rounded(tf.weighted(long, tf.CI_TEXT.weight), ["tfidf"])


# --- metrics and scores without a model -------------------------------------


@query
def regression_metrics(spark, sf_dir):
    """A plain rule as the prediction: a day per changed file."""
    prs = features.training_rows(fixtures.pull_requests(spark, sf_dir)).select(
        "repository",
        F.col("merge_time_hours").alias("label"),
        (F.col("files_changed") * 24.0).alias("prediction"),
    )
    out = models.regression_metrics(prs, by=["repository"])
    return out.select("repository", *[r6(c) for c in out.columns if c != "repository"])


@query
def ci_metrics(spark, sf_dir):
    labels = materialize(features.with_ci_labels(_rollup(spark, sf_dir)), "labels")
    rules = {
        "duration": F.col("ci_total_runs") * 0.5,
        "attempts": F.col("ci_unique_tests") * 2.0,
        "success": F.col("ci_successful_runs") / (F.col("ci_total_runs") + 5),
    }
    out = None
    for target, rule in rules.items():
        rows = labels.select(F.col(f"label_{target}").alias("label"), rule.alias("prediction"))
        part = models.ci_metrics(rows, target).withColumn("target", F.lit(target))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.select("target", *[r6(c) for c in out.columns if c != "target"])


@query
def score_confidence(spark, sf_dir):
    table = features.pr_features(fixtures.pull_requests(spark, sf_dir), *_KEY)
    share = scores.filled_share(list(features.PR_STRUCTURAL))
    return table.select(
        *_KEY, r6(share, "filled_share"), scores.confidence(share).alias("prediction_confidence")
    )


def _rule_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir).select(
        *_KEY,
        (F.col("ci_total_duration") / 36000).alias("duration"),
        (F.col("ci_avg_retries") / 8 - 0.5).alias("attempts"),
        (F.col("ci_success_rate") * 1.6 - 0.3).alias("success"),
    )


@query
def combined_rules(spark, sf_dir):
    """The PR and CI comparison and advice texts, fed by rule predictions so every text
    is certain: PR hours are additions / 10, confidence the share of filled features,
    CI the rule predictions of ``ci_score_shaping``."""
    table = features.pr_features(fixtures.pull_requests(spark, sf_dir), *_KEY)
    share = scores.filled_share(list(features.PR_STRUCTURAL))
    pr_scores = table.select(
        *_KEY,
        (F.col("additions") / 10).alias("predicted_hours"),
        scores.confidence(share).alias("prediction_confidence"),
        F.lit(None).cast("string").alias("error"),
    )
    ci_scores = scoring.summarize_ci(scoring.shape_ci(_rule_predictions(spark, sf_dir)))
    out = scoring.combine(pr_scores, ci_scores, _KEY)
    return out.select(
        *_KEY, r6("predicted_hours"), r6("total_duration_hours"), "prediction_confidence", "timeline_comparison",
        "ci_recommendation", "pr_advice", "error",
    )


@query
def ci_score_shaping(spark, sf_dir):
    shaped = scoring.shape_ci(_rule_predictions(spark, sf_dir))
    return _rounded(
        shaped, ("total_duration_hours", "total_duration_minutes", "success_probability")
    )


@query
def ci_prediction_summary(spark, sf_dir):
    out = scoring.summarize_ci(scoring.shape_ci(_rule_predictions(spark, sf_dir)))
    return out.select(
        *_KEY,
        "estimated_completion_time",
        "expected_attempts",
        "retry_risk",
        "overall_success_likelihood",
        "recommendation",
    )


# --- models -----------------------------------------------------------------

_FOREST, _BOOSTING, _LEAFWISE = (
    models.PR_DEFAULTS[n] for n in ("random_forest", "gradient_boosting", "leafwise")
)
_CI_FOREST = models.CI_DEFAULTS["random_forest"]


def _merge_model(spark: SparkSession, sf_dir: str, config=_FOREST) -> models.Fitted:
    return once(
        spark,
        sf_dir,
        f"merge-{config.algorithm}",
        lambda: models.fit_merge_time(fixtures.pull_requests(spark, sf_dir), config, min_rows=10),
    )


def _ci_models(spark: SparkSession, sf_dir: str) -> tuple[dict[str, models.Fitted], dict[str, str]]:
    return once(
        spark,
        sf_dir,
        "ci",
        lambda: models.fit_ci(_rollup(spark, sf_dir), _CI_FOREST, min_rows=10),
    )


def _algorithm_scores(config: models.ModelConfig) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = _merge_model(spark, sf_dir, config)
        return scoring.score_prs(fixtures.pull_requests(spark, sf_dir), model)

    return run


for _name, _config in {
    "rf_scores": _FOREST,
    "gbt_scores": _BOOSTING,
    "gbt_leafy_scores": _LEAFWISE,
}.items():
    _scores = _algorithm_scores(_config)
    _scores.__name__ = _name
    query(_scores)


@query
def batch_scores(spark, sf_dir):
    return scoring.score_prs(_faulty(spark, sf_dir), _merge_model(spark, sf_dir))


@query
def batch_score_keys(spark, sf_dir):
    """What is certain of ``batch_scores``: every row, its fault, and whether it has a prediction."""
    out = scoring.score_prs(_faulty(spark, sf_dir), _merge_model(spark, sf_dir))
    return out.select(
        *_KEY, "error", F.col("predicted_hours").isNull().alias("unpredicted"),
        F.col("prediction_confidence").isNull().alias("unrated"),
    )


@query
def store_to_scores(spark, sf_dir):
    """One path from the store to scores: the merge-time forest fitted on the store's
    current rows after its loads, saved and loaded again, then a batch scored.  What is
    certain of it, as in ``batch_score_keys``."""
    kept, _ = _cycled(spark, sf_dir)
    fitted = models.fit_merge_time(kept.rows(), _FOREST, min_rows=10)
    path = scratch_path(spark, "store-model")
    models.save(fitted, path)
    out = scoring.score_prs(_faulty(spark, sf_dir), models.load(spark, path))
    return out.select(
        *_KEY, "error", F.col("predicted_hours").isNull().alias("unpredicted"),
        F.col("prediction_confidence").isNull().alias("unrated"),
    )


def _pr_url() -> Column:
    return F.concat(F.lit("https://git.example.org/"), "repository", F.lit("/pull/"), "pr_number")


@query
def batch_report(spark, sf_dir):
    prs = fixtures.pull_requests(spark, sf_dir)
    newest = incremental.newest_open(prs.withColumn("state", F.col("pr_state")), 50)
    report = scoring.batch_report(newest, _merge_model(spark, sf_dir), _pr_url())
    path = scratch_path(spark, "batch-report")
    documents.write_csv(report, path)
    return documents.read_csv(spark, path, report.schema)


@query
def batch_report_keys(spark, sf_dir):
    """What is certain of ``batch_report``."""
    report = batch_report(spark, sf_dir)
    return report.select(
        *_KEY, "pr_title", "pr_url", iso("created_at"), "error", F.col("predicted_hours").isNull().alias("unpredicted")
    )


@query
def model_reload(spark, sf_dir):
    """Rows whose score a reloaded model changes; both scores are written first."""
    model = _merge_model(spark, sf_dir)
    path = scratch_path(spark, "model")
    models.save(model, path)
    prs = fixtures.pull_requests(spark, sf_dir)
    hours = F.col("predicted_hours")
    fresh = materialize(scoring.score_prs(prs, model).select(*_KEY, hours.alias("fresh")), "fresh-scores")
    again = materialize(scoring.score_prs(prs, models.load(spark, path)).select(*_KEY, hours), "reloaded-scores")
    both = again.join(fresh, list(_KEY))
    same = hours.eqNullSafe(F.col("fresh"))
    return both.agg(F.count("*").alias("prs"), F.count_if(~same).alias("changed"))


@query
def model_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "model")
    models.save(_merge_model(spark, sf_dir), path)
    return scoring.score_prs(fixtures.pull_requests(spark, sf_dir), models.load(spark, path))


@query
def feature_importance(spark, sf_dir):
    return _merge_model(spark, sf_dir).importance(spark, 20)


def _report_rows(spark: SparkSession, named: dict[str, models.Fitted], errors: dict[str, str], k: int) -> DataFrame:
    """Sizes, metrics and top features as long rows."""
    rows = []
    for target, model in named.items():
        numbers = {**model.sizes, **model.metrics}
        rows += [(target, "metric", n, None if v is None else float(v), None) for n, v in numbers.items()]
        top = zip(model.features, model.model.featureImportances.toArray().tolist())
        ranked = sorted(top, key=lambda p: (-p[1], p[0]))[:k]
        rows += [(target, "importance", n, float(v), None) for n, v in ranked]
    rows += [(target, "error", "error", None, text) for target, text in errors.items()]
    return spark.createDataFrame(
        rows, "target string, section string, name string, value double, error string"
    )


@query
def train_report(spark, sf_dir):
    return _report_rows(spark, {"merge_time": _merge_model(spark, sf_dir)}, {}, 20)


@query
def train_sizes(spark, sf_dir):
    """Rows, training rows and test rows of the merge-time model."""
    sizes = _merge_model(spark, sf_dir).sizes
    return spark.createDataFrame([sizes], "data_points long, training_size long, test_size long")


@query
def ci_train_report(spark, sf_dir):
    fitted, errors = _ci_models(spark, sf_dir)
    return _report_rows(spark, fitted, errors, 15)


def _ci_clean_models(spark: SparkSession, sf_dir: str) -> tuple[dict[str, models.Fitted], dict[str, str]]:
    return once(
        spark,
        sf_dir,
        "ci-clean",
        lambda: models.fit_ci(_rollup(spark, sf_dir), _CI_FOREST, min_rows=10, exclude_leaky=True),
    )


@query
def ci_leakage_report(spark, sf_dir):
    """The CI models' metrics with the columns their labels come from and without them,
    side by side, with the number of features of each."""
    leaky, _ = _ci_models(spark, sf_dir)
    clean, _ = _ci_clean_models(spark, sf_dir)
    rows = []
    for target in models.CI_TARGETS:
        a, b = leaky.get(target), clean.get(target)
        names = sorted({*(a.metrics if a else {}), *(b.metrics if b else {})})
        for name in names:
            value = [None if m is None or m.metrics.get(name) is None else float(m.metrics[name]) for m in (a, b)]
            rows.append((target, name, *value))
        rows.append((target, "features", *[None if m is None else float(len(m.features)) for m in (a, b)]))
    return spark.createDataFrame(rows, "target string, metric string, with_leaks double, without_leaks double")


@query
def ci_batch_scores(spark, sf_dir):
    fitted, _ = _ci_models(spark, sf_dir)
    return scoring.score_ci(_rollup(spark, sf_dir), fitted)


def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    prs = fixtures.pull_requests(spark, sf_dir)
    with_runs = ci.prs_with_ci(prs, fixtures.ci_runs(spark, sf_dir), PR_ID)
    fitted, _ = _ci_models(spark, sf_dir)
    return scoring.combine(
        scoring.score_prs(with_runs, _merge_model(spark, sf_dir)),
        scoring.score_ci(_rollup(spark, sf_dir), fitted),
    )


@query
def combined_analysis(spark, sf_dir):
    return _combined(spark, sf_dir)


@query
def combined_keys(spark, sf_dir):
    """What is certain of ``combined_analysis``, which is written first."""
    out = materialize(_combined(spark, sf_dir), "combined")
    return out.select(*_KEY, "error", F.col("predicted_hours").isNull().alias("unpredicted"))


@query
def combined_json(spark, sf_dir):
    combined = _combined(spark, sf_dir)
    path = scratch_path(spark, "combined")
    documents.write_json(combined, path)
    return spark.read.schema(combined.schema).json(path)


def _json_round_trip(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(spark, name)
    documents.write_json(df, path)
    return spark.read.schema(df.schema).json(path)


@query
def ci_prediction_json(spark, sf_dir):
    """The CI prediction summary saved as JSON lines and read back, as the predict command saves it."""
    out = scoring.summarize_ci(scoring.shape_ci(_rule_predictions(spark, sf_dir)))
    summary = out.select(
        *_KEY, "estimated_completion_time", "expected_attempts", "retry_risk", "overall_success_likelihood", "recommendation"
    )
    return _json_round_trip(spark, summary, "ci-predictions")


@query
def ci_train_json(spark, sf_dir):
    """The CI training report (metrics, sizes, top features, errors) saved as JSON lines and read back."""
    fitted, errors = _ci_models(spark, sf_dir)
    return _json_round_trip(spark, _report_rows(spark, fitted, errors, 15), "ci-train-report")


@query
def model_summary(spark, sf_dir):
    fitted, _ = _ci_models(spark, sf_dir)
    path = scratch_path(spark, "ci-model")
    models.save_ci(fitted, path)
    return models.registry(spark, [f"{path}_{target}" for target in fitted])


def _vectors(spark: SparkSession, sf_dir: str, folds: int = 5) -> DataFrame:
    """Scaled training vectors with a fold number."""

    def make() -> DataFrame:
        rows = models.pr_table(features.training_rows(fixtures.pull_requests(spark, sf_dir)), None)
        return models.fold_table(rows, list(features.PR_STRUCTURAL), folds=folds)

    return once(spark, sf_dir, f"vectors-{folds}", make)


@query
def grid_search(spark, sf_dir):
    estimator = models.regressor(models.ModelConfig(rounds=5, depth=5), mllib=True)
    grid = (
        models.ParamGridBuilder()
        .addGrid(estimator.maxDepth, [3, 5])
        .addGrid(estimator.minInstancesPerNode, [1, 4])
        .build()
    )
    found = models.tuned(_vectors(spark, sf_dir, folds=3), estimator, grid, folds=3)
    return models.grid_report(spark, grid, found)


@query
def cv_mae(spark, sf_dir):
    maes = models.cross_validate(
        _vectors(spark, sf_dir), models.regressor(models.ModelConfig(rounds=10, depth=5), mllib=True)
    )
    return models.cv_report(spark, maes)


# --- boosting from histograms ------------------------------------------------

#: Line features of few distinct values, so each value is a bin of its own.
LINE_FEATURES = ("l_quantity", "l_discount", "l_tax", "l_linenumber")


def _first_tree(spark: SparkSession, sf_dir: str, config: histboost.BoostConfig) -> tuple[histboost.BoostedModel, DataFrame]:
    lines = fixtures.table(spark, sf_dir, "lineitem").select(
        (F.col("l_extendedprice").cast("double") / 1000).alias("label"), *[F.col(c).cast("double") for c in LINE_FEATURES]
    )
    rows = VectorAssembler(inputCols=list(LINE_FEATURES), outputCol="features").transform(lines).select("label", "features")
    model = histboost.HistBooster(config).fit(rows)
    return model, model.nodes(spark)


@query
def boost_first_split(spark, sf_dir):
    """Root split and leaf weights of the first second-order tree on line prices (all rows)."""
    config = histboost.BoostConfig(rounds=1, depth=1, min_leaf=20, min_child_weight=1.0, l2=1.0)
    model, nodes = _first_tree(spark, sf_dir, config)
    names = F.element_at(F.array(*[F.lit(c) for c in LINE_FEATURES]), F.col("feature") + 1)
    edges = F.array(*[F.array(*[F.lit(float(e)) for e in fe]).cast("array<double>") for fe in model.edges])
    threshold = F.element_at(F.element_at(edges, F.col("feature") + 1), F.col("bin") + 1)
    split = F.col("feature").isNotNull()
    return nodes.select(
        "node",
        F.when(split, names).alias("feature"),
        F.when(split, threshold).alias("threshold"),
        F.when(split, F.format_string("%.8e", "gain")).alias("gain"),
        "n_rows",
        r6("weight"),
    )


@query
def boost_importance(spark, sf_dir):
    """Importance of every feature of the leaf-limited merge-time booster, by split count
    and by gain, from its node table."""
    fitted = _merge_model(spark, sf_dir, _LEAFWISE)
    return histboost.importances(fitted.model.nodes(spark), fitted.features)


@query
def leafwise_tree_shapes(spark, sf_dir):
    """Leaves and depth of every tree of the leaf-limited merge-time booster."""
    model = _merge_model(spark, sf_dir, _LEAFWISE).model
    nodes = model.nodes(spark).where(F.col("feature").isNull())
    return nodes.groupBy("tree").agg(
        F.count("*").alias("n_leaves"), F.max(F.floor(F.log2("node"))).cast("int").alias("depth"), F.sum("n_rows").alias("n_rows")
    )


@query
def fold_assignment(spark, sf_dir):
    """Position and contiguous fold (of 5) of every training pull request in key order."""
    rows = features.training_rows(fixtures.pull_requests(spark, sf_dir)).select(*_KEY)
    return folds.contiguous_folds(rows, list(_KEY), 5)
