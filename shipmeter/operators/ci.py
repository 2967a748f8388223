"""CI runs: cleaning, deduplication, job durations, rollups and summaries.

The rollup never groups rows of one pull request directly.  It counts per test
name first and then folds those counts, and both steps combine on the map side,
so a pull request with very many runs does not become one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shipmeter import KEYS
from shipmeter.functions import times
from shipmeter.functions.hashing import ci_run_text, hex_word
from shipmeter.functions.urls import RUN_PREFIX, is_ci_run_url, job_url
from shipmeter.operators.folds import positions
from shipmeter.operators.quantiles import upper_median
from shipmeter.schemas import JOB_DOCUMENT

FAILED_STATES = ("failure", "error")
MAX_DURATION_SECONDS = 86_400

#: Flag and the words one of which a test name must contain.
KIND_WORDS = {
    "ci_has_build": ("build",),
    "ci_has_test": ("test",),
    "ci_has_lint": ("lint", "style", "format"),
    "ci_has_deploy": ("deploy",),
}

DURATION_COLUMNS = ("ci_total_duration", "ci_avg_duration", "ci_max_duration", "ci_min_duration")
OUTCOME_COLUMNS = (
    "ci_total_runs",
    "ci_unique_tests",
    "ci_successful_runs",
    "ci_failed_runs",
    "ci_success_rate",
)
RETRY_COLUMNS = ("ci_avg_retries", "ci_max_retries")


# --- cleaning ---------------------------------------------------------------


def clean_statuses(statuses: DataFrame, prefix: str = RUN_PREFIX) -> DataFrame:
    """Statuses of the CI system; a status without such a URL is dropped."""
    return statuses.where(is_ci_run_url(F.col("target_url"), prefix))


def first_per_url(statuses: DataFrame, keys=KEYS) -> DataFrame:
    """The first status per target URL within a pull request, in listing order.

    An aggregate, not a window: it combines before the shuffle.
    """
    keys = list(keys)
    rest = [c for c in statuses.columns if c not in (*keys, "target_url")]
    first = F.min_by(F.struct(*rest), F.col("ordinal")).alias("_row")
    return statuses.groupBy(*keys, "target_url").agg(first).select(*keys, "target_url", "_row.*")


def latest_commits(commits: DataFrame, keys=KEYS) -> DataFrame:
    return commits.groupBy(*keys).agg(F.max_by("sha", "ordinal").alias("sha"))


def latest_commit_statuses(commits: DataFrame, statuses: DataFrame, keys=KEYS) -> DataFrame:
    return latest_commits(commits, keys).join(statuses, "sha")


def document_durations(documents: DataFrame) -> DataFrame:
    """``url`` to seconds.  Of several landings of one address the last counts;
    a duration of 0 or less, or of a day or more, is not believed."""
    status = F.from_json("doc", JOB_DOCUMENT)["status"]
    seconds = times.seconds_between(
        times.iso_instant(status["startTime"]), times.iso_instant(status["completionTime"])
    )
    sane = F.when((seconds > 0) & (seconds < MAX_DURATION_SECONDS), seconds)
    # A null must still replace an older number, so the value travels in a struct.
    return (
        documents.select("url", "landed", F.struct(sane.alias("seconds")).alias("_d"))
        .groupBy("url")
        .agg(F.max_by("_d", "landed").alias("_d"))
        .select("url", F.col("_d.seconds").alias("ci_duration_seconds"))
    )


def with_durations(statuses: DataFrame, documents: DataFrame) -> DataFrame:
    """Statuses with the duration of their job document, null where there is none."""
    keyed = statuses.withColumn("url", job_url(F.col("target_url")))
    return keyed.join(document_durations(documents), "url", "left")


def run_record(statuses: DataFrame, keys=KEYS) -> DataFrame:
    return statuses.select(
        *keys,
        "ordinal",
        F.col("context").alias("ci_name"),
        F.col("target_url").alias("ci_target_url"),
        F.col("state").alias("ci_state"),
        "ci_duration_seconds",
    )


def collect_runs(
    commits: DataFrame, statuses: DataFrame, documents: DataFrame, keys=KEYS, prefix: str = RUN_PREFIX
) -> DataFrame:
    """CI runs of each pull request's latest commit, as they are stored."""
    latest = latest_commit_statuses(commits, clean_statuses(statuses, prefix), keys)
    runs = first_per_url(latest.drop("sha"), keys)
    return run_record(with_durations(runs, documents), keys)


def prs_with_ci(prs: DataFrame, runs: DataFrame, keys=KEYS) -> DataFrame:
    return prs.join(runs.select(*keys).distinct(), list(keys), "left_semi")


# --- nesting ----------------------------------------------------------------


def ci_parts(runs: DataFrame, keys=KEYS, part_span: int = 1000) -> DataFrame:
    """Runs as arrays, in parts of ``part_span`` runs in order, whatever their ordinals.

    A run's place within its pull request comes from its position in the whole table
    (key ranges, counts per range, offsets) less the position of the PR's first run,
    so no PR's runs are gathered to be numbered, however many it has.
    """
    keys = list(keys)
    order = ["ordinal", "ci_name", "ci_target_url", "ci_state", "ci_duration_seconds"]
    fields = F.struct(*order)
    placed = positions(runs.select(*keys, *order), [*keys, *order])
    first = placed.groupBy(*keys).agg(F.min("position").alias("_first"))
    part = F.floor((F.col("position") - F.col("_first")) / F.lit(part_span)).cast("long")
    ordered = F.sort_array(F.collect_list(fields))
    return (
        placed.join(first, keys)
        .groupBy(*keys, part.alias("part"))
        .agg(ordered.alias("_runs"))
        .select(
            *keys,
            "part",
            F.transform(
                "_runs",
                lambda r: F.struct(
                    r["ci_name"].alias("ci_name"),
                    r["ci_target_url"].alias("ci_target_url"),
                    r["ci_state"].alias("ci_state"),
                    r["ci_duration_seconds"].alias("ci_duration_seconds"),
                ),
            ).alias("ci_data"),
        )
    )


def nest_ci(prs: DataFrame, runs: DataFrame, keys=KEYS, part_span: int = 1000) -> DataFrame:
    """Pull requests with their runs embedded, one row per part of runs.

    Equal to a full join: a PR without runs keeps a null array, and runs whose PR
    has no record keep a row with the key alone.  Written as a left join from the
    parts, which can be split when one PR has very many, and an anti join.
    """
    keys = list(keys)
    embedded = ci_parts(runs, keys, part_span).join(prs, keys, "left")
    alone = prs.join(runs.select(*keys).distinct(), keys, "left_anti")
    return embedded.unionByName(alone, allowMissingColumns=True)


def explode_ci(documents: DataFrame, keys=KEYS) -> DataFrame:
    """All CI runs embedded in stored documents, flat."""
    return documents.select(*keys, F.explode("ci_data").alias("_run")).select(*keys, "_run.*")


def ci_digest(runs: DataFrame, keys=KEYS) -> DataFrame:
    """A digest of the set of runs of a pull request that does not depend on order."""
    word = hex_word(ci_run_text(), 12).cast("decimal(38,0)")
    return runs.groupBy(*keys).agg(
        F.concat_ws(":", F.count("*").cast("string"), F.sum(word).cast("string")).alias("ci_digest"),
        F.count("*").alias("ci_run_count"),
    )


# --- per-PR rollup ----------------------------------------------------------


def _per_test(runs: DataFrame, keys) -> DataFrame:
    """One row per pull request and test name; the only step that sees every run."""
    seconds = F.col("ci_duration_seconds")
    return runs.groupBy(*keys, F.coalesce("ci_name", F.lit("")).alias("ci_name")).agg(
        F.count("*").alias("_runs"),
        F.sum(seconds).alias("_sum"),
        F.count(seconds).alias("_timed"),
        F.max(seconds).alias("_max"),
        F.min(seconds).alias("_min"),
        F.count_if(F.col("ci_state") == "success").alias("_ok"),
        F.count_if(F.col("ci_state").isin(*FAILED_STATES)).alias("_failed"),
    )


def _contains_any(name: Column, words: tuple[str, ...]) -> Column:
    found = F.contains(name, F.lit(words[0]))
    for word in words[1:]:
        found = found | F.contains(name, F.lit(word))
    return found


def rollup_runs(runs: DataFrame, keys=KEYS) -> DataFrame:
    """Durations, outcomes, retries and kinds of check, one row per pull request."""
    name = F.lower("ci_name")
    total = F.sum("_runs")
    zero = F.lit(0.0)
    return (
        _per_test(runs, keys)
        .groupBy(*keys)
        .agg(
            F.coalesce(F.sum("_sum"), zero).alias("ci_total_duration"),
            F.coalesce(F.try_divide(F.sum("_sum"), F.sum("_timed")), zero).alias("ci_avg_duration"),
            F.coalesce(F.max("_max"), zero).alias("ci_max_duration"),
            F.coalesce(F.min("_min"), zero).alias("ci_min_duration"),
            total.alias("ci_total_runs"),
            F.count("*").alias("ci_unique_tests"),
            F.sum("_ok").alias("ci_successful_runs"),
            F.sum("_failed").alias("ci_failed_runs"),
            (F.sum("_ok") / total).alias("ci_success_rate"),
            F.avg("_runs").alias("ci_avg_retries"),
            F.max("_runs").alias("ci_max_retries"),
            *[F.bool_or(_contains_any(name, words)).alias(flag) for flag, words in KIND_WORDS.items()],
        )
    )


def ci_rollup(runs: DataFrame, prs: DataFrame, keys=KEYS) -> DataFrame:
    """The rollup with the PR columns the CI models use; only PRs with runs."""
    carried = prs.select(
        *keys,
        *[c for c in KEYS if c not in keys],
        F.col("title").alias("pr_title"),
        F.col("files_changed").alias("pr_files_changed"),
        F.col("additions").alias("pr_additions"),
        F.col("deletions").alias("pr_deletions"),
        F.col("commit_count").alias("pr_commits"),
        F.coalesce("is_draft", F.lit(False)).alias("pr_is_draft"),
    )
    return carried.join(rollup_runs(runs, keys), list(keys))


def rollup_nested(documents: DataFrame, keys=KEYS) -> DataFrame:
    """Counts and flags read off the embedded arrays, folded over the parts of a PR."""

    def states(*wanted: str) -> Column:
        return F.size(F.filter("ci_data", lambda r: r["ci_state"].isin(*wanted)))

    def named(words: tuple[str, ...]) -> Column:
        return F.exists(
            "ci_data", lambda r: _contains_any(F.lower(F.coalesce(r["ci_name"], F.lit(""))), words)
        )

    return (
        documents.where(F.size("ci_data") > 0)
        .select(
            *keys,
            F.size("ci_data").alias("_n"),
            states("success").alias("_ok"),
            states(*FAILED_STATES).alias("_failed"),
            *[named(words).alias(flag) for flag, words in KIND_WORDS.items()],
        )
        .groupBy(*keys)
        .agg(
            F.sum("_n").alias("ci_total_runs"),
            F.sum("_ok").alias("ci_successful_runs"),
            F.sum("_failed").alias("ci_failed_runs"),
            *[F.bool_or(flag).alias(flag) for flag in KIND_WORDS],
        )
    )


# --- summaries --------------------------------------------------------------


def ci_summary(runs: DataFrame, by=("repository",), pr_key: str = "pr_number") -> DataFrame:
    """Runs, rates over runs that have a state, and durations, one row per group."""
    by = list(by)
    state, seconds = F.col("ci_state"), F.col("ci_duration_seconds")
    known = F.count_if(state.isNotNull() & (state != ""))
    sums = runs.groupBy(*by).agg(
        F.count("*").alias("total_ci_runs"),
        F.count_distinct(pr_key).alias("unique_prs"),
        F.count_distinct(F.coalesce("ci_name", F.lit(""))).alias("unique_ci_tests"),
        F.try_divide(F.count_if(state == "success"), known).alias("success_rate"),
        F.try_divide(F.count_if(state.isin(*FAILED_STATES)), known).alias("failure_rate"),
        F.avg(seconds).alias("avg_duration_seconds"),
        F.max(seconds).alias("max_duration_seconds"),
        F.min(seconds).alias("min_duration_seconds"),
    )
    medians = upper_median(runs, "ci_duration_seconds", "median_duration_seconds", by)
    return sums.join(medians, by, "left")


def state_distribution(runs: DataFrame, by=("repository",)) -> DataFrame:
    known = runs.where(F.col("ci_state").isNotNull() & (F.col("ci_state") != ""))
    return known.groupBy(*by, "ci_state").agg(F.count("*").alias("runs"))


def top_tests(runs: DataFrame, k: int = 10) -> DataFrame:
    named = runs.where(F.col("ci_name").isNotNull() & (F.col("ci_name") != ""))
    return (
        named.groupBy("ci_name")
        .agg(F.count("*").alias("runs"))
        .orderBy(F.desc("runs"), "ci_name")
        .limit(k)
    )


def top_tests_by(runs: DataFrame, by=("repository",), k: int = 10) -> DataFrame:
    """The same per group; ``row_number() <= k`` is cut before the shuffle."""
    named = runs.where(F.col("ci_name").isNotNull() & (F.col("ci_name") != ""))
    counts = named.groupBy(*by, "ci_name").agg(F.count("*").alias("runs"))
    place = Window.partitionBy(*by).orderBy(F.desc("runs"), "ci_name")
    return counts.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
