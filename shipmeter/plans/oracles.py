"""The same results in plain SQL, for an engine that shares no code with Spark.

Each oracle names the views it builds on; views are written out once below.
"""

from __future__ import annotations

from typing import NamedTuple

# A test holds the stop words against Spark's own list.
from shipmeter.operators.textfeatures import ENGLISH_STOP_WORDS as _STOP_WORDS

# What the queries take from constants is written out here again, so that a wrong
# constant shows as a difference.
RUN_PREFIX = "https://prow.ci.openshift.org/view/gs"
VIEW_PREFIX = "https://prow.ci.openshift.org/view/gs/"
DOCUMENT_BASE = "https://gcsweb-ci.apps.ci.l2s4.p1.openshiftapps.com/gcs"
DOCUMENT_NAME = "prowjob.json"
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
PR_STRUCTURAL = """
    review_count comment_count commit_count files_changed additions deletions created_hour
    created_day is_draft lines_changed addition_ratio files_per_addition reviews_per_commit
    comments_per_commit is_business_hours is_weekend
""".split()
CI_STRUCTURAL = """
    pr_files_changed pr_additions pr_deletions pr_commits pr_is_draft ci_total_duration
    ci_avg_duration ci_max_duration ci_min_duration ci_total_runs ci_unique_tests
    ci_successful_runs ci_failed_runs ci_success_rate ci_avg_retries ci_max_retries
    ci_has_build ci_has_test ci_has_lint ci_has_deploy ci_run_per_test_ratio
    ci_duration_per_file
""".split()


class TextConfig(NamedTuple):
    max_features: int
    min_df: int
    max_df: float
    weight: float
    prefix: str


PR_TEXT = TextConfig(50, 2, 0.8, 0.3, "tfidf_")
CI_TEXT = TextConfig(30, 1, 0.9, 0.2, "ci_tfidf_")

_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}
ORACLES: dict[str, str] = {}


def _view(name: str, needs: str, body: str) -> None:
    _VIEWS[name] = (tuple(needs.split()), body)


def _oracle(name: str, needs: str, body: str) -> None:
    order: list[str] = []

    def visit(view: str) -> None:
        for need in _VIEWS[view][0]:
            visit(need)
        if view not in order:
            order.append(view)

    for need in needs.split():
        visit(need)
    views = ",\n".join(f"{v} AS ({_VIEWS[v][1]})" for v in order)
    ORACLES[name] = (f"WITH {views}\n" if order else "") + body


def r6(expression: str, name: str | None = None) -> str:
    """Six places; adding 0 turns a negative zero into zero."""
    return f"round({expression}, 6) + 0.0 AS {name or expression}"


def iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {column}"


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# --- views of the given tables ----------------------------------------------

_view(
    "pr_times",
    "",
    """
    SELECT *, created_at + to_hours(pr_number % 97) AS updated_at FROM (
      SELECT o_orderkey AS pr_number, o_custkey,
        CASE WHEN o_orderstatus = 'P' THEN 'open' ELSE 'closed' END AS state,
        o_orderpriority = '5-LOW' AS draft, o_orderpriority,
        o_orderdate + to_hours(o_custkey % 24) AS created_at,
        CASE WHEN o_orderstatus <> 'P'
          THEN o_orderdate + to_minutes(CAST(floor(o_totalprice / 8) AS BIGINT)) END AS merged_at
      FROM orders)""",
)
_view(
    "authors",
    "",
    """
    SELECT c_custkey AS o_custkey, 'org/' || lower(c_mktsegment) AS repository,
      CASE WHEN c_custkey % 37 = 5 THEN NULL
           WHEN c_custkey % 10 = 0 THEN 'dependabot[bot]'
           WHEN c_custkey % 10 = 1 THEN 'Robot-' || c_name ELSE c_name END AS author_login,
      CASE WHEN c_custkey % 37 = 5 THEN NULL
           WHEN c_custkey % 50 = 7 THEN 'Bot' ELSE 'User' END AS author_type,
      CASE WHEN c_nationkey % 3 = 0 THEN 'MEMBER'
           WHEN c_nationkey % 3 = 1 THEN 'CONTRIBUTOR' END AS author_association
    FROM customer""",
)
_view(
    "repos",
    "authors",
    "SELECT o_orderkey AS pr_number, repository FROM orders JOIN authors USING (o_custkey)",
)
_view(
    "listing",
    "pr_times authors",
    """SELECT pr_times.*, repository, author_login, author_type, author_association,
         merged_at IS NOT NULL AS merged
       FROM pr_times JOIN authors USING (o_custkey)""",
)
_view(
    "contents",
    "",
    """
    SELECT pr_number, changed_files, additions, deletions, review_count, comment_count,
      commit_count, p_name AS title, p_type
    FROM (
      SELECT l_orderkey AS pr_number, count(*) AS changed_files,
        CAST(sum(l_quantity) AS BIGINT) AS additions,
        CAST(sum(floor(l_quantity * l_discount * 10)) AS BIGINT) AS deletions,
        min(l_partkey) AS p_partkey,
        count(*) FILTER (WHERE l_returnflag = 'R') AS review_count,
        count(*) FILTER (WHERE l_returnflag = 'A') AS comment_count,
        count(DISTINCT l_suppkey) AS commit_count
      FROM lineitem GROUP BY ALL)
    LEFT JOIN part USING (p_partkey)""",
)
_view(
    "prs",
    "listing contents",
    """
    SELECT repository, pr_number, title, concat_ws(' ', p_type, o_orderpriority) AS body,
      review_count, comment_count, commit_count, changed_files AS files_changed, additions,
      deletions, CAST(hour(created_at) AS INTEGER) AS created_hour,
      CAST(isodow(created_at) - 1 AS INTEGER) AS created_day,
      coalesce(author_association, 'NONE') AS author_association, draft AS is_draft,
      created_at, merged_at,
      CASE WHEN merged_at IS NOT NULL THEN
        greatest(0.0, (epoch_us(merged_at) - epoch_us(created_at)) / 3.6e9) END AS merge_time_hours,
      state AS pr_state
    FROM listing LEFT JOIN contents USING (pr_number)""",
)
_view(
    "statuses",
    "",
    f"""
    SELECT user_id AS pr_number, event_id AS ordinal, value, ts,
      CASE event_type WHEN 'signup' THEN 'build' WHEN 'click' THEN 'unit-test'
        WHEN 'view' THEN 'lint' WHEN 'purchase' THEN 'deploy' WHEN 'error' THEN 'e2e-test' END
        AS context,
      CASE WHEN event_id % 11 = 0 THEN NULL
        WHEN event_id % 13 = 0 THEN 'https://ci.example.org/' || path
        ELSE '{VIEW_PREFIX}' || path END AS target_url,
      CASE WHEN value < 60 THEN 'success' WHEN value < 90 THEN 'failure'
        WHEN value < 120 THEN 'error' ELSE 'pending' END AS state
    FROM (SELECT *, 'b/' || user_id || '/' || event_type || '/' ||
            regexp_extract(props, '[0-9]+') AS path FROM events)""",
)
_view(
    "runs",
    "statuses",
    """SELECT pr_number, ordinal, context AS ci_name, target_url AS ci_target_url,
         state AS ci_state,
         CASE WHEN ordinal % 7 <> 0 THEN value * 60 END AS ci_duration_seconds
       FROM statuses""",
)
_view("runs_repo", "runs repos", "SELECT runs.*, repository FROM runs JOIN repos USING (pr_number)")
_view(
    "commit_ends",
    "",
    "SELECT l_orderkey AS pr_number, min(l_suppkey) AS first, max(l_suppkey) AS last "
    "FROM lineitem GROUP BY ALL",
)
_view(
    "commit_statuses",
    "statuses commit_ends",
    """SELECT md5(pr_number || '-' || CASE WHEN ordinal % 3 = 0 THEN first ELSE last END) AS sha,
         ordinal, context, target_url, state
       FROM statuses JOIN commit_ends USING (pr_number)""",
)
_view(
    "latest_statuses",
    "commit_statuses commit_ends",
    """SELECT pr_number, s.sha, ordinal, context, target_url, state
       FROM (SELECT pr_number, md5(pr_number || '-' || last) AS sha FROM commit_ends) c
       JOIN commit_statuses s ON s.sha = c.sha""",
)
_view(
    "timeline_prs",
    "",
    """SELECT user_id AS pr_number, min(ts) AS created_at,
         CASE WHEN user_id % 4 <> 0 THEN max(ts) END AS merged_at, user_id % 3 = 0 AS is_draft
       FROM events GROUP BY user_id""",
)
_view(
    "timeline_events",
    "",
    """SELECT user_id AS pr_number, event_id, ts AS happened,
         CASE event_type WHEN 'signup' THEN 'R' ELSE 'D' END AS kind
       FROM events WHERE event_type IN ('signup', 'error')""",
)
_view(
    "order_prs",
    "pr_times",
    "SELECT pr_number, created_at, merged_at, draft AS is_draft FROM pr_times",
)
_view(
    "order_events",
    "pr_times",
    """SELECT pr_number, event_id, created_at + to_hours(event_id) AS happened, flag AS kind FROM (
         SELECT l_orderkey AS pr_number, l_partkey % 1000 AS event_id,
           CASE max(l_returnflag) WHEN 'R' THEN 'R' WHEN 'A' THEN 'D' END AS flag
         FROM lineitem GROUP BY 1, 2)
       JOIN pr_times USING (pr_number) WHERE flag IS NOT NULL""",
)


def _drafts(name: str, prs: str, events: str) -> None:
    """Draft hours in two lags: drop events that repeat the state, then pair the rest."""
    _view(
        name,
        f"{prs} {events}",
        f"""
        SELECT p.pr_number,
          CASE WHEN p.is_draft OR coalesce(any_ready, false) THEN
            (coalesce(closed, 0) + CASE
               WHEN coalesce(state, 'D') = 'D' AND p.merged_at IS NOT NULL
               THEN epoch_us(p.merged_at) - coalesce(opened, epoch_us(p.created_at))
               ELSE 0 END) / 3.6e9
          ELSE 0.0 END AS draft_time_hours
        FROM {prs} p LEFT JOIN (
          SELECT pr_number, sum(us - start) FILTER (WHERE kind = 'R') AS closed,
            arg_max(kind, row(happened, event_id)) AS state,
            max(us) FILTER (WHERE kind = 'D') AS opened,
            bool_or(kind = 'R') AS any_ready
          FROM (
            SELECT c.*, epoch_us(happened) AS us,
              coalesce(epoch_us(lag(happened) OVER w), epoch_us(created_at)) AS start
            FROM (
              SELECT *, lag(kind, 1, 'D') OVER (PARTITION BY pr_number ORDER BY happened, event_id)
                AS before FROM {events}) c
            JOIN {prs} USING (pr_number)
            WHERE kind <> before
            WINDOW w AS (PARTITION BY pr_number ORDER BY happened, event_id))
          GROUP BY pr_number) e USING (pr_number)""",
    )


_drafts("timeline_drafts", "timeline_prs", "timeline_events")
_drafts("order_drafts", "order_prs", "order_events")

_KINDS = {
    "ci_has_build": ("build",),
    "ci_has_test": ("test",),
    "ci_has_lint": ("lint", "style", "format"),
    "ci_has_deploy": ("deploy",),
}
_FLAGS = ", ".join(
    "bool_or(" + " OR ".join(f"contains(lower(ci_name), '{w}')" for w in words) + f") AS {flag}"
    for flag, words in _KINDS.items()
)
_view(
    "rolled",
    "runs",
    f"""
    SELECT pr_number,
      coalesce(sum(ci_duration_seconds), 0.0) AS ci_total_duration,
      coalesce(avg(ci_duration_seconds), 0.0) AS ci_avg_duration,
      coalesce(max(ci_duration_seconds), 0.0) AS ci_max_duration,
      coalesce(min(ci_duration_seconds), 0.0) AS ci_min_duration,
      count(*) AS ci_total_runs,
      count(DISTINCT coalesce(ci_name, '')) AS ci_unique_tests,
      count(*) FILTER (WHERE ci_state = 'success') AS ci_successful_runs,
      count(*) FILTER (WHERE ci_state IN ('failure', 'error')) AS ci_failed_runs,
      count(*) FILTER (WHERE ci_state = 'success') / count(*) AS ci_success_rate,
      {_FLAGS}
    FROM runs GROUP BY pr_number""",
)
_view(
    "retries",
    "runs",
    """SELECT pr_number, avg(n) AS ci_avg_retries, max(n) AS ci_max_retries FROM (
         SELECT pr_number, coalesce(ci_name, '') AS ci_name, count(*) AS n FROM runs GROUP BY 1, 2)
       GROUP BY pr_number""",
)
_view(
    "rollup_rows",
    "rolled retries prs",
    """
    SELECT r.*, t.ci_avg_retries, t.ci_max_retries, p.repository, p.title AS pr_title,
      p.files_changed AS pr_files_changed, p.additions AS pr_additions,
      p.deletions AS pr_deletions, p.commit_count AS pr_commits, p.is_draft AS pr_is_draft
    FROM rolled r JOIN retries t USING (pr_number) JOIN prs p USING (pr_number)""",
)
_view(
    "features_raw",
    "prs",
    """
    SELECT repository, pr_number,
      CAST(coalesce(review_count, 0) AS DOUBLE) AS review_count,
      CAST(coalesce(comment_count, 0) AS DOUBLE) AS comment_count,
      CAST(coalesce(commit_count, 0) AS DOUBLE) AS commit_count,
      CAST(coalesce(files_changed, 0) AS DOUBLE) AS files_changed,
      CAST(coalesce(additions, 0) AS DOUBLE) AS additions,
      CAST(coalesce(deletions, 0) AS DOUBLE) AS deletions,
      CAST(created_hour AS DOUBLE) AS created_hour, CAST(created_day AS DOUBLE) AS created_day,
      CAST(CAST(is_draft AS INTEGER) AS DOUBLE) AS is_draft,
      CAST(p.additions + p.deletions AS DOUBLE) AS lines_changed,
      p.additions / (p.additions + p.deletions + 1) AS addition_ratio,
      p.files_changed / (p.additions + 1) AS files_per_addition,
      p.review_count / (p.commit_count + 1) AS reviews_per_commit,
      p.comment_count / (p.commit_count + 1) AS comments_per_commit,
      CASE WHEN created_hour BETWEEN 9 AND 17 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_business_hours,
      CASE WHEN created_day IN (5, 6) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_weekend
    FROM prs p""",
)
_view(
    "features",
    "features_raw",
    "SELECT repository, pr_number, "
    + ", ".join(f"coalesce({c}, 0.0::DOUBLE) AS {c}" for c in PR_STRUCTURAL)
    + " FROM features_raw",
)


def _bucket(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT % 100 < 20"


_view(
    "split",
    "repos",
    f"SELECT repository, pr_number, {_bucket(chr(39).join(['repository || ', '#', ' || pr_number']))} AS is_test FROM repos",
)

_TOKEN = r"'[\p{L}\p{N}_]{2,}'"


def _text_views(prefix: str, source: str, needs: str, key: str, text: str) -> None:
    """Tokens, words without stop words and n-grams of a text column, in order."""
    _view(
        f"{prefix}_tokens",
        needs,
        f"""SELECT {key}, unnest(l) AS token, generate_subscripts(l, 1) AS pos FROM (
              SELECT {key}, regexp_extract_all(lower(coalesce({text}, '')), {_TOKEN}) AS l
              FROM {source})""",
    )
    _view(
        f"{prefix}_words",
        f"{prefix}_tokens",
        f"""SELECT {key}, token, row_number() OVER (PARTITION BY {key} ORDER BY pos) AS pos
            FROM {prefix}_tokens WHERE token NOT IN ({_quoted(_STOP_WORDS)})""",
    )
    _view(
        f"{prefix}_grams",
        f"{prefix}_words",
        f"""SELECT {key}, token AS term, pos, 1 AS kind FROM {prefix}_words
            UNION ALL
            SELECT {key}, token || ' ' || after, pos, 2 FROM (
              SELECT {key}, token, pos,
                lead(token) OVER (PARTITION BY {key} ORDER BY pos) AS after FROM {prefix}_words)
            WHERE after IS NOT NULL""",
    )


def _vocab_views(name: str, grams: str, docs: str, key: str, config: TextConfig, where: str = "") -> None:
    """Vocabulary ``<name>_vocab`` and long TF-IDF ``<name>_tfidf`` over ``grams``.

    ``where`` limits the documents the vocabulary is fitted on.
    """
    _view(f"{name}_n", docs if docs in _VIEWS else "", f"SELECT count(*) AS n FROM {docs} {where}")
    _view(
        f"{name}_vocab",
        f"{grams} {name}_n",
        f"""SELECT term, df, term_count, ln((1 + n) / (1 + df)) + 1 AS idf,
              row_number() OVER (ORDER BY term) - 1 AS position
            FROM (
              SELECT term, count(DISTINCT {key}) AS df, count(*) AS term_count FROM {grams} {where}
              GROUP BY term
              HAVING count(DISTINCT {key}) >= {config.min_df}
                AND count(DISTINCT {key}) <= {config.max_df} * (SELECT n FROM {name}_n)
              ORDER BY term_count DESC, term LIMIT {config.max_features}), {name}_n""",
    )
    _view(
        f"{name}_tfidf",
        f"{grams} {name}_vocab",
        f"""SELECT {key}, term, position, tf,
              w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS tfidf
            FROM (SELECT {key}, term, position, count(*) AS tf, (1 + ln(count(*))) * any_value(idf) AS w
                  FROM {grams} JOIN {name}_vocab USING (term) GROUP BY ALL)""",
    )


_text_views("doc", "documents", "", "doc_id", "text")
_view(
    "pr_texts",
    "prs",
    "SELECT repository, pr_number, "
    "trim(coalesce(title, '') || ' ' || coalesce(body, '')) AS text FROM prs",
)
_text_views("pr", "pr_texts", "pr_texts", "pr_number", "text")
_TRAIN_DOCS = f"WHERE NOT ({_bucket('CAST(doc_id AS VARCHAR)')})"
_vocab_views("doc", "doc_grams", "documents", "doc_id", PR_TEXT)
_vocab_views("train", "doc_grams", "documents", "doc_id", PR_TEXT, _TRAIN_DOCS)
_vocab_views("cidoc", "doc_grams", "documents", "doc_id", CI_TEXT)
_vocab_views("prv", "pr_grams", "prs", "pr_number", PR_TEXT)

# --- sources, sinks, store --------------------------------------------------

_PR_PLAIN = (
    "repository, pr_number, title, body, review_count, comment_count, commit_count, "
    "files_changed, additions, deletions, created_hour, created_day, author_association, is_draft"
)
_view(
    "documents_written",
    "prs runs",
    """SELECT p.*, coalesce(part, -1) AS part, coalesce(n, 0) AS ci_runs FROM prs p LEFT JOIN (
         SELECT pr_number, ordinal // 1000 AS part, count(*) AS n FROM runs GROUP BY 1, 2)
       USING (pr_number)""",
)
_view(
    "prs_read",
    "prs runs",
    """SELECT p.*, coalesce(n, 0) AS ci_runs FROM prs p LEFT JOIN (
         SELECT pr_number, count(*) AS n FROM runs GROUP BY 1) USING (pr_number)
       WHERE pr_number % 97 <> 0""",
)
_oracle(
    "scan_quarantine",
    "documents_written",
    "SELECT repository, count(*) AS documents FROM documents_written WHERE pr_number % 97 = 0 GROUP BY repository",
)
_oracle(
    "scan_prs",
    "prs_read",
    f"SELECT repository, pr_number, title, {iso('created_at')}, {iso('merged_at')}, ci_runs "
    "FROM prs_read",
)
_oracle(
    "scan_ci_runs",
    "runs_repo",
    f"""SELECT repository, pr_number, ci_name, ci_target_url, ci_state,
          {r6('ci_duration_seconds')} FROM runs_repo WHERE pr_number % 97 <> 0""",
)
_oracle(
    "scan_repos",
    "prs_read",
    f"""SELECT repository, pr_number, additions, {r6('merge_time_hours')} FROM prs_read
        WHERE repository IN ('org/machinery', 'org/building')""",
)
_oracle(
    "csv_roundtrip",
    "prs",
    f"SELECT {_PR_PLAIN}, pr_state, {iso('created_at')}, {iso('merged_at')}, "
    f"{r6('merge_time_hours')} FROM prs",
)
_oracle(
    "scan_repo_list",
    "",
    """SELECT 'org/' || lower(c_mktsegment) || '-' || c_custkey AS repository FROM customer
       WHERE c_custkey % 5 IN (0, 4)""",
)
_oracle(
    "pr_listing",
    "listing",
    f"SELECT repository, pr_number, state, {iso('updated_at')} FROM listing WHERE state = 'closed'",
)
_oracle(
    "union_repos",
    "prs",
    """SELECT repository, pr_number, title, CASE WHEN repository >= 'org/f' THEN body END AS body
       FROM prs""",
)


def _hash(additions: str, digest: str = "") -> str:
    ci = f"'_ci', {digest}, " if digest else ""
    return f"""md5(CAST(json_object({ci}'additions', {additions}, 'comment_count', comment_count,
      'commit_count', commit_count, 'deletions', deletions, 'files_changed', files_changed,
      'merged_at', epoch_us(merged_at), 'pr_number', pr_number, 'review_count', review_count,
      'title', title) AS VARCHAR))"""


_view(
    "digests",
    "runs",
    """SELECT pr_number, count(*) || ':' || sum(word) AS ci_digest, count(*) AS ci_run_count FROM (
         SELECT pr_number, ('0x' || substr(md5(CAST(json_object(
             'ci_duration_ms', CAST(round(ci_duration_seconds * 1000) AS BIGINT),
             'ci_name', ci_name, 'ci_state', ci_state, 'ci_target_url', ci_target_url)
           AS VARCHAR)), 1, 12))::BIGINT AS word FROM runs)
       GROUP BY pr_number""",
)
_view(
    "stored",
    "prs",
    f"""SELECT repository, pr_number, additions, {_hash('additions', 'NULL')} AS _cache_hash,
          0 AS ci_run_count
        FROM prs WHERE pr_number % 3 <> 0 AND merged_at IS NOT NULL""",
)
_view(
    "incoming",
    "prs digests",
    f"""SELECT repository, pr_number, additions + CASE WHEN pr_number % 5 = 0 THEN 1 ELSE 0 END AS additions,
          {_hash('additions + CASE WHEN pr_number % 5 = 0 THEN 1 ELSE 0 END', 'ci_digest')} AS _cache_hash,
          ci_run_count
        FROM prs LEFT JOIN digests USING (pr_number)
        WHERE merged_at IS NOT NULL OR ci_run_count > 0""",
)
_oracle(
    "pr_upsert",
    "stored incoming",
    """SELECT coalesce(i.repository, s.repository) AS repository,
         coalesce(i.pr_number, s.pr_number) AS pr_number,
         CASE WHEN i.pr_number IS NULL THEN 'keep' WHEN s.pr_number IS NULL THEN 'insert'
           WHEN i._cache_hash = s._cache_hash THEN 'skip' ELSE 'update' END AS action,
         CASE WHEN i.pr_number IS NULL THEN s.additions ELSE i.additions END AS additions,
         coalesce(i._cache_hash, s._cache_hash) AS _cache_hash,
         coalesce(i.ci_run_count, s.ci_run_count, 0) AS ci_run_count
       FROM stored s FULL JOIN incoming i ON s.pr_number = i.pr_number""",
)
_oracle(
    "clear_repo",
    "stored",
    "SELECT repository, pr_number, _cache_hash FROM stored WHERE repository <> 'org/building'",
)
_oracle(
    "pr_change_hash",
    "prs",
    f"SELECT repository, pr_number, {_hash('additions')} AS change_hash FROM prs",
)
_oracle(
    "stored_pr_keys",
    "repos",
    """SELECT repository, pr_number, pr_number IN (SELECT user_id FROM events) AS has_ci
       FROM repos""",
)
_oracle(
    "store_cycle",
    "stored incoming",
    """SELECT repository, pr_number, additions, _cache_hash, coalesce(ci_run_count, 0) AS ci_run_count,
         (SELECT count(*) FROM incoming WHERE repository = 'org/building') AS dropped
       FROM incoming WHERE repository <> 'org/building'""",
)
_oracle(
    "store_runs",
    "runs_repo incoming",
    f"""SELECT r.repository, r.pr_number, r.ordinal, r.ci_name, r.ci_state, {r6('r.ci_duration_seconds', 'ci_duration_seconds')}
        FROM runs_repo r JOIN incoming i USING (repository, pr_number) WHERE r.repository <> 'org/building'""",
)
_oracle(
    "store_stats",
    "repos",
    """SELECT coalesce(repository, '(all)') AS repository,
         coalesce(replace(repository, '/', '_'), '(all)') AS store_name,
         count(*) AS prs, count(DISTINCT repository) AS repositories
       FROM repos
       GROUP BY ROLLUP (repository)""",
)
_oracle(
    "collection_summary",
    "repos runs",
    """SELECT coalesce(repository, '(all)') AS repository, count(*) AS prs,
         CAST(coalesce(sum(n), 0) AS BIGINT) AS ci_runs
       FROM repos LEFT JOIN (SELECT pr_number, count(*) AS n FROM runs GROUP BY 1) USING (pr_number)
       GROUP BY ROLLUP (repository)""",
)

# --- pull requests ----------------------------------------------------------

_oracle(
    "pr_record",
    "prs order_drafts",
    f"""SELECT repository, pr_number, title, body, coalesce(review_count, 0) AS review_count,
          coalesce(comment_count, 0) AS comment_count, coalesce(commit_count, 0) AS commit_count,
          files_changed, additions, deletions, created_hour, created_day, author_association,
          is_draft, {iso('created_at')}, {iso('merged_at')},
          round(CASE WHEN merged_at IS NOT NULL THEN greatest(0.0,
            (epoch_us(merged_at) - epoch_us(created_at)) / 3.6e9 - draft_time_hours) END, 6) + 0.0
            AS merge_time_hours
        FROM prs JOIN order_drafts USING (pr_number)""",
)
_oracle(
    "draft_time",
    "timeline_drafts",
    f"SELECT pr_number, {r6('draft_time_hours')} FROM timeline_drafts",
)
_oracle(
    "net_merge_time",
    "timeline_drafts",
    """SELECT pr_number, round(CASE WHEN merged_at IS NOT NULL THEN greatest(0.0,
         (epoch_us(merged_at) - epoch_us(created_at)) / 3.6e9 - draft_time_hours) END, 6) + 0.0
         AS merge_time_hours
       FROM timeline_prs JOIN timeline_drafts USING (pr_number)""",
)
_BOT = " OR ".join(f"contains(lower(author_login), '{p}')" for p in BOT_PATTERNS)
_view(
    "humans",
    "listing",
    f"SELECT * FROM listing WHERE NOT coalesce(author_type = 'Bot', false) "
    f"AND NOT coalesce({_BOT}, false)",
)
_oracle("human_prs", "humans", "SELECT repository, pr_number, author_login FROM humans")
_oracle(
    "merged_prs",
    "listing",
    f"SELECT repository, pr_number, {iso('merged_at')} FROM listing WHERE merged_at IS NOT NULL",
)
_oracle(
    "created_parts",
    "pr_times",
    """SELECT pr_number, CAST(hour(created_at) AS INTEGER) AS created_hour,
         CAST(isodow(created_at) - 1 AS INTEGER) AS created_day FROM pr_times""",
)
_oracle(
    "business_hour_flag",
    "",
    "SELECT event_id, isodow(ts) <= 5 AND hour(ts) BETWEEN 9 AND 17 AS is_business_hour FROM events",
)
_oracle(
    "business_hours_between",
    "pr_times",
    """
    SELECT pr_number, round(CASE WHEN created_at >= merged_at THEN 0.0 ELSE (
        CASE WHEN isodow(created_at) <= 5 AND hour(created_at) BETWEEN 9 AND 17
          THEN greatest(0, epoch_us(least(merged_at, date_trunc('day', created_at) + INTERVAL 17 HOUR))
            - epoch_us(created_at)) ELSE 0 END
        + coalesce((SELECT sum(greatest(0, epoch_us(least(merged_at, d + INTERVAL 17 HOUR))
            - epoch_us(d + INTERVAL 9 HOUR)))
          FROM generate_series(date_trunc('day', created_at) + INTERVAL 1 DAY, merged_at, INTERVAL 1 DAY) t(d)
          WHERE isodow(d) <= 5), 0)) / 3.6e9 END, 6) + 0.0 AS business_hours
    FROM pr_times WHERE merged_at IS NOT NULL""",
)
_oracle(
    "format_duration",
    "",
    """SELECT event_id, CASE WHEN h < 1 THEN CAST(trunc(h * 60) AS BIGINT) || ' minutes'
         WHEN h < 24 THEN printf('%.1f hours', h) ELSE printf('%.1f days', h / 24) END AS duration_text
       FROM (SELECT event_id, value * CAST(0.4 AS DOUBLE) AS h FROM events)""",
)
_oracle(
    "parse_duration",
    "",
    """SELECT o_orderkey AS pr_number, nullif(
         CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 5) * 3600.0 ELSE 0.0 END
         + CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 60) * 60.0 ELSE 0.0 END
         + CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 61) * 1.0 ELSE 0.0 END, 0.0)::DOUBLE AS seconds
       FROM orders""",
)
_REQUIRED = ("title", "review_count", "files_changed")
_COUNTS = ("review_count", "comment_count", "commit_count", "files_changed", "additions", "deletions")
_oracle(
    "validate_prs",
    "prs",
    "SELECT repository, pr_number, CASE "
    + " ".join(f"WHEN {c} IS NULL THEN 'Missing required PR data field: {c}'" for c in _REQUIRED)
    + " "
    + " ".join(f"WHEN {c} < 0 THEN 'Field {c} must be a non-negative number'" for c in _COUNTS)
    + """ END AS error FROM (
      SELECT * REPLACE (CASE WHEN pr_number % 50 = 0 THEN -1 ELSE additions END AS additions,
        CASE WHEN pr_number % 70 <> 0 THEN title END AS title) FROM prs)""",
)

_FAULT = (
    "CASE "
    + " ".join(f"WHEN {c} IS NULL THEN 'Missing required PR data field: {c}'" for c in _REQUIRED)
    + " "
    + " ".join(f"WHEN {c} < 0 THEN 'Field {c} must be a non-negative number'" for c in _COUNTS)
    + " END"
)
_oracle(
    "batch_score_keys",
    "prs",
    f"""SELECT repository, pr_number, error, error IS NOT NULL AS unpredicted, error IS NOT NULL AS unrated
        FROM (SELECT repository, pr_number, {_FAULT} AS error FROM (
          SELECT * REPLACE (CASE WHEN pr_number % 50 = 0 THEN -1 ELSE additions END AS additions,
            CASE WHEN pr_number % 70 <> 0 THEN title END AS title) FROM prs))""",
)
_oracle(
    "batch_report_keys",
    "prs",
    f"""SELECT repository, pr_number, title AS pr_title,
          'https://git.example.org/' || repository || '/pull/' || pr_number AS pr_url,
          {iso('created_at')}, {_FAULT} AS error, {_FAULT} IS NOT NULL AS unpredicted
        FROM (SELECT *, row_number() OVER (PARTITION BY repository
                ORDER BY created_at DESC, pr_number DESC) AS rank FROM prs WHERE pr_state = 'open')
        WHERE rank <= 50""",
)
_oracle(
    "combined_keys",
    "prs runs",
    f"""SELECT repository, pr_number, {_FAULT} AS error, {_FAULT} IS NOT NULL AS unpredicted
        FROM prs WHERE pr_number IN (SELECT pr_number FROM runs)""",
)
_oracle("model_reload", "prs", "SELECT count(*) AS prs, 0::BIGINT AS changed FROM prs")
_oracle(
    "train_sizes",
    "prs split",
    """SELECT count(*) AS data_points, count(*) FILTER (WHERE NOT is_test) AS training_size,
         count(*) FILTER (WHERE is_test) AS test_size
       FROM prs JOIN split USING (repository, pr_number) WHERE merge_time_hours <= 720""",
)

# --- incremental load -------------------------------------------------------

_oracle(
    "prs_to_fetch",
    "humans",
    "SELECT repository, pr_number FROM humans WHERE pr_number % 3 = 0",
)
_oracle(
    "ci_to_fetch",
    "humans",
    "SELECT repository, pr_number FROM humans WHERE pr_number NOT IN (SELECT user_id FROM events)",
)
_oracle(
    "fetch_budget",
    "humans repos",
    """
    SELECT repository, pr_number, position, merged FROM (
      SELECT repository, pr_number, merged, row_number() OVER w AS position,
        coalesce(sum(CAST(merged AS INTEGER)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          AS merged_before
      FROM humans WHERE pr_number % 3 = 0
      WINDOW w AS (PARTITION BY repository ORDER BY updated_at DESC, pr_number))
    JOIN (SELECT repository, count(*) AS stored FROM repos WHERE pr_number % 3 <> 0 GROUP BY 1)
      USING (repository)
    WHERE position <= 400 AND stored + merged_before < 2300""",
)
_oracle(
    "stored_prs_limit",
    "repos",
    "SELECT pr_number, repository FROM repos ORDER BY pr_number LIMIT 1000",
)
_oracle(
    "open_prs_topn",
    "listing",
    f"""SELECT repository, pr_number, rank, {iso('created_at')} FROM (
          SELECT *, row_number() OVER (PARTITION BY repository
            ORDER BY created_at DESC, pr_number DESC) AS rank FROM listing WHERE state = 'open')
        WHERE rank <= 50""",
)

# --- CI ---------------------------------------------------------------------

_view(
    "clean",
    "statuses",
    f"SELECT * FROM statuses WHERE starts_with(target_url, '{RUN_PREFIX}')",
)
_oracle(
    "ci_runs_clean",
    "clean",
    """SELECT pr_number, ordinal, context AS ci_name, target_url AS ci_target_url, state AS ci_state
       FROM clean""",
)
_oracle(
    "ci_runs_dedup",
    "clean",
    """SELECT pr_number, ordinal, target_url, context, state FROM clean
       QUALIFY row_number() OVER (PARTITION BY pr_number, target_url ORDER BY ordinal) = 1""",
)
_oracle(
    "latest_commit_statuses",
    "latest_statuses",
    "SELECT pr_number, sha, ordinal, context, state FROM latest_statuses",
)


def _job_url(url: str) -> str:
    return (
        f"CASE WHEN starts_with({url}, '{VIEW_PREFIX}') THEN '{DOCUMENT_BASE}/' || "
        f"regexp_replace(replace({url}, '{VIEW_PREFIX}', ''), '/+$', '') || '/{DOCUMENT_NAME}' END"
    )


_oracle("job_url", "statuses", f"SELECT ordinal, {_job_url('target_url')} AS job_url FROM statuses")
_view(
    "document_seconds",
    "statuses",
    f"""SELECT {_job_url('target_url')} AS url,
          CASE WHEN s > 0 AND s < 86400 THEN s END AS seconds
        FROM (SELECT *, CAST(round(value * 1000) AS BIGINT)::DOUBLE AS s FROM statuses
              WHERE starts_with(target_url, '{VIEW_PREFIX}'))
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY ordinal DESC) = 1""",
)
_oracle(
    "job_durations",
    "latest_statuses document_seconds",
    f"""SELECT pr_number, ordinal, context AS ci_name, target_url AS ci_target_url,
          state AS ci_state, round(seconds, 6) AS ci_duration_seconds
        FROM (SELECT * FROM latest_statuses WHERE starts_with(target_url, '{RUN_PREFIX}')
              QUALIFY row_number() OVER (PARTITION BY pr_number, target_url ORDER BY ordinal) = 1)
        LEFT JOIN document_seconds ON url = {_job_url('target_url')}""",
)
_oracle(
    "prs_with_ci",
    "repos",
    "SELECT repository, pr_number FROM repos WHERE pr_number IN (SELECT user_id FROM events)",
)
_oracle(
    "pr_ci_nested",
    "pr_times runs",
    f"""SELECT pr_number, {iso('merged_at')}, coalesce(part, -1) AS part, coalesce(n, 0) AS ci_runs, ci_names
        FROM (SELECT pr_number, merged_at FROM pr_times WHERE merged_at IS NOT NULL) FULL JOIN (
          SELECT pr_number, part, count(*) AS n,
            string_agg(ci_name, ',' ORDER BY ordinal, ci_name, ci_target_url, ci_state, ci_duration_seconds) AS ci_names
          FROM (SELECT *, (row_number() OVER (PARTITION BY pr_number
              ORDER BY ordinal, ci_name, ci_target_url, ci_state, ci_duration_seconds) - 1) // 1000 AS part FROM runs)
          GROUP BY 1, 2)
        USING (pr_number)""",
)
_DURATIONS = [r6(f"ci_{k}_duration") for k in ("total", "avg", "max", "min")]
_OUTCOMES = [
    "ci_total_runs",
    "ci_unique_tests",
    "ci_successful_runs",
    "ci_failed_runs",
    r6("ci_success_rate"),
]
_RETRIES = [r6("ci_avg_retries"), "ci_max_retries"]


def _list(*parts) -> str:
    return ", ".join(parts)


_oracle("ci_durations", "rolled", f"SELECT pr_number, {_list(*_DURATIONS)} FROM rolled")
_oracle("ci_outcomes", "rolled", f"SELECT pr_number, {_list(*_OUTCOMES)} FROM rolled")
_oracle("ci_retries", "retries", f"SELECT pr_number, {_list(*_RETRIES)} FROM retries")
_oracle("ci_kind_flags", "rolled", f"SELECT pr_number, {_list(*_KINDS)} FROM rolled")
_oracle(
    "ci_rollup",
    "rollup_rows",
    "SELECT repository, pr_number, pr_title, pr_files_changed, pr_additions, pr_deletions, "
    f"pr_commits, pr_is_draft, {_list(*_DURATIONS, *_OUTCOMES, *_RETRIES, *_KINDS)} FROM rollup_rows",
)
_oracle(
    "ci_rollup_nested",
    "rolled",
    f"SELECT pr_number, ci_total_runs, ci_successful_runs, ci_failed_runs, {_list(*_KINDS)} FROM rolled",
)
_oracle(
    "ci_summary",
    "runs_repo",
    f"""
    SELECT repository, total_ci_runs, unique_prs, unique_ci_tests, {r6('success_rate')},
      {r6('failure_rate')}, {r6('avg_duration_seconds')}, {r6('max_duration_seconds')},
      {r6('min_duration_seconds')}, {r6('median_duration_seconds')}
    FROM (
      SELECT repository, count(*) AS total_ci_runs, count(DISTINCT pr_number) AS unique_prs,
        count(DISTINCT coalesce(ci_name, '')) AS unique_ci_tests,
        count(*) FILTER (WHERE ci_state = 'success') / count(ci_state) AS success_rate,
        count(*) FILTER (WHERE ci_state IN ('failure', 'error')) / count(ci_state) AS failure_rate,
        avg(ci_duration_seconds) AS avg_duration_seconds,
        max(ci_duration_seconds) AS max_duration_seconds,
        min(ci_duration_seconds) AS min_duration_seconds
      FROM runs_repo GROUP BY repository)
    LEFT JOIN (
      SELECT repository, ci_duration_seconds AS median_duration_seconds FROM (
        SELECT repository, ci_duration_seconds,
          row_number() OVER (PARTITION BY repository ORDER BY ci_duration_seconds) - 1 AS rank,
          count(*) OVER (PARTITION BY repository) AS n
        FROM runs_repo WHERE ci_duration_seconds IS NOT NULL)
      WHERE rank = n // 2) USING (repository)""",
)
_oracle(
    "ci_state_distribution",
    "runs_repo",
    "SELECT repository, ci_state, count(*) AS runs FROM runs_repo GROUP BY 1, 2",
)
_oracle(
    "ci_top_tests",
    "runs",
    "SELECT ci_name, count(*) AS runs FROM runs GROUP BY 1 ORDER BY runs DESC, ci_name LIMIT 10",
)
_oracle(
    "ci_top_tests_by_repo",
    "runs_repo",
    """SELECT repository, ci_name, runs, rank FROM (
         SELECT *, row_number() OVER (PARTITION BY repository ORDER BY runs DESC, ci_name) AS rank
         FROM (SELECT repository, ci_name, count(*) AS runs FROM runs_repo GROUP BY 1, 2))
       WHERE rank <= 3""",
)

# --- statistics -------------------------------------------------------------

_STAT_FIELDS = (*_COUNTS, "merge_time_hours")
_oracle(
    "repo_numeric_stats",
    "prs",
    f"""SELECT repository, field, {r6('avg(value)', 'mean')},
          {r6('quantile_cont(value, 0.5)', 'median')}, {r6('stddev_pop(value)', 'std')},
          {r6('min(value)', 'min')}, {r6('max(value)', 'max')}
        FROM ("""
    + " UNION ALL ".join(
        f"SELECT repository, '{f}' AS field, CAST({f} AS DOUBLE) AS value FROM prs" for f in _STAT_FIELDS
    )
    + ") WHERE value IS NOT NULL GROUP BY 1, 2",
)
_oracle(
    "repo_time_profile",
    "prs",
    f"""SELECT count(*) AS total_prs, count(DISTINCT repository) AS unique_repositories,
          {r6('count(*) FILTER (WHERE created_day IN (5, 6)) / count(*)', 'weekend_prs_ratio')},
          {r6('count(*) FILTER (WHERE created_hour BETWEEN 9 AND 17) / count(*)', 'business_hours_prs_ratio')}
        FROM prs""",
)
_PERCENTILES = _list(
    *[r6(f"quantile_cont(merge_time_hours, {p / 100})", f"p{p}") for p in (25, 50, 75, 90, 95)]
)
_oracle("merge_time_percentiles", "prs", f"SELECT {_PERCENTILES} FROM prs")
_oracle(
    "merge_time_percentiles_by_repo",
    "prs",
    f"SELECT repository, {_PERCENTILES} FROM prs GROUP BY repository",
)
_PRICES = "l_orderkey, l_partkey, l_linenumber, l_extendedprice"
_oracle(
    "outliers_iqr",
    "",
    f"""SELECT {_PRICES} FROM lineitem, (
          SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3
          FROM lineitem)
        WHERE l_extendedprice BETWEEN q1 - 0.4 * (q3 - q1) AND q3 + 0.4 * (q3 - q1)""",
)
_oracle(
    "outliers_zscore",
    "",
    f"""SELECT {_PRICES} FROM lineitem, (
          SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem)
        WHERE abs((l_extendedprice - m) / s) < 1.5""",
)

# --- features ---------------------------------------------------------------

_BASIC, _DERIVED = PR_STRUCTURAL[:9], PR_STRUCTURAL[9:]
_oracle(
    "pr_basic_features",
    "features_raw",
    f"SELECT repository, pr_number, {_list(*map(r6, _BASIC))} FROM features_raw",
)
_oracle(
    "pr_derived_features",
    "features_raw",
    f"SELECT repository, pr_number, {_list(*map(r6, _DERIVED))} FROM features_raw",
)
_oracle(
    "pr_training_rows",
    "prs",
    f"SELECT repository, pr_number, {r6('merge_time_hours')} FROM prs WHERE merge_time_hours <= 720",
)
_oracle("pr_text", "pr_texts", "SELECT repository, pr_number, text FROM pr_texts")
_TEXT_COLUMNS = [
    r6(
        f"coalesce(max(CASE WHEN position = {i} THEN tfidf END), 0.0) * {PR_TEXT.weight}",
        f"{PR_TEXT.prefix}{i}",
    )
    for i in range(PR_TEXT.max_features)
]
_oracle(
    "pr_features",
    "features prv_tfidf",
    f"""SELECT repository, pr_number, {_list(*[r6(f'any_value({c})', c) for c in PR_STRUCTURAL])},
          {_list(*_TEXT_COLUMNS)}
        FROM features LEFT JOIN prv_tfidf USING (pr_number) GROUP BY repository, pr_number""",
)
_oracle(
    "feature_profile",
    "",
    "SELECT count(*) AS rows, 16 AS structural, 50 AS text, 3.125::DOUBLE AS text_ratio FROM orders",
)
_oracle(
    "feature_alignment",
    "features",
    f"""SELECT repository, pr_number, is_weekend, additions, 0.0::DOUBLE AS tfidf_7,
          {r6('addition_ratio')} FROM features""",
)
_CI_RATIOS = {
    "ci_run_per_test_ratio": "ci_total_runs / (ci_unique_tests + 1)",
    "ci_duration_per_file": "coalesce(ci_avg_duration / (pr_files_changed + 1), 0.0)",
}
_oracle(
    "ci_features",
    "rollup_rows",
    "SELECT repository, pr_number, "
    + _list(
        *[
            r6(
                _CI_RATIOS.get(c)
                or (f"CAST(CAST({c} AS INTEGER) AS DOUBLE)" if c in _KINDS or c == "pr_is_draft" else f"CAST(coalesce({c}, 0) AS DOUBLE)"),
                c,
            )
            for c in CI_STRUCTURAL
        ]
    )
    + " FROM rollup_rows",
)
_LABELS = """SELECT *, CASE WHEN ci_total_duration > 0 THEN ci_total_duration / 3600 END AS label_duration,
  ci_avg_retries AS label_attempts, ci_success_rate AS label_success FROM rollup_rows"""
_view("labels", "rollup_rows", _LABELS)
_oracle(
    "ci_targets",
    "labels",
    f"""SELECT repository, pr_number, {r6('label_duration')}, {r6('label_attempts')},
          {r6('label_success')} FROM labels""",
)
_oracle("train_test_split", "split", "SELECT repository, pr_number, is_test FROM split")
_view(
    "moments",
    "features split",
    "SELECT "
    + _list(
        *[
            f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}"
            for c in PR_STRUCTURAL
        ]
    )
    + " FROM features JOIN split USING (repository, pr_number) WHERE NOT is_test",
)
_oracle(
    "scaled_features",
    "moments",
    "SELECT repository, pr_number, is_test, "
    + _list(*[r6(f"({c} - m_{c}) / s_{c}", c) for c in PR_STRUCTURAL])
    + " FROM features JOIN split USING (repository, pr_number), moments",
)

# --- text -------------------------------------------------------------------

_oracle(
    "tokens",
    "",
    f"""SELECT doc_id, CAST(len(l) AS INTEGER) AS n, md5(array_to_string(l, ' ')) AS tokens_md5
        FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {_TOKEN}) AS l FROM documents)""",
)
_oracle(
    "tokens_nostop",
    "doc_words",
    """SELECT doc_id, CAST(count(token) AS INTEGER) AS n,
         md5(coalesce(string_agg(token, ' ' ORDER BY pos), '')) AS words_md5
       FROM (SELECT doc_id FROM documents) LEFT JOIN doc_words USING (doc_id) GROUP BY doc_id""",
)
_oracle(
    "ngrams",
    "doc_grams",
    """SELECT doc_id, CAST(count(term) AS INTEGER) AS n,
         md5(coalesce(string_agg(term, '|' ORDER BY kind, pos), '')) AS ngrams_md5
       FROM (SELECT doc_id FROM documents) LEFT JOIN doc_grams USING (doc_id) GROUP BY doc_id""",
)
_oracle(
    "vocabulary",
    "doc_vocab",
    f"SELECT term, df, term_count, {r6('idf')}, position FROM doc_vocab",
)
_LONG = f"SELECT doc_id, term, position, tf, {r6('tfidf')}"
_oracle("tfidf", "doc_tfidf", f"{_LONG} FROM doc_tfidf")
_oracle("tfidf_apply", "train_tfidf", f"{_LONG} FROM train_tfidf")
_oracle(
    "text_weighting",
    "cidoc_tfidf",
    f"""SELECT doc_id, term, position, tf, {r6(f'tfidf * {CI_TEXT.weight}', 'tfidf')}
        FROM cidoc_tfidf""",
)

# --- metrics and scores without a model -------------------------------------


def _metrics(y: str, p: str) -> list[str]:
    error = f"({y} - {p})"
    return [
        r6(f"avg(abs{error})", "mae"),
        r6(f"avg({error} * {error})", "mse"),
        r6(f"sqrt(avg({error} * {error}))", "rmse"),
        r6(f"1 - sum({error} * {error}) / nullif(var_pop({y}) * count(*), 0)", "r2"),
        r6(f"avg(abs{error} / abs(nullif({y}, 0))) * 100", "mape"),
    ]


_oracle(
    "regression_metrics",
    "prs",
    f"""SELECT repository, {_list(*_metrics('y', 'p'))} FROM (
          SELECT repository, merge_time_hours AS y, files_changed * 24.0::DOUBLE AS p FROM prs
          WHERE merge_time_hours <= 720) WHERE p IS NOT NULL GROUP BY repository""",
)
_RULES = {
    "duration": "ci_total_runs * 0.5::DOUBLE",
    "attempts": "ci_unique_tests * 2.0::DOUBLE",
    "success": "ci_successful_runs / (ci_total_runs + 5)",
}
_NULL = "CAST(NULL AS DOUBLE)"
_oracle(
    "ci_metrics",
    "labels",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS target, {_list(*_metrics('y', 'p'))},
          {r6('avg(abs(y - p)) * 60', 'mae_minutes') if t == 'duration' else _NULL + ' AS mae_minutes'},
          {r6('sqrt(avg((y - p) * (y - p))) * 60', 'rmse_minutes') if t == 'duration' else _NULL + ' AS rmse_minutes'},
          {r6('avg(CAST((y > 0.5) = (p > 0.5) AS INTEGER))', 'accuracy') if t == 'success' else _NULL + ' AS accuracy'}
        FROM (SELECT label_{t} AS y, {rule} AS p FROM labels) WHERE y IS NOT NULL"""
        for t, rule in _RULES.items()
    ),
)
_SHARE = "(" + " + ".join(f"CAST({c} <> 0 AS INTEGER)" for c in PR_STRUCTURAL) + ") / 16"
_oracle(
    "score_confidence",
    "features",
    f"""SELECT repository, pr_number, {r6(_SHARE, 'filled_share')},
          CASE WHEN {_SHARE} > 0.7 THEN 'high' WHEN {_SHARE} > 0.4 THEN 'medium' ELSE 'low' END
            AS prediction_confidence
        FROM features""",
)
_view(
    "shaped",
    "rollup_rows",
    """
    SELECT repository, pr_number, d AS total_duration_hours, d * 60 AS total_duration_minutes,
      greatest(1, CAST(round_even(a, 0) AS BIGINT)) AS expected_attempts,
      least(1.0, greatest(0.0, s)) AS success_probability,
      CASE WHEN s > 0.5 THEN 'success' ELSE 'failure' END AS likely_outcome
    FROM (SELECT *, ci_total_duration / 36000 AS d, ci_avg_retries / 8 - 0.5 AS a,
            ci_success_rate * 1.6::DOUBLE - 0.3::DOUBLE AS s FROM rollup_rows)""",
)
_oracle(
    "ci_score_shaping",
    "shaped",
    f"""SELECT repository, pr_number, {r6('total_duration_hours')}, {r6('total_duration_minutes')},
          expected_attempts, {r6('success_probability')}, likely_outcome FROM shaped""",
)
_oracle(
    "ci_prediction_summary",
    "shaped",
    """
    SELECT repository, pr_number,
      printf('%.1f hours (%.1f days)', total_duration_hours, total_duration_hours / 24)
        AS estimated_completion_time,
      expected_attempts,
      CASE WHEN expected_attempts > 3 THEN 'high' WHEN expected_attempts > 1 THEN 'medium' ELSE 'low' END
        AS retry_risk,
      printf('%.1f%%', success_probability * 100) AS overall_success_likelihood,
      CASE WHEN success_probability > 0.8 THEN 'CI likely to pass with minimal issues'
        WHEN success_probability > 0.6 THEN 'CI may require some attention'
        WHEN success_probability > 0.4 THEN 'CI likely to need fixes before passing'
        ELSE 'CI may require significant fixes' END AS recommendation
    FROM shaped""",
)

# Second-order boosting: the root split of one tree of depth 1 (L2 weight 1, 20 rows a
# side) on the line features, each of whose values is its own bin.
_oracle(
    "boost_first_split",
    "",
    """
    WITH t AS (
      SELECT l_extendedprice::DOUBLE / 1000 AS y, l_quantity::DOUBLE AS f0, l_discount::DOUBLE AS f1,
        l_tax::DOUBLE AS f2, l_linenumber::DOUBLE AS f3 FROM lineitem),
    g AS (SELECT avg(y) OVER () - y AS g, f0, f1, f2, f3 FROM t),
    x AS (
      SELECT 0 AS k, 'l_quantity' AS feature, f0 AS v, g FROM g UNION ALL
      SELECT 1, 'l_discount', f1, g FROM g UNION ALL
      SELECT 2, 'l_tax', f2, g FROM g UNION ALL
      SELECT 3, 'l_linenumber', f3, g FROM g),
    per AS (SELECT k, feature, v, sum(g) AS sg, count(*) AS n FROM x GROUP BY ALL),
    cum AS (
      SELECT k, feature, v,
        sum(sg) OVER (PARTITION BY k ORDER BY v) AS gl, sum(n) OVER (PARTITION BY k ORDER BY v) AS nl,
        sum(sg) OVER (PARTITION BY k) AS gt, sum(n) OVER (PARTITION BY k) AS nt,
        max(v) OVER (PARTITION BY k) AS top
      FROM per),
    cand AS (
      SELECT *, 0.5 * (gl * gl / (nl + 1) + (gt - gl) * (gt - gl) / (nt - nl + 1) - gt * gt / (nt + 1)) AS gain
      FROM cum WHERE v < top AND nl >= 20 AND nt - nl >= 20),
    best AS (SELECT * FROM cand WHERE gain > 0 ORDER BY gain DESC, k, v LIMIT 1)
    SELECT 1::BIGINT AS node, feature, v AS threshold, printf('%.8e', gain) AS gain, nt::BIGINT AS n_rows,
      NULL::DOUBLE AS weight FROM best
    UNION ALL SELECT 2, NULL, NULL, NULL, nl::BIGINT, round(-gl / (nl + 1), 6) FROM best
    UNION ALL SELECT 3, NULL, NULL, NULL, (nt - nl)::BIGINT, round(-(gt - gl) / (nt - nl + 1), 6) FROM best""",
)
_view(
    "fold_rows",
    "prs",
    """SELECT repository, pr_number, (row_number() OVER (ORDER BY repository, pr_number) - 1)::BIGINT AS position,
      count(*) OVER () AS n
    FROM prs WHERE merge_time_hours <= 720""",
)
_oracle(
    "fold_assignment",
    "fold_rows",
    """
    SELECT repository, pr_number, position,
      (CASE WHEN position < (n % 5) * (n // 5 + 1) THEN position // (n // 5 + 1)
        ELSE n % 5 + (position - (n % 5) * (n // 5 + 1)) // (n // 5) END)::INTEGER AS fold
    FROM fold_rows""",
)

# The same rows as store_cycle: a broken load leaves nothing, overlapping loads both count.
ORACLES["store_commits"] = ORACLES["store_cycle"]
_oracle(
    "fetch_budget_both",
    "humans repos runs pr_times",
    """
    SELECT repository, pr_number, position, need_pr, need_ci FROM (
      SELECT repository, pr_number, need_pr, need_ci, row_number() OVER w AS position,
        coalesce(sum(CAST(need_pr AND coalesce(merged, false) AS INTEGER))
          OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS counted_before
      FROM (
        SELECT humans.*, have_pr.pr_number IS NULL AS need_pr, have_ci.pr_number IS NULL AS need_ci
        FROM humans
        LEFT JOIN (SELECT DISTINCT pr_number FROM repos WHERE pr_number % 3 <> 0) have_pr
          ON humans.pr_number = have_pr.pr_number
        LEFT JOIN (SELECT DISTINCT pr_number FROM runs WHERE pr_number % 3 <> 0
            AND pr_number IN (SELECT pr_number FROM repos WHERE pr_number % 3 <> 0)
            AND pr_number IN (SELECT pr_number FROM pr_times WHERE merged_at IS NOT NULL)) have_ci
          ON humans.pr_number = have_ci.pr_number)
      WHERE need_pr OR need_ci
      WINDOW w AS (PARTITION BY repository ORDER BY updated_at DESC, pr_number))
    LEFT JOIN (SELECT repository, count(*) AS stored FROM repos WHERE pr_number % 3 <> 0 GROUP BY 1) USING (repository)
    WHERE position <= 400 AND coalesce(stored, 0) + counted_before < 2300""",
)
# The store-to-score path keeps the rows, faults and prediction flags of the batch.
ORACLES["store_to_scores"] = ORACLES["batch_score_keys"]
# Saved as JSON and read back, the CI summary keeps every value.
ORACLES["ci_prediction_json"] = ORACLES["ci_prediction_summary"]
_oracle(
    "combined_rules",
    "features shaped",
    f"""
    SELECT f.repository, f.pr_number, {r6('f.additions / 10', 'predicted_hours')}, {r6('total_duration_hours')},
      f.prediction_confidence,
      CASE WHEN total_duration_hours > f.additions / 10 THEN 'CI may take longer than PR merge process'
        WHEN total_duration_hours IS NOT NULL AND f.additions IS NOT NULL THEN 'CI should complete before PR merge'
      END AS timeline_comparison,
      CASE WHEN success_probability > 0.8 THEN 'CI likely to pass with minimal issues'
        WHEN success_probability > 0.6 THEN 'CI may require some attention'
        WHEN success_probability > 0.4 THEN 'CI likely to need fixes before passing'
        WHEN success_probability IS NOT NULL THEN 'CI may require significant fixes' END AS ci_recommendation,
      CASE WHEN f.prediction_confidence = 'high' THEN 'High confidence in merge time prediction'
        WHEN f.prediction_confidence = 'medium' THEN 'Medium confidence - monitor for changes'
        ELSE 'Low confidence - prediction may be inaccurate' END AS pr_advice,
      NULL::VARCHAR AS error
    FROM (SELECT repository, pr_number, additions,
        CASE WHEN {_SHARE} > 0.7 THEN 'high' WHEN {_SHARE} > 0.4 THEN 'medium' ELSE 'low' END AS prediction_confidence
      FROM features) f
    LEFT JOIN shaped USING (repository, pr_number)""",
)
# Keys of the store after store_cycle's loads, and which have CI runs.
ORACLES["store_keys"] = f"SELECT repository, pr_number, ci_run_count > 0 AS has_ci FROM ({ORACLES['store_cycle']})"
ORACLES["store_first_rows"] = (
    f"SELECT repository, pr_number, additions, _cache_hash FROM ({ORACLES['store_cycle']}) "
    "ORDER BY pr_number, repository LIMIT 1000"
)
ORACLES["store_statistics"] = f"""SELECT coalesce(repository, '(all)') AS repository,
    coalesce(replace(repository, '/', '_'), '(all)') AS store_name,
    count(*) AS prs, count(DISTINCT repository) AS repositories
  FROM ({ORACLES['store_cycle']}) GROUP BY ROLLUP (repository)"""

_ALL_FEATURES = [*PR_STRUCTURAL, *[f"{PR_TEXT.prefix}{i}" for i in range(PR_TEXT.max_features)]]
_view(
    "wide_all",
    "features prv_tfidf",
    "SELECT repository, pr_number, "
    + _list(
        *[f"any_value({c}) AS {c}" for c in PR_STRUCTURAL],
        *[
            f"coalesce(max(CASE WHEN position = {i} THEN tfidf END), 0.0) * {PR_TEXT.weight} AS {PR_TEXT.prefix}{i}"
            for i in range(PR_TEXT.max_features)
        ],
    )
    + " FROM features LEFT JOIN prv_tfidf USING (pr_number) GROUP BY repository, pr_number",
)
_view(
    "moments_all",
    "wide_all split",
    "SELECT "
    + _list(*[f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in _ALL_FEATURES])
    + " FROM wide_all JOIN split USING (repository, pr_number) WHERE NOT is_test",
)
_oracle(
    "scaled_all_features",
    "wide_all split moments_all",
    "SELECT repository, pr_number, is_test, "
    + _list(*[r6(f"({c} - m_{c}) / s_{c}", c) for c in _ALL_FEATURES])
    + " FROM wide_all JOIN split USING (repository, pr_number), moments_all",
)

# The CI feature table with its text columns: n-grams of the PR title, the vocabulary
# fitted on every row.
_text_views("cit", "rollup_rows", "rollup_rows", "pr_number", "pr_title")
_vocab_views("citv", "cit_grams", "rollup_rows", "pr_number", CI_TEXT)
_CI_STRUCTURAL_SQL = [
    r6(
        _CI_RATIOS.get(c)
        or (f"CAST(CAST({c} AS INTEGER) AS DOUBLE)" if c in _KINDS or c == "pr_is_draft" else f"CAST(coalesce({c}, 0) AS DOUBLE)"),
        c,
    )
    for c in CI_STRUCTURAL
]
_oracle(
    "ci_features_text",
    "rollup_rows citv_tfidf",
    "SELECT repository, pr_number, "
    + _list(
        *[f"any_value({c.rsplit(' AS ', 1)[0]}) AS {c.rsplit(' AS ', 1)[1]}" for c in _CI_STRUCTURAL_SQL],
        *[
            r6(f"coalesce(max(CASE WHEN position = {i} THEN tfidf END), 0.0) * {CI_TEXT.weight}", f"{CI_TEXT.prefix}{i}")
            for i in range(CI_TEXT.max_features)
        ],
    )
    + " FROM rollup_rows LEFT JOIN citv_tfidf USING (pr_number) GROUP BY repository, pr_number",
)
