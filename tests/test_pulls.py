"""Draft timelines, merge time, the fetch budget and validation."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shipmeter.operators import incremental, pulls, validation
from shipmeter.operators.timeline import DRAFT, READY, draft_time

UTC = dt.timezone.utc
START = dt.datetime(2024, 5, 1, tzinfo=UTC)
PRS = "repository string, pr_number bigint, created_at timestamp, merged_at timestamp, is_draft boolean"
EVENTS = "repository string, pr_number bigint, event_id bigint, event string, created_at timestamp"


def loop_draft_hours(created, merged, is_draft, events):
    if not is_draft and all(kind != READY for _, kind in events):
        return 0.0
    total, since, draft = 0.0, created, True
    for at, kind in events:
        if kind == READY and draft:
            total, draft = total + (at - since).total_seconds(), False
        elif kind == DRAFT and not draft:
            since, draft = at, True
    if draft and merged:
        total += (merged - since).total_seconds()
    return total / 3600


@pytest.mark.parametrize("chunk", ["hour", "day", "year"])
def test_draft_time_against_a_loop(spark, chunk):
    rng = random.Random(11)
    prs, events, want = [], [], {}
    for n in range(300):
        created = START + dt.timedelta(minutes=rng.randrange(5000))
        merged = created + dt.timedelta(hours=rng.randrange(1, 400)) if rng.random() < 0.7 else None
        is_draft = rng.choice([True, False])
        times = sorted(rng.sample(range(1, 30_000), rng.randrange(0, 12)))
        steps = [
            (created + dt.timedelta(minutes=m / 7), rng.choice([READY, DRAFT])) for m in times
        ]
        prs.append(("o/r", n, created, merged, is_draft))
        events += [("o/r", n, i, kind, at) for i, (at, kind) in enumerate(steps)]
        events.append(("o/r", n, 99, "labeled", created))
        want[n] = loop_draft_hours(created, merged, is_draft, steps)
    rng.shuffle(events)
    got = draft_time(
        spark.createDataFrame(prs, PRS), spark.createDataFrame(events, EVENTS), chunk=chunk
    ).collect()
    assert len(got) == 300
    for row in got:
        assert abs(row.draft_time_hours - want[row.pr_number]) < 1e-6, row


def test_one_busy_pr_is_spread_over_chunks(spark):
    """A PR that holds nearly all events gives the same sum."""
    events = [
        ("o/r", 1, i, READY if i % 2 else DRAFT, START + dt.timedelta(minutes=i)) for i in range(20_000)
    ]
    prs = [("o/r", 1, START, None, False), ("o/r", 2, START, START, True)]
    got = draft_time(spark.createDataFrame(prs, PRS), spark.createDataFrame(events, EVENTS))
    assert {r.pr_number: round(r.draft_time_hours, 6) for r in got.collect()} == {
        1: round(10_000 / 60, 6),
        2: 0.0,
    }


def test_net_merge_time_of_a_stored_document(spark):
    df = spark.createDataFrame(
        [("2024-01-15T10:30:00Z", "2024-01-16T06:15:00Z", 0.0), ("2024-01-15T10:30:00Z", "2024-01-15T11:30:00Z", 5.0)],
        "a string, b string, d double",
    )
    hours = pulls.net_merge_hours(F.to_timestamp("a"), F.to_timestamp("b"), F.col("d"))
    assert [r[0] for r in df.select(hours).collect()] == [19.75, 0.0]


@pytest.mark.parametrize("seed", range(4))
def test_fetch_budget_against_a_loop(spark, seed):
    rng = random.Random(seed)
    rows, stored = [], {f"r{i}": rng.randrange(0, 40) for i in range(4)}
    for n in range(400):
        at = START - dt.timedelta(minutes=rng.randrange(0, 3000))
        # One repository holds most of the rows.
        rows.append(("r0" if rng.random() < 0.6 else f"r{rng.randrange(4)}", n, at, rng.random() < 0.5))
    max_new, limit = rng.randrange(5, 60), rng.randrange(60, 90)
    want = set()
    for repo, have in stored.items():
        taken, merged = 0, 0
        for _, n, _, m in sorted((r for r in rows if r[0] == repo), key=lambda r: (-r[2].timestamp(), r[1])):
            if have + merged >= limit or taken >= max_new:
                break
            want.add(n)
            taken, merged = taken + 1, merged + m
    candidates = spark.createDataFrame(rows, "repository string, pr_number bigint, updated_at timestamp, merged boolean")
    counts = spark.createDataFrame(list(stored.items()), "repository string, stored bigint")
    got = incremental.fetch_budget(candidates, counts, max_new, limit)
    assert {r.pr_number for r in got.collect()} == want


def test_fetch_budget_rejects_a_larger_new_limit(spark):
    df = spark.createDataFrame([], "repository string, stored bigint")
    with pytest.raises(ValueError, match="must not exceed"):
        incremental.fetch_budget(df, df, 10, 5)


def test_invalid_rows_are_quarantined(spark):
    schema = (
        "pr_number bigint, title string, review_count bigint, comment_count bigint, "
        "commit_count bigint, files_changed bigint, additions bigint, deletions bigint"
    )
    rows = [
        (1, "a", 1, 1, 1, 1, 1, 1),
        (2, None, 1, 1, 1, 1, -1, 1),
        (3, "c", 1, 1, 1, 1, 1, -4),
        (4, "d", 1, None, None, 1, None, None),
    ]
    good, bad = validation.split_valid(spark.createDataFrame(rows, schema))
    assert sorted(r.pr_number for r in good.collect()) == [1, 4]
    assert {r.pr_number: r.error for r in bad.collect()} == {
        2: "Missing required PR data field: title",
        3: "Field deletions must be a non-negative number",
    }


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "n int, body string")
    b = spark.createDataFrame([(2,)], "n int")
    assert {tuple(r) for r in pulls.union_all([b, a]).collect()} == {(1, "x"), (2, None)}


def test_fetch_budget_cuts_rows_before_the_shuffle(spark):
    rows = [("r0", n, START, True) for n in range(500)]
    schema = "repository string, pr_number bigint, updated_at timestamp, merged boolean"
    candidates = spark.createDataFrame(rows, schema)
    counts = spark.createDataFrame([], "repository string, stored bigint")
    taken = incremental.fetch_budget(candidates, counts, 100, 1000)
    assert {r.pr_number for r in taken.collect()} == set(range(100))
    assert "WindowGroupLimit [repository#" in taken._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(3))
def test_budget_of_both_needs_against_the_loop(spark, seed):
    """As the collector's loop: skip PRs needing nothing; only merged PRs whose record is
    fetched count toward the limit; every PR taken counts toward max_new."""
    rng = random.Random(seed)
    listed = [(f"r{rng.randrange(3)}", n, START - dt.timedelta(minutes=rng.randrange(0, 3000)), rng.random() < 0.5) for n in range(300)]
    have_pr = {n for _, n, _, _ in listed if rng.random() < 0.4}
    have_ci = {n for n in have_pr if rng.random() < 0.5} | {n for _, n, _, _ in listed if rng.random() < 0.1}
    stored = {f"r{i}": sum(1 for r, n, _, _ in listed if r == f"r{i}" and n in have_pr) for i in range(3)}
    max_new, limit = rng.randrange(10, 60), rng.randrange(60, 140)
    want = set()
    for repo in stored:
        count, processed = stored[repo], 0
        for _, n, _, m in sorted((r for r in listed if r[0] == repo), key=lambda r: (-r[2].timestamp(), r[1])):
            if count >= limit or processed >= max_new:
                break
            need_pr, need_ci = n not in have_pr, n not in have_ci
            if not need_pr and not need_ci:
                continue
            want.add((n, need_pr, need_ci))
            count += need_pr and m
            processed += 1
    df = spark.createDataFrame(listed, "repository string, pr_number bigint, updated_at timestamp, merged boolean")
    keys = spark.createDataFrame([(n,) for n in have_pr], "pr_number bigint")
    runs = spark.createDataFrame([(n,) for n in have_ci], "pr_number bigint")
    counts = spark.createDataFrame(list(stored.items()), "repository string, stored bigint")
    candidates = incremental.needs(df, keys, runs, ("pr_number",))
    got = incremental.fetch_budget(candidates, counts, max_new, limit, counted="counted")
    assert {(r.pr_number, r.need_pr, r.need_ci) for r in got.collect()} == want
    assert any(not pr and ci for _, pr, ci in want)
