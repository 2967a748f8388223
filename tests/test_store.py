"""The keyed store, document scans and file formats."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from shipmeter.operators import ci
from shipmeter.schemas import PULL_REQUEST, conform
from shipmeter.sources import documents
from shipmeter.sources.store import Store, with_ci

UTC = dt.timezone.utc
DAYS = [dt.datetime(2024, 6, d, tzinfo=UTC) for d in range(1, 9)]


def fresh():
    return tempfile.mkdtemp(prefix="run-") + "/data"


def prs(spark, rows):
    base = spark.createDataFrame(
        rows, "repository string, pr_number bigint, title string, additions bigint, merged_at timestamp"
    )
    return conform(base, PULL_REQUEST)


def no_ci(df):
    return df.withColumns(
        {"ci_digest": F.lit(None).cast("string"), "ci_run_count": F.lit(0).cast("long")}
    )


def state(store):
    return {(r.repository, r.pr_number): r.additions for r in store.rows().collect()}


def test_upsert_appends_only_changes(spark):
    store = Store(spark, fresh())
    assert state(store) == {}
    first = [("o/a_b", 1, "x", 10, DAYS[0]), ("o/a_b", 2, "y", 20, DAYS[0]), ("o/c", 1, "z", 5, None)]
    store.upsert(no_ci(prs(spark, first)), DAYS[1])
    assert state(store) == {("o/a_b", 1): 10, ("o/a_b", 2): 20}  # unmerged without CI is not stored
    store.upsert(no_ci(prs(spark, first)), DAYS[2])
    assert store.versions().count() == 2
    store.upsert(no_ci(prs(spark, [("o/a_b", 2, "y", 21, DAYS[0])])), DAYS[3])
    assert state(store) == {("o/a_b", 1): 10, ("o/a_b", 2): 21}
    assert store.versions().count() == 3
    assert store.rows(["o/none"]).count() == 0


def test_new_ci_on_an_unchanged_pr_is_a_change(spark):
    store = Store(spark, fresh())
    rows = prs(spark, [("o/r", 1, "x", 10, DAYS[0])])
    store.upsert(no_ci(rows), DAYS[1])
    runs = spark.createDataFrame(
        [("o/r", 1, 0, "build", "u", "success", 3.0), ("o/r", 2, 0, "build", "u", "error", None)],
        "repository string, pr_number bigint, ordinal int, ci_name string, ci_target_url string, ci_state string, ci_duration_seconds double",
    )
    store.upsert(with_ci(rows, ci.ci_digest(runs)), DAYS[2])
    assert {tuple(r) for r in store.pr_keys(with_ci_only=True).collect()} == {("o/r", 1), ("o/r", 2)}
    assert store.versions().count() == 3
    shuffled = runs.repartition(3).orderBy(F.desc("pr_number"))
    store.upsert(with_ci(rows, ci.ci_digest(shuffled)), DAYS[3])
    assert store.versions().count() == 3  # order of runs is no change


def test_clear_and_compact(spark):
    store = Store(spark, fresh())
    store.upsert(no_ci(prs(spark, [("o/a", n, "x", n, DAYS[0]) for n in range(1, 4)] + [("o/b", 1, "x", 9, DAYS[0])])), DAYS[1])
    assert store.clear("o/a", DAYS[2]) == 3
    assert state(store) == {("o/b", 1): 9}
    store.upsert(no_ci(prs(spark, [("o/a", 1, "x", 1, DAYS[0])])), DAYS[3])
    assert state(store) == {("o/a", 1): 1, ("o/b", 1): 9}
    smaller = store.compact(fresh())
    assert state(smaller) == state(store) and smaller.versions().count() == 2


def test_unreadable_documents_are_skipped(spark):
    path = fresh()
    lines = [
        ("o/r", '{"pr_number": 1, "title": "a", "created_at": "2024-01-15T10:30:00+00:00", "ci_data": [{"ci_name": "build"}]}'),
        ("o/r", '{"pr_number": 2, "tit'),
        ("o/s", '{"pr_number": 3, "title": "c"}'),
    ]
    spark.createDataFrame(lines, "repository string, value string").write.partitionBy("repository").text(path)
    docs = documents.scan_documents(spark, path)
    assert {(r.repository, r.pr_number, r.title) for r in docs.collect()} == {("o/r", 1, "a"), ("o/s", 3, "c")}
    assert docs.where("pr_number = 1").first().created_at.isoformat() == "2024-01-15T10:30:00"
    assert [r.ci_name for r in ci.explode_ci(docs).collect()] == ["build"]
    pruned = documents.scan_documents(spark, path, ["o/s", "o/absent"])
    assert [r.pr_number for r in pruned.collect()] == [3]
    assert "PartitionFilters: [isnotnull(repository" in pruned._jdf.queryExecution().toString() or (
        "repository" in pruned._jdf.queryExecution().toString().split("PartitionFilters")[1][:80]
    )


def test_one_document_per_file(spark):
    path = fresh()
    text = '{\n  "pr_number": 7,\n  "title": "a",\n  "repository": "o/r"\n}'
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    assert documents.scan_documents(spark, path, multi_line=True).first().pr_number == 7


def test_csv_keeps_text_as_it_is(spark):
    path = fresh()
    rows = [
        ("o/r", 1, ' padded "quoted", comma ', 1, DAYS[0]),
        ("o/r", 2, "two\nlines\\", None, None),
        ("o/r", 3, "", 3, DAYS[1]),
        ("o/r", 4, None, 4, DAYS[1]),
    ]
    df = prs(spark, rows)
    documents.write_csv(df, path)
    back = documents.read_csv(spark, path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_repository_list(spark):
    path = fresh()
    lines = ["org/machinery", "", "# note", "  org/building  ", "   # indented"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    got = {r.repository for r in documents.scan_repo_list(spark, path).collect()}
    assert got == {"org/machinery", "org/building"}


def test_loads_are_atomic_and_checked(spark):
    store = Store(spark, fresh())
    rows = no_ci(prs(spark, [("o/a", 1, "x", 1, DAYS[0]), ("o/a", 2, "y", 2, DAYS[0])]))

    class Broken(Exception):
        pass

    def breaks():
        raise Broken()

    runs = spark.createDataFrame(
        [("o/a", 1, 0, "build", "u", "success", 3.0)],
        "repository string, pr_number bigint, ordinal int, ci_name string, ci_target_url string, ci_state string, ci_duration_seconds double",
    )
    try:
        store.upsert(rows, DAYS[1], runs, between=breaks)
    except Broken:
        pass
    assert state(store) == {} and store.runs().count() == 0  # its runs were written, never seen
    later = no_ci(prs(spark, [("o/a", 2, "y", 20, DAYS[0]), ("o/b", 1, "z", 5, DAYS[0])]))
    store.upsert(rows, DAYS[1], between=lambda: store.upsert(later, DAYS[2]))
    assert state(store) == {("o/a", 1): 1, ("o/a", 2): 20, ("o/b", 1): 5}
    assert store._version() == 2 and store.versions().count() == 4
    store.upsert(later, DAYS[3])
    assert store._version() == 2  # nothing new: no load


def test_loads_build_their_records_once(spark, sf_dir):
    from shipmeter.plans import queries

    lazy, lazy_in = queries._stored_and_incoming(spark, sf_dir)
    once, once_in = queries._stored_and_incoming(spark, sf_dir, write=True)
    for a, b in ((lazy, once), (lazy_in, once_in)):
        b = b.select(*a.columns)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    # a load reads the written table; no join or scan of the given tables is left in its plan
    for df in (once, once_in):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
