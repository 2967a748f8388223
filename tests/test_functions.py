"""Column functions against hand cases and plain loops."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from shipmeter.functions import scores, times, urls
from shipmeter.operators import pulls
from shipmeter.operators import textfeatures as tf


def values(spark, rows, schema, column):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(column.alias("x")).collect()]


def naive(ts):
    return ts.replace(tzinfo=dt.timezone.utc)


def loop_business_hours(start, end):
    total, day = 0.0, start.date()
    while day <= end.date():
        open_, close = (dt.datetime.combine(day, dt.time(h)) for h in (9, 17))
        if day.weekday() < 5:
            if day == start.date():
                begin = start if 9 <= start.hour <= 17 else None
            else:
                begin = open_
            if begin is not None:
                total += max(0.0, (min(close, end) - begin).total_seconds() / 3600)
        day += dt.timedelta(days=1)
    return total if start < end else 0.0


def test_business_hours_against_a_loop(spark):
    rng = random.Random(7)
    pairs = []
    for _ in range(400):
        start = dt.datetime(2024, 2, 20) + dt.timedelta(seconds=rng.randrange(20 * 86400))
        end = start + dt.timedelta(seconds=rng.randrange(-86400, 15 * 86400))
        pairs.append((start, end))
    pairs += [
        (dt.datetime(2024, 3, 1, 7), dt.datetime(2024, 3, 1, 16)),
        (dt.datetime(2024, 3, 1, 17, 30), dt.datetime(2024, 3, 4, 10)),
        (dt.datetime(1965, 3, 1, 10), dt.datetime(1965, 3, 20, 10)),
    ]
    got = values(
        spark,
        [(naive(a), naive(b)) for a, b in pairs],
        "a timestamp, b timestamp",
        times.business_hours_between(F.col("a"), F.col("b")),
    )
    for (a, b), hours in zip(pairs, got):
        assert abs(hours - loop_business_hours(a, b)) < 1e-9, (a, b)


def test_one_decimal_rounds_the_binary_value(spark):
    rng = random.Random(3)
    xs = [0.05, 0.15, 0.25, 0.35, 1.05, 1.25, 1.35, 2.5, 23.95, 99.95, 0.0, 0.96, -1.25, -0.01]
    xs += [round(rng.uniform(0, 400), 2) for _ in range(3000)]
    xs += [rng.randrange(0, 100_000) / 60 for _ in range(1000)]
    got = values(spark, [(x,) for x in xs], "x double", times.one_decimal(F.col("x")))
    assert got == [f"{x:.1f}" for x in xs]


def test_format_duration(spark):
    got = values(
        spark,
        [(0.999,), (0.5,), (1.0,), (23.9,), (24.0,), (60.0,), (None,)],
        "h double",
        times.format_duration(F.col("h")),
    )
    assert got == ["59 minutes", "30 minutes", "1.0 hours", "23.9 hours", "1.0 days", "2.5 days", None]


def test_parse_duration(spark):
    got = values(
        spark,
        [("30m45s",), ("1h30m",), ("",), ("0s",), ("2H",), ("took 5m, then 7m",), (None,)],
        "s string",
        times.parse_duration(F.col("s")),
    )
    assert got == [1845.0, 5400.0, None, None, 7200.0, 300.0, None]


def test_job_url(spark):
    view = "https://prow.ci.openshift.org/view/gs/results/pull/4595/images/19384"
    base = "https://gcsweb-ci.apps.ci.l2s4.p1.openshiftapps.com/gcs"
    rows = [(view,), (view + "//",), ("https://prow.ci.openshift.org/view/gsx/1",), ("https://x.org",), (None,)]
    want = f"{base}/results/pull/4595/images/19384/prowjob.json"
    assert values(spark, rows, "u string", urls.job_url(F.col("u"))) == [want, want, None, None, None]
    kept = values(spark, rows, "u string", urls.is_ci_run_url(F.col("u")))
    assert kept == [True, True, True, False, False]


def test_bots_are_found_literally(spark):
    rows = [
        ("dependabot[bot]", "User"),
        ("Robot-7", "User"),
        ("bob", "Bot"),
        ("t", None),
        ("Abbott", "User"),
        (None, None),
    ]
    got = values(spark, rows, "login string, kind string", pulls.is_bot(F.col("login"), F.col("kind")))
    assert got == [True, True, True, False, False, False]


def test_score_classes(spark):
    got = values(spark, [(0.5,), (1.5,), (2.5,), (3.5,)], "x double", scores.expected_attempts(F.col("x")))
    assert got == [1, 2, 2, 4]
    got = values(spark, [(-0.2,), (0.5,), (1.7,)], "x double", scores.success_probability(F.col("x")))
    assert got == [0.0, 0.5, 1.0]
    got = values(spark, [(0.5,), (0.51,), (None,)], "x double", scores.likely_outcome(F.col("x")))
    assert got == ["failure", "success", None]
    got = values(spark, [(0.7,), (0.71,), (0.4,), (None,)], "x double", scores.confidence(F.col("x")))
    assert got == ["medium", "high", "low", "low"]


def test_tokens_are_words_of_two_or_more_characters(spark):
    texts = ["Fix a BUG in foo_bar, v2!", "été à la plage", "x", "", "日本語 テスト", "naïve don't", "٣٤ ab"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.tokens for r in tf.with_tokens(df, "text").collect()]
    assert got == [re.findall(r"(?u)\b\w\w+\b", t.lower()) for t in texts]


def test_ngrams_are_formed_after_stop_words(spark):
    df = spark.createDataFrame([("the fast fix of the build",), ("fix",), (None,)], "text string")
    got = [r.ngrams for r in tf.with_ngrams(df, "text").collect()]
    assert got == [["fast", "fix", "build", "fast fix", "fix build"], ["fix"], []]


def test_pr_text_trims_missing_parts(spark):
    rows = [("a", "b"), (None, "b"), ("a", None), (None, None)]
    got = values(spark, rows, "t string, b string", tf.pr_text(F.col("t"), F.col("b")))
    assert got == ["a b", "b", "a", ""]


def test_stop_words_are_sparks_own_without_contractions(spark):
    from pyspark.ml.feature import StopWordsRemover

    from shipmeter.operators.textfeatures import ENGLISH_STOP_WORDS

    own = {w for w in StopWordsRemover.loadDefaultStopWords("english") if "'" not in w}
    assert set(ENGLISH_STOP_WORDS) == own


def test_vocabulary_counts_only_pairs_that_can_be_terms(spark, monkeypatch):
    import random
    from collections import Counter

    from shipmeter.operators import textfeatures as tf

    rng = random.Random(4)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.08)), 200)}" for _ in range(rng.randint(0, 30))) for _ in range(300)]
    config = tf.TextConfig(max_features=12, min_df=3, max_df=0.6, weight=1.0, prefix="x", stop_words=())
    grams = tf.with_ngrams(spark.createDataFrame([(t,) for t in texts], "text string"), "text", config)
    counted, frames = tf._counted, []
    monkeypatch.setattr(tf, "_counted", lambda *a: frames.append(counted(*a)) or frames[-1])
    got = [(r.term, r.df, r.term_count) for r in tf.vocabulary(grams, config).orderBy("position").collect()]

    df, count = Counter(), Counter()
    for t in texts:
        words = t.split()
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        count.update(terms)
        df.update(set(terms))
    kept = [t for t in count if 3 <= df[t] <= 0.6 * len(texts)]
    best = sorted(sorted(kept, key=lambda t: (-count[t], t))[:12])
    assert got == [(t, df[t], count[t]) for t in best]
    assert frames[1].count() < sum(" " in t for t in count) / 4  # the other pairs are never shuffled
