import numpy as np
from helpers import ODD, docs, nothing, odd
from pyspark.sql import functions as F

from shipmeter.llm import imatch, quality, queries, toxicity, ziplang


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_language_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = by_id(queries.QUERIES["op3_compression_language"](spark, folder))
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    held = [r for r in rows if got[r.doc_id].held_out]
    assert len(got) == len(rows) and 100 < len(held) < 300
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edge_rows(spark):
    taught = docs(spark, ["the cat and the dog", "der hund und die katze", None, "42"]).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    model = ziplang.fit(taught)
    assert set(model) == {"en", "de"}
    got = ziplang.predict(odd(spark), model).collect()
    assert len(got) == len(ODD)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3, 4, 11))
    assert ziplang.fit(nothing(spark)) == {} and ziplang.predict(nothing(spark), {}).count() == 0
    assert {r.lang_pred for r in ziplang.predict(odd(spark), {}).collect()} == {"und"}


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable"))
    y = np.asarray(y)
    return (order[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


def held_out(spark, query, label, size="sf0.01"):
    folder = f"/root/testdata/{size}"
    got = by_id(queries.QUERIES[query](spark, folder))
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    labels = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert all(0 <= r.score <= 1 for r in got.values())
    return auc([r[label] for r in labels], [got[r.doc_id].score for r in labels])


def test_toxicity_held_out(spark):
    assert held_out(spark, "op5_kneser_ney_toxicity", "toxic", "sf0.1") > 0.95


def test_quality_held_out(spark):
    assert held_out(spark, "op7_random_indexing_quality", "quality") > 0.9


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.3, (toxicity.SIZE, toxicity.SIZE)).astype(float)
    counts[5] = 0
    assert np.allclose(np.exp(toxicity.kneser_ney(counts, counts * 2)).sum(axis=1), 1)


def test_gains_cover_every_word(spark):
    """Words beyond any fixed number, each in few texts, get the gain of the dense models."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 2500, 40)) for _ in range(60)]
    label = [None if i % 3 == 2 else i % 3 for i in range(60)]
    marked = spark.createDataFrame(list(zip(texts, label)), "text string, label int")
    counts = toxicity._counted(marked)
    got = {r.pair: r.ratio for r in toxicity.gains(counts).collect()}
    p = toxicity._pairs(pa.array(texts))
    names = np.unique(np.concatenate((p.before, p.word)))
    assert len(names) > 1100 and set(got) == set(p.pair.tolist())
    u, w = np.searchsorted(names, p.before), np.searchsorted(names, p.word)
    grid = np.zeros((3, len(names), len(names)))
    for i, a, b, times in zip(p.row, u, w, p.times):
        grid[2 if label[i] is None else label[i], a, b] += times
    seen = grid.sum(axis=0)[:, names != 0]  # nothing comes before a start
    plain, toxic = (toxicity.kneser_ney(grid[c][:, names != 0], seen) for c in (0, 1))
    column = np.cumsum(names != 0) - 1
    assert np.allclose([got[k] for k in p.pair.tolist()], (toxic - plain)[u, column[w]])


def some_texts(seed, n, length, names):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{k}" for k in rng.zipf(1.3, length) % names) for _ in range(n)]


def test_bigrams_are_dealt_in_few_bytes(spark):
    texts = some_texts(4, 60, 4000, 20_000)
    marked = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts)], "text string, label int").coalesce(1)
    bigrams = len({(a, b) for t in texts for a, b in zip(["", *t.split()], t.split())})
    for texts_too, most in ((False, 8), (True, 12)):
        blocks = toxicity._counted(marked, texts=texts_too)
        size = sum(len(v) for r in blocks.collect() for v in r if isinstance(v, (bytes, bytearray)))
        assert bigrams > 60_000 and size < most * bigrams


def test_texts_sum_their_gains(spark):
    """Also copies in other partitions, texts without words and texts that the fit did not see."""
    import pyarrow as pa

    texts = some_texts(5, 80, 60, 900) + [None, "", "?", "solo"]
    texts += texts[:30]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(0, 100, 2)], "doc_id long, toxic int")
    model, every = toxicity.fit(docs, labels, F.lit(False))
    gain = {r.pair: r.gain for r in toxicity.gains(model.counts, model.buckets).collect()}
    assert sum(g != 0 for g in gain.values()) > 500
    other = some_texts(6, 10, 40, 900) + ["solo solo", "never seen"]
    seen = every.unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(other + other[:3])], "id long, text string"))
    got = {r.id: r for r in toxicity._gained(seen, model).collect()}
    assert len(got) == len(texts) + len(other) + 3
    for i, t in [*rows, *((1000 + i, t) for i, t in enumerate(other + other[:3]))]:
        p = toxicity._pairs(pa.array([t], pa.string()))
        assert got[i].n == p.times.sum()
        assert np.isclose(got[i].gain, sum(gain.get(k, 0.0) * n for k, n in zip(p.pair.tolist(), p.times.tolist())))


def test_folded_buckets_sum_alike(spark):
    texts = some_texts(8, 40, 80, 500)
    marked = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts)], "text string, label int").repartition(3)
    contexts = toxicity._contexts(toxicity._counted(marked, 12), 12).cache()
    one, four = (toxicity._sums(marked, contexts, 12, fold).collect() for fold in (1, 4))
    assert len(one) == len(texts) and any(r.gain for r in one)
    assert {r.digest: round(r.gain, 9) for r in one} == {r.digest: round(r.gain, 9) for r in four}


def test_few_bits_tell_hashes_apart():
    rng = np.random.default_rng(7)
    hashes = np.unique(rng.integers(0, 2**64, 100_000, np.uint64))
    bits = toxicity._bits(hashes)
    cut = toxicity._unpack_hashes(toxicity._pack_hashes(hashes, bits), bits)
    assert 32 < bits < 64 and len(np.unique(cut)) == len(hashes)
    assert len(np.unique(hashes >> np.uint64(65 - bits))) < len(hashes)
    assert toxicity._bits(hashes[:1]) == toxicity._bits(hashes[:0]) == 32


def test_rare_words_tell(spark):
    """2000 toxic words, each in five of 60 000 texts: more than a fixed list or a sample holds."""
    ids = spark.range(60_000).withColumnRenamed("id", "doc_id").withColumn("toxic", (F.col("doc_id") % 6 == 0).cast("int"))
    plain = [F.concat(F.lit("w"), F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(50))) for i in range(4)]
    own = F.concat(F.when(F.col("toxic") == 1, "slur").otherwise("w"), F.when(F.col("toxic") == 1, F.pmod(F.floor(F.col("doc_id") / 6), F.lit(2000))).otherwise(F.pmod(F.hash("doc_id"), F.lit(50))))
    docs = ids.select("doc_id", F.concat_ws(" ", *plain, own).alias("text"))
    got = toxicity.score_documents(docs, ids, F.pmod(F.hash("id"), F.lit(10)) == 0)
    held = got.filter(F.pmod(F.hash("doc_id"), F.lit(10)) == 0).collect()
    assert auc([int(r.doc_id % 6 == 0) for r in held], [r.score for r in held]) > 0.9


def test_filtering_equals_scoring(spark, sf_dir):
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model, every = toxicity.fit(documents, labels, F.lit(False))
    low = {r.doc_id for r in toxicity.score(every, model).collect() if r.score < 0.5}
    kept = toxicity.without_toxic(documents, model)
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == low


def test_toxicity_edge_rows(spark):
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, 1), (7, 0), (8, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    none = labels.filter("toxic = 9")
    for df, n in ((odd(spark), len(ODD)), (nothing(spark), 0)):
        for given in (labels, none):
            got = toxicity.score_documents(df, given, F.lit(False)).collect()
            assert len(got) == n and all(0 <= r.score <= 1 for r in got)


def test_quality_edge_rows(spark):
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, 1), (7, 0), (8, None), (None, 1), (99, 1)], "doc_id long, quality int")
    for df, n in ((odd(spark), len(ODD)), (nothing(spark), 0)):
        model = quality.fit(df, labels if n else labels.filter("quality = 9"), F.lit(False))
        got = quality.score_documents(df, model).collect()
        assert len(got) == n and all(0 <= r.score <= 1 for r in got)


def test_pooling_is_the_same_in_stretches(monkeypatch):
    import pyarrow as pa

    table = np.random.default_rng(2).normal(size=(quality.TERMS, quality.DIM))
    texts = pa.array(["A b c!! d", None, "", "Ha Ha Ha " * 40, "x | y | z"])
    whole = quality.pooled(texts, table)
    monkeypatch.setattr(quality, "STRETCH", 7)
    assert np.allclose(whole, quality.pooled(texts, table))


def test_edit_test_equals_brute_force(spark, sf_dir):
    import hashlib

    got = by_id(queries.QUERIES["op6_imatch"](spark, sf_dir))
    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    prints = {}
    for k, (i, text) in enumerate(rows):
        after, cut = rows[(k + 1) % len(rows)][1], len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text)
        assert prints.setdefault(text, got[i].fingerprint) == got[i].fingerprint
        assert got[i].near_edited == 1 or got[i].fingerprint != got[i].edited_fingerprint
    edited, other = np.array([r.near_edited for r in got.values()]), np.array([r.near_next for r in got.values()])
    assert edited.mean() > 0.3 and other.mean() < 0.1


def test_following_crosses_ranges(spark):
    rows = spark.createDataFrame([(i * 7 % 101, 0, 1) for i in range(101)] + [(None, 3, 1)], "id long, key long, n int")
    got = {r.id: r.next_id for r in imatch.following(rows).collect()}
    assert got == {i: i - 1 for i in range(1, 101)} | {0: None, None: 100}


def test_edit_test_deals_texts_once(spark, monkeypatch):
    plans, write = {}, imatch.materialize

    def spy(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(imatch, "materialize", spy)
    rows = [(i, f"common w{i % 5} x{i}") for i in range(40)] + [(None, "no id"), (None, "none again"), (7, "common seven twice")]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = imatch.edit_test(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 2
    # the joins hash the same columns as the window that drops repeats, so its exchange serves them
    dealt = [line.split("Exchange ")[1] for line in plans["prints"].splitlines() if "Exchange hashpartitioning(" in line]
    assert dealt and not any("isnull(" in line or "coalesce(" in line for line in dealt)


def test_imatch_edge_rows(spark):
    got = imatch.edit_test(odd(spark)).collect()
    assert len(got) == len(ODD) - 1  # one row per distinct id and text
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and r.fingerprint for r in got)
    one = imatch.edit_test(docs(spark, ["alone here"])).collect()
    assert len(one) == 1 and one[0].n_chars == 10
    assert imatch.edit_test(nothing(spark)).count() == 0
    same = {r.doc_id: r.fingerprint for r in imatch.fingerprints(odd(spark)).collect()}
    assert same[6] == same[7] and same[1] == same[2]
