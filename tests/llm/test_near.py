import random

import numpy as np
import pyarrow as pa
from helpers import docs, nothing, odd
from pyspark.sql import functions as F

from shipmeter.llm import dartminhash as d
from shipmeter.llm.lexer import shingles, words


def brute(texts):
    """Classes from all pairs, as the least index of each."""
    column, row = d.elements(pa.array(texts))
    sets = [set(column[row == i].tolist()) for i in range(len(texts))]
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if texts[i] == texts[j] or both and both >= d.SIMILARITY * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(texts))]


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([4, 30, 120, 400]))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    return texts


def test_classes_equal_all_pairs(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        got = {r.doc_id: r.class_id for r in d.near_duplicates(docs(spark, texts)).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts)


def test_a_large_group_is_one_class(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(200)] = f"x{i}"
        texts.append(" ".join(copy))
    got = d.near_duplicates(docs(spark, texts)).collect()
    want = brute(texts)
    assert sum(r.class_id != want[r.doc_id] for r in got) <= 2


def test_few_pairs_at_the_threshold_share_no_bucket():
    assert (1 - d.SIMILARITY**d.ROWS) ** d.BANDS < 0.003


def test_pairs_inside_a_crowded_group_meet(spark, monkeypatch):
    """Similar pairs whose buckets are those of a large group, with a centre like none of them."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)]
    for i in range(40):
        own = {k: f"x{i}" for k in rng.sample(range(3, 197), 9)}
        for j in range(2):
            copy = [own.get(k, w) for k, w in enumerate(base)]
            copy[rng.randrange(200)] = f"y{i}_{j}"
            texts.append(" ".join(copy))
    plain = d.signatures

    def crowded(df, id_col="doc_id", text_col="text"):
        return plain(df, id_col, text_col).withColumn("buckets", F.array(F.lit(1).cast("long")))

    monkeypatch.setattr(d, "signatures", crowded)
    got = {r.doc_id: r.class_id for r in d.near_duplicates(docs(spark, texts)).collect()}
    want = brute(texts)
    assert len(set(want)) > 30 and [got[i] for i in range(len(texts))] == want


def test_signatures_estimate_weighted_similarity():
    a = " ".join(f"a{i}" for i in range(300))
    b = a.replace("a150 ", "z ").replace("a20 ", "y ")
    c = a + " " + a
    column, row = d.elements(pa.array([a, b, c]))
    dots = d.sketch(column, row, 3, 2048)
    sets = [set(column[row == i].tolist()) for i in range(3)]
    for i, j in ((0, 1), (0, 2), (1, 2)):
        exact = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
        assert abs((dots[i] == dots[j]).mean() - exact) < 0.05


def test_every_coordinate_is_hit_whatever_the_length():
    texts = ["one two", " ".join(map(str, range(50))), " ".join(map(str, range(30_000)))]
    column, row = d.elements(pa.array(texts))
    assert (d.sketch(column, row, 3) != 0).all()


def test_words_and_shingles():
    w = words(pa.array(["Ab, cd-EF", None, "", "ab CD ef", "é"]))
    assert w.first.tolist() == [0, 3, 3, 3, 6, 7]
    assert (w.hashes[:3] == w.hashes[3:6]).all()
    hashes, row = shingles(w, 5)
    assert row.tolist() == [0, 3, 4] and hashes[0] == hashes[1] != hashes[2]
    assert len(np.unique(words(pa.array([" ".join(map(str, range(5000)))])).hashes)) == 5000


def test_odd_rows(spark):
    got = {r.doc_id: r.class_id for r in d.near_duplicates(odd(spark)).collect()}
    assert set(got) == set(range(1, 12))
    assert got[1] == got[2] == got[11] == 1  # null is empty
    assert got[3] == 3 and got[4] == 4  # no words: only equal texts
    assert got[6] == got[7] == 6 and got[5] == 5


def test_rows_of_one_id_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, "c")], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in d.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_empty_table(spark):
    assert d.near_duplicates(nothing(spark)).count() == 0
