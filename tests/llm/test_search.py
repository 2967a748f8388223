import hashlib
import random
import re

from helpers import ODD, docs, nothing, odd

from shipmeter.llm import decontam, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(texts, items, width=10):
    windows = {}
    for name, text in items:
        w = split(text)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(name))
    out = []
    for text in texts:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= names
        out.append((len(w), len(hit), sorted(found)))
    return out


def items_of(spark, pairs):
    return spark.createDataFrame(pairs, "item_id long, text string")


def test_query_equals_brute_force(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in queries.QUERIES["op8_positional_index"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for (i, _), (n, hit, found) in zip(rows, brute([t for _, t in rows], items)):
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        assert (n, hit, len(found), digest, hit > 0) == (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated)


def test_common_words_short_items_and_ties(spark):
    rng = random.Random(4)
    few = list("abcdefg")
    texts = [" ".join(rng.choices(few, k=rng.randrange(60))) for _ in range(60)]
    items = [(1, "a b"), (2, "c"), (3, texts[0]), (4, texts[1] + " zz"), (5, None), (6, "... !"), (7, " ".join(texts[3].split()[5:17])), (3, "g g g")]
    got = {r.doc_id: r for r in decontam.contamination(docs(spark, texts), items_of(spark, items)).collect()}
    for i, want in enumerate(brute(texts, items)):
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == want, i


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    texts = ["p q r s t u v w x y z a b c", "nothing", "k l m n o p q r s t"]
    items = [(i, " ".join(t.split()[i : i + 11])) for i, t in enumerate(texts)]
    one = sorted(decontam.contamination(docs(spark, texts), items_of(spark, items)).collect())
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 8)
    assert sorted(decontam.contamination(docs(spark, texts), items_of(spark, items)).collect()) == one


def test_proximity_matches(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = [item, item.replace("delta", "delta extra"), item.replace("delta", "changed"), "alpha kappa", item.replace("beta gamma", "gamma beta")]
    got = {r.doc_id: r for r in decontam.contamination(docs(spark, texts), items_of(spark, [(1, item)])).collect()}
    assert [got[i].n_hit for i in range(5)] == [10, 0, 0, 0, 0]
    assert [got[i].n_near for i in range(5)] == [0, 1, 1, 0, 1]


def test_odd_rows_and_empty_tables(spark):
    items = items_of(spark, [(1, "two three four"), (None, "one")])
    got = decontam.contamination(odd(spark), items).collect()
    assert len(got) == len(ODD)
    assert sorted(r.doc_id for r in got if r.contaminated) == [6, 7, 7]
    none = items_of(spark, [])
    assert decontam.contamination(odd(spark), none).filter("contaminated").count() == 0
    assert decontam.contamination(nothing(spark), items).count() == 0
