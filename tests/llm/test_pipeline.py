from helpers import ODD, SCHEMA, nothing, row
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as p
from shipmeter.llm import decontam, dartminhash, segbpe, toxicity


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_stages_equal_their_operators(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, items = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    left = {r.doc_id: r for r in docs.collect()}
    scores = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels, F.lit(False)).collect()}
    left = {i: r for i, r in left.items() if scores[i] < 0.5}

    def frame():
        return spark.createDataFrame(list(left.values()), docs.schema)

    classes = {r.doc_id: r.class_id for r in dartminhash.near_duplicates(frame()).collect()}
    left = {i: r for i, r in left.items() if classes[i] == i}
    hit = {r.doc_id for r in decontam.contamination(frame(), items).collect() if r.contaminated}
    left = {i: r for i, r in left.items() if i not in hit}
    got = {r.doc_id: r for r in p.run(spark, sf_dir).collect()}
    assert set(got) == set(left) and 0 < len(hit) < 20
    codec = segbpe.Codec(open(p.public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    clean = [i for i in left if not any(c in left[i].text for c in "@0123456789")]
    assert len(clean) > 50
    for i in clean:
        ids = next(iter(codec.encode_all([left[i].text])))
        assert got[i].ids == ids and got[i].decoded == codec.decode(ids)


def test_stages_take_odd_rows_and_empty_tables(spark, sf_dir):
    for docs in (spark.createDataFrame(ODD + [row(12, "mail a.b@c.org now")], SCHEMA), nothing(spark)):
        columns = docs.columns
        for name, stage in p.STAGES[:-1]:
            docs = p.materialize(stage(spark, docs, sf_dir), name)
            assert docs.columns == columns, name
        out = p.encode(spark, docs, sf_dir).collect()
        ids = sorted(r.doc_id for r in out if r.doc_id is not None)
        assert ids in ([], [1, 3, 4, 5, 6, 8, 9, 10, 12])
