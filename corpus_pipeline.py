"""From raw documents to encoded training text, stage by stage.

Each stage works on all rows that the one before it kept.  The first three drop whole
documents, the fourth rewrites texts, the last encodes them.  A null text counts as empty
throughout and stays null up to the last stage; extra columns are carried up to there.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shipmeter.llm import dartminhash, decontam, segbpe, surrogates, toxicity
from shipmeter.session import materialize, prepare

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

SURROGATE_KEY = "pipeline key; production passes its own secret"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score is 0.5 or more; all labels teach."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model, _ = toxicity.fit(docs, labels, F.lit(False))
    return toxicity.without_toxic(docs, model)


# Ids that stay or go grow with the corpus, so their joins merge and never broadcast.


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one of the least id.

    Rows that share an id are one document: the row with the least hash of its text stays.
    Rows with a null id belong to no class and stay.
    """
    stays = dartminhash.near_duplicates(docs).filter("class_id = doc_id").select(F.col("doc_id").alias("kept_id"))
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("print"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("print"))
    single = held.filter("id is not null").withColumn("nth", nth).filter("nth = 1")
    chosen = single.join(stays.hint("merge"), F.col("id") == F.col("kept_id"), "left_semi").select("row.*")
    return chosen.unionByName(docs.filter("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item; rows of one id go together."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontam.contamination(docs, items).filter("contaminated").select(F.col("doc_id").alias("hit_id")).distinct()
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"))
    return held.join(hit.hint("merge"), F.col("id").eqNullSafe(F.col("hit_id")), "left_anti").select("row.*")


def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; ``n_chars`` follows the new text."""
    made = surrogates.replace(docs, SURROGATE_KEY).select(*docs.columns)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return made


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each document that is left."""
    return segbpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", replace_personal),
    ("encoding", encode),
]

#: No SQL: learned scores and merges are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again by the next."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
