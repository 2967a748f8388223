"""Registered queries over ``documents``: one thin query for each operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipmeter.llm import (
    convrepair, dartminhash, decontam, filteraudit, imatch, metricjoin, quality, secretscan, segbpe, surrogates, tokencount,
    toxicity, ziplang,
)
from shipmeter.llm.oracles import ORACLES as ORACLES
from shipmeter.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

TOKEN_LIMIT = 1024
SURROGATE_KEY = "test key; production passes its own secret"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts, a digest of the base spans and all spans."""
    found = secretscan.scan(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.kind.isin("assign", "access", "hex"))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secretscan.spelled(base), 256).alias("base_sha256"), secretscan.spelled(F.col("spans")).alias("spans"),
    )


def remainder(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string")) % n


@query
def op3_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    taught = docs.filter(remainder("doc_id", 5) != 0)
    judged = ziplang.predict(docs, ziplang.fit(taught))
    return judged.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    replaced = surrogates.replace(table(spark, sf_dir, "documents"), SURROGATE_KEY)
    return replaced.select("doc_id", "text", "n_entities", "kinds")


@query
def op5_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score_documents(docs, labels, remainder("id", 5) == 0)
    return scored.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    tested = imatch.edit_test(table(spark, sf_dir, "documents"))
    return tested.withColumns({c: imatch.spelled(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})


@query
def op7_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score_documents(docs, quality.fit(docs, labels, remainder("id", 4) == 2))
    return scored.select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query
def op8_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", listed, "contaminated")


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the byte-level vocabulary."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = tokencount.count_tokens(table(spark, sf_dir, "documents"), path)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op10_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = segbpe.encode_decode(table(spark, sf_dir, "documents"), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op11_hirschberg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and its digest for every conversation."""
    return convrepair.repair(table(spark, sf_dir, "conversations"))


@query
def op12_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every embedding."""
    return metricjoin.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op13_packed_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their orders, per source."""
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
