"""Language by compression: the dictionary that makes a text smallest names its language.

Each language has a raw-content zstandard dictionary made from a bounded sample of
labelled rows.  A text is reduced to its letters, cut into chunks of ``CHUNK`` bytes so that
the dictionary matters throughout a long text, and every chunk is compressed with every
dictionary.  The smallest total wins; a narrow margin is rejected.  Scoring is one map
step without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shipmeter.llm.shipping import ship

SAMPLE_DOCS = 96  # labelled rows per language
PIECE = 2048  # code points of each that go into the dictionary
CHUNK = 4096
LEVEL = 3
MARGIN = 0.01  # a lead of less than this share of the runner-up's size is rejected
SOFTNESS = 8.0  # bytes
UNKNOWN = "und"

_NOT_LETTERS = regex.compile(r"[^\p{L}]+")


def letters(text: str) -> str:
    """Lower-case words; one space between them and at both ends."""
    body = _NOT_LETTERS.sub(" ", text.lower()).strip()
    return f" {body} " if body else ""


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> dict[str, bytes]:
    """A dictionary for each language of ``docs``, most frequent language first.

    Takes the ``SAMPLE_DOCS`` rows of each language with the least hash of their id, so
    at most that many pieces of ``PIECE`` code points per language reach the driver.  Rows
    without a language or without letters teach nothing.
    """
    rows = docs.select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col)).alias("order"), F.col(text_col).cast("string").alias("text")
    ).filter("lang is not null and text rlike '\\\\p{L}'")
    shares = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", F.xxhash64("text")))
    picked = rows.withColumn("rank", rank).filter(F.col("rank") <= SAMPLE_DOCS)
    made: dict[str, list[str]] = {}
    for r in picked.select("lang", "rank", F.substring("text", 1, PIECE).alias("text")).orderBy("lang", "rank").collect():
        made.setdefault(r.lang, []).append(letters(r.text))
    order = sorted(made, key=lambda x: (-shares[x], x))
    return {lang: "".join(made[lang]).encode() for lang in order}


class Judge:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = list(dictionaries)
        self._by = []
        for raw in dictionaries.values():
            held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self._by.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False
                ).compress
            )

    def sizes(self, body: str) -> list[int]:
        data = body.encode()
        chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        return [sum(len(compress(c)) for c in chunks) for compress in self._by]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin is too narrow."""
        body = letters(text) if text else ""
        if not body or not self.langs:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(body)
        best = min(range(len(sizes)), key=sizes.__getitem__)  # of equals the most frequent language
        rest = [s for i, s in enumerate(sizes) if i != best]
        score = 1.0 / (1.0 + sum(exp(max(-700.0, (sizes[best] - s) / SOFTNESS)) for s in rest))
        narrow = bool(rest) and min(rest) - sizes[best] < MARGIN * min(rest)
        return self.langs[best], score, narrow


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` (0 to 1) and ``rejected`` for every row.

    Null texts and texts without letters are ``und`` with score 0.  ``rejected`` marks a
    narrow margin; ``lang_pred`` still names the smallest.  Repeated rows are judged each;
    other columns are not read.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(dictionaries).judge
        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column(1)]
            langs, scores, narrow = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(narrow, pa.bool_())],
                ["id", "lang_pred", "score", "rejected"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_col)
