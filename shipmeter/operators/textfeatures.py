"""TF-IDF text features.

Tokens are words of two or more characters, stop words go before n-grams are
formed, the document-frequency limits come before the cut to the most frequent
terms, and weights are ``(1 + ln tf) (ln((1 + n) / (1 + df)) + 1)`` with unit
length per document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipmeter.session import materialize

# Spark's own English list without its contractions, which the
# tokenizer splits anyway.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did "
    "doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very s t can will just don should now cannot could "
    "ought would"
).split()

#: Runs of letters, digits and underscores; combining marks end a word.
WORD = r"[\p{L}\p{N}_]{2,}"


@dataclass(frozen=True)
class TextConfig:
    """Limits of a vocabulary: absolute lower and relative upper document frequency."""

    max_features: int
    min_df: int
    max_df: float
    weight: float
    prefix: str
    stop_words: tuple[str, ...] = tuple(ENGLISH_STOP_WORDS)


PR_TEXT = TextConfig(max_features=50, min_df=2, max_df=0.8, weight=0.3, prefix="tfidf_")
CI_TEXT = TextConfig(max_features=30, min_df=1, max_df=0.9, weight=0.2, prefix="ci_tfidf_")


def pr_text(title: Column, body: Column) -> Column:
    """Title and body as one text; a missing one is empty."""
    return F.trim(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))))


def with_tokens(df: DataFrame, text: str, out: str = "tokens") -> DataFrame:
    """A JVM transformer: lower case, then every match of the word pattern."""
    filled = df.withColumn("_text", F.coalesce(text, F.lit("")))
    words = RegexTokenizer(
        inputCol="_text", outputCol=out, pattern=WORD, gaps=False, toLowercase=True, minTokenLength=2
    )
    return words.transform(filled).drop("_text")


def without_stop_words(df: DataFrame, tokens: str = "tokens", out: str = "words", stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """Hash lookups per token; tokens are lower case already."""
    remover = StopWordsRemover(
        inputCol=tokens, outputCol=out, stopWords=list(stop_words), caseSensitive=True
    )
    return remover.transform(df)


def unigrams_and_bigrams(words: Column) -> Column:
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(words, pairs)


def with_ngrams(df: DataFrame, text: str, config: TextConfig = PR_TEXT, out: str = "ngrams") -> DataFrame:
    tokens = with_tokens(df, text, "_tokens")
    words = without_stop_words(tokens, "_tokens", "_words", config.stop_words)
    return words.withColumn(out, unigrams_and_bigrams(F.col("_words"))).drop("_tokens", "_words")


#: Frequent words that may be named in the filter of the pairs; more, and all pairs are counted.
MAX_NAMED = 2_000


def _counted(grams: DataFrame, terms: Column) -> DataFrame:
    """``term, df, term_count`` over arrays of terms: one shuffle on the term, with partial
    sums before it; no row per document and term is shuffled."""
    marks = F.concat(
        F.transform(F.array_distinct(terms), lambda t: F.struct(t.alias("term"), F.lit(1).alias("d"), F.lit(0).alias("c"))),
        F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(0).alias("d"), F.lit(1).alias("c"))),
    )
    return (
        grams.select(F.explode(marks).alias("_m"))
        .groupBy(F.col("_m.term").alias("term"))
        .agg(F.sum("_m.d").alias("df"), F.sum("_m.c").alias("term_count"))
    )


def vocabulary(grams: DataFrame, config: TextConfig = PR_TEXT, ngrams: str = "ngrams") -> DataFrame:
    """Terms with document frequency, corpus count, ``idf`` and position.

    Ties at the cut go by term, and positions are alphabetical.  Words (terms without a
    space) are counted first.  A pair occurs no more often than either of its words, so
    once ``max_features`` words stay within the limits, only pairs of words that occur as
    often as the last of them can be among the terms; all other pairs need no count.
    """
    documents = grams.agg(F.count("*").alias("n")).scalar()
    allowed = (F.col("df") >= config.min_df) & (F.col("df") <= F.lit(config.max_df) * documents)
    is_pair = lambda t: F.contains(t, F.lit(" "))
    words = materialize(_counted(grams, F.filter(ngrams, lambda t: ~is_pair(t))), "word-counts")
    best = words.where(allowed).orderBy(F.desc("term_count"), "term").limit(config.max_features)
    last = best.agg(F.count("*").alias("n"), F.min("term_count").alias("least")).first()
    pairs = F.filter(ngrams, is_pair)
    if last["n"] == config.max_features > 0:
        frequent = [r["term"] for r in words.where(F.col("term_count") >= last["least"]).select("term").limit(MAX_NAMED + 1).collect()]
        if len(frequent) <= MAX_NAMED:
            ends = lambda t: (F.substring_index(t, " ", 1), F.substring_index(t, " ", -1))
            pairs = F.filter(ngrams, lambda t: is_pair(t) & ends(t)[0].isin(frequent) & ends(t)[1].isin(frequent))
    kept = (
        words.unionByName(_counted(grams, pairs))
        .where(allowed)
        .orderBy(F.desc("term_count"), "term")
        .limit(config.max_features)
    )
    # At most max_features terms from here on.
    terms = F.sort_array(F.collect_list(F.struct("term", "df", "term_count")))
    return (
        kept.agg(terms.alias("_terms"))
        .select(F.posexplode("_terms").alias("position", "_t"))
        .select(
            "_t.term",
            "_t.df",
            "_t.term_count",
            (F.log((1 + documents) / (1 + F.col("_t.df"))) + 1).alias("idf"),
            "position",
        )
    )


def collect_terms(vocab: DataFrame) -> list[tuple[str, float]]:
    """A fitted vocabulary as ``(term, idf)`` in position order: ``max_features`` rows at most."""
    return [(r["term"], r["idf"]) for r in vocab.orderBy("position").collect()]


def _weights(df: DataFrame, terms: list[tuple[str, float]], ngrams: str) -> DataFrame:
    """Add ``_counts``, ``_w`` and ``_norm`` of a fitted vocabulary to each row.

    Terms are looked up by hash inside the row, so applying a vocabulary needs no
    explode and no shuffle, however long a text is.
    """
    counter = CountVectorizerModel.from_vocabulary(
        [t for t, _ in terms], inputCol=ngrams, outputCol="_vector", minTF=1.0
    )
    counted = counter.transform(df).withColumn("_counts", vector_to_array("_vector")).drop("_vector")
    idfs = F.array(*[F.lit(float(idf)) for _, idf in terms])
    w = F.zip_with(
        "_counts", idfs, lambda tf, idf: F.when(tf > 0, (1 + F.log(tf)) * idf).otherwise(0.0)
    )
    norm = F.sqrt(F.aggregate("_w", F.lit(0.0), lambda acc, x: acc + x * x))
    return counted.withColumn("_w", w).withColumn("_norm", norm)


def tfidf(grams: DataFrame, terms: list[tuple[str, float]], key: str, ngrams: str = "ngrams") -> DataFrame:
    """Long form of a fitted vocabulary, one row per document and term it contains."""
    if not terms:
        empty = "term string, position int, tf bigint, tfidf double"
        return grams.sparkSession.createDataFrame([], f"{key} bigint, {empty}")
    names = F.array(*[F.lit(t) for t, _ in terms])
    entries = F.arrays_zip(names.alias("term"), F.col("_counts").alias("tf"), F.col("_w").alias("w"))
    return (
        _weights(grams, terms, ngrams)
        .select(key, "_norm", F.posexplode(entries).alias("position", "_t"))
        .where(F.col("_t.tf") > 0)
        .select(
            key,
            F.col("_t.term").alias("term"),
            "position",
            F.col("_t.tf").cast("long").alias("tf"),
            (F.col("_t.w") / F.col("_norm")).alias("tfidf"),
        )
    )


def weighted(df: DataFrame, weight: float, column: str = "tfidf") -> DataFrame:
    """Text columns scaled against structural ones.  Trees, and features scaled to
    unit variance, do not notice."""
    return df.withColumn(column, F.col(column) * F.lit(weight))


def with_wide_tfidf(
    df: DataFrame, terms: list[tuple[str, float]], config: TextConfig, ngrams: str = "ngrams"
) -> DataFrame:
    """Add columns ``prefix0`` to ``prefix<max_features-1>``, weighted, of a fitted
    vocabulary.  Positions the vocabulary does not fill are 0."""
    names = [f"{config.prefix}{i}" for i in range(config.max_features)]
    if not terms:
        return df.select("*", *[F.lit(0.0).alias(n) for n in names])
    share = F.transform(
        "_w",
        lambda w: F.when(F.col("_norm") > 0, w / F.col("_norm") * F.lit(config.weight)).otherwise(0.0),
    )
    filled = _weights(df, terms, ngrams).withColumn("_share", share)
    return filled.select(
        *df.columns,
        *[
            (F.col("_share")[i] if i < len(terms) else F.lit(0.0)).alias(n)
            for i, n in enumerate(names)
        ],
    )
