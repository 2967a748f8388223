"""I-Match fingerprints over randomised lexicon subsets.

The lexicon holds the terms whose inverse document frequency lies in a band.  The band
begins at ``IDF_LOW`` and reaches as far up as ``LEXICON`` terms allow, so the lexicon has a
proven size and may be broadcast.  Random subsets of it come from one hash of the term: at
scale ``s`` there are ``2 ** s`` disjoint subsets, of which the first ``SUBSETS`` are used.  A
text uses the two scales at which a subset holds about one of its terms, so long and short
texts alike have some subsets that an edit leaves untouched.  A fingerprint has, for each
subset that meets the text, a hash of the sorted distinct terms they share.

DataFrame functions only.  Document frequencies count every text in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shipmeter.session import materialize

IDF_LOW = 3.0
LEXICON = 200_000
SUBSETS = 32
STEP = 0.05  # width of the steps in which the upper end of the band is sought
_BREAKS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_NO_TERMS = 63  # the scale of the one entry of a text without lexicon terms


def terms(text: Column) -> Column:
    """Distinct words, lower case; empty strings are left out."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), _BREAKS, -1)), "")


def lexicon(texts: DataFrame) -> DataFrame:
    """Hashes (``term``) of the terms of ``texts`` (one ``text`` column) in the band."""
    total = texts.count()
    per_text = texts.select(F.explode(terms(F.col("text"))).alias("word"))
    counts = per_text.groupBy(F.xxhash64("word").alias("term")).agg(F.count("*").alias("df"))
    idf = F.log(F.lit(float(max(total, 1))) / F.col("df"))
    # A term of one text says nothing about others; most terms are such and none is written.
    counts = materialize(counts.filter((F.col("df") > 1) & (idf >= IDF_LOW)), "df")
    steps = counts.groupBy(F.floor(idf / STEP).alias("step")).count().orderBy("step").collect()
    held, high = 0, IDF_LOW
    for step in steps:  # at most ln(total) / STEP rows
        held += step["count"]
        if held > LEXICON:
            break
        high = (step["step"] + 1) * STEP
    return counts.filter(F.floor(idf / STEP) < round(high / STEP)).select("term")


def following(rows: DataFrame) -> DataFrame:
    """``id``, ``key``, ``n`` of distinct rows with ``next_id``, ``next_key``: the next row by id, then key, both descending.

    After the last row comes the first.  Rows are dealt into ranges, ordered inside each
    range, and the ranges are joined at their ends; only one row per range meets in one task.
    """
    distinct = rows.groupBy("id", "key").agg(F.min("n").alias("n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.repartitionByRange(parts, F.col("id").desc_nulls_last(), F.col("key").desc())
    dealt = materialize(dealt.withColumn("range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("range").orderBy(F.col("id").desc_nulls_last(), F.col("key").desc())
    me = F.struct("id", "key")
    led = dealt.withColumn("next", F.lead(me).over(inside))
    heads = dealt.groupBy("range").agg(F.max(me).alias("head"))
    across = Window.orderBy("range")
    ends = heads.select(
        "range",
        F.coalesce(F.lead("head").over(across), F.first("head").over(across)).alias("turn"),
    )
    found = led.join(F.broadcast(ends), "range").withColumn("next", F.coalesce("next", "turn"))
    return found.select("id", "key", "n", F.col("next.id").alias("next_id"), F.col("next.key").alias("next_key"))


def _scale(count: Column) -> Column:
    return F.greatest(F.lit(5), F.ceil(F.log2(F.greatest(count, F.lit(1))))).cast("int")


def _subset(term: Column, scale: Column) -> Column:
    return F.pmod(term, F.call_function("shiftleft", F.lit(1).cast("long"), scale))


def _entries(found: Column, scale: Column) -> Column:
    mine = F.filter(found, lambda t: _subset(t, scale) < SUBSETS)
    used = F.array_distinct(F.transform(mine, lambda t: _subset(t, scale)))

    def entry(slot: Column) -> Column:
        digest = F.xxhash64(F.array_sort(F.filter(mine, lambda t: _subset(t, scale) == slot)))
        place = F.shiftleft((scale * SUBSETS + slot).cast("long"), 48)
        return place.bitwiseOR(F.shiftrightunsigned(digest, 16))

    return F.transform(used, entry)


def _fingerprint(found: Column, scale: Column, whole: Column) -> Column:
    """Sorted entries: 16 bits of scale and subset, 48 bits of hash."""
    both = F.concat(_entries(found, scale), _entries(found, scale + 1))
    alone = F.array(F.shiftleft(F.lit(_NO_TERMS * SUBSETS).cast("long"), 48).bitwiseOR(F.shiftrightunsigned(whole, 16)))
    return F.array_sort(F.when(F.size(both) > 0, both).otherwise(alone))


def spelled(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.hex(x))), "-")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries among the subsets that meet either text, at scales both use."""

    def scale(x: Column) -> Column:
        return F.shiftrightunsigned(x, 53)

    def slot(x: Column) -> Column:
        return F.shiftrightunsigned(x, 48)

    common = F.array_intersect(F.transform(a, scale), F.transform(b, scale))
    x = F.filter(a, lambda e: F.array_contains(common, scale(e)))
    y = F.filter(b, lambda e: F.array_contains(common, scale(e)))
    either = F.size(F.array_union(F.transform(x, slot), F.transform(y, slot)))
    return F.when(either > 0, F.size(F.array_intersect(x, y)) / either).otherwise(0.0)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("key", F.xxhash64("text"))


def _printed(rows: DataFrame, sides: dict[str, str], keep: list[str], words: DataFrame) -> DataFrame:
    """Adds a fingerprint for each text column of ``sides`` and drops the texts; rows are distinct by ``keep``."""
    names = list(sides)
    hashed = rows.select(*keep, *[F.transform(terms(F.col(c)), lambda w: F.xxhash64(w)).alias(c) for c in names])
    scaled = hashed.select(
        *keep, *names,
        *[_scale(F.size(c)).alias(f"{c}_scale") for c in names],
        *[F.xxhash64(F.array_sort(c)).alias(f"{c}_whole") for c in names],
    )
    own = [f"{c}_{x}" for c in names for x in ("scale", "whole")]

    def chosen(side: int, c: str) -> Column:
        near = F.filter(c, lambda t: _subset(t, F.col(f"{c}_scale")) < SUBSETS)
        return F.transform(near, lambda t: F.struct(F.lit(side).alias("side"), t.alias("term")))

    flat = scaled.select(*keep, *own, F.explode_outer(F.concat(*[chosen(i, c) for i, c in enumerate(names)])).alias("t"))
    flat = flat.select(*keep, *own, "t.side", "t.term").join(F.broadcast(words.withColumn("held", F.lit(True))), "term", "left")
    met = F.collect_set(F.when(F.col("held"), F.struct("side", "term"))).alias("met")
    grouped = flat.groupBy(*keep, *own).agg(met)

    def side_terms(side: int) -> Column:
        return F.transform(F.filter("met", lambda m: m.side == side), lambda m: m.term)

    lists = grouped.select(*keep, *own, *[side_terms(i).alias(c) for i, c in enumerate(names)])
    prints = [_fingerprint(F.col(c), F.col(f"{c}_scale"), F.col(f"{c}_whole")).alias(out) for c, out in sides.items()]
    return lists.select(*keep, *prints)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fingerprint`` (array of long), one row per distinct (id, text).

    Null counts as an empty text.  A text without lexicon terms has one entry, from all of
    its terms.  Equal texts have equal fingerprints.
    """
    rows = _keyed(docs, id_col, text_col)
    made = _printed(rows, {"text": "fingerprint"}, ["id", "key"], lexicon(rows.select("text")))
    return made.select(F.col("id").alias(id_col), "fingerprint")


def edit_test(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How fingerprints take an edit: each text against itself with its last third replaced.

    The last floor(n / 3) code points give way to the first as many of the next document
    (descending id; equal ids by descending hash of the text; after the last the first).
    Columns: ``id_col``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``
    (arrays), ``near_edited``, ``near_next``.  One row per distinct (id, text); null counts as
    an empty text.
    """
    rows = _keyed(docs, id_col, text_col)
    words = materialize(lexicon(rows.select("text")), "lexicon")
    order = materialize(following(rows.select("id", "key", F.length("text").alias("n"))), "order")
    # One text of each (id, key), dealt by them once for both joins.  A struct of a null id
    # equals another, so the joins hash what the window hashes and no text is dealt again.
    texts = rows.select(F.struct("id").alias("own"), "key", "text")
    one = Window.partitionBy("own", "key").orderBy(F.lit(0))
    texts = texts.withColumn("nth", F.row_number().over(one)).filter("nth = 1").drop("nth")
    after = order.select(
        F.struct("id").alias("of"), F.col("key").alias("of_key"), (F.col("n") / 3).cast("long").cast("int").alias("cut"),
        F.struct(F.col("next_id").alias("id")).alias("next"), "next_key",
    )
    patch = texts.join(after, (F.col("own") == F.col("next")) & (F.col("key") == F.col("next_key"))).select(
        "of", "of_key", "cut", "next", "next_key", F.substring("text", F.lit(1), F.col("cut")).alias("patch")
    )
    both = texts.join(patch, (F.col("own") == F.col("of")) & (F.col("key") == F.col("of_key")))
    n = F.length("text").cast("long")
    edited = F.concat(F.substring("text", F.lit(1), (n - F.col("cut")).cast("int")), "patch")
    sides = both.select("own.id", "key", n.alias("n_chars"), F.col("next.id").alias("next_id"), "next_key", "text", edited.alias("edited"))
    sides = sides.withColumn("edited_sha256", F.sha2("edited", 256))
    keep = ["id", "key", "n_chars", "next_id", "next_key", "edited_sha256"]
    made = materialize(_printed(sides, {"text": "fingerprint", "edited": "edited_fingerprint"}, keep, words), "prints")
    other = made.select(F.col("id").alias("o_id"), F.col("key").alias("o_key"), F.col("fingerprint").alias("next_print"))
    joined = made.join(other, F.col("next_id").eqNullSafe(F.col("o_id")) & (F.col("next_key") == F.col("o_key")))
    return joined.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
    )
