"""Benchmark passages in documents, by a positional inverted index.

The index holds postings of the terms that matter: for every window of an item (``WIDTH``
words, or a shorter item as a whole) the two terms that are rarest in the documents.  A posting
carries the document, the position and the words around it, so the lists of a window's
other terms are intersected, offset by offset, where the posting lies and need no further
join.  Postings meet items by a join on the term; one frequent term spreads over
tasks because the index is the large side, which adaptive execution may split.

Terms of the items are sent to all tasks, in blocks of at most ``BLOCK_WORDS`` item words,
so that what is sent has a bound; more items mean more passes over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shipmeter.llm.lexer import sliced, words
from shipmeter.llm.shipping import ship
from shipmeter.session import materialize

WIDTH = 10
SLACK = 2  # words by which a proximity match may shift
NEAR_SHARE = 0.8  # share of a window's words that a proximity match needs
BLOCK_WORDS = 2_000_000


def _digest(texts: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t.as_py() or "") for t in texts], np.uint64).view(np.int64)


def _around(hashes: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, reach: int) -> np.ndarray:
    """Words from ``reach`` before to ``reach`` after each position, 0 outside the row."""
    place = at[:, None] + np.arange(-reach, reach + 1)
    inside = (place >= low[:, None]) & (place < high[:, None])
    return np.where(inside, hashes[np.clip(place, 0, max(0, len(hashes) - 1))], 0)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(matrix) + 1) * matrix.shape[1]
    return pa.ListArray.from_arrays(ends.astype(np.int32), matrix.reshape(-1))


def item_words(items: DataFrame, width: int) -> DataFrame:
    """``item``, ``q`` (position), ``term``, ``m`` (words of the item), ``around``, for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            w = words(batch.column(1))
            row, hashes = w.row_of(), w.hashes.view(np.int64)
            low, high = w.first[:-1][row], w.first[1:][row]
            at = np.arange(len(row))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(_digest(batch.column(1))[row]), pa.array(at - low),
                 pa.array(hashes), pa.array(high - low), _lists(_around(hashes, at, low, high, width - 1))],
                ["item", "version", "q", "term", "m", "around"],
            )

    schema = "item string, version long, q long, term long, m long, around array<long>"
    return items.mapInArrow(run, schema)


def _scan(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """One row per document (``id``, ``key``, ``n_words``) and the counts of the given terms (``term``, ``freq``)."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        total = np.zeros(len(known), np.int64)
        kind = None
        names = ["id", "key", "n_words", "term", "freq"]
        for batch in sliced(batches, 1):
            w, kind, n = words(batch.column(1)), batch.column(0).type, batch.num_rows
            if len(known):
                at = np.minimum(np.searchsorted(known, w.hashes.view(np.int64)), len(known) - 1)
                hit = known[at] == w.hashes.view(np.int64)
                total += np.bincount(at[hit], minlength=len(known))
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_digest(batch.column(1))), pa.array(np.diff(w.first)), none, none], names
            )
        if total.any():
            seen = np.flatnonzero(total)
            none = pa.nulls(len(seen), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(seen), kind), none, none, pa.array(known[seen]), pa.array(total[seen])], names
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, key long, n_words long, term long, freq long")


def build_index(docs: DataFrame, terms: np.ndarray, reach: int) -> DataFrame:
    """Postings of the given terms: ``term``, ``id``, ``key``, ``p`` (position) and the words around it."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        if not len(known):
            return
        for batch in sliced(batches, 1):
            w = words(batch.column(1))
            hashes = w.hashes.view(np.int64)
            at = np.flatnonzero(known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes)
            if not len(at):
                continue
            row = np.searchsorted(w.first, at, "right") - 1
            low, high = w.first[row], w.first[row + 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[at]), batch.column(0).take(pa.array(row)), pa.array(_digest(batch.column(1))[row]),
                 pa.array(at - low), _lists(_around(hashes, at, low, high, reach))],
                ["term", "id", "key", "p", "beside"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"term long, id {kind}, key long, p long, beside array<long>")


def rarest(items: DataFrame, freq: DataFrame, width: int) -> DataFrame:
    """The words of ``items`` that are among the two rarest, of those that occur, of some window.

    One is enough for exact matches; the second finds a proximity match that lacks the first.
    """
    known = items.join(freq, "term", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    ahead = Window.partitionBy("item", "version").orderBy("q").rowsBetween(0, width - 1)
    occurring = F.collect_list(F.when(F.col("freq") > 0, F.struct("freq", "term", "q"))).over(ahead)
    opened = known.withColumn("rare", F.slice(F.array_sort(occurring), 1, 2)).filter(F.col("q") <= F.greatest(F.col("m") - width, F.lit(0)))
    picked = opened.select("item", "version", F.explode("rare").alias("r")).select("item", "version", F.col("r.q").alias("q")).distinct()
    return items.join(picked, ["item", "version", "q"], "left_semi")


def _compare(pairs: DataFrame, width: int) -> DataFrame:
    """Runs of equal words around each anchor, and the share of nearly placed ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = width - 1
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ours = np.asarray(batch.column(3).flatten()).reshape(n, -1)
            theirs = np.asarray(batch.column(6).flatten()).reshape(n, -1)
            p, m = np.asarray(batch.column(2)), np.asarray(batch.column(5))
            equal = (ours[:, SLACK:-SLACK] == theirs) & (theirs != 0)
            back = np.cumprod(equal[:, reach::-1], axis=1).sum(axis=1) - 1
            ahead = np.cumprod(equal[:, reach:], axis=1).sum(axis=1) - 1
            need = np.minimum(width, m)
            exact = back + ahead + 1 >= need
            close = np.zeros_like(equal)
            for s in range(2 * SLACK + 1):
                close |= ours[:, s : s + theirs.shape[1]] == theirs
            close &= theirs != 0
            sums = np.concatenate((np.zeros((n, 1), int), np.cumsum(close, axis=1)), axis=1)
            best = (sums[:, width:] - sums[:, :-width]).max(axis=1)
            share = np.minimum(best / need, 1.0)
            keep = np.flatnonzero(exact | (share >= NEAR_SHARE))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), batch.column(4).take(pa.array(keep)),
                 pa.array((p - back)[keep]), pa.array((p + ahead)[keep]), pa.array(exact[keep]), pa.array(share[keep])],
                ["id", "key", "item", "low", "high", "exact", "share"],
            )

    kind = pairs.schema["id"].dataType.simpleString()
    return pairs.select("id", "key", "p", "beside", "item", "m", "around").mapInArrow(
        run, f"id {kind}, key long, item string, low long, high long, exact boolean, share double"
    )


def _sorted_longs(column: DataFrame) -> np.ndarray:
    return np.sort(np.array([r[0] for r in column.distinct().collect()], np.int64))


def search(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Documents (``id``, ``key``, ``n_words``) and matches (``id``, ``key``, ``item``, ``low``, ``high``, ``exact``, ``share``).

    ``docs`` has ``id`` and ``text``; ``items`` has ``item`` (string) and ``text``.  A match
    that is not exact is a proximity match: ``share`` of a window's words lie within ``SLACK``
    of their place.
    """
    ship(docs.sparkSession)
    every = materialize(item_words(items, width), "item_words")
    total = every.count()
    blocks = max(1, -(-total // BLOCK_WORDS))
    heads: DataFrame | None = None
    found: list[DataFrame] = []
    for block in range(blocks):
        mine = every.filter(F.pmod(F.xxhash64("item", "version"), F.lit(blocks)) == block)
        scanned = materialize(_scan(docs, _sorted_longs(mine.select("term"))), "scan")
        heads = heads or scanned.filter("n_words is not null").select("id", "key", "n_words")
        freq = scanned.filter("term is not null").groupBy("term").agg(F.sum("freq").alias("freq"))
        anchors = materialize(rarest(mine, freq, width), "anchors")
        index = materialize(build_index(docs, _sorted_longs(anchors.select("term")), width - 1 + SLACK), "index")
        found.append(_compare(index.join(anchors, "term"), width))
    matches = found[0]
    for more in found[1:]:
        matches = matches.unionByName(more)
    return heads, matches


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = WIDTH
) -> DataFrame:
    """``id_col``, ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted ids), ``n_near``, ``contaminated`` for every row.

    A word is hit if it lies in an occurrence of a window; ``n_near`` counts items with a
    proximity match and no exact one.  Null and empty texts have no words.  Items without
    words or with a null id match nothing.  Rows that share an id are matched by their own
    text, repeated rows get one result each.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    tests = items.select(F.col(item_col).cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    heads, matches = search(rows, tests.filter("item is not null"), width)
    exact = F.when(F.col("exact"), F.struct("low", "high"))
    hits = matches.groupBy("id", "key").agg(
        F.array_sort(F.collect_set(exact)).alias("runs"),
        F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("item")))).alias("items"),
        F.collect_set("item").alias("any"),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))
    union = F.aggregate(
        "runs",
        start,
        lambda acc, r: F.struct(
            (acc.n + F.greatest(F.lit(0).cast("long"), r.high - F.greatest(r.low, acc.end + 1) + 1)).alias("n"),
            F.greatest(acc.end, r.high).alias("end"),
        ),
    ).getField("n")
    counted = hits.select(
        F.col("id").alias("i"), F.col("key").alias("k"), union.alias("n_hit"), "items", (F.size("any") - F.size("items")).alias("n_near")
    )
    joined = heads.join(counted, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        listed.alias("items"), F.coalesce(F.col("n_near"), F.lit(0)).cast("long").alias("n_near"), (n_hit > 0).alias("contaminated"),
    )
