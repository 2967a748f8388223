"""Near-duplicates by DartMinHash.

A document is a weighted set: its shingles of five words, weighted by how often each
occurs.  Every unit of weight of an element is a column in which darts fall as a Poisson
process over ranks, seeded by hashes of the element, the unit and the rank cell, so
equal elements get equal darts in every document.  A document of total weight W looks
at ranks up to t / W only, about t = k ln k + 2k darts whatever its length; each dart
hits one of k coordinates and each coordinate keeps its earliest dart.  Two documents
agree on a coordinate with a probability equal to their weighted Jaccard similarity.

Coordinates are joined in bands.  Each bucket links its members to one of them, so a
bucket of n texts gives n - 1 candidates and not all pairs; each candidate is then checked
exactly.  Buckets in which the checked links leave several classes are dealt again, one
member of each class against another centre, for up to ``ROUNDS`` turns.  What still lies in a
bucket of several classes is then joined exactly, on the rarest element-units of each
text, so every similar pair that shares a bucket ends in one class.  Exact copies are one node
throughout.  Classes are connected components, found by label propagation on tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipmeter.llm.lexer import mix, shingles, sliced, words
from shipmeter.llm.shipping import ship
from shipmeter.session import materialize

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 8
ROUNDS = 5
ROWS_AT_ONCE = 128  # rows whose darts are held at once

_U = np.uint64
_EDGES = np.array([0.0, *(2.0**-e for e in range(6, 0, -1))])  # rank cells below 1; above, unit cells


def _poisson(u: np.ndarray, width: float) -> np.ndarray:
    cdf = np.cumsum([exp(-width) * width**i / factorial(i) for i in range(14)])
    return np.searchsorted(cdf, u)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(np.float64) * 2.0**-53


def elements(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Element-unit hashes and rows: the c-th occurrence of a shingle is its unit c."""
    shingle, row = shingles(words(texts), WORDS)
    order = np.lexsort((shingle, row))
    shingle, row = shingle[order], row[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (shingle[1:] != shingle[:-1]) | (row[1:] != row[:-1])
    at = np.arange(len(row))
    unit = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return mix(shingle + unit.astype(_U) * _U(0xA0761D6478BD642F)), row


def _throw(column: np.ndarray, row: np.ndarray, top: np.ndarray, n: int, k: int) -> np.ndarray:
    """Earliest dart of each coordinate, 0 where none fell; ``top``: rank limit by row."""
    found_rank, found_at, found_id = [], [], []

    def cell(mine: np.ndarray, number: np.ndarray, low: np.ndarray, width: float) -> None:
        seed = mix(column[mine] ^ mix(number.astype(_U) + _U(1)))
        count = _poisson(_unit(seed), width)
        hit = np.flatnonzero(count)
        times = count[hit]
        src = np.repeat(hit, times)
        nth = np.arange(len(src)) - np.repeat(np.cumsum(times) - times, times)
        dart = mix(seed[src] + (nth.astype(_U) + _U(1)) * _U(0xE7037ED1A0B428DB))
        rank = low[src] + width * _unit(dart)
        owner = row[mine[src]]
        keep = rank <= top[owner]
        dart, rank, owner = dart[keep], rank[keep], owner[keep]
        where = mix(dart + _U(0x8EBC6AF09C88C6E3))
        found_rank.append(rank)
        found_at.append(owner * k + (where % _U(k)).astype(np.int64))
        found_id.append(where | _U(1))

    for c, low in enumerate(_EDGES):
        mine = np.flatnonzero(top[row] > low)
        high = _EDGES[c + 1] if c + 1 < len(_EDGES) else 1.0
        cell(mine, np.full(len(mine), c), np.full(len(mine), low), high - low)
    whole = np.maximum(np.ceil(top).astype(np.int64) - 1, 0)[row]
    mine = np.repeat(np.arange(len(column)), whole)
    nth = np.arange(len(mine)) - np.repeat(np.cumsum(whole) - whole, whole)
    cell(mine, nth + len(_EDGES), nth + 1.0, 1.0)

    rank, at, ident = map(np.concatenate, (found_rank, found_at, found_id))
    first = np.full(n * k, np.inf)
    np.minimum.at(first, at, rank)
    kept = rank == first[at]
    out = np.zeros(n * k, _U)
    np.maximum.at(out, at[kept], ident[kept])
    return out.reshape(n, k)


def sketch(column: np.ndarray, row: np.ndarray, n: int, k: int = BANDS * ROWS) -> np.ndarray:
    """``k`` coordinates for each of ``n`` rows; rows without elements stay 0."""
    weight = np.bincount(row, minlength=n)
    begin = np.concatenate(([0], np.cumsum(weight)))
    out = np.zeros((n, k), _U)
    for low in range(0, n, ROWS_AT_ONCE):  # so that many short texts need no more memory
        high = min(n, low + ROWS_AT_ONCE)
        part = slice(begin[low], begin[high])
        out[low:high] = _sketch(column[part], row[part] - low, weight[low:high], k)
    return out


def _sketch(column: np.ndarray, row: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    n = len(weight)
    out = np.zeros((n, k), _U)
    open_rows = np.flatnonzero(weight)
    darts = k * log(k) + 2 * k
    while len(open_rows):
        place = np.full(n, -1)
        place[open_rows] = np.arange(len(open_rows))
        mine = np.flatnonzero(place[row] >= 0)
        got = _throw(column[mine], place[row[mine]], darts / weight[open_rows], len(open_rows), k)
        out[open_rows] = got
        open_rows = open_rows[(got == 0).any(axis=1)]  # a coordinate without a dart: look further
        darts *= 2
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``same`` (digest of the words, of the text if it has none), ``weight``, ``buckets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = np.arange(1, ROWS + 1).astype(_U) * _U(0x9FB21C651E98DF25)
        band = mix(np.arange(BANDS).astype(_U) + _U(77))
        for batch in sliced(batches, 1):
            texts, n = batch.column(1), batch.num_rows
            column, row = elements(texts)
            dots = sketch(column, row, n).reshape(n, BANDS, ROWS)
            keys = mix((mix(dots + scale)).sum(axis=2, dtype=_U) ^ band)
            weight = np.bincount(row, minlength=n)
            width = np.where(weight > 0, BANDS, 0)
            flat = keys[weight > 0].reshape(-1).view(np.int64)
            buckets = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(width))).astype(np.int32), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _same(texts), pa.array(weight, pa.int64()), buckets],
                ["id", "same", "weight", "buckets"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return _rows(docs, id_col, text_col).mapInArrow(run, f"id {kind}, same binary, weight long, buckets array<long>")


def _same(texts: pa.Array) -> pa.Array:
    """128 bits from the word sequence; a text without words stands for itself."""
    w = words(texts)
    count = np.diff(w.first)
    nth = np.arange(len(w.hashes)) - np.repeat(w.first[:-1], count)
    digest = np.zeros((len(count), 2), _U)
    for half, salt in enumerate((0x2545F4914F6CDD1D, 0x61C8864680B583EB)):
        spread = mix(w.hashes ^ mix(nth.astype(_U) * _U(salt) + _U(half + 1)))
        sums = np.concatenate(([_U(0)], np.cumsum(spread, dtype=_U)))
        digest[:, half] = mix(sums[w.first[1:]] - sums[w.first[:-1]] + count.astype(_U))
    return pa.array([d.tobytes() if c else b"text:" + (t.as_py() or "").encode() for d, c, t in zip(digest, count, texts)], pa.binary())


def _element_lists(docs: DataFrame) -> DataFrame:
    """``id`` and the sorted element-units of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            column, row = elements(batch.column(1))
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows))))
            lists = pa.ListArray.from_arrays(ends.astype(np.int32), column.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "units"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, units array<long>")


def _unbounded(side: DataFrame) -> DataFrame:
    """A side that grows with the corpus: merged at every size, never broadcast."""
    return side.hint("merge")


def _linked(both: DataFrame) -> DataFrame:
    """Distinct pairs (u < v) of members and the head of their bucket whose weights allow the similarity."""
    fits = F.least("weight", "h_weight") >= SIMILARITY * F.greatest("weight", "h_weight")
    apart = both.filter("id <> h_id").filter(fits)
    return apart.select(F.least("id", "h_id").alias("u"), F.greatest("id", "h_id").alias("v")).distinct()


def _crowded(members: DataFrame) -> DataFrame:
    """The members (``bucket``, ``id``, ``weight``) of buckets that have several, each with the one of the least id."""
    heads = members.groupBy("bucket").agg(F.min(F.struct("id", "weight")).alias("h"), F.count("*").alias("n")).filter("n > 1")
    named = heads.select("bucket", F.col("h.id").alias("h_id"), F.col("h.weight").alias("h_weight"))
    return members.join(_unbounded(named), "bucket")


def _more_stars(members: DataFrame, turn: int) -> DataFrame:
    """Links from one member of each class (``side``) in a bucket to one member of the bucket.

    A hash of the id and the turn chooses them, the same in all buckets, so members of one
    group mostly meet the same few centres; the next turn has other centres.
    """
    order = F.struct(F.xxhash64("id", F.lit(turn)).alias("order"), F.col("id"), F.col("weight"))
    shown = members.groupBy("bucket", "side").agg(F.min(order).alias("m"))
    heads = shown.groupBy("bucket").agg(F.min("m").alias("h"), F.count("*").alias("n")).filter("n > 1")
    heads = heads.select("bucket", F.col("h.id").alias("h_id"), F.col("h.weight").alias("h_weight"))
    return _linked(shown.select("bucket", "m.id", "m.weight").join(heads, "bucket"))


def _checked(edges: DataFrame, units: DataFrame) -> DataFrame:
    """Links whose exact weighted Jaccard similarity is high enough."""
    a, b = units.select(F.col("id").alias("u"), F.col("units").alias("x")), units.select(F.col("id").alias("v"), F.col("units").alias("y"))
    both = edges.join(_unbounded(a), "u").join(_unbounded(b), "v").withColumn("n", F.size(F.array_intersect("x", "y")))
    return both.filter(F.col("n") >= SIMILARITY * (F.size("x") + F.size("y") - F.col("n"))).select("u", "v")


def _finished(sided: DataFrame, units: DataFrame) -> DataFrame:
    """Candidates (u < v) among the members of buckets that hold several classes (``side``).

    Two sets of a high enough similarity share one of their rarest elements, at places
    after which enough elements are left in both.  So each pair of different classes that
    may be similar is met, whatever buckets it shares.
    """
    several = sided.groupBy("bucket").agg(F.min("side").alias("a"), F.max("side").alias("b")).filter("a < b").select("bucket")
    still = materialize(sided.join(_unbounded(several), "bucket", "left_semi").select("id", "side").distinct(), "open")
    every = units.join(_unbounded(still), "id").select("id", "side", F.size("units").alias("n"), F.explode("units").alias("unit"))
    every = materialize(every, "open_units")
    often = every.groupBy("unit").agg(F.count("*").alias("freq"))
    ranked = every.join(_unbounded(often), "unit").groupBy("id", "side", "n").agg(F.array_sort(F.collect_list(F.struct("freq", "unit"))).alias("r"))
    length = (F.col("n") - F.ceil(SIMILARITY * F.col("n") - 1e-9) + 1).cast("int")
    rare = ranked.select("id", "side", "n", F.posexplode(F.slice("r", F.lit(1), length)).alias("at", "r"))
    rare = materialize(rare.filter("r.freq > 1").select(F.col("r.unit").alias("unit"), "id", "side", "n", "at"), "rare")
    a, b = (rare.select("unit", *[F.col(c).alias(f"{x}_{c}") for c in ("id", "side", "n", "at")]) for x in "ab")
    left = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    enough = left >= SIMILARITY / (1 + SIMILARITY) * (F.col("a_n") + F.col("b_n")) - 1e-9
    met = a.join(_unbounded(b), "unit").filter("a_id < b_id and a_side <> b_side").filter(enough)
    return met.select(F.col("a_id").alias("u"), F.col("b_id").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``label``, the least id of its component, for every id in ``edges``.

    Each step gives every id the least label among its neighbours and then that
    label's own label, so the number of steps grows with the logarithm of a path.
    """
    pairs = edges.select(F.col("u").alias("id"), F.col("v").alias("to"))
    pairs = materialize(pairs.unionByName(pairs.select(F.col("to").alias("id"), F.col("id").alias("to"))), "pairs")
    labels = materialize(
        pairs.groupBy("id").agg(F.least(F.min("to"), F.first("id")).alias("label")), "labels"
    )
    while True:
        seen = pairs.join(labels.select(F.col("id").alias("to"), "label"), "to").groupBy("id").agg(F.min("label").alias("near"))
        lower = labels.join(seen, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("root"))
        new = lower.join(jump, "label").select("id", "was", F.least("label", "root").alias("label"))
        new = materialize(new, "labels")
        labels = new.select("id", "label")
        if new.filter("was <> label").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``class_id``, the least id of the class; one row per id.

    Texts of the same words are one node.  Rows that share an id count as one document.
    Texts without words link only to equal texts; null counts as empty.  A row whose id
    is null gives no row.  Other columns are not read.
    """
    ship(docs.sparkSession)
    rows = _rows(docs, id_col, text_col).filter("id is not null")
    signed = materialize(signatures(rows, "id"), "signatures")
    owner = signed.groupBy("same").agg(F.min("id").alias("rep"))
    nodes = materialize(
        signed.groupBy("same").agg(F.min_by(F.struct("id", "weight", "buckets"), "id").alias("n")).select("n.*"), "nodes"
    )
    members = nodes.select("id", "weight", F.explode("buckets").alias("bucket"))
    crowded = materialize(_crowded(members), "crowded")
    edges = materialize(_linked(crowded), "edges")
    ends = crowded.select("id").distinct()
    units = materialize(
        _element_lists(rows.join(_unbounded(ends), "id", "left_semi")).groupBy("id").agg(F.max("units").alias("units")), "units"
    )
    links = materialize(_checked(edges, units), "links")
    held = materialize(signed.select("id", "same").distinct().join(owner, "same").select("id", "rep"), "held")
    first = held.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
    several = held.join(first.filter("low < high").select("id", "low"), "id").filter("rep > low")
    shared = several.select(F.col("low").alias("u"), F.col("rep").alias("v")).distinct()
    for turn in range(1, ROUNDS):
        if links.isEmpty():
            break
        labels = components(links)
        sided = crowded.join(labels, "id", "left").select("bucket", "id", "weight", F.coalesce("label", "id").alias("side"))
        fresh = materialize(_checked(materialize(_more_stars(sided, turn), "edges"), units), "links")
        # Classes found so far are kept as stars, not as all the links that made them.
        links = labels.filter("id <> label").select(F.col("label").alias("u"), F.col("id").alias("v")).unionByName(fresh)
        if fresh.isEmpty():
            break
    sided = crowded.join(components(links), "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("side"))
    rest = materialize(_checked(materialize(_finished(sided, units), "edges"), units), "links")
    labels = components(links.unionByName(rest).unionByName(shared)).withColumnRenamed("id", "low")
    return first.join(labels, "low", "left").select(
        F.col("id").alias(id_col), F.coalesce("label", "low").alias("class_id")
    )
