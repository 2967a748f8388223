"""Quality from random-indexing word vectors and a small network.

Every term (a lower-case word, or the written shape of a chunk: its capitals, digits and
punctuation) falls into one of ``TERMS`` cells and has a fixed sparse random index vector.
One pass over all texts adds to each term's context vector the index vectors of its
neighbours.  A text is the mean of the context vectors of its terms, with a few sums
that show repetition.  A network of two layers in numpy, fitted on a bounded sample of
labelled rows, gives the score; a temperature set on rows the weights did not see
calibrates it.

The context table has a fixed size, so it can be sent to all tasks; each task adds up one
of its own and the tables are summed by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipmeter.llm.lexer import buffers, mix, sliced
from shipmeter.llm.shipping import ship
from shipmeter.session import materialize

TERMS = 1 << 14
DIM = 48
NONZERO = 2
REACH = 2  # neighbours on each side
BLOCKS = 32
SAMPLE_DOCS = 16_000  # labelled rows that fit the network
HIDDEN = 32
EPOCHS = 40
STRETCH = 1 << 16  # terms whose vectors are held at once

_U = np.uint64
_KIND = np.zeros(256, np.uint8)  # 0 space; 1 lower or beyond ASCII, 2 capital, 3 digit, else the byte itself
_LOWER = np.arange(256, dtype=np.uint8)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 0 if _c in " \t\n\r\x0b\x0c" else 1 if _b >= 128 or _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else _b
    if _b < 128:
        _LOWER[_b] = ord(_c.lower())
_WORDY = (_KIND >= 1) & (_KIND <= 3)


class Model(NamedTuple):
    contexts: np.ndarray  # TERMS x DIM, rows of unit length
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


def _index() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each term's index vector."""
    seed = mix(np.arange(TERMS * NONZERO, dtype=_U) + _U(41)).reshape(TERMS, NONZERO)
    return (seed % _U(DIM)).astype(np.int64), np.where((seed >> _U(40)) & _U(1), 1.0, -1.0)


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Term cells in order, word and shape of each chunk by turns, and the row of each."""
    raw, begin = buffers(texts)
    kind = _KIND[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[begin] = True
    inside = kind > 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(inside)
    chunk = np.cumsum(opens[at]) - 1
    first = np.searchsorted(at, starts)
    # A word is hashed from its letters and digits, a shape from its runs of one kind.
    base = _U(0x9E3779B97F4A7C15)

    def hashed(values: np.ndarray, use: np.ndarray) -> np.ndarray:
        count = np.cumsum(use)
        nth = count - np.concatenate(([0], count))[first][chunk]
        power = np.multiply.accumulate(np.full(int(nth.max()) + 1, base, _U))
        return mix(np.add.reduceat(np.where(use, values.astype(_U) * power[nth], _U(0)), first))

    k = kind[at]
    turn = np.ones(len(k), bool)
    turn[1:] = (k[1:] != k[:-1]) | opens[at][1:]
    word = hashed(_LOWER[raw[at]], _WORDY[raw[at]])
    shape = hashed(k, turn) ^ _U(0x5851F42D4C957F2D)
    cell = (mix(np.stack([word, shape], axis=1).reshape(-1)) % _U(TERMS)).astype(np.int64)
    row = np.searchsorted(begin, starts, "right") - 1
    return cell, np.repeat(row, 2)


def _add_contexts(total: np.ndarray, cell: np.ndarray, row: np.ndarray) -> None:
    place, sign = _index()
    flat = total.reshape(-1)
    for lag in range(1, REACH + 1):
        a, b = cell[:-lag], cell[lag:]
        same = row[:-lag] == row[lag:]
        a, b = a[same], b[same]
        for x, y in ((a, b), (b, a)):
            for j in range(NONZERO):
                flat += np.bincount(x * DIM + place[y, j], sign[y, j], minlength=TERMS * DIM)


def contexts(texts: DataFrame) -> np.ndarray:
    """Context vectors of all terms over all ``texts`` (one column), of unit length."""
    height = TERMS // BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TERMS, DIM))
        for batch in sliced(batches, 0):
            cell, row = terms(batch.column(0))
            if len(cell) > REACH:
                _add_contexts(total, cell, row)
        parts = [total[b * height : (b + 1) * height].astype(np.int64) for b in range(BLOCKS)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(BLOCKS), pa.int32()), pa.array([_packed(p) for p in parts], pa.binary())], ["block", "sums"]
        )

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((height, DIM), np.int64)
        for sums in table.column("sums"):
            total += _unpacked(sums.as_py(), height)
        return pa.table({"block": table.column("block")[:1].cast(pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, sums binary"
    summed = texts.mapInArrow(run, schema).groupBy("block").applyInArrow(add, schema)
    out = np.zeros((TERMS, DIM))
    for r in summed.collect():  # BLOCKS rows of fixed size
        out[r.block * height : (r.block + 1) * height] = np.frombuffer(r.sums, np.int64).reshape(height, DIM)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _packed(part: np.ndarray) -> bytes:
    """A table of counts in the narrowest integer type that holds it."""
    most = int(np.abs(part).max(initial=0))
    kind = next(k for k, top in (("i1", 127), ("i2", 32767), ("i4", 2**31 - 1), ("i8", 2**63 - 1)) if most <= top)
    return kind.encode() + part.astype(kind).tobytes()


def _unpacked(data: bytes, height: int) -> np.ndarray:
    return np.frombuffer(data, data[:2].decode(), offset=2).reshape(height, DIM).astype(np.int64)


def pooled(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """A row of features for each text."""
    n = len(texts)
    cell, row = terms(texts)
    count = np.bincount(row, minlength=n).astype(float)
    safe = np.maximum(count, 1)[:, None]
    sums, spread = np.zeros((n, DIM)), np.zeros((n, DIM))
    for at in range(0, len(cell), STRETCH):  # so that a very long text needs no more memory
        vectors, owner = table[cell[at : at + STRETCH]], row[at : at + STRETCH]
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        sums[owner[first]] += np.add.reduceat(vectors, first)
        spread[owner[first]] += np.add.reduceat(vectors * vectors, first)
    repeats = []
    for lag in (2, 4, 6, 8):
        same = (cell[lag:] == cell[:-lag]) & (row[lag:] == row[:-lag])
        repeats.append(np.bincount(row[lag:][same], minlength=n) / safe[:, 0])
    pair = np.unique(row * TERMS + cell)
    kinds = np.bincount(pair // TERMS, minlength=n) / safe[:, 0]
    return np.column_stack([sums / safe, spread / safe, *repeats, kinds, np.log1p(count), kinds * np.log1p(count)])


def _featured(rows: DataFrame, table: np.ndarray, extra: list[str]) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0):
            x = pooled(batch.column(0), sent.value)
            ends = (np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(ends, x.reshape(-1))], [*extra, "x"])

    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in extra)
    return rows.select("text", *extra).mapInArrow(run, f"{kinds}x array<double>")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, ...]:
    """Weights of the two layers, by Adam on shuffled batches."""
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        rate = 0.003 * (1 - epoch / EPOCHS) + 1e-4
        for i in range(0, len(order), 128):
            a, b = x[order[i : i + 128]], y[order[i : i + 128]]
            h = np.tanh(a @ w[0] + w[1])
            d = (_sigmoid(h @ w[2] + w[3]) - b) / len(b)
            dh = np.outer(d, w[2]) * (1 - h * h)
            grads = [a.T @ dh + 1e-4 * w[0], dh.sum(axis=0), h.T @ d + 1e-4 * w[2], np.array([d.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return tuple(w)


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss."""
    grid = np.exp(np.linspace(-1.5, 2.5, 161))

    def loss(t: float) -> float:
        p = np.clip(_sigmoid(z / t), 1e-9, 1 - 1e-9)
        return -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    return float(min(grid, key=loss)) if len(z) else 1.0


def fit(docs: DataFrame, labels: DataFrame, kept_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on the labelled rows where ``kept_out`` (on column ``id``) does not hold.

    Context vectors come from all texts and no label.  At most ``SAMPLE_DOCS`` labelled
    rows, those with the least hash of their id, reach the driver as features.  Labels
    other than 0 and 1 and labels of one id that differ teach nothing.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    table = contexts(rows.select("text"))
    taught = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    one = taught.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most")
    drawn = materialize(one.filter(~kept_out).select("id", "label").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS), "drawn")
    seen = _featured(rows.join(F.broadcast(drawn), "id").select("text", "label"), table, ["label"]).select("label", "x").toArrow()
    y = seen.column("label").to_numpy().astype(float)
    width = 2 * DIM + 7
    x = seen.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width) if len(y) else np.zeros((0, width))
    order = np.lexsort((*x.T[::-1], y)) if len(y) else np.zeros(0, int)  # arrival order must not matter
    x, y = x[order], y[order]
    mean = x.mean(axis=0) if len(y) else np.zeros(width)
    scale = np.maximum(x.std(axis=0), 1e-6) if len(y) else np.ones(width)
    z = np.clip((x - mean) / scale, -8, 8)
    apart = mix(np.arange(len(y), dtype=_U)) % _U(5) == 0
    w1, b1, w2, b2 = train(z[~apart], y[~apart])
    logits = np.tanh(z[apart] @ w1 + b1) @ w2 + b2
    return Model(table, mean, scale, w1, b1, w2, float(b2[0]), _temperature(logits, y[apart]))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) for every row; null and empty texts score as texts of no terms.

    Repeated rows are scored each; other columns are not read.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in sliced(batches, 1):
            z = np.clip((pooled(batch.column(1), m.contexts) - m.mean) / m.scale, -8, 8)
            logits = np.tanh(z @ m.w1 + m.b1) @ m.w2 + m.b2
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(logits / m.temperature))], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
