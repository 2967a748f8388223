"""Words of Arrow text batches as 64-bit hashes, a whole slice of rows at a time.

A word is a maximal run of ASCII letters or digits and of characters beyond ASCII;
A-Z count as a-z.  All work is on the UTF-8 bytes that Arrow holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000

_CODE = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    if _b >= 128 or _c.isalnum():
        _CODE[_b] = ord(_c.lower()) if _b < 128 else _b

_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 256), _BASE, np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(NamedTuple):
    """Hashes of the words of some rows; row ``r`` has those from ``first[r]`` to ``first[r + 1]``."""

    hashes: np.ndarray
    first: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and where each row begins; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    begin = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[begin[0] : begin[-1]] if len(texts) else raw[:0], begin - begin[0]


def words(texts: pa.Array) -> Words:
    raw, begin = buffers(texts)
    code = _CODE[raw]
    inside = code > 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[begin] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    at = np.flatnonzero(inside)
    starts = np.flatnonzero(opens)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64))
    word_of = np.cumsum(opens[at]) - 1
    place = at - starts[word_of]
    powers = _powers(int(place.max()) + 1)
    hashes = np.add.reduceat(code[at].astype(np.uint64) * powers[place], np.searchsorted(at, starts))
    lengths = np.bincount(word_of, minlength=len(starts)).astype(np.uint64)
    return Words(mix(hashes + lengths * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(starts, begin))


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive words and the row of each; a shorter row is one shingle."""
    count = np.diff(w.first)
    per_row = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), per_row)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    start = w.first[:-1][row] + nth
    span = np.minimum(n, count[row])
    out = mix(span.astype(np.uint64))
    for k in range(n):
        use = span > k
        step = w.hashes[np.minimum(start + k, max(0, len(w.hashes) - 1))]
        out = np.where(use, mix(out * np.uint64(_BASE) + step), out)
    return out, row


def sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``SLICE_BYTES`` of text; a longer row comes alone."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64) + 64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start = stop
