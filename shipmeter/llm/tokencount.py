"""Token counts: strings proven to be one token are counted by lookup, the rest merged.

``prove`` runs the merges once over every vocabulary string, on the driver, and keeps
those that come out as a single token and that the split pattern leaves whole.  While
counting, a pre-token found among them costs one dictionary lookup; any other is merged,
and its count is remembered in a cache of bounded size.  One narrow map step: no
shuffle, and a task's memory is one batch of texts, the vocabulary and the cache.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipmeter.llm.pretokens import ALPHABET, BYTE_PATTERN, Cutter
from shipmeter.llm.shipping import ship

CACHE_WORDS = 300_000
CACHE_LENGTH = 64


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Tokens left after all merges, lowest rank and then leftmost first."""
    n = len(symbols)
    if n < 2:
        return n
    if n <= 24:
        symbols = list(symbols)
        while len(symbols) > 1:
            best, at = min((ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if best == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return len(symbols)
    parts: list[str | None] = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if j >= n or (parts[i], parts[j]) != pair:
            continue
        parts[i], parts[j] = pair[0] + pair[1], None
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (p := (parts[i], parts[k])) in ranks:
                heapq.heappush(heap, (ranks[p], i, p))
        if (h := before[i]) >= 0 and (p := (parts[h], parts[i])) in ranks:
            heapq.heappush(heap, (ranks[p], h, p))
    return left


def ranks_of(raw: str) -> dict[tuple[str, str], int]:
    merges = json.loads(raw)["model"]["merges"]
    return {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(merges)}


def prove(raw: str) -> frozenset[str]:
    """Texts that are one pre-token and one token, by running the merges on each."""
    ranks, cutter = ranks_of(raw), Cutter(raw, BYTE_PATTERN, folded=False)
    byte_of = {ch: b for b, ch in enumerate(ALPHABET)}
    proven = set()
    for shown in json.loads(raw)["model"]["vocab"]:
        try:
            text = bytes(byte_of[ch] for ch in shown).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if cutter.cut(text) == [text] and merge_count(list(shown), ranks) == 1:
            proven.add(text)
    return frozenset(proven)


class Counter(dict):
    """Tokens of a pre-token; unknown ones are merged on first sight."""

    def __init__(self, raw: str, proven: frozenset[str]) -> None:
        super().__init__(dict.fromkeys(proven, 1))
        self._proven, self._ranks, self._room = proven, ranks_of(raw), CACHE_WORDS
        self.cutter = Cutter(raw, BYTE_PATTERN, folded=False)

    def __missing__(self, piece: str | int) -> int:
        if isinstance(piece, int):
            return 1
        count = merge_count([ALPHABET[b] for b in piece.encode()], self._ranks)
        if len(piece) <= CACHE_LENGTH:
            if self._room == 0:
                self.clear()
                self.update(dict.fromkeys(self._proven, 1))
                self._room = CACHE_WORDS
            self._room -= 1
            self[piece] = count
        return count

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, self.cutter.cut(text))) if text else 0


_MADE: dict[int, Counter] = {}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` and ``n_tokens`` for every row of ``docs``.

    ``path`` is the vocabulary file (byte-level BPE), read on the driver.  A null text
    counts as empty: 0 bytes, 0 tokens.  Repeated rows are counted each; other columns
    are not carried, so their names cannot clash.
    """
    ship(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((raw, prove(raw)))
    key = hash(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _MADE:
            _MADE.clear()
            _MADE[key] = Counter(*shared.value)
        counter = _MADE[key]
        for batch in batches:
            texts = batch.column(1)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            counts = pa.array([counter.count(t.as_py()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, counts], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id_col)
