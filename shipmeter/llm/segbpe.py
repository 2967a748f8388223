"""BPE by a segment tree over the ranks of adjacent pairs.

Leaf ``i`` of the tree holds the rank of the pair that starts at symbol ``i``, and every
node the least (rank, position) below it, so the root names the leftmost lowest-rank
merge.  A merge changes three leaves, each repaired on its path to the root; the loop
ends when the root holds no mergeable pair.

Short words are merged many at a time, one tree per row of a numpy table; long words
walk a tree of their own.  Each distinct word of a task is merged once and remembered
in a cache of bounded size.  One narrow map step, no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipmeter.llm.pretokens import ALPHABET, WORD_PATTERN, Cutter
from shipmeter.llm.shipping import ship

CACHE_WORDS = 400_000
CACHE_LENGTH = 48
WIDE = 64  # symbols; longer words get a tree of their own
NONE = np.int64(1) << 60
END = "</w>"  # fixed value: the word-end mark of this vocabulary family


class Merges:
    """The merge list as sorted pair keys, searchable one by one or by array."""

    def __init__(self, raw: str) -> None:
        model = json.loads(raw)["model"]
        vocab: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.base = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        _, first = np.unique(keys, return_index=True)  # of a repeated pair the lowest rank
        self.keys, self.ranks = keys[first], first.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        self.inner = np.array([vocab[ch] for ch in ALPHABET], np.int32)
        self.final = np.array([vocab[ch + END] for ch in ALPHABET], np.int32)

    def symbols(self, word: str) -> np.ndarray:
        data = np.frombuffer(word.encode(), np.uint8)
        out = self.inner[data]
        out[-1] = self.final[data[-1]]
        return out

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)


def merge_long(symbols: np.ndarray, merges: Merges) -> list[int]:
    """Merges one word with a tree of its own: n leaves, log n per update."""
    n = len(symbols)
    size = 1 << max(1, (n - 1).bit_length())
    sym = symbols.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank_of, base, none = merges.rank_of, merges.base, (1 << 60, 0)
    tree = [none] * (2 * size)
    for i in range(n - 1):
        if (r := rank_of.get(sym[i] * base + sym[i + 1])) is not None:
            tree[size + i] = (r, i)
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(i: int) -> None:
        j = after[i]
        r = rank_of.get(sym[i] * base + sym[j]) if j < n else None
        node = size + i
        tree[node] = none if r is None else (r, i)
        while node > 1:
            node >>= 1
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

    alive = [True] * n
    while tree[1] is not none:
        rank, i = tree[1]
        j = after[i]
        sym[i], alive[j] = int(merges.made[rank]), False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        after[j] = n
        put(j)
        put(i)
        if before[i] >= 0:
            put(before[i])
    return [s for s, a in zip(sym, alive) if a]


def merge_many(words: list[np.ndarray], merges: Merges) -> list[list[int]]:
    """Merges words of at most ``WIDE`` symbols, a tree per row."""
    done: list[list[int]] = [[]] * len(words)
    classes: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        classes.setdefault(1 << max(1, (len(w) - 1).bit_length()), []).append(k)
    for size, members in classes.items():
        n = len(members)
        length = np.array([len(words[k]) for k in members])
        cols = np.arange(size)
        inside = cols < length[:, None]
        sym = np.zeros((n, size + 1), np.int32)
        sym[:, :size][inside] = np.concatenate([words[k] for k in members])
        after = np.minimum(np.broadcast_to(cols + 1, (n, size)), length[:, None]).copy()
        before = np.broadcast_to(cols - 1, (n, size)).copy()
        tree = np.full((n, 2 * size), NONE)
        paired = cols[:-1] + 1 < length[:, None]
        rank = merges.lookup(sym[:, : size - 1][paired], sym[:, 1:size][paired])
        leaf = np.full((n, size - 1), NONE)
        leaf[paired] = np.where(rank == NONE, NONE, rank * size + np.nonzero(paired)[1])
        tree[:, size : 2 * size - 1] = leaf
        low = size
        while low > 1:
            low >>= 1
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])

        def put(rows: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
            node = i + size
            tree[rows, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def pair_value(rows: np.ndarray, i: np.ndarray) -> np.ndarray:
            j = after[rows, i]
            has = j < length[rows]
            r = merges.lookup(sym[rows, i], sym[rows, j])
            return np.where(has & (r != NONE), r * size + i, NONE)

        rows = np.nonzero(tree[:, 1] != NONE)[0]
        while len(rows):
            root = tree[rows, 1]
            i, made = root % size, merges.made[root // size]
            j = after[rows, i]
            k = after[rows, j]
            sym[rows, i] = made
            inside[rows, j] = False
            after[rows, i] = k
            linked = k < length[rows]
            before[rows[linked], k[linked]] = i[linked]
            put(rows, j, np.full(len(rows), NONE))
            put(rows, i, pair_value(rows, i))
            h = before[rows, i]
            has = h >= 0
            if has.any():
                put(rows[has], h[has], pair_value(rows[has], h[has]))
            rows = rows[tree[rows, 1] != NONE]
        for r, k in enumerate(members):
            done[k] = sym[r, :size][inside[r]].tolist()
    return done


class Codec:
    """Encodes and decodes texts with one vocabulary file."""

    def __init__(self, raw: str) -> None:
        self.merges = Merges(raw)
        self.cutter = Cutter(raw, WORD_PATTERN, folded=True)
        spec = json.loads(raw)
        self.tokens = {i: t for t, i in spec["model"]["vocab"].items()}
        self.tokens |= {t["id"]: t["content"] for t in spec["added_tokens"]}
        self._known: dict[str | int, list[int]] = {}

    def encode_all(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of each text; the distinct words of all of them are merged together."""
        if len(self._known) > CACHE_WORDS:
            self._known.clear()
        cut = [self.cutter.cut(t) if t else [] for t in texts]
        new = list({w for pieces in cut for w in pieces if w not in self._known})
        known = self._known
        short: list[tuple[str, np.ndarray]] = []
        passing = []
        for w in new:
            if isinstance(w, int):
                known[w] = [w]
                continue
            if len(w) > CACHE_LENGTH:
                passing.append(w)
            symbols = self.merges.symbols(w)
            if len(symbols) > WIDE:
                known[w] = merge_long(symbols, self.merges)
            else:
                short.append((w, symbols))
        for (w, _), ids in zip(short, merge_many([s for _, s in short], self.merges)):
            known[w] = ids
        for pieces in cut:
            yield list(chain.from_iterable(map(known.__getitem__, pieces)))
        for w in passing:
            del known[w]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by one space."""
        return " ".join(map(self.tokens.__getitem__, ids))


_MADE: dict[int, Codec] = {}


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (array of int) and ``decoded`` (string) for every row.

    ``path`` is the vocabulary file (BPE with word ends), read on the driver.  Null and
    empty texts give no ids and an empty decoded text.  Repeated rows are encoded each;
    other columns are not carried, so their names cannot clash.
    """
    ship(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    key = hash(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _MADE:
            _MADE.clear()
            _MADE[key] = Codec(shared.value)
        codec = _MADE[key]
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                ids = list(codec.encode_all(batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(codec.decode, ids), pa.string())],
                    ["id", "ids", "decoded"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)
