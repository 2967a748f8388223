"""Toxicity by two Kneser-Ney bigram models, one for toxic and one for ordinary texts.

Events are all words of the corpus, as 64-bit hashes.  A class's bigram counts fall back on
its word counts, and these on continuation counts (how many different words come before a
word) that all texts share, so rare expressions are smoothed alike in both models.  Each
word's difference of log likelihoods counts as far as the labelled texts bear it out: by
z^4 / (z^4 + TELLING^4), with z from the classes' shares of texts that hold the word or the
bigram.  A text's score is the sum, normalised by its length, through a logistic curve
fitted on a bounded number of labelled rows that the counts left out.

The distinct bigrams of a stretch of texts are dealt by their word, packed to a few bytes
each: words and contexts as sorted hashes, a bigram as two places in them, its texts as
places in the stretch.  A task merges what all stretches sent of its words, so it knows all
counts but those by context; these are summed by context and sent to the tasks that asked.
Bigrams are dealt once to be counted and once, with their texts, to be scored; a task sums
the gains of its words per text.  No table of all bigrams is written, and nothing of the
counts reaches the driver.  A text stands there as a digest of its bigrams, so no text is
shuffled for a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shipmeter.llm.lexer import Words, mix, sliced, words
from shipmeter.llm.shipping import ship
from shipmeter.session import materialize

CURVE_DOCS = 20_000  # labelled rows that fit the curve
DISCOUNT = 0.75
TELLING = 5.0  # standard deviations between the classes' shares of texts at which half of a gain counts
SIZE = 64  # words of the dense form in tests
STRETCH_WORDS = 2_500_000  # words packed together
BUCKET_BYTES = 16_000_000  # of text whose bigrams one task merges
LEAST_BUCKETS = 12
FOLD = 4  # buckets that a task scores one after the other, so that a text has few partial sums
LABELS_SENT = 4_000_000  # labelled rows that are sent to all tasks; more are merged with the texts

_U = np.uint64


class Model(NamedTuple):
    sums: DataFrame  # digest, gain: of each text of the corpus with words, gain summed over its bigrams
    counts: DataFrame  # blocks of the corpus, not run again unless other texts are scored
    buckets: int
    curve: np.ndarray  # weights of the logistic curve


class Pairs(NamedTuple):
    """Distinct bigrams of some rows; ``pair`` is a hash of both words, ``before`` 0 at the start of a row."""

    row: np.ndarray
    pair: np.ndarray
    before: np.ndarray
    word: np.ndarray
    times: np.ndarray
    digest: np.ndarray  # of each row's bigrams and their times


class Merged(NamedTuple):
    """Distinct bigrams of one bucket's blocks, and its words in ascending order."""

    pair: np.ndarray
    before: np.ndarray
    at: np.ndarray  # place of each bigram's word among ``words``
    counts: dict[str, np.ndarray]  # by class: occurrences and texts of each bigram
    words: np.ndarray
    kinds: np.ndarray  # bigrams of each word
    uses: dict[str, np.ndarray]  # by class: occurrences of each word, and texts that hold it
    back: np.ndarray  # place in ``pair`` of each block's bigrams, one block after the other


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def _hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(before + _U(0xA0761D6478BD642F)) ^ word)


def _before(w: Words) -> np.ndarray:
    before = np.concatenate((np.zeros(1, _U), w.hashes))[: len(w.hashes)]
    before[w.first[:-1][np.diff(w.first) > 0]] = 0
    return before


def _digests(w: Words) -> np.ndarray:
    """Of each row's bigrams and their times, in any order."""
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(mix(_hash(_before(w), w.hashes)), dtype=_U)))
    return mix(sums[w.first[1:]] - sums[w.first[:-1]] + np.diff(w.first).astype(_U)).view(np.int64)


def _pairs(texts: pa.Array) -> Pairs:
    w = words(texts)
    row, before = w.row_of(), _before(w)
    pair = _hash(before, w.hashes)
    order = np.lexsort((pair, row))
    fresh = np.ones(len(row), bool)
    fresh[1:] = (pair[order][1:] != pair[order][:-1]) | (row[order][1:] != row[order][:-1])
    starts = np.flatnonzero(fresh)
    first = order[starts]
    times = np.diff(np.append(starts, len(row)))
    return Pairs(row[first], pair[first].view(np.int64), before[first].view(np.int64), w.hashes[first].view(np.int64), times, _digests(w))


CLASSES = ("toxic", "plain")
_COUNTS = [f"{c}{x}" for x in ("", "_texts") for c in CLASSES]
_HELD = [f"{c}_held" for c in CLASSES]
#: Of the bucket's words: hash, number of bigrams, texts by class; of its contexts: hash; of its bigrams: place of the context, counts.
_BLOCK = ["word", "pairs", *_HELD, "context", "at", *_COUNTS]
#: How many texts hold each bigram; place of each of them among the digests, times it holds the bigram; digests.
_TEXTS = ["holders", "text", "times", "digest"]
_STATS = [f"{c}{x}" for x in ("", "_kinds") for c in CLASSES]
_ASKED = ["bits", "context", *_STATS]


def _pack(a: np.ndarray) -> bytes:
    """Whole numbers from 0, each in the bytes that the largest needs, compressed place by place."""
    if not len(a):
        return b""
    a = a.astype(np.min_scalar_type(a.max()))
    planes = a.view(np.uint8).reshape(len(a), -1).T.tobytes()
    return bytes([a.itemsize]) + len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpack(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, _U)
    planes = np.frombuffer(pa.decompress(b[9:], int.from_bytes(b[1:9], "little"), "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(b[0], -1).T).view(f"u{b[0]}").ravel()


def _pack_hashes(a: np.ndarray, bits: int = 64) -> bytes:
    """The first ``bits`` of ascending hashes."""
    return _pack(np.diff(a >> _U(64 - bits), prepend=_U(0)))


def _unpack_hashes(b: bytes, bits: int = 64) -> np.ndarray:
    return np.cumsum(_unpack(b), dtype=_U) << _U(64 - bits)


def _pack_places(a: np.ndarray, starts: np.ndarray) -> bytes:
    """Places that ascend from each of ``starts`` to the next."""
    steps = np.diff(a, prepend=0)
    steps[starts] = a[starts]
    return _pack(steps)


def _unpack_places(b: bytes, sizes: np.ndarray) -> np.ndarray:
    sums = np.cumsum(_unpack(b), dtype=np.int64)
    ends = np.cumsum(sizes, dtype=np.int64)
    return sums - np.repeat(np.concatenate((np.zeros(1, np.int64), sums[ends[:-1] - 1])), sizes)


def _bits(hashes: np.ndarray) -> int:
    """How many first bits tell ascending distinct hashes apart."""
    if len(hashes) < 2:
        return 32
    least = int((hashes[1:] ^ hashes[:-1]).min())
    return max(32, 65 - least.bit_length())


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ascends with the hash."""
    return ((hashes >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _blocks(w: Words, label: np.ndarray, buckets: int, texts: bool, bits: int) -> Iterator[dict]:
    """The distinct bigrams of a stretch of rows, a block for each bucket of words that occur."""
    names, at = np.unique(w.hashes, return_inverse=True)
    row, rows = w.row_of().astype(np.int32), len(label)
    key = at * (len(names) + 1)
    key[1:] += at[:-1] + 1
    begins = w.first[:-1][np.diff(w.first) > 0]
    key[begins] = at[begins] * (len(names) + 1)  # place of the context 0: the start of a row
    of = label[row]
    uses = {c: np.bincount(np.unique(at[of == k] * rows + row[of == k]) // rows, minlength=len(names)) for c, k in zip(_HELD, (1, 0))}
    del at
    order = np.argsort(key, kind="stable")  # rows ascend within a key
    key, row, of = key[order], row[order], of[order]
    del order
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(fresh)
    times, key, row, of = np.diff(np.append(starts, len(key))), key[starts], row[starts], of[starts]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(fresh)
    sums = dict(zip(_COUNTS, [np.add.reduceat(x * (of == k), starts) for x in (times, 1) for k in (1, 0)])) if len(starts) else {}
    if texts:  # equal texts once
        one = np.zeros(rows, bool)
        digest = _digests(w)
        one[np.unique(digest, return_index=True)[1]] = True
        chosen = one[row]
        row, times = row[chosen], times[chosen]
        holders = np.add.reduceat(chosen.astype(np.int64), starts) if len(starts) else starts
        ends = np.concatenate(([0], np.cumsum(holders)))
    key = key[starts]
    word, context = key // (len(names) + 1), key % (len(names) + 1)
    named = np.concatenate((np.zeros(1, _U), names))
    begin = np.searchsorted(_bucket(names, buckets), np.arange(buckets + 1))
    cut = np.searchsorted(word, begin)
    for bucket in np.flatnonzero(np.diff(begin)):
        own, some = slice(begin[bucket], begin[bucket + 1]), slice(cut[bucket], cut[bucket + 1])
        used, place = np.unique(context[some], return_inverse=True)
        pairs = np.bincount(word[some] - own.start)
        out = {"word": _pack_hashes(names[own], bits), "pairs": _pack(pairs), "context": _pack_hashes(named[used], bits), "at": _pack_places(place, np.cumsum(pairs) - pairs)}
        out |= {c: _pack(x[own]) for c, x in uses.items()} | {c: _pack(x[some]) for c, x in sums.items()}
        if texts:
            inside = slice(ends[some.start], ends[some.stop])
            there, nth = np.unique(row[inside], return_inverse=True)
            out |= {"holders": _pack(holders[some]), "text": _pack_places(nth, ends[some] - ends[some.start]), "times": _pack(times[inside]), "digest": _pack(digest[there].view(_U))}
        yield {"bucket": int(bucket), **out}


def _counted(marked: DataFrame, buckets: int = LEAST_BUCKETS, texts: bool = False, bits: int = 64) -> DataFrame:
    """Blocks of the bigrams of all texts, by bucket of their word; with ``texts``, which texts hold them.

    ``marked`` has ``text`` and ``label``, null where the text counts for no class.  Of words
    and contexts the first ``bits`` of the hash are sent; they must tell those of a bucket apart.
    """
    columns = _BLOCK + _TEXTS * texts
    schema = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in columns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Words] = []
        labels: list[np.ndarray] = []

        def stretch() -> pa.RecordBatch:
            sizes = np.concatenate([np.diff(w.first) for w in held])
            w = Words(np.concatenate([w.hashes for w in held]), np.concatenate(([0], np.cumsum(sizes))))
            label = np.concatenate(labels)
            held.clear()
            labels.clear()
            return pa.RecordBatch.from_pylist(list(_blocks(w, label, buckets, texts, bits)), schema)

        for batch in sliced(batches, 0):
            held.append(words(batch.column(0)))
            labels.append(batch.column(1).fill_null(2).to_numpy(zero_copy_only=False))
            if sum(len(w.hashes) for w in held) >= STRETCH_WORDS:
                yield stretch()
        if held:
            yield stretch()

    kinds = ", ".join(["bucket int", *[f"{c} binary" for c in columns]])
    return marked.select("text", "label").mapInArrow(run, kinds)


def _merged(blocks: list[dict], bits: int = 64) -> Merged:
    word = [_unpack_hashes(b["word"], bits) for b in blocks]
    pairs = [_unpack(b["pairs"]) for b in blocks]
    each = np.concatenate([np.repeat(w, n) for w, n in zip(word, pairs)])
    before = np.concatenate([_unpack_hashes(b["context"], bits)[_unpack_places(b["at"], n)] for b, n in zip(blocks, pairs)])
    pair = _hash(before, each)
    order = np.argsort(pair)
    pair = pair[order]
    fresh = np.ones(len(pair), bool)
    fresh[1:] = pair[1:] != pair[:-1]
    back = np.empty(len(pair), np.int32)
    back[order] = np.cumsum(fresh, dtype=np.int32) - 1
    pair, first = pair[fresh], order[fresh]
    each, before = each[first], before[first]
    del order, fresh, first
    summed = lambda c, back, n: np.bincount(back, np.concatenate([_unpack(b[c]) for b in blocks]), n)
    counts = {c: summed(c, back, len(pair)) for c in _COUNTS}
    words_, back_ = np.unique(np.concatenate(word), return_inverse=True)
    at = np.searchsorted(words_, each).astype(np.int32)
    uses = {c: np.bincount(at, counts[c], len(words_)) for c in CLASSES} | {c: summed(c, back_, len(words_)) for c in _HELD}
    return Merged(pair, before, at, counts, words_, np.bincount(at, minlength=len(words_)), uses, back)


def _contexts(counts: DataFrame, buckets: int, every: bool = False) -> DataFrame:
    """What each bucket needs of its contexts: ``bucket``, packed ``context`` and counts by class; and rows of totals.

    ``bits``: how many first bits of a hash tell the bucket's words and contexts apart.

    The counts are those of the whole corpus; contexts that no counted text holds are left out,
    and without ``every`` those of words that no counted text holds, whose gain is 0.
    """
    totals = ["shared", *CLASSES, *[f"{c}_words" for c in CLASSES], *[f"{c}_starts" for c in CLASSES]]
    columns = ["home", "bucket", *_ASKED, *[f"total_{c}" for c in totals]]
    kind = {c: "int" if c in ("home", "bucket", "bits") else "double" if c.startswith("total_") else "binary" for c in columns}
    kinds = ", ".join(f"{c} {k}" for c, k in kind.items())
    schema = pa.schema([(c, {"int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}[k]) for c, k in kind.items()])

    def ask(group: pa.Table) -> pa.Table:
        m = _merged(group.to_pylist())
        start = m.before == 0
        sums = [m.kinds.sum() + 0.5 * len(m.words), *[m.uses[c].sum() for c in CLASSES], *[(m.uses[c] > 0).sum() for c in CLASSES], *[m.counts[c][start].sum() for c in CLASSES]]
        bits = max(_bits(m.words), _bits(np.unique(m.before)))
        rows = [{"bits": bits, **dict(zip((f"total_{c}" for c in totals), map(float, sums)))}]
        tells = (m.uses["toxic"] + m.uses["plain"] > 0)[m.at] | every
        context, back = np.unique(m.before[tells], return_inverse=True)
        stats = {c + x: np.bincount(back, f(m.counts[c][tells]), len(context)) for c in CLASSES for x, f in (("", lambda n: n), ("_kinds", lambda n: n > 0))}
        cut = np.searchsorted(_bucket(context, buckets), np.arange(buckets + 1))
        for home in np.flatnonzero(np.diff(cut)):
            own = slice(cut[home], cut[home + 1])
            rows.append({"home": int(home), "bucket": group["bucket"][0].as_py(), "bits": bits, "context": _pack_hashes(context[own]), **{c: _pack(x[own].astype(np.int64)) for c, x in stats.items()}})
        return pa.Table.from_pylist(rows, schema)

    def answer(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        if rows[0]["home"] is None:  # totals
            return group
        asked = [_unpack_hashes(r["context"]) for r in rows]
        context, back = np.unique(np.concatenate(asked), return_inverse=True)
        stats = {c: np.bincount(back, np.concatenate([_unpack(r[c]) for r in rows]), len(context)).astype(np.int64) for c in _STATS}
        seen = stats["toxic"] + stats["plain"] > 0
        for r, own in zip(rows, np.split(back, np.cumsum([len(a) for a in asked])[:-1])):
            own = own[seen[own]]
            r |= {"context": _pack_hashes(context[own], r["bits"])} | {c: _pack(x[own]) for c, x in stats.items()}
        return pa.Table.from_pylist(rows, schema)

    asked = counts.select("bucket", *_BLOCK).groupBy("bucket").applyInArrow(ask, kinds)
    return asked.groupBy("home").applyInArrow(answer, kinds)


def _rated(m: Merged, contexts: list[dict], total: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """log P toxic - log P ordinary of each bigram, and the weight it counts with."""
    bits = contexts[0]["bits"] if contexts else 64
    known = np.concatenate([np.zeros(0, _U), *[_unpack_hashes(r["context"], bits) for r in contexts]])
    order = np.argsort(known)
    known, before = np.append(known[order], _U(2**64 - 1)), m.before >> _U(64 - bits) << _U(64 - bits)
    place = np.searchsorted(known, before)
    found = known[place] == before
    context = {c: np.append(np.concatenate([np.zeros(0), *[_unpack(r[c]) for r in contexts]])[order], 0)[place] * found for c in _STATS}
    shared = (m.kinds + 0.5) / (total["shared"] or 1)

    def log_p(c: str) -> np.ndarray:
        base = shared
        if total[c]:
            base = (np.maximum(m.uses[c] - DISCOUNT, 0) + DISCOUNT * total[f"{c}_words"] * shared) / total[c]
        base, seen = base[m.at], context[c]
        own = (np.maximum(m.counts[c] - DISCOUNT, 0) + DISCOUNT * context[f"{c}_kinds"] * base) / np.maximum(seen, 1)
        return np.log(np.where(seen > 0, own, base))

    def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The square of z of the two shares of texts; without texts of both classes nothing tells."""
        n, k = total["toxic_starts"], total["plain_starts"]
        if not (n and k):
            return np.zeros(len(a))
        pooled = (a + b) / (n + k)
        return (a / n - b / k) ** 2 / (pooled * (1 - pooled) * (1 / n + 1 / k) + 1e-12)

    z2 = np.maximum(squared(m.uses["toxic_held"], m.uses["plain_held"])[m.at], squared(m.counts["toxic_texts"], m.counts["plain_texts"]))
    told = (m.uses["toxic"] + m.uses["plain"] > 0)[m.at]
    return log_p("toxic") - log_p("plain"), np.where(told, z2 * z2 / (z2 * z2 + TELLING**4), 0.0)


def _totals(contexts: DataFrame) -> dict[str, float]:
    names = [c for c in contexts.columns if c.startswith("total_")]
    row = contexts.filter("home is null").agg(*[F.sum(c).alias(c) for c in names], F.max("bits").alias("bits")).first()
    return {c.removeprefix("total_"): row[c] or 0.0 for c in names} | {"bits": row.bits or 64}


def _beside(counts: DataFrame, contexts: DataFrame, fold: int = 1):
    """The blocks of ``fold`` buckets with what these need of their contexts."""
    part = F.floor(F.col("bucket") / fold).cast("int")
    asked = contexts.filter("home is not null").select("bucket", *_ASKED)
    return counts.groupBy(part.alias("part")).cogroup(asked.groupBy(part.alias("part")))


def gains(counts: DataFrame, buckets: int = LEAST_BUCKETS) -> DataFrame:
    """``pair``, ``ratio`` (log P toxic - log P ordinary) and ``gain`` (weighted) of all bigrams in ``_counted``'s blocks."""
    contexts = materialize(_contexts(counts, buckets, every=True), "contexts")
    total = _totals(contexts)

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return pa.table({"pair": pa.array([], pa.int64()), "ratio": pa.array([], pa.float64()), "gain": pa.array([], pa.float64())})
        m = _merged(blocks.to_pylist())
        ratio, weight = _rated(m, asked.to_pylist(), total)
        return pa.table({"pair": m.pair.view(np.int64), "ratio": ratio, "gain": ratio * weight})

    return _beside(counts, contexts).applyInArrow(run, "pair long, ratio double, gain double")


def _sums(marked: DataFrame, contexts: DataFrame, buckets: int, fold: int = 1) -> DataFrame:
    """``digest`` and ``gain`` of each text of ``marked`` with words, equal texts once."""
    total = _totals(contexts)
    bits = total["bits"]
    counts = _counted(marked, buckets, True, bits)

    def of_bucket(rows: list[dict], asked: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        m = _merged(rows, bits)
        ratio, weight = _rated(m, asked, total)
        gain, digests, sums, start = ratio * weight, [], [], 0
        for r in rows:
            holders = _unpack(r["holders"])
            pair = np.repeat(m.back[start : start + len(holders)], holders)
            start += len(holders)
            digests.append(_unpack(r["digest"]).view(np.int64))
            sums.append(np.bincount(_unpack_places(r["text"], holders), gain[pair] * _unpack(r["times"]), len(digests[-1])))
        digest, first = np.unique(np.concatenate(digests), return_index=True)  # every copy has the same sum
        return digest, np.concatenate(sums)[first]

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        digests, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
        for bucket in pc.unique(blocks["bucket"]).to_pylist():
            digest, gain = of_bucket(*[t.filter(pc.equal(t["bucket"], bucket)).to_pylist() for t in (blocks, asked)])
            digests.append(digest)
            sums.append(gain)
        digest, back = np.unique(np.concatenate(digests), return_inverse=True)
        return pa.table({"digest": digest, "gain": np.bincount(back, np.concatenate(sums), len(digest))})

    parts = _beside(counts, contexts, fold).applyInArrow(run, "digest long, gain double")
    return parts.groupBy("digest").agg(F.sum("gain").alias("gain"))


def _unbounded(side: DataFrame) -> DataFrame:
    """A side that grows with the corpus: merged at every size, never broadcast."""
    return side.hint("merge")


def kneser_ney(counts: np.ndarray, every: np.ndarray) -> np.ndarray:
    """log P(w | u) of one class as ``gains`` has it, from dense bigram counts of the class and of all texts."""
    kinds = (every > 0).sum(axis=0).astype(float) + 0.5
    base = kinds / kinds.sum()
    single = counts.sum(axis=0)
    if single.any():
        base = (np.maximum(single - DISCOUNT, 0) + DISCOUNT * (single > 0).sum() * base) / single.sum()
    total = counts.sum(axis=1, keepdims=True)
    held = DISCOUNT * (counts > 0).sum(axis=1, keepdims=True)
    own = np.maximum(counts - DISCOUNT, 0)
    return np.log(np.where(total > 0, (own + held * base) / np.maximum(total, 1), base))


def _features(gain: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(gain), 20 * gain / np.maximum(n, 1), gain / np.sqrt(np.maximum(n, 1)), np.log1p(n) / 5], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + 0.1 * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _heads(rows: DataFrame) -> DataFrame:
    """``id``, ``n`` (words) and ``digest`` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            w = words(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(w.first)), pa.array(_digests(w))], ["id", "n", "digest"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text").mapInArrow(run, f"id {kind}, n long, digest long")


def _entries(rows: DataFrame) -> DataFrame:
    """``digest``, ``pair``, ``times``: the distinct bigrams of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0):
            p = _pairs(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(p.digest[p.row]), pa.array(p.pair), pa.array(p.times.astype(np.int32))], ["digest", "pair", "times"])

    return rows.select("text").mapInArrow(run, "digest long, pair long, times int")


def _gained(rows: DataFrame, model: Model) -> DataFrame:
    """``id``, ``n``, ``digest`` and ``gain``, the summed log-likelihood difference, of each row."""
    known = materialize(_heads(rows).join(_unbounded(model.sums), "digest", "left"), "heads")
    other = known.filter("n > 0 and gain is null").groupBy("digest").agg(F.count("*").alias("copies"))  # no text of the fit
    if other.isEmpty():
        return known.withColumn("gain", F.coalesce("gain", F.lit(0.0)))
    entries = _entries(rows).join(_unbounded(other.select("digest")), "digest", "left_semi")
    sums = entries.join(_unbounded(gains(model.counts, model.buckets).filter("gain <> 0").select("pair", "gain")), "pair").groupBy("digest").agg(F.sum(F.col("gain") * F.col("times")).alias("sum"))
    each = other.join(_unbounded(sums), "digest").select("digest", (F.col("sum") / F.col("copies")).alias("own"))  # each copy was summed
    return known.join(_unbounded(each), "digest", "left").withColumn("gain", F.coalesce("gain", "own", F.lit(0.0))).drop("own")


def _score(model: Model) -> Column:
    n = F.greatest(F.col("n"), F.lit(1))
    parts = [F.lit(1.0), 20 * F.col("gain") / n, F.col("gain") / F.sqrt(n), F.log1p("n") / 5]
    z = sum((F.lit(float(w)) * p for w, p in zip(model.curve, parts)), F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, kept_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Model, DataFrame]:
    """The model and ``id`` and ``text`` of every row of ``docs``.

    ``kept_out``: a condition on column ``id``; where it holds no label is read.  Of the
    other labelled rows a fifth, by hash, fits the curve and the rest is counted.  Labels
    other than 0 and 1, and several labels of one id that differ, teach nothing.
    """
    ship(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    taught = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    one = taught.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most")
    one = materialize(
        one.filter(~kept_out).select("id", "label", (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(5)) == 0).alias("curve")), "labels"
    )
    counted = one.filter("not curve").select("id", "label")
    marked = rows.join(F.broadcast(counted) if counted.count() <= LABELS_SENT else counted, "id", "left")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_BUCKETS, -(-size // (FOLD * BUCKET_BYTES)))
    fold = max(1, -(-size // (parts * BUCKET_BYTES)))
    buckets = parts * fold
    counts = _counted(marked, buckets)
    contexts = materialize(_contexts(counts, buckets), "contexts")
    sums = materialize(_sums(marked, contexts, buckets, fold), "sums")
    model = Model(sums, counts, buckets, np.zeros(4))
    shown = one.filter("curve").orderBy(F.xxhash64("id"), "id").limit(CURVE_DOCS)
    shown = materialize(shown.select("id", "label"), "shown")
    seen = _gained(rows.join(F.broadcast(shown), "id", "left_semi"), model)
    seen = seen.join(F.broadcast(shown), "id").select("n", "label", "gain").toPandas()
    x = _features(seen["gain"].to_numpy(float), seen["n"].to_numpy(float))
    return model._replace(curve=_logistic(x, seen["label"].to_numpy(float))), rows


def score(every: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) for every row of ``every`` (``id``, ``text``).

    A bigram that no text of the fit holds says nothing.
    """
    return _gained(every, model).select(F.col("id").alias(id_col), _score(model).alias("score"))


def without_toxic(docs: DataFrame, model: Model, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, all columns kept.

    A null text scores as a text of no words.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    gained = _gained(docs.select(F.lit(0).alias("id"), text), model)
    high = gained.filter(_score(model) >= limit).select(F.col("digest").alias("high")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_digests(words(batch.column(1))))], ["row", "digest"])

    held = docs.select(row, text)
    held = held.mapInArrow(run, StructType([held.schema["row"], StructField("digest", LongType())]))
    return held.join(_unbounded(high), F.col("digest") == F.col("high"), "left_anti").select("row.*")


def score_documents(docs: DataFrame, labels: DataFrame, kept_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` for every row of ``docs``, from a model fitted on its labelled rows.

    Null and empty texts score as texts of no words.  Without labels of both classes all
    texts of one length score nearly alike.  Repeated rows are scored each; other columns are
    not read.
    """
    model, every = fit(docs, labels, kept_out, id_col, text_col)
    return score(every, model, id_col)
