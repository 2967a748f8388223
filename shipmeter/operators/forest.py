"""Random forests that grow and score over numpy blocks of rows.

Growing.  Spark bins the rows (a bin per value, or approximate percentiles) and packs
them into blocks of bytes.  The trees are dealt to as many groups as the cluster has
cores; a task reads all blocks into one matrix of a byte per row and feature, which past
``HELD_BYTES`` lies in a mapped file of its own machine, and grows the trees of its group
in turn, small ones some together.  Beside the matrix it holds the labels and a few numbers
a row.  Each tree draws its rows with replacement (Poisson weights of its seed), considers
every feature at each split and splits at the largest fall of variance, least feature and
bin first, while each side keeps ``min_leaf`` drawn rows.  A level is one pass: large nodes
by histograms, nodes of at most 64 rows by sorting their bins.  No tree reaches the driver
for that; they are rows of a written table.

Scoring.  Rows are cut once into bins, so a node is one integer, and a block of rows walks
one tree at a time, level by level.  A forest of at most ``HELD_NODES`` nodes is broadcast.
A larger one stays where it is: its trees are dealt to tasks, every task reads all packed
rows, and a block's sums meet in the order of the groups, so a forest scores alike each time.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from shipmeter.operators.histboost import bin_edges
from shipmeter.session import materialize, scratch_path

#: Rows that walk a tree together, so that their bins stay in a core's cache.
BLOCK = 4096
#: Bits of a node below its left child: its feature and its bin.
_BITS = 16
#: Nodes of a forest that every task may hold whole (16 bytes each).
HELD_NODES = 1 << 21
#: Bytes of nodes that a task holds of a larger forest.
GROUP_BYTES = 256 << 20
#: Bytes of binned rows that a growing task holds in memory.
HELD_BYTES = 256 << 20
#: Rows of the trees that a task grows together, so that a level of small trees is not all overhead.
TOGETHER = 1 << 20
#: Nodes in a row of the table of trees.
_PART = 1 << 16


@dataclass(frozen=True)
class ForestConfig:
    rounds: int = 200
    depth: int = 20
    min_leaf: int = 2
    bins: int = 64
    seed: int = 42


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees by tree; the children of a node lie side by side.

    ``node`` holds ``left child << 32 | feature << 16 | bin``; a leaf is its own left child
    and sends every row there.
    """

    roots: np.ndarray
    node: np.ndarray
    value: np.ndarray


# --- growing -----------------------------------------------------------------


def _grower() -> Callable:
    """A function that grows trees together, made here so that it travels in the tasks' closures."""
    piece, small, bits = 1 << 18, 64, _BITS

    def pieces(n: int):
        return [slice(a, min(a + piece, n)) for a in range(0, n, piece)]

    def better(score, feature, cut, best, best_f, best_b, nodes):
        up = score > best[nodes]
        at = nodes[up]
        best[at], best_f[at], best_b[at] = score[up], feature, cut[up]

    def large_nodes(x, y, rows, drawn, start, nodes, total, best, across, least):
        """Best splits of ``nodes`` from histograms, some nodes at a time."""
        size = np.diff(start)
        first = 0
        while first < len(nodes):
            last = first + 1
            held = size[nodes[first]]
            while last < len(nodes) and last - first < 1024 and held + size[nodes[last]] <= piece:
                held += size[nodes[last]]
                last += 1
            some, first = nodes[first:last], last
            sums, counts = total[0][some, None], total[1][some, None]
            if len(some) == 1:
                lo = start[some[0]]
                parts = [(rows[lo + s.start : lo + s.stop], drawn[lo + s.start : lo + s.stop], 0) for s in pieces(held)]
            else:
                each = [slice(start[k], start[k + 1]) for k in some]
                nth = np.repeat(np.arange(len(some)), size[some])
                parts = [(np.concatenate([rows[s] for s in each]), np.concatenate([drawn[s] for s in each]), nth)]
            parts = [(at, nth, w.astype(np.float64), w * y.take(at)) for at, w, nth in parts]
            for f, wide in enumerate(across):
                if wide < 2:
                    continue
                cells = len(some) * wide
                n, s = np.zeros(cells), np.zeros(cells)
                for at, nth, w, wy in parts:
                    cell = nth * wide + x[f].take(at)
                    n += np.bincount(cell, w, cells)
                    s += np.bincount(cell, wy, cells)
                n = n.reshape(-1, wide).cumsum(1)[:, :-1]
                s = s.reshape(-1, wide).cumsum(1)[:, :-1]
                rest = counts - n
                with np.errstate(divide="ignore", invalid="ignore"):
                    found = s * s / n + (sums - s) ** 2 / rest
                found[(n < least) | (rest < least)] = -np.inf
                b = found.argmax(1)
                better(found[np.arange(len(some)), b], f, b, *best, some)

    def small_nodes(x, y, rows, drawn, start, nodes, total, best, least):
        """Best splits of nodes of at most 64 rows, each by its rows in the order of their bins."""
        size = np.diff(start)[nodes]
        width = 2
        while width <= small:
            fit, step = nodes[(size <= width) & ((size > width // 2) | (width == 2))], piece // 8 // width
            place = np.arange(width, dtype=np.uint16)
            for a in range(0, len(fit), step):
                some = fit[a : a + step]
                kept = place < (start[some + 1] - start[some])[:, None]
                past = np.where(kept, 0, 0xFFC0).astype(np.uint16)  # beyond every bin
                spot = np.where(kept, start[some][:, None] + place, 0)
                at = rows.take(spot)
                w = np.where(kept, drawn.take(spot), 0).astype(np.float64)
                wy = (w * y.take(at)).ravel()
                w = w.ravel()
                base = np.arange(len(some))[:, None] * width
                sums, counts = total[0][some, None], total[1][some, None]
                for f in range(len(x)):
                    bins = x[f].take(at)
                    # A feature of one bin within a node cannot split it.
                    mine = np.flatnonzero(((bins != bins[:, :1]) & kept).any(1))
                    if not len(mine):
                        continue
                    key = bins[mine].astype(np.uint16) << 6 | place | past[mine]
                    key.sort(axis=1)
                    bins = key >> 6
                    order = base[mine] + (key & 63)
                    n = w.take(order).cumsum(1)[:, :-1]
                    s = wy.take(order).cumsum(1)[:, :-1]
                    rest = counts[mine] - n
                    with np.errstate(divide="ignore", invalid="ignore"):
                        found = s * s / n + (sums[mine] - s) ** 2 / rest
                    found[(n < least) | (rest < least) | (bins[:, 1:] == bins[:, :-1])] = -np.inf
                    b, row = found.argmax(1), np.arange(len(mine))
                    better(found[row, b], f, bins[row, b], *best, some[mine])
            width *= 2

    def grow(x, y, centre: float, weights, depth: int, least: int, across: list[int]):
        """Per tree of ``weights`` (draws by row) its nodes, their values and the fall of squares
        by feature; ``y`` is the label less ``centre`` and ``across`` the number of bins by feature.
        All trees grow level by level together."""
        leaf, count = (1 << bits) - 1, len(weights)
        whole = [np.flatnonzero(w) for w in weights]
        alive = np.array([t for t in range(count) if len(whole[t])], np.int64)
        rows = np.concatenate(whole).astype(np.int32 if len(y) < 1 << 31 else np.int64)
        drawn = np.concatenate([w[r] for w, r in zip(weights, whole)])
        start = np.concatenate([[0], np.cumsum([len(whole[t]) for t in alive])]).astype(np.int64)
        del whole
        trees, fall, base = alive, np.zeros((count, len(x))), np.zeros(count, np.int64)
        nodes, values, owners = [], [], []
        for level in range(depth + 1 if len(alive) else 0):
            k = len(start) - 1
            own = np.repeat(np.arange(k, dtype=np.int32), np.diff(start))
            sums, counts, squares = np.zeros(k), np.zeros(k), np.zeros(k)
            for s in pieces(len(rows)):
                lo = own[s.start]
                w, v, to = drawn[s].astype(np.float64), y.take(rows[s]), own[s] - lo
                hi = lo + int(to[-1]) + 1
                counts[lo:hi] += np.bincount(to, w)
                sums[lo:hi] += np.bincount(to, w * v)
                squares[lo:hi] += np.bincount(to, w * v * v)
            feature, cut, score = np.zeros(k, np.int64), np.zeros(k, np.int64), np.full(k, -np.inf)
            # A gain below the noise of the sums is none.
            floor = sums * sums / counts + 1e-13 * squares
            able = (counts >= 2 * least) & (np.diff(start) > 1) & (squares > floor) & (level < depth)
            few = np.diff(start) <= small
            best, total = (score, feature, cut), (sums, counts)
            large_nodes(x, y, rows, drawn, start, np.flatnonzero(able & ~few), total, best, across, least)
            small_nodes(x, y, rows, drawn, start, np.flatnonzero(able & few), total, best, least)
            split = able & (score > floor)
            np.add.at(fall, (trees[split], feature[split]), (score - sums * sums / counts)[split])
            # A tree's nodes are numbered level by level, its own only.
            here, parted = np.bincount(trees, minlength=count), np.bincount(trees[split], minlength=count)
            place = base[trees] + np.arange(k) - (np.cumsum(here) - here)[trees]
            rank = np.cumsum(split) - 1
            left = (base + here)[trees] + 2 * (rank - (np.cumsum(parted) - parted)[trees])
            nodes.append(np.where(split, left << 2 * bits | feature << bits | cut, place << 2 * bits | leaf))
            values.append(centre + sums / counts)
            owners.append(trees)
            base += here
            if not split.any():
                break
            # Rows go to their child's stretch in the order they had.
            still = split[own]
            rows, drawn, own = rows[still], drawn[still], own[still]
            right = np.empty(len(rows), bool)
            for s in pieces(len(rows)):
                right[s] = x[feature[own[s]], rows[s]] > cut[own[s]]
            size = np.diff(start)[split]
            begin = np.concatenate([[0], np.cumsum(size)])
            lefts = np.concatenate([[0], np.cumsum(~right)])
            to_left = np.diff(lefts[begin])
            start = np.concatenate([[0], np.cumsum(np.stack([to_left, size - to_left], 1).ravel())])
            dealt, again = np.empty_like(rows), np.empty_like(drawn)
            own = rank[own]
            for s in pieces(len(rows)):
                mine = own[s]
                before = lefts[s] - lefts[begin[mine]]
                behind = np.arange(s.start, s.stop) - begin[mine] - before
                to = np.where(right[s], start[2 * mine + 1] + behind, start[2 * mine] + before)
                dealt[to], again[to] = rows[s], drawn[s]
            rows, drawn, trees = dealt, again, np.repeat(trees[split], 2)
        empty = (np.array([leaf], np.int64), np.array([centre + y.mean()]))
        if not len(alive):
            return [(*empty, f) for f in fall]
        nodes, values, owners = (np.concatenate(a) for a in (nodes, values, owners))
        order = np.argsort(owners, kind="stable")
        ends = np.cumsum(np.bincount(owners, minlength=count))[:-1]
        dealt = zip(np.split(nodes[order], ends), np.split(values[order], ends), fall)
        return [(n, v, f) if len(n) else (*empty, f) for n, v, f in dealt]

    return grow


def _packed_training(values: DataFrame, edges: list[list[float]]) -> DataFrame:
    """Blocks of the rows (``label, v``): labels, and bins feature by feature."""
    cuts, size = [np.asarray(e) for e in edges], BLOCK

    def pack(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(cuts))
                label = part.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
                bins = np.stack([np.searchsorted(c, v[:, f]).astype(np.uint8) for f, c in enumerate(cuts)])
                held = [pa.array([a.tobytes()], pa.binary()) for a in (label, bins)]
                numbers = [pa.array([block], pa.int64()), pa.array([part.num_rows], pa.int64())]
                yield pa.RecordBatch.from_arrays(numbers + held, ["block", "n", "label", "bins"])
                block += 1

    return values.mapInArrow(pack, "block long, n long, label binary, bins binary")


def _dealt(df: DataFrame, groups: int, *order: str) -> DataFrame:
    """Every row to each of ``groups`` partitions where it names no ``group``, in order."""
    if "group" not in df.columns:
        df = df.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return df.repartitionById(groups, "group").sortWithinPartitions("group", *order)


class ForestGrower:
    """Fits on ``label`` and a vector ``features`` column, as MLlib's estimators do."""

    def __init__(self, config: ForestConfig) -> None:
        if config.depth > 30:
            raise ValueError(f"depth {config.depth} is over 30, the most that is supported")
        if not 2 <= config.bins <= 256:
            raise ValueError(f"{config.bins} bins do not fit a byte")
        self.config = config

    def fit(self, df: DataFrame) -> ForestModel:
        config, spark = self.config, df.sparkSession
        values = df.select(F.col("label").cast("double").alias("label"), vector_to_array("features", "float64").alias("v"))
        summary = values.agg(F.max(F.size("v")).alias("width"), F.count("*").alias("n"), F.avg("label").alias("mean")).first()
        if not summary["n"]:
            raise ValueError("no rows to grow a forest on")
        edges = bin_edges(values, "v", config.bins, summary["width"])
        blocks = materialize(_packed_training(values, edges), "forest-blocks")
        groups = max(1, min(config.rounds, spark.sparkContext.defaultParallelism))
        path = scratch_path(spark, "forest")
        trees = _dealt(blocks, groups, "block").mapInArrow(
            self._planter(summary["n"], summary["mean"], [len(e) + 1 for e in edges], groups),
            "tree int, part int, n long, node binary, value binary, fall array<double>",
        )
        trees.write.parquet(path)
        return ForestModel(config, edges, path, summary["n"])

    def _planter(self, total: int, centre: float, across: list[int], groups: int) -> Callable:
        # Plain numbers: the tasks need not have this module.
        rounds, depth, seed, width = self.config.rounds, self.config.depth, self.config.seed, len(across)
        grow, most, part, least = _grower(), HELD_BYTES, _PART, max(self.config.min_leaf, 1)
        together = max(1, TOGETHER // total)

        def planted(x, y, group):
            mine = range(group, rounds, groups)
            for first in range(0, len(mine), together):
                some = mine[first : first + together]
                weights = [np.random.default_rng((seed, t)).poisson(1.0, total).astype(np.uint8) for t in some]
                grown = grow(x, y, centre, weights, depth, least, across)
                for tree, held in zip(some, grown):
                    yield from parts(tree, *held)

        def parts(tree, node, value, fall):
            for i, at in enumerate(range(0, len(node), part)):
                some = node[at : at + part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tree], pa.int32()),
                        pa.array([i], pa.int32()),
                        pa.array([len(some)], pa.int64()),
                        pa.array([some.tobytes()], pa.binary()),
                        pa.array([value[at : at + part].tobytes()], pa.binary()),
                        pa.array([[] if i else fall.tolist()], pa.list_(pa.float64())),
                    ],
                    ["tree", "part", "n", "node", "value", "fall"],
                )

        def read(batches):
            import tempfile

            at, x, y, file = 0, None, None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i] for c in ("group", "n", "label", "bins")}
                    n = row["n"].as_py()
                    if x is None:
                        y = np.empty(total)
                        if width * total > most:
                            file = tempfile.TemporaryFile()
                            x = np.memmap(file, np.uint8, "w+", shape=(width, total))
                        else:
                            x = np.empty((width, total), np.uint8)
                    x[:, at : at + n] = np.frombuffer(row["bins"].as_buffer(), np.uint8).reshape(width, n)
                    y[at : at + n] = np.frombuffer(row["label"].as_buffer()) - centre
                    at += n
                    if at == total:
                        yield from planted(x, y, row["group"].as_py())
                        at = 0
            if at:
                raise ValueError(f"{at} of {total} rows reached a group of trees")

        return read


# --- model -------------------------------------------------------------------


class ForestModel:
    """Trees in a written table; small forests are also held by the driver."""

    def __init__(self, config: ForestConfig, edges: list[list[float]], path: str, rows: int) -> None:
        self.config, self.edges, self.path, self.rows = config, edges, path, rows
        trees = SparkSession.active().read.parquet(path)
        sizes = trees.groupBy("tree").agg(F.sum("n").alias("n"), F.max_by("fall", -F.col("part")).alias("fall")).orderBy("tree").collect()
        if [r["tree"] for r in sizes] != list(range(config.rounds)):
            raise ValueError(f"{len(sizes)} of {config.rounds} trees at {path}")
        self.nodes = sum(r["n"] for r in sizes)
        falls = np.array([r["fall"] for r in sizes])
        each = falls.sum(1, keepdims=True)
        shares = np.divide(falls, each, out=np.zeros_like(falls), where=each > 0).sum(0)
        self.featureImportances = _Dense(shares / shares.sum() if shares.sum() > 0 else shares)
        self.held = self._hold(trees) if self.nodes <= HELD_NODES else None

    def _hold(self, trees: DataFrame) -> Forest:
        rows = trees.select("tree", "part", "node", "value").orderBy("tree", "part").collect()
        roots, node, value, at = [], [], [], 0
        for r in rows:
            if r["part"] == 0:
                roots.append(at)
            held = np.frombuffer(r["node"], np.int64)
            node.append(held + (roots[-1] << 2 * _BITS))
            value.append(np.frombuffer(r["value"]))
            at += len(held)
        return Forest(np.array(roots), np.concatenate(node), np.concatenate(value))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.scored(df, vector_to_array(F.col("features"), "float64"), df.columns)

    def scored(self, df: DataFrame, features: Column, kept: list[str]) -> DataFrame:
        """The columns ``kept`` and ``prediction`` of an array of features; missing features are an error."""
        if self.held is not None:
            return df.select(*kept, self._predict(df.sparkSession)(features).alias("prediction"))
        return self._scored_in_groups(df, features, kept)

    def _predict(self, spark: SparkSession) -> Callable[[Column], Column]:
        parts = spark.sparkContext.broadcast((self.held.roots, self.held.node, self.held.value))
        cuts, cut_rows, walk, size = [np.asarray(e) for e in self.edges], _cutter(), _walker(), BLOCK

        @arrow_udf("double")
        def predict(features: pa.Array) -> pa.Array:
            roots, node, value = parts.value
            x = features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), -1) if len(features) else np.zeros((0, len(cuts)))
            out = np.zeros(len(x))
            for at in range(0, len(x), size):
                walk(cut_rows(x[at : at + size], cuts), roots, node, value, out[at : at + size])
            return pa.array(out / len(roots))

        return lambda features: F.coalesce(predict(features), F.lit(float("nan")))  # never null

    def _scored_in_groups(self, df: DataFrame, features: Column, kept: list[str]) -> DataFrame:
        """The same with the trees dealt to tasks that each read all rows, written."""
        spark, cuts = df.sparkSession, [np.asarray(e) for e in self.edges]
        cut_rows, walk, size, rounds = _cutter(), _walker(), BLOCK, self.config.rounds
        slots = max(spark.sparkContext.defaultParallelism, -(-self.nodes * 16 // GROUP_BYTES))
        groups = max(1, min(rounds, slots))

        def pack(batches):
            from pyspark import TaskContext

            block = TaskContext.get().partitionId() << 33
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    x = part.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    rest = part.select([c for c in part.schema.names if c != "_x"])
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, rest.schema) as writer:
                        writer.write_batch(rest)
                    held = [pa.array([a], pa.binary()) for a in (cut_rows(x, cuts).tobytes(), sink.getvalue().to_pybytes())]
                    numbers = [pa.array([block], pa.int64()), pa.array([part.num_rows], pa.int64())]
                    yield pa.RecordBatch.from_arrays(numbers + held, ["id", "n", "bins", "rest"])
                    block += 1

        def add(batches):
            trees, group = [], None
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i] for c in batch.schema.names}
                    if row["group"].as_py() != group:
                        trees, group = [], row["group"].as_py()
                    if row["kind"].as_py() == 0:
                        node, value = (np.frombuffer(row[c].as_buffer(), t) for c, t in (("data", np.int64), ("value", np.float64)))
                        if row["part"].as_py() == 0:
                            trees.append(([], []))
                        trees[-1][0].append(node.copy())
                        trees[-1][1].append(value.copy())
                        continue
                    n = row["n"].as_py()
                    bins, total = np.frombuffer(row["data"].as_buffer(), np.uint8).reshape(n, -1), np.zeros(n)
                    for t, (node, value) in enumerate(trees):
                        if len(node) > 1:
                            trees[t] = node, value = [np.concatenate(node)], [np.concatenate(value)]
                        walk(bins, [0], node[0], value[0], total)
                    held = [pa.array([row["id"].as_py()], pa.int64()), pa.array([group], pa.int32()), pa.array([total.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(held, ["id", "group", "total"])

        schema = df.select(*kept).schema.add("prediction", T.DoubleType())

        def unpack(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    out = 0.0
                    for total in batch.column("totals")[i].values:
                        out = out + np.frombuffer(total["total"].as_buffer())
                    rest = pa.ipc.open_stream(batch.column("rest")[i].as_buffer()).read_next_batch()
                    yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out / rounds)], [*rest.schema.names, "prediction"])

        packed = materialize(df.select(*kept, features.alias("_x")).mapInArrow(pack, "id long, n long, bins binary, rest binary"), "packed-rows")
        trees = spark.read.parquet(self.path).select(
            (F.col("tree") % groups).alias("group"), F.lit(0).alias("kind"), F.col("tree").cast("long").alias("id"),
            "part", "n", F.col("node").alias("data"), "value",
        )
        rows = packed.select(
            F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("kind"), "id",
            F.lit(0).alias("part"), "n", F.col("bins").alias("data"), F.lit(None).cast("binary").alias("value"),
        )
        sums = _dealt(trees.unionByName(rows), groups, "kind", "id", "part").mapInArrow(add, "id long, group int, total binary")
        sums = sums.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("group", "total"))).alias("totals"))
        both = packed.select("id", "rest").join(sums, "id").select("rest", "totals")
        scores = materialize(both.mapInArrow(unpack, schema), "scores")
        return scores.withColumn("prediction", F.coalesce("prediction", F.lit(float("nan"))))  # never null

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def load(cls, path: str) -> ForestModel:
        meta = json.loads(SparkSession.active().read.text(f"{path}/meta").first()[0])
        return cls(ForestConfig(**meta["config"]), meta["edges"], f"{path}/trees", meta["rows"])


def _cutter() -> Callable:
    def cut(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        if np.isnan(x).any():
            raise ValueError("features to score cannot be null or NaN")
        bins = np.empty((len(x), len(cuts)), np.uint8)
        for f, c in enumerate(cuts):
            bins[:, f] = np.searchsorted(c, x[:, f])
        return bins

    return cut


def _walker() -> Callable:
    bits = _BITS
    low = (1 << bits) - 1

    def walk(bins, roots, node, value, total) -> None:
        """Add the value of each row's leaf to ``total``, tree by tree."""
        base = np.arange(len(bins)) * bins.shape[1]
        bins = bins.ravel()
        for root in roots:
            place = np.full(len(total), root)
            alive, here, mine = None, place, base
            level = 0
            while len(here):
                held = node.take(here)
                # A leaf names feature 0 and a bin beyond all.
                beyond = bins.take(mine + (held >> bits & low)) > (held & low)
                here = (held >> 2 * bits) + beyond
                level += 1
                if level % 3 == 0:  # rows at a leaf stop
                    if alive is None:
                        place = here
                    else:
                        place[alive] = here
                    going = np.flatnonzero((node.take(here) & low) != low)
                    alive = going if alive is None else alive[going]
                    here, mine = here[going], mine[going]
            total += value.take(place)

    return walk


class _Dense:
    def __init__(self, values: np.ndarray) -> None:
        self.values = values

    def toArray(self) -> np.ndarray:
        return self.values


class _Writer:
    def __init__(self, model: ForestModel) -> None:
        self.model = model

    def overwrite(self) -> _Writer:
        return self

    def save(self, path: str) -> None:
        spark, m = SparkSession.active(), self.model
        meta = {"kind": "forest", "config": asdict(m.config), "edges": m.edges, "rows": m.rows}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        if m.path != f"{path}/trees":  # a loaded model saved where it is
            spark.read.parquet(m.path).write.mode("overwrite").parquet(f"{path}/trees")
