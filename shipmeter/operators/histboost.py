"""Gradient boosting by histograms of gradients and hessians.

Second order (as ``xgboost`` grows trees) and leaf-limited best-first growth (as
``lightgbm`` does), which MLlib's boosting has neither of.

Spark does everything that grows with the rows: the bin edges (approximate
percentiles, or the values themselves where a feature has few), the binned table,
and per tree level one reduction of gradient sums and row counts by (node, feature,
bin).  The rows lie in a persisted RDD of numpy blocks (one per Arrow batch) with
their prediction; a task adds up the histograms of its blocks and a tree of tasks adds
theirs, so the driver receives one histogram array a level, of nodes x features x bins
cells, and keeps the trees.  Every level is the same small job: nothing about it grows
with the trees so far.  The loss is squared, so a row's hessian is 1 and hessian sums
are row counts.

Growth.  Every level splits each open node at its best (feature, bin) by the
regularised gain ``(GL^2/(HL+l2) + GR^2/(HR+l2) - G^2/(H+l2)) / 2 - gamma``; a split
needs ``min_leaf`` rows and ``min_child_weight`` hessian on each side and a positive
gain.  With ``leaves`` set, the splits kept are those a best-first grower takes: a
heap of open leaves on the driver, the largest gain first, until the tree has
``leaves`` leaves.  A node's best split depends on its rows alone, so growing level
by level and choosing best-first afterwards gives the same tree as growing one leaf
at a time, in ``depth`` passes instead of ``leaves - 1``.  Leaf weights are
``-G / (H + l2)``, shrunk by ``step``.  Rows are drawn for a tree by a hash of
(row, tree, seed), so a lost task draws the same rows again.

Ties: the least feature, then the least bin; among equal gains in the heap the least
node.  A label must not be null.  A null or NaN feature value falls in bin 0.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from shipmeter.session import materialize, shared_dir

#: Rounds after which the blocks are written to the shared folder, which ends their lineage.
REWRITE_EVERY = 10
_DRAWS = 1 << 20


@dataclass(frozen=True)
class BoostConfig:
    rounds: int = 200
    depth: int = 8
    leaves: int | None = None  # None: every split of positive gain down to ``depth``
    min_leaf: int = 1  # rows on each side of a split
    min_child_weight: float = 1.0  # hessian on each side of a split
    l2: float = 1.0
    gamma: float = 0.0
    step: float = 0.1
    subsample: float = 1.0
    bins: int = 64
    seed: int = 42


@dataclass
class Tree:
    """Splits by node (heap numbering: root 1, children 2n and 2n + 1) and leaf weights."""

    splits: dict[int, tuple[int, int, float, int]]  # node -> feature, bin, gain, rows
    leaves: dict[int, tuple[float, int]]  # node -> weight (unshrunk), rows

    def arrays(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = 1 << (depth + 1)
        feature, threshold, weight = np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros(size)
        for node, (f, b, _, _) in self.splits.items():
            feature[node], threshold[node] = f, b
        for node, (w, _) in self.leaves.items():
            weight[node] = w
        return feature, threshold, weight


# --- bins --------------------------------------------------------------------


def bin_edges(values: DataFrame, column: str, bins: int, width: int) -> list[list[float]]:
    """Per feature the sorted edges; a value's bin is the number of edges below it.

    A feature of at most ``bins`` distinct values gets one bin per value; any other
    gets ``bins`` bins by approximate percentiles.
    """
    cells = values.select(F.posexplode(column).alias("f", "v")).where(~F.isnan("v") & F.col("v").isNotNull())
    summary = cells.groupBy("f").agg(
        F.approx_count_distinct("v", 0.01).alias("k"),
        F.percentile_approx("v", [i / bins for i in range(1, bins)], 10_000).alias("q"),
    )
    found = {r["f"]: (r["k"], r["q"]) for r in summary.collect()}
    few = [f for f, (k, _) in found.items() if k <= 2 * bins]
    exact: dict[int, list[float]] = {f: [] for f in few}
    if few:
        for r in cells.where(F.col("f").isin(few)).groupBy("f", "v").count().select("f", "v").collect():
            exact[r["f"]].append(r["v"])
    edges = []
    for f in range(width):
        if f in exact and len(exact[f]) <= bins:
            edges.append(sorted(exact[f])[:-1])
        else:
            edges.append(sorted(set(found.get(f, (0, []))[1] or [])))
    return edges


def binned(values: Column, edges: list[list[float]]) -> Column:
    """``array<int>`` of the bins of an ``array<double>`` of feature values."""
    table = F.array(*[F.array(*[F.lit(float(e)) for e in fe]).cast("array<double>") for fe in edges])
    return F.transform(values, lambda v, i: F.size(F.filter(F.element_at(table, i + 1), lambda e: e < v)))


# --- growth ------------------------------------------------------------------


def _walker() -> Callable:
    """The nodes that rows of ``bins`` end in under the splits of one tree, ``depth`` down.

    A function made here, not one of the module: it travels inside the tasks' closures.
    """

    def walk(bins: np.ndarray, feature: np.ndarray, limit: np.ndarray, depth: int) -> np.ndarray:
        node, rows = np.ones(len(bins), dtype=np.int64), np.arange(len(bins))
        for _ in range(depth):
            f = feature[node]
            right = bins[rows, np.maximum(f, 0)] > limit[node]
            node = np.where(f >= 0, node * 2 + right, node)
        return node

    return walk


def _blocks(rows: DataFrame, config: BoostConfig, first: int, rounds: int) -> RDD:
    """``(pred, label, bins, drawn)`` arrays of the rows (``id, label, bins, pred``), a
    tuple per Arrow batch; ``drawn`` holds a bit per row and tree from ``first`` on, or
    nothing where every tree takes every row."""
    columns = [F.col("pred").cast("double").alias("pred"), F.col("label").cast("double").alias("label"), "bins"]
    thin = config.subsample < 1 and rounds > 0
    if thin:
        draw = lambda t: F.pmod(F.xxhash64("id", t, F.lit(config.seed)), F.lit(_DRAWS)) < F.lit(config.subsample * _DRAWS)
        columns.append(F.transform(F.sequence(F.lit(first), F.lit(first + rounds - 1)), draw).alias("drawn"))
    kind = np.uint8 if config.bins < 256 else np.int32

    def pack(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue

            def matrix(name: str) -> np.ndarray:
                return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)

            drawn = np.packbits(matrix("drawn").astype(bool), axis=1) if thin else np.zeros((n, 0), dtype=np.uint8)
            arrays = (
                batch.column("pred").to_numpy(zero_copy_only=False).astype(np.float64),
                batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64),
                matrix("bins").astype(kind),
                drawn,
            )
            names = ["pred", "label", "bins", "drawn"]
            held = [pa.array([a.tobytes()], pa.binary()) for a in arrays]
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *held], ["n", *names])

    def unpack(row) -> tuple[np.ndarray, ...]:
        flat = np.frombuffer(row.pred), np.frombuffer(row.label)
        return *flat, np.frombuffer(row.bins, dtype=kind).reshape(row.n, -1), np.frombuffer(row.drawn, dtype=np.uint8).reshape(row.n, -1)

    packed = rows.select(*columns).mapInArrow(pack, "n long, pred binary, label binary, bins binary, drawn binary")
    return packed.rdd.map(unpack)


def _advanced(blocks: RDD, tree: Tree, config: BoostConfig) -> RDD:
    """The blocks with the predictions of one more tree."""
    feature, limit, weight = tree.arrays(config.depth)
    steps, depth, walk = config.step * weight, config.depth, _walker()

    def step(block):
        pred, label, bins, drawn = block
        return pred + steps[walk(bins, feature, limit, depth)], label, bins, drawn

    return blocks.map(step)


def _histograms(blocks: RDD, splits: dict, level: int, nodes: list[int], draw: int, width: int, config: BoostConfig) -> tuple[np.ndarray, np.ndarray]:
    """Gradient sums and row counts ``[node, feature, bin]`` of the open ``nodes`` of a
    level, over the rows drawn for the tree at bit ``draw``."""
    feature, limit, _ = Tree(splits, {}).arrays(level)
    place = np.full(1 << (level + 1), -1)
    place[nodes] = np.arange(len(nodes))
    across, thin, walk = config.bins + 1, config.subsample < 1, _walker()
    shape = (len(nodes), width, across)
    if not blocks.getNumPartitions():
        return np.zeros(shape), np.zeros(shape, dtype=np.int64)

    def sums(part):
        g, n = np.zeros(shape), np.zeros(shape, dtype=np.int64)
        for pred, label, bins, drawn in part:
            at = place[walk(bins, feature, limit, level)]
            kept = at >= 0
            if thin:
                kept &= (drawn[:, draw // 8] >> (7 - draw % 8)) & 1 == 1
            cells = (at[kept, None] * (width * across) + np.arange(width) * across + bins[kept]).ravel()
            g += np.bincount(cells, np.repeat((pred - label)[kept], width), g.size).reshape(shape)
            n += np.bincount(cells, minlength=n.size).reshape(shape)
        yield g, n

    return blocks.mapPartitions(sums).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))


def _best(g: np.ndarray, h: np.ndarray, n: np.ndarray, config: BoostConfig) -> tuple[float, int, int]:
    """Gain, feature and bin of a node's best split from its histograms [feature, bin]."""
    gl, hl, nl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1], n.cumsum(1)[:, :-1]
    gt, ht, nt = g.sum(1)[:, None], h.sum(1)[:, None], n.sum(1)[:, None]
    gr, hr, nr = gt - gl, ht - hl, nt - nl
    lam = config.l2
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 0.5 * (gl**2 / (hl + lam) + gr**2 / (hr + lam) - gt**2 / (ht + lam)) - config.gamma
    ok = (nl >= config.min_leaf) & (nr >= config.min_leaf) & (hl >= config.min_child_weight) & (hr >= config.min_child_weight)
    gain = np.where(ok & np.isfinite(gain), gain, -np.inf)
    if gain.size == 0:
        return -math.inf, -1, -1
    at = int(np.argmax(gain))
    f, b = divmod(at, gain.shape[1])
    return float(gain[f, b]), f, b


def grow(rows: DataFrame, tree_index: int, config: BoostConfig, width: int) -> Tree:
    """One tree on ``rows`` (``id, label, bins, pred``)."""
    blocks = _blocks(rows, config, tree_index, 1).persist(StorageLevel.MEMORY_AND_DISK)
    tree = _grown(blocks, 0, config, width)
    blocks.unpersist()
    return tree


def _grown(blocks: RDD, draw: int, config: BoostConfig, width: int) -> Tree:
    """One tree on the blocks' rows, as drawn for it at bit ``draw``."""
    splits: dict[int, tuple[int, int, float, int]] = {}
    totals: dict[int, tuple[float, float, int]] = {}
    gains: dict[int, tuple[float, int, int, int]] = {}
    open_nodes = [1]
    for level in range(max(config.depth, 1)):
        if not open_nodes:
            break
        sums, counts = _histograms(blocks, splits, level, open_nodes, draw, width, config)
        next_open = []
        for node, g, n in zip(open_nodes, sums, counts):
            if not n.any():
                continue
            h = n.astype(np.float64)
            if node == 1:
                totals[1] = (float(g[0].sum()), float(h[0].sum()), int(n[0].sum()))
            if level >= config.depth:
                continue
            gain, feat, cut = _best(g, h, n, config)
            if gain > 0:
                rows = totals[node][2]
                gains[node] = (gain, feat, cut, rows)
                splits[node] = (feat, cut, gain, rows)
                left = (float(g[feat, : cut + 1].sum()), float(h[feat, : cut + 1].sum()), int(n[feat, : cut + 1].sum()))
                whole = totals[node]
                totals[2 * node] = left
                totals[2 * node + 1] = (whole[0] - left[0], whole[1] - left[1], whole[2] - left[2])
                for child in (2 * node, 2 * node + 1):
                    # Only a node that might still split is read again; the others are leaves
                    # whose sums the parent's histogram already gave.
                    _, hc, nc = totals[child]
                    if level + 1 < config.depth and nc >= 2 * config.min_leaf and hc >= 2 * config.min_child_weight:
                        next_open.append(child)
        open_nodes = next_open
    if config.leaves is not None:
        splits = _best_first(gains, config.leaves)
    leaves = {}
    for node, (g, h, n) in totals.items():
        parent_split = node == 1 or (node // 2) in splits
        if parent_split and node not in splits:
            leaves[node] = (-g / (h + config.l2) if h + config.l2 > 0 else 0.0, n)
    return Tree(splits, leaves)


def _best_first(gains: dict[int, tuple[float, int, int, int]], leaves: int) -> dict[int, tuple[int, int, float, int]]:
    """The splits a grower keeps that always splits the open leaf of largest gain."""
    kept: dict[int, tuple[int, int, float, int]] = {}
    heap = [(-gains[1][0], 1)] if 1 in gains else []
    while heap and len(kept) + 1 < leaves:
        _, node = heapq.heappop(heap)
        gain, feat, cut, n = gains[node]
        kept[node] = (feat, cut, gain, n)
        for child in (2 * node, 2 * node + 1):
            if child in gains:
                heapq.heappush(heap, (-gains[child][0], child))
    return kept


# --- model -------------------------------------------------------------------


@dataclass
class BoostedModel:
    config: BoostConfig
    base: float
    edges: list[list[float]]
    trees: list[Tree]
    featuresCol: str = "features"

    def predict(self, values: Column) -> Column:
        """Prediction from a column of feature values (``array<double>``), in Arrow batches."""
        depth, step = self.config.depth, self.config.step
        arrays = [t.arrays(depth) for t in self.trees]
        base, edges = self.base, [np.asarray(e, dtype=np.float64) for e in self.edges]
        walk = _walker()

        @pandas_udf("double")
        def score(column: pd.Series) -> pd.Series:
            if column.empty:
                return pd.Series([], dtype="float64")
            v = np.stack(column.to_numpy()).astype(np.float64)
            b = np.zeros(v.shape, dtype=np.int64)
            for f, e in enumerate(edges):  # edges below the value, as ``binned`` counts them
                b[:, f] = np.where(np.isnan(v[:, f]), 0, np.searchsorted(e, v[:, f], side="left"))
            out = np.full(len(b), base)
            for feature, limit, weight in arrays:
                out += step * weight[walk(b, feature, limit, depth)]
            return pd.Series(out)

        return score(values)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.predict(vector_to_array(F.col(self.featuresCol), "float64")))

    @property
    def featureImportances(self):
        gain = np.zeros(len(self.edges))
        for t in self.trees:
            for f, _, g, _ in t.splits.values():
                gain[f] += g
        total = gain.sum()
        return _Dense(gain / total if total > 0 else gain)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The fitted ensemble as a node table: one row per split and per leaf."""
        rows = []
        for i, t in enumerate(self.trees):
            rows += [(i, n, f, b, g, r, None) for n, (f, b, g, r) in t.splits.items()]
            rows += [(i, n, None, None, None, r, w) for n, (w, r) in t.leaves.items()]
        schema = "tree int, node long, feature int, bin int, gain double, n_rows long, weight double"
        return spark.createDataFrame(rows, schema)

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def load(cls, path: str) -> BoostedModel:
        spark = SparkSession.active()
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        trees: dict[int, Tree] = {}
        for r in spark.read.parquet(f"{path}/nodes").collect():
            t = trees.setdefault(r["tree"], Tree({}, {}))
            if r["feature"] is None:
                t.leaves[r["node"]] = (r["weight"], r["n_rows"])
            else:
                t.splits[r["node"]] = (r["feature"], r["bin"], r["gain"], r["n_rows"])
        return cls(BoostConfig(**meta["config"]), meta["base"], meta["edges"], [trees.get(i, Tree({}, {})) for i in range(meta["trees"])])


def importances(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Per feature of a node table: splits, summed gain and each one's share, by gain
    then name."""
    table = nodes.sparkSession.createDataFrame(list(enumerate(names)), "feature int, name string")
    per = nodes.where(F.col("feature").isNotNull()).groupBy("feature").agg(
        F.count(F.lit(1)).alias("splits"), F.sum("gain").alias("gain")
    )
    whole = per.agg(F.sum("splits").alias("all_splits"), F.sum("gain").alias("all_gain"))
    return (
        table.join(per, "feature", "left")
        .select("name", F.coalesce("splits", F.lit(0)).alias("splits"), F.coalesce("gain", F.lit(0.0)).alias("gain"))
        .withColumns({
            "split_share": F.col("splits") / whole.select(F.col("all_splits")).scalar(),
            "gain_share": F.col("gain") / whole.select(F.col("all_gain")).scalar(),
        })
        .orderBy(F.desc("gain"), "name")
    )


class _Dense:
    def __init__(self, values: np.ndarray) -> None:
        self.values = values

    def toArray(self) -> np.ndarray:
        return self.values


class _Writer:
    def __init__(self, model: BoostedModel) -> None:
        self.model = model

    def overwrite(self) -> _Writer:
        return self

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        m = self.model
        meta = {"kind": "boosted", "config": asdict(m.config), "base": m.base, "edges": m.edges, "trees": len(m.trees)}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        m.nodes(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")


class HistBooster:
    """Fits on ``label`` and a vector ``features`` column, as MLlib's estimators do."""

    def __init__(self, config: BoostConfig) -> None:
        self.config = config

    def prepared(self, df: DataFrame) -> tuple[DataFrame, list[list[float]]]:
        """The binned rows ``id, label, bins`` (written) and the edges."""
        values = df.select(F.col("label").cast("double").alias("label"), vector_to_array("features", "float64").alias("v"))
        values = materialize(values.withColumn("id", F.monotonically_increasing_id()), "boost-values")
        width = values.agg(F.max(F.size("v"))).first()[0] or 0
        edges = bin_edges(values, "v", self.config.bins, width)
        rows = values.select("id", "label", binned(F.col("v"), edges).alias("bins"))
        return materialize(rows, "boost-bins"), edges

    def fit(self, df: DataFrame) -> BoostedModel:
        rows, edges = self.prepared(df)
        return self.fit_binned(rows, edges)

    def fit_binned(self, rows: DataFrame, edges: list[list[float]]) -> BoostedModel:
        config = self.config
        base = rows.agg(F.avg("label")).first()[0]
        base = 0.0 if base is None else float(base)
        shared_dir(rows.sparkSession)
        current = _blocks(rows.withColumn("pred", F.lit(base)), config, 0, config.rounds).persist(StorageLevel.MEMORY_AND_DISK)
        previous, trees = None, []
        for t in range(config.rounds):
            tree = _grown(current, t, config, len(edges))
            trees.append(tree)
            if previous is not None:  # the tree's first pass has filled the cache of its successor
                previous.unpersist()
            previous, current = current, _advanced(current, tree, config).persist(StorageLevel.MEMORY_AND_DISK)
            if (t + 1) % REWRITE_EVERY == 0:
                current.checkpoint()
        if previous is not None:
            previous.unpersist()
        current.unpersist()
        return BoostedModel(config, base, edges, trees)
