"""Histogram boosting against plain growers on numpy arrays."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from shipmeter.operators import histboost as hb
from shipmeter.operators import models


def best_split(x, g, h, rows, cfg):
    best = (-math.inf, -1, -1)
    big_g, big_h, n = g[rows].sum(), h[rows].sum(), len(rows)
    for f in range(x.shape[1]):
        for b in range(cfg.bins):
            left = x[rows, f] <= b
            nl = int(left.sum())
            if nl < cfg.min_leaf or n - nl < cfg.min_leaf:
                continue
            gl, hl = g[rows][left].sum(), h[rows][left].sum()
            gr, hr = big_g - gl, big_h - hl
            if hl < cfg.min_child_weight or hr < cfg.min_child_weight:
                continue
            gain = 0.5 * (gl**2 / (hl + cfg.l2) + gr**2 / (hr + cfg.l2) - big_g**2 / (big_h + cfg.l2)) - cfg.gamma
            if gain > best[0]:
                best = (gain, f, b)
    return best


def plain_tree(x, g, h, cfg):
    """Level by level, or one leaf at a time (the open leaf of largest gain) to ``leaves``."""
    rows = {1: np.arange(len(x))}
    splits = {}

    def candidate(node):
        if int(math.log2(node)) >= cfg.depth:
            return None
        gain, f, b = best_split(x, g, h, rows[node], cfg)
        return (gain, f, b) if gain > 0 else None

    def split(node, f, b):
        r = rows[node]
        rows[2 * node], rows[2 * node + 1] = r[x[r, f] <= b], r[x[r, f] > b]
        splits[node] = (f, b)

    if cfg.leaves is None:
        todo = [1]
        while todo:
            node = todo.pop(0)
            c = candidate(node)
            if c:
                split(node, c[1], c[2])
                todo += [2 * node, 2 * node + 1]
    else:
        open_ = {1: candidate(1)}
        while len(splits) + 1 < cfg.leaves:
            ready = [(-c[0], n) for n, c in open_.items() if c]
            if not ready:
                break
            _, node = min(ready)
            _, f, b = open_.pop(node)
            split(node, f, b)
            open_[2 * node], open_[2 * node + 1] = candidate(2 * node), candidate(2 * node + 1)
    leaves = {}
    for node, r in rows.items():
        if node not in splits and (node == 1 or node // 2 in splits):
            leaves[node] = -g[r].sum() / (h[r].sum() + cfg.l2)
    return splits, leaves


def data(seed, n=300, width=4, bins=8):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, bins, size=(n, width))
    y = 3 * (x[:, 0] > 3) + x[:, 1] * (x[:, 2] > 2) + rng.normal(scale=0.5, size=n)
    return x, y


def rows_frame(spark, x, y, pred=0.0):
    return spark.createDataFrame(
        [(i, float(v), [int(b) for b in r], pred) for i, (r, v) in enumerate(zip(x, y))], "id long, label double, bins array<int>, pred double"
    )


@pytest.mark.parametrize("leaves", [None, 6])
def test_tree_equals_plain_grower(spark, leaves):
    cfg = hb.BoostConfig(rounds=1, depth=4, leaves=leaves, min_leaf=5, bins=8, l2=1.0)
    x, y = data(1)
    tree = hb.grow(rows_frame(spark, x, y), 0, cfg, x.shape[1])
    splits, weights = plain_tree(x, -y, np.ones(len(y)), cfg)
    assert {n: s[:2] for n, s in tree.splits.items()} == splits
    assert tree.leaves.keys() == weights.keys()
    for n, w in weights.items():
        assert tree.leaves[n][0] == pytest.approx(w, rel=1e-9, abs=1e-9)
    if leaves:
        assert len(tree.leaves) <= leaves


def test_best_first_keeps_largest_gains_first():
    gains = {1: (5.0, 0, 0, 9), 2: (1.0, 0, 0, 4), 3: (4.0, 0, 0, 5), 6: (3.0, 0, 0, 3), 7: (0.5, 0, 0, 2)}
    assert list(hb._best_first(gains, 3)) == [1, 3]
    assert list(hb._best_first(gains, 4)) == [1, 3, 6]
    assert list(hb._best_first(gains, 99)) == [1, 3, 6, 2, 7]


def test_boosting_equals_plain_rounds_and_scores(spark):
    x, y = data(2, n=200)
    cfg = hb.BoostConfig(rounds=3, depth=3, leaves=None, min_leaf=3, bins=8, step=0.3)
    edges = [[float(e) for e in range(7)] for _ in range(x.shape[1])]
    model = hb.HistBooster(cfg).fit_binned(rows_frame(spark, x, y).drop("pred"), edges)
    pred = np.full(len(y), y.mean())
    for tree in model.trees:
        splits, weights = plain_tree(x, pred - y, np.ones(len(y)), cfg)
        assert {n: s[:2] for n, s in tree.splits.items()} == splits
        node = np.ones(len(y), dtype=int)
        for _ in range(cfg.depth):
            f = np.array([splits.get(n, (-1, 0))[0] for n in node])
            b = np.array([splits.get(n, (-1, 0))[1] for n in node])
            node = np.where(f >= 0, 2 * node + (x[np.arange(len(y)), np.maximum(f, 0)] > b), node)
        pred = pred + cfg.step * np.array([weights[n] for n in node])
    vec = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i long, v array<double>")
    got = vec.select("i", model.predict(F.col("v")).alias("p")).orderBy("i").toPandas()["p"].to_numpy()
    assert got == pytest.approx(pred, rel=1e-9)


def test_draws_repeat_and_thin(spark):
    x, y = data(3, n=400)
    cfg = hb.BoostConfig(rounds=1, depth=2, subsample=0.5, bins=8)
    a = hb.grow(rows_frame(spark, x, y), 0, cfg, 4)
    b = hb.grow(rows_frame(spark, x, y), 0, cfg, 4)
    assert a == b
    assert 120 < a.splits[1][3] < 280  # rows of the root: about half


def lines(spark, sf_dir):
    names = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_partkey"]
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (F.col("l_extendedprice").cast("double") / 1000).alias("label"), *[F.col(c).cast("double") for c in names],
        (F.crc32(F.col("l_orderkey").cast("string")) % 5 == 0).alias("test"),
    )
    return VectorAssembler(inputCols=names, outputCol="features").transform(df).select("label", "features", "test")


def mae(df):
    return df.select(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0]


def test_held_out_error_not_above_mllib(spark, sf_dir):
    df = lines(spark, sf_dir)
    train, test = df.where(~F.col("test")), df.where(F.col("test"))
    ours = hb.HistBooster(hb.BoostConfig(rounds=15, depth=4, step=0.3)).fit(train)
    theirs = GBTRegressor(maxIter=15, maxDepth=4, stepSize=0.3, seed=1).fit(train)
    assert mae(ours.transform(test)) <= 1.02 * mae(theirs.transform(test))


def test_leaf_limit_and_save_load(spark, sf_dir, tmp_path):
    df = lines(spark, sf_dir)
    config = models.booster_config(models.ModelConfig("leafwise", 3, 6, 20, 0.1, 1.0, leaves=31))
    model = hb.HistBooster(config).fit(df)
    nodes = model.nodes(spark).toPandas()
    leaves = nodes[nodes["feature"].isna()]
    assert leaves.groupby("tree").size().max() <= 31
    assert int(np.floor(np.log2(leaves["node"].max()))) <= 6
    assert (leaves.groupby("tree")["n_rows"].sum() == df.count()).all()
    model.write().overwrite().save(str(tmp_path / "m"))
    again = hb.BoostedModel.load(str(tmp_path / "m"))
    a = model.transform(df).select("prediction").toPandas()["prediction"]
    b = again.transform(df).select("prediction").toPandas()["prediction"]
    assert a.tolist() == pytest.approx(b.tolist())


def test_importances_from_the_node_table(spark):
    x, y = data(6, n=300)
    cfg = hb.BoostConfig(rounds=3, depth=3, min_leaf=3, bins=8)
    edges = [[float(e) for e in range(7)] for _ in range(x.shape[1])]
    model = hb.HistBooster(cfg).fit_binned(rows_frame(spark, x, y).drop("pred"), edges)
    got = {r["name"]: r for r in hb.importances(model.nodes(spark), ["a", "b", "c", "d"]).collect()}
    splits = [s for t in model.trees for s in t.splits.values()]
    for i, name in enumerate("abcd"):
        assert got[name]["splits"] == sum(1 for s in splits if s[0] == i)
        assert got[name]["gain"] == pytest.approx(sum(s[2] for s in splits if s[0] == i))
    assert sum(r["gain_share"] for r in got.values()) == pytest.approx(1.0)
    assert got["a"]["gain_share"] == pytest.approx(model.featureImportances.toArray()[0])


def test_a_level_is_one_stage_whatever_the_trees_before(spark):
    x, y = data(7, n=500)
    cfg = hb.BoostConfig(rounds=12, depth=3, min_leaf=3, bins=8, subsample=0.7)
    edges = [[float(e) for e in range(7)] for _ in range(x.shape[1])]
    rows = rows_frame(spark, x, y).drop("pred").coalesce(3)
    spark.sparkContext.setJobGroup("boost", "boost")
    model = hb.HistBooster(cfg).fit_binned(rows, edges)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    jobs = tracker.getJobIdsForGroup("boost")
    # One job a level, the mean label and one checkpoint per ten rounds; no level shuffles.
    assert len(model.trees) == 12 and len(jobs) <= 12 * cfg.depth + 8
    assert sum(len(tracker.getJobInfo(j).stageIds) == 1 for j in jobs) >= 12 * cfg.depth


def test_blocks_hold_the_rows_and_draws_of_spark(spark):
    x, y = data(8, n=100)
    cfg = hb.BoostConfig(subsample=0.4, bins=8, seed=5)
    rows = rows_frame(spark, x, y, 0.5)
    got = np.concatenate([np.column_stack([p, l, b, np.unpackbits(d, axis=1)[:, :11]]) for p, l, b, d in hb._blocks(rows, cfg, 3, 11).collect()])
    draws = [(F.pmod(F.xxhash64("id", F.lit(t), F.lit(5)), F.lit(1 << 20)) < 0.4 * (1 << 20)).cast("double").alias(f"d{t}") for t in range(3, 14)]
    want = np.array(rows.select("pred", "label", *[F.col("bins")[i].cast("double") for i in range(4)], *draws).collect())
    assert got.tolist() == want.tolist() and 0 < want[:, 6:].mean() < 1
