"""Embedding near-duplicates by an exact metric range join.

Cosine >= 0.98 between vectors is Euclidean distance <= r = sqrt(2 - 2 * 0.98) between
their unit vectors.  Pivots (a bounded, hash-drawn sample of the vectors) partition the
vectors: each vector's home cell is its nearest pivot.  By the triangle inequality a
pair within r whose members live in cells i < j has the member of cell i within
d(x, p_i) + 2r of p_j, so a vector is sent as a guest to every later cell j with
d(x, p_j) <= d(x, p_home) + 2r, and each cell joins its homes with its homes and
guests on its own.  A pair is counted only in the later of its two cells, so it is
found exactly once.

Cells are split into blocks of at most ``BLOCK`` rows a side; a task holds one query
block and one data block of one (label, dimension, cell), however large or hot the
cell.  Links do not leave the tasks as pairs: each task gives counts per vector and a
spanning forest of its links (every member to the least id of its piece), so the rows
written grow with the vectors, not with the square of a group.  Components are joined
by label propagation in Spark.

Defined cases: vectors compare only within equal, non-null labels and equal lengths.
Null, empty or zero vectors and vectors with a null or non-finite component link with
nothing and are their own component.  A vec_id given by several rows is taken by its
row of least hash of (label, embedding); a null vec_id gives no row.  Other columns
are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipmeter.llm.dartminhash import components
from shipmeter.llm.shipping import ship
from shipmeter.session import materialize

# Fixed values of the contract.
SIMILARITY = 0.98
RADIUS = math.sqrt(2 - 2 * SIMILARITY)
# Parameters of the plan: homes per cell that set the number of pivots, the most pivots
# (the sample the driver holds: MAX_PIVOTS x dimension doubles), rows a side per task.
CELL_ROWS = 20_000
MAX_PIVOTS = 256
BLOCK = 2048
SLACK = 1e-9  # rounding room on the boundary; it only adds guests

_CELLS = "vec_id long, label int, dim int, cell int, home int, embedding array<float>"
_OUT = "vec_id long, links long, root long"


def _valid(embedding: str) -> F.Column:
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0)


def nodes(embeddings: DataFrame) -> DataFrame:
    """One row per non-null vec_id with ``ok``: it may link at all."""
    first = embeddings.filter(F.col("vec_id").isNotNull()).groupBy("vec_id").agg(
        F.min_by(F.struct("label", "embedding"), F.xxhash64("label", "embedding")).alias("r")
    )
    rows = first.select("vec_id", F.col("r.label").alias("label"), F.col("r.embedding").cast("array<float>").alias("embedding"))
    return rows.withColumn("ok", F.col("label").isNotNull() & _valid("embedding"))


def pivots(vectors: DataFrame) -> np.ndarray:
    """The unit pivots: ``ceil(n / CELL_ROWS)`` (at most MAX_PIVOTS) vectors of the most
    common length, those of least hash of vec_id."""
    counted = vectors.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if counted is None:
        return np.zeros((0, 0))
    k = min(MAX_PIVOTS, max(1, math.ceil(counted["count"] / CELL_ROWS)))
    drawn = vectors.filter(F.size("embedding") == counted["dim"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(k)
    p = np.array([np.asarray(r["embedding"], dtype=np.float64) for r in drawn.collect()])
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def cells(vectors: DataFrame, pivot: np.ndarray) -> DataFrame:
    """Each vector once in its home cell and once in every later cell it must visit."""
    dim = pivot.shape[1] if pivot.size else -1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            sizes = b["embedding"].map(len).to_numpy()
            same = sizes == dim
            for part, pivoted in ((b[same], True), (b[~same], False)):
                if part.empty:
                    continue
                if not pivoted:
                    out.append(pd.DataFrame({"vec_id": part["vec_id"], "label": part["label"], "dim": part["embedding"].map(len),
                                             "cell": 0, "home": 0, "embedding": part["embedding"]}))
                    continue
                x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ pivot.T)))
                home = d.argmin(axis=1)
                reach = d[np.arange(len(d)), home][:, None] + 2 * RADIUS + SLACK
                visit = (d <= reach) & (np.arange(d.shape[1])[None, :] >= home[:, None])
                row, cell = np.nonzero(visit)
                out.append(pd.DataFrame({
                    "vec_id": part["vec_id"].to_numpy()[row], "label": part["label"].to_numpy()[row], "dim": dim,
                    "cell": cell, "home": home[row], "embedding": part["embedding"].to_numpy()[row],
                }))
            yield pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in _CELLS.split(", ")])

    return vectors.select("vec_id", "label", "embedding").mapInPandas(run, _CELLS)


def _block(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
    """Links between one query block (homes) and one data block of a cell: counts per
    vector and each vector's least linked-piece id."""
    if q.empty or d.empty:
        return pd.DataFrame({"vec_id": [], "links": [], "root": []}).astype("int64")
    a = np.stack(q["embedding"].to_numpy()).astype(np.float64)
    b = np.stack(d["embedding"].to_numpy()).astype(np.float64)
    cos = (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])
    qi, di = q["vec_id"].to_numpy(), d["vec_id"].to_numpy()
    guest = (d["home"].to_numpy() != d["cell"].to_numpy())[None, :]
    linked = (cos >= SIMILARITY) & (guest | (qi[:, None] < di[None, :]))
    r, c = np.nonzero(linked)
    if not len(r):
        return pd.DataFrame({"vec_id": [], "links": [], "root": []}).astype("int64")
    ids = np.concatenate([qi[r], di[c]])
    uniq, inv = np.unique(ids, return_inverse=True)
    links = np.bincount(inv, minlength=len(uniq))
    parent = np.arange(len(uniq))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for u, v in zip(inv[: len(r)], inv[len(r) :]):
        ru, rv = find(u), find(v)
        if ru != rv:
            parent[max(ru, rv)] = min(ru, rv)  # uniq is sorted: the least index is the least id
    roots = np.array([uniq[find(i)] for i in range(len(uniq))])
    return pd.DataFrame({"vec_id": uniq, "links": links.astype("int64"), "root": roots})


def links(vectors: DataFrame, pivot: np.ndarray) -> DataFrame:
    """Per linked vector its block results (``vec_id, links, root``), before combining."""
    placed = materialize(cells(vectors, pivot), "cells")
    key = ["label", "dim", "cell"]
    homes = placed.filter("cell = home")
    sizes = (
        placed.groupBy(*key)
        .agg(F.sum((F.col("cell") == F.col("home")).cast("long")).alias("nq"), F.count(F.lit(1)).alias("nd"))
        .select(*key, F.ceil(F.col("nq") / BLOCK).alias("nq"), F.ceil(F.col("nd") / BLOCK).alias("nd"))
    )
    rest = [F.col(c).alias(c) for c in (*key, "vec_id", "home", "embedding")]  # new names for each side
    q = homes.join(sizes, key).select(
        *rest, F.pmod(F.xxhash64("vec_id"), "nq").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("nd") - 1)).alias("db")
    )
    d = placed.join(sizes, key).select(
        *rest, F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), F.pmod(F.xxhash64("vec_id", F.lit(1)), "nd").alias("db")
    )
    block = [*key, "qb", "db"]
    return q.groupBy(*block).cogroup(d.groupBy(*block)).applyInPandas(_block, _OUT)


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per vector."""
    ship(embeddings.sparkSession)
    all_nodes = materialize(nodes(embeddings), "vectors")
    valid = all_nodes.filter("ok")
    found = materialize(links(valid, pivots(valid)), "links")
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    edges = found.filter("vec_id <> root").select(F.col("vec_id").alias("u"), F.col("root").alias("v")).distinct()
    labels = components(edges) if not edges.isEmpty() else edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
    out = all_nodes.select("vec_id").join(counts, "vec_id", "left").join(
        labels.select(F.col("id").alias("vec_id"), F.col("label").alias("component_id")), "vec_id", "left"
    )
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").cast("long").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"),
    )
