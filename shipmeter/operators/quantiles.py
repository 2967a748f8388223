"""Exact order statistics that never gather a whole group in one task.

``percentile`` keeps every distinct value of a group in one buffer.  Here a
bounded sketch only proposes cut points close to the wanted ranks; exact counts
between the cuts, combined in the map tasks, say which interval holds a rank, and
just the values of that interval are shuffled and sorted.  A poor cut makes an interval longer, never a result wrong.

An interval that holds a rank and more than HELD distinct values is cut again by its own
percentiles until it holds no more, so no task sorts more than HELD of them.  Repeats are
counted in the map tasks, so a value that fills an interval is one row there.

The input is read more than once: pass a scan or a written table, not a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shipmeter.session import materialize

_ACCURACY = 10_000
_MARGIN = 2.0 / _ACCURACY
#: Distinct values that the interval of a rank may hold before it is sorted; larger ones are
#: cut into CUTS parts by their own percentiles, round after round.
HELD = 100_000
CUTS = 1000
_BLOCK = 32  # cuts that are looked at one by one, after those at the ends of such blocks


def _rank_values(df: DataFrame, value: str, ranks: Column, near: Sequence[float], by: list[str]) -> DataFrame:
    """One row per group and wanted rank (0-based, an array column over ``n``)."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    edges = sorted({min(1.0, max(0.0, p + d)) for p in near for d in (-_MARGIN, _MARGIN)})
    cuts = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.approx_percentile("_v", F.array(*[F.lit(e) for e in edges]), F.lit(_ACCURACY)).alias("_cuts"),
    )
    if by:
        placed = rows.join(materialize(cuts, "rank-cuts"), by)  # one row per group, made once for all passes
    else:
        # One row with a number per cut, so it can travel through the driver.
        only = cuts.first()
        numbers = F.array(*[F.lit(c) for c in only["_cuts"] or []]).cast("array<double>")
        placed = rows.withColumns({"n": F.lit(only["n"]).cast("long"), "_cuts": numbers})
    interval = F.aggregate(
        "_cuts", F.lit(0), lambda acc, cut: acc + F.when(cut < F.col("_v"), 1).otherwise(0)
    )
    placed = placed.select(*by, "n", interval.alias("_i"), "_v")

    # Counts per interval combine in the map tasks: at most one row per cut and group
    # is shuffled from here to the join.
    before = Window.partitionBy(*by).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    wanted = (
        placed.groupBy(*by, "n", "_i")
        .agg(F.count("*").alias("_size"))
        .withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .withColumn("_rank", F.explode(F.array_distinct(ranks)))
        .where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_size")))
        .groupBy(*by, "_i", "_start", "_size")
        .agg(F.sort_array(F.collect_list("_rank")).alias("_ranks"))
        .withColumn("_i", F.col("_i").cast("long"))
    )
    wanted = materialize(wanted, "rank-intervals")

    def few(intervals: DataFrame) -> DataFrame:
        return intervals if by else F.broadcast(intervals)  # one row per cut at most

    held = placed.withColumn("_i", F.col("_i").cast("long")).join(few(wanted), [*by, "_i"], "left_semi")
    # Only values of the intervals that hold a rank are grouped and sorted, at most HELD of them.
    held = held.groupBy(*by, "n", "_i", "_v").agg(F.count("*").alias("_c"))
    held, wanted = _narrowed(held, wanted, by)
    counts = held.join(few(wanted), [*by, "_i"])
    inside = Window.partitionBy(*by, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = counts.withColumn("_upto", F.col("_start") + F.sum("_c").over(inside))
    hit = F.filter(
        "_ranks", lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_c"))
    )
    return found.select(*by, "n", F.explode(hit).alias("_rank"), F.col("_v").alias("_value"))


def _part(value: Column, cuts: Column, ends: Column) -> Column:
    """The place of a value among sorted distinct cuts: even between two cuts, odd on a cut.

    ``ends`` are the last cuts of the blocks; only the block that may hold the value is
    looked at cut by cut.
    """
    block = F.aggregate(ends, F.lit(0), lambda acc, cut: acc + (cut < value).cast("int"))
    return 2 * _BLOCK * block + F.aggregate(
        F.slice(cuts, block * _BLOCK + 1, _BLOCK), F.lit(0), lambda acc, cut: acc + (cut < value).cast("int") + (cut <= value).cast("int")
    )


def _narrowed(held: DataFrame, wanted: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both without the values that cannot hold a rank, until no interval has more than HELD.

    ``held``: distinct values of the wanted intervals, each with its number ``_c``;
    ``wanted``: ``_i, _start, _size, _ranks`` per group.  Each larger interval is cut into
    parts by CUTS percentiles of its distinct values, and the parts that hold a rank stay.
    A value equal to a cut is a part of its own, so every round leaves less.  Interval ids
    become paths (``3/5/7``), so parts of different rounds never meet.
    """
    keys = [*by, "_i"]
    if wanted.where(F.col("_size") > HELD).isEmpty():
        return held, wanted
    held = materialize(held.withColumn("_i", F.col("_i").cast("string")), "rank-values")
    wanted = wanted.withColumn("_i", F.col("_i").cast("string"))
    while True:
        large = materialize(held.groupBy(*keys).agg(F.count("*").alias("_many")).where(F.col("_many") > HELD), "rank-large")
        if large.isEmpty():
            return held, wanted
        fractions = F.array(*[F.lit(k / CUTS) for k in range(1, CUTS)])
        cuts = held.join(large, keys).groupBy(*keys).agg(F.array_distinct(F.approx_percentile("_v", fractions, F.lit(_ACCURACY))).alias("_cuts"))
        cuts = materialize(cuts.withColumn("_ends", F.filter("_cuts", lambda cut, i: i % _BLOCK == _BLOCK - 1)), "rank-parts")
        part = F.when(F.col("_cuts").isNotNull(), _part(F.col("_v"), F.col("_cuts"), F.col("_ends"))).otherwise(0)
        cut = materialize(held.join(cuts, keys, "left").withColumn("_p", part).drop("_cuts", "_ends"), "rank-cut")
        path = F.concat_ws("/", "_i", F.col("_p").cast("string")).alias("_i")
        earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        parts = cut.groupBy(*keys, "_p").agg(F.sum("_c").alias("_size")).withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        parts = parts.join(wanted.drop("_size"), keys).withColumn("_start", F.col("_start") + F.col("_before"))
        inside = F.filter("_ranks", lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_size")))
        parts = parts.select(*by, path, "_start", "_size", inside.alias("_ranks")).where(F.size("_ranks") > 0)
        wanted = materialize(parts, "rank-intervals")
        left = cut.select(*by, "n", path, "_v", "_c").join(wanted, keys, "left_semi")
        held = materialize(left, "rank-values")


def percentiles(df: DataFrame, value: str, wanted: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """One row per group with a column per wanted percentile (a share in 0..1).

    Interpolates linearly between the two values around the rank ``(n-1) p``.
    Nulls are ignored; groups without values are absent, and without ``by`` an
    empty input gives one row of nulls.
    """
    by = list(by)
    at = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in wanted.items()}
    ranks = F.array(*[f for h in at.values() for f in (F.floor(h), F.ceil(h))])
    values = _rank_values(df, value, ranks, list(wanted.values()), by)

    def at_rank(rank: Column) -> Column:
        return F.max(F.when(F.col("_rank") == rank, F.col("_value")))

    low = [at_rank(F.floor(h)).alias(f"_lo_{name}") for name, h in at.items()]
    high = [at_rank(F.ceil(h)).alias(f"_hi_{name}") for name, h in at.items()]
    ends = values.groupBy(*by).agg(F.max("n").alias("n"), *low, *high)
    return ends.select(
        *by,
        *[
            (
                F.col(f"_lo_{name}")
                + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (h - F.floor(h))
            ).alias(name)
            for name, h in at.items()
        ],
    )


def upper_median(df: DataFrame, value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """The value at position ``n // 2`` of the sorted non-null values."""
    by = list(by)
    rank = F.floor(F.col("n") / F.lit(2))
    values = _rank_values(df, value, F.array(rank), [0.5], by)
    return values.groupBy(*by).agg(F.max("_value").alias(name))
