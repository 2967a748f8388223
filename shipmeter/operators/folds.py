"""Row positions and contiguous folds without gathering the rows in one task.

A row number over a whole table is usually a window without a partition, which sends
every row to one task.  Here the rows are dealt into key ranges and sorted within
each range; the id Spark gives a row in a task counts the rows before it in that
task, the counts per range give each range its offset, and the offset plus the count
is the position.  Only one number per range travels, in a table joined by broadcast
(as many rows as ranges).

Folds are then cut from positions as an unshuffled k-fold split cuts them: the first
``n % k`` folds hold ``n // k + 1`` rows, the others ``n // k``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shipmeter.session import materialize

_TASK_BITS = 33  # monotonically_increasing_id keeps the task in the bits above these


def positions(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """``df`` with the 0-based position of each row in ``order`` (ascending, nulls first).

    ``order`` should be a key; rows that tie on it take some order among themselves.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = materialize(
        ranged.withColumns({"_task": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}), "positions"
    )
    counts = tagged.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_task", (F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))).alias("_offset")
    ).fillna(0, ["_offset"])
    within = F.col("_id") - F.shiftleft(F.col("_task").cast("long"), _TASK_BITS)
    placed = tagged.join(F.broadcast(offsets), "_task")
    return placed.withColumn(name, (F.col("_offset") + within).cast("long")).drop("_task", "_id", "_offset")


def fold_of(position: Column, n: Column | int, folds: int) -> Column:
    """The contiguous fold of a 0-based position among ``n`` rows."""
    n = F.lit(n) if isinstance(n, int) else n
    q, r = F.floor(n / folds), n % folds
    big = r * (q + 1)
    return F.when(position < big, F.floor(position / (q + 1))).otherwise(r + F.floor((position - big) / q)).cast("int")


def contiguous_folds(df: DataFrame, order: list[str], folds: int = 5) -> DataFrame:
    """``df`` with ``position`` and ``fold`` (0 to folds - 1) in the order of ``order``."""
    placed = positions(df, order)
    n = placed.select(F.count(F.lit(1))).scalar()
    return placed.withColumn("fold", fold_of(F.col("position"), n, folds))
