"""Filter interaction audit: what five document filters remove in each of their 120 orders.

Wide packed counters.  Each document's outcome is a 5-bit failure mask (plus its two
labels), and a mask decides all 600 (order, step) outcomes at once.  A mask maps to one
big integer whose fields hold every counter of every step; the integers of a part are
summed and the fields read back.  The field width is taken from the largest part's row
count, so no field carries into the next.

All of it runs in Spark: the per-row tests, the duplicate test against the smallest id
of each text table-wide, a count per (part, mask, labels) that combines in the map
tasks before any shuffle, and the packing.  The big integer of a mask is held as 63-bit
limbs of whole fields (a constant table of 128 rows), so the sums per part are sums of
longs per limb, and shifts and masks cut them back into fields.  At most 32 x 4 counted
rows per part are packed, however many documents or how hot a part or a text is.

Defined cases: null text is empty; a null source is the part ``""``; words are maximal
runs without ``[\\x20\\x09-\\x0D]``; a text of no words fails A and passes B.  E fails
for a row whose text equals the text of a smaller doc_id anywhere in the table; rows
of a null doc_id or of the smallest id of their text (repeated rows included) pass E.
A document counts as good (toxic) if any ``labels`` row of its id says quality (toxic)
1; documents without labels count as neither.  An empty table gives no rows; every
part present gets all 600 rows, zeros included.  Other columns are not read.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipmeter.llm.shipping import ship
from shipmeter.session import materialize

# Fixed values of the audit's contract: filters, thresholds and symbols.
FILTERS = "ABCDE"
MIN_WORDS = 50  # A fails under this many words
DISTINCT_PERCENT = 65  # B fails when 100 * distinct words < 65 * words
UPPER_PERCENT = 5  # C fails when 100 * [A-Z] characters > 5 * code points
SYMBOLS = "[#$%&*|]"  # D fails on any of these
SPACE = "[\\x20\\x09-\\x0D]"

ORDERS = tuple("".join(p) for p in itertools.permutations(FILTERS))  # 120, lexicographic
STEPS = len(FILTERS)
COUNTERS = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
PER_FILTER = ("unique_fails", "shapley")
FIELDS = len(ORDERS) * STEPS * len(COUNTERS) + len(PER_FILTER) * len(FILTERS)
SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def failures(text: Column) -> Column:
    """The 5-bit mask of filters A to D (bits 0 to 3) that a text fails."""
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    n = F.size(words)
    upper = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    bits = [
        n < MIN_WORDS,
        F.size(F.array_distinct(words)) * 100 < n * DISTINCT_PERCENT,
        upper * 100 > F.length(text) * UPPER_PERCENT,
        text.rlike(SYMBOLS),
    ]
    return sum((b.cast("int") * (1 << i) for i, b in enumerate(bits)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic, n``: documents counted by their full failure mask."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.col("doc_id").alias("id"),
        F.unhex(F.sha2(text, 256)).alias("key"),
        failures(text).alias("mask"),
    )
    flags = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    # One row per (text, part, id) first: repeated rows and copies combine before the shuffle.
    by_id = rows.groupBy("key", "part", "mask", "id").agg(F.count(F.lit(1)).alias("n"))
    by_id = by_id.join(flags, "id", "left").na.fill(0, ["good", "toxic"])
    cells = by_id.groupBy("key", "part", "mask", "good", "toxic").agg(
        F.min("id").alias("low"),
        F.sum("n").alias("n"),
        F.min_by("n", "id").alias("n_low"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
    )
    cells = materialize(cells, "audit-cells")  # read twice below; the texts are scanned once
    first = cells.groupBy("key").agg(F.min("low").alias("first"))
    at_first = F.when(F.col("low") == F.col("first"), F.col("n_low")).otherwise(0)
    passing = F.col("n_null") + F.coalesce(at_first, F.lit(0))
    cells = cells.join(first, "key")
    split = cells.select("part", "mask", "good", "toxic", passing.alias("n")).unionByName(
        cells.select("part", (F.col("mask") + 16).alias("mask"), "good", "toxic", (F.col("n") - passing).alias("n"))
    )
    return split.filter("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


@lru_cache(maxsize=None)
def outcomes(mask: int, good: int, toxic: int) -> tuple[int, ...]:
    """The field values of one document of this mask and labels, in packing order."""
    fields: list[int] = []
    for order in ORDERS:
        before = 0
        for letter in order:
            bit = 1 << FILTERS.index(letter)
            fails = bool(mask & bit)
            earlier = bool(mask & before)
            removed = fails and not earlier
            kept = not (mask & (before | bit))
            fields += [int(kept), int(removed), int(fails and earlier), int(removed and good), int(removed and toxic)]
            before |= bit
    fails = bin(mask).count("1")
    fields += [int(mask == 1 << i) for i in range(len(FILTERS))]
    fields += [len(ORDERS) // fails if mask >> i & 1 else 0 for i in range(len(FILTERS))]
    return tuple(fields)


def field_width(rows: int) -> int:
    """Bits that hold the largest sum a field can reach: 120 per row (shapley)."""
    return max(1, (len(ORDERS) * rows).bit_length())


def limbs(values: tuple[int, ...], width: int) -> list[int]:
    """The packed integer of ``values`` (field i at bit i * width) as 63-bit limbs, each
    holding ``63 // width`` whole fields, so sums never carry between limbs."""
    per = max(1, 63 // width)
    out = []
    for start in range(0, len(values), per):
        out.append(sum(v << (j * width) for j, v in enumerate(values[start : start + per])))
    return out


def packed_table(spark, width: int) -> DataFrame:
    """Every (mask, good, toxic) with the limbs of its outcomes: 128 rows, a constant."""
    rows = [(m, g, t, limbs(outcomes(m, g, t), width)) for m in range(32) for g in (0, 1) for t in (0, 1)]
    return spark.createDataFrame(rows, "mask int, good int, toxic int, limbs array<long>")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per (part, filter_order, step): what the step's filter keeps, removes and
    overlaps with, its share of the good and toxic documents it removes, and its total
    over all orders (``shapley``).

    Each counted mask joins its packed integer (as limbs), the limbs times the count are
    summed per part, and the sums are cut back into fields, all in Spark.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    counted = materialize(masks(docs, labels), "audit-masks")
    largest = counted.groupBy("part").agg(F.sum("n").alias("rows")).agg(F.max("rows")).first()[0] or 0
    width = field_width(int(largest))
    per = max(1, 63 // width)
    table = F.broadcast(packed_table(spark, width))
    summed = (
        counted.join(table, ["mask", "good", "toxic"])
        .select("part", "n", F.posexplode("limbs").alias("limb", "value"))
        .groupBy("part", "limb")
        .agg(F.sum(F.col("n") * F.col("value")).alias("total"))
    )
    fields = summed.select("part", "limb", "total", F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("j")).select(
        "part",
        (F.col("limb") * per + F.col("j")).alias("field"),
        F.expr(f"shiftright(total, j * {width}) & {(1 << width) - 1}").alias("value"),
    )
    fields = fields.where(F.col("field") < FIELDS)
    base = len(ORDERS) * STEPS * len(COUNTERS)
    steps = fields.where(F.col("field") < base).select(
        "part",
        (F.col("field") / (STEPS * len(COUNTERS))).cast("int").alias("o"),
        ((F.col("field") % (STEPS * len(COUNTERS))) / len(COUNTERS)).cast("int").alias("s"),
        (F.col("field") % len(COUNTERS)).alias("c"),
        "value",
    )
    wide = steps.groupBy("part", "o", "s").agg(
        *[F.max(F.when(F.col("c") == i, F.col("value"))).alias(name) for i, name in enumerate(COUNTERS)]
    )
    per_filter = fields.where(F.col("field") >= base).select(
        "part",
        ((F.col("field") - base) % len(FILTERS)).alias("f"),
        F.when(F.col("field") < base + len(FILTERS), "unique_fails").otherwise("shapley").alias("kind"),
        "value",
    )
    by_filter = per_filter.groupBy("part", "f").agg(
        F.max(F.when(F.col("kind") == "unique_fails", F.col("value"))).alias("unique_fails"),
        F.max(F.when(F.col("kind") == "shapley", F.col("value"))).alias("shapley"),
    )
    orders = F.broadcast(spark.createDataFrame([(i, o) for i, o in enumerate(ORDERS)], "o int, filter_order string"))
    letter = F.expr("instr('ABCDE', substring(filter_order, s + 1, 1)) - 1")
    rows = wide.join(orders, "o").withColumn("f", letter).join(by_filter, ["part", "f"])
    return rows.select(
        "part",
        "filter_order",
        (F.col("s") + 1).cast("int").alias("step"),
        *[F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")],
    )
