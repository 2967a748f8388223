"""Time a pull request spent as a draft."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shipmeter import KEYS

READY = "ready_for_review"
DRAFT = "converted_to_draft"


def draft_time(prs: DataFrame, events: DataFrame, keys=KEYS, chunk: str = "hour") -> DataFrame:
    """``draft_time_hours`` per pull request.

    A PR starts as a draft at ``created_at``.  Events that repeat the state are
    ignored; a draft that is still open ends at ``merged_at``.  PRs that are not
    a draft now and never became ready spent no time as one.

    Only changes of state matter: with ``+ts`` for each change to ready and
    ``-ts`` for each change to draft, the sum telescopes to the draft time.  The
    changes are found inside chunks of time first and chunks are then joined at
    their edges, so a PR with very many events is spread over many tasks.
    """
    keys = list(keys)
    micros = F.unix_micros("created_at")
    chunk_start = F.unix_micros(F.date_trunc(chunk, F.col("created_at")))
    wanted = F.col("event").isin(READY, DRAFT) & F.col("created_at").isNotNull()
    changes = events.where(wanted).select(
        *keys,
        "event_id",
        "event",
        chunk_start.alias("_chunk"),
        (micros - chunk_start).alias("_offset"),
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_offset", "event_id")
    # Null in "_before" marks the first event of a chunk; the next step settles it.
    before = changes.withColumn("_before", F.lag("event").over(inside))
    sign = F.when(F.col("event") == READY, 1).otherwise(-1)
    changed = F.col("_before").isNotNull() & (F.col("event") != F.col("_before"))
    place = F.struct("_offset", "event_id")
    chunks = before.groupBy(*keys, "_chunk").agg(
        F.min_by("event", place).alias("_first"),
        F.min("_offset").alias("_first_offset"),
        F.max_by("event", place).alias("_last"),
        F.sum(F.when(changed, sign * F.col("_offset"))).alias("_offsets"),
        F.sum(F.when(changed, sign)).alias("_signs"),
        F.max(F.when(changed & (F.col("event") == DRAFT), F.col("_offset"))).alias("_draft_offset"),
        F.bool_or(F.col("event") == READY).alias("_ready"),
    )

    along = Window.partitionBy(*keys).orderBy("_chunk")
    first_sign = F.when(
        F.col("_first") != F.lag("_last", 1, DRAFT).over(along),
        F.when(F.col("_first") == READY, 1).otherwise(-1),
    ).otherwise(0)
    joined = chunks.withColumn("_first_sign", first_sign)
    offsets = (
        F.coalesce("_offsets", F.lit(0))
        + F.col("_first_sign") * F.col("_first_offset")
        + (F.coalesce("_signs", F.lit(0)) + F.col("_first_sign")) * F.col("_chunk")
    )
    opened = F.coalesce("_draft_offset", F.when(F.col("_first_sign") == -1, F.col("_first_offset")))
    per_pr = joined.groupBy(*keys).agg(
        F.sum(offsets.cast("decimal(38,0)")).alias("_sum"),
        F.max_by("_last", "_chunk").alias("_state"),
        F.max(F.col("_chunk") + opened).alias("_opened"),
        F.bool_or("_ready").alias("_ready"),
    )

    created, merged = F.unix_micros("created_at"), F.unix_micros("merged_at")
    still_draft = F.coalesce("_state", F.lit(DRAFT)) == DRAFT
    # An open draft of an unmerged PR adds nothing: its own start is taken back.
    end = F.when(still_draft, F.coalesce(merged, F.col("_opened"), created)).otherwise(0)
    total = F.coalesce("_sum", F.lit(0).cast("decimal(38,0)")) - created + end
    counts = F.coalesce("is_draft", F.lit(False)) | F.coalesce("_ready", F.lit(False))
    return prs.join(per_pr, keys, "left").select(
        *keys,
        F.when(counts, total.cast("double") / F.lit(3.6e9)).otherwise(0.0).alias("draft_time_hours"),
    )
