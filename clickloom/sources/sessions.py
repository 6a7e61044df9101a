"""Visits derived from event times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

FACTS = ["project_id", "visitor_id"]


def assign_sessions(
    events: DataFrame,
    gap_seconds: int = 1800,
    keys: Sequence[str] = ("visitor_id",),
    ts: str = "created_at",
) -> DataFrame:
    """Add ``session_no``; a visit ends after more than ``gap_seconds`` of silence.

    Events closer than the gap always share a visit, so all events of one key in
    one gap-wide slot do. The visit borders are found on one row per key and
    slot, which bounds the rows of even the busiest key by the time range.
    """
    keys = list(keys)
    micros = F.unix_micros(ts)
    slotted = events.withColumn("_slot", F.floor(micros / F.lit(gap_seconds * 1_000_000)))
    edges = slotted.groupBy(*keys, "_slot").agg(F.min(micros).alias("_lo"), F.max(micros).alias("_hi"))
    order = Window.partitionBy(*keys).orderBy("_slot")
    silence = F.col("_lo") - F.lag("_hi").over(order)
    opened = F.when(silence.isNull() | (silence > gap_seconds * 1_000_000), 1).otherwise(0)
    numbered = edges.withColumn("_open", opened).select(
        *keys, "_slot", F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("session_no")
    )
    return slotted.join(numbered, [*keys, "_slot"]).drop("_slot")


def summarise_sessions(events: DataFrame, attributes: Sequence[str] = ()) -> DataFrame:
    """One row per session with counts, pages, bounce flag and duration.

    Attributes are taken from the first event of the session.
    """
    is_view = F.col("event") == "$pageview"
    at = F.struct("created_at", "event_id")
    views = F.count_if(is_view)
    return events.groupBy("session_id").agg(
        F.first("visitor_id").alias("visitor_id"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
        views.alias("pageview_count"),
        F.count_if(~is_view).alias("event_count"),
        F.min_by("path", F.when(is_view, at)).alias("entry_page"),
        F.max_by("path", F.when(is_view, at)).alias("exit_page"),
        (views <= 1).alias("is_bounce"),
        ((F.unix_micros(F.max("created_at")) - F.unix_micros(F.min("created_at"))) / 1000).cast("long").alias("duration_ms"),
        *[F.min_by(a, at).alias(a) for a in attributes],
    )
