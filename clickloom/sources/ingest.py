"""Collect envelopes: parsing, outcomes, routing to tables, replay chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions.channels import referrer_host
from clickloom.functions.hashing import error_fingerprint
from clickloom.operators.privacy import PrivacySettings, skip_reason
from clickloom.operators.quality import log_level, vital_rating

# Envelope types and the table each one is appended to.
TARGETS = {
    "pageview": "pageviews", "event": "events", "identify": "identifies", "web_vital": "web_vitals", "scroll_depth": "scroll_depths",
    "search_query": "search_queries", "outlink": "outlinks", "js_error": "js_errors", "log": "log_entries",
    "click_event": "click_events", "survey_response": "survey_responses", "session_replay": "session_replays",
}

ENVELOPE = """type string, timestamp bigint, project_id string, visitor_id string, session_id string, user_agent string,
 dnt boolean, consent_mode string, consent_granted boolean, groups map<string,string>, path string, title string, referrer string,
 hostname string, screen string, language string, utm_source string, utm_medium string, utm_campaign string, utm_term string,
 utm_content string, properties string, name string, data string, revenue double, currency string, user_id string, traits string,
 metric_name string, metric_value double, rating string, max_depth_percent int, query string, results_count int, url string,
 link_type string, message string, filename string, lineno int, colno int, stack string, release string, environment string,
 level string, logger string, attributes string, x double, y double, selector string, text string, survey_id string,
 answers string, completed boolean, events array<string>, duration_ms bigint, is_complete boolean"""


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Envelope columns, the event time (client time, else arrival), the raw text and all other columns of ``lines``.

    A column of ``lines`` that is named like an envelope field stays under ``line.``.
    """
    others = [c for c in lines.columns if c not in (column, "received_at")]
    rows = lines.select(F.col(column).alias("raw"), "received_at", *others, F.from_json(column, ENVELOPE).alias("_e"))
    fields = rows.schema["_e"].dataType.names
    carried = [F.col(c).alias(f"line.{c}" if c in fields else c) for c in others]
    at = F.coalesce(F.timestamp_millis("_e.timestamp"), F.col("received_at"))
    return rows.select("raw", "received_at", *carried, "_e.*", at.alias("created_at"))


def with_outcome(envelopes: DataFrame, settings: PrivacySettings = PrivacySettings()) -> DataFrame:
    """``outcome`` tracked, skipped or failed, with the reason."""
    skipped = skip_reason(
        settings, F.col("user_agent"), F.coalesce("dnt", F.lit(False)), F.col("consent_mode"), F.col("consent_granted")
    )
    failed = (
        F.when(F.col("type").isNull() | ~F.col("type").isin(list(TARGETS)), "unknown type")
        .when(F.coalesce("visitor_id", F.lit("")) == "", "missing visitor")
        .when((F.col("type") == "log") & log_level(F.col("level")).isNull(), "unsupported level")
    )
    outcome = F.when(failed.isNotNull(), "failed").when(skipped.isNotNull(), "skipped").otherwise("tracked")
    return envelopes.withColumn("outcome", outcome).withColumn("reason", F.coalesce(failed, skipped))


def batch_items(batches: DataFrame, column: str = "value", largest: int | None = None) -> DataFrame:
    """One line per item of a batch envelope, told apart by ``batch_id`` and ``position``.

    Every item is kept whatever the size of its batch. With ``largest``, a
    larger batch is refused as a whole: one line without a value. An empty or
    unreadable batch is such a line as well.
    """
    items = F.from_json(F.coalesce(F.get_json_object(column, "$.events"), F.get_json_object(column, "$.batch")), "array<string>")
    sized = batches.withColumn("_items", items)
    fits = F.size("_items") >= 1 if largest is None else F.size("_items").between(1, largest)
    return sized.select(
        "batch_id", "received_at", F.posexplode(F.when(fits, F.col("_items")).otherwise(F.array(F.lit(None).cast("string")))).alias("position", "value")
    )


def batch_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("batch_id").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("tracked", "skipped", "failed")]
    )


def _columns(kind: str) -> dict[str, Column]:
    """Columns of a table whose name or value differs from the envelope's."""
    if kind == "pageview":
        return {"referrer_domain": referrer_host(F.col("referrer"))}
    if kind == "event":
        return {
            "event_name": F.col("name"), "event_data": F.col("data"),
            "revenue_amount": F.col("revenue").cast("decimal(12,2)"), "revenue_currency": F.col("currency"),
        }
    if kind == "web_vital":
        return {"rating": F.coalesce("rating", vital_rating(F.col("metric_name"), F.col("metric_value")))}
    if kind == "js_error":
        return {"fingerprint": error_fingerprint(F.col("message"), F.col("filename"), F.col("lineno"), F.col("stack"))}
    if kind == "log":
        return {"level": log_level(F.col("level"))}
    return {}


def route(tracked: DataFrame, kind: str) -> DataFrame:
    """The tracked envelopes of one type with their table's columns."""
    return tracked.filter(F.col("type") == kind).withColumns(_columns(kind) or {"type": F.col("type")})


def quarantine(envelopes: DataFrame) -> DataFrame:
    """Failed envelopes with their raw text, kept instead of dropped."""
    return envelopes.filter("outcome = 'failed'").select("received_at", "raw", "reason")


# Session replay.


def recordings(chunks: DataFrame) -> DataFrame:
    """One row per recorded session, merged from its chunks.

    ``chunks`` holds ``session_id, visitor_id, chunk_at, chunk_no, events,
    duration_ms, is_complete`` and the attributes of the page and device.
    """
    at = F.struct("chunk_at", "chunk_no")
    attributes = [c for c in ("entry_page", "browser", "os", "device_type", "country", "screen") if c in chunks.columns]
    return chunks.groupBy("session_id").agg(
        F.max_by("visitor_id", at).alias("visitor_id"), F.sum(F.size("events")).alias("events_count"),
        F.min("chunk_at").alias("started_at"), F.max(F.coalesce("duration_ms", F.lit(0))).alias("duration_ms"),
        *[F.min_by(a, F.when(F.col(a).isNotNull(), at)).alias(a) for a in attributes],
        F.bool_or(F.coalesce("is_complete", F.lit(False))).alias("is_complete"),
    )


def recording_events(chunks: DataFrame) -> DataFrame:
    """The recorded events in order, one row each, so a long session needs no single array."""
    return chunks.select("session_id", "chunk_at", "chunk_no", F.posexplode("events").alias("position", "event"))


def list_recordings(found: DataFrame, start: str, end: str, limit: int = 50, offset: int = 0) -> DataFrame:
    at = F.col("started_at")
    rows = found.filter((at >= F.lit(start).cast("timestamp")) & (at <= F.lit(end).cast("timestamp")))
    return rows.orderBy(F.desc("started_at"), F.desc("session_id")).offset(offset).limit(limit)
