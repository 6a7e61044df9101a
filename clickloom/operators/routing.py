"""Webhook payloads, destination routing and the delivery outbox."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from clickloom.functions.calendar import instant
from clickloom.plans.small import broadcast_if_small

DEFAULT_EVENT = "webhook_event"
MAX_ATTEMPTS = 3


def normalize_event_type(raw: Column) -> Column:
    """Lower-case name of ``[a-z0-9_.:-]``; blanks and slashes become one underscore."""
    spaced = F.regexp_replace(F.trim(raw), r"[\s/\\]", "_")
    kept = F.regexp_replace(spaced, r"[^A-Za-z0-9_.:-]", "")
    single = F.regexp_replace(F.regexp_replace(kept, "_+", "_"), "^_", "")
    cut = F.regexp_replace(F.lower(single), "^_+|_+$", "")
    return F.when(cut != "", cut).otherwise(DEFAULT_EVENT)


def event_type(payload: Column) -> Column:
    """Type of a JSON payload from its first naming field, when that is a text."""
    root = F.try_parse_json(payload)
    fields = [F.try_variant_get(root, f"$.{n}", "variant") for n in ("event_type", "type", "event", "name")]
    first = F.coalesce(*fields)
    text = F.when(F.schema_of_variant(first) == "STRING", F.try_variant_get(first, "$", "string"))
    return normalize_event_type(F.coalesce(text, F.lit(DEFAULT_EVENT)))


def wrap_payload(source_id: Column, source_name: Column, kind: Column, payload: Column, received_at: Column) -> Column:
    """The payload with the metadata of its source, as sent on to destinations."""
    return F.to_json(
        F.struct(
            kind.alias("event_type"),
            F.struct(source_id.alias("id"), source_name.alias("name")).alias("source"),
            F.date_format(received_at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("received_at"),
            F.try_parse_json(payload).alias("payload"),
        )
    )


def route(events: DataFrame, destinations: DataFrame, kind: str = "event_type", scope: str = "project_id") -> DataFrame:
    """One outbox row per event and active destination of its project that takes its type.

    Destinations with a type list meet events by project and type. Those that
    take everything are first gathered to one short list per project.
    """
    types = F.coalesce("event_types", F.array().cast("array<string>"))
    active = destinations.filter("is_active").select(scope, "destination_id", types.alias("types"))
    named = active.select(scope, F.explode(F.array_distinct("types")).alias(kind), "destination_id")
    typed = events.join(broadcast_if_small(named), [scope, kind])
    general = active.filter(F.size("types") == 0).groupBy(scope).agg(F.collect_list("destination_id").alias("_ids"))
    to_all = events.join(broadcast_if_small(general), scope).withColumn("destination_id", F.explode("_ids")).drop("_ids")
    return typed.unionByName(to_all)


def ingestion_log(events: DataFrame, outbox: DataFrame, key: str = "event_id") -> DataFrame:
    """Each received payload with its number of routed deliveries."""
    counts = outbox.groupBy(key).agg(F.count("*").alias("deliveries"))
    return events.join(counts, key, "left").fillna(0, ["deliveries"])


# Payload transforms.


def _parts(path: str) -> list[str]:
    return [p.strip() for p in path.split(".") if p.strip()]


def _read(doc, path: str):
    def descend(node, part):
        return node.get(part, _read) if isinstance(node, dict) else _read

    return reduce(descend, _parts(path), doc)


def _write(doc: dict, path: str, value) -> None:
    *parents, leaf = _parts(path) or [None]
    if leaf is None:
        return
    for part in parents:
        if not isinstance(doc.get(part), dict):
            doc[part] = {}
        doc = doc[part]
    doc[leaf] = value


def _remove(doc, path: str):
    """Take the value out of the document; `_read` itself marks an absent one."""
    *parents, leaf = _parts(path) or [None]
    for part in parents:
        doc = doc.get(part) if isinstance(doc, dict) else None
    return doc.pop(leaf, _read) if isinstance(doc, dict) and leaf is not None else _read


def reshape(payload, rules: dict):
    """Include paths, exclude paths, rename, set fixed values, then wrap."""
    def option(*names):
        return next((rules[n] for n in names if n in rules), None)

    include, exclude = option("include", "include_fields"), option("exclude", "drop_fields")
    if include is not None:
        out: dict = {}
        for path in include:
            value = _read(payload, path)
            if value is not _read:
                _write(out, path, json.loads(json.dumps(value)))
    else:
        out = json.loads(json.dumps(payload))
    for path in exclude or []:
        _remove(out, path)
    for old, new in (option("rename", "rename_fields") or {}).items():
        value = _remove(out, old)
        if value is not _read:
            _write(out, new, value)
    for path, value in (option("set", "static_fields") or {}).items():
        _write(out, path, value)
    wrap = option("wrap", "wrap_key")
    return {wrap.strip(): out} if wrap else out


@F.pandas_udf(T.StringType())
def transform_payload(payloads: pd.Series, rules: pd.Series) -> pd.Series:
    """Payloads after their destination's transform, as compact JSON with sorted keys."""
    parsed = {text: json.loads(text) for text in rules.dropna().unique()}

    def one(payload, text):
        if payload is None:
            return None
        doc = json.loads(payload)
        out = reshape(doc, parsed[text]) if text is not None and parsed[text] else doc
        return json.dumps(out, sort_keys=True, separators=(",", ":"))

    return pd.Series([one(p, r) for p, r in zip(payloads, rules)], index=payloads.index, dtype=object)


# Outbox.


def due_deliveries(outbox: DataFrame, destinations: DataFrame, now: str, limit: int = 100) -> DataFrame:
    """The oldest waiting deliveries of active destinations."""
    active = broadcast_if_small(destinations.filter("is_active").select("destination_id"))
    waiting = outbox.filter(F.col("status").isin("pending", "retry") & (F.col("next_retry_at") <= instant(now)))
    return waiting.join(active, "destination_id", "left_semi").orderBy("created_at", "delivery_id").limit(limit)


def retry_state(attempts: DataFrame) -> DataFrame:
    """Current state of every delivery from its attempt log.

    ``attempts`` holds ``delivery_id, attempt, ok, at``. A failure waits 60 s,
    doubled per attempt, and the third one is final.
    """
    last = attempts.groupBy("delivery_id").agg(F.max_by(F.struct("attempt", "ok", "at"), "attempt").alias("l")).select("delivery_id", "l.*")
    dead = ~F.col("ok") & (F.col("attempt") >= MAX_ATTEMPTS)
    delay = F.lit(60) * F.pow(F.lit(2.0), F.least(F.col("attempt") - 1, F.lit(5)))
    due = F.when(F.col("ok"), F.lit(None).cast("timestamp")).when(dead, F.col("at")).otherwise(
        F.timestamp_seconds(F.unix_seconds("at") + delay.cast("long"))
    )
    status = F.when(F.col("ok"), "delivered").when(dead, "dead_letter").otherwise("retry")
    return last.select("delivery_id", F.col("attempt").alias("attempts"), status.alias("status"), due.alias("next_retry_at"))


def destination_counters(attempts: DataFrame) -> DataFrame:
    """Last success and failure per destination and failures since the last success."""
    ok = F.col("ok")
    ends = attempts.groupBy("destination_id").agg(
        F.max(F.when(ok, F.col("at"))).alias("last_success_at"), F.max(F.when(~ok, F.col("at"))).alias("last_failure_at")
    )
    failures = attempts.filter(~ok).join(ends.select("destination_id", "last_success_at"), "destination_id")
    since = failures.filter(F.col("last_success_at").isNull() | (F.col("at") > F.col("last_success_at")))
    counts = since.groupBy("destination_id").agg(F.count("*").alias("failure_count"))
    return ends.join(counts, "destination_id", "left").fillna(0, ["failure_count"])


STATUSES = {"pending": "pending_deliveries", "retry": "retry_deliveries", "delivered": "delivered_deliveries", "dead_letter": "dead_letter_deliveries"}


def destination_health(destinations: DataFrame, outbox: DataFrame) -> DataFrame:
    """Deliveries by status and one overall status per destination."""
    counts = outbox.groupBy("destination_id").agg(
        F.count("*").alias("total_deliveries"), *[F.count_if(F.col("status") == s).alias(n) for s, n in STATUSES.items()]
    )
    out = destinations.join(counts, "destination_id", "left").fillna(0, ["total_deliveries", *STATUSES.values()])
    # Without any success a failure still ranks below no success at all.
    failing = F.col("last_failure_at").isNotNull() & (
        F.col("last_success_at").isNull() | (F.col("last_failure_at") > F.col("last_success_at"))
    )
    status = (
        F.when(~F.col("is_active"), "disabled").when(F.col("dead_letter_deliveries") > 0, "degraded").when(failing, "failing").otherwise("healthy")
    )
    return out.withColumn("status", status)
