"""Visitor segments: conditions over profiles, sessions, views, events and counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions import calendar
from clickloom.functions.props import all_of, any_of
from clickloom.functions.targeting import holds, json_path


class Facts(Protocol):
    profiles: DataFrame
    sessions: DataFrame
    pageviews: DataFrame
    events: DataFrame
    conversions: DataFrame


@dataclass(frozen=True)
class SegmentCondition:
    source: str
    field: str | None
    op: str
    value: Any = None
    event: str | None = None


@dataclass(frozen=True)
class RuleSet:
    match: str = "all"
    conditions: tuple[SegmentCondition, ...] = field(default_factory=tuple)


METRICS = ("sessions", "pageviews", "events")
SOURCES = ("profile", "session", "pageview", "event")


def _value(c: SegmentCondition) -> Column:
    none = F.lit(None).cast("string")
    if c.source in ("profile", "user", "identity"):
        name = c.field or "user_id"
        if name == "user_id":
            return F.col("user_id")
        for prefix in ("traits.", "trait:"):
            name = name.removeprefix(prefix)
        return F.col("traits")[name]
    if c.source == "session":
        name = c.field or "country"
        return F.col("device_type" if name == "device" else name) if name in ("country", "browser", "os", "device") else none
    if c.source == "pageview":
        name = c.field or "path"
        return F.col(name) if name in ("path", "referrer_domain") else none
    name = c.field or "event_name"
    if name in ("name", "event_name"):
        return F.col("event_name")
    if name == "path":
        return F.col("path")
    for prefix in ("event_data.", "data."):
        if name.startswith(prefix):
            return json_path(F.col("event_data"), name.removeprefix(prefix))
    return none


def _between(df: DataFrame, start, end, ts: str) -> DataFrame:
    if start is not None:
        df = df.filter((F.col(ts) >= calendar.instant(start)) & (F.col(ts) <= calendar.instant(end)))
    return df


def _base(source: str) -> str:
    return "profile" if source in ("user", "identity") else source


def visitor_flags(facts: Facts, conditions: Sequence[SegmentCondition], start=None, end=None) -> DataFrame:
    """One row per known visitor with a flag per condition, in one shuffle."""
    frames = {
        "profile": facts.profiles,
        "session": _between(facts.sessions, start, end, "last_at"),
        "pageview": _between(facts.pageviews, start, end, "created_at"),
        "event": _between(facts.events, start, end, "created_at"),
    }
    counted = {"session": "sessions", "pageview": "pageviews", "event": "events"}
    rows = []
    for source, df in frames.items():
        columns = [F.col("visitor_id")]
        for i, c in enumerate(conditions):
            if _base(c.source) == source:
                test = holds(_value(c), c.op, c.value)
                if source == "event" and c.event:
                    test = test & (F.col("event_name") == c.event)
            else:
                test = F.lit(None).cast("boolean")
            columns.append(test.alias(f"c{i}"))
        for name in METRICS:
            columns.append(F.lit(1 if counted.get(source) == name else 0).alias(name))
        rows.append(df.select(*columns))
    grouped = reduce(DataFrame.unionByName, rows).groupBy("visitor_id").agg(
        *[F.bool_or(f"c{i}").alias(f"c{i}") for i in range(len(conditions))],
        *[F.sum(n).alias(n) for n in METRICS],
    )
    for i, c in enumerate(conditions):
        if c.source == "metric":
            number = F.col(c.field) if c.field in METRICS else F.lit(0)
            grouped = grouped.withColumn(f"c{i}", holds(number.cast("double").cast("string"), c.op, c.value))
        else:
            # A visitor without a profile still meets neq and not_exists.
            absent = _base(c.source) == "profile" and c.op in ("neq", "not_exists")
            grouped = grouped.withColumn(f"c{i}", F.coalesce(f"c{i}", F.lit(absent)))
    return grouped


def _passes(rules: RuleSet, offset: int = 0) -> Column:
    tests = [F.col(f"c{offset + i}") for i in range(len(rules.conditions))]
    if not tests:
        return F.lit(True)
    return any_of(tests) if rules.match == "any" else all_of(tests)


def evaluate(facts: Facts, rules: RuleSet, start=None, end=None) -> DataFrame:
    """Matching visitors with their session, view and event counts."""
    if rules.match not in ("all", "any"):
        raise ValueError("match must be 'all' or 'any'")
    flags = visitor_flags(facts, rules.conditions, start, end)
    return flags.filter(_passes(rules)).select("visitor_id", *METRICS)


def memberships(facts: Facts, segments: dict[str, RuleSet], start=None, end=None) -> DataFrame:
    """``segment, visitor_id`` of several segments from one pass over the facts."""
    conditions, found = [], []
    for name, rules in segments.items():
        found.append(F.when(_passes(rules, len(conditions)), F.lit(name)))
        conditions.extend(rules.conditions)
    flags = visitor_flags(facts, conditions, start, end)
    return flags.select("visitor_id", F.explode(F.array_compact(F.array(*found))).alias("segment"))


def segment_metrics(members: DataFrame, facts: Facts, start=None, end=None) -> DataFrame:
    """Views, viewing sessions, events and conversions of each segment."""
    pv = _between(facts.pageviews, start, end, "created_at")
    ev = _between(facts.events, start, end, "created_at")
    cv = _between(facts.conversions, start, end, "created_at")
    # Per visitor first, so a busy visitor adds one row to the member join.
    # A session belongs to one visitor, so its sessions add up.
    per_visitor = (
        pv.groupBy("visitor_id").agg(F.count("*").alias("pageviews"), F.count_distinct("session_id").alias("sessions"))
        .unionByName(ev.groupBy("visitor_id").agg(F.count("*").alias("events")), allowMissingColumns=True)
        .unionByName(cv.groupBy("visitor_id").agg(F.count("*").alias("conversions")), allowMissingColumns=True)
    )
    names = ["pageviews", "sessions", "events", "conversions"]
    sums = members.join(per_visitor, "visitor_id").groupBy("segment").agg(*[F.sum(n).alias(n) for n in names])
    sizes = members.groupBy("segment").agg(F.count("*").alias("visitors"))
    out = sizes.join(sums, "segment", "left")
    rate = F.when(F.col("visitors") > 0, F.coalesce("conversions", F.lit(0)) / F.col("visitors") * 100).otherwise(0.0)
    return out.select(
        "segment", "visitors", *[F.coalesce(n, F.lit(0)).alias(n) for n in names], rate.alias("conversion_rate")
    )


def breakdown(members: DataFrame, facts: Facts, prop: str, start=None, end=None, limit: int | None = 50) -> DataFrame:
    """Members per value of a session field, path, event name or trait."""
    if prop in ("country", "browser", "os", "device"):
        column = "device_type" if prop == "device" else prop
        side = _between(facts.sessions, start, end, "last_at").select("visitor_id", F.col(column).alias("value"))
    elif prop == "path":
        side = _between(facts.pageviews, start, end, "created_at").select("visitor_id", F.col("path").alias("value"))
    elif prop in ("event", "event_name"):
        side = _between(facts.events, start, end, "created_at").select("visitor_id", F.col("event_name").alias("value"))
    else:
        trait = prop.removeprefix("traits.").removeprefix("trait:")
        side = facts.profiles.select("visitor_id", F.col("traits")[trait].alias("value"))
    pairs = side.withColumn("value", F.coalesce("value", F.lit("Unknown"))).distinct()
    out = pairs.join(members.select("visitor_id"), "visitor_id", "left_semi").groupBy("value").agg(
        F.count("*").alias("visitors")
    )
    return out.orderBy(F.desc("visitors"), "value").limit(limit) if limit else out
