"""The unified event stream over page views and custom events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

PAGEVIEW = "$pageview"
NONE_LABEL = "$$_none"
OTHER_LABEL = "$$_other"

_MAP = "map<string,string>"


def json_map(column: str | Column) -> Column:
    """A JSON object as a map of texts; anything else is an empty map."""
    text = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.when(F.ltrim(text).startswith("{"), F.from_json(text, _MAP)), F.create_map().cast(_MAP))


def _overlay(base: Column, **named: Column) -> Column:
    pairs = [part for key, value in named.items() for part in (F.lit(key), value.cast("string"))]
    return F.map_concat(base, F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()))


def event_stream(
    pageviews: DataFrame,
    events: DataFrame,
    start=None,
    end=None,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """``event, visitor_id, session_id, created_at, event_id, properties``.

    The range is half open. A side that the wanted names exclude is not read.
    """

    def ranged(df: DataFrame) -> DataFrame:
        if start is not None:
            df = df.filter(F.col("created_at") >= F.lit(start).cast("timestamp"))
        if end is not None:
            df = df.filter(F.col("created_at") < F.lit(end).cast("timestamp"))
        return df

    shared = ["event_id", "project_id", "visitor_id", "session_id", "created_at"]
    sides = []
    if names is None or PAGEVIEW in names:
        pv = ranged(pageviews)
        fields = ["path", "title", "referrer", "referrer_domain", "utm_source", "utm_medium", "utm_campaign"]
        props = _overlay(json_map("properties"), **{f: F.col(f) for f in fields if f in pv.columns})
        sides.append(pv.select(F.lit(PAGEVIEW).alias("event"), *shared, props.alias("properties")))
    custom = None if names is None else [n for n in names if n != PAGEVIEW]
    if custom is None or custom:
        ev = ranged(events)
        if custom is not None:
            ev = ev.filter(F.col("event_name").isin(custom))
        props = _overlay(
            json_map("event_data"),
            path=F.col("path"),
            revenue=F.col("revenue_amount"),
            revenue_currency=F.col("revenue_currency"),
        )
        sides.append(ev.select(F.col("event_name").alias("event"), *shared, props.alias("properties")))
    if not sides:
        return event_stream(pageviews, events).limit(0)
    out = sides[0]
    for side in sides[1:]:
        out = out.unionByName(side)
    return out


def join_sessions(ev: DataFrame, sessions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Session attributes as ``s_<name>`` columns."""
    picked = sessions.select("session_id", *[F.col(c).alias(f"s_{c}") for c in columns])
    return ev.join(picked, "session_id", "left")


def join_profiles(ev: DataFrame, profiles: DataFrame) -> DataFrame:
    """The person's account id and traits as ``user_id`` and ``traits``."""
    return ev.join(profiles.select("visitor_id", "user_id", "traits"), "visitor_id", "left")


def join_groups(ev: DataFrame, groups: DataFrame, indexes: Sequence[int]) -> DataFrame:
    """Properties of each wanted group type as ``g<i>_properties``."""
    for i in indexes:
        side = groups.filter(F.col("type_index") == i).select(
            F.col("group_key").alias(f"_g{i}"), F.col("properties").alias(f"g{i}_properties")
        )
        ev = ev.join(side, F.col("properties")[f"$group_{i}"] == F.col(f"_g{i}"), "left").drop(f"_g{i}")
    return ev
