"""Stored insights: JSON specifications, relative dates and dashboard filters.

A stored specification is a plain dictionary, as read from JSON. It is resolved
against an instant (``now``, in UTC), turned into the query of its kind and run
over an event stream.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame

from clickloom.functions.props import FilterGroup, PropertyFilter
from clickloom.operators import engagement, funnels, paths, retention, trends
from clickloom.operators.funnels import Exclusion, FunnelQuery, Step
from clickloom.operators.paths import PathsQuery
from clickloom.operators.retention import RetentionQuery
from clickloom.operators.trends import Breakdown, Series, TrendsQuery
from clickloom.session import cut_lineage

Spec = Mapping[str, Any]
KINDS = ("trends", "funnels", "retention", "stickiness", "lifecycle", "paths")
MAX_AGO = 10_000
RELATIVE = re.compile(r"-([0-9]{1,5})([hdwmy])")


def _months_ago(day: datetime, n: int) -> datetime:
    """The same day n months earlier, or the last one of a shorter month."""
    year, month = divmod(day.year * 12 + day.month - 1 - n, 12)
    following = datetime(year + (month + 1) // 12, (month + 1) % 12 + 1, 1)
    return day.replace(year=year, month=month + 1, day=min(day.day, (following - timedelta(days=1)).day))


def resolve(text: str, now: datetime) -> datetime:
    """An absolute or relative date as wall-clock time of UTC.

    ``-24h`` counts from ``now``; days, weeks, months and years (``-7d``, ``-2w``,
    ``-1m``, ``-1y``) and ``dStart``, ``mStart``, ``yStart`` begin at midnight.
    """
    now = _utc(now)
    today = now.replace(hour=0, minute=0, second=0, microsecond=0)
    starts = {"dStart": today, "mStart": today.replace(day=1), "yStart": today.replace(month=1, day=1)}
    if text in starts:
        return starts[text]
    try:
        if found := RELATIVE.fullmatch(text):
            n, unit = int(found[1]), found[2]
            if n > MAX_AGO:
                raise ValueError
            if unit == "h":
                return now - timedelta(hours=n)
            if unit in "dw":
                return today - timedelta(days=n * (7 if unit == "w" else 1))
            return _months_ago(today, n * (12 if unit == "y" else 1))
        return _utc(datetime.fromisoformat(text))
    except (ValueError, OverflowError):
        raise ValueError(f"unrecognised date {text!r}") from None


def _utc(moment: datetime) -> datetime:
    return moment.astimezone(timezone.utc).replace(tzinfo=None) if moment.tzinfo else moment


def resolved(spec: Spec, now: datetime) -> dict[str, Any]:
    """The specification with absolute dates; without ``date_to`` it ends now."""
    out = dict(spec)
    if out.get("date_from") is None:
        raise ValueError("date_from is missing")
    out["date_from"] = str(resolve(out["date_from"], now))
    out["date_to"] = str(_utc(now) if out.get("date_to") is None else resolve(out["date_to"], now))
    return out


def with_dashboard(spec: Spec, filters: Spec) -> dict[str, Any]:
    """The specification under a dashboard's filters: its dates win, its properties must hold as well."""
    out = dict(spec)
    out |= {key: filters[key] for key in ("date_from", "date_to") if filters.get(key) is not None}
    if filters.get("properties"):
        out["properties"] = [*(spec.get("properties") or ()), *filters["properties"]]
    return out


def _filter(v: Spec) -> PropertyFilter:
    value = v.get("value")
    return PropertyFilter(v["key"], v.get("operator", "exact"), tuple(value) if isinstance(value, list) else value, v.get("type", "event"), v.get("group_type_index"))


def _filters(v: Spec) -> tuple[PropertyFilter, ...]:
    return tuple(_filter(p) for p in v.get("properties") or ())


def _group(v: Spec | None) -> FilterGroup | None:
    if v is None:
        return None
    return FilterGroup(v.get("type", "AND"), tuple(_group(x) if "values" in x else _filter(x) for x in v["values"]))


def _breakdown(v: Spec | None) -> Breakdown | None:
    if v is None:
        return None
    limit = {} if v.get("limit") is None else {"limit": v["limit"]}
    return Breakdown(v["property"], v.get("type", "event"), group_type_index=v.get("group_type_index"), **limit)


def _given(v: Spec, *names: str, **renamed: str) -> dict[str, Any]:
    """Fields that are present and not null, by the name the query has for them."""
    named = {name: name for name in names} | {new: old for new, old in renamed.items()}
    return {new: v[old] for new, old in named.items() if v.get(old) is not None}


def _series(v: Spec) -> Series:
    given = _given(v, "event", "math", "math_property", "math_property_type", "math_group_type_index", "custom_name")
    return Series(**given, properties=_filters(v))


def _shared(v: Spec) -> dict[str, Any]:
    common = {"properties": _filters(v), "filter_group": _group(v.get("filter_group"))}
    return common | _given(v, "date_from", "date_to")


def _trends(v: Spec) -> TrendsQuery:
    given = _given(v, "interval", "timezone", "compare", "formula", "smoothing_intervals", "cumulative", "aggregation_group_type_index")
    return TrendsQuery(tuple(_series(s) for s in v["series"]), **_shared(v), **given, breakdown=_breakdown(v.get("breakdown")))


def _funnel(v: Spec) -> FunnelQuery:
    given = _given(
        v, "order", "interval", "timezone", "from_step", "to_step", "bins", "aggregation_group_type_index",
        window="funnel_window", window_unit="funnel_window_unit", attribution="breakdown_attribution", attribution_step="breakdown_attribution_step",
    )
    steps = tuple(Step(s.get("event"), _filters(s), s.get("custom_name")) for s in v["steps"])
    left_out = tuple(Exclusion(x.get("event"), _filters(x), None, x["from_step"], x["to_step"]) for x in v.get("exclusions") or ())
    return FunnelQuery(steps, **_shared(v), **given, exclusions=left_out, breakdown=_breakdown(v.get("breakdown")))


def _retention(v: Spec) -> RetentionQuery:
    given = _given(v, "period", "total_intervals", "retention_type", "cumulative", "timezone", "aggregation_group_type_index")
    back = _series(v["returning"]) if v.get("returning") else None
    return RetentionQuery(_series(v["target"]), **_shared(v), **given, returning=back, breakdown=_breakdown(v.get("breakdown")))


def _paths(v: Spec) -> PathsQuery:
    given = _given(v, "start_point", "end_point", "step_limit", "edge_limit", "min_edge_weight", "max_edge_weight")
    kinds = v.get("include_event_types") or ["pageview"]
    return PathsQuery(
        **_shared(v), **given, pageviews="pageview" in kinds, custom_events="custom_event" in kinds,
        cleaning=tuple((r["regex"], r["alias"]) for r in v.get("path_cleaning_rules") or ()),
        groupings=tuple(v.get("path_groupings") or ()), exclude=tuple(v.get("exclude_events") or ()),
    )


READERS = {"trends": _trends, "funnels": _funnel, "retention": _retention, "stickiness": _trends, "lifecycle": _trends, "paths": _paths}


def parse(kind: str, spec: Spec, now: datetime):
    """The validated query of a stored specification; fields it does not know are ignored."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of insight {kind!r}")
    try:
        return READERS[kind](resolved(spec, now)).validate()
    except KeyError as missing:
        raise ValueError(f"{missing.args[0]} is missing") from None


def run(ev: DataFrame, kind: str, spec: Spec, now: datetime) -> DataFrame:
    """The rows of a stored insight; a funnel's ``viz`` picks steps, times to convert or the trend."""
    q = parse(kind, spec, now)
    if kind == "funnels":
        views = {"steps": funnels.funnel_steps, "time_to_convert": funnels.convert_histogram, "trends": funnels.conversion_trend}
        return views[spec.get("viz") or "steps"](cut_lineage(funnels.outcomes(ev, q)), q)
    runs = {"trends": trends.trends, "retention": retention.retention, "stickiness": engagement.stickiness, "lifecycle": engagement.lifecycle, "paths": paths.paths}
    return runs[kind](ev, q)
