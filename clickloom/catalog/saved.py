"""Stored insights run from JSON (INS46-INS48)."""

from __future__ import annotations

import json
from datetime import datetime

from clickloom.catalog import funnels, retention  # noqa: F401  registered first, as the SQL of stored insights is theirs
from clickloom.catalog.oracle import EV, r4
from clickloom.catalog.registry import ORACLE, query
from clickloom.catalog.trends import day, days
from clickloom.operators.saved import run, with_dashboard

NOW = datetime(2024, 1, 22, 15, 30)


def _daily_sql(value: str, where: str, start: str, end: str) -> str:
    return f"""WITH {EV}, days AS ({days(start, end)}),
    v AS (SELECT {day()} AS bucket, {value} AS value FROM ev WHERE created_at >= TIMESTAMP '{start}' AND created_at < TIMESTAMP '{end}' AND {where} GROUP BY 1)
    SELECT bucket, {r4('coalesce(value, 0)')} AS value FROM days LEFT JOIN v USING (bucket)"""


@query("INS46_relative_range", _daily_sql("count(*)", "event = 'purchase'", "2024-01-15", "2024-01-22 15:30:00"))
def _(m):
    spec = json.loads('{"series": [{"event": "purchase"}], "date_from": "-7d", "date_to": null}')
    return run(m.stream(), "trends", spec, NOW).select("bucket", "value")


@query("INS47_spec_trends", _daily_sql("count(DISTINCT visitor_id)", "event = '$pageview' AND k > 20 AND (path = '/p1' OR (utm_source = 'google' AND k <= 80))", "2024-01-01", "2024-01-22"))
def _(m):
    spec = json.loads("""{
      "series": [{"event": "$pageview", "math": "dau", "properties": [{"key": "k", "operator": "gt", "value": 20}]}],
      "date_from": "mStart", "date_to": "dStart", "interval": "day",
      "filter_group": {"type": "OR", "values": [
        {"key": "path", "value": ["/p1"]},
        {"type": "AND", "values": [{"key": "utm_source", "value": "google"}, {"key": "k", "operator": "lte", "value": 80}]}]}
    }""")
    return run(m.stream(), "trends", spec, NOW).select("bucket", "value")


@query("INS48_dashboard_filters", _daily_sql("count(DISTINCT visitor_id)", "event = 'click' AND k > 10 AND k < 60", "2024-01-08", "2024-01-22"))
def _(m):
    spec = json.loads('{"series": [{"event": "click", "math": "dau"}], "date_from": "-1m", "properties": [{"key": "k", "operator": "gt", "value": 10}]}')
    filters = json.loads('{"date_from": "-2w", "date_to": "dStart", "properties": [{"key": "k", "operator": "lt", "value": 60}]}')
    return run(m.stream(), "trends", with_dashboard(spec, filters), NOW).select("bucket", "value")


# The other kinds, stored with relative dates; the SQL is that of the same insight given as a query.

_FUNNEL = {"steps": [{"event": "$pageview"}, {"event": "click"}, {"event": "purchase"}], "date_from": "-15d", "date_to": "dStart", "funnel_window": 2, "funnel_window_unit": "day"}
_STORED = {
    "INS49_stored_funnel": ("INS05_funnel_steps", "funnels", _FUNNEL, datetime(2024, 1, 20, 9), []),
    "INS49_stored_funnel_trend": ("INS07_conversion_trend", "funnels", _FUNNEL | {"viz": "trends"}, datetime(2024, 1, 20, 9), ["breakdown_value"]),
    "INS49_stored_funnel_times": ("INS06_convert_histogram", "funnels", _FUNNEL | {"viz": "time_to_convert"}, datetime(2024, 1, 20, 9), ["breakdown_value"]),
    "INS50_stored_retention": (
        "INS11_retention_recurring", "retention",
        {"target": {"event": "signup"}, "returning": {"event": "purchase"}, "date_from": "-1w", "date_to": "dStart", "total_intervals": 5, "retention_type": "recurring"}, datetime(2024, 1, 12, 9), [],
    ),
    "INS51_stored_stickiness": ("INS15_stickiness", "stickiness", {"series": [{"event": "click"}, {"event": None}], "date_from": "-2w", "date_to": "dStart"}, NOW, ["compare_label"]),
    "INS52_stored_lifecycle": ("INS17_lifecycle", "lifecycle", {"series": [{"event": "purchase"}], "date_from": "2024-01-08T06:00:00Z", "date_to": "dStart"}, NOW, []),
    "INS53_stored_paths": ("INS19_paths", "paths", {"include_event_types": ["pageview"], "date_from": "2024-01-05", "date_to": "dStart"}, datetime(2024, 1, 25, 9), []),
}
for _name, (_same, _kind, _spec, _now, _left_out) in _STORED.items():
    @query(_name, ORACLE[_same])
    def _(m, kind=_kind, spec=_spec, now=_now, left_out=tuple(_left_out)):
        return run(m.stream(sessions=kind == "paths"), kind, json.loads(json.dumps(spec)), now).drop(*left_out)
