"""Relative dates, stored specifications and dashboard filters."""

from datetime import datetime, timezone

import pytest

from clickloom.functions.props import FilterGroup, PropertyFilter
from clickloom.operators import saved
from clickloom.operators.funnels import Exclusion, FunnelQuery, Step
from clickloom.operators.trends import Breakdown, Series, TrendsQuery

NOW = datetime(2026, 11, 16, 15, 30, tzinfo=timezone.utc)


# Fixed cases with known answers.
@pytest.mark.parametrize("text,want", [
    ("-7d", "2026-11-09 00:00:00"), ("-24h", "2026-11-15 15:30:00"), ("-1m", "2026-10-16 00:00:00"), ("mStart", "2026-11-01 00:00:00"),
    ("dStart", "2026-11-16 00:00:00"), ("yStart", "2026-01-01 00:00:00"), ("-2w", "2026-11-02 00:00:00"), ("-1y", "2025-11-16 00:00:00"),
    ("-0d", "2026-11-16 00:00:00"), ("2026-11-01T02:00:00+02:00", "2026-11-01 00:00:00"),
])
def test_relative_dates(text, want):
    assert str(saved.resolve(text, NOW)) == want


def test_months_end_in_shorter_months():
    assert str(saved.resolve("-1m", datetime(2024, 3, 31, 5))) == "2024-02-29 00:00:00"
    assert str(saved.resolve("-12m", datetime(2024, 2, 29))) == "2023-02-28 00:00:00"
    assert str(saved.resolve("-2m", datetime(2024, 2, 10))) == "2023-12-10 00:00:00"


@pytest.mark.parametrize("text", ["7d", "-7", "-d", "-7日", "--7d", "-10001d", "-9999y", "yesterday", ""])
def test_unknown_dates(text):
    with pytest.raises(ValueError):
        saved.resolve(text, NOW)


def test_missing_end_is_now():
    assert saved.resolved({"date_from": "-7d", "date_to": None}, NOW)["date_to"] == "2026-11-16 15:30:00"
    with pytest.raises(ValueError):
        saved.resolved({}, NOW)


def test_trends_spec():
    spec = {
        "series": [{"event": "purchase", "math": "sum", "math_property": "revenue", "properties": [{"key": "k", "value": ["a", "b"]}]}],
        "date_from": "-7d", "interval": "hour", "breakdown": {"property": "plan", "type": "person", "limit": None}, "unknown": 1,
        "filter_group": {"type": "OR", "values": [{"key": "x", "operator": "is_set"}, {"values": [{"key": "y", "value": 1}]}]},
    }
    want = TrendsQuery(
        (Series("purchase", "sum", "revenue", properties=(PropertyFilter("k", value=("a", "b")),)),), "2026-11-09 00:00:00", "2026-11-16 15:30:00",
        interval="hour", breakdown=Breakdown("plan", "person"),
        filter_group=FilterGroup("OR", (PropertyFilter("x", "is_set"), FilterGroup("AND", (PropertyFilter("y", value=1),)))),
    )
    assert saved.parse("trends", spec, NOW) == want
    with pytest.raises(ValueError):
        saved.parse("trends", {"date_from": "-7d"}, NOW)
    with pytest.raises(ValueError):
        saved.parse("tables", spec, NOW)


def test_funnel_spec():
    spec = {"steps": [{"event": "a"}, {"event": "b", "custom_name": "B"}], "date_from": "-1m", "date_to": "dStart", "funnel_window": 3, "funnel_window_unit": "hour", "exclusions": [{"event": "c", "from_step": 0, "to_step": 1}]}
    want = FunnelQuery((Step("a"), Step("b", (), "B")), "2026-10-16 00:00:00", "2026-11-16 00:00:00", window=3, window_unit="hour", exclusions=(Exclusion("c"),))
    assert saved.parse("funnels", spec, NOW) == want


def test_dashboard_filters():
    spec = {"date_from": "-7d", "properties": [{"key": "a"}]}
    assert saved.with_dashboard(spec, {"date_from": "mStart", "properties": [{"key": "b"}]}) == {"date_from": "mStart", "properties": [{"key": "a"}, {"key": "b"}]}
    assert saved.with_dashboard(spec, {"date_to": None}) == spec


@pytest.mark.parametrize("kind,spec", [
    ("trends", {"series": [{"event": "purchase"}]}),
    ("stickiness", {"series": [{"event": "click"}]}),
    ("lifecycle", {"series": [{"event": "click"}]}),
    ("funnels", {"steps": [{"event": "$pageview"}, {"event": "click"}]}),
    ("funnels", {"steps": [{"event": "$pageview"}, {"event": "click"}], "viz": "trends"}),
    ("funnels", {"steps": [{"event": "$pageview"}, {"event": "click"}], "viz": "time_to_convert"}),
    ("retention", {"target": {"event": "$pageview"}, "total_intervals": 3}),
    ("paths", {"include_event_types": ["pageview", "custom_event"], "step_limit": 3}),
])
def test_every_kind_runs(demo, kind, spec):
    found = saved.run(demo.stream(sessions=True), kind, spec | {"date_from": "-7d"}, datetime(2024, 1, 22, 15, 30))
    assert found.count() > 0
