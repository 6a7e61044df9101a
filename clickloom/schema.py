"""Schemas of the fact tables written by the ingest job."""

from __future__ import annotations

from pyspark.sql import types as T

_COMMON = "project_id string, visitor_id string, session_id string, created_at timestamp"

TABLES: dict[str, str] = {
    "pageviews": f"{_COMMON}, path string, title string, referrer string, referrer_domain string, "
    "hostname string, duration_ms bigint, utm_source string, utm_medium string, utm_campaign string, "
    "utm_term string, utm_content string, properties string",
    "events": f"{_COMMON}, event_name string, path string, event_data string, "
    "revenue_amount decimal(12,2), revenue_currency string",
    "web_vitals": f"{_COMMON}, path string, metric_name string, metric_value double, rating string",
    "scroll_depths": f"{_COMMON}, path string, max_depth_percent int",
    "search_queries": f"{_COMMON}, path string, query string, results_count int",
    "outlinks": f"{_COMMON}, path string, url string, link_type string",
    "js_errors": f"{_COMMON}, path string, message string, filename string, lineno int, colno int, "
    "stack string, fingerprint string, release string, environment string",
    "log_entries": f"{_COMMON}, level string, message string, logger string, release string, "
    "environment string, attributes string",
    "click_events": f"{_COMMON}, path string, x double, y double, selector string, text string",
}


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])
