"""A small BI layer: visual queries, drill-through, row policies, tenant views."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clickloom.functions.calendar import instant
from clickloom.session import configure

DAY = {"pageviews": "created_at", "events": "created_at", "sessions": "first_at", "daily_stats": "date"}


def _or(name: str, default: str) -> Column:
    return F.coalesce(name, F.lit(default))


DIMENSIONS: dict[str, dict[str, Callable[[], Column]]] = {
    "pageviews": {
        "path": lambda: F.col("path"), "referrer_domain": lambda: _or("referrer_domain", "Direct"),
        "utm_source": lambda: _or("utm_source", ""), "utm_medium": lambda: _or("utm_medium", ""),
        "utm_campaign": lambda: _or("utm_campaign", ""), "date": lambda: F.to_date("created_at"),
    },
    "events": {"event_name": lambda: F.col("event_name"), "path": lambda: _or("path", ""), "date": lambda: F.to_date("created_at")},
    "sessions": {
        "browser": lambda: _or("browser", "Unknown"), "os": lambda: _or("os", "Unknown"), "device": lambda: _or("device_type", "desktop"),
        "country": lambda: _or("country", "XX"), "date": lambda: F.to_date("first_at"),
    },
    "daily_stats": {"date": lambda: F.col("date")},
}


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0))


METRICS: dict[str, dict[str, Callable[[], Column]]] = {
    "pageviews": {
        "count": lambda: F.count("*"), "unique_visitors": lambda: F.count_distinct("visitor_id"),
        "sessions": lambda: F.count_distinct("session_id"),
    },
    "events": {
        "count": lambda: F.count("*"), "unique_visitors": lambda: F.count_distinct("visitor_id"),
        "revenue": lambda: _sum("revenue_amount").cast("double"),
    },
    "sessions": {
        "count": lambda: F.count("*"), "visitors": lambda: F.count_distinct("visitor_id"),
        "avg_duration": lambda: F.coalesce(F.avg("duration_ms"), F.lit(0.0)),
    },
    "daily_stats": {n: (lambda n=n: _sum(n)) for n in ("pageviews", "visitors", "sessions")},
}
_SHARED = ["browser", "os", "device", "country"]
FILTERS: dict[str, list[str]] = {
    "pageviews": ["path", "visitor_id", "session_id", "referrer_domain", "utm_source", "utm_medium", "utm_campaign", *_SHARED],
    "events": ["event_name", "path", "visitor_id", "session_id", "revenue_currency"],
    "sessions": ["visitor_id", "entry_page", "exit_page", "referrer_domain", *_SHARED],
    "daily_stats": ["date"],
    "csv_uploads": ["upload_id", "row_number"],
}
DRILL: dict[str, list[str]] = {
    "pageviews": [
        "event_id", "visitor_id", "session_id", "path", "title", "referrer_domain", "utm_source", "utm_medium", "utm_campaign",
        *_SHARED, "created_at",
    ],
    "events": [
        "event_id", "visitor_id", "session_id", "event_name", "path", "event_data", "revenue_amount", "revenue_currency", "created_at",
    ],
    "sessions": [
        "session_id", "visitor_id", "entry_page", "exit_page", *_SHARED, "duration_ms", "pageview_count", "event_count", "first_at", "last_at",
    ],
    "daily_stats": ["date", "pageviews", "visitors", "sessions", "bounces", "total_duration_ms"],
    "csv_uploads": ["upload_id", "row_number", "row_data", "created_at"],
}


@dataclass(frozen=True)
class Policy:
    dataset: str
    field: str
    operator: str
    values: tuple


@dataclass(frozen=True)
class Metric:
    """A named aggregate with its own filter, usable next to the built-in ones."""

    dataset: str
    name: str
    expression: str
    where: str = "true"

    def column(self) -> Column:
        return F.expr(f"{self.expression} FILTER (WHERE {self.where})")


def filter_column(dataset: str, key: str) -> Column:
    if key not in FILTERS.get(dataset, []):
        raise ValueError(f"{key!r} cannot be filtered on dataset {dataset!r}")
    return F.col("device_type" if key == "device" else key)


def filter_clause(dataset: str, key: str, value) -> Column:
    """Equality, or membership for a list."""
    column = filter_column(dataset, key)
    if isinstance(value, (list, tuple)):
        if not value:
            raise ValueError(f"filter {key!r} must not be empty")
        return column.isin(list(value))
    return column == value


def policy_clause(p: Policy) -> Column:
    """Rows a policy lets through; a NULL field passes no policy."""
    if not p.values:
        raise ValueError("policy values cannot be empty")
    member = filter_column(p.dataset, p.field).isin(list(p.values))
    if p.operator in ("eq", "in"):
        return member
    if p.operator in ("neq", "not_in"):
        return ~member
    raise ValueError(f"unknown policy operator {p.operator!r}")


def apply_policies(df: DataFrame, dataset: str, policies: Sequence[Policy]) -> DataFrame:
    for p in policies:
        if p.dataset == dataset:
            df = df.filter(policy_clause(p))
    return df


def _ranged(df: DataFrame, dataset: str, start: str, end: str) -> DataFrame:
    ts = DAY[dataset]
    if dataset == "daily_stats":
        return df.filter(F.col(ts).between(F.to_date(instant(start)), F.to_date(instant(end))))
    return df.filter((F.col(ts) >= instant(start)) & (F.col(ts) <= instant(end)))


def visual_query(
    df: DataFrame, dataset: str, dimensions: Sequence[str], metrics: Sequence[str | Metric], start: str, end: str,
    policies: Sequence[Policy] = (), limit: int | None = None, totals: str | None = None,
) -> DataFrame:
    """Metrics by any number of dimensions, largest first metric first; all rows unless a page of ``limit`` is asked for.

    ``totals`` may be ``rollup`` or ``cube`` to add subtotals.
    """
    if dataset not in DIMENSIONS:
        raise ValueError(f"unknown dataset {dataset!r}")
    try:
        groups = [DIMENSIONS[dataset][d]().alias(d) for d in dimensions]
        wanted = list(metrics) or ["count"]
        values = [
            m.column().alias(m.name) if isinstance(m, Metric) else METRICS[dataset][m]().alias(m) for m in wanted
        ]
    except KeyError as error:
        raise ValueError(f"{error.args[0]!r} is unknown for dataset {dataset!r}") from error
    rows = apply_policies(_ranged(df, dataset, start, end), dataset, policies)
    by = rows.rollup(*groups) if totals == "rollup" else rows.cube(*groups) if totals == "cube" else rows.groupBy(*groups)
    out = by.agg(*values)
    first = wanted[0].name if isinstance(wanted[0], Metric) else wanted[0]
    order = [F.desc(first), *[F.col(d) for d in dimensions]]
    return out.orderBy(*order).limit(limit) if limit and dimensions else out


def drill_through(
    df: DataFrame, dataset: str, filters: dict, start: str, end: str, policies: Sequence[Policy] = (), limit: int | None = None,
    sessions: DataFrame | None = None,
) -> DataFrame:
    """The rows behind a number, newest first; views take device and place from their session."""
    if dataset == "pageviews" and sessions is not None:
        side = sessions.select("session_id", "browser", "os", "device_type", "country")
        df = df.join(side, "session_id", "left")
    rows = apply_policies(_ranged(df, dataset, start, end), dataset, policies)
    for key, value in filters.items():
        rows = rows.filter(filter_clause(dataset, key, value))
    if "device_type" in rows.columns:
        rows = rows.withColumn("device", F.col("device_type"))
    out = rows.select(*DRILL[dataset])
    tie = [c for c in ("event_id", "session_id") if c in out.columns][:1]
    return out.orderBy(F.desc(DAY[dataset]), *[F.desc(t) for t in tie]).limit(limit) if limit else out


# Tables a tenant may query.
TENANT_TABLES = [
    "pageviews", "events", "sessions", "daily_stats", "daily_pages", "daily_referrers", "daily_events", "daily_geo", "daily_devices",
    "daily_campaigns", "web_vitals", "scroll_depths", "search_queries", "outlinks", "js_errors", "log_entries", "click_events",
    "goals", "goal_conversions", "user_profiles", "user_aliases", "account_profiles", "account_memberships", "surveys",
    "survey_responses", "experiments", "experiment_exposures", "csv_upload_rows", "marketing_import_rows", "session_recordings",
]


def tenant_sql(spark: SparkSession, project_id: str, loaders: dict[str, Callable[[SparkSession], DataFrame]], sql: str) -> DataFrame:
    """Run SQL in a session of its own that sees only one project's allowed tables."""
    own = configure(spark.newSession())
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, load in loaders.items():
        if name in TENANT_TABLES:
            load(own).filter(F.col("project_id") == project_id).createOrReplaceTempView(name)
    return own.sql(sql)
