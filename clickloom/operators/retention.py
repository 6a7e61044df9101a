"""Retention grids, classic retention and cohort metric tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from clickloom.functions import calendar
from clickloom.functions.props import FilterGroup, PropertyFilter
from clickloom.functions.stats import percent
from clickloom.operators import trends as T
from clickloom.operators.funnels import breakdown_label
from clickloom.operators.trends import Breakdown, Series, TrendsQuery

MAX_INTERVALS = 120
PERIOD_DAYS = {"hour": 1 / 24, "day": 1, "week": 7, "month": 31}


@dataclass(frozen=True)
class RetentionQuery:
    target: Series
    date_from: str
    date_to: str
    returning: Series | None = None
    period: str = "day"
    total_intervals: int = 7
    retention_type: str = "first_time"
    cumulative: bool = False
    timezone: str = "UTC"
    properties: tuple[PropertyFilter, ...] = ()
    filter_group: FilterGroup | None = None
    breakdown: Breakdown | None = None
    aggregation_group_type_index: int | None = None

    @property
    def horizon(self) -> str:
        """End of the last cohort's last interval, at the latest."""
        days = PERIOD_DAYS[self.period] * self.total_intervals
        return str(datetime.fromisoformat(self.date_to) + timedelta(days=days))

    def as_trends(self, start: str, end: str) -> TrendsQuery:
        return TrendsQuery(
            (self.target, self.returning or self.target), start, end, self.period, self.timezone, self.properties,
            self.filter_group, self.breakdown, aggregation_group_type_index=self.aggregation_group_type_index,
        )

    def validate(self) -> "RetentionQuery":
        if self.period not in PERIOD_DAYS:
            raise ValueError("retention period must be hour, day, week or month")
        if not 1 <= self.total_intervals <= MAX_INTERVALS:
            raise ValueError(f"total_intervals must be 1-{MAX_INTERVALS}")
        if self.retention_type not in ("first_time", "recurring"):
            raise ValueError("unknown retention type")
        self.as_trends(self.date_from, self.date_to).validate()
        return self


def cells(ev: DataFrame, q: RetentionQuery) -> DataFrame:
    """``actor, cohort, bd, retained`` with the retained interval numbers.

    One pass over the events and one row per actor and period; an actor's
    arrays are bounded by the number of periods.
    """
    q.validate()
    first_time = q.retention_type == "first_time"
    span = q.as_trends("1970-01-01" if first_time else q.date_from, q.horizon)
    base = T.scoped(ev, span)
    at = F.col("created_at")
    start_test, return_test = (T.series_predicate(s) for s in span.series)
    begin, end = calendar.instant(q.date_from), calendar.instant(q.date_to)
    before = at < begin
    is_start = F.coalesce(start_test, F.lit(False))
    is_return = F.coalesce(return_test, F.lit(False)) & ~before
    rows = base.filter(is_start | is_return).select(
        T.actor(q.aggregation_group_type_index).alias("actor"),
        F.when(before, -1).otherwise(calendar.bucket_index(at, q.date_from, q.period, q.timezone)).alias("period"),
        (is_start & (at < end)).alias("started"),
        is_return.alias("returned"),
        (q.breakdown.text() if q.breakdown else F.lit("")).alias("bd"),
    )
    active = rows.groupBy("actor", "period").agg(
        F.bool_or("started").alias("started"), F.bool_or("returned").alias("returned"),
        F.min(F.when(F.col("started"), F.col("bd"))).alias("bd"),
    )
    starts = F.collect_list(F.when(F.col("started"), F.struct("period", "bd")))
    returns = F.collect_list(F.when(F.col("returned"), F.col("period")))
    actors = active.groupBy("actor").agg(F.array_sort(starts).alias("starts"), returns.alias("returns"))
    if first_time:
        firsts = actors.withColumn("start", F.get("starts", F.lit(0))).filter(F.col("start")["period"] >= 0)
    else:
        firsts = actors.withColumn("start", F.explode("starts"))
    labels = F.size(calendar.bucket_starts(q.date_from, q.horizon, q.period, q.timezone))
    cohort = F.col("start")["period"]
    last = F.least(F.lit(q.total_intervals), labels - cohort) - 1
    steps = F.sequence(F.lit(0), last)
    if q.cumulative:
        # Retained in i when any return falls in i or later inside the grid.
        furthest = F.array_max(F.filter("returns", lambda r: r <= cohort + last))
        kept = F.filter(steps, lambda i: (i == 0) | (F.coalesce(furthest, F.lit(-1)) >= cohort + i))
    else:
        kept = F.filter(steps, lambda i: (i == 0) | F.array_contains("returns", cohort + i))
    out = firsts.select("actor", cohort.alias("cohort"), F.col("start")["bd"].alias("bd"), kept.alias("retained"))
    if q.breakdown:
        out = T.label_breakdowns(out, _top(ev, q))
    return out


def _top(ev: DataFrame, q: RetentionQuery) -> DataFrame:
    return T.top_breakdowns(T.hits(ev, q.as_trends(q.date_from, q.date_to)), q.breakdown.limit)


def retention(ev: DataFrame, q: RetentionQuery) -> DataFrame:
    """``breakdown_value, date, interval, count, percentage`` without gaps."""
    found = cells(ev, q)
    counts = found.select("bd", "cohort", F.explode("retained").alias("interval")).groupBy("bd", "cohort", "interval").agg(
        F.count("*").alias("count")
    )
    groups = _top(ev, q).select("bd") if q.breakdown else ev.sparkSession.range(1).select(F.lit("").alias("bd"))
    labels = calendar.bucket_labels(q.date_from, q.horizon, q.period, q.timezone)
    cohorts = F.size(calendar.bucket_starts(q.date_from, q.date_to, q.period, q.timezone))
    dense = groups.withColumn("labels", labels).withColumn("cohort", F.explode(F.sequence(F.lit(0), cohorts - 1)))
    last = F.least(F.lit(q.total_intervals), F.size("labels") - F.col("cohort")) - 1
    dense = dense.select(
        "bd", "cohort", F.get("labels", F.col("cohort")).alias("date"), F.explode(F.sequence(F.lit(0), last)).alias("interval")
    )
    sizes = counts.filter("interval = 0").select("bd", "cohort", F.col("count").alias("size"))
    full = dense.join(counts, ["bd", "cohort", "interval"], "left").join(sizes, ["bd", "cohort"], "left")
    full = full.fillna(0, ["count", "size"])
    return full.select(
        breakdown_label(F.col("bd")).alias("breakdown_value"), "date", "cohort", "interval", "count",
        percent(F.col("count"), F.col("size")).alias("percentage"),
    )


def retention_actors(
    ev: DataFrame, q: RetentionQuery, cohort: int, interval: int, breakdown_value: str | None = None,
    limit: int | None = 100, offset: int = 0,
) -> DataFrame:
    found = cells(ev, q).filter((F.col("cohort") == cohort) & F.array_contains("retained", interval))
    if breakdown_value is not None:
        found = found.filter(F.col("bd") == breakdown_value)
    return T.page(found.select("actor").distinct(), [F.col("actor")], limit, offset)


CLASSIC_OFFSETS = (1, 7, 14, 30, 60, 90)
CLASSIC_UNITS = {"daily": "day", "weekly": "week", "monthly": "month"}


def _first_visits(sessions: DataFrame, unit: str) -> DataFrame:
    firsts = sessions.groupBy("visitor_id").agg(F.min("first_at").alias("first_visit"))
    return firsts.select("visitor_id", F.to_date(F.date_trunc(unit, "first_visit")).alias("cohort"))


def _cohort_dates(df: DataFrame, start: str, end: str, unit: str) -> DataFrame:
    """All period starts from the one holding ``start`` up to ``end``."""
    return df.sparkSession.range(1).select(F.explode(calendar.period_starts(start, end, unit)).alias("cohort"))


def classic_retention(sessions: DataFrame, start: str, end: str, period: str = "weekly", offsets=CLASSIC_OFFSETS) -> DataFrame:
    """First-visit cohorts and who had a session exactly N days after the cohort date."""
    unit = CLASSIC_UNITS[period]
    members = _first_visits(sessions, unit)
    days = sessions.select("visitor_id", F.to_date("first_at").alias("day")).distinct()
    back = days.join(members, "visitor_id").withColumn("offset", F.datediff("day", "cohort"))
    hits = back.filter(F.col("offset").isin(list(offsets))).groupBy("cohort", "offset").agg(F.count("*").alias("visitors"))
    sizes = members.groupBy("cohort").agg(F.count("*").alias("total_visitors"))
    dense = _cohort_dates(sessions, start, end, unit).withColumn("offset", F.explode(F.array(*[F.lit(n) for n in offsets])))
    full = dense.join(sizes, "cohort", "left").join(hits, ["cohort", "offset"], "left")
    full = full.fillna(0, ["total_visitors", "visitors"])
    return full.select(
        F.col("cohort").alias("date"), "total_visitors", F.col("offset").alias("period"), "visitors",
        percent(F.col("visitors"), F.col("total_visitors")).alias("percentage"),
    )


METRICS = ("pageviews", "sessions", "events", "revenue")


def cohort_table(sessions: DataFrame, facts: dict[str, DataFrame], start: str, end: str, group_by: str, metric: str) -> DataFrame:
    """First-visit cohorts by week or month with one metric per later period.

    ``facts`` holds the frame a metric reads: ``pageviews`` or ``events``.
    """
    if metric not in METRICS or group_by not in ("week", "month"):
        raise ValueError("unknown metric or grouping")
    members = _first_visits(sessions, group_by)
    source, at, value = {
        "pageviews": ("pageviews", "created_at", F.count("*")),
        "events": ("events", "created_at", F.count("*")),
        "sessions": ("sessions", "first_at", F.count("*")),
        "revenue": ("events", "created_at", F.sum("revenue_amount")),
    }[metric]
    rows = sessions if source == "sessions" else facts[source]
    # Pre-aggregated per visitor and period, so a busy visitor joins as few rows.
    per_visitor = rows.groupBy("visitor_id", F.to_date(F.date_trunc(group_by, at)).alias("measured")).agg(value.alias("v"))
    values = per_visitor.join(members, "visitor_id").groupBy("cohort", "measured").agg(
        F.sum("v").cast("double").alias("value")
    )
    sizes = members.groupBy("cohort").agg(F.count("*").alias("size"))
    cohorts = _cohort_dates(sessions, start, end, group_by).join(sizes, "cohort")
    last = F.date_sub(F.to_date(calendar.instant(end)), 1)
    dense = cohorts.filter(F.col("cohort") <= last).select(
        "cohort", "size", F.posexplode(F.sequence("cohort", last, calendar.step(group_by))).alias("period_offset", "measured")
    )
    return dense.join(values, ["cohort", "measured"], "left").select(
        "cohort", "size", "period_offset", F.coalesce("value", F.lit(0.0)).alias("value")
    )
