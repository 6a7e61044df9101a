"""Traffic reports over rollups of past days and the raw rows of today."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions.calendar import instant
from clickloom.functions.props import any_of
from clickloom.functions.stats import percent, percent_change, ratio
from clickloom.operators.rollups import device_keys, rounded
from clickloom.operators.trends import page
from clickloom.plans.small import with_row

#: The partition column of fact tables in month folders.
MONTH = "month"


@dataclass(frozen=True)
class Span:
    """A closed range and the day from which rows are read raw."""

    start: str
    end: str
    today: str

    def days(self, rollup: DataFrame) -> DataFrame:
        d = F.col("date")
        return rollup.filter(
            (d >= F.to_date(instant(self.start))) & (d <= F.to_date(instant(self.end))) & (d < F.to_date(F.lit(self.today)))
        )

    def raw(self, df: DataFrame, ts: str = "created_at") -> DataFrame:
        """Rows of the range, whatever the day; of a table in month folders no other month is listed."""
        if MONTH in df.columns:
            df = df.filter(F.col(MONTH).between(F.date_format(instant(self.start), "yyyy-MM"), F.date_format(instant(self.end), "yyyy-MM")))
        return df.filter((F.col(ts) >= instant(self.start)) & (F.col(ts) <= instant(self.end)))

    def fresh(self, df: DataFrame, ts: str = "created_at") -> DataFrame:
        """Rows of today inside the range."""
        return self.raw(df, ts).filter(F.col(ts) >= instant(self.today))


def raw_floor(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """The oldest retained raw time.

    Of a table in month folders the oldest month that has rows is found from
    folder names and row counts, without reading a column, and only its times
    are read. Another table is read in that one column.
    """
    if MONTH in df.columns:
        df = df.filter(F.col(MONTH) == df.agg(F.min(MONTH).alias("oldest")).scalar())
    return df.agg(F.min(ts).alias("floor"))


def unique_visitors(pageviews: DataFrame, daily: DataFrame, span: Span) -> DataFrame:
    """Exact uniques of the retained raw rows plus summed daily uniques of older days."""
    raw = span.raw(pageviews).agg(F.count_distinct("visitor_id").alias("n"))
    floor = raw_floor(pageviews).select(F.to_date("floor")).scalar()
    start, end = F.to_date(instant(span.start)), F.to_date(instant(span.end))
    old = daily.filter((F.col("date") >= start) & (F.col("date") <= end) & (F.col("date") < floor))
    return raw.unionByName(old.agg(F.coalesce(F.sum("visitors"), F.lit(0)).alias("n"))).agg(F.sum("n").alias("visitors"))


def sketched_visitors(sketches: DataFrame, span: Span, *keys: str) -> DataFrame:
    """``visitors_estimate, low, high`` of the range from daily sketches, whatever its length.

    The bounds are three standard errors of the sketch, that is 3 * 1.04 /
    sqrt(2 ** k) of the estimate, with a chance of some 0.3 % to miss.
    """
    start, end = F.to_date(instant(span.start)), F.to_date(instant(span.end))
    days = sketches.filter(F.col("date").between(start, end))
    merged = days.groupBy(*keys).agg(F.hll_union_agg("visitor_sketch").alias("s"), F.max("sketch_k").alias("k"))
    estimate = F.coalesce(F.hll_sketch_estimate("s"), F.lit(0)).cast("long")
    error = 3 * 1.04 / F.sqrt(F.pow(F.lit(2.0), F.col("k")))
    return merged.select(*keys, estimate.alias("visitors_estimate"), F.floor(estimate * (1 - error)).alias("low"), F.ceil(estimate * (1 + error)).alias("high"))


def period_stats(pageviews: DataFrame, sessions: DataFrame, daily: DataFrame, span: Span) -> DataFrame:
    """One row: views, exact visitors, sessions, bounces and total duration."""
    names = ["pageviews", "sessions", "bounces", "total_duration_ms"]
    past = span.days(daily).agg(*[F.sum(n).alias(n) for n in names])
    views = span.fresh(pageviews).agg(
        F.count("*").alias("pageviews"), F.count_distinct("session_id").alias("sessions"),
        F.lit(0).alias("bounces"), F.lit(0).alias("total_duration_ms"),
    )
    visits = span.fresh(sessions, "first_at").agg(
        F.lit(0).alias("pageviews"), F.lit(0).alias("sessions"),
        F.count_if("is_bounce").alias("bounces"), F.sum("duration_ms").alias("total_duration_ms"),
    )
    exact = unique_visitors(pageviews, daily, span).select(*[F.lit(0).alias(n) for n in names], "visitors")
    rows = past.unionByName(views).unionByName(visits).unionByName(exact, allowMissingColumns=True)
    return rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in [*names, "visitors"]])


def events_count(events: DataFrame, daily_events: DataFrame, span: Span) -> DataFrame:
    past = span.days(daily_events).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("events"))
    return past.unionByName(span.fresh(events).agg(F.count("*").alias("events"))).agg(F.sum("events").alias("events"))


def stats_with_previous(
    pageviews: DataFrame, sessions: DataFrame, events: DataFrame, daily: DataFrame, daily_events: DataFrame,
    spans: dict[str, Span],
) -> DataFrame:
    """One row per named period with rates, ready to compare."""
    out = None
    for name, span in spans.items():
        stats = period_stats(pageviews, sessions, daily, span)
        row = with_row(stats, events_count(events, daily_events, span)).select(
            F.lit(name).alias("period"), "pageviews", "visitors", "sessions", "events",
            percent(F.col("bounces"), F.col("sessions")).alias("bounce_rate"),
            (ratio(F.col("total_duration_ms"), F.col("sessions")) / 1000).alias("avg_duration"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def top_pages(pageviews: DataFrame, daily_pages: DataFrame, span: Span, limit: int | None = 100, offset: int = 0) -> DataFrame:
    """Views, summed daily unique views and the mean of daily mean durations."""
    today = span.fresh(pageviews).groupBy("path").agg(
        F.count("*").alias("views"), F.count_distinct("visitor_id").alias("unique_views"),
        rounded(F.avg("duration_ms")).alias("avg_duration_ms"),
    )
    rows = span.days(daily_pages).select("path", "views", "unique_views", "avg_duration_ms").unionByName(today)
    out = rows.groupBy("path").agg(
        F.sum("views").alias("views"), F.sum("unique_views").alias("unique_views"),
        rounded(F.avg("avg_duration_ms")).alias("avg_duration"),
    )
    return page(out, [F.desc("views"), F.col("path")], limit, offset)


def exact_page_uniques(pageviews: DataFrame, span: Span) -> DataFrame:
    """Unique visitors per page over the whole range."""
    return span.raw(pageviews).groupBy("path").agg(F.count_distinct("visitor_id").alias("unique_visitors"))


def top_referrers(pageviews: DataFrame, daily_referrers: DataFrame, span: Span, limit: int | None = 100, offset: int = 0) -> DataFrame:
    domain = F.coalesce("referrer_domain", F.lit("Direct")).alias("referrer_domain")
    today = span.fresh(pageviews).groupBy(domain).agg(F.count_distinct("session_id").alias("visits"))
    rows = span.days(daily_referrers).select("referrer_domain", "visits").unionByName(today)
    out = rows.groupBy("referrer_domain").agg(F.sum("visits").alias("visits"))
    return page(out, [F.desc("visits"), F.col("referrer_domain")], limit, offset)


def top_events(events: DataFrame, daily_events: DataFrame, span: Span, limit: int | None = 100, offset: int = 0) -> DataFrame:
    today = span.fresh(events).groupBy("event_name").agg(F.count("*").alias("count"))
    rows = span.days(daily_events).select("event_name", "count").unionByName(today)
    out = rows.groupBy("event_name").agg(F.sum("count").alias("count"))
    return page(out, [F.desc("count"), F.col("event_name")], limit, offset)


def devices(sessions: DataFrame, span: Span, limit: int | None = 100, offset: int = 0) -> DataFrame:
    out = span.raw(sessions, "first_at").groupBy(*device_keys()).agg(F.count_distinct("visitor_id").alias("visitors"))
    return page(out, [F.desc("visitors"), F.col("browser"), F.col("os"), F.col("device")], limit, offset)


def geo(sessions: DataFrame, span: Span, limit: int | None = 100, offset: int = 0) -> DataFrame:
    country = F.coalesce("country", F.lit("XX")).alias("country")
    out = span.raw(sessions, "first_at").groupBy(country).agg(F.count_distinct("visitor_id").alias("visitors"))
    return page(out, [F.desc("visitors"), F.col("country")], limit, offset)


def timeseries(pageviews: DataFrame, daily: DataFrame, span: Span) -> DataFrame:
    today = span.fresh(pageviews).groupBy(F.to_date("created_at").alias("date")).agg(
        F.count("*").alias("pageviews"), F.count_distinct("visitor_id").alias("visitors"),
        F.count_distinct("session_id").alias("sessions"),
    )
    past = span.days(daily).groupBy("date").agg(*[F.sum(n).alias(n) for n in ("pageviews", "visitors", "sessions")])
    return past.unionByName(today)


# Visitors and sessions.


def visitors_list(sessions: DataFrame, span: Span, prefix: str | None = None, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Visitors with totals and the attributes of their latest session."""
    rows = span.raw(sessions, "first_at")
    if prefix:
        rows = rows.filter(F.startswith("visitor_id", F.lit(prefix)))
    latest = F.struct("last_at", "session_id")
    out = rows.groupBy("visitor_id").agg(
        F.count("*").alias("session_count"), F.sum("pageview_count").alias("pageviews"),
        F.sum("event_count").alias("events"), F.max("last_at").alias("last_seen"), F.min("first_at").alias("first_seen"),
        *[F.max_by(c, latest).alias(c) for c in ("country", "browser", "device_type")],
    )
    return page(out, [F.desc("last_seen"), F.col("visitor_id")], limit, offset)


def visitor_summary(sessions: DataFrame, pageviews: DataFrame, span: Span, patterns: Sequence[str]) -> DataFrame:
    """Totals of every visitor, with views of a page family."""
    latest = F.struct("last_at", "session_id")
    totals = span.raw(sessions, "first_at").groupBy("visitor_id").agg(
        F.count("*").alias("session_count"), F.sum("pageview_count").alias("pageviews"),
        F.sum("event_count").alias("events"), F.min("first_at").alias("first_seen"), F.max("last_at").alias("last_seen"),
        F.sum("duration_ms").alias("total_duration_ms"),
        *[F.max_by(c, latest).alias(c) for c in ("country", "browser", "os", "device_type")],
    )
    family = span.raw(pageviews).filter(in_family(patterns)).groupBy("visitor_id").agg(F.count("*").alias("family_views"))
    return totals.join(family, "visitor_id", "left").fillna(0, ["family_views"])


def visitor_sessions(sessions: DataFrame, visitor: str, span: Span, limit: int | None = 100) -> DataFrame:
    rows = span.raw(sessions.filter(F.col("visitor_id") == visitor), "first_at")
    return page(rows, [F.desc("first_at"), F.col("session_id")], limit)


def session_timeline(pageviews: DataFrame, events: DataFrame, session: str) -> DataFrame:
    """Views and events of one session in time order."""
    mine = F.col("session_id") == session
    pv = pageviews.filter(mine).select("created_at", "event_id", F.lit("pageview").alias("kind"), "path", F.lit(None).cast("string").alias("event_name"))
    ev = events.filter(mine).select("created_at", "event_id", F.lit("event").alias("kind"), "path", "event_name")
    return pv.unionByName(ev).orderBy("created_at", "event_id")


def daily_activity(pageviews: DataFrame, events: DataFrame, span: Span) -> DataFrame:
    """Views and events per visitor and day."""
    pv = span.raw(pageviews).select("visitor_id", F.to_date("created_at").alias("date"), F.lit(1).alias("pv"), F.lit(0).alias("ev"))
    ev = span.raw(events).select("visitor_id", F.to_date("created_at").alias("date"), F.lit(0).alias("pv"), F.lit(1).alias("ev"))
    return pv.unionByName(ev).groupBy("visitor_id", "date").agg(F.sum("pv").alias("pageviews"), F.sum("ev").alias("events"))


def visitor_events(events: DataFrame, visitor: str, span: Span, limit: int | None = 20) -> DataFrame:
    counts = span.raw(events.filter(F.col("visitor_id") == visitor)).groupBy("event_name").agg(F.count("*").alias("count"))
    return page(counts, [F.desc("count"), F.col("event_name")], limit)


def recent_activity(pageviews: DataFrame, events: DataFrame, now: str, limit: int = 50) -> DataFrame:
    """Newest views and events of the last hour."""
    recent = F.col("created_at") >= instant(now) - F.expr("INTERVAL 1 HOUR")
    pv = pageviews.filter(recent).select(
        F.lit("pageview").alias("activity_type"), "visitor_id", F.col("path").alias("detail"),
        F.lit(None).cast("string").alias("event_name"), "created_at", "event_id",
    )
    ev = events.filter(recent).select(
        F.lit("event").alias("activity_type"), "visitor_id", F.col("path").alias("detail"), "event_name", "created_at", "event_id"
    )
    return pv.unionByName(ev).orderBy(F.desc("created_at"), F.desc("event_id")).limit(limit)


def realtime_visitors(pageviews: DataFrame, now: str, minutes: int = 5) -> DataFrame:
    since = instant(now) - F.expr(f"INTERVAL {minutes} MINUTES")
    rows = pageviews.filter((F.col("created_at") > since) & (F.col("created_at") <= instant(now)))
    return rows.agg(F.count_distinct("visitor_id").alias("visitors"))


# Page families, such as pricing pages.


def in_family(patterns: Sequence[str], column: str = "path") -> Column:
    return any_of(F.col(column).like(p) for p in patterns)


def family_stats(pageviews: DataFrame, sessions: DataFrame, daily_pages: DataFrame, span: Span, patterns: Sequence[str]) -> DataFrame:
    """Views, visitors, view-weighted duration and bounce rate of entries there."""
    past = span.days(daily_pages).filter(in_family(patterns)).agg(
        F.coalesce(F.sum("views"), F.lit(0)).alias("v0"), F.coalesce(F.sum("unique_views"), F.lit(0)).alias("u0"),
        F.coalesce(F.avg("avg_duration_ms"), F.lit(0.0)).alias("d0"),
    )
    today = span.fresh(pageviews).filter(in_family(patterns)).agg(
        F.count("*").alias("v1"), F.count_distinct("visitor_id").alias("u1"), F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("d1")
    )
    entries = span.raw(sessions, "first_at").filter(in_family(patterns, "entry_page")).agg(
        F.count_if("is_bounce").alias("b"), F.count("*").alias("n")
    )
    views = F.col("v0") + F.col("v1")
    weighted = (F.col("d0") * F.col("v0") + F.col("d1") * F.col("v1")) / views
    return with_row(past, today, entries).select(
        views.alias("views"), (F.col("u0") + F.col("u1")).alias("visitors"),
        F.when(views > 0, weighted).otherwise(0.0).alias("avg_duration_ms"),
        percent(F.col("b"), F.col("n")).alias("bounce_rate"),
    )


def family_timeseries(pageviews: DataFrame, daily_pages: DataFrame, span: Span, patterns: Sequence[str]) -> DataFrame:
    past = span.days(daily_pages).filter(in_family(patterns)).groupBy("date").agg(
        F.sum("views").alias("views"), F.sum("unique_views").alias("unique_views")
    )
    today = span.fresh(pageviews).filter(in_family(patterns)).groupBy(F.to_date("created_at").alias("date")).agg(
        F.count("*").alias("views"), F.count_distinct("visitor_id").alias("unique_views")
    )
    return past.unionByName(today)


def family_frequency(pageviews: DataFrame, span: Span, patterns: Sequence[str]) -> DataFrame:
    """Visitors by number of views: 1, 2, 3, 4 and 5 or more."""
    per = span.raw(pageviews).filter(in_family(patterns)).groupBy("visitor_id").agg(F.count("*").alias("n"))
    counts = per.groupBy(F.least("n", F.lit(5)).alias("n")).agg(F.count("*").alias("visitor_count"))
    dense = pageviews.sparkSession.range(1, 6).withColumnRenamed("id", "n")
    label = F.when(F.col("n") == 5, "5+").otherwise(F.col("n").cast("string"))
    return dense.join(counts, "n", "left").select(label.alias("visits"), F.coalesce("visitor_count", F.lit(0)).alias("visitor_count"))


def family_referrers(pageviews: DataFrame, span: Span, patterns: Sequence[str], limit: int | None = 20) -> DataFrame:
    domain = F.coalesce("referrer_domain", F.lit("Direct")).alias("referrer_domain")
    out = span.raw(pageviews).filter(in_family(patterns)).groupBy(domain).agg(F.count_distinct("session_id").alias("visits"))
    return page(out, [F.desc("visits"), F.col("referrer_domain")], limit)


def hour_heatmap(pageviews: DataFrame, span: Span, patterns: Sequence[str] = ("%",)) -> DataFrame:
    """Views by weekday (Sunday is 0) and hour."""
    rows = span.raw(pageviews).filter(in_family(patterns))
    return rows.groupBy((F.dayofweek("created_at") - 1).alias("day_of_week"), F.hour("created_at").alias("hour")).agg(
        F.count("*").alias("count")
    )


# Overview, impact and combined reports.


def overview(current: DataFrame, previous: DataFrame, pages: DataFrame) -> DataFrame:
    """Notable changes as rows ``metric, title, severity, summary``.

    ``current`` and ``previous`` are rows of `period_stats`; ``pages`` is a top
    list of `top_pages`.
    """
    before = previous.select(F.col("pageviews").alias("before"))
    top = pages.agg(F.max("views").alias("top"), F.sum("views").alias("all_views"))
    row = with_row(current, before, top)
    change = percent_change(F.col("pageviews"), F.col("before"))
    bounce = percent(F.col("bounces"), F.col("sessions"))
    share = percent(F.col("top"), F.coalesce("all_views", F.lit(0)))

    def insight(test: Column, metric: str, title: Column | str, severity: Column | str, summary: Column) -> Column:
        def text(c):
            return F.lit(c) if isinstance(c, str) else c

        return F.when(
            test,
            F.struct(
                F.lit(metric).alias("metric"), text(title).alias("title"), text(severity).alias("severity"), summary.alias("summary")
            ),
        )

    up = change > 0
    found = F.array_compact(
        F.array(
            insight(
                (F.abs(change) >= 20) & (F.col("before") > 0), "pageviews",
                F.when(up, "Traffic increased").otherwise("Traffic declined"), F.when(up, "info").otherwise("warning"),
                F.format_string("Pageviews changed by %.1f%% versus the previous comparable period.", change),
            ),
            insight(
                (bounce >= 60) & (F.col("sessions") >= 20), "bounce_rate", "Bounce rate is elevated", "warning",
                F.format_string("Bounce rate is %.1f%% across %d sessions.", bounce, F.col("sessions")),
            ),
            insight(
                share >= 50, "pages", "Traffic is concentrated", "info",
                F.format_string("The top page accounts for %.1f%% of views among the returned top pages.", share),
            ),
        )
    )
    return row.select(F.explode(found).alias("i")).select("i.*")


def merge_sources(ours: DataFrame, theirs: DataFrame, key: str, count: str) -> DataFrame:
    """Add the counts of two sources by key."""
    return ours.select(key, count).unionByName(theirs.select(key, count)).groupBy(key).agg(F.sum(count).alias(count))


def activation(activity: DataFrame, events: DataFrame, pageviews: DataFrame, span: Span, names: Sequence[str], paths: Sequence[str]) -> DataFrame:
    """Active visitors that did every required event and saw every required path."""
    cohort = span.raw(activity).select("visitor_id").distinct()
    did = span.raw(events).filter(F.col("event_name").isin(list(names))).groupBy("visitor_id").agg(F.count_distinct("event_name").alias("e"))
    saw = span.raw(pageviews).filter(F.col("path").isin(list(paths))).groupBy("visitor_id").agg(F.count_distinct("path").alias("p"))
    full = cohort.join(did, "visitor_id", "left").join(saw, "visitor_id", "left").fillna(0, ["e", "p"])
    out = full.agg(
        F.count("*").alias("cohort_visitors"), F.count_if((F.col("e") >= len(names)) & (F.col("p") >= len(paths))).alias("activated_visitors")
    )
    return out.withColumn("activation_rate", percent(F.col("activated_visitors"), F.col("cohort_visitors")))


def lifecycle_report(activity: DataFrame, start: str, end: str) -> DataFrame:
    """Active, new, returning, resurrected and dormant visitors of two equal windows."""
    at, lo, hi = F.col("created_at"), instant(start), instant(end)
    before = F.timestamp_micros(2 * F.unix_micros(lo) - F.unix_micros(hi))
    per = activity.filter(at <= hi).groupBy("visitor_id").agg(
        F.bool_or(at >= lo).alias("now"), F.bool_or((at >= before) & (at < lo)).alias("prev"), F.min(at).alias("first")
    )
    now, prev = F.col("now"), F.col("prev")
    return per.agg(
        F.count_if(now).alias("active_visitors"), F.count_if(now & (F.col("first") >= lo)).alias("new_visitors"),
        F.count_if(now & prev).alias("returning_visitors"),
        F.count_if(now & ~prev & (F.col("first") < lo)).alias("resurrected_visitors"),
        F.count_if(prev & ~now).alias("dormant_visitors"),
    )


def impact(rows: DataFrame, split: str, days: int = 7, ts: str = "created_at", distinct: str | None = None) -> DataFrame:
    """A count before and after a split, with change and direction."""
    at, mid = F.col(ts), instant(split)
    span = F.expr(f"INTERVAL {max(1, min(days, 90))} DAYS")
    side = F.when((at >= mid - span) & (at < mid), "before").when((at >= mid) & (at < mid + span), "after")
    tagged = rows.withColumn("side", side).filter(F.col("side").isNotNull())

    def value(name: str) -> Column:
        here = F.col("side") == name
        return F.count_distinct(F.when(here, F.col(distinct))) if distinct else F.count_if(here)

    out = tagged.agg(value("before").alias("before_value"), value("after").alias("after_value"))
    change = F.col("after_value") - F.col("before_value")
    return out.select(
        "before_value", "after_value", change.alias("absolute_change"),
        percent_change(F.col("after_value"), F.col("before_value")).alias("percent_change"),
        F.when(change > 0, "up").when(change < 0, "down").otherwise("flat").alias("direction"),
    )
