"""CSV exports, daily summaries and scheduled report payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clickloom.functions.calendar import instant
from clickloom.operators import marketing, reports
from clickloom.operators.reports import Span
from clickloom.plans.small import with_row


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """Quoted CSV with a header; ``files`` limits the number of files for small reports."""
    out = df.coalesce(files) if files else df
    out.write.mode("overwrite").csv(path, header=True, escape='"')


def stats_rows(pageviews: DataFrame, sessions: DataFrame, daily: DataFrame, span: Span) -> DataFrame:
    """Daily figures: rollups of past days and one row for today."""
    names = ["pageviews", "visitors", "sessions", "bounces", "total_duration_ms"]
    past = span.days(daily).groupBy("date").agg(*[F.sum(n).alias(n) for n in names])
    views = span.fresh(pageviews).agg(
        F.count("*").alias("pageviews"), F.count_distinct("visitor_id").alias("visitors"), F.count_distinct("session_id").alias("sessions")
    )
    visits = span.fresh(sessions, "first_at").agg(
        F.count_if("is_bounce").alias("bounces"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_duration_ms")
    )
    today = with_row(views, visits).withColumn("date", F.to_date(F.lit(span.today)))
    return past.unionByName(today.filter(F.to_date(instant(span.end)) >= F.col("date")))


def campaign_rows(pageviews: DataFrame, sessions: DataFrame, daily: DataFrame, span: Span) -> DataFrame:
    """All campaigns with their bounces, to be sorted by visitors."""
    tagged = pageviews.filter(F.col("utm_source").isNotNull())
    out = marketing.campaign_stats(tagged, sessions, daily, span, limit=None)
    return out.drop("bounce_rate").orderBy(F.desc("visitors"), *marketing.UTM)


def daily_summaries(daily: DataFrame, date: str) -> DataFrame:
    """One summary per project and day with rounded bounce rate and whole durations."""
    rows = daily.filter(F.col("date") == F.lit(date).cast("date"))
    some = F.col("sessions") > 0
    return rows.select(
        "project_id", "date", "pageviews", "visitors", "sessions",
        F.when(some, F.round(F.col("bounces") / F.col("sessions") * 100)).otherwise(0.0).alias("bounce_rate"),
        F.when(some, F.expr("total_duration_ms div sessions")).otherwise(0).alias("avg_duration_ms"),
    )


FREQUENCY_DAYS = {"daily": 1, "weekly": 7, "monthly": 30}


def due_configs(configs: DataFrame, now: str) -> DataFrame:
    """Active report settings whose last sending is a whole period ago."""
    days = F.create_map(*[F.lit(x) for pair in FREQUENCY_DAYS.items() for x in pair])
    period = F.make_dt_interval(days=F.try_element_at(days, F.col("frequency")))
    waited = F.col("last_sent_at").isNull() | (F.col("last_sent_at") + period <= instant(now))
    return configs.filter(F.col("is_active") & waited)


def report_payload(
    pageviews: DataFrame, sessions: DataFrame, events: DataFrame, daily: DataFrame, daily_events: DataFrame, daily_pages: DataFrame,
    daily_referrers: DataFrame, span: Span,
) -> DataFrame:
    """``section, name, value`` rows of one report: totals, top 5 pages and referrers."""
    stats = with_row(reports.period_stats(pageviews, sessions, daily, span), reports.events_count(events, daily_events, span))
    totals = stats.select(
        F.explode(
            F.array(*[F.struct(F.lit("totals").alias("section"), F.lit(n).alias("name"), F.col(n).cast("long").alias("value"))
                      for n in ("pageviews", "visitors", "sessions", "bounces", "total_duration_ms", "events")])
        ).alias("r")
    ).select("r.*")
    pages = reports.top_pages(pageviews, daily_pages, span, 5).select(F.lit("pages").alias("section"), F.col("path").alias("name"), F.col("views").alias("value"))
    sites = reports.top_referrers(pageviews, daily_referrers, span, 5).select(
        F.lit("referrers").alias("section"), F.col("referrer_domain").alias("name"), F.col("visits").alias("value")
    )
    return totals.unionByName(pages).unionByName(sites)
