"""Web vitals, script errors, logs and clicks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions.hashing import error_fingerprint
from clickloom.operators.reports import Span
from clickloom.operators.trends import page
from clickloom.plans.ordered import MAX_ROWS, Following, Timeline
from clickloom.plans.quantile import percentiles
from clickloom.plans.small import broadcast_if_small

# Vital names, rating thresholds (good up to, poor beyond), log levels.
VITALS = ["LCP", "FID", "INP", "CLS", "FCP", "TTFB"]
THRESHOLDS = {"LCP": (2500, 4000), "CLS": (0.1, 0.25), "INP": (200, 500), "TTFB": (800, 1800)}
LEVELS = ["trace", "debug", "info", "warn", "error", "fatal", "critical"]


def vital_rating(metric: Column, value: Column) -> Column:
    out = F
    for name, (good, poor) in THRESHOLDS.items():
        rated = F.when(value <= good, "good").when(value <= poor, "needs-improvement").otherwise("poor")
        out = out.when(metric == name, rated)
    return out


def vitals_summary(vitals: DataFrame, span: Span) -> DataFrame:
    """Percentiles and ratings of each of the six vitals, absent ones as zeros."""
    rows = span.raw(vitals).filter(F.col("metric_name").isin(VITALS))
    ranks = percentiles(rows, ["metric_name"], "metric_value", {"p50": 0.5, "p75": 0.75, "p99": 0.99})
    ratings = rows.groupBy("metric_name").agg(
        F.count_if(F.col("rating") == "good").alias("good"),
        F.count_if(F.col("rating") == "needs-improvement").alias("needs_improvement"),
        F.count_if(F.col("rating") == "poor").alias("poor"),
    )
    names = vitals.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in VITALS])).alias("metric_name"))
    out = names.join(ranks, "metric_name", "left").join(ratings, "metric_name", "left")
    out = out.fillna(0.0, ["p50", "p75", "p99"]).fillna(0, ["good", "needs_improvement", "poor"])
    return out.withColumn("total", F.col("good") + F.col("needs_improvement") + F.col("poor"))


def vitals_by_page(vitals: DataFrame, span: Span, limit: int | None = 50) -> DataFrame:
    """A 75th percentile per vital and page, with the number of samples."""
    rows = span.raw(vitals)
    ranks = percentiles(rows.filter(F.col("metric_name").isin(VITALS)), ["path", "metric_name"], "metric_value", {"p75": 0.75})
    wide = ranks.groupBy("path").agg(
        *[F.max(F.when(F.col("metric_name") == v, F.col("p75"))).alias(f"{v.lower()}_p75") for v in VITALS]
    )
    out = rows.groupBy("path").agg(F.count("*").alias("samples")).join(wide, "path", "left")
    return page(out, [F.desc("samples"), F.col("path")], limit)


def vitals_timeseries(vitals: DataFrame, span: Span, metric: str) -> DataFrame:
    rows = span.raw(vitals).filter(F.col("metric_name") == metric).withColumn("date", F.to_date("created_at"))
    return percentiles(rows, ["date"], "metric_value", {"p75": 0.75})


# Script errors.


def with_fingerprint(errors: DataFrame) -> DataFrame:
    print_ = error_fingerprint(F.col("message"), F.col("filename"), F.col("lineno"), F.col("stack"))
    return errors.withColumn("fingerprint", print_)


def error_groups(errors: DataFrame, source_maps: DataFrame, span: Span, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Errors by fingerprint, release and environment with their latest occurrence."""
    latest = F.struct("created_at", "event_id")
    groups = span.raw(errors).groupBy(F.coalesce("fingerprint", "message").alias("fingerprint"), "release", "environment").agg(
        F.count("*").alias("count"), F.count_distinct("visitor_id").alias("affected_visitors"),
        F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
        *[F.max_by(c, latest).alias(f"last_{c}") for c in ("message", "path", "browser")],
    )
    mapped = source_maps.select("release", F.col("environment").alias("_env")).distinct().withColumn("_mapped", F.lit(True))
    env = F.coalesce(F.col("environment"), F.lit("production"))
    out = groups.join(broadcast_if_small(mapped), (groups["release"] == mapped["release"]) & (env == F.col("_env")), "left").drop(mapped["release"])
    out = out.withColumn("source_map_configured", F.coalesce("_mapped", F.lit(False))).drop("_env", "_mapped")
    return page(out, [F.desc("count"), F.col("fingerprint"), F.col("release"), F.col("environment")], limit, offset)


def match_source_maps(errors: DataFrame, source_maps: DataFrame) -> DataFrame:
    """Each error with the newest map whose URL ends its file name.

    A distinct file name meets the maps by equality, with its endings of those
    lengths only that the maps of its release and environment have.
    """
    maps = source_maps.groupBy("release", "environment", "minified_url").agg(
        F.max(F.struct("created_at", "map_id")).alias("_map")
    )
    env = F.coalesce("environment", F.lit("production"))
    files = errors.filter(F.col("filename").isNotNull()).select("release", env.alias("environment"), "filename").distinct()
    lengths = maps.groupBy("release", "environment").agg(F.collect_set(F.length("minified_url")).alias("_lengths"))
    each = files.join(lengths, ["release", "environment"]).withColumn("_n", F.explode("_lengths")).filter(F.col("_n").between(1, F.length("filename")))
    ended = each.select("release", "environment", "filename", F.right("filename", F.col("_n")).alias("minified_url"))
    best = ended.join(maps, ["release", "environment", "minified_url"])
    best = best.groupBy("release", "environment", "filename").agg(F.max("_map").alias("_map"))
    side = best.select(F.col("release").alias("_r"), F.col("environment").alias("_e"), F.col("filename").alias("_f"), F.col("_map.map_id").alias("source_map_id"))
    on = (F.col("release") == F.col("_r")) & (env == F.col("_e")) & (F.col("filename") == F.col("_f"))
    return errors.join(side, on, "left").drop("_r", "_e", "_f")


def error_timeseries(errors: DataFrame, span: Span) -> DataFrame:
    return span.raw(errors).groupBy(F.to_date("created_at").alias("date")).agg(F.count("*").alias("count"))


def error_stats(errors: DataFrame, span: Span) -> DataFrame:
    return span.raw(errors).agg(
        F.count("*").alias("total_errors"), F.count_distinct(F.coalesce("fingerprint", "message")).alias("unique_errors"),
        F.count_distinct("visitor_id").alias("affected_visitors"),
    )


def errors_by_release(errors: DataFrame, span: Span, limit: int | None = 10) -> DataFrame:
    out = span.raw(errors).groupBy(F.coalesce("release", F.lit("unknown")).alias("release")).agg(F.count("*").alias("count"))
    return page(out, [F.desc("count"), F.col("release")], limit)


# Logs.


def log_level(raw: Column) -> Column:
    """The lower-case level, ``warning`` as ``warn``; NULL when it is none of the seven."""
    low = F.lower(F.trim(raw))
    low = F.when(low == "warning", "warn").otherwise(low)
    return F.when(low.isin(LEVELS), low)


def search_logs(
    logs: DataFrame, span: Span, level: str | None = None, release: str | None = None, environment: str | None = None,
    search: str | None = None, limit: int | None = 100, offset: int = 0,
) -> DataFrame:
    """Newest matching lines; ``%`` and ``_`` in the search text are wildcards."""
    out = span.raw(logs)
    for column, value in (("level", level), ("release", release), ("environment", environment)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if search:
        out = out.filter(F.col("message").ilike(f"%{search}%"))
    return page(out, [F.desc("created_at"), F.desc("event_id")], limit, offset)


def log_stats(logs: DataFrame, span: Span, releases: int = 10) -> DataFrame:
    """Total, per level and per top release as ``kind, name, count`` in one pass."""
    rows = span.raw(logs).select("level", F.coalesce("release", F.lit("unknown")).alias("release"))
    sums = rows.groupingSets([[], ["level"], ["release"]], "level", "release").agg(
        F.count("*").alias("count"), F.grouping_id("level", "release").alias("_g")
    )
    kind = F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "level").otherwise("release")
    out = sums.select(kind.alias("kind"), F.coalesce(F.when(F.col("_g") == 1, F.col("level")), F.when(F.col("_g") == 2, F.col("release"))).alias("name"), "count")
    top = out.filter("kind = 'release'").orderBy(F.desc("count"), "name").limit(releases)
    return out.filter("kind <> 'release'").unionByName(top)


# Clicks.


def click_heatmap(clicks: DataFrame, span: Span, path: str) -> DataFrame:
    """Clicks on whole-number coordinates, halves rounded to even."""
    rows = span.raw(clicks).filter(F.col("path") == path)
    return rows.groupBy(F.rint("x").alias("x"), F.rint("y").alias("y")).agg(
        F.count("*").alias("count"), F.min("selector").alias("selector")
    )


def click_stats(clicks: DataFrame, span: Span, limit: int | None = 50) -> DataFrame:
    out = span.raw(clicks).groupBy("path").agg(F.count("*").alias("total_clicks"), F.count_distinct("visitor_id").alias("unique_visitors"))
    return page(out, [F.desc("total_clicks"), F.col("path")], limit)


SPOT = ["path", "selector", "visitor_id", "session_id"]


def rage_clicks(clicks: DataFrame, span: Span, seconds: int = 5, least: int = 3, limit: int | None = None) -> DataFrame:
    """Repeated clicks on one spot inside a fixed time bucket."""
    slot = F.floor(F.unix_micros("created_at") / F.lit(seconds * 1_000_000))
    found = span.raw(clicks).groupBy(*SPOT, slot.alias("_slot")).agg(
        F.count("*").alias("occurrences"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen")
    ).filter(F.col("occurrences") >= least)
    out = found.withColumn("severity", F.when(F.col("occurrences") >= 2 * least, "high").otherwise("medium")).drop("_slot")
    return page(out, [F.desc("occurrences"), F.desc("last_seen")], limit)


def sliding_rage_clicks(clicks: DataFrame, span: Span, seconds: int = 5, least: int = 3, max_rows: int = MAX_ROWS) -> DataFrame:
    """Clicks that start a run of ``least`` clicks within any ``seconds``."""
    line = Timeline(span.raw(clicks), SPOT, "created_at", ["event_id"], max_rows)
    ahead = max(2, least - 1)
    found = line.with_columns({"_later": Following(F.unix_micros("created_at"), n=ahead)}).result()
    nth = F.get("_later", F.lit(least - 2))
    return found.filter(nth - F.unix_micros("created_at") <= seconds * 1_000_000).drop("_later")


def label_hits(clicks: DataFrame, labels: DataFrame) -> DataFrame:
    """Clicks of each active label: same selector and a path the pattern covers."""
    active = labels.filter(F.col("status") == "active")
    fits = (F.col("path_pattern") == "*") | (F.col("path") == F.col("path_pattern")) | F.expr(
        "path LIKE replace(path_pattern, '*', '%')"
    )
    return clicks.join(broadcast_if_small(active.select("label_id", "selector", "path_pattern")), "selector").filter(fits)


def label_stats(clicks: DataFrame, labels: DataFrame, span: Span) -> DataFrame:
    """Counts of every active label, unused ones included."""
    counts = label_hits(span.raw(clicks), labels).groupBy("label_id").agg(
        F.count("*").alias("count"), F.count_distinct("visitor_id").alias("unique_visitors"),
        F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
    )
    active = labels.filter(F.col("status") == "active").select("label_id", "name")
    return active.join(counts, "label_id", "left").fillna(0, ["count", "unique_visitors"])
