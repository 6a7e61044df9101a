"""Daily rollups of the raw facts, one frame per rollup table.

Each builder groups by project and date, so a run may cover one day, the days a
micro-batch touched, or all history; `write_days` replaces exactly the dates it
is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KEYS = ["project_id", "date"]


def _dated(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("date", F.to_date(ts))


def rounded(c: Column) -> Column:
    """A mean as a whole number, halves to even."""
    return F.rint(F.coalesce(c, F.lit(0.0))).cast("int")


def daily_stats(pageviews: DataFrame, sessions: DataFrame) -> DataFrame:
    views = _dated(pageviews, "created_at").groupBy(*KEYS).agg(
        F.count("*").alias("pageviews"),
        F.count_distinct("visitor_id").alias("visitors"),
        F.count_distinct("session_id").alias("sessions"),
    )
    visits = _dated(sessions, "first_at").groupBy(*KEYS).agg(
        F.count_if("is_bounce").alias("bounces"), F.sum("duration_ms").alias("total_duration_ms")
    )
    return views.join(visits, KEYS, "left").fillna(0, ["bounces", "total_duration_ms"])


def daily_sketches(pageviews: DataFrame, k: int = 14) -> DataFrame:
    """Per project and day a sketch of its visitors, 2 ** k bytes at most, which merges over days and projects."""
    sketch = F.hll_sketch_agg("visitor_id", F.lit(k)).alias("visitor_sketch")
    return _dated(pageviews, "created_at").groupBy(*KEYS).agg(sketch).withColumn("sketch_k", F.lit(k))


def daily_pages(pageviews: DataFrame) -> DataFrame:
    return _dated(pageviews, "created_at").groupBy(*KEYS, "path").agg(
        F.count("*").alias("views"),
        F.count_distinct("visitor_id").alias("unique_views"),
        rounded(F.avg("duration_ms")).alias("avg_duration_ms"),
    )


def daily_referrers(pageviews: DataFrame) -> DataFrame:
    domain = F.coalesce("referrer_domain", F.lit("Direct")).alias("referrer_domain")
    return _dated(pageviews, "created_at").groupBy(*KEYS, domain).agg(F.count_distinct("session_id").alias("visits"))


def daily_events(events: DataFrame) -> DataFrame:
    return _dated(events, "created_at").groupBy(*KEYS, "event_name").agg(F.count("*").alias("count"))


def daily_geo(sessions: DataFrame) -> DataFrame:
    country = F.coalesce("country", F.lit("XX")).alias("country")
    return _dated(sessions, "first_at").groupBy(*KEYS, country).agg(F.count_distinct("visitor_id").alias("visitors"))


def daily_devices(sessions: DataFrame) -> DataFrame:
    return _dated(sessions, "first_at").groupBy(*KEYS, *device_keys()).agg(
        F.count_distinct("visitor_id").alias("visitors")
    )


def device_keys() -> list[Column]:
    return [
        F.coalesce("browser", F.lit("Unknown")).alias("browser"),
        F.coalesce("os", F.lit("Unknown")).alias("os"),
        F.coalesce("device_type", F.lit("desktop")).alias("device"),
    ]


UTM = ["utm_source", "utm_medium", "utm_campaign"]


def daily_campaigns(pageviews: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per campaign and day; ``bounces`` counts by source alone, ``bounces_exact`` by campaign."""
    views = _dated(pageviews, "created_at").filter(F.col("utm_source").isNotNull())
    views = views.select(
        *KEYS, "visitor_id", "session_id", *[F.coalesce(u, F.lit("")).alias(u) for u in UTM]
    )
    groups = views.groupBy(*KEYS, *UTM).agg(
        F.count_distinct("visitor_id").alias("visitors"),
        F.count_distinct("session_id").alias("sessions"),
        F.count("*").alias("pageviews"),
    )
    bounced = _dated(sessions, "first_at").filter("is_bounce").select(*KEYS, "session_id")
    by_source = bounces_of(views, bounced, [*KEYS, "utm_source"], "bounces")
    by_campaign = bounces_of(views, bounced, [*KEYS, *UTM], "bounces_exact")
    out = groups.join(by_source, [*KEYS, "utm_source"], "left").join(by_campaign, [*KEYS, *UTM], "left")
    return out.fillna(0, ["bounces", "bounces_exact"])


def bounces_of(views: DataFrame, bounced: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Bounced sessions per key, each session once per key."""
    pairs = views.select(*keys, "session_id").distinct()
    on = [k for k in KEYS if k in bounced.columns and k in keys] + ["session_id"]
    return pairs.join(bounced, on).groupBy(*keys).agg(F.count("*").alias(name))


def write_days(rollup: DataFrame, path: str) -> None:
    """Replace the files of every date in the frame and leave other dates alone."""
    rollup.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def touched_days(batch: DataFrame, ts: str = "created_at") -> DataFrame:
    return batch.select(F.to_date(ts).alias("date")).distinct()


def reroll(facts: DataFrame, days: DataFrame, build, ts: str = "created_at") -> DataFrame:
    """Rebuild a rollup for the touched dates only, late rows included."""
    kept = facts.join(days, F.to_date(facts[ts]) == days["date"], "left_semi")
    return build(kept)
