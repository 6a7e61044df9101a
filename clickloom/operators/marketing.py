"""Campaigns, channels, revenue attribution, commerce and imported spend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.functions.channels import ai_provider, channel
from clickloom.functions.props import any_of
from clickloom.functions.calendar import instant
from clickloom.functions.stats import percent, ratio
from clickloom.functions.targeting import json_path
from clickloom.operators.reports import Span, raw_floor
from clickloom.operators.rollups import UTM, bounces_of
from clickloom.operators.trends import page
from clickloom.plans.ordered import MAX_ROWS, Previous, Running, Timeline

TOUCH = [*UTM, "referrer_domain"]


def campaign_key() -> list[Column]:
    """Source, medium and campaign with NULL as empty text."""
    return [F.coalesce(u, F.lit("")).alias(u) for u in UTM]


def campaign_stats(
    pageviews: DataFrame, sessions: DataFrame, daily: DataFrame, span: Span, keys: list[str] | None = None,
    limit: int | None = 100, offset: int = 0,
) -> DataFrame:
    """Exact visitors, sessions, views and bounce rate per key.

    The key is the whole campaign, or one of its columns for the source and
    medium reports.
    """
    keys = keys or UTM
    tagged = pageviews.filter(any_of(F.col(k).isNotNull() for k in keys)).select(
        *campaign_key(), "visitor_id", "session_id", "created_at"
    )
    fresh = span.fresh(tagged)
    bounced = span.fresh(sessions, "first_at").filter("is_bounce").select("session_id")
    today = fresh.groupBy(*keys).agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("pageviews"))
    today = today.join(bounces_of(fresh, bounced, keys, "bounces"), keys, "left").fillna(0, ["bounces"])
    past = span.days(daily).select(*keys, "sessions", "pageviews", "bounces")
    sums = past.unionByName(today.select(*keys, "sessions", "pageviews", "bounces")).groupBy(*keys).agg(
        *[F.sum(n).alias(n) for n in ("sessions", "pageviews", "bounces")]
    )
    if len(keys) == 1:
        sums = sums.filter(F.col(keys[0]) != "")
    out = sums.join(_campaign_uniques(tagged, daily, span, keys), keys, "left").select(
        *keys, F.coalesce("visitors", F.lit(0)).alias("visitors"), "sessions", "pageviews", "bounces",
        percent(F.col("bounces"), F.col("sessions")).alias("bounce_rate"),
    )
    return page(out, [F.desc("pageviews"), *[F.col(k) for k in keys]], limit, offset)


def _campaign_uniques(tagged: DataFrame, daily: DataFrame, span: Span, keys: list[str]) -> DataFrame:
    raw = span.raw(tagged).groupBy(*keys).agg(F.count_distinct("visitor_id").alias("visitors"))
    floor = raw_floor(tagged).select(F.to_date("floor")).scalar()
    old = span.days(daily).filter(F.col("date") < floor)
    old = old.groupBy(*keys).agg(F.sum("visitors").alias("visitors"))
    return raw.unionByName(old).groupBy(*keys).agg(F.sum("visitors").alias("visitors"))


def campaign_timeseries(pageviews: DataFrame, daily: DataFrame, span: Span, source: str) -> DataFrame:
    mine = F.col("utm_source") == source
    names = ["pageviews", "visitors", "sessions"]
    past = span.days(daily).filter(mine).groupBy("date").agg(*[F.sum(n).alias(n) for n in names])
    today = span.fresh(pageviews).filter(mine).groupBy(F.to_date("created_at").alias("date")).agg(
        F.count("*").alias("pageviews"), F.count_distinct("visitor_id").alias("visitors"),
        F.count_distinct("session_id").alias("sessions"),
    )
    return past.unionByName(today)


def _blank_to_null(name: str) -> Column:
    return F.nullif(F.col(name), F.lit("")).alias(name)


def channel_groups(pageviews: DataFrame, span: Span, exact_hosts: bool = False) -> DataFrame:
    """Views per channel; summed visitors and sessions over finer groups, and exact ones."""
    fields = ["utm_source", "utm_medium", "referrer_domain"]
    named = channel(*[F.col(f) for f in fields], exact_hosts=exact_hosts)
    fine = span.raw(pageviews).select("visitor_id", "session_id", *[_blank_to_null(f) for f in fields]).groupBy(*fields).agg(
        F.count_distinct("visitor_id").alias("v"), F.count_distinct("session_id").alias("s"), F.count("*").alias("n")
    )
    summed = fine.groupBy(named.alias("channel")).agg(
        F.sum("v").alias("visitors_summed"), F.sum("s").alias("sessions_summed"), F.sum("n").alias("pageviews")
    )
    exact = span.raw(pageviews).groupBy(named.alias("channel")).agg(
        F.count_distinct("visitor_id").alias("visitors"), F.count_distinct("session_id").alias("sessions")
    )
    whole = Window.partitionBy()  # at most twelve channels
    return summed.join(exact, "channel").withColumn(
        "percentage", percent(F.col("pageviews"), F.sum("pageviews").over(whole))
    )


def ai_referrers(pageviews: DataFrame, span: Span) -> DataFrame:
    provider = ai_provider(F.col("referrer_domain"))
    rows = span.raw(pageviews).filter((F.col("referrer_domain") != "") & provider.isNotNull())
    return rows.groupBy("referrer_domain", provider.alias("provider")).agg(
        F.count_distinct("visitor_id").alias("visitors"), F.count_distinct("session_id").alias("sessions"),
        F.count("*").alias("pageviews"),
    )


def _revenue(events: DataFrame, span: Span) -> DataFrame:
    return span.raw(events).filter(F.col("revenue_amount").isNotNull()).select(
        "event_id", "session_id", "created_at", F.col("revenue_amount").cast("double").alias("revenue")
    )


def _touches(pageviews: DataFrame, paid: DataFrame, span: Span) -> DataFrame:
    """Views of sessions that pay in the range; none after its end can come before a payment."""
    seen = pageviews.filter(F.col("created_at") <= instant(span.end)).join(paid.select("session_id").distinct(), "session_id", "left_semi")
    return seen.select("session_id", "created_at", "event_id", F.struct(*[_blank_to_null(t) for t in TOUCH]).alias("touch"))


def touch_per_event(events: DataFrame, pageviews: DataFrame, span: Span, model: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """Each revenue event with the first or last view of its session so far."""
    paid = _revenue(events, span)
    seen = _touches(pageviews, paid, span)
    if model == "first_touch":
        first = seen.groupBy("session_id").agg(F.min_by(F.struct("created_at", "touch"), F.struct("created_at", "event_id")).alias("f"))
        joined = paid.join(first, "session_id", "left")
        return joined.withColumn("touch", F.when(F.col("f.created_at") <= F.col("created_at"), F.col("f.touch"))).drop("f")
    rows = seen.select("*", F.lit(0).alias("kind")).unionByName(
        paid.select("*", F.lit(1).alias("kind")), allowMissingColumns=True
    )
    line = Timeline(rows, ["session_id"], "created_at", ["kind", "event_id"], max_rows)
    found = line.with_columns({"last": Previous(F.col("touch"), F.col("kind") == 0)}).result()
    return found.filter("kind = 1").select("event_id", "session_id", "created_at", "revenue", F.col("last").alias("touch"))


def linear_credit(events: DataFrame, pageviews: DataFrame, span: Span, max_rows: int = MAX_ROWS) -> DataFrame:
    """``touch, conversions, revenue``: every event shared by its session's earlier touches.

    A touch earns what all later events of the session pay per touch: the
    session total minus the running total at the touch. No pair of event and
    touch is ever formed.
    """
    paid = _revenue(events, span)
    firsts = _touches(pageviews, paid, span).groupBy("session_id", "touch").agg(
        F.min(F.struct("created_at", "event_id")).alias("at")
    ).select("session_id", "touch", "at.*", F.lit(0).alias("kind"))
    rows = firsts.unionByName(paid.select("*", F.lit(1).alias("kind")), allowMissingColumns=True)
    line = Timeline(rows, ["session_id"], "created_at", ["kind", "event_id"], max_rows)
    line = line.with_columns({"n": Running(1 - F.col("kind"))})
    # Shares are zero on touch rows and on events without a touch.
    shared = (F.col("kind") == 1) & (F.col("n") > 0)
    line.df = line.df.withColumn("unit", F.when(shared, 1 / F.col("n")).otherwise(0.0)).withColumn(
        "money", F.when(shared, F.col("revenue") / F.col("n")).otherwise(0.0)
    )
    done = line.with_columns({"units": Running(F.col("unit")), "moneys": Running(F.col("money"))}).result()
    totals = done.groupBy("session_id").agg(F.sum("unit").alias("all_units"), F.sum("money").alias("all_money"))
    earned = done.filter("kind = 0").join(totals, "session_id").filter("all_units > 0").groupBy("touch").agg(
        F.sum(F.col("all_units") - F.col("units")).alias("conversions"), F.sum(F.col("all_money") - F.col("moneys")).alias("revenue")
    )
    bare = done.filter("kind = 1 and n = 0").groupBy(F.lit(None).cast(done.schema["touch"].dataType).alias("touch")).agg(
        F.count("*").cast("double").alias("conversions"), F.sum("revenue").alias("revenue")
    )
    return earned.unionByName(bare)


def attribution(events: DataFrame, pageviews: DataFrame, span: Span, model: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """Conversions and revenue by channel, source and campaign."""
    if model == "linear":
        credit = linear_credit(events, pageviews, span, max_rows)
    elif model in ("first_touch", "last_touch"):
        credit = touch_per_event(events, pageviews, span, model, max_rows).groupBy("touch").agg(
            F.count("*").cast("double").alias("conversions"), F.sum("revenue").alias("revenue")
        )
    else:
        raise ValueError(f"unknown attribution model {model!r}")
    t = F.col("touch")
    named = channel(t["utm_source"], t["utm_medium"], t["referrer_domain"])
    return credit.groupBy(named.alias("channel"), t["utm_source"].alias("source"), t["utm_campaign"].alias("campaign")).agg(
        F.sum("conversions").alias("conversions"), F.sum("revenue").alias("revenue")
    ).filter("conversions > 1e-9").withColumn("model", F.lit(model))


# Commerce.


def revenue_totals(events: DataFrame, span: Span) -> DataFrame:
    paid = span.raw(events).filter(F.col("revenue_amount").isNotNull())
    out = paid.agg(F.count("*").alias("orders"), F.coalesce(F.sum("revenue_amount"), F.lit(0)).cast("double").alias("revenue"))
    return out.withColumn("average_order_value", ratio(F.col("revenue"), F.col("orders")))


def revenue_by_currency(events: DataFrame, span: Span) -> DataFrame:
    paid = span.raw(events).filter(F.col("revenue_amount").isNotNull())
    return paid.groupBy(F.coalesce("revenue_currency", F.lit("USD")).alias("currency")).agg(
        F.count("*").alias("orders"), F.sum("revenue_amount").cast("double").alias("revenue")
    )


def top_products(events: DataFrame, span: Span, limit: int | None = 25) -> DataFrame:
    paid = span.raw(events).filter(F.col("revenue_amount").isNotNull())
    data = F.col("event_data")
    out = paid.groupBy(
        F.coalesce(json_path(data, "product_id"), F.lit("unknown")).alias("product_id"),
        F.coalesce(json_path(data, "product_name"), json_path(data, "name"), "event_name").alias("product_name"),
    ).agg(F.count("*").alias("orders"), F.sum("revenue_amount").cast("double").alias("revenue"))
    return page(out, [F.desc("revenue"), F.col("product_id")], limit)


# Imported marketing rows.

# Accepted provider names, the metrics that are summed.
PROVIDERS = {
    "google_analytics": "google_analytics", "ga4": "google_analytics", "google_ads": "google_ads",
    "search_console": "search_console", "google_search_console": "search_console",
}
METRICS = ["impressions", "clicks", "cost", "conversions", "revenue", "sessions", "users"]


def provider_name(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in PROVIDERS.items() for x in pair])
    return F.try_element_at(names, F.lower(F.trim(c)))


def checked_import(rows: DataFrame) -> DataFrame:
    """Rows with the provider's canonical name and a ``rejected`` reason or NULL."""
    def is_object(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_parse_json(name)).startswith("OBJECT"), F.lit(False))

    numbers = F.map_values(F.from_json("metrics", "map<string,string>"))
    bad = F.exists(numbers, lambda v: v.isNull() | ~v.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"))
    reason = (
        F.when(provider_name(F.col("provider")).isNull(), "provider")
        .when(~is_object("dimensions"), "dimensions")
        .when(~is_object("metrics"), "metrics")
        .when(~is_object("raw_row"), "raw_row")
        .when(bad, "metric_value")
    )
    return rows.withColumn("rejected", reason).withColumn("provider", provider_name(F.col("provider")))


def import_summary(rows: DataFrame, imports: DataFrame, start: str, end: str, provider: str | None = None) -> DataFrame:
    kept = rows.filter(F.col("row_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if provider:
        kept = kept.join(imports.filter(F.col("provider") == PROVIDERS[provider]).select("import_id"), "import_id")
    sums = [F.coalesce(F.sum(json_path(F.col("metrics"), m).try_cast("double")), F.lit(0.0)).alias(m) for m in METRICS]
    return kept.agg(F.count("*").alias("rows"), *sums)


def import_rows(rows: DataFrame, import_id: str, limit: int | None = 100, offset: int = 0) -> DataFrame:
    return page(rows.filter(F.col("import_id") == import_id), [F.desc("row_date"), F.col("row_id")], limit, offset)
