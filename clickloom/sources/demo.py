"""The analytics model laid over the supplied star-schema test tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clickloom.session import configure
from clickloom.sources.event_stream import PAGEVIEW, event_stream
from clickloom.sources.sessions import assign_sessions, summarise_sessions

NOW = "2024-01-31 00:00:00"
TODAY = "2024-01-30"
GAP = 24 * 3600


def pick(values: list, index: Column) -> Column:
    """The entry of a short literal list at a computed position."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


class Demo:
    """Lazily built model frames; nothing is read before an operator needs it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def ev(self) -> DataFrame:
        """All events without sessions."""
        k = F.get_json_object("props", "$.k").cast("int")
        return self.table("events").select(
            "event_id",
            F.when(F.col("event_type") == "view", PAGEVIEW).otherwise(F.col("event_type")).alias("event"),
            F.col("user_id").cast("string").alias("visitor_id"),
            F.col("user_id").alias("uid"),
            F.concat(F.lit("p"), (F.col("user_id") % 2).cast("string")).alias("project_id"),
            F.col("ts").cast("timestamp").alias("created_at"),
            k.alias("k"),
            F.concat(F.lit("/p"), (k % 10).cast("string")).alias("path"),
            F.col("value"),
            F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(12,2)")).alias("revenue_amount"),
            F.col("props"),
        )

    @cached_property
    def evs(self) -> DataFrame:
        """All events with their session."""
        return assign_sessions(self.ev, GAP).withColumn(
            "session_id", F.concat_ws("-", "visitor_id", F.col("session_no").cast("string"))
        )

    def _pageviews(self, base: DataFrame) -> DataFrame:
        k = F.col("k")
        return base.filter(F.col("event") == PAGEVIEW).select(
            "event_id", "project_id", "visitor_id", "uid", "session_id", "created_at", "path", "k", "value",
            pick([None, "Home", "Docs"], k).alias("title"),
            (k * 137).cast("long").alias("duration_ms"),
            *self.touch_columns(),
            F.col("props").alias("properties"),
        )

    @staticmethod
    def touch_columns() -> list[Column]:
        k = F.col("k")
        source = pick(["google", "newsletter", "facebook", None], k)
        return [
            source.alias("utm_source"),
            pick(["cpc", "email", "social", None], k).alias("utm_medium"),
            F.when(source.isNotNull(), F.concat(F.lit("c"), (k % 3).cast("string"))).alias("utm_campaign"),
            pick(
                [
                    "https://www.google.com/search", "https://chatgpt.com/", "https://t.co/ab",
                    "https://news.example.org/x", None,
                ],
                k,
            ).alias("referrer"),
            pick(["www.google.com", "chatgpt.com", "t.co", "news.example.org", None], k).alias("referrer_domain"),
        ]

    def _events(self, base: DataFrame) -> DataFrame:
        return base.filter(F.col("event") != PAGEVIEW).select(
            "event_id", "project_id", "visitor_id", "uid", "session_id", "created_at", "path", "k", "value",
            F.col("event").alias("event_name"),
            F.col("props").alias("event_data"),
            "revenue_amount",
            F.when(F.col("revenue_amount").isNotNull(), pick(["USD", "EUR"], F.col("k"))).alias("revenue_currency"),
        )

    @cached_property
    def pageviews(self) -> DataFrame:
        return self._pageviews(self.evs)

    @cached_property
    def events(self) -> DataFrame:
        return self._events(self.evs)

    @cached_property
    def flat_pageviews(self) -> DataFrame:
        """Page views for operators that need no session."""
        return self._pageviews(self.ev.withColumn("session_id", F.lit(None).cast("string")))

    @cached_property
    def flat_events(self) -> DataFrame:
        return self._events(self.ev.withColumn("session_id", F.lit(None).cast("string")))

    def stream(self, start=None, end=None, names=None, sessions: bool = False) -> DataFrame:
        pv, ev = (self.pageviews, self.events) if sessions else (self.flat_pageviews, self.flat_events)
        return event_stream(pv, ev, start, end, names)

    @cached_property
    def sessions(self) -> DataFrame:
        """Sessions with device and place of the visitor."""
        base = summarise_sessions(self.evs, ["uid", "project_id"])
        uid = F.col("uid")
        places = self.table("customer").join(
            F.broadcast(self.table("nation")), F.col("c_nationkey") == F.col("n_nationkey")
        ).select(F.col("c_custkey").alias("uid"), F.col("n_name").alias("country"))
        return base.withColumns(
            {
                "browser": pick(["Chrome", "Firefox", "Safari"], uid),
                "os": pick(["Windows", "macOS", "Linux", "iOS"], uid),
                "device_type": pick(["desktop", "mobile"], uid),
            }
        ).join(places, "uid", "left")

    @cached_property
    def profiles(self) -> DataFrame:
        """One person per customer; the balance trait is whole-numbered text."""
        return self.table("customer").select(
            F.col("c_custkey").cast("string").alias("visitor_id"),
            F.col("c_custkey").alias("uid"),
            F.col("c_name").alias("user_id"),
            F.create_map(
                F.lit("plan"), F.col("c_mktsegment"), F.lit("balance"), F.floor("c_acctbal").cast("string"),
                F.lit("since"), F.when(F.col("c_custkey") % 3 == 0, "n/a").otherwise(
                    F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")), "yyyy-MM-dd")
                ),
            ).alias("traits"),
            F.col("c_nationkey"),
            (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=(F.col("c_custkey") % 28).cast("int"))).alias("first_seen_at"),
        )

    @cached_property
    def groups(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.lit(0).alias("type_index"),
            F.col("n_name").alias("group_key"),
            F.create_map(F.lit("region"), F.col("r_name"), F.lit("size"), F.col("n_nationkey").cast("string")).alias("properties"),
        )

    @cached_property
    def grouped_ev(self) -> DataFrame:
        """The event stream with the visitor's nation stamped as group 0."""
        nations = self.table("customer").join(
            F.broadcast(self.table("nation")), F.col("c_nationkey") == F.col("n_nationkey")
        ).select(F.col("c_custkey").cast("string").alias("visitor_id"), "n_name")
        stamped = self.stream().join(nations, "visitor_id", "left")
        extra = F.when(F.col("n_name").isNotNull(), F.create_map(F.lit("$group_0"), F.col("n_name")))
        return stamped.withColumn(
            "properties", F.map_concat("properties", F.coalesce(extra, F.create_map().cast("map<string,string>")))
        ).drop("n_name")

    # Domain tables carved out of the same events.

    @cached_property
    def js_errors(self) -> DataFrame:
        k = F.col("k")
        return self.evs.filter("event = 'error'").select(
            "event_id", "visitor_id", "session_id", "created_at", "path",
            F.concat(F.lit("err "), (k % 7).cast("string")).alias("message"),
            F.concat(F.lit("https://cdn.example.org/js/f"), (k % 4).cast("string"), F.lit(".js")).alias("filename"),
            (k % 11).cast("int").alias("lineno"),
            F.when(k % 5 != 0, F.concat(F.lit("\n  at f"), (k % 6).cast("string"), F.lit("()\n at main"))).alias("stack"),
            F.concat(F.lit("r"), (k % 3).cast("string")).alias("release"),
            pick(["prod", "stage"], F.floor(k / 3)).alias("environment"),
            pick(["Chrome", "Firefox", "Safari"], F.col("uid")).alias("browser"),
        )

    @cached_property
    def clicks(self) -> DataFrame:
        return self.evs.filter("event = 'click'").select(
            "event_id", "visitor_id", "session_id", "created_at", "path", "k",
            F.col("value").alias("x"), F.col("k").cast("double").alias("y"),
            pick(["#buy", ".nav a", None, "button.go", "#help"], F.col("k")).alias("selector"),
        )

    @cached_property
    def vitals(self) -> DataFrame:
        return self.evs.filter("event = '$pageview'").select(
            "visitor_id", "created_at", "path",
            pick(["LCP", "CLS", "INP", "TTFB", "FCP", "FID"], F.col("k")).alias("metric_name"),
            F.col("value").alias("metric_value"),
            F.when(F.col("value") < 20, "good").when(F.col("value") < 60, "needs-improvement").otherwise("poor").alias("rating"),
        )

    @cached_property
    def logs(self) -> DataFrame:
        k = F.col("k")
        return self.ev.filter("event in ('error', 'signup')").select(
            "event_id", "visitor_id", "created_at",
            pick(["Warning", "error", "INFO ", "debug", "notice"], k).alias("raw_level"),
            F.concat(F.lit("msg_"), (k % 9).cast("string"), F.lit(" done")).alias("message"),
            F.concat(F.lit("r"), (k % 3).cast("string")).alias("release"),
            pick(["prod", "stage"], k).alias("environment"),
        )

    @cached_property
    def responses(self) -> DataFrame:
        """One survey response per user turn: a score, and the whole text as a comment."""
        k = F.col("conv_id")
        comment = F.concat(pick(["love the ", "slow and confusing ", "", "great "], k), F.coalesce("text", F.lit("none given")))
        answers = F.array(
            F.struct(F.lit("nps").alias("question"), ((k + F.col("turn")) % 11).cast("string").alias("answer")),
            F.struct(F.lit("comment").alias("question"), comment.alias("answer")),
        )
        return self.table("conversations").filter("role = 'user'").select(
            F.concat_ws(":", k.cast("string"), F.col("turn").cast("string")).alias("response_id"),
            F.concat(F.lit("s"), (k % 2).cast("string")).alias("survey_id"),
            (k % 1000).cast("string").alias("visitor_id"),
            (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(k % 700).cast("int"), mins=F.col("turn").cast("int"))).alias("created_at"),
            (k % 4 != 0).alias("completed"),
            F.to_json(answers).alias("answers"),
        )

    @cached_property
    def generations(self) -> DataFrame:
        k = F.col("conv_id")
        return self.table("conversations").filter("role = 'assistant'").select(
            F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("generation_id"),
            F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("trace_key"),
            pick(["small", "medium", "large"], k).alias("model"),
            F.length("text").alias("input_tokens"),
            F.floor(F.length("text") / 4).cast("long").alias("output_tokens"),
            (F.length("text") % 1000).cast("long").alias("latency_ms"),
            (F.length("text") / 1000).alias("cost"),
            pick(["ok", "ok", "ok", "error"], F.col("turn") + k).alias("status"),
            (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(k % 700).cast("int"))).alias("created_at"),
            F.col("conv_id"), F.col("turn"),
        )

    @cached_property
    def conversions(self) -> DataFrame:
        """One purchase-goal conversion per session."""
        return self.events.filter("event_name = 'purchase'").groupBy("session_id").agg(
            F.min_by(F.struct("visitor_id", "created_at", "revenue_amount", "event_id"), F.struct("created_at", "event_id")).alias("c")
        ).select("session_id", "c.*")

    @cached_property
    def exposures(self) -> DataFrame:
        """First click per visitor, variant by parity."""
        return self.ev.filter("event = 'click'").groupBy("visitor_id").agg(
            F.min("created_at").alias("first_exposed_at"), F.first("uid").alias("uid")
        ).select("visitor_id", "first_exposed_at", pick(["control", "b"], F.col("uid")).alias("variant"))
