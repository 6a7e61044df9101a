"""Alert rules, traffic baselines, spikes and silence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.functions.calendar import instant
from clickloom.functions.stats import percent


@dataclass(frozen=True)
class Rule:
    rule_id: str
    metric: str
    operator: str
    threshold: float
    window_minutes: int = 60
    cooldown_minutes: int = 60


OPERATORS = {
    "gt": lambda v, t: v > t, "lt": lambda v, t: v < t, "gte": lambda v, t: v >= t, "lte": lambda v, t: v <= t,
    "eq": lambda v, t: F.abs(v - t) < 2.220446049250313e-16,
}


def metric_values(
    pageviews: DataFrame, sessions: DataFrame, errors: DataFrame, windows: Sequence[tuple[str, int]], now: str
) -> DataFrame:
    """``metric, window_minutes, value`` of every wanted pair, one pass per table."""
    def since(ts: str, minutes: int) -> Column:
        at = F.col(ts)
        return (at >= instant(now) - F.expr(f"INTERVAL {minutes} MINUTES")) & (at <= instant(now))

    def averaged(rows: Column) -> Column:
        return F.coalesce(F.avg(F.when(rows, F.col("duration_ms"))), F.lit(0.0)) / 1000

    tables = {
        "pageviews": (pageviews, "created_at", lambda w: F.count_if(w)),
        "visitors": (pageviews, "created_at", lambda w: F.count_distinct(F.when(w, F.col("visitor_id")))),
        "error_count": (errors, "created_at", lambda w: F.count_if(w)),
        "bounce_rate": (sessions, "first_at", lambda w: percent(F.count_if(w & F.col("is_bounce")), F.count_if(w))),
        "avg_duration": (sessions, "first_at", averaged),
    }
    parts = []
    for name in sorted({m for m, _ in windows}):
        df, ts, value = tables[name]
        spans = sorted({w for m, w in windows if m == name})
        # Only rows of the longest window are read.
        row = df.filter(since(ts, max(spans))).agg(
            F.array(*[F.struct(F.lit(w).alias("window_minutes"), value(since(ts, w)).cast("double").alias("value")) for w in spans]).alias("v")
        )
        parts.append(row.select(F.lit(name).alias("metric"), F.inline("v")))
    return reduce(DataFrame.unionByName, parts)


def evaluate_rules(values: DataFrame, rules: Sequence[Rule], now: str, last: dict[str, str] | None = None) -> DataFrame:
    """Rules with their value and whether they fire now, outside their cooldown."""
    last = last or {}
    tests = []
    for r in rules:
        mine = (F.col("metric") == r.metric) & (F.col("window_minutes") == r.window_minutes)
        cooled = F.lit(True)
        if r.rule_id in last:
            cooled = instant(now) - F.expr(f"INTERVAL {r.cooldown_minutes} MINUTES") >= instant(last[r.rule_id])
        fired = OPERATORS[r.operator](F.col("value"), F.lit(float(r.threshold))) & cooled
        tests.append(F.when(mine, F.struct(F.lit(r.rule_id).alias("rule_id"), F.col("value").alias("metric_value"), fired.alias("triggered"))))
    return values.select(F.explode(F.array_compact(F.array(*tests))).alias("r")).select("r.*")


def replay_rule(rows: DataFrame, rule: Rule, ts: str = "created_at") -> DataFrame:
    """Fire times of a count rule over history, evaluated at every window end.

    Windows are counted with partial aggregation; the cooldown then walks one
    bounded list of window ends.
    """
    window = F.window(ts, f"{rule.window_minutes} minutes")
    counts = rows.groupBy(window.alias("w")).agg(F.count("*").cast("double").alias("value"))
    hot = counts.filter(OPERATORS[rule.operator](F.col("value"), F.lit(float(rule.threshold))))
    at = F.unix_seconds(F.col("w.end"))
    wait = rule.cooldown_minutes * 60
    empty = F.array().cast("array<bigint>")

    def walk(fired: Column, t: Column) -> Column:
        return F.when((F.size(fired) == 0) | (t - F.element_at(fired, -1) >= wait), F.concat(fired, F.array(t))).otherwise(fired)

    folded = hot.agg(F.array_sort(F.collect_list(at)).alias("ts")).select(
        F.explode(F.aggregate("ts", empty, lambda acc, t: F.when(F.size(acc) == 0, F.array(t)).otherwise(walk(acc, t)))).alias("t")
    )
    return folded.select(F.lit(rule.rule_id).alias("rule_id"), F.timestamp_seconds("t").alias("triggered_at"))


def baselines(pageviews: DataFrame, now: str, days: int = 14) -> DataFrame:
    """Mean views per project, hour and weekday (Monday is 0) over two weeks."""
    rows = pageviews.filter((F.col("created_at") >= instant(now) - F.expr(f"INTERVAL {days} DAYS")) & (F.col("created_at") <= instant(now)))
    return rows.groupBy("project_id", F.hour("created_at").alias("hour"), F.weekday("created_at").alias("weekday")).agg(
        (F.count("*") / float(days)).alias("avg_pageviews")
    )


def spikes(pageviews: DataFrame, base: DataFrame, minutes: int = 10, ratio: float = 2.0) -> DataFrame:
    """Time windows whose hourly rate is a multiple of the usual rate."""
    counts = pageviews.groupBy("project_id", F.window("created_at", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n"))
    rated = counts.select(
        "project_id", F.col("w.start").alias("window_start"), F.hour("w.start").alias("hour"), F.weekday("w.start").alias("weekday"),
        (F.col("n") * (60.0 / minutes)).alias("hourly_rate"),
    )
    joined = rated.join(base.filter("avg_pageviews >= 1"), ["project_id", "hour", "weekday"])
    times = F.col("hourly_rate") / F.col("avg_pageviews")
    return joined.filter(times >= ratio).select(
        "project_id", "window_start", F.floor("hourly_rate").alias("current_rate"), F.floor("avg_pageviews").alias("baseline_rate"),
        F.round(times, 1).alias("multiplier"),
    )


def silences(pageviews: DataFrame, now: str, hours: int = 3, repeat_hours: int = 6) -> DataFrame:
    """Alert times for projects without a view, repeated while the silence lasts.

    Views are reduced to one row per project and minute before they are ordered.
    """
    minute = pageviews.filter(F.col("created_at") <= instant(now)).groupBy("project_id", F.date_trunc("minute", "created_at").alias("m")).agg(
        F.min("created_at").alias("lo"), F.max("created_at").alias("hi")
    )
    after = F.coalesce(F.lead("lo").over(Window.partitionBy("project_id").orderBy("m")), instant(now))
    gaps = minute.withColumn("until", after).withColumn("from", F.col("hi") + F.expr(f"INTERVAL {hours} HOURS"))
    quiet = gaps.filter(F.col("until") > F.col("from"))
    return quiet.select("project_id", F.explode(F.sequence("from", "until", F.expr(f"INTERVAL {repeat_hours} HOURS"))).alias("alert_at"))
