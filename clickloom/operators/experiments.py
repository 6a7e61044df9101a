"""Experiments, feature flags, remote configuration and goals."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.functions.hashing import assigned_variant, in_rollout, weighted_variant
from clickloom.functions.props import all_of
from clickloom.functions.stats import compare_proportions, percent
from clickloom.functions.targeting import Rules, matches
from clickloom.plans.small import with_row


def first_exposures(exposures: DataFrame, order: Sequence[str] = ("created_at", "event_id")) -> DataFrame:
    """The earliest assignment per experiment and visitor."""
    at = F.struct(*order)
    return exposures.groupBy("experiment_id", "visitor_id").agg(
        F.min_by("variant", at).alias("variant"), F.min("created_at").alias("first_exposed_at")
    )


def assign_all(visitors: DataFrame, project: str, experiment: str, weights: Sequence[tuple[str, float]]) -> DataFrame:
    return visitors.withColumn("variant", assigned_variant(project, experiment, F.col("visitor_id"), weights))


def converters(exposures: DataFrame, conversions: DataFrame, start: str, end: str) -> DataFrame:
    """Visitors that converted after their exposure, inside the range."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    seen = exposures.filter(F.col("first_exposed_at").between(lo, hi))
    # A visitor converted after the exposure exactly when the last conversion is.
    last = conversions.filter(F.col("created_at") <= hi).groupBy("visitor_id").agg(F.max("created_at").alias("last_at"))
    return seen.join(last, "visitor_id").filter(F.col("last_at") >= F.col("first_exposed_at"))


def experiment_results(exposures: DataFrame, conversions: DataFrame, variants: Sequence[str], start: str, end: str) -> DataFrame:
    """Exposures, converters and the test against the first variant."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    shown = exposures.filter(F.col("first_exposed_at").between(lo, hi)).groupBy("variant").agg(F.count_distinct("visitor_id").alias("assignments"))
    done = converters(exposures, conversions, start, end).groupBy("variant").agg(F.count_distinct("visitor_id").alias("conversions"))
    names = exposures.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(v) for v in variants])).alias("position", "variant"))
    rows = names.join(shown, "variant", "left").join(done, "variant", "left").fillna(0, ["assignments", "conversions"])
    whole = Window.partitionBy()  # one row per variant
    first = F.col("position") == 0
    base_n = F.max(F.when(first, F.col("assignments"))).over(whole)
    base_c = F.max(F.when(first, F.col("conversions"))).over(whole)
    rows = rows.withColumns({"_bn": base_n, "_bc": base_c})
    c = compare_proportions(F.col("conversions"), F.col("assignments"), F.col("_bc"), F.col("_bn"))
    rows = rows.select(
        "variant", "assignments", "conversions", percent(F.col("conversions"), F.col("assignments")).alias("conversion_rate"),
        F.when(~first, c.lift).alias("lift_percent"), F.when(~first, c.p_value).alias("p_value"),
        F.when(~first, c.confidence).alias("confidence"),
        F.coalesce(F.when(~first, c.significant), F.lit(False)).alias("significant"), first.alias("is_baseline"),
    )
    better = F.col("significant") & (F.col("lift_percent") > 0)
    best = F.max(F.when(better, F.col("conversion_rate"))).over(whole)
    return rows.withColumn("is_winner", F.coalesce(better & (F.col("conversion_rate") == best), F.lit(False)))


@dataclass(frozen=True)
class Flag:
    key: str
    enabled: bool = True
    rules: Rules = Rules()
    rollout_percentage: float = 100.0
    experiment: tuple[str, tuple[tuple[str, float], ...]] | None = None
    variants: tuple[tuple[str, float, Any], ...] = ()
    flag_type: str = "boolean"
    default_value: Any = False
    remote_config: dict = field(default_factory=dict)


def _json(value: Any) -> Column:
    return F.lit(json.dumps(value))


def evaluate_flag(project: str, flag: Flag) -> Column:
    """``key, matched, enabled, variant, value, reason`` for a visitor row."""
    none, visitor = F.lit(None).cast("string"), F.col("visitor_id")

    def result(matched: bool, enabled: bool, variant: Column, value: Column, reason: str) -> Column:
        return F.struct(
            F.lit(flag.key).alias("key"), F.lit(matched).alias("matched"), F.lit(enabled).alias("enabled"),
            variant.alias("variant"), value.alias("value"), F.lit(reason).alias("reason"),
        )

    default = _json(flag.default_value)
    if not flag.enabled:
        return result(False, False, none, default, "disabled")
    values = F.create_map(*[x for name, _, v in flag.variants for x in (F.lit(name), _json(v))]) if flag.variants else None

    def value_of(variant: Column) -> Column:
        named = F.concat(F.lit('"'), variant, F.lit('"'))
        return F.coalesce(F.try_element_at(values, variant), named) if values is not None else named

    if flag.flag_type == "boolean":
        plain = _json(True)
    else:
        plain = _json(flag.remote_config) if flag.remote_config else default
    matched_only = result(True, True, none, plain, "match")
    if flag.experiment:
        variant = assigned_variant(project, flag.experiment[0], visitor, flag.experiment[1])
        final = result(True, True, variant, value_of(variant), "experiment_assignment")
    elif flag.variants:
        variant = weighted_variant(project, flag.key, visitor, [(name, w) for name, w, _ in flag.variants])
        picked = result(True, True, variant, value_of(variant), "variant_assignment")
        final = F.when(variant.isNotNull(), picked).otherwise(matched_only)
    else:
        final = matched_only
    rolled = in_rollout(project, flag.key, visitor, flag.rollout_percentage)
    return (
        F.when(~matches(flag.rules), result(False, False, none, default, "no_match"))
        .when(~rolled, result(True, False, none, default, "rollout_miss"))
        .otherwise(final)
    )


def evaluate_flags(visitors: DataFrame, project: str, flags: Sequence[Flag]) -> DataFrame:
    """All flags for all visitors without a join."""
    found = F.array(*[evaluate_flag(project, f) for f in flags])
    return visitors.select("visitor_id", F.explode(found).alias("f")).select("visitor_id", "f.*")


@dataclass(frozen=True)
class ConfigEntry:
    key: str
    value: Any
    rules: Rules = Rules()
    is_active: bool = True


def evaluate_config(visitors: DataFrame, entries: Sequence[ConfigEntry]) -> DataFrame:
    def one(e: ConfigEntry) -> Column:
        hit = matches(e.rules) & F.lit(e.is_active)
        reason = F.when(F.lit(not e.is_active), "inactive").when(hit, "match").otherwise("no_match")
        return F.struct(F.lit(e.key).alias("key"), hit.alias("matched"), F.when(hit, _json(e.value)).alias("value"), reason.alias("reason"))

    return visitors.select("visitor_id", F.explode(F.array(*[one(e) for e in entries])).alias("c")).select("visitor_id", "c.*")


# Goals.


@dataclass(frozen=True)
class Goal:
    goal_id: str
    type: str
    target: str
    data: dict = field(default_factory=dict)


def matches_pattern(path: Column, pattern: str) -> Column:
    """Exact, ``pre%``, ``%post``, ``pre%post``; more wildcards ask for all parts in any order."""
    parts = pattern.split("%")
    if not pattern:
        return F.lit(False)
    if len(parts) == 1:
        return path == pattern
    if len(parts) == 2:
        return all_of([path.startswith(parts[0])] if parts[0] else []) & all_of([path.endswith(parts[1])] if parts[1] else [])
    return all_of(path.contains(p) for p in parts if p)


def goal_test(goal: Goal) -> Column:
    if goal.type == "pageview":
        return (F.col("event") == "$pageview") & matches_pattern(F.col("path"), goal.target)
    data = F.try_parse_json("event_data")
    same = [
        F.coalesce(F.to_json(F.try_variant_get(data, f"$['{k}']", "variant")) == json.dumps(v), F.lit(False)) for k, v in goal.data.items()
    ]
    return all_of([F.col("event") == goal.target, *same])


def goal_hits(rows: DataFrame, goals: Sequence[Goal]) -> DataFrame:
    """One row per event and goal it meets; goals are specifications, not a table join."""
    met = F.array_compact(F.array(*[F.when(goal_test(g), F.lit(g.goal_id)) for g in goals]))
    return rows.withColumn("goal_id", F.explode(met))


def goal_conversions(rows: DataFrame, goals: Sequence[Goal]) -> DataFrame:
    """The first hit per goal and session."""
    at = F.struct("created_at", "event_id")
    return goal_hits(rows, goals).groupBy("goal_id", "session_id").agg(
        F.min_by(F.struct("visitor_id", "event_id", "revenue_amount"), at).alias("c"), F.min("created_at").alias("created_at")
    ).select("goal_id", "session_id", "created_at", "c.*")


def goal_stats(conversions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Conversions, visitors, revenue, and rates per session visitor."""
    per = conversions.groupBy("goal_id").agg(
        F.count("*").alias("conversions"), F.count_distinct("visitor_id").alias("unique_visitors"),
        F.coalesce(F.sum("revenue_amount"), F.lit(0)).cast("double").alias("total_revenue"),
    )
    everyone = sessions.agg(F.count_distinct("visitor_id").alias("_all"))
    out = with_row(per, everyone)
    return out.select(
        "goal_id", "conversions", "unique_visitors", "total_revenue",
        percent(F.col("conversions"), F.col("_all")).alias("conversion_rate"),
        percent(F.col("unique_visitors"), F.col("_all")).alias("unique_rate"),
    )
