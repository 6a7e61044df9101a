"""Event trends: series, maths, breakdowns, formulas and period comparison."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.functions import calendar
from clickloom.functions.formula import formula
from clickloom.functions.props import (
    FilterGroup, PropertyFilter, all_of, and_filters, any_of, group_predicate, property_text, safe_number,
)
from clickloom.plans.quantile import percentiles
from clickloom.session import cut_lineage
from clickloom.sources.event_stream import NONE_LABEL, OTHER_LABEL

QUANTILES = {"median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
VALUE_MATHS = ("sum", "avg", "min", "max", *QUANTILES)
COUNT_MATHS = ("total", "dau", "unique_sessions", "unique_group")
ACTOR_PREFIX = "per_actor_"
ACTOR_MATHS = tuple(f"{ACTOR_PREFIX}{m}" for m in ("avg", "min", "max", "median", "p90", "p95", "p99"))
MAX_SERIES, MAX_BUCKETS, MAX_GROUPS, MAX_TOP = 26, 5000, 5, 500


@dataclass(frozen=True)
class Series:
    event: str | None = None
    math: str = "total"
    math_property: str | None = None
    math_property_type: str = "event"
    math_group_type_index: int | None = None
    properties: tuple[PropertyFilter, ...] = ()
    custom_name: str | None = None

    @property
    def label(self) -> str:
        return self.custom_name or self.event or "All events"


@dataclass(frozen=True)
class Breakdown:
    property: str
    type: str = "event"
    limit: int = 25
    group_type_index: int | None = None

    def text(self) -> Column:
        return F.coalesce(property_text(self.property, self.type, self.group_type_index), F.lit(NONE_LABEL))


@dataclass(frozen=True)
class TrendsQuery:
    series: tuple[Series, ...]
    date_from: str
    date_to: str
    interval: str = "day"
    timezone: str = "UTC"
    properties: tuple[PropertyFilter, ...] = ()
    filter_group: FilterGroup | None = None
    breakdown: Breakdown | None = None
    compare: bool = False
    formula: str | None = None
    smoothing_intervals: int | None = None
    cumulative: bool = False
    aggregation_group_type_index: int | None = None

    def validate(self) -> "TrendsQuery":
        if not 1 <= len(self.series) <= MAX_SERIES:
            raise ValueError(f"series must contain 1-{MAX_SERIES} items")
        if self.interval not in calendar.UNITS:
            raise ValueError("unknown interval")
        span = (_time(self.date_to) - _time(self.date_from)).total_seconds()
        if span <= 0:
            raise ValueError("date_to must be after date_from")
        shortest = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 28 * 86400}[self.interval]
        if span / shortest + 1 > MAX_BUCKETS:
            raise ValueError("too many buckets; use a larger interval")
        if self.aggregation_group_type_index is not None and not 0 <= self.aggregation_group_type_index < MAX_GROUPS:
            raise ValueError("unknown group type")
        for s in self.series:
            if s.math not in (*COUNT_MATHS, *VALUE_MATHS, *ACTOR_MATHS):
                raise ValueError(f"unknown math {s.math!r}")
            if s.math in VALUE_MATHS and not s.math_property:
                raise ValueError("this math needs math_property")
            if s.math == "unique_group" and not (
                s.math_group_type_index is not None and 0 <= s.math_group_type_index < MAX_GROUPS
            ):
                raise ValueError("unique_group math needs math_group_type_index")
        if self.breakdown and not 1 <= self.breakdown.limit <= MAX_TOP:
            raise ValueError(f"breakdown limit must be 1-{MAX_TOP}")
        if self.smoothing_intervals is not None and not 1 <= self.smoothing_intervals <= 100:
            raise ValueError("smoothing_intervals must be 1-100")
        if self.formula:
            formula(self.formula, [F.lit(0.0)] * len(self.series))
        return self

    def previous(self) -> "TrendsQuery":
        """The window of equal length that ends where this one starts."""
        start, end = _time(self.date_from), _time(self.date_to)
        return replace(self, date_from=str(start - (end - start)), date_to=str(start))


def _time(text: str) -> datetime:
    return datetime.fromisoformat(text)


def actor(q_index: int | None) -> Column:
    """The visitor, or the group key when aggregating by a group type."""
    return F.col("visitor_id") if q_index is None else F.col("properties")[f"$group_{q_index}"]


def in_range(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.filter((F.col("created_at") >= calendar.instant(start)) & (F.col("created_at") < calendar.instant(end)))


def series_predicate(s: Series) -> Column:
    named = [F.col("event") == s.event] if s.event else []
    return all_of([*named, and_filters(s.properties)])


def scoped(ev: DataFrame, q: TrendsQuery) -> DataFrame:
    """Events of the range that pass the query-level filters and have an actor."""
    out = in_range(ev, q.date_from, q.date_to).filter(and_filters(q.properties))
    if q.filter_group:
        out = out.filter(group_predicate(q.filter_group))
    if q.aggregation_group_type_index is not None:
        out = out.filter(actor(q.aggregation_group_type_index).isNotNull())
    return out


def _case(q: TrendsQuery, pick) -> Column:
    """A per-series column chosen by ``series_index``."""
    columns = [(i, pick(s)) for i, s in enumerate(q.series)]
    out = F
    for i, c in columns:
        if c is not None:
            out = out.when(F.col("series_index") == i, c)
    return F.lit(None) if out is F else out


def hits(ev: DataFrame, q: TrendsQuery) -> DataFrame:
    """One row per event and matching series, from a single read of the events.

    With a comparison the window before is read too; ``win`` tells them apart.
    """
    base = scoped(ev, replace(q, date_from=q.previous().date_from) if q.compare else q)
    tests = [series_predicate(s) for s in q.series]
    if len(q.series) == 1:
        matched = base.filter(tests[0]).withColumn("series_index", F.lit(0))
    else:
        found = F.array_compact(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)]))
        matched = base.filter(any_of(tests)).withColumn("series_index", F.explode(found))
    counted = {
        "dau": lambda s: actor(q.aggregation_group_type_index),
        "unique_sessions": lambda s: F.col("session_id"),
        "unique_group": lambda s: F.col("properties")[f"$group_{s.math_group_type_index}"],
    }
    columns = {
        "win": F.when(F.col("created_at") < calendar.instant(q.date_from), 1).otherwise(0),
        "bd": q.breakdown.text() if q.breakdown else F.lit(""),
        "bucket": calendar.bucket(F.col("created_at"), q.interval, q.timezone),
    }
    if any(s.math.startswith(ACTOR_PREFIX) for s in q.series):
        columns["actor"] = actor(q.aggregation_group_type_index)
    if any(s.math in counted for s in q.series):
        columns["counted"] = _case(q, lambda s: counted[s.math](s) if s.math in counted else None)
    if any(s.math in VALUE_MATHS for s in q.series):
        columns["number"] = _case(
            q,
            lambda s: safe_number(property_text(s.math_property, s.math_property_type, s.math_group_type_index))
            if s.math in VALUE_MATHS
            else None,
        )
    return matched.select("series_index", *[c.alias(n) for n, c in columns.items()])


def cells(found: DataFrame, q: TrendsQuery) -> DataFrame:
    """``found`` grouped by window, series, value, bucket and whom the maths count, with ``n`` and sums.

    All numbers but percentiles of a property come from these rows, so the
    events are read once, whatever the number of windows and kinds of maths.
    """
    keys = [c for c in ("win", "series_index", "bd", "bucket", "actor", "counted") if c in found.columns]
    sums = [F.count("*").alias("n")]
    if "number" in found.columns:
        sums += [F.sum("number").alias("number_sum"), F.count("number").alias("number_n"), F.min("number").alias("number_min"), F.max("number").alias("number_max")]
    return found.groupBy(*keys).agg(*sums)


def top_breakdowns(grouped: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` largest values with their rank, then one row for the rest; of cells or of single rows."""
    totals = grouped.groupBy("bd").agg((F.sum("n") if "n" in grouped.columns else F.count("*")).alias("n"))
    head = totals.orderBy(F.desc("n"), "bd").limit(limit + 1)
    ranked = head.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "bd")))
    other = F.col("rank") > limit
    return ranked.select(F.when(other, OTHER_LABEL).otherwise(F.col("bd")).alias("bd"), "rank")


def label_breakdowns(found: DataFrame, top: DataFrame) -> DataFrame:
    """Replace values outside the top ones; ``top`` holds at most 501 rows."""
    kept = F.broadcast(top.filter(F.col("bd") != OTHER_LABEL).select("bd", F.lit(True).alias("_kept")))
    return found.join(kept, "bd", "left").withColumn(
        "bd", F.when(F.col("_kept"), F.col("bd")).otherwise(OTHER_LABEL)
    ).drop("_kept")


def aggregate(grouped: DataFrame, found: DataFrame, q: TrendsQuery) -> DataFrame:
    """``series_index, bd, bucket, value`` for all maths of the query.

    ``grouped`` has the cells of one window; percentiles of a property take
    their rows from ``found``.
    """
    keys = ["series_index", "bd", "bucket"]
    by_kind: dict[str, list[int]] = {}
    for i, s in enumerate(q.series):
        kind = "actor" if s.math.startswith(ACTOR_PREFIX) else "quantile" if s.math in QUANTILES else "plain"
        by_kind.setdefault(kind, []).append(i)

    def only(rows: DataFrame, kind: str) -> DataFrame:
        return rows if len(by_kind) == 1 else rows.filter(F.col("series_index").isin(by_kind[kind]))

    parts: list[DataFrame] = []
    if "plain" in by_kind:
        maths = {q.series[i].math for i in by_kind["plain"]}
        aggregates = {"total": lambda: F.sum("n"), "distinct": lambda: F.count_distinct("counted")}
        aggregates["sum"] = lambda: F.sum("number_sum")
        aggregates["avg"] = lambda: F.try_divide(F.sum("number_sum"), F.sum("number_n"))
        aggregates["min"], aggregates["max"] = lambda: F.min("number_min"), lambda: F.max("number_max")
        wanted = {m if m in aggregates else "distinct" for m in maths}
        sums = only(grouped, "plain").groupBy(*keys).agg(*[aggregates[w]().cast("double").alias(f"_{w}") for w in sorted(wanted)])
        value = _case(q, lambda s: F.col("_" + (s.math if s.math in wanted else "distinct")) if s.math in maths else None)
        parts.append(sums.select(*keys, value.alias("value")))
    if "quantile" in by_kind:
        wanted = {q.series[i].math: QUANTILES[q.series[i].math] for i in by_kind["quantile"]}
        sums = percentiles(only(found, "quantile"), keys, "number", wanted)
        value = _case(q, lambda s: F.col(s.math) if s.math in wanted else None)
        parts.append(sums.select(*keys, value.alias("value")))
    if "actor" in by_kind:
        counts = only(grouped, "actor").groupBy(*keys, "actor").agg(F.sum("n").alias("c"))
        maths = {q.series[i].math.removeprefix(ACTOR_PREFIX) for i in by_kind["actor"]}
        plain = maths - set(QUANTILES)
        # Few distinct counts exist: m of them need about m * m / 2 events.
        weighted = counts.groupBy(*keys, "c").agg(F.count("*").alias("actors"))
        sums = weighted.groupBy(*keys).agg(
            *[(F.sum(F.col("c") * F.col("actors")) / F.sum("actors") if m == "avg" else getattr(F, m)("c")).cast("double").alias(m) for m in sorted(plain)],
            *[F.percentile("c", F.lit(QUANTILES[m]), F.col("actors")).alias(m) for m in sorted(maths - plain)],
        )
        parts.append(_actor_values(sums, q, keys, maths))
    return reduce(DataFrame.unionByName, parts)


def _actor_values(sums: DataFrame, q: TrendsQuery, keys: Sequence[str], maths: set[str]) -> DataFrame:
    value = _case(
        q,
        lambda s: F.col(s.math.removeprefix(ACTOR_PREFIX))
        if s.math.startswith(ACTOR_PREFIX) and s.math.removeprefix(ACTOR_PREFIX) in maths
        else None,
    )
    return sums.select(*keys, value.alias("value")).filter(F.col("value").isNotNull())


def run_period(ev: DataFrame, q: TrendsQuery) -> DataFrame:
    """Zero-filled values of the query's own window, before formula and smoothing."""
    found = hits(ev, replace(q, compare=False))
    return _period(cells(found, q), found, q)


def _period(grouped: DataFrame, found: DataFrame, q: TrendsQuery) -> DataFrame:
    spark = grouped.sparkSession
    if q.breakdown:
        top = top_breakdowns(grouped, q.breakdown.limit)
        grouped, found = label_breakdowns(grouped, top), label_breakdowns(found, top)
    else:
        top = spark.range(1).select(F.lit("").alias("bd"), F.lit(1).alias("rank"))
    values = aggregate(grouped, found, q)
    indexes = F.explode(F.array(*[F.lit(i) for i in range(len(q.series))]))
    dense = calendar.with_dense_buckets(
        top.withColumn("series_index", indexes), q.date_from, q.date_to, q.interval, q.timezone
    )
    return dense.join(values, ["series_index", "bd", "bucket"], "left").select(
        "series_index", "bd", "rank", "bucket", F.coalesce("value", F.lit(0.0)).alias("value")
    )


def post_process(values: DataFrame, q: TrendsQuery) -> DataFrame:
    """Trailing mean, then running sum, along the buckets of each line."""
    line = Window.partitionBy("series_index", "bd").orderBy("bucket")
    if q.smoothing_intervals and q.smoothing_intervals > 1:
        mean = F.avg("value").over(line.rowsBetween(-(q.smoothing_intervals - 1), 0))
        values = values.withColumn("value", mean)
    if q.cumulative:
        values = values.withColumn("value", F.sum("value").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return values


def apply_formula(values: DataFrame, q: TrendsQuery) -> DataFrame:
    lines = [F.max(F.when(F.col("series_index") == i, F.col("value"))).alias(f"s{i}") for i in range(len(q.series))]
    wide = values.groupBy("bd", "rank", "bucket").agg(*lines)
    series = [F.coalesce(f"s{i}", F.lit(0.0)) for i in range(len(q.series))]
    return wide.select(
        F.lit(-1).alias("series_index"), "bd", "rank", "bucket", formula(q.formula, series).alias("value")
    )


def trends(ev: DataFrame, q: TrendsQuery) -> DataFrame:
    """Long rows ``label, series_index, breakdown_value, compare_label, bucket, value, total``."""
    q.validate()
    windows = [("current" if q.compare else None, q)]
    if q.compare:
        windows.append(("previous", q.previous()))
    found = hits(ev, q)
    grouped = cells(found, q)
    kinds = {s.math.startswith(ACTOR_PREFIX) for s in q.series if s.math not in QUANTILES}
    if len(windows) + len(kinds) + bool(q.breakdown) > 2:  # the cells are used more than once
        grouped = cut_lineage(grouped)
    parts = []
    for i, (compare_label, window) in enumerate(windows):
        here = F.col("win") == i
        values = _period(grouped.filter(here), found.filter(here), window)
        if q.formula:
            values = apply_formula(values, q)
        parts.append(post_process(values, q).withColumn("compare_label", F.lit(compare_label).cast("string")))
    out = reduce(DataFrame.unionByName, parts)
    line = Window.partitionBy("series_index", "bd", "compare_label")
    if q.formula:
        label, index = F.lit(f"Formula ({q.formula})"), F.lit(None).cast("int")
    else:
        label, index = _case(q, lambda s: F.lit(s.label)), F.col("series_index")
    return out.select(
        label.alias("label"),
        index.alias("series_index"),
        F.when(~F.col("bd").isin("", NONE_LABEL), F.col("bd")).alias("breakdown_value"),
        "compare_label",
        "bucket",
        "value",
        F.sum("value").over(line).alias("total"),
    )


def trends_actors(
    ev: DataFrame, q: TrendsQuery, series: int, bucket: str | None = None, breakdown_value: str | None = None,
    limit: int | None = 100, offset: int = 0,
) -> DataFrame:
    """Who is behind one data point: events, first and last time per actor."""
    q.validate()
    s = q.series[series]
    rows = scoped(ev, q).filter(series_predicate(s))
    if bucket is not None:
        rows = rows.filter(calendar.bucket(F.col("created_at"), q.interval, q.timezone) == bucket)
    if q.breakdown and breakdown_value is not None:
        if breakdown_value == OTHER_LABEL:
            ranked = top_breakdowns(hits(ev, replace(q, compare=False)), q.breakdown.limit).filter(F.col("bd") != OTHER_LABEL)
            rows = rows.withColumn("bd", q.breakdown.text()).join(F.broadcast(ranked), "bd", "left_anti")
        else:
            rows = rows.filter(q.breakdown.text() == breakdown_value)
    out = rows.groupBy(actor(q.aggregation_group_type_index).alias("actor_id")).agg(
        F.count("*").alias("event_count"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")
    )
    return page(out, [F.desc("event_count"), F.col("actor_id")], limit, offset)


def page(df: DataFrame, order: Sequence[Column], limit: int | None, offset: int = 0) -> DataFrame:
    """A sorted page; without a limit all rows are kept."""
    if limit is None:
        return df
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


def hydrate_people(actors: DataFrame, profiles: DataFrame, id_column: str = "actor_id") -> DataFrame:
    """Account id and traits of each actor; unknown people get an empty map."""
    side = profiles.select(F.col("visitor_id").alias(id_column), "user_id", "traits")
    return actors.join(side, id_column, "left").withColumn(
        "traits", F.coalesce("traits", F.create_map().cast("map<string,string>"))
    )


def hydrate_groups(actors: DataFrame, groups: DataFrame, type_index: int, id_column: str = "actor_id") -> DataFrame:
    side = groups.filter(F.col("type_index") == type_index).select(
        F.col("group_key").alias(id_column), F.col("properties").alias("group_properties")
    )
    return actors.join(side, id_column, "left").withColumn(
        "group_properties", F.coalesce("group_properties", F.create_map().cast("map<string,string>"))
    )
