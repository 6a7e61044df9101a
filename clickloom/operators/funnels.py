"""Conversion funnels: best attempt per actor and the reports over it."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types

from clickloom.functions import calendar
from clickloom.functions.props import FilterGroup, PropertyFilter, all_of, and_filters, any_of, group_predicate
from clickloom.functions.stats import bin_index, bin_width, percent
from clickloom.operators.trends import MAX_TOP, Breakdown, actor, in_range, page
from clickloom.plans.ordered import MAX_ROWS, Following, Timeline
from clickloom.plans.quantile import percentiles
from clickloom.sources.event_stream import NONE_LABEL, OTHER_LABEL, PAGEVIEW

MAX_STEPS = 20
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000}


@dataclass(frozen=True)
class Step:
    event: str | None = None
    properties: tuple[PropertyFilter, ...] = ()
    custom_name: str | None = None

    @property
    def label(self) -> str:
        return self.custom_name or self.event or "Any event"

    def test(self) -> Column:
        named = [F.col("event") == self.event] if self.event else []
        return F.coalesce(all_of([*named, and_filters(self.properties)]), F.lit(False))


@dataclass(frozen=True)
class Exclusion(Step):
    from_step: int = 0
    to_step: int = 1


@dataclass(frozen=True)
class FunnelQuery:
    steps: tuple[Step, ...]
    date_from: str
    date_to: str
    order: str = "ordered"
    window: int = 14
    window_unit: str = "day"
    exclusions: tuple[Exclusion, ...] = ()
    properties: tuple[PropertyFilter, ...] = ()
    filter_group: FilterGroup | None = None
    breakdown: Breakdown | None = None
    attribution: str = "first_touch"
    attribution_step: int = 0
    interval: str = "day"
    timezone: str = "UTC"
    from_step: int = 0
    to_step: int | None = None
    bins: int = 20
    aggregation_group_type_index: int | None = None

    def validate(self) -> "FunnelQuery":
        if not 2 <= len(self.steps) <= MAX_STEPS:
            raise ValueError(f"a funnel takes 2-{MAX_STEPS} steps")
        if self.order not in ("ordered", "strict", "unordered"):
            raise ValueError("unknown funnel order")
        if self.attribution not in ("first_touch", "last_touch", "step"):
            raise ValueError("unknown breakdown attribution")
        if self.breakdown and self.breakdown.limit > MAX_TOP:
            raise ValueError(f"a breakdown has at most {MAX_TOP} values")
        for x in self.exclusions:
            if not 0 <= x.from_step < x.to_step < len(self.steps):
                raise ValueError("an exclusion lies between two steps")
        return self

    @property
    def window_seconds(self) -> int:
        return self.window * UNIT_SECONDS[self.window_unit]

    @property
    def span(self) -> tuple[int, int]:
        return self.from_step, len(self.steps) - 1 if self.to_step is None else self.to_step


def candidates(ev: DataFrame, q: FunnelQuery) -> DataFrame:
    """Events that can matter, with ``s<i>`` and ``x<i>`` match flags.

    Strict funnels need every event to see interruptions. Conversions may
    complete up to one window after the range.
    """
    q.validate()
    horizon = datetime.fromisoformat(q.date_to) + timedelta(seconds=q.window_seconds)
    rows = in_range(ev, q.date_from, str(horizon)).filter(and_filters(q.properties))
    if q.filter_group:
        rows = rows.filter(group_predicate(q.filter_group))
    tests = [s.test() for s in q.steps] + [x.test() for x in q.exclusions]
    if q.order != "strict":
        rows = rows.filter(any_of(tests))
    names = [f"s{i}" for i in range(len(q.steps))] + [f"x{i}" for i in range(len(q.exclusions))]
    rows = rows.withColumn("actor", actor(q.aggregation_group_type_index)).filter(F.col("actor").isNotNull())
    return rows.select(
        "actor", "created_at", "event_id",
        *[t.alias(n) for n, t in zip(names, tests)],
        (q.breakdown.text() if q.breakdown else F.lit("")).alias("bd"),
    )


def outcomes(ev: DataFrame, q: FunnelQuery, max_rows: int = MAX_ROWS) -> DataFrame:
    """The best attempt of every actor that entered.

    ``actor, reached, times (array of epoch seconds), entry_bucket, bd``. The
    longest attempt wins, the earliest one on ties. Every attempt is computed
    from next-event lookups, so no actor is gathered into one task.
    """
    rows = candidates(ev, q).withColumn("t", F.unix_micros("created_at"))
    line = Timeline(rows, ["actor"], "created_at", ["event_id"], max_rows)
    attempts = _unordered(line, q) if q.order == "unordered" else _chained(line, q)
    limit = F.unix_micros(calendar.instant(q.date_to))
    entered = attempts.filter((F.col("t") < limit) & (F.size("chain") > 0))
    # The shortest key wins: more steps first, then the earlier entry.
    rank = F.struct((-F.size("chain")).alias("n"), F.col("created_at"), F.col("event_id"))
    best = entered.groupBy("actor").agg(F.min_by("chain", rank).alias("chain"))
    first, last = F.col("chain")[0], F.element_at("chain", -1)
    at_step = F.coalesce(F.get("chain", F.lit(q.attribution_step)), first)
    touch = {"first_touch": first, "last_touch": last, "step": at_step}[q.attribution]
    return best.select(
        "actor",
        F.size("chain").alias("reached"),
        F.transform("chain", lambda e: e["t"] / F.lit(1e6)).alias("times"),
        calendar.bucket(F.timestamp_micros(first["t"]), q.interval, q.timezone).alias("entry_bucket"),
        touch["bd"].alias("bd"),
    )


def _chained(line: Timeline, q: FunnelQuery) -> DataFrame:
    """Chains of the ordered and strict funnels, built from the last step back."""
    n, window = len(q.steps), q.window_seconds * 1_000_000
    here = {"t": F.col("t"), "bd": F.col("bd")}
    blockers = {f"next_x{i}": Following(F.col("t"), F.col(f"x{i}")) for i in range(len(q.exclusions))}
    if blockers:
        line = line.with_columns(blockers)
        here["blocked"] = F.array(*[F.col(name) for name in blockers])
    link = F.struct(*[c.alias(k) for k, c in here.items()])
    for step in range(n - 1, 0, -1):
        chain = F.array(link)
        if step < n - 1:
            chain = F.concat(chain, F.coalesce(F.col("rest"), F.filter(chain, lambda e: F.lit(False))))
        value = F.when(F.col(f"s{step}"), chain)
        # Strict: only the directly following event counts, matching or not.
        found = Following(value) if q.order == "strict" else Following(value, F.col(f"s{step}"))
        line.df = line.df.drop("rest_next")
        line = line.with_columns({"rest_next": found})
        line.df = line.df.withColumn("rest", F.col("rest_next"))
    full = line.result().filter("s0")
    chain = F.concat(F.array(link), F.coalesce(F.col("rest"), F.filter(F.array(link), lambda e: F.lit(False))))
    kept = F.filter(chain, lambda e: e["t"] - F.col("t") <= window)
    full = full.withColumn("chain", kept)
    return full.filter(~_excluded(q, window)) if q.exclusions else full


def _excluded(q: FunnelQuery, window: int) -> Column:
    """An exclusion event between two reached steps, or up to the window's end."""
    tests = []
    for i, x in enumerate(q.exclusions):
        start, end = F.get("chain", F.lit(x.from_step)), F.get("chain", F.lit(x.to_step))
        until = F.coalesce(end["t"], F.col("t") + window)
        tests.append(F.coalesce(F.get(start["blocked"], F.lit(i)) <= until, F.lit(False)))
    return any_of(tests)


def _unordered(line: Timeline, q: FunnelQuery) -> DataFrame:
    """Steps in any order, each on its own event inside the window.

    A maximum matching never needs more than as many candidates per step as
    there are steps, so bounded arrays carry all that the matching may use.
    """
    n, window = len(q.steps), q.window_seconds * 1_000_000
    link = F.struct(F.col("t").alias("t"), F.col("event_id").alias("id"), F.col("bd").alias("bd"))
    ahead = {f"next_s{i}": Following(link, F.col(f"s{i}"), max(2, n - 1)) for i in range(n)}
    rows = line.with_columns(ahead).result().filter(any_of(F.col(f"s{i}") for i in range(n)))
    options = []
    for i in range(n):
        own = F.filter(F.array(F.when(F.col(f"s{i}"), link)), lambda e: e.isNotNull())
        near = F.filter(F.concat(own, F.col(f"next_s{i}")), lambda e: e["t"] - F.col("t") <= window)
        options.append(F.slice(near, 1, n))
    rows = rows.withColumns({f"c{i}": o for i, o in enumerate(options)})
    names = [f"c{i}" for i in range(n)]
    ids = F.array(*[F.transform(c, lambda e: e["id"]) for c in names])
    firsts = F.array_compact(F.array(*[F.get(F.col(c), F.lit(0)) for c in names]))
    simple = F.array_distinct(firsts)
    # Distinct first candidates are already a full matching.
    matched = F.transform(simple, lambda e: e["id"])
    if not _disjoint(q.steps):
        overlap = F.size(simple) < F.size(firsts)
        matched = F.when(overlap, _match_steps(F.when(overlap, ids))).otherwise(matched)
    rows = rows.withColumn("used", matched)
    pool = F.array_distinct(F.flatten(F.array(*[F.col(c) for c in names])))
    chosen = F.filter(pool, lambda e: F.array_contains(F.col("used"), e["id"]))
    return rows.withColumn("chain", F.array_sort(chosen))


def _disjoint(steps: tuple[Step, ...]) -> bool:
    """Steps on different named events never share an event."""
    names = [s.event for s in steps]
    return None not in names and len(set(names)) == len(names)


@F.pandas_udf(types.ArrayType(types.LongType()))
def _match_steps(options: pd.Series) -> pd.Series:
    """Events of a maximum matching between steps and their candidates."""

    def match(lists) -> list[int]:
        taken: dict[int, int] = {}

        def place(step: int, tried: set[int]) -> bool:
            for event in lists[step]:
                if event in tried:
                    continue
                tried.add(event)
                if event not in taken or place(taken[event], tried):
                    taken[event] = step
                    return True
            return False

        for step in range(len(lists)):
            place(step, set())
        return sorted(int(e) for e in taken)

    return options.map(lambda lists: None if lists is None else match([list(x) for x in lists]))


def grouped(found: DataFrame, q: FunnelQuery) -> DataFrame:
    """Outcomes with ``bd`` cut to the largest groups; the rest is merged."""
    if not q.breakdown:
        return found
    totals = found.groupBy("bd").agg(F.count("*").alias("_n"))
    head = totals.orderBy(F.desc("_n"), "bd").limit(q.breakdown.limit).select("bd", F.lit(True).alias("_top"))
    return found.join(F.broadcast(head), "bd", "left").withColumn(
        "bd", F.when(F.col("_top"), F.col("bd")).otherwise(OTHER_LABEL)
    ).drop("_top")


def breakdown_label(c: Column) -> Column:
    return F.when(~c.isin("", NONE_LABEL), c)


def funnel_steps(found: DataFrame, q: FunnelQuery) -> DataFrame:
    """Per group and step: count, rates, drop-off and time since the step before."""
    found = grouped(found, q)
    reached = found.select(
        "bd",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.col("reached") - 1),
                lambda i: F.struct(
                    i.alias("step"),
                    F.when(i > 0, F.get("times", i) - F.get("times", F.greatest(i - 1, F.lit(0)))).alias("secs"),
                ),
            )
        ).alias("r"),
    ).select("bd", "r.step", "r.secs")
    counts = reached.groupBy("bd", "step").agg(F.count("*").alias("count"), F.avg("secs").alias("avg_secs"))
    medians = percentiles(reached, ["bd", "step"], "secs", {"median_secs": 0.5})
    groups = found.select("bd").distinct() if q.breakdown else found.sparkSession.range(1).select(F.lit("").alias("bd"))
    names = F.array(*[F.lit(s.label) for s in q.steps])
    dense = groups.select("bd", F.posexplode(names).alias("step", "name"))
    full = dense.join(counts, ["bd", "step"], "left").join(medians, ["bd", "step"], "left").fillna(0, ["count"])
    line = Window.partitionBy("bd").orderBy("step")
    entered = F.first("count").over(line)
    before = F.coalesce(F.lag("count").over(line), F.col("count"))
    return full.select(
        breakdown_label(F.col("bd")).alias("breakdown_value"),
        "step", "name", "count",
        percent(F.col("count"), entered).alias("conversion_rate"),
        percent(F.col("count"), before).alias("conversion_rate_from_previous"),
        (before - F.col("count")).alias("dropoff_count"),
        "avg_secs", "median_secs",
    )


def _converted(found: DataFrame, q: FunnelQuery) -> DataFrame:
    start, end = q.span
    return grouped(found, q).filter(F.col("reached") > end).select(
        "bd", (F.get("times", F.lit(end)) - F.get("times", F.lit(start))).alias("secs")
    )


def time_to_convert(found: DataFrame, q: FunnelQuery) -> DataFrame:
    """Mean and median seconds between two steps."""
    secs = _converted(found, q)
    means = secs.groupBy("bd").agg(F.count("*").alias("converted"), F.avg("secs").alias("average_secs"))
    return means.join(percentiles(secs, ["bd"], "secs", {"median_secs": 0.5}), "bd", "left").select(
        breakdown_label(F.col("bd")).alias("breakdown_value"), "converted", "average_secs", "median_secs"
    )


def convert_histogram(found: DataFrame, q: FunnelQuery) -> DataFrame:
    """Equal bins of the seconds between two steps, empty bins included."""
    secs = _converted(found, q)
    widths = secs.groupBy("bd").agg(bin_width(F.max("secs"), q.bins).alias("width"))
    counts = secs.join(widths, "bd").groupBy("bd", bin_index(F.col("secs"), F.col("width"), q.bins).alias("bin")).agg(
        F.count("*").alias("count")
    )
    dense = widths.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(q.bins - 1))))
    return dense.join(counts, ["bd", "bin"], "left").select(
        breakdown_label(F.col("bd")).alias("breakdown_value"), "bin",
        (F.col("bin") * F.col("width")).alias("from_secs"), ((F.col("bin") + 1) * F.col("width")).alias("to_secs"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def conversion_trend(found: DataFrame, q: FunnelQuery) -> DataFrame:
    """Entered and converted actors by entry bucket, empty buckets included."""
    start, end = q.span
    found = grouped(found, q)
    counts = found.filter(F.col("reached") > start).groupBy("bd", F.col("entry_bucket").alias("bucket")).agg(
        F.count("*").alias("entered"), F.count_if(F.col("reached") > end).alias("converted")
    )
    groups = found.select("bd").distinct() if q.breakdown else found.sparkSession.range(1).select(F.lit("").alias("bd"))
    dense = calendar.with_dense_buckets(groups, q.date_from, q.date_to, q.interval, q.timezone)
    full = dense.join(counts, ["bd", "bucket"], "left").fillna(0, ["entered", "converted"])
    return full.select(
        breakdown_label(F.col("bd")).alias("breakdown_value"), "bucket", "entered", "converted",
        percent(F.col("converted"), F.col("entered")).alias("conversion_rate"),
    )


def funnel_actors(
    found: DataFrame, q: FunnelQuery, step: int, dropped: bool = False, breakdown_value: str | None = None,
    limit: int | None = 100, offset: int = 0,
) -> DataFrame:
    """Actors that reached a step, or that reached the one before but not it."""
    out = grouped(found, q).filter(F.col("reached") == step if dropped else F.col("reached") > step)
    if breakdown_value is not None:
        out = out.filter(F.col("bd") == breakdown_value)
    return page(out.select("actor", "reached", "times"), [F.col("actor")], limit, offset)


# Saved funnels of URL and event steps.


@dataclass(frozen=True)
class SavedStep:
    label: str
    type: str
    value: str

    def test(self) -> Column:
        if self.type == "url":
            return (F.col("event") == PAGEVIEW) & F.col("path").like(self.value)
        return (F.col("event") != PAGEVIEW) & (F.col("event") == self.value)


def saved_funnel(rows: DataFrame, steps: list[SavedStep], window_hours: int | None = None, ordered: bool = True) -> DataFrame:
    """Visitors per step; an ordered funnel starts at the first step-one event.

    ``rows`` holds ``visitor_id, created_at, event, path``. Each step joins one
    row per visitor, so no pairs of events are formed.
    """
    limit = F.expr(f"INTERVAL {window_hours} HOURS") if window_hours else None
    counts: list[DataFrame] = []
    if ordered:
        reached: DataFrame | None = None
        for i, step in enumerate(steps):
            hits = rows.filter(step.test()).select("visitor_id", F.col("created_at").alias("at"))
            if reached is None:
                reached = hits.groupBy("visitor_id").agg(F.min("at").alias("t"))
                reached = reached.withColumn("t0", F.col("t"))
            else:
                joined = hits.join(reached, "visitor_id").filter(F.col("at") >= F.col("t"))
                if limit is not None:
                    joined = joined.filter(F.col("at") <= F.col("t0") + limit)
                reached = joined.groupBy("visitor_id").agg(F.min("at").alias("t"), F.first("t0").alias("t0"))
            counts.append(reached.agg(F.count("*").alias("visitors")).withColumn("step", F.lit(i)))
    else:
        flags = [s.test() for s in steps]
        for i in range(len(steps)):
            # Prefix i counts visitors that did all its steps, each within the
            # window of their first event among these steps.
            hits = rows.filter(any_of(flags[: i + 1]))
            first = hits.groupBy("visitor_id").agg(F.min("created_at").alias("t0"))
            kept = hits.join(first, "visitor_id")
            if limit is not None:
                kept = kept.filter(F.col("created_at") <= F.col("t0") + limit)
            done = kept.groupBy("visitor_id").agg(*[F.bool_or(flags[j]).alias(f"d{j}") for j in range(i + 1)])
            done = done.filter(all_of(F.col(f"d{j}") for j in range(i + 1)))
            counts.append(done.agg(F.count("*").alias("visitors")).withColumn("step", F.lit(i)))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    line = Window.orderBy("step")  # one row per step
    before = F.lag("visitors").over(line)
    drop = F.when(before > 0, (before - F.col("visitors")) / before * 100).otherwise(F.lit(0.0))
    labels = F.array(*[F.lit(s.label) for s in steps])
    return out.select("step", F.get(labels, F.col("step")).alias("label"), "visitors", drop.alias("drop_off"))


def prefix_funnel(pageviews: DataFrame, prefixes: list[str]) -> DataFrame:
    """Visitors with a view under each path prefix, independent of order."""
    counts = [F.count_distinct(F.when(F.startswith("path", F.lit(p)), F.col("visitor_id"))) for p in prefixes]
    wide = pageviews.agg(F.array(*counts).alias("n"))
    return wide.select(F.posexplode("n").alias("step", "visitors")).select(
        "step", F.get(F.array(*[F.lit(p) for p in prefixes]), F.col("step")).alias("path"), "visitors"
    )
