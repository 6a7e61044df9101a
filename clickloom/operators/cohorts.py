"""Dynamic and static person cohorts.

Criteria are flags of a visitor. One grouped pass over the events, one over the
sessions, one over the profiles and one over stored members give every visitor
a row of flags, whatever the number of cohorts and criteria; trees, negations
and references to other cohorts are boolean expressions on that row.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clickloom.functions import calendar
from clickloom.functions.props import PropertyFilter, and_filters, predicate
from clickloom.plans.small import broadcast_if_small

DAYS = {"day": 1, "week": 7, "month": 30}
BEHAVIOURS = (
    "performed_event", "performed_event_multiple", "stopped_performing_event", "restarted_performing_event",
    "performed_event_first_time", "performed_event_regularly",
)


@dataclass(frozen=True)
class Person:
    key: str
    operator: str = "exact"
    value: Any = None
    negation: bool = False


@dataclass(frozen=True)
class InCohort:
    key: str
    negation: bool = False


@dataclass(frozen=True)
class Behavior:
    value: str
    key: str
    time_value: int = 30
    time_interval: str = "day"
    seq_time_value: int | None = None
    count: int | None = None
    count_operator: str | None = None
    min_periods: int | None = None
    total_periods: int | None = None
    event_properties: tuple[PropertyFilter, ...] = ()
    negation: bool = False


@dataclass(frozen=True)
class Group:
    join: str = "AND"
    values: tuple["Group | Person | InCohort | Behavior", ...] = field(default_factory=tuple)


@dataclass(frozen=True)
class People:
    """What criteria are evaluated on."""

    events: DataFrame
    sessions: DataFrame
    profiles: DataFrame
    members: DataFrame | None = None

    def universe(self) -> DataFrame:
        """Every visitor with a session or a profile."""
        return self.sessions.select("visitor_id").union(self.profiles.select("visitor_id")).distinct()


def _back(now: datetime, interval: str, n: int) -> datetime:
    return now - timedelta(hours=n) if interval == "hour" else now - timedelta(days=DAYS[interval] * n)


class _Flags:
    """The criteria of a set of cohorts: what each needs of the facts, and its test of a visitor's row."""

    def __init__(self, now: datetime):
        self.now, self.known = now, {}
        self.matches: list[Column] = []
        self.events: dict[str, Column] = {}
        self.profiles: dict[str, Column] = {}
        self.members: dict[str, Column] = {}

    def _behaviour(self, c: Behavior, name: str) -> Column:
        if c.value not in BEHAVIOURS:
            raise ValueError(f"unknown behaviour {c.value!r}")
        instant = lambda t: calendar.instant(str(t))
        start, at = _back(self.now, c.time_interval, c.time_value), F.col("created_at")
        lower = {
            "performed_event_regularly": _back(self.now, c.time_interval, c.total_periods or 0),
            "performed_event_first_time": None,
            "restarted_performing_event": None,
        }.get(c.value, start)
        rows = (F.col("event") == c.key) & (at < instant(self.now))
        if lower is not None:
            rows = rows & (at >= instant(lower))
        self.matches.append(rows)
        own = F.coalesce(rows & and_filters(c.event_properties), F.lit(False))
        if c.value == "performed_event":
            self.events[name] = F.bool_or(own)
            return F.coalesce(name, F.lit(False))
        if c.value == "performed_event_first_time":
            self.events[name] = F.min(F.when(own, at))
            return F.coalesce(F.col(name) >= instant(start), F.lit(False))
        if c.value == "performed_event_regularly":  # at most one entry per period since ``lower``
            self.events[name] = F.size(F.collect_set(F.when(own, F.date_trunc(c.time_interval, at))))
            return F.coalesce(F.col(name) >= c.min_periods, F.lit(False))
        if c.value == "performed_event_multiple":
            self.events[name] = F.count_if(own)
            n = F.coalesce(name, F.lit(0))
            fits = {"gte": n >= c.count, "lte": n <= c.count, "exact": n == c.count}[c.count_operator]
            nobody = F.lit(c.count_operator == "lte" or c.count == 0)
            return F.when(n > 0, fits).otherwise(nobody & F.col("known"))
        recent = at >= instant(_back(self.now, c.time_interval, c.seq_time_value or 0))
        since = at >= instant(start)
        parts = {"recent": recent, "earlier": since & ~recent, "before": ~since}
        for part, test in parts.items():
            self.events[f"{name}_{part}"] = F.bool_or(own & test)
        seen = {part: F.coalesce(f"{name}_{part}", F.lit(False)) for part in parts}
        if c.value == "stopped_performing_event":
            return seen["earlier"] & ~seen["recent"]
        return seen["recent"] & ~seen["earlier"] & seen["before"]

    def test(self, c: Person | InCohort | Behavior, cohorts: dict[str, Group]) -> Column:
        """Whether the row of a visitor meets the criterion; equal criteria are computed once."""
        bare = repr(replace(c, negation=False))
        if bare not in self.known:
            name = f"f{len(self.known)}"
            if isinstance(c, Person):
                self.profiles[name] = F.bool_or(F.coalesce(predicate(PropertyFilter(c.key, c.operator, c.value, "person")), F.lit(False)))
                self.known[bare] = F.coalesce(name, F.lit(False))
            elif isinstance(c, Behavior):
                self.known[bare] = self._behaviour(c, name)
            elif c.key in cohorts:
                self.known[bare] = F.col(f"in_{list(cohorts).index(c.key)}")
            else:
                self.members[name] = F.bool_or(F.col("cohort_id") == c.key)
                self.known[bare] = F.coalesce(name, F.lit(False))
        return F.col("known") & ~self.known[bare] if c.negation else self.known[bare]

    def tree(self, group: Group, cohorts: dict[str, Group]) -> Column:
        parts = [self.tree(v, cohorts) if isinstance(v, Group) else self.test(v, cohorts) for v in group.values]
        if not parts:
            return F.lit(False)
        return reduce(Column.__or__ if group.join == "OR" else Column.__and__, parts)

    def rows(self, p: People) -> DataFrame:
        """One row of flags per visitor; ``known`` marks those with a session or a profile."""
        sources = [p.sessions.groupBy("visitor_id").agg(F.lit(True).alias("known"))]
        sources.append(p.profiles.groupBy("visitor_id").agg(F.lit(True).alias("known"), *[c.alias(n) for n, c in self.profiles.items()]))
        if self.events:
            rows = p.events.filter(reduce(Column.__or__, self.matches))
            sources.append(rows.groupBy("visitor_id").agg(*[c.alias(n) for n, c in self.events.items()]))
        if self.members:
            if p.members is None:
                raise ValueError("a criterion refers to a cohort that is neither given nor stored")
            sources.append(p.members.groupBy("visitor_id").agg(*[c.alias(n) for n, c in self.members.items()]))
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
        flags = [F.max(n).alias(n) for n in rows.columns if n not in ("visitor_id", "known")]
        return rows.groupBy("visitor_id").agg(F.coalesce(F.bool_or("known"), F.lit(False)).alias("known"), *flags)


def flagged(p: People, cohorts: dict[str, Group], now: str) -> DataFrame:
    """``visitor_id`` and one column of flags, ``in_0`` and so on in the order of evaluation, for every visitor found.

    Cohorts may refer to each other; a cohort that is not among ``cohorts`` is
    looked up in the stored members.
    """
    ordered = {name: cohorts[name] for name in evaluation_order(cohorts)}
    flags = _Flags(datetime.fromisoformat(now))
    tests = [flags.tree(group, ordered) for group in ordered.values()]
    rows = flags.rows(p)
    for i, test in enumerate(tests):
        rows = rows.withColumn(f"in_{i}", test)
    return rows.select("visitor_id", *[f"in_{i}" for i in range(len(tests))])


def members_of(p: People, group: Group, now: str) -> DataFrame:
    """Visitors of a criteria tree: all parts for AND, any part for OR."""
    return flagged(p, {"": group}, now).filter("in_0").select("visitor_id")


def criterion(p: People, c: Person | InCohort | Behavior, now: datetime) -> DataFrame:
    return members_of(p, Group("AND", (c,)), str(now))


def references(group: Group) -> set[str]:
    out: set[str] = set()
    for v in group.values:
        out |= references(v) if isinstance(v, Group) else {v.key} if isinstance(v, InCohort) else set()
    return out


def evaluation_order(cohorts: dict[str, Group]) -> list[str]:
    """Cohorts with the ones they refer to first; a cycle is an error."""
    order: list[str] = []
    state: dict[str, str] = {}

    def visit(name: str) -> None:
        if state.get(name) == "open":
            raise ValueError(f"cohort {name} refers to itself")
        if name in state or name not in cohorts:
            return
        state[name] = "open"
        for other in sorted(references(cohorts[name])):
            visit(other)
        state[name] = "done"
        order.append(name)

    for name in cohorts:
        visit(name)
    return order


def recalculate(p: People, cohorts: dict[str, Group], now: str) -> DataFrame:
    """``cohort_id, visitor_id`` of all cohorts; stored members of others are kept."""
    names = evaluation_order(cohorts)
    mine = F.array_compact(F.array(*[F.when(F.col(f"in_{i}"), F.lit(name)) for i, name in enumerate(names)]))
    found = flagged(p, cohorts, now).select(F.explode(mine).alias("cohort_id"), "visitor_id")
    if p.members is None:
        return found
    return p.members.filter(~F.col("cohort_id").isin(names)).select("cohort_id", "visitor_id").unionByName(found)


def size_history(members: DataFrame, at: str) -> DataFrame:
    """One count per cohort, to append to the size history."""
    return members.groupBy("cohort_id").agg(F.count("*").alias("count")).withColumn("calculated_at", calendar.instant(at))


def write_members(members: DataFrame, path: str) -> None:
    """Replace the member files of every cohort in the frame."""
    members.write.mode("overwrite").partitionBy("cohort_id").parquet(path)


def add_members(current: DataFrame, cohort_id: str, visitors: DataFrame) -> DataFrame:
    added = visitors.select(F.lit(cohort_id).alias("cohort_id"), "visitor_id")
    return current.select("cohort_id", "visitor_id").unionByName(added).distinct()


def remove_members(current: DataFrame, cohort_id: str, visitors: DataFrame) -> DataFrame:
    gone = visitors.select(F.lit(cohort_id).alias("cohort_id"), "visitor_id")
    return current.join(gone, ["cohort_id", "visitor_id"], "left_anti")


def duplicate(current: DataFrame, cohort_id: str, new_id: str) -> DataFrame:
    copy = current.filter(F.col("cohort_id") == cohort_id).select(F.lit(new_id).alias("cohort_id"), "visitor_id")
    return current.select("cohort_id", "visitor_id").unionByName(copy)


# Names that mark a header line.
HEADER_NAMES = ["visitor_id", "user_id", "distinct_id", "id", "email"]


def read_id_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, is_first`` of every line of the uploaded files."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    heads = lines.filter(F.col("_start") == 0).groupBy("_file").agg(F.min("_id").alias("_head"))
    joined = lines.join(broadcast_if_small(heads), "_file", "left")
    return joined.select("value", (F.col("_id") == F.col("_head")).alias("is_first"))


def ids_from_csv(lines: DataFrame) -> DataFrame:
    """First field of every line; quotes, blanks and a header line are dropped."""
    first = F.trim(F.get(F.split("value", ","), F.lit(0)))
    bare = F.trim(F.regexp_replace(first, '^"+|"+$', ""))
    ids = lines.select(bare.alias("visitor_id"), "is_first")
    header = F.col("is_first") & F.lower("visitor_id").isin(HEADER_NAMES)
    return ids.filter((F.col("visitor_id") != "") & ~header).select("visitor_id").distinct()


def resolve_visitors(ids: DataFrame, profiles: DataFrame, aliases: DataFrame, sessions: DataFrame) -> DataFrame:
    """``input_id, visitor_id`` pairs; ids found nowhere keep a NULL visitor."""
    def pairs(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col(key).alias("input_id"), "visitor_id")

    known = reduce(
        DataFrame.unionByName,
        [pairs(profiles, "visitor_id"), pairs(profiles, "user_id"), pairs(aliases, "alias_id"), pairs(sessions, "visitor_id")],
    ).filter(F.col("input_id").isNotNull()).distinct()
    return ids.select(F.col("id").alias("input_id")).distinct().join(known, "input_id", "left")


def member_list(members: DataFrame, profiles: DataFrame, cohort_id: str) -> DataFrame:
    side = profiles.select("visitor_id", "user_id", "traits")
    return members.filter(F.col("cohort_id") == cohort_id).join(side, "visitor_id", "left")


def static_from_actors(actors: DataFrame, cohort_id: str, id_column: str = "actor_id") -> DataFrame:
    """A static cohort of everyone an actors query returns."""
    return actors.select(F.lit(cohort_id).alias("cohort_id"), F.col(id_column).alias("visitor_id")).distinct()
