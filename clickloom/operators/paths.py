"""User paths through pages and events, and page-to-page flows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions.props import FilterGroup, PropertyFilter, and_filters, bind, group_predicate
from clickloom.functions.stats import percent
from clickloom.operators.trends import in_range, page
from clickloom.plans.ordered import MAX_ROWS, Following, Previous, Running, Timeline
from clickloom.sources.event_stream import PAGEVIEW



@dataclass(frozen=True)
class PathsQuery:
    date_from: str
    date_to: str
    pageviews: bool = True
    custom_events: bool = False
    start_point: str | None = None
    end_point: str | None = None
    exclude: tuple[str, ...] = ()
    step_limit: int = 5
    edge_limit: int | None = None
    min_edge_weight: int | None = None
    max_edge_weight: int | None = None
    cleaning: tuple[tuple[str, str], ...] = ()
    groupings: tuple[str, ...] = ()
    properties: tuple[PropertyFilter, ...] = ()
    filter_group: FilterGroup | None = None

    def validate(self) -> "PathsQuery":
        if not (self.pageviews or self.custom_events):
            raise ValueError("paths need at least one kind of event")
        if not 2 <= self.step_limit <= 20:
            raise ValueError("step_limit must be 2-20")
        return self


def wildcard_pattern(text: str) -> str:
    """``*`` matches anything; all other characters are literal."""
    return "^" + ".*".join(re.escape(part) for part in text.split("*")) + "$"


def _replacement(pattern: str, alias: str) -> Callable[[Column], Column]:
    return lambda x: F.when(x.rlike(pattern), F.regexp_replace(x, pattern, alias)).otherwise(x)


def clean_item(item: Column, rules: tuple[tuple[str, str], ...], groupings: tuple[str, ...]) -> Column:
    """All replacement rules in order, then the first wildcard that matches."""
    for pattern, alias in rules:
        item = bind(item, _replacement(pattern, alias))
    if not groupings:
        return item
    return bind(item, lambda x: F.coalesce(*[F.when(x.rlike(wildcard_pattern(g)), F.lit(g)) for g in groupings], x))


def path_items(ev: DataFrame, q: PathsQuery) -> DataFrame:
    q.validate()
    rows = in_range(ev, q.date_from, q.date_to)
    if not q.custom_events:
        rows = rows.filter(F.col("event") == PAGEVIEW)
    if not q.pageviews:
        rows = rows.filter(F.col("event") != PAGEVIEW)
    rows = rows.filter(and_filters(q.properties))
    if q.filter_group:
        rows = rows.filter(group_predicate(q.filter_group))
    name = F.when(F.col("event") == PAGEVIEW, F.coalesce(F.col("properties")["path"], F.lit("/"))).otherwise(F.col("event"))
    items = rows.select(
        "session_id", "visitor_id", "created_at", "event_id", clean_item(name, q.cleaning, q.groupings).alias("item")
    )
    return items.filter(~F.col("item").isin(list(q.exclude))) if q.exclude else items


def shape(items: DataFrame, q: PathsQuery, max_rows: int = MAX_ROWS) -> DataFrame:
    """``session_id, visitor_id, items`` with at most ``step_limit`` entries.

    Repeats collapse, then the start point, the end point and the step limit
    apply. All of it is done on ordered rows; only the kept steps of a session
    are gathered.
    """
    line = Timeline(items, ["session_id"], "created_at", ["event_id"], max_rows)
    line = line.with_columns({"before": Previous(F.col("item"))})
    line.df = line.df.filter(~F.col("item").eqNullSafe(F.col("before")))
    if q.start_point:
        line = line.with_columns({"started": Running(F.when(F.col("item") == q.start_point, 1).otherwise(0))})
        line.df = line.df.filter("started > 0")
    line = line.with_columns({"step": Running(F.lit(1))})
    if q.end_point:
        is_end = F.col("item") == q.end_point
        line = line.with_columns(
            {"ends": Running(F.when(is_end, 1).otherwise(0)), "next_end": Following(F.col("step"), is_end)}
        )
        # Rows up to the first end point, which is the step itself or the next one.
        first_end = F.when(is_end, F.col("step")).otherwise(F.col("next_end"))
        line.df = line.df.withColumn("end_step", first_end).filter(
            F.col("end_step").isNotNull() & ((F.col("ends") == 0) | (is_end & (F.col("ends") == 1)))
        )
        if not q.start_point:
            skipped = F.greatest(F.col("end_step") - q.step_limit, F.lit(0))
            line.df = line.df.withColumn("step", F.col("step") - skipped).filter("step > 0")
    kept = line.result().filter(F.col("step") <= q.step_limit)
    entry = F.struct("step", "item", F.unix_micros("created_at").alias("t"))
    return kept.groupBy("session_id").agg(
        F.first("visitor_id").alias("visitor_id"), F.array_sort(F.collect_list(entry)).alias("items")
    )


def session_paths(ev: DataFrame, q: PathsQuery, max_rows: int = MAX_ROWS) -> DataFrame:
    return shape(path_items(ev, q), q, max_rows)


def _node(e: Column) -> Column:
    return F.concat(e["step"].cast("string"), F.lit("_"), e["item"])


def edges(paths: DataFrame) -> DataFrame:
    """One row per move of a session: ``source, target, secs``."""
    pairs = F.zip_with(
        F.slice("items", 1, F.greatest(F.size("items") - 1, F.lit(0))),
        F.slice("items", 2, F.size("items")),
        lambda a, b: F.struct(
            _node(a).alias("source"), _node(b).alias("target"), ((b["t"] - a["t"]) / F.lit(1e6)).alias("secs")
        ),
    )
    return paths.select("session_id", "visitor_id", F.explode(pairs).alias("e")).select("session_id", "visitor_id", "e.*")


def weigh(moves: DataFrame, q: PathsQuery) -> DataFrame:
    """Edges with their session count and mean seconds, heaviest first."""
    out = moves.groupBy("source", "target").agg(F.count("*").alias("value"), F.avg("secs").alias("average_secs"))
    if q.min_edge_weight is not None:
        out = out.filter(F.col("value") >= q.min_edge_weight)
    if q.max_edge_weight is not None:
        out = out.filter(F.col("value") <= q.max_edge_weight)
    return page(out, [F.desc("value"), F.col("source"), F.col("target")], q.edge_limit)


def paths(ev: DataFrame, q: PathsQuery, max_rows: int = MAX_ROWS) -> DataFrame:
    return weigh(edges(session_paths(ev, q, max_rows)), q)


def path_actors(
    found: DataFrame, node: str | None = None, edge: tuple[str, str] | None = None, dropped_at: str | None = None,
    limit: int | None = 100, offset: int = 0,
) -> DataFrame:
    """Visitors through a node, along an edge, or whose path ended at a node."""
    nodes = F.transform("items", _node)
    if edge:
        steps = F.arrays_zip(
            F.slice(nodes, 1, F.greatest(F.size("items") - 1, F.lit(0))).alias("a"), F.slice(nodes, 2, F.size("items")).alias("b")
        )
        test = F.exists(steps, lambda s: (s["a"] == edge[0]) & (s["b"] == edge[1]))
    elif dropped_at:
        test = F.element_at(nodes, -1) == dropped_at
    else:
        test = F.array_contains(nodes, node)
    out = found.filter(test).groupBy(F.col("visitor_id").alias("actor")).agg(F.count("*").alias("sessions"))
    return page(out, [F.desc("sessions"), F.col("actor")], limit, offset)


def page_flows(
    pageviews: DataFrame, path: str, direction: str = "forward", limit: int | None = 10, max_rows: int = MAX_ROWS
) -> DataFrame:
    """Pages visited right after (or before) a page, with their share of the list."""
    line = Timeline(pageviews, ["session_id"], "created_at", ["event_id"], max_rows)
    step = Following(F.col("path")) if direction == "forward" else Previous(F.col("path"))
    near = line.with_columns({"near": step}).result().filter((F.col("path") == path) & F.col("near").isNotNull())
    ends = ["path", "near"] if direction == "forward" else ["near", "path"]
    moves = near.select(F.col(ends[0]).alias("from_path"), F.col(ends[1]).alias("to_path"))
    counts = moves.groupBy("from_path", "to_path").agg(F.count("*").alias("transitions"))
    head = page(counts, [F.desc("transitions"), F.col("from_path"), F.col("to_path")], limit)
    total = head.agg(F.sum("transitions")).scalar()
    return head.withColumn("percentage", percent(F.col("transitions"), total))
