"""Condition operators shared by segments, flags and remote config."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, functions as F

from clickloom.functions.props import all_of, any_of


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Rules:
    match: str = "all"
    conditions: tuple[Condition, ...] = field(default_factory=tuple)


def _text(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def holds(actual: Column, op: str, value: Any) -> Column:
    """The condition on a text column; a missing value equals nothing."""
    if op == "exists":
        return actual.isNotNull()
    if op == "not_exists":
        return actual.isNull()
    no = F.lit(False)
    if op == "eq":
        return F.coalesce(actual == _text(value), no)
    if op == "neq":
        return ~F.coalesce(actual == _text(value), no)
    if op == "contains":
        return F.coalesce(actual.contains(_text(value)), no)
    if op == "starts_with":
        return F.coalesce(actual.startswith(_text(value)), no)
    if op == "ends_with":
        return F.coalesce(actual.endswith(_text(value)), no)
    if op == "in":
        return F.coalesce(actual.isin([_text(v) for v in value]), no)
    if op in ("gt", "gte", "lt", "lte"):
        number, bound = actual.try_cast("double"), F.lit(float(value))
        test = {"gt": number > bound, "gte": number >= bound, "lt": number < bound, "lte": number <= bound}[op]
        return F.coalesce(test, no)
    return no


def json_path(document: Column | str, path: str) -> Column:
    """A dotted path inside a JSON text; key parts may hold any character."""
    steps = "".join(f"['{part}']" for part in path.split("."))
    return F.get_json_object(document, f"${steps}")


def map_path(column: str, path: str) -> Column:
    return F.col(column)[path]


def targeting_value(name: str) -> Column:
    """Visitor, user, trait or context value of a targeting condition."""
    if name in ("visitor_id", "user_id"):
        return F.col(name)
    for prefix in ("traits.", "trait."):
        if name.startswith(prefix):
            return map_path("traits", name[len(prefix):])
    if name.startswith("context."):
        return map_path("context", name[len("context."):])
    return F.coalesce(map_path("context", name), map_path("traits", name))


def matches(rules: Rules) -> Column:
    """Whether a row meets all or any of the conditions; none means everyone."""
    if not rules.conditions:
        return F.lit(True)
    tests = [holds(targeting_value(c.field), c.op, c.value) for c in rules.conditions]
    return any_of(tests) if rules.match == "any" else all_of(tests)
