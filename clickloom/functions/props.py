"""Property filters compiled to boolean columns; NULL never matches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

# Session columns that a filter may read, the number pattern and
# the date pattern.
SESSION_FIELDS = (
    "country", "region", "city", "browser", "os", "device_type", "screen", "language", "entry_page",
    "exit_page", "hostname", "is_bounce", "pageview_count", "event_count", "duration_ms",
)
NUMBER = r"^\s*-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?\s*$"
DATE = r"^\d{4}-\d{2}-\d{2}"
MAX_DEPTH = 5


@dataclass(frozen=True)
class PropertyFilter:
    key: str
    operator: str = "exact"
    value: Any = None
    type: str = "event"
    group_type_index: int | None = None


@dataclass(frozen=True)
class FilterGroup:
    type: str = "AND"
    values: tuple["FilterGroup | PropertyFilter", ...] = field(default_factory=tuple)


def property_text(key: str, scope: str = "event", group: int | None = None) -> Column:
    """The property as text, looked up in its scope."""
    if scope == "event":
        return F.col("properties")[key]
    if scope == "session":
        if key not in SESSION_FIELDS:
            raise ValueError(f"unknown session property {key!r}")
        return F.col(f"s_{key}").cast("string")
    if scope == "person":
        return F.col("user_id") if key == "user_id" else F.col("traits")[key]
    if scope == "group":
        if group is None:
            raise ValueError("group properties need group_type_index")
        return F.col(f"g{group}_properties")[key]
    raise ValueError(f"unknown property type {scope!r}")


def safe_number(text: Column) -> Column:
    """The text as a double when it is a plain decimal number, else NULL."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def _texts(value: Any) -> list[str]:
    items = value if isinstance(value, (list, tuple)) else [value]
    return [str(v).lower() if isinstance(v, bool) else str(v) for v in items]


def _instant(text: Column) -> Column:
    return F.when(text.rlike(DATE), text.try_cast("timestamp"))


def predicate(f: PropertyFilter) -> Column:
    """One filter as a column; a cohort filter reads a flag from `attach_cohorts`."""
    if f.type == "cohort":
        member = F.coalesce(F.col(cohort_flag(f.value)), F.lit(False))
        return ~member if f.operator == "is_not" else member
    text = property_text(f.key, f.type, f.group_type_index)
    return compare(text, f.operator, f.value)


def compare(text: Column, operator: str, value: Any) -> Column:
    if operator == "exact":
        return text.isin(_texts(value))
    if operator == "is_not":
        return text.isNull() | ~text.isin(_texts(value))
    if operator == "icontains":
        return F.contains(F.lower(text), F.lit(str(value).lower()))
    if operator == "not_icontains":
        return text.isNull() | ~F.contains(F.lower(text), F.lit(str(value).lower()))
    if operator == "regex":
        return text.rlike(str(value))
    if operator == "not_regex":
        return text.isNull() | ~text.rlike(str(value))
    if operator in ("gt", "gte", "lt", "lte"):
        number, bound = safe_number(text), F.lit(float(value))
        return {"gt": number > bound, "gte": number >= bound, "lt": number < bound, "lte": number <= bound}[operator]
    if operator == "is_set":
        return text.isNotNull()
    if operator == "is_not_set":
        return text.isNull()
    if operator in ("is_date_before", "is_date_after"):
        bound = F.lit(str(value)).cast("timestamp")
        return _instant(text) < bound if operator == "is_date_before" else _instant(text) > bound
    raise ValueError(f"unknown operator {operator!r}")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def all_of(columns: Iterable[Column]) -> Column:
    return reduce(and_, columns, F.lit(True))


def any_of(columns: Iterable[Column]) -> Column:
    return reduce(or_, columns, F.lit(False))


def and_filters(filters: Sequence[PropertyFilter]) -> Column:
    return all_of(predicate(f) for f in filters)


def group_predicate(group: FilterGroup, depth: int = 1) -> Column:
    """A nested AND/OR tree; an empty group holds for every row."""
    if depth > MAX_DEPTH:
        raise ValueError("filter groups are nested too deeply")
    if not group.values:
        return F.lit(True)
    parts = [
        group_predicate(v, depth + 1) if isinstance(v, FilterGroup) else predicate(v) for v in group.values
    ]
    return all_of(parts) if group.type == "AND" else any_of(parts)


def leaves(group: FilterGroup | None) -> list[PropertyFilter]:
    out: list[PropertyFilter] = []
    for v in group.values if group else ():
        out.extend(leaves(v) if isinstance(v, FilterGroup) else [v])
    return out


def cohort_flag(cohort_id: Any) -> str:
    return "_cohort_" + re.sub(r"\W", "_", str(cohort_id))


def attach_cohorts(df: DataFrame, filters: Sequence[PropertyFilter], members: DataFrame) -> DataFrame:
    """Left-join one membership flag for every cohort that the filters name."""
    for cohort in sorted({str(f.value) for f in filters if f.type == "cohort"}):
        flag = members.filter(F.col("cohort_id") == cohort).select("visitor_id").distinct()
        df = df.join(flag.withColumn(cohort_flag(cohort), F.lit(True)), "visitor_id", "left")
    return df


def filter_cohort(df: DataFrame, cohort_id: str, members: DataFrame, negated: bool = False) -> DataFrame:
    """Keep (or drop) the rows of a cohort's members."""
    side = members.filter(F.col("cohort_id") == cohort_id).select("visitor_id")
    return df.join(side, "visitor_id", "left_anti" if negated else "left_semi")
