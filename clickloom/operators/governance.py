"""Tracking plans, event validation and the catalogue of observed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.functions.calendar import instant
from clickloom.functions.props import bind
from clickloom.operators.trends import page
from clickloom.plans.small import broadcast_if_small, with_row

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
VARIANT_MAP = "map<string,variant>"


def type_name(value: Column) -> Column:
    """JSON type of a variant: null, boolean, integer, number, string, array or object."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.lit(None))
        .when(kind == "VOID", "null")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$"), "integer")
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("string")
    )


def matches_type(value: Column, expected: Column) -> Column:
    name = type_name(value)
    text = F.try_variant_get(value, "$", "string")
    stamp = (name == "string") & text.rlike(RFC3339) & text.try_cast("timestamp").isNotNull()
    return (
        F.when(expected == "any", F.lit(True))
        .when(expected == "number", name.isin("integer", "number"))
        .when(expected.isin("boolean", "bool"), name == "boolean")
        .when(expected.isin("timestamp", "datetime"), stamp)
        .when(expected.isin("string", "integer", "object", "array", "null"), name == expected)
        .otherwise(F.lit(False))
    )


def lookup(root: Column, path: Column) -> Column:
    """The variant at a dotted path, NULL where a part is missing."""
    return F.aggregate(F.split(path, r"\."), root, lambda acc, part: F.try_variant_get(acc, "$", VARIANT_MAP)[part])


def pick_schemas(schemas: DataFrame, plan_id: str | None) -> DataFrame:
    """One schema per event: the active plan's before a global one, newest first."""
    usable = schemas.filter(F.col("plan_id").isNull() | (F.col("plan_id") == plan_id if plan_id else F.lit(False)))
    order = Window.partitionBy("event_name").orderBy(
        F.col("plan_id").isNull(), F.desc("updated_at"), F.col("schema_id")
    )  # the few schemas of one event
    return usable.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def validate_events(events: DataFrame, schemas: DataFrame, mode: str = "observe") -> DataFrame:
    """Events with their ``violations`` and whether they are ``accepted``.

    ``schemas`` holds ``event_name, status, rules`` with rules as
    ``array<struct<field, type, required>>``, one row per event name.
    """
    if mode not in ("observe", "reject"):
        raise ValueError("mode must be 'observe' or 'reject'")
    side = schemas.select("event_name", F.col("status").alias("_status"), F.col("rules").alias("_rules"))
    joined = events.join(broadcast_if_small(side), "event_name", "left")
    root = F.try_parse_json("event_data")
    none = F.lit(None).cast("string")

    def violation(kind: str, prop: Column, expected: Column, actual: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("violation_type"), prop.alias("property"), expected.alias("expected_type"), actual.alias("actual_type")
        )

    def check(entry: Column) -> Column:
        rule, value = entry["rule"], entry["value"]
        filled = F.coalesce(value.isNotNull() & (type_name(value) != "null"), F.lit(False))
        missing = rule["required"] & ~filled
        wrong = filled & rule["type"].isNotNull() & ~matches_type(value, rule["type"])
        return F.when(missing, violation("missing_required_property", rule["field"], none, none)).when(
            wrong, violation("property_type_mismatch", rule["field"], rule["type"], type_name(value))
        )

    def with_values(document: Column) -> Column:
        return F.transform(rules, lambda r: F.struct(r.alias("rule"), lookup(document, r["field"]).alias("value")))

    rules = F.coalesce("_rules", F.array().cast("array<struct<field:string,type:string,required:boolean>>"))
    # The document is bound to a lambda variable, so each payload is parsed once.
    entries = bind(root, with_values)
    unknown = F.when(F.col("_status").isNull(), violation("unknown_event", none, none, none))
    unapproved = F.when(F.col("_status") != "approved", violation("unapproved_event", none, none, none))
    found = F.array_compact(
        F.concat(F.array(unknown, unapproved), F.transform(entries, check))
    )
    out = joined.withColumn("violations", found)
    accepted = F.lit(True) if mode == "observe" else F.size("violations") == 0
    return out.withColumn("accepted", accepted).drop("_status", "_rules")


def violation_rows(validated: DataFrame) -> DataFrame:
    """One row per violation, ready to append."""
    return validated.select("event_id", "event_name", "visitor_id", "created_at", F.explode("violations").alias("v")).select(
        "event_id", "event_name", "visitor_id", "created_at", "v.*"
    )


def list_violations(rows: DataFrame, event_name: str | None = None, kind: str | None = None, limit: int | None = 100, offset: int = 0) -> DataFrame:
    if event_name:
        rows = rows.filter(F.col("event_name") == event_name)
    if kind:
        rows = rows.filter(F.col("violation_type") == kind)
    return page(rows, [F.desc("created_at"), F.desc("event_id"), F.col("property")], limit, offset)


def coverage(events: DataFrame, schemas: DataFrame, now: str, plan_id: str | None) -> DataFrame:
    """Observed and approved-schema event names of the last day."""
    recent = events.filter(F.col("created_at") >= instant(now) - F.expr("INTERVAL 24 HOURS"))
    approved = schemas.filter(F.col("status") == "approved")
    if plan_id:
        approved = approved.filter(F.col("plan_id").isNull() | (F.col("plan_id") == plan_id))
    names = recent.select("event_name").distinct()
    covered = approved.select("event_name").distinct().withColumn("_ok", F.lit(True))
    return names.join(covered, "event_name", "left").agg(
        F.count("*").alias("observed_events_24h"), F.count("_ok").alias("covered_events_24h")
    )


VIOLATIONS = {
    "unknown_event": "unknown_events_24h", "unapproved_event": "unapproved_events_24h",
    "missing_required_property": "missing_property_violations_24h", "property_type_mismatch": "type_mismatch_violations_24h",
}


def governance_health(events: DataFrame, schemas: DataFrame, violations: DataFrame, now: str, plan_id: str | None) -> DataFrame:
    recent = violations.filter(F.col("created_at") >= instant(now) - F.expr("INTERVAL 24 HOURS"))
    counts = recent.agg(
        F.count("*").alias("violations_24h"), *[F.count_if(F.col("violation_type") == k).alias(n) for k, n in VIOLATIONS.items()]
    )
    row = with_row(coverage(events, schemas, now, plan_id), counts)
    ratio = F.when(F.col("observed_events_24h") == 0, 1.0).otherwise(F.col("covered_events_24h") / F.col("observed_events_24h"))
    row = row.withColumn("coverage_ratio", ratio)
    status = (
        F.when(F.lit(plan_id is None), "not_configured")
        .when((F.col("unknown_events_24h") > 0) | (F.col("coverage_ratio") < 0.8), "critical")
        .when((F.col("violations_24h") > 0) | (F.col("coverage_ratio") < 1.0), "warning")
        .otherwise("healthy")
    )
    return row.withColumn("status", status)


def top_violations(violations: DataFrame, now: str, limit: int = 10) -> DataFrame:
    recent = violations.filter(F.col("created_at") >= instant(now) - F.expr("INTERVAL 24 HOURS"))
    counts = recent.groupBy("event_name", "violation_type").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "event_name", "violation_type").limit(limit)


# Definitions.


def event_definitions(ev: DataFrame, documented: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Volume, users and last use per event; documented but unseen events have none."""
    seen = ev.groupBy(F.col("event").alias("name")).agg(
        F.count("*").alias("volume"), F.count_distinct("visitor_id").alias("unique_users"), F.max("created_at").alias("last_seen")
    )
    if documented is not None:
        seen = seen.join(documented, "name", "full_outer").fillna(0, ["volume", "unique_users"])
    return page(seen, [F.desc("volume"), F.col("name")], limit)


# Property types of JSON values.
PROPERTY_TYPES = {"integer": "Numeric", "number": "Numeric", "boolean": "Boolean", "object": "Object", "array": "Array"}
DATE_LIKE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2})?"


def property_type(value: Column) -> Column:
    name, text = type_name(value), F.try_variant_get(value, "$", "string")
    out = F.when((name == "string") & text.rlike(DATE_LIKE), "DateTime")
    for json_type, shown in PROPERTY_TYPES.items():
        out = out.when(name == json_type, shown)
    return out.otherwise("String")


def dominant_types(counts: DataFrame) -> DataFrame:
    """The most frequent type per name with the total over types."""
    return counts.groupBy("name").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "type"))["type"].alias("property_type"),
        F.sum("n").alias("seen"),
    )


def property_definitions(documents: DataFrame, column: str, documented: DataFrame | None = None) -> DataFrame:
    """Observed JSON keys of all rows with their dominant type."""
    entries = documents.select(F.explode(F.from_json(column, VARIANT_MAP)).alias("name", "value"))
    counts = entries.groupBy("name", property_type(F.col("value")).alias("type")).agg(F.count("*").alias("n"))
    out = dominant_types(counts)
    if documented is not None:
        out = out.join(documented, "name", "full_outer").fillna(0, ["seen"]).fillna("String", ["property_type"])
    return out


def search_definitions(definitions: DataFrame, search: str | None = None, include_hidden: bool = False) -> DataFrame:
    """Definitions whose name, description or a tag holds the text."""
    out = definitions if include_hidden else definitions.filter(~F.coalesce("hidden", F.lit(False)))
    if search:
        needle = search.lower()
        def held(c: Column) -> Column:
            return F.coalesce(F.lower(c).contains(needle), F.lit(False))

        tagged = F.exists(F.coalesce("tags", F.array().cast("array<string>")), held)
        out = out.filter(held(F.col("name")) | held(F.col("description")) | tagged)
    return out


def explore_events(ev: DataFrame, before: str | None = None, names: list[str] | None = None, test: Column | None = None, limit: int = 100) -> DataFrame:
    """Newest events before a time; one row more than asked tells that there are more."""
    out = ev if before is None else ev.filter(F.col("created_at") < instant(before))
    if names:
        out = out.filter(F.col("event").isin(names))
    if test is not None:
        out = out.filter(test)
    return out.orderBy(F.desc("created_at"), F.desc("event_id")).limit(limit + 1)
