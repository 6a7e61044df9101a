"""Property filters (FLT01-FLT22) over the whole event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.catalog.oracle import EV, PROFILES, SESS, r4
from clickloom.catalog.registry import query
from clickloom.functions import targeting
from clickloom.functions.props import (
    FilterGroup, PropertyFilter as P, and_filters, attach_cohorts, filter_cohort, group_predicate, leaves,
    property_text, safe_number,
)
from clickloom.operators.segments import RuleSet, SegmentCondition, evaluate
from clickloom.operators.trends import actor
from clickloom.sources.event_stream import join_groups, join_profiles, join_sessions

START, END = "2024-01-08", "2024-01-22"
NATIONS = "nat AS (SELECT CAST(c_custkey AS VARCHAR) AS nat_visitor, n_name AS group_0, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
# Event properties in SQL: k and path for all; title, utm for views; revenue for purchases.
PROPS = """fe AS (SELECT e.* REPLACE (
    CASE WHEN event = '$pageview' THEN title END AS title,
    CASE WHEN event = '$pageview' THEN utm_source END AS utm_source), p.plan, p.balance, p.since, p.user_id
  FROM ev e LEFT JOIN profiles p USING (visitor_id))"""


def _count(df):
    return df.groupBy("event").agg(
        F.count("*").alias("n"), F.count_distinct("visitor_id").alias("visitors"), F.sum("event_id").alias("id_sum")
    )


def _sql(where: str) -> str:
    return (
        f"WITH {EV}, {PROFILES}, {PROPS} SELECT event, count(*) AS n, count(DISTINCT visitor_id) AS visitors, "
        f"CAST(sum(event_id) AS BIGINT) AS id_sum FROM fe WHERE {where} GROUP BY event"
    )


def _filter_query(name: str, f: P | FilterGroup, where: str) -> None:
    def run(m):
        ev = m.stream()
        people = any(x.type == "person" for x in ([f] if isinstance(f, P) else leaves(f)))
        if people:
            ev = join_profiles(ev, m.profiles)
        return _count(ev.filter(group_predicate(f) if isinstance(f, FilterGroup) else and_filters([f])))

    query(name, _sql(where))(run)


_filter_query("FLT03_exact", P("k", "exact", [1, 2, "37"]), "k IN (1, 2, 37)")
_filter_query("FLT04_is_not", P("title", "is_not", "Home"), "title IS NULL OR title <> 'Home'")
_filter_query("FLT05_icontains", P("plan", "icontains", "BUIL", "person"), "contains(lower(plan), 'buil')")
_filter_query("FLT06_not_icontains", P("utm_source", "not_icontains", "OO"), "utm_source IS NULL OR NOT contains(utm_source, 'oo')")
_filter_query("FLT07_regex", P("path", "regex", "^/p[1-3]$"), "regexp_matches(path, '^/p[1-3]$')")
_filter_query("FLT08_not_regex", P("title", "not_regex", "^D"), "title IS NULL OR NOT regexp_matches(title, '^D')")
for _op, _sign in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    _filter_query(f"FLT09_{_op}", P("k", _op, 50), f"k {_sign} 50")
_filter_query("FLT10_is_set", P("utm_source", "is_set"), "utm_source IS NOT NULL")
_filter_query("FLT11_is_not_set", P("revenue", "is_not_set"), "revenue_amount IS NULL")
_filter_query("FLT12_is_date_before", P("since", "is_date_before", "2023-05-01", "person"), "since <> 'n/a' AND since < '2023-05-01'")
_filter_query("FLT12_is_date_after", P("since", "is_date_after", "2023-05-01", "person"), "since <> 'n/a' AND since > '2023-05-01'")


@query("FLT13_flat_and", _sql("k > 20 AND path = '/p3' AND plan = 'BUILDING'"))
def _(m):
    filters = [P("k", "gt", 20), P("path", "exact", "/p3"), P("plan", "exact", "BUILDING", "person")]
    return _count(join_profiles(m.stream(), m.profiles).filter(and_filters(filters)))


_filter_query(
    "FLT14_nested_groups",
    FilterGroup("OR", (
        FilterGroup("AND", (P("k", "lt", 10), P("path", "exact", "/p1"))),
        FilterGroup("AND", (P("plan", "exact", "MACHINERY", "person"), FilterGroup("OR", (P("k", "gt", 90), P("revenue", "gte", 40))))),
    )),
    "(k < 10 AND path = '/p1') OR (plan = 'MACHINERY' AND (k > 90 OR revenue_amount >= 40))",
)


@query(
    "FLT01_property_scopes",
    f"WITH {SESS}, {PROFILES}, {NATIONS} SELECT e.event_id, CAST(e.k AS VARCHAR) AS event_k, s.browser AS session_browser, "
    "p.plan AS person_plan, p.user_id AS person_user, region AS group_region FROM evs e JOIN sessions s USING (session_id) "
    "LEFT JOIN profiles p ON p.visitor_id = e.visitor_id LEFT JOIN nat ON nat_visitor = e.visitor_id",
)
def _(m):
    ev = m.stream(sessions=True)
    nations = m.grouped_ev.select("event_id", F.col("properties")["$group_0"].alias("g"))
    ev = ev.join(nations, "event_id", "left").withColumn(
        "properties", F.map_concat("properties", F.map_filter(F.create_map(F.lit("$group_0"), F.col("g")), lambda _, v: v.isNotNull()))
    )
    ev = join_groups(join_profiles(join_sessions(ev, m.sessions, ["browser"]), m.profiles), m.groups, [0])
    return ev.select(
        "event_id", property_text("k").alias("event_k"), property_text("browser", "session").alias("session_browser"),
        property_text("plan", "person").alias("person_plan"), property_text("user_id", "person").alias("person_user"),
        property_text("region", "group", 0).alias("group_region"),
    )


@query(
    "FLT02_safe_number",
    f"WITH {EV} SELECT event_id, {r4('revenue_amount')} AS revenue, CAST(NULL AS DOUBLE) AS from_path, "
    "CAST(k AS DOUBLE) AS k FROM ev",
)
def _(m):
    return m.stream().select(
        "event_id", safe_number(property_text("revenue")).alias("revenue"),
        safe_number(property_text("path")).alias("from_path"), safe_number(property_text("k")).alias("k"),
    )


def _members(m):
    return m.profiles.filter("uid % 4 = 1").select(F.lit("vip").alias("cohort_id"), "visitor_id").unionByName(
        m.profiles.filter("uid % 10 = 0").select(F.lit("tens").alias("cohort_id"), "visitor_id")
    )


@query("FLT15_cohort_member", _sql("uid % 4 = 1"))
def _(m):
    return _count(filter_cohort(m.stream(), "vip", _members(m)))


@query("FLT15_cohort_in_or_group", _sql("uid % 10 = 0 OR (NOT uid % 4 = 1 AND k < 5)"))
def _(m):
    group = FilterGroup("OR", (
        P("id", "exact", "tens", "cohort"),
        FilterGroup("AND", (P("id", "is_not", "vip", "cohort"), P("k", "lt", 5))),
    ))
    return _count(attach_cohorts(m.stream(), leaves(group), _members(m)).filter(group_predicate(group)))


@query(
    "FLT18_group_actor",
    f"WITH {EV}, {NATIONS} SELECT group_0 AS actor_id, count(*) AS n FROM ev JOIN nat ON nat_visitor = visitor_id GROUP BY 1",
)
def _(m):
    ev = m.grouped_ev.withColumn("actor_id", actor(0)).filter(F.col("actor_id").isNotNull())
    return ev.groupBy("actor_id").agg(F.count("*").alias("n"))


_SEG = {
    "exists": (None, "true"), "not_exists": (None, "false"), "eq": ("BUILDING", "plan = 'BUILDING'"),
    "neq": ("BUILDING", "plan <> 'BUILDING'"), "contains": ("ILD", "contains(plan, 'ILD')"),
    "starts_with": ("MA", "starts_with(plan, 'MA')"), "ends_with": ("E", "ends_with(plan, 'E')"),
    "in": (["BUILDING", "FURNITURE"], "plan IN ('BUILDING', 'FURNITURE')"),
}


@query(
    "FLT19_condition_operators",
    f"WITH {PROFILES} SELECT visitor_id, "
    + ", ".join(f"({w}) AS op_{op}" for op, (_, w) in _SEG.items())
    + ", balance > 5000 AS op_gt, balance >= 5000 AS op_gte, balance < 0 AS op_lt, balance <= 0 AS op_lte, true AS neq_missing FROM profiles",
)
def _(m):
    plan, balance = F.col("traits")["plan"], F.col("traits")["balance"]
    return m.profiles.select(
        "visitor_id",
        *[targeting.holds(plan, op, value).alias(f"op_{op}") for op, (value, _) in _SEG.items()],
        *[targeting.holds(balance, op, v).alias(f"op_{op}") for op, v in (("gt", 5000), ("gte", 5000), ("lt", 0), ("lte", 0))],
        targeting.holds(F.col("traits")["absent"], "neq", "x").alias("neq_missing"),
    )


_VISITOR_FLAGS = f"""{SESS}, {PROFILES}, flags AS (
  SELECT v.visitor_id, coalesce(bool_or(p.plan = 'BUILDING'), false) AS is_plan,
    coalesce(bool_or(s.browser = 'Chrome'), false) AS is_chrome
  FROM (SELECT visitor_id FROM sessions UNION SELECT visitor_id FROM profiles) v
  LEFT JOIN profiles p USING (visitor_id) LEFT JOIN sessions s USING (visitor_id) GROUP BY 1),
acts AS (SELECT visitor_id, coalesce(bool_or(event = '$pageview' AND path = '/p7'), false) AS saw_p7,
    coalesce(bool_or(event = 'purchase' AND k > 80), false) AS big,
    count(*) FILTER (WHERE event = '$pageview') AS views
  FROM ev GROUP BY 1)"""


def _segment(match: str) -> RuleSet:
    return RuleSet(match, (
        SegmentCondition("profile", "traits.plan", "eq", "BUILDING"),
        SegmentCondition("session", "browser", "eq", "Chrome"),
        SegmentCondition("pageview", "path", "eq", "/p7"),
        SegmentCondition("event", "event_data.k", "gt", 80, event="purchase"),
        SegmentCondition("metric", "pageviews", "gte", 10),
    ))


for _match, _join in (("any", " OR "), ("all", " AND ")):
    _tests = _join.join(["is_plan", "is_chrome", "coalesce(saw_p7, false)", "coalesce(big, false)", "coalesce(views, 0) >= 10"])

    @query(
        "FLT20_condition_sources" if _match == "any" else "FLT21_match_all",
        f"WITH {_VISITOR_FLAGS} SELECT visitor_id FROM flags LEFT JOIN acts USING (visitor_id) WHERE {_tests}",
    )
    def _(m, match=_match):
        return evaluate(m, _segment(match)).select("visitor_id")


@query("FLT21_empty_matches_everyone", f"WITH {EV}, {PROFILES} SELECT count(*) AS n FROM (SELECT visitor_id FROM ev UNION SELECT visitor_id FROM profiles)")
def _(m):
    return evaluate(m, RuleSet()).agg(F.count("*").alias("n"))


@query(
    "FLT22_json_path",
    f"WITH {EV} SELECT event_id, CAST(k AS VARCHAR) AS k, CAST(k AS VARCHAR) AS nested, CAST(NULL AS VARCHAR) AS missing FROM ev",
)
def _(m):
    nested = F.concat(F.lit('{"a": {"b.c": 1, "b": '), F.col("props"), F.lit("}}"))
    return m.ev.select(
        "event_id", targeting.json_path(F.col("props"), "k").alias("k"), targeting.json_path(nested, "a.b.k").alias("nested"),
        targeting.json_path(nested, "a.x").alias("missing"),
    )
