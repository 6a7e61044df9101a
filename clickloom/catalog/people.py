"""Cohorts, segments, identity, groups and accounts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from clickloom.catalog.oracle import CONVERSIONS, EV, EVS, PROFILES, SESS, r4, ts
from clickloom.catalog.registry import query
from clickloom.functions.props import PropertyFilter as P
from clickloom.operators import cohorts as C, identity as I, segments as S
from clickloom.operators.cohorts import Behavior, Group, InCohort, People, Person
from clickloom.operators.trends import page
from clickloom.plans.graph import resolve_chains
from clickloom.sources.demo import NOW, pick
from clickloom.sources.event_stream import join_groups, join_profiles, join_sessions

EVP = f"{EV}, {PROFILES}, universe AS (SELECT visitor_id FROM ev UNION SELECT visitor_id FROM profiles)"
N = "TIMESTAMP '2024-01-31'"


def _people(m):
    stream = m.stream()
    return People(stream, m.ev.select("visitor_id").distinct(), m.profiles)


def _did(where: str) -> str:
    return f"SELECT DISTINCT visitor_id FROM ev WHERE created_at < {N} AND {where}"


_WEEK = f"created_at >= {N} - INTERVAL 7 DAY"
_CRITERIA = {
    "INS25_performed_event": (Behavior("performed_event", "purchase", 1), _did(f"event = 'purchase' AND created_at >= {N} - INTERVAL 1 DAY")),
    "INS25_with_properties": (
        Behavior("performed_event", "click", 3, event_properties=(P("k", "gt", 70),)),
        _did(f"event = 'click' AND k > 70 AND created_at >= {N} - INTERVAL 3 DAY"),
    ),
    "INS26_multiple_gte": (
        Behavior("performed_event_multiple", "click", 1, "week", count=4, count_operator="gte"),
        f"SELECT visitor_id FROM ev WHERE event = 'click' AND {_WEEK} GROUP BY 1 HAVING count(*) >= 4",
    ),
    "INS26_multiple_lte_with_zero": (
        Behavior("performed_event_multiple", "click", 1, "week", count=2, count_operator="lte"),
        f"SELECT visitor_id FROM universe LEFT JOIN (SELECT visitor_id, count(*) AS n FROM ev WHERE event = 'click' AND {_WEEK} GROUP BY 1) USING (visitor_id) WHERE coalesce(n, 0) <= 2",
    ),
    "INS27_stopped": (
        Behavior("stopped_performing_event", "purchase", 10, seq_time_value=3),
        f"{_did(f'''event = 'purchase' AND created_at >= {N} - INTERVAL 10 DAY AND created_at < {N} - INTERVAL 3 DAY''')} EXCEPT {_did(f'''event = 'purchase' AND created_at >= {N} - INTERVAL 3 DAY''')}",
    ),
    "INS28_restarted": (
        Behavior("restarted_performing_event", "purchase", 6, seq_time_value=3),
        f"({_did(f'''event = 'purchase' AND created_at >= {N} - INTERVAL 3 DAY''')} EXCEPT {_did(f'''event = 'purchase' AND created_at >= {N} - INTERVAL 6 DAY AND created_at < {N} - INTERVAL 3 DAY''')}) INTERSECT {_did(f'''event = 'purchase' AND created_at < {N} - INTERVAL 6 DAY''')}",
    ),
    "INS29_first_time": (
        Behavior("performed_event_first_time", "signup", 28),
        f"SELECT visitor_id FROM ev WHERE event = 'signup' GROUP BY 1 HAVING min(created_at) >= {N} - INTERVAL 28 DAY",
    ),
    "INS30_regularly": (
        Behavior("performed_event_regularly", "$pageview", 1, "day", min_periods=6, total_periods=10),
        f"SELECT visitor_id FROM ev WHERE event = '$pageview' AND created_at >= {N} - INTERVAL 10 DAY GROUP BY 1 HAVING count(DISTINCT date_trunc('day', created_at)) >= 6",
    ),
    "INS31_person_property": (Person("plan", "exact", ["BUILDING", "MACHINERY"]), "SELECT visitor_id FROM profiles WHERE plan IN ('BUILDING', 'MACHINERY')"),
    "SET05_negated_criterion": (
        Behavior("performed_event", "purchase", 1, negation=True),
        f"SELECT visitor_id FROM universe EXCEPT {_did(f'''event = 'purchase' AND created_at >= {N} - INTERVAL 1 DAY''')}",
    ),
}
for _name, (_criterion, _sql) in _CRITERIA.items():
    @query(_name, f"WITH {EVP} {_sql}")
    def _(m, c=_criterion):
        return C.criterion(_people(m), c, datetime.fromisoformat(NOW))

_RESTART = _CRITERIA["INS28_restarted"]


@query("SET06_except_intersect", f"WITH {EVP} {_RESTART[1]}")
def _(m):
    at, stream = F.col("created_at"), m.stream(names=["purchase"])
    recent, gap, before = "2024-01-28", "2024-01-25", "2024-01-25"
    a = stream.filter(at >= recent).select("visitor_id")
    b = stream.filter((at >= gap) & (at < recent)).select("visitor_id")
    return a.subtract(b).intersect(stream.filter(at < before).select("visitor_id"))


_BUY, _PLAN = Behavior("performed_event", "purchase", 1), Person("plan", "exact", "BUILDING")
_BUY_SQL, _PLAN_SQL = _CRITERIA["INS25_performed_event"][1], "SELECT visitor_id FROM profiles WHERE plan = 'BUILDING'"


@query("SET03_intersect_groups", f"WITH {EVP} {_BUY_SQL} INTERSECT {_PLAN_SQL}")
def _(m):
    return C.members_of(_people(m), Group("AND", (_BUY, _PLAN)), NOW)


@query("SET04_union_groups", f"WITH {EVP} {_BUY_SQL} UNION {_PLAN_SQL}")
def _(m):
    return C.members_of(_people(m), Group("OR", (_BUY, _PLAN)), NOW)


@query("SET01_union_all", f"WITH {EV} SELECT event, count(*) AS n FROM ev GROUP BY 1")
def _(m):
    return m.stream().groupBy("event").agg(F.count("*").alias("n"))


@query("SET02_union_visitors", f"WITH {EVP} SELECT visitor_id FROM universe")
def _(m):
    return _people(m).universe()


_COHORTS = {"fans": Group("AND", (InCohort("buyers"), InCohort("quiet", negation=True))), "buyers": Group("OR", (_BUY, _PLAN)),
            "quiet": Group("AND", (Behavior("performed_event_multiple", "click", 1, "week", count=2, count_operator="lte"),))}
_MEMBERS = f"""{EVP}, buyers AS ({_BUY_SQL} UNION {_PLAN_SQL}), quiet AS ({_CRITERIA['INS26_multiple_lte_with_zero'][1]}),
  members AS (SELECT 'buyers' AS cohort_id, visitor_id FROM buyers UNION ALL SELECT 'quiet', visitor_id FROM quiet
    UNION ALL SELECT 'fans', visitor_id FROM (SELECT visitor_id FROM buyers EXCEPT SELECT visitor_id FROM quiet))"""
for _name in ("INS32_nested_cohorts", "STR15_recalculated_cohorts"):
    @query(_name, f"WITH {_MEMBERS} SELECT * FROM members")
    def _(m):
        return C.recalculate(_people(m), _COHORTS, NOW)


@query("INS33_cohort_sizes", f"WITH {_MEMBERS} SELECT cohort_id, count(*) AS count, '2024-01-31T00:00:00' AS calculated_at FROM members GROUP BY 1")
def _(m):
    return C.size_history(C.recalculate(_people(m), _COHORTS, NOW), NOW)


def _static(m):
    return m.profiles.filter("uid % 4 = 1").select(F.lit("vip").alias("cohort_id"), "visitor_id")


@query("INS34_static_cohort", f"WITH {PROFILES}, v AS (SELECT visitor_id, uid FROM profiles WHERE (uid % 4 = 1 OR uid % 6 = 0) AND uid % 9 <> 0) SELECT 'vip' AS cohort_id, visitor_id FROM v UNION ALL SELECT 'vip2', visitor_id FROM v")
def _(m):
    added = C.add_members(_static(m), "vip", m.profiles.filter("uid % 6 = 0"))
    return C.duplicate(C.remove_members(added, "vip", m.profiles.filter("uid % 9 = 0")), "vip", "vip2")


@query("INS34_csv_ids", f"WITH {PROFILES} SELECT 'v ' || visitor_id AS visitor_id FROM profiles WHERE uid % 5 <> 0")
def _(m):
    v = F.col("visitor_id")
    line = F.when(F.col("uid") % 5 == 0, F.lit("  ,x")).when(F.col("uid") % 2 == 0, F.concat(F.lit('"v '), v, F.lit('",x'))).otherwise(F.concat(F.lit(" v "), v, F.lit(" ")))
    lines = m.profiles.select(line.alias("value"), F.lit(False).alias("is_first"))
    head = m.spark.range(1).select(F.lit("visitor_id,name").alias("value"), F.lit(True).alias("is_first"))
    return C.ids_from_csv(lines.unionByName(head))


@query("INS35_cohort_from_actors", f"WITH {EV} SELECT 'clickers' AS cohort_id, visitor_id FROM ev WHERE event = 'click' AND created_at >= TIMESTAMP '2024-01-30' GROUP BY 2")
def _(m):
    from clickloom.operators.trends import Series, TrendsQuery, trends_actors

    actors = trends_actors(m.stream(), TrendsQuery((Series("click"),), "2024-01-30", "2024-01-31"), 0, limit=None)
    return C.static_from_actors(actors, "clickers")


@query("JON04_cohort_semi_anti", f"WITH {EV} SELECT uid % 4 = 1 AS member, count(*) AS n FROM ev GROUP BY 1")
def _(m):
    from clickloom.functions.props import filter_cohort

    ev = m.stream()
    parts = [filter_cohort(ev, "vip", _static(m), neg).agg(F.count("*").alias("n")).withColumn("member", F.lit(not neg)) for neg in (False, True)]
    return parts[0].unionByName(parts[1])


@query("JON28_member_list", f"WITH {PROFILES} SELECT 'vip' AS cohort_id, visitor_id, user_id, plan FROM profiles WHERE uid % 4 = 1")
def _(m):
    return C.member_list(_static(m), m.profiles, "vip").withColumn("plan", F.col("traits")["plan"]).drop("traits")


def _aliases(m):
    return m.profiles.select(F.concat(F.lit("u"), F.floor(F.col("uid") / 3).cast("string")).alias("alias_id"), "visitor_id")


@query("JON15_resolve_visitors", f"""WITH {PROFILES}, ids AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN c_name WHEN 2 THEN 'u' || c_custkey ELSE 'none' END AS input_id FROM customer),
  known AS (SELECT visitor_id AS input_id, visitor_id FROM profiles UNION SELECT user_id, visitor_id FROM profiles UNION SELECT 'u' || (uid // 3), visitor_id FROM profiles)
  SELECT input_id, visitor_id FROM ids LEFT JOIN known USING (input_id)""")
def _(m):
    key, name = F.col("c_custkey").cast("string"), F.col("c_name")
    ids = m.table("customer").select(pick_case(F.col("c_custkey") % 4, key, name, F.concat(F.lit("u"), key), F.lit("none")).alias("id"))
    return C.resolve_visitors(ids, m.profiles, _aliases(m), m.ev.select("visitor_id").distinct())


def pick_case(index, *values):
    out = F
    for i, v in enumerate(values):
        out = out.when(index == i, v)
    return out


# Segments.

_SEGMENTS = {
    "builders": S.RuleSet("all", (S.SegmentCondition("profile", "traits.plan", "eq", "BUILDING"),)),
    "chrome_or_busy": S.RuleSet("any", (S.SegmentCondition("session", "browser", "eq", "Chrome"), S.SegmentCondition("metric", "events", "gt", 60))),
}
_SEG = f"""{SESS}, {PROFILES}, {CONVERSIONS}, cnt AS (SELECT visitor_id, count(*) AS n FROM ce GROUP BY 1),
  members AS (SELECT 'builders' AS segment, visitor_id FROM profiles WHERE plan = 'BUILDING'
    UNION ALL SELECT 'chrome_or_busy', visitor_id FROM (SELECT visitor_id FROM sessions WHERE browser = 'Chrome' UNION SELECT visitor_id FROM cnt WHERE n > 60)),
  mine AS (SELECT segment, visitor_id FROM members)"""
_SEG_METRICS = f"""SELECT segment, count(DISTINCT m.visitor_id) AS visitors,
    CAST(coalesce(sum(p), 0) AS BIGINT) AS pageviews, CAST(coalesce(sum(s), 0) AS BIGINT) AS sessions, CAST(coalesce(sum(e), 0) AS BIGINT) AS events, CAST(coalesce(sum(c), 0) AS BIGINT) AS conversions,
    {r4('coalesce(sum(c), 0) / count(DISTINCT m.visitor_id) * 100')} AS conversion_rate FROM mine m
  LEFT JOIN (SELECT visitor_id, count(*) AS p, count(DISTINCT session_id) AS s FROM pv GROUP BY 1) USING (visitor_id)
  LEFT JOIN (SELECT visitor_id, count(*) AS e FROM ce GROUP BY 1) USING (visitor_id) LEFT JOIN (SELECT visitor_id, count(*) AS c FROM conversions GROUP BY 1) USING (visitor_id) GROUP BY 1"""


@query("INS36_segment_evaluate", f"WITH {_SEG}, ses AS (SELECT visitor_id, count(*) AS s FROM sessions GROUP BY 1) SELECT m.visitor_id, coalesce(s, 0) AS sessions, coalesce(n, 0) AS events FROM mine m LEFT JOIN ses USING (visitor_id) LEFT JOIN cnt USING (visitor_id) WHERE segment = 'chrome_or_busy'")
def _(m):
    return S.evaluate(m, _SEGMENTS["chrome_or_busy"]).select("visitor_id", "sessions", "events")


@query("INS37_segment_compare", f"WITH {_SEG} {_SEG_METRICS}")
def _(m):
    return S.segment_metrics(S.memberships(m, _SEGMENTS), m)


@query("AGG66_segment_metrics", f"WITH {_SEG} {_SEG_METRICS} HAVING segment = 'builders'")
def _(m):
    return S.segment_metrics(S.memberships(m, {"builders": _SEGMENTS["builders"]}), m)


_BREAK = {
    "country": "SELECT visitor_id, coalesce(country, 'Unknown') AS value FROM sessions", "path": "SELECT visitor_id, path AS value FROM pv",
    "event": "SELECT visitor_id, event AS value FROM ce", "traits.plan": "SELECT visitor_id, plan AS value FROM profiles",
}
for _prop, _rows in _BREAK.items():
    for _name in (f"INS38_segment_breakdown_{_prop.split('.')[-1]}",) + (("AGG67_segment_breakdown",) if _prop == "country" else ()):
        @query(_name, f"WITH {_SEG} SELECT value, count(DISTINCT visitor_id) AS visitors FROM ({_rows}) JOIN mine USING (visitor_id) WHERE segment = 'chrome_or_busy' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
        def _(m, prop=_prop):
            members = S.memberships(m, {"chrome_or_busy": _SEGMENTS["chrome_or_busy"]})
            return S.breakdown(members, m, prop, limit=12)


# Property folds.

_UPD = f"""{EV}, ops AS (
  SELECT visitor_id, created_at AS t, event_id AS id, 'k' AS name, CAST(k AS VARCHAR) AS value, 1 AS kind FROM ev WHERE event = 'signup'
  UNION ALL SELECT visitor_id, created_at, event_id, 'path', path, 1 FROM ev WHERE event = 'signup'
  UNION ALL SELECT visitor_id, created_at, event_id, 'first', CAST(k AS VARCHAR), 0 FROM ev WHERE event = 'click'
  UNION ALL SELECT visitor_id, created_at, event_id, 'path', 'once' || path, 0 FROM ev WHERE event = 'click'
  UNION ALL SELECT visitor_id, created_at, event_id, unnest(['path', 'first']), NULL, 2 FROM ev WHERE event = 'error' AND k % 5 = 0),
  st AS (SELECT visitor_id, name, max((t, id)) FILTER (WHERE kind = 2) AS gone, max((t, id)) FILTER (WHERE kind = 1) AS put FROM ops GROUP BY 1, 2),
  res AS (SELECT s.visitor_id, s.name, CASE WHEN put IS NOT NULL AND (gone IS NULL OR put > gone) THEN
      (SELECT arg_max(value, (t, id)) FROM ops o WHERE o.visitor_id = s.visitor_id AND o.name = s.name AND kind = 1)
    ELSE (SELECT arg_min(value, (t, id)) FROM ops o WHERE o.visitor_id = s.visitor_id AND o.name = s.name AND kind = 0 AND (s.gone IS NULL OR (t, id) > s.gone)) END AS value FROM st s)"""


def _data(m):
    """Event payloads that set, set once and unset properties."""
    k = F.col("k").cast("string")
    sets = F.to_json(F.struct(F.struct(k.alias("k"), F.col("path")).alias("$set")))
    once = F.to_json(F.struct(F.struct(k.alias("first"), F.concat(F.lit("once"), F.col("path")).alias("path")).alias("$set_once")))
    data = F.when(F.col("event") == "signup", sets).when(F.col("event") == "click", once).when(
        (F.col("event") == "error") & (F.col("k") % 5 == 0), F.lit('{"$unset": ["path", "first", 3]}'))
    return m.ev.withColumn("event_data", data)


def _updates(m):
    rows = _data(m).filter(F.col("event_data").isNotNull())
    return rows.select("visitor_id", "created_at", "event_id", *[c.alias(n) for n, c in I.property_update(F.col("event_data")).items()])


def _traits(df, key="visitor_id"):
    return df.select(key, *[F.col("traits")[n].alias(n) for n in ("k", "path", "first")])


for _name in ("STR10_property_fold", "STR17_property_patches", "SCL18_trait_merge"):
    @query(_name, f"WITH {_UPD} SELECT visitor_id, max(value) FILTER (WHERE name = 'k') AS k, max(value) FILTER (WHERE name = 'path') AS path, max(value) FILTER (WHERE name = 'first') AS first FROM res WHERE value IS NOT NULL GROUP BY 1")
    def _(m, name=_name):
        if name != "SCL18_trait_merge":
            return _traits(I.fold_properties(_updates(m), ["visitor_id"]))
        # Two halves folded apart and merged onto each other give the same end.
        folded = I.fold_properties(_updates(m), ["visitor_id"])
        none = F.lit(None)
        merged = I.merge_traits(F.col("traits"), F.create_map(F.lit("k"), F.lit("unused")), none.cast("map<string,string>"), F.array(F.lit("absent")))
        has_k = F.map_contains_key("traits", "k")
        return _traits(folded.withColumn("traits", F.when(has_k, merged).otherwise(F.col("traits"))))


@query("SCL19_update_extraction", f"WITH {EV} SELECT event_id, CASE WHEN event = 'signup' THEN CAST(k AS VARCHAR) END AS set_k, CASE WHEN event = 'click' THEN CAST(k AS VARCHAR) END AS once_first, CASE WHEN event = 'error' AND k % 5 = 0 THEN 'path,first' END AS unset FROM ev WHERE event IN ('signup', 'click') OR (event = 'error' AND k % 5 = 0)")
def _(m):
    return _updates(m).select("event_id", F.col("set")["k"].alias("set_k"), F.col("set_once")["first"].alias("once_first"), F.array_join("unset", ",").alias("unset"))


def _identified(m):
    parts = I.property_update(F.col("event_data"))
    return _data(m).select(
        "visitor_id", "created_at", "event_id", *[c.alias(n) for n, c in parts.items()],
        F.when(F.col("event") == "signup", F.concat(F.lit("user"), (F.col("k") % 50).cast("string"))).alias("user_id"),
        (F.col("event") == "signup").alias("identified"),
    )


@query("STR10_profiles", f"WITH {EV} SELECT visitor_id, 'user' || (arg_max(k, (created_at, event_id)) FILTER (WHERE event = 'signup') % 50) AS user_id, {ts('min(created_at)')} AS first_seen_at, {ts('max(created_at)')} AS last_seen_at, {ts('''min(created_at) FILTER (WHERE event = 'signup')''')} AS identified_at FROM ev GROUP BY 1")
def _(m):
    return I.fold_profiles(_identified(m)).drop("traits")


def _account_rows(m):
    return m.ev.select(
        F.concat(F.lit("acc"), (F.col("uid") % 13).cast("string")).alias("account_id"), "visitor_id", "created_at", "event_id",
        F.when(F.col("event") == "signup", F.concat(F.lit("Name "), F.col("k").cast("string"))).alias("name"),
        F.when(F.col("event") == "click", pick(["admin", "member"], F.col("k"))).alias("role"),
        F.when(F.col("event") == "signup", F.concat(F.lit("user"), F.col("uid").cast("string"))).alias("user_id"),
        F.when(F.col("event") == "purchase", F.create_map(F.lit("tier"), F.col("path"))).alias("set"),
        F.lit(None).cast("map<string,string>").alias("set_once"), F.lit(None).cast("array<string>").alias("unset"),
    )


_ACC = "'acc' || (uid % 13)"
for _name in ("STR11_accounts", "STR12_groups"):
    @query(_name, f"WITH {EV} SELECT {_ACC} AS account_id, 'Name ' || arg_max(k, (created_at, event_id)) FILTER (WHERE event = 'signup') AS name, arg_max(path, (created_at, event_id)) FILTER (WHERE event = 'purchase') AS tier, {ts('min(created_at)')} AS first_seen_at FROM ev GROUP BY 1")
    def _(m, name=_name):
        if name == "STR12_groups":
            rows = _account_rows(m).withColumn("type_index", F.lit(0)).withColumnRenamed("account_id", "group_key")
            out = I.fold_accounts(rows, ["type_index", "group_key"]).withColumnRenamed("group_key", "account_id")
        else:
            out = I.fold_accounts(_account_rows(m))
        return out.select("account_id", "name", F.col("traits")["tier"].alias("tier"), "first_seen_at")


@query("STR11_memberships", f"WITH {EV} SELECT {_ACC} AS account_id, visitor_id, CASE arg_max(k, (created_at, event_id)) FILTER (WHERE event = 'click') % 2 WHEN 0 THEN 'admin' ELSE 'member' END AS role, 'user' || max(uid) FILTER (WHERE event = 'signup') AS user_id, {ts('max(created_at)')} AS last_seen_at FROM ev GROUP BY 1, 2".replace("CASE arg_max", "CASE WHEN count(*) FILTER (WHERE event = 'click') = 0 THEN NULL ELSE CASE arg_max").replace("'member' END AS role", "'member' END END AS role"))
def _(m):
    return I.memberships(_account_rows(m)).drop("first_seen_at")


_MEMB = f"members AS (SELECT DISTINCT {_ACC} AS account_id, visitor_id, CASE WHEN uid % 2 = 0 THEN 'user' || uid END AS user_id FROM ev)"


def _memberships(m):
    return m.ev.select(
        F.concat(F.lit("acc"), (F.col("uid") % 13).cast("string")).alias("account_id"), "visitor_id",
        F.when(F.col("uid") % 2 == 0, F.concat(F.lit("user"), F.col("uid").cast("string"))).alias("user_id"),
    ).distinct()


for _name in ("AGG57_account_analytics", "JON14_account_facts"):
    @query(_name, f"""WITH {SESS}, {_MEMB.replace('FROM ev', 'FROM evs')}, s AS (SELECT visitor_id, count(*) AS n FROM sessions GROUP BY 1), p AS (SELECT visitor_id, count(*) AS n FROM pv GROUP BY 1),
      e AS (SELECT visitor_id, count(*) AS n, sum(CAST(revenue_amount AS DOUBLE)) AS r FROM ce GROUP BY 1)
      SELECT account_id, count(DISTINCT m.visitor_id) AS members, count(DISTINCT m.user_id) AS identified_users, CAST(sum(coalesce(s.n, 0)) AS BIGINT) AS sessions, CAST(sum(coalesce(p.n, 0)) AS BIGINT) AS pageviews,
        CAST(sum(coalesce(e.n, 0)) AS BIGINT) AS events, {r4('coalesce(sum(r), 0)')} AS revenue FROM members m LEFT JOIN s USING (visitor_id) LEFT JOIN p USING (visitor_id) LEFT JOIN e USING (visitor_id) GROUP BY 1""")
    def _(m):
        return I.account_analytics(_memberships(m), m.sessions, m.pageviews, m.events)


@query("INS42_account_members", f"WITH {EV}, {_MEMB} SELECT account_id, visitor_id, user_id FROM members WHERE account_id = 'acc3' ORDER BY visitor_id LIMIT 20")
def _(m):
    return page(_memberships(m).filter("account_id = 'acc3'"), [F.col("visitor_id")], 20)


@query("INS42_profile_list", f"WITH {PROFILES} SELECT visitor_id, user_id, plan FROM profiles ORDER BY first_seen_at DESC, visitor_id LIMIT 25 OFFSET 5")
def _(m):
    return I.list_people(m.profiles, limit=25, offset=5).select("visitor_id", "user_id", F.col("traits")["plan"].alias("plan"))


# Merges and the identity graph.


def _merges(m):
    """Chains of three: 3 into 2 into 1, and so on for every ten customers."""
    uid = F.col("uid")
    return m.profiles.filter("uid % 10 IN (2, 3)").select(
        F.col("visitor_id").alias("from_id"), (uid - 1).cast("string").alias("to_id"), (uid % 10 - 1).cast("int").alias("position"))


_TO = "CASE uid % 10 WHEN 2 THEN uid - 1 WHEN 3 THEN uid - 2 ELSE uid END"


@query("UDA12_redirect_closure", f"WITH {PROFILES} SELECT visitor_id AS from_id, CAST({_TO} AS VARCHAR) AS to_id FROM profiles WHERE uid % 10 IN (2, 3)")
def _(m):
    return I.redirect_map(_merges(m))


@query("UDA12_rekeyed_events", f"WITH {EV} SELECT CAST({_TO} AS VARCHAR) AS visitor_id, event, count(*) AS n FROM ev GROUP BY 1, 2")
def _(m):
    return I.redirect(m.ev, I.redirect_map(_merges(m))).groupBy("visitor_id", "event").agg(F.count("*").alias("n"))


@query("STR13_redirect_visitors", f"WITH {EV} SELECT event_id, CAST({_TO} AS VARCHAR) AS visitor_id FROM ev")
def _(m):
    return I.redirect(m.ev.select("event_id", "visitor_id"), I.redirect_map(_merges(m)))


@query("UDA12_merged_profiles", f"""WITH {PROFILES}, r AS (SELECT *, CAST({_TO} AS VARCHAR) AS person, CASE uid % 10 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS pos FROM profiles)
  SELECT person AS visitor_id, arg_min(CASE WHEN uid % 10 = 1 THEN NULL ELSE user_id END, pos) AS user_id, {ts('min(first_seen_at)')} AS first_seen_at, arg_min(plan, pos) AS plan, arg_min(CASE WHEN uid % 10 = 2 THEN 'x' END, pos) AS extra FROM r GROUP BY 1""")
def _(m):
    extra = F.when(F.col("uid") % 10 == 2, F.create_map(F.lit("extra"), F.lit("x"))).otherwise(I.empty_map())
    people = m.profiles.withColumn("traits", F.map_concat("traits", extra)).withColumn("user_id", F.when(F.col("uid") % 10 != 1, F.col("user_id")))
    out = I.merge_profiles(people, _merges(m))
    return out.select("visitor_id", "user_id", "first_seen_at", F.col("traits")["plan"].alias("plan"), F.col("traits")["extra"].alias("extra"))


@query("WIN12_merge_priority", f"""WITH {EV}, x AS (SELECT visitor_id, uid, min(created_at) AS seen FROM ev WHERE event = 'click' GROUP BY 1, 2),
  r AS (SELECT *, CAST({_TO} AS VARCHAR) AS person, CASE uid % 10 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS pos FROM x)
  SELECT 'e1' AS experiment_id, person AS visitor_id, {ts('arg_min(seen, pos)')} AS seen FROM r GROUP BY 2""")
def _(m):
    rows = m.exposures.select(F.lit("e1").alias("experiment_id"), "visitor_id", F.col("first_exposed_at").alias("seen"))
    return I.merge_keyed(rows, _merges(m), "experiment_id")


_EDGES = f"""{EV}, {PROFILES}, {_MEMB}, edges AS (SELECT 'visitor:' || visitor_id AS source, 'user:' || user_id AS target, 'identified_as' AS kind FROM profiles
  UNION SELECT 'visitor:' || visitor_id, 'user:u' || (uid // 3), 'alias' FROM profiles UNION SELECT 'visitor:' || visitor_id, 'account:' || account_id, 'member_of' FROM members
  UNION SELECT 'user:' || user_id, 'account:' || account_id, 'member_of' FROM members WHERE user_id IS NOT NULL UNION SELECT 'visitor:' || visitor_id, 'user:' || user_id, 'identified_as' FROM members WHERE user_id IS NOT NULL),
  related AS (SELECT visitor_id FROM profiles WHERE uid // 3 = 4 UNION SELECT visitor_id FROM members WHERE account_id = 'acc5')"""


def _edges(m):
    return I.identity_edges(m.profiles, _aliases(m), _memberships(m))


@query("UDA08_identity_edges", f"WITH {_EDGES} SELECT * FROM edges")
def _(m):
    return _edges(m)


@query("UDA09_related_visitors", f"WITH {_EDGES} SELECT visitor_id FROM related")
def _(m):
    return I.related_visitors(m.profiles, _aliases(m), _memberships(m), user="u4", account="acc5")


@query("UDA08_graph_around_seed", f"WITH {_EDGES}, mine AS (SELECT * FROM edges WHERE source IN (SELECT 'visitor:' || visitor_id FROM related)) SELECT DISTINCT node, split_part(node, ':', 1) AS kind FROM (SELECT source AS node FROM mine UNION SELECT target FROM mine)")
def _(m):
    related = I.related_visitors(m.profiles, _aliases(m), _memberships(m), user="u4", account="acc5")
    return I.identity_graph(_edges(m), related)[0]


_ALIAS_EDGES = """links AS (SELECT 'v' || c_custkey AS a, 'u' || (c_custkey // 3) AS b FROM customer UNION SELECT 'v' || c_custkey, 'n' || c_nationkey FROM customer WHERE c_custkey % 7 = 0),
  both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links)"""


@query("UDA08_components", f"WITH RECURSIVE {_ALIAS_EDGES}, reach(node, root) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node) SELECT node, min(root) AS component FROM reach GROUP BY 1")
def _(m):
    c = m.table("customer")
    v = F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("source")
    users = c.select(v, F.concat(F.lit("u"), F.floor(F.col("c_custkey") / 3).cast("string")).alias("target"))
    nations = c.filter("c_custkey % 7 = 0").select(v, F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("target"))
    return I.people_components(users.unionByName(nations))


# People pages.


@query("FLT34_people_list", f"WITH {PROFILES}, x AS (SELECT * FROM profiles WHERE contains(lower(plan), 'build') AND balance > 0 AND uid % 4 = 1) SELECT visitor_id, user_id, (SELECT count(*) FROM x) AS total FROM x ORDER BY first_seen_at DESC, visitor_id LIMIT 10 OFFSET 3")
def _(m):
    return I.list_people(m.profiles, "BUILD", (P("balance", "gt", 0, "person"),), _static(m), limit=10, offset=3).select("visitor_id", "user_id", "total")


@query("WIN04_page_total", "WITH g AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') SELECT n_name AS group_key, (SELECT count(*) FROM g) AS total FROM g ORDER BY 1 LIMIT 3")
def _(m):
    return I.list_groups(m.groups, 0, "asia", 3).select("group_key", "total")


@query("INS41_group_list", "SELECT n_name AS group_key, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY 1 LIMIT 10 OFFSET 2")
def _(m):
    return I.list_groups(m.groups, 0, limit=10, offset=2).select("group_key", F.col("properties")["region"].alias("region"))


@query("INS41_group_events", f"WITH {EV} SELECT event_id, event FROM ev JOIN customer ON uid = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3' ORDER BY created_at DESC, event_id DESC LIMIT 30")
def _(m):
    rows = m.grouped_ev.filter(F.col("properties")["$group_0"] == "NATION_3")
    return page(rows, [F.desc("created_at"), F.desc("event_id")], 30).select("event_id", "event")


@query("JON21_group_people", f"WITH {EV}, {PROFILES} SELECT e.visitor_id, count(*) AS events, {ts('max(created_at)')} AS last_at, min(p.user_id) AS user_id FROM ev e JOIN nation ON true JOIN customer ON c_nationkey = n_nationkey AND c_custkey = uid LEFT JOIN profiles p ON p.visitor_id = e.visitor_id WHERE n_name = 'NATION_3' GROUP BY 1")
def _(m):
    return I.group_people(m.grouped_ev, m.profiles, 0, "NATION_3").drop("traits")


@query("INS39_person_details", f"""WITH {SESS}, {PROFILES}, a AS (SELECT visitor_id, count(*) AS n FROM ce GROUP BY 1), s AS (SELECT visitor_id, count(*) AS n FROM sessions GROUP BY 1)
  SELECT p.visitor_id, 1 AS aliases, CASE WHEN p.uid % 10 = 1 AND p.uid + 1 <= mx THEN 1 + CASE WHEN p.uid + 2 <= mx THEN 1 ELSE 0 END ELSE 0 END AS merged_from, coalesce(a.n, 0) AS events, coalesce(s.n, 0) AS sessions, CASE WHEN p.uid % 4 = 1 THEN 1 ELSE 0 END AS cohorts
  FROM profiles p CROSS JOIN (SELECT max(uid) AS mx FROM profiles) LEFT JOIN a USING (visitor_id) LEFT JOIN s USING (visitor_id)""")
def _(m):
    out = I.person_details(m.profiles, _aliases(m), I.redirect_map(_merges(m)), m.events, m.sessions, _static(m))
    return out.select("visitor_id", "aliases", "merged_from", "events", "sessions", "cohorts")


@query("INS40_person_events", f"WITH {EV} SELECT event_id, event FROM ev WHERE visitor_id = '5' ORDER BY created_at DESC, event_id DESC LIMIT 20")
def _(m):
    return page(m.ev.filter("visitor_id = '5'"), [F.desc("created_at"), F.desc("event_id")], 20).select("event_id", "event")


for _name in ("INS40_person_sessions", "JON18_recorded_sessions"):
    @query(_name, f"WITH {SESS} SELECT session_id, pageview_count, EXISTS (SELECT 1 FROM pv WHERE pv.session_id = s.session_id AND k > 90) AS has_recording FROM sessions s WHERE visitor_id = '5' ORDER BY first_at DESC LIMIT 50")
    def _(m):
        return I.person_sessions(m.sessions, m.pageviews.filter("k > 90"), "5").select("session_id", "pageview_count", "has_recording")


# Joins to the event stream.


@query("JON01_event_sessions", f"WITH {SESS} SELECT event_id, s.browser AS s_browser, CAST(s.pageview_count AS VARCHAR) AS s_pageviews FROM evs JOIN sessions s USING (session_id)")
def _(m):
    joined = join_sessions(m.stream(sessions=True), m.sessions, ["browser", "pageview_count"])
    return joined.select("event_id", "s_browser", F.col("s_pageview_count").cast("string").alias("s_pageviews"))


@query("JON02_event_people", f"WITH {EV}, {PROFILES} SELECT event_id, user_id, plan FROM ev LEFT JOIN profiles USING (visitor_id)")
def _(m):
    return join_profiles(m.stream(), m.profiles).select("event_id", "user_id", F.col("traits")["plan"].alias("plan"))


@query("JON03_event_groups", f"WITH {EV} SELECT event_id, r_name AS region FROM ev LEFT JOIN customer ON uid = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(m):
    return join_groups(m.grouped_ev, m.groups, [0]).select("event_id", F.col("g0_properties")["region"].alias("region"))


def _mapping(m):
    existing = m.spark.createDataFrame([("company", 1)], "group_type string, type_index int")
    seen = m.ev.groupBy(F.concat(F.lit("t"), (F.col("k") % 7).cast("string")).alias("group_type")).agg(F.min("event_id").alias("first_seen"))
    return I.assign_group_types(existing, seen, max_types=5)


_MAPPING = f"""{EV}, seen AS (SELECT 't' || (k % 7) AS group_type, min(event_id) AS f FROM ev GROUP BY 1), rk AS (SELECT group_type, row_number() OVER (ORDER BY f) AS n FROM seen),
  mapping AS (SELECT 'company' AS group_type, 1 AS type_index UNION ALL SELECT group_type, CASE n WHEN 1 THEN 0 ELSE n END FROM rk WHERE n <= 4)"""


@query("WIN16_group_type_index", f"WITH {_MAPPING} SELECT group_type, CAST(type_index AS BIGINT) AS type_index FROM mapping")
def _(m):
    return _mapping(m)


_STAMP = f"WITH {_MAPPING} SELECT event_id, '$group_' || type_index AS name, 'key' || k AS value FROM ev JOIN mapping ON group_type = 't' || (k % 7) WHERE k % 3 > 0 UNION ALL SELECT event_id, '$group_1', CASE WHEN k % 2 = 0 THEN 'own' ELSE 'shared' END FROM ev"
for _name in ("SCL20_group_stamping", "SCL35_envelope_groups"):
    @query(_name, _STAMP)
    def _(m):
        k = F.col("k")
        key = F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("key"), k.cast("string")))
        envelope = F.create_map(F.lit("company"), F.lit("shared"))
        own = F.when(k % 2 == 0, F.create_map(F.lit("company"), F.lit("own"), F.concat(F.lit("t"), (k % 7).cast("string")), key)).otherwise(
            F.create_map(F.concat(F.lit("t"), (k % 7).cast("string")), key))
        rows = m.ev.select("event_id", I.merge_envelope_groups(envelope, own).alias("groups"), I.empty_map().alias("properties"))
        return I.stamp_groups(rows, _mapping(m), max_types=5, max_key=400).select("event_id", F.explode("properties").alias("name", "value"))


@query("JON22_accounts_as_groups", f"WITH {EV} SELECT 2 AS type_index, {_ACC} AS group_key, 'Name ' || arg_max(k, (created_at, event_id)) FILTER (WHERE event = 'signup') AS name, arg_max(path, (created_at, event_id)) FILTER (WHERE event = 'purchase') AS tier FROM ev GROUP BY ALL".replace("SELECT 2 AS", "SELECT 2::BIGINT AS"))
def _(m):
    mapping = m.spark.createDataFrame([("account", 2), ("team", 0)], "group_type string, type_index int")
    out = I.accounts_as_groups(I.fold_accounts(_account_rows(m)), mapping)
    return out.select("type_index", "group_key", F.col("properties")["name"].alias("name"), F.col("properties")["tier"].alias("tier"))
