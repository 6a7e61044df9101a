"""Governance, definitions, experiments, flags, goals, alerts and privacy."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.catalog.oracle import CONVERSIONS, ERRORS, EV, EVS, EXPOSURES, PROFILES, SESS, r4, ts
from clickloom.catalog.registry import query
from clickloom.functions import enrich, hashing, stats
from clickloom.functions.targeting import Condition, Rules, matches
from clickloom.operators import alerts as A, experiments as X, governance as G, privacy as V
from clickloom.operators.alerts import Rule
from clickloom.operators.experiments import ConfigEntry, Flag, Goal
from clickloom.operators.trends import page
from clickloom.session import new_folder
from clickloom.sources.demo import pick
from clickloom.sources.people_files import delete_visitors, visitor_rows, write_by_visitor

NOW = "2024-01-30 20:00:00"

# Tracking plan.

_RULES = "array<struct<field:string,type:string,required:boolean>>"


def _schemas(m):
    rows = [
        ("s1", "purchase", "approved", "plan", 2, [("amount", "number", True), ("meta.coupon", "string", False)]),
        ("s2", "purchase", "draft", None, 9, [("other", "any", True)]),
        ("s3", "click", "draft", "plan", 1, [("k", "integer", True)]),
        ("s4", "signup", "approved", None, 5, [("at", "timestamp", True), ("k", "boolean", False)]),
        ("s5", "signup", "approved", "other", 7, [("nope", "any", True)]),
    ]
    return m.spark.createDataFrame(rows, f"schema_id string, event_name string, status string, plan_id string, updated_at int, rules {_RULES}")


def _payloads(m):
    k = F.col("k")
    coupon = F.when(k % 3 == 0, F.lit("7")).when(k % 3 == 1, F.lit('"c"')).otherwise(F.lit("null"))
    amount = F.when(k % 4 == 0, F.lit('"x"')).when(k % 4 == 1, F.lit("null")).otherwise(F.lit("42.5"))
    purchase = F.concat(F.lit('{"amount": '), amount, F.lit(', "meta": {"coupon": '), coupon, F.lit("}}"))
    signup = F.when(k % 2 == 0, F.lit('{"at": "2024-01-02T03:04:05Z", "k": true}')).otherwise(F.lit('{"at": "soon", "k": 1}'))
    data = F.when(F.col("event") == "purchase", purchase).when(F.col("event") == "signup", signup).otherwise(F.col("props"))
    return m.ev.filter("event <> '$pageview'").withColumn("event_name", F.col("event")).withColumn("event_data", data)


_VIOLATIONS = f"""{EV}, violations AS (
  SELECT event_id, event AS event_name, visitor_id, created_at, 'unknown_event' AS violation_type, CAST(NULL AS VARCHAR) AS property, CAST(NULL AS VARCHAR) AS expected_type, CAST(NULL AS VARCHAR) AS actual_type FROM ev WHERE event = 'error'
  UNION ALL SELECT event_id, event, visitor_id, created_at, 'unapproved_event', NULL, NULL, NULL FROM ev WHERE event = 'click'
  UNION ALL SELECT event_id, event, visitor_id, created_at, 'missing_required_property', 'amount', NULL, NULL FROM ev WHERE event = 'purchase' AND k % 4 = 1
  UNION ALL SELECT event_id, event, visitor_id, created_at, 'property_type_mismatch', 'amount', 'number', 'string' FROM ev WHERE event = 'purchase' AND k % 4 = 0
  UNION ALL SELECT event_id, event, visitor_id, created_at, 'property_type_mismatch', 'meta.coupon', 'string', 'integer' FROM ev WHERE event = 'purchase' AND k % 3 = 0
  UNION ALL SELECT event_id, event, visitor_id, created_at, 'property_type_mismatch', 'at', 'timestamp', 'string' FROM ev WHERE event = 'signup' AND k % 2 = 1
  UNION ALL SELECT event_id, event, visitor_id, created_at, 'property_type_mismatch', 'k', 'boolean', 'integer' FROM ev WHERE event = 'signup' AND k % 2 = 1)"""


def _validated(m, mode="observe"):
    return G.validate_events(_payloads(m), G.pick_schemas(_schemas(m), "plan"), mode)


def _violations(m):
    return G.violation_rows(_validated(m))


@query("STR09_validation_outcome", f"WITH {_VIOLATIONS} SELECT e.event_id, count(violation_type) AS violations, count(violation_type) = 0 AS accepted FROM ev e LEFT JOIN violations v ON v.event_id = e.event_id WHERE event <> '$pageview' GROUP BY 1")
def _(m):
    return _validated(m, "reject").select("event_id", F.size("violations").alias("violations"), "accepted")


@query("SRC45_violation_rows", f"WITH {_VIOLATIONS} SELECT event_id, event_name, visitor_id, {ts('created_at')} AS created_at, violation_type, property, expected_type, actual_type FROM violations")
def _(m):
    return _violations(m)


@query("INS43_violation_list", f"WITH {_VIOLATIONS} SELECT event_id, property FROM violations WHERE event_name = 'purchase' AND violation_type = 'property_type_mismatch' ORDER BY created_at DESC, event_id DESC, property LIMIT 30")
def _(m):
    return G.list_violations(_violations(m), "purchase", "property_type_mismatch", 30).select("event_id", "property")


@query("JON27_schema_pick", f"WITH {EV} SELECT event AS event_name, CASE event WHEN 'purchase' THEN 's1' WHEN 'click' THEN 's3' WHEN 'signup' THEN 's4' END AS schema_id, count(*) AS n FROM ev WHERE event <> '$pageview' GROUP BY 1")
def _(m):
    picked = G.pick_schemas(_schemas(m), "plan").select("event_name", "schema_id")
    return _payloads(m).groupBy("event_name").agg(F.count("*").alias("n")).join(picked, "event_name", "left")


@query("JON17_schema_coverage", f"WITH {EV} SELECT count(DISTINCT event) AS observed_events_24h, count(DISTINCT event) FILTER (WHERE event IN ('purchase', 'signup')) AS covered_events_24h FROM ev WHERE event <> '$pageview' AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR")
def _(m):
    return G.coverage(_payloads(m), _schemas(m), NOW, "plan")


@query("AGG56_governance_health", f"""WITH {_VIOLATIONS}, v AS (SELECT * FROM violations WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR), o AS (SELECT count(DISTINCT event) AS n, count(DISTINCT event) FILTER (WHERE event IN ('purchase', 'signup')) AS c FROM ev WHERE event <> '$pageview' AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR)
  SELECT n AS observed_events_24h, c AS covered_events_24h, (SELECT count(*) FROM v) AS violations_24h, (SELECT count(*) FROM v WHERE violation_type = 'unknown_event') AS unknown_events_24h, (SELECT count(*) FROM v WHERE violation_type = 'unapproved_event') AS unapproved_events_24h,
    (SELECT count(*) FROM v WHERE violation_type = 'missing_required_property') AS missing_property_violations_24h, (SELECT count(*) FROM v WHERE violation_type = 'property_type_mismatch') AS type_mismatch_violations_24h, {r4('c / n')} AS coverage_ratio, 'critical' AS status FROM o""")
def _(m):
    return G.governance_health(_payloads(m), _schemas(m), _violations(m), NOW, "plan")


@query("AGG56_top_violations", f"WITH {_VIOLATIONS} SELECT event_name, violation_type, count(*) AS count FROM violations WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 4")
def _(m):
    return G.top_violations(_violations(m), NOW, 4)


_JSONS = ["null", "true", "12", "1.5", '"a"', '"2024-01-05T10:00:00Z"', "[1]", '{"a": 1}', '"2024-01-05"']
_TYPES = ["null", "boolean", "integer", "number", "string", "string", "array", "object", "string"]
_SHOWN = ["String", "Boolean", "Numeric", "Numeric", "String", "DateTime", "Array", "Object", "DateTime"]


def _case(values) -> str:
    return "CASE k % 9 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


@query("SCL21_json_type", f"WITH {EV}, t AS (SELECT event_id, k, {_case(_TYPES)} AS name FROM ev) SELECT event_id, name, name IN ('integer', 'number') AS is_number, k % 9 = 5 AS is_timestamp, true AS is_any FROM t")
def _(m):
    value = F.try_parse_json(pick(_JSONS, F.col("k")))
    out = m.ev.select("event_id", G.type_name(value).alias("name"), *[
        F.coalesce(G.matches_type(value, F.lit(t)), F.lit(False)).alias(n) for t, n in (("number", "is_number"), ("timestamp", "is_timestamp"), ("any", "is_any"))])
    return out


@query("SCL22_property_type", f"WITH {EV} SELECT event_id, {_case(_SHOWN)} AS type FROM ev")
def _(m):
    return m.ev.select("event_id", G.property_type(F.try_parse_json(pick(_JSONS, F.col("k")))).alias("type"))


# Definitions.


def _documented(m):
    rows = [("purchase", "Bought", ["money"], False), ("refund", "Money back", ["money"], False), ("secret", "Hidden one", [], True)]
    return m.spark.createDataFrame(rows, "name string, description string, tags array<string>, hidden boolean")


_DEFS = f"{EV}, seen AS (SELECT event AS name, count(*) AS volume, count(DISTINCT visitor_id) AS unique_users, max(created_at) AS last_seen FROM ev GROUP BY 1), docs AS (SELECT * FROM (VALUES ('purchase', 'Bought', 1, false), ('refund', 'Money back', 1, false), ('secret', 'Hidden one', 0, true)) t(name, description, tagged, hidden))"


@query("AGG64_event_definitions", f"WITH {_DEFS} SELECT name, volume, unique_users, {ts('last_seen')} AS last_seen FROM seen")
def _(m):
    return G.event_definitions(m.stream())


@query("JON23_unseen_definitions", f"WITH {_DEFS} SELECT name, coalesce(volume, 0) AS volume, coalesce(unique_users, 0) AS unique_users, description FROM seen FULL JOIN docs USING (name)")
def _(m):
    return G.event_definitions(m.stream(), _documented(m)).select("name", "volume", "unique_users", "description")


@query("FLT33_definition_search", f"WITH {_DEFS} SELECT name, coalesce(volume, 0) AS volume FROM seen FULL JOIN docs USING (name) WHERE NOT coalesce(hidden, false) AND (contains(lower(name), 'mon') OR contains(lower(coalesce(description, '')), 'mon') OR tagged = 1)")
def _(m):
    return G.search_definitions(G.event_definitions(m.stream(), _documented(m)), "MON").select("name", "volume")


def _typed_docs(m):
    k = F.col("k")
    mixed = F.when(k % 3 == 0, F.lit("1")).when(k % 3 == 1, F.lit("true")).otherwise(F.lit('"2024-02-03"'))
    return m.ev.select(F.concat(F.lit('{"k": '), k.cast("string"), F.lit(', "mixed": '), mixed, F.lit("}")).alias("doc"))


@query("AGG65_property_definitions", f"""WITH {EV}, t AS (SELECT 'mixed' AS name, CASE k % 3 WHEN 0 THEN 'Numeric' WHEN 1 THEN 'Boolean' ELSE 'DateTime' END AS type, count(*) AS n FROM ev GROUP BY 2 UNION ALL SELECT 'k', 'Numeric', count(*) FROM ev)
  SELECT name, arg_min(type, (-n, type)) AS property_type, CAST(sum(n) AS BIGINT) AS seen FROM t GROUP BY 1""")
def _(m):
    return G.property_definitions(_typed_docs(m), "doc")


@query("WIN11_dominant_type", f"WITH {EV}, t AS (SELECT path AS name, event AS type, count(*) AS n FROM ev GROUP BY 1, 2) SELECT name, arg_min(type, (-n, type)) AS property_type, CAST(sum(n) AS BIGINT) AS seen FROM t GROUP BY 1")
def _(m):
    return G.dominant_types(m.ev.groupBy(F.col("path").alias("name"), F.col("event").alias("type")).agg(F.count("*").alias("n")))


@query("FLT32_events_explorer", f"WITH {EV} SELECT event_id, event FROM ev WHERE created_at < TIMESTAMP '2024-01-20' AND event IN ('click', 'purchase') AND k > 50 ORDER BY created_at DESC, event_id DESC LIMIT 26")
def _(m):
    rows = G.explore_events(m.stream(), "2024-01-20", ["click", "purchase"], F.col("properties")["k"].cast("int") > 50, 25)
    return rows.select("event_id", "event")


# Rolls, experiments and flags.

PROJECT = "0f8fad5b-d9cb-469f-a165-70867728950e"
EXPERIMENT = "7c9e6679-7425-40de-944b-e07fc1f90ae7"
WEIGHTS = [("control", 50.0), ("b", 30.0), ("c", 20.0), ("off", 0.0)]


def _share(data: str) -> str:
    """The first 16 digits of a digest as a share of the 64-bit range; digits are summed by place."""
    digits = " + ".join(f"(strpos('0123456789abcdef', substring(h, {i}, 1)) - 1) * {float(16 ** (16 - i))!r}" for i in range(1, 17))
    return f"SELECT visitor_id, ({digits}) / 18446744073709551615.0 AS share FROM (SELECT visitor_id, sha256({data}) AS h FROM people)"


def _bytes(uuid: str) -> str:
    return f"unhex('{uuid.replace('-', '')}')"


_PEOPLE = f"{PROFILES}, people AS (SELECT visitor_id, uid, plan, balance, user_id FROM profiles)"


def _roll(key: str, salt: str) -> str:
    return _share(f"{_bytes(PROJECT)} || encode('{key}') || encode(visitor_id) || encode('{salt}')")


_ASSIGN = _share(f"{_bytes(PROJECT)} || {_bytes(EXPERIMENT)} || encode(visitor_id)")
_PICKED = "CASE WHEN share * 100 < 50 THEN 'control' WHEN share * 100 < 80 THEN 'b' WHEN share * 100 < 100 THEN 'c' ELSE 'control' END"


@query("SCL10_stable_roll", f"WITH {_PEOPLE}, s AS ({_roll('flag', 'rollout')}) SELECT visitor_id, {r4('share * 100')} AS roll FROM s")
def _(m):
    return m.profiles.select("visitor_id", hashing.stable_roll(PROJECT, "flag", F.col("visitor_id"), "rollout").alias("roll"))


@query("SCL11_weighted_variant", f"WITH {_PEOPLE}, s AS ({_roll('flag', 'variant')}) SELECT visitor_id, {_PICKED} AS variant FROM s")
def _(m):
    return m.profiles.select("visitor_id", hashing.weighted_variant(PROJECT, "flag", F.col("visitor_id"), WEIGHTS).alias("variant"))


@query("SCL12_rollout", f"WITH {_PEOPLE}, s AS ({_roll('flag', 'rollout')}) SELECT visitor_id, share * 100 < 25 AS quarter, true AS everyone, false AS nobody FROM s")
def _(m):
    v = F.col("visitor_id")
    return m.profiles.select("visitor_id", *[hashing.in_rollout(PROJECT, "flag", v, p).alias(n) for n, p in (("quarter", 25.0), ("everyone", 100.0), ("nobody", 0.0))])


@query("SCL13_experiment_assignment", f"WITH {_PEOPLE}, s AS ({_ASSIGN}) SELECT visitor_id, {_PICKED} AS variant FROM s")
def _(m):
    return X.assign_all(m.profiles.select("visitor_id"), PROJECT, EXPERIMENT, WEIGHTS)


_ZTEST = """SELECT *, CASE WHEN se > 0 THEN (x / n - bx / bn) / se ELSE 0 END AS z FROM (SELECT *, sqrt(((x + bx) / (n + bn)) * (1 - (x + bx) / (n + bn)) * (1.0 / n + 1.0 / bn)) AS se FROM base)"""
_ERF = """SELECT *, 1.0 / (1.0 + 0.3275911 * abs(z) / sqrt(2.0)) AS t, abs(z) / sqrt(2.0) AS a FROM zt"""
_P = "2 * (1 - 0.5 * (1 + (1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-a * a))))"
for _name in ("SCL14_proportion_test", "SCL15_normal_cdf"):
    @query(_name, f"""WITH {EV}, base AS (SELECT path, count(*) AS n, count(*) FILTER (WHERE event = 'purchase') AS x, 1000 AS bn, 180 AS bx FROM ev GROUP BY 1), zt AS ({_ZTEST}), e AS ({_ERF})
      SELECT path, {r4('(x / n - 0.18) / 0.18 * 100')} AS lift, {r4(f'greatest(0, least(1, {_P}))')} AS p_value, {r4(f'(1 - greatest(0, least(1, {_P}))) * 100')} AS confidence, {_P} < 0.05 AS significant FROM e""")
    def _(m):
        rows = m.ev.groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.col("event") == "purchase").alias("x"))
        c = stats.compare_proportions(F.col("x"), F.col("n"), F.lit(180), F.lit(1000))
        return rows.select("path", c.lift.alias("lift"), c.p_value.alias("p_value"), c.confidence.alias("confidence"), c.significant.alias("significant"))


@query("SCL24_percent_change", f"WITH {EV}, n AS (SELECT visitor_id, count(*) FILTER (WHERE event = 'click') AS a, count(*) FILTER (WHERE event = 'error') AS b FROM ev GROUP BY 1) SELECT visitor_id, {r4('CASE WHEN b > 0 THEN a / b * 100 ELSE 0 END')} AS share, {r4('CASE WHEN b > 0 THEN (a - b) / b * 100 WHEN a > 0 THEN 100 ELSE 0 END')} AS change FROM n")
def _(m):
    n = m.ev.groupBy("visitor_id").agg(F.count_if(F.col("event") == "click").alias("a"), F.count_if(F.col("event") == "error").alias("b"))
    return n.select("visitor_id", stats.percent(F.col("a"), F.col("b")).alias("share"), stats.percent_change(F.col("a"), F.col("b")).alias("change"))


_RULES_ANY = Rules("any", (Condition("traits.plan", "eq", "BUILDING"), Condition("visitor_id", "in", ["3", 5]), Condition("context.tier", "gte", 8)))
_TARGET_SQL = "plan = 'BUILDING' OR visitor_id IN ('3', '5') OR uid % 10 >= 8"


def _visitors(m):
    return m.profiles.withColumn("context", F.create_map(F.lit("tier"), (F.col("uid") % 10).cast("string")))


@query("FLT39_targeting", f"WITH {_PEOPLE} SELECT visitor_id, {_TARGET_SQL} AS any_rule, plan LIKE '%ER%' AND uid % 10 < 4 AS all_rules FROM people")
def _(m):
    every = Rules("all", (Condition("plan", "contains", "ER"), Condition("tier", "lt", 4)))
    return _visitors(m).select("visitor_id", matches(_RULES_ANY).alias("any_rule"), matches(every).alias("all_rules"))


_FLAGS = [
    Flag("off", enabled=False), Flag("flag", rules=_RULES_ANY, rollout_percentage=40.0),
    Flag("multi", flag_type="multivariate", variants=(("control", 50.0, {"x": 1}), ("b", 30.0, "two"), ("c", 20.0, None)), default_value="none"),
    Flag("exp", experiment=(EXPERIMENT, tuple(WEIGHTS)), variants=(("b", 1.0, 7),)), Flag("conf", flag_type="config", remote_config={"a": [1]}),
]


@query("UDA10_flag_evaluation", f"""WITH {_PEOPLE}, r AS ({_roll('flag', 'rollout')}), v AS ({_roll('multi', 'variant')}), a AS ({_ASSIGN}),
  mv AS (SELECT visitor_id, {_PICKED.replace("ELSE 'control'", 'ELSE NULL')} AS variant FROM v), av AS (SELECT visitor_id, {_PICKED} AS variant FROM a)
  SELECT visitor_id, 'off' AS key, false AS matched, false AS enabled, NULL AS variant, 'false' AS value, 'disabled' AS reason FROM people
  UNION ALL SELECT visitor_id, 'flag', ({_TARGET_SQL}), ({_TARGET_SQL}) AND share * 100 < 40, NULL, CASE WHEN ({_TARGET_SQL}) AND share * 100 < 40 THEN 'true' ELSE 'false' END, CASE WHEN NOT ({_TARGET_SQL}) THEN 'no_match' WHEN share * 100 >= 40 THEN 'rollout_miss' ELSE 'match' END FROM people JOIN r USING (visitor_id)
  UNION ALL SELECT visitor_id, 'multi', true, true, variant, CASE variant WHEN 'control' THEN '{{"x": 1}}' WHEN 'b' THEN '"two"' WHEN 'c' THEN 'null' ELSE '"none"' END, 'variant_assignment' FROM mv
  UNION ALL SELECT visitor_id, 'exp', true, true, variant, CASE variant WHEN 'b' THEN '7' ELSE '"' || variant || '"' END, 'experiment_assignment' FROM av
  UNION ALL SELECT visitor_id, 'conf', true, true, NULL, '{{"a": [1]}}', 'match' FROM people""")
def _(m):
    return X.evaluate_flags(_visitors(m), PROJECT, _FLAGS)


@query("INS44_flag_log", f"WITH {_PEOPLE}, r AS ({_roll('flag', 'rollout')}) SELECT visitor_id, CASE WHEN NOT ({_TARGET_SQL}) THEN 'no_match' WHEN share * 100 >= 40 THEN 'rollout_miss' ELSE 'match' END AS reason FROM people JOIN r USING (visitor_id) ORDER BY visitor_id LIMIT 40 OFFSET 10")
def _(m):
    log = X.evaluate_flags(_visitors(m), PROJECT, _FLAGS).filter("key = 'flag'")
    return page(log.select("visitor_id", "reason"), [F.col("visitor_id")], 40, 10)


@query("UDA11_remote_config", f"""WITH {_PEOPLE} SELECT visitor_id, 'limits' AS key, ({_TARGET_SQL}) AS matched, CASE WHEN {_TARGET_SQL} THEN '{{"max": 5}}' END AS value, CASE WHEN {_TARGET_SQL} THEN 'match' ELSE 'no_match' END AS reason FROM people
  UNION ALL SELECT visitor_id, 'old', false, NULL, 'inactive' FROM people""")
def _(m):
    return X.evaluate_config(_visitors(m), [ConfigEntry("limits", {"max": 5}, _RULES_ANY), ConfigEntry("old", 1, is_active=False)])


_EXP = f"""{EVS}, {CONVERSIONS}, {EXPOSURES}, seen AS (SELECT * FROM exposures WHERE first_exposed_at <= TIMESTAMP '2024-01-20'),
  conv AS (SELECT DISTINCT variant, e.visitor_id FROM seen e JOIN conversions c ON c.visitor_id = e.visitor_id AND c.created_at >= first_exposed_at AND c.created_at <= TIMESTAMP '2024-01-20')"""


@query("JON08_converters", f"WITH {_EXP} SELECT variant, visitor_id FROM conv")
def _(m):
    return X.converters(m.exposures, m.conversions, "2024-01-01", "2024-01-20").select("variant", "visitor_id")


@query("AGG68_experiment_results", f"""WITH {_EXP}, a AS (SELECT variant, count(*) AS n FROM seen GROUP BY 1), c AS (SELECT variant, count(*) AS x FROM conv GROUP BY 1),
  base AS (SELECT v.variant, coalesce(a.n, 0) AS n, coalesce(c.x, 0) AS x, (SELECT n FROM a WHERE variant = 'control') AS bn, (SELECT x FROM c WHERE variant = 'control') AS bx FROM (VALUES ('control'), ('b'), ('ghost')) v(variant) LEFT JOIN a USING (variant) LEFT JOIN c USING (variant)),
  zt AS ({_ZTEST.replace('FROM base', "FROM base WHERE n > 0 AND variant <> 'control'")}), e AS ({_ERF})
  SELECT b.variant, b.n AS assignments, b.x AS conversions, {r4('CASE WHEN b.n > 0 THEN b.x / b.n * 100 ELSE 0 END')} AS conversion_rate, {r4('(e.x / e.n - e.bx / e.bn) / (e.bx / e.bn) * 100')} AS lift_percent, CASE WHEN e.n > 0 THEN {r4(f'greatest(0, least(1, {_P}))')} END AS p_value,
    CASE WHEN e.n > 0 THEN {r4(f'(1 - greatest(0, least(1, {_P}))) * 100')} END AS confidence, coalesce({_P} < 0.05, false) AS significant, b.variant = 'control' AS is_baseline, coalesce({_P} < 0.05 AND e.x / e.n > e.bx / e.bn, false) AS is_winner FROM base b LEFT JOIN e USING (variant)""")
def _(m):
    return X.experiment_results(m.exposures, m.conversions, ["control", "b", "ghost"], "2024-01-01", "2024-01-20")


for _name in ("WIN09_earliest_assignment", "STR05_first_exposure"):
    @query(_name, f"WITH {EV} SELECT 'e' || (k % 3) AS experiment_id, visitor_id, arg_min(path, (created_at, event_id)) AS variant, {ts('min(created_at)')} AS first_exposed_at FROM ev WHERE event = 'click' GROUP BY 1, 2")
    def _(m):
        rows = m.ev.filter("event = 'click'").select(F.concat(F.lit("e"), (F.col("k") % 3).cast("string")).alias("experiment_id"), "visitor_id", F.col("path").alias("variant"), "created_at", "event_id")
        return X.first_exposures(rows)


# Goals.

_GOALS = [Goal("exact", "pageview", "/p3"), Goal("prefix", "pageview", "/p1%"), Goal("suffix", "pageview", "%7"), Goal("both", "pageview", "/%9"),
          Goal("parts", "pageview", "%p%5%"), Goal("buy", "event", "purchase"), Goal("k7", "event", "click", {"k": 7})]
_HIT = """CASE g WHEN 'exact' THEN event = '$pageview' AND path = '/p3' WHEN 'prefix' THEN event = '$pageview' AND starts_with(path, '/p1') WHEN 'suffix' THEN event = '$pageview' AND ends_with(path, '7')
  WHEN 'both' THEN event = '$pageview' AND starts_with(path, '/') AND ends_with(path, '9') WHEN 'parts' THEN event = '$pageview' AND contains(path, 'p') AND contains(path, '5') WHEN 'buy' THEN event = 'purchase' WHEN 'k7' THEN event = 'click' AND k = 7 END"""
_GOAL_ROWS = f"{SESS}, hits AS (SELECT g AS goal_id, e.* FROM evs e CROSS JOIN (VALUES ('exact'), ('prefix'), ('suffix'), ('both'), ('parts'), ('buy'), ('k7')) t(g) WHERE {_HIT}), conv AS (SELECT goal_id, session_id, min(created_at) AS created_at, arg_min(event_id, (created_at, event_id)) AS event_id, arg_min(visitor_id, (created_at, event_id)) AS visitor_id, arg_min(coalesce(revenue_amount, 0), (created_at, event_id)) AS revenue FROM hits GROUP BY 1, 2)"


def _goal_rows(m):
    return m.evs.withColumn("event_data", F.col("props"))


@query("FLT27_url_goal", f"WITH {_GOAL_ROWS} SELECT goal_id, event_id FROM hits WHERE event = '$pageview'")
def _(m):
    return X.goal_hits(_goal_rows(m), [g for g in _GOALS if g.type == "pageview"]).select("goal_id", "event_id")


@query("FLT28_event_goal", f"WITH {_GOAL_ROWS} SELECT goal_id, event_id FROM hits WHERE event <> '$pageview'")
def _(m):
    return X.goal_hits(_goal_rows(m), [g for g in _GOALS if g.type == "event"]).select("goal_id", "event_id")


@query("STR04_goal_conversions", f"WITH {_GOAL_ROWS} SELECT goal_id, session_id, event_id, visitor_id FROM conv")
def _(m):
    return X.goal_conversions(_goal_rows(m), _GOALS).select("goal_id", "session_id", "event_id", "visitor_id")


@query("AGG50_goal_stats", f"WITH {_GOAL_ROWS} SELECT goal_id, count(*) AS conversions, count(DISTINCT visitor_id) AS unique_visitors, {r4('sum(revenue)')} AS total_revenue, {r4('count(*) / (SELECT count(DISTINCT visitor_id) FROM sessions) * 100')} AS conversion_rate, {r4('count(DISTINCT visitor_id) / (SELECT count(DISTINCT visitor_id) FROM sessions) * 100')} AS unique_rate FROM conv GROUP BY 1")
def _(m):
    return X.goal_stats(X.goal_conversions(_goal_rows(m), _GOALS), m.sessions)


# Alerts.

_RULESET = [Rule("r1", "pageviews", "gt", 10, 600), Rule("r2", "visitors", "lte", 3, 600), Rule("r3", "error_count", "gte", 5, 1440), Rule("r4", "bounce_rate", "gt", 1, 1440), Rule("r5", "avg_duration", "lt", 1e9, 1440, 120), Rule("r6", "pageviews", "eq", -1, 1440)]
_AT = f"TIMESTAMP '{NOW}'"
_METRICS = f"""{SESS}, errs AS (SELECT * FROM evs WHERE event = 'error'), vals AS (
  SELECT 'pageviews' AS metric, w AS window_minutes, CAST((SELECT count(*) FROM pv WHERE created_at BETWEEN {_AT} - INTERVAL 1 MINUTE * w AND {_AT}) AS DOUBLE) AS value FROM (VALUES (600), (1440)) t(w)
  UNION ALL SELECT 'visitors', 600, (SELECT count(DISTINCT visitor_id) FROM pv WHERE created_at BETWEEN {_AT} - INTERVAL 600 MINUTE AND {_AT})
  UNION ALL SELECT 'error_count', 1440, (SELECT count(*) FROM errs WHERE created_at BETWEEN {_AT} - INTERVAL 1440 MINUTE AND {_AT})
  UNION ALL SELECT 'bounce_rate', 1440, (SELECT coalesce(count(*) FILTER (WHERE is_bounce) / nullif(count(*), 0) * 100, 0) FROM sessions WHERE first_at BETWEEN {_AT} - INTERVAL 1440 MINUTE AND {_AT})
  UNION ALL SELECT 'avg_duration', 1440, (SELECT coalesce(avg(duration_ms), 0) / 1000 FROM sessions WHERE first_at BETWEEN {_AT} - INTERVAL 1440 MINUTE AND {_AT}))"""


def _values(m):
    return A.metric_values(m.pageviews, m.sessions, m.js_errors, [(r.metric, r.window_minutes) for r in _RULESET], NOW)


@query("AGG62_metric_values", f"WITH {_METRICS} SELECT metric, CAST(window_minutes AS BIGINT) AS window_minutes, {r4('value')} AS value FROM vals")
def _(m):
    return _values(m)


@query("STR06_alert_rules", f"""WITH {_METRICS} SELECT rule_id, {r4('value')} AS metric_value, CASE rule_id WHEN 'r1' THEN value > 10 WHEN 'r2' THEN value <= 3 WHEN 'r3' THEN value >= 5 WHEN 'r4' THEN value > 1 WHEN 'r5' THEN false ELSE value = -1 END AS triggered
  FROM (VALUES ('r1', 'pageviews', 600), ('r2', 'visitors', 600), ('r3', 'error_count', 1440), ('r4', 'bounce_rate', 1440), ('r5', 'avg_duration', 1440), ('r6', 'pageviews', 1440)) t(rule_id, metric, window_minutes) JOIN vals USING (metric, window_minutes)""")
def _(m):
    return A.evaluate_rules(_values(m), _RULESET, NOW, {"r5": "2024-01-30 19:00:00"})


@query("STR06_alert_replay", f"""WITH RECURSIVE {EV}, w AS (SELECT time_bucket(INTERVAL 60 MINUTE, created_at) + INTERVAL 60 MINUTE AS e FROM ev WHERE event = 'error' GROUP BY 1 HAVING count(*) >= 3),
  f(t) AS (SELECT min(e) FROM w UNION ALL SELECT (SELECT min(e) FROM w WHERE e >= f.t + INTERVAL 300 MINUTE) FROM f WHERE f.t IS NOT NULL)
  SELECT 'errors' AS rule_id, {ts('t')} AS triggered_at FROM f WHERE t IS NOT NULL""")
def _(m):
    # At larger scale factors every hour qualifies; the walk stays bounded by the hours.
    return A.replay_rule(m.ev.filter("event = 'error'"), Rule("errors", "error_count", "gte", 3, 60, 300))


_BASE = f"{EV}, base AS (SELECT project_id, hour(created_at) AS hour, isodow(created_at) - 1 AS weekday, count(*) / 14.0 AS avg_pageviews FROM ev WHERE event = '$pageview' AND created_at >= TIMESTAMP '2024-01-30' - INTERVAL 14 DAY AND created_at <= TIMESTAMP '2024-01-30' GROUP BY 1, 2, 3)"


@query("AGG63_baselines", f"WITH {_BASE} SELECT project_id, hour, weekday, {r4('avg_pageviews')} AS avg_pageviews FROM base")
def _(m):
    return A.baselines(m.flat_pageviews, "2024-01-30")


for _name in ("STR07_traffic_spikes", "JON20_spike_baseline"):
    @query(_name, f"""WITH {_BASE}, busy AS (SELECT project_id, hour, weekday, avg_pageviews * 20 AS avg_pageviews FROM base), w AS (SELECT project_id, time_bucket(INTERVAL 10 MINUTE, created_at) AS s, count(*) * 6.0 AS rate FROM ev WHERE event = '$pageview' GROUP BY 1, 2)
      SELECT w.project_id, {ts('s')} AS window_start, CAST(floor(rate) AS BIGINT) AS current_rate, CAST(floor(avg_pageviews) AS BIGINT) AS baseline_rate, ROUND(CAST(rate / avg_pageviews AS DOUBLE), 1) AS multiplier
      FROM w JOIN busy b ON b.project_id = w.project_id AND b.hour = hour(s) AND b.weekday = isodow(s) - 1 WHERE avg_pageviews >= 1 AND rate / avg_pageviews >= 0.5""")
    def _(m):
        base = A.baselines(m.flat_pageviews, "2024-01-30").withColumn("avg_pageviews", F.col("avg_pageviews") * 20)
        return A.spikes(m.flat_pageviews, base, ratio=0.5)


@query("STR08_zero_traffic", f"""WITH {EV}, p AS (SELECT project_id || (uid % 20) AS project_id, created_at, lead(created_at, 1, TIMESTAMP '2024-01-31') OVER (PARTITION BY project_id || (uid % 20) ORDER BY created_at) AS nxt FROM ev WHERE event = '$pageview')
  SELECT project_id, strftime(unnest(generate_series(created_at + INTERVAL 3 HOUR, nxt, INTERVAL 6 HOUR)), '%Y-%m-%dT%H:%M:%S') AS alert_at FROM p WHERE nxt > created_at + INTERVAL 3 HOUR""")
def _(m):
    rows = m.flat_pageviews.withColumn("project_id", F.concat("project_id", (F.col("uid") % 20).cast("string")))
    return A.silences(rows, "2024-01-31")


# Privacy.

_AGENTS = ["Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36", "Googlebot/2.1", "", "Mozilla/5.0 (iPhone; CPU iPhone OS 17) Mobile/15E148 Safari/604.1", "MyCrawlerX", "curl-PROBE/1", "Mozilla/5.0 (X11; Linux) Firefox/121.0"]
_IPS = ["203.0.113.42", "2001:db8:abcd:1234::1", "::1", "1:2:3:4:5:6:7:8", "not an ip", "999.1.1.1", "2001:0DB8::ffff:1.2.3.4", "fe80:0:0:1::"]
_ANON = ["203.0.113.0", "2001:db8:abcd::", "::", "1:2:3::", "not an ip", "999.1.1.1", "2001:db8::", "fe80::"]


def _cases(column: str, values: list[str]) -> str:
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


@query("FLT36_bot_agents", f"WITH {EV} SELECT event_id, k % 7 IN (1, 4, 5) AS bot FROM ev")
def _(m):
    return m.ev.select("event_id", V.is_bot(pick(_AGENTS, F.col("k")), (" Probe ", "")).alias("bot"))


@query("FLT35_privacy_ladder", f"""WITH {EV}, x AS (SELECT event_id, k % 7 IN (1, 4) AS bot, k % 13 = 0 AS dnt, CASE k % 4 WHEN 0 THEN 'Analytics' WHEN 1 THEN 'ads' WHEN 2 THEN NULL ELSE 'analytics' END AS mode, CASE k % 5 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS granted FROM ev)
  SELECT event_id, CASE WHEN dnt THEN 'dnt' WHEN bot THEN 'bot' WHEN granted = false THEN 'consent_denied' WHEN granted IS NULL THEN 'consent_required' WHEN mode IS NULL THEN 'consent_mode_required' WHEN lower(mode) <> 'analytics' THEN 'consent_mode_not_allowed' END AS reason FROM x""")
def _(m):
    k = F.col("k")
    strict = V.PrivacySettings(True, True, (), True, ("analytics",))
    granted = F.when(k % 5 == 0, False).when(k % 5 != 1, True)
    mode = pick(["Analytics", "ads", None, "analytics"], k)
    return m.ev.select("event_id", V.skip_reason(strict, pick(_AGENTS, k), k % 13 == 0, mode, granted).alias("reason"))


@query("FLT37_anonymize_ip", f"WITH {EV} SELECT event_id, {_cases('k', _ANON)} AS ip FROM ev")
def _(m):
    return m.ev.select("event_id", V.anonymize_ip(pick(_IPS, F.col("k"))).alias("ip"))


@query("FLT38_strip_geo", f"WITH {EV} SELECT event_id, CASE WHEN k % 2 = 1 THEN 'R' || (k % 5) END AS region, CASE WHEN k % 2 = 1 THEN 'C' || (k % 9) END AS city, 'DE' AS country FROM ev")
def _(m):
    k = F.col("k")
    rows = m.ev.select("event_id", "k", F.concat(F.lit("R"), (k % 5).cast("string")).alias("region"), F.concat(F.lit("C"), (k % 9).cast("string")).alias("city"), F.lit("DE").alias("country"))
    return V.strip_geo(rows, k % 2 == 0).drop("k")


@query("SRC39_people_export", f"WITH {EVS} SELECT visitor_id, CASE WHEN event = '$pageview' THEN 'pageviews' ELSE 'events' END AS \"table\", count(*) AS records, CAST(sum(k) AS BIGINT) AS k_sum FROM evs WHERE uid % 50 = 7 GROUP BY 1, 2")
def _(m):
    who = m.profiles.filter("uid % 50 = 7").select("visitor_id")
    out = V.export_people({"pageviews": m.pageviews, "events": m.events}, who)
    return out.groupBy("visitor_id", "table").agg(F.count("*").alias("records"), F.sum(F.get_json_object("record", "$.k").cast("long")).alias("k_sum"))


@query("SRC39_export_from_files", f"WITH {EV} SELECT visitor_id, event_id FROM ev WHERE visitor_id IN ('7', '57', '107')")
def _(m):
    """Rows of three visitors, looked up in files that are dealt and sorted by visitor."""
    path = new_folder(m.spark, "events_by_visitor")
    write_by_visitor(m.ev.select("visitor_id", "event_id", "created_at"), path, 32)
    return visitor_rows(m.spark, path, ["7", "57", "107"], 32).select("visitor_id", "event_id")


@query("SRC40_delete_in_files", f"WITH {EV} SELECT visitor_id, count(*) AS n FROM ev WHERE visitor_id NOT IN ('7', '57', '107') GROUP BY 1")
def _(m):
    path = new_folder(m.spark, "events_by_visitor")
    write_by_visitor(m.ev.select("visitor_id", "event_id", "created_at"), path, 32)
    delete_visitors(m.spark, path, ["7", "57", "107"], 32)
    return m.spark.read.parquet(path).groupBy("visitor_id").agg(F.count("*").alias("n"))


@query("SRC40_people_delete", f"WITH {EV} SELECT visitor_id, CASE WHEN event = '$pageview' THEN 'pageviews' ELSE 'events' END AS \"table\", count(*) AS deleted FROM ev WHERE uid % 50 = 7 GROUP BY 1, 2 UNION ALL SELECT 'kept', 'pageviews', count(*) FROM ev WHERE uid % 50 <> 7 AND event = '$pageview'")
def _(m):
    who = m.profiles.filter("uid % 50 = 7").select("visitor_id")
    kept, counts = V.delete_people({"pageviews": m.flat_pageviews, "events": m.flat_events}, who)
    left = kept["pageviews"].agg(F.count("*").alias("deleted")).select(F.lit("kept").alias("visitor_id"), "deleted", F.lit("pageviews").alias("table"))
    return counts.unionByName(left)


# Lookups.


@query("SCL30_user_agents", f"WITH {EV} SELECT event_id, CASE k % 7 WHEN 0 THEN 'Chrome' WHEN 3 THEN 'Safari' WHEN 6 THEN 'Firefox' END AS browser, CASE k % 7 WHEN 0 THEN 'Windows' WHEN 3 THEN 'iOS' WHEN 6 THEN 'Linux' END AS os, CASE k % 7 WHEN 3 THEN 'mobile' ELSE 'desktop' END AS device FROM ev")
def _(m):
    return enrich.with_device(m.ev.select("event_id", pick(_AGENTS, F.col("k")).alias("user_agent"))).drop("user_agent")


def _networks(m):
    """Ten IPv4 blocks of 65,536 addresses for each of five nations inside two wide networks, and IPv6 networks of three lengths."""
    empty = [F.lit(None).cast("string").alias(c) for c in ("region", "city")]
    nation = m.table("nation").filter("n_nationkey < 5")
    tens = nation.withColumn("i", F.explode(F.sequence(F.col("n_nationkey") * 10, F.col("n_nationkey") * 10 + 9)))
    fine = tens.select(F.concat(F.lit("10."), F.col("i").cast("string"), F.lit(".0.0/16")).alias("network"), F.col("n_name").alias("country"), *empty)
    six = nation.select(F.concat(F.lit("2001:db8:"), F.lower(F.hex("n_nationkey")), F.lit("00::/40")).alias("network"), F.concat(F.lit("six "), F.col("n_name")).alias("country"), *empty)
    wide = m.spark.createDataFrame([("10.80.0.0/12", "Wide"), ("10.96.0.0/11", "Wide"), ("2001:db8::/32", "Six"), ("2001:DB8:0:0:0:0:0:7/128", "Host")], "network string, country string")
    return fine.unionByName(six).unionByName(wide.select("network", "country", *empty))


@query("SCL31_locate_ip6", f"""WITH {EV} SELECT event_id, CASE WHEN k = 0 THEN 'Host' WHEN k < 5 THEN 'six NATION_' || k WHEN k < 90 THEN 'Six' END AS country FROM ev""")
def _(m):
    k, tail = F.col("k"), F.lit("::7")
    address = F.when(k == 0, "2001:db8::7").when(k < 5, F.concat(F.lit("2001:0db8:"), k.cast("string"), F.lit("a1:"), F.lit("1::"), F.lower(F.hex(F.col("event_id") % 65536))))
    address = address.when(k < 90, F.concat(F.lit("2001:DB8:f"), F.lpad(k.cast("string"), 3, "0"), tail)).when(k < 95, "2001:db9::1").otherwise("no address")
    return enrich.locate(m.ev.select("event_id", address.alias("ip")), _networks(m)).select("event_id", "country")


@query("SCL31_locate_ip", f"WITH {EV} SELECT event_id, CASE WHEN k < 50 THEN 'NATION_' || (k // 10) WHEN k >= 80 THEN 'Wide' END AS country FROM ev")
def _(m):
    rows = m.ev.select("event_id", F.concat(F.lit("10."), F.col("k").cast("string"), F.lit("."), (F.col("event_id") % 256).cast("string"), F.lit(".7")).alias("ip"))
    return enrich.locate(rows, _networks(m)).select("event_id", "country")


@query("SCL32_intent", "SELECT conv_id, turn, CASE WHEN regexp_matches(q, 'error|bug|exception|crash') THEN 'errors' WHEN regexp_matches(q, 'page|url|landing') THEN 'top_pages' WHEN regexp_matches(q, 'referrer|source|utm|campaign|channel') THEN 'referrers' WHEN regexp_matches(q, 'event|conversion|click|signup|purchase') THEN 'events' WHEN regexp_matches(q, 'device|browser|os|mobile|desktop') THEN 'devices' WHEN regexp_matches(q, 'country|geo|region|city|location') THEN 'geo' WHEN regexp_matches(q, 'trend|over time|timeseries|daily') THEN 'traffic_trend' ELSE 'overview' END AS intent FROM (SELECT conv_id, turn, lower(text) AS q FROM conversations WHERE role = 'user')")
def _(m):
    return m.table("conversations").filter("role = 'user'").select("conv_id", "turn", enrich.intent(F.col("text")).alias("intent"))
