"""Trends (INS01-INS03), their maths (AGG01-AGG09) and buckets (SCL01-SCL04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.catalog.oracle import EV, EVS, PROFILES, r4, ts
from clickloom.catalog.registry import query
from clickloom.functions import calendar
from clickloom.functions.props import PropertyFilter as P
from clickloom.operators import trends as T
from clickloom.operators.trends import Breakdown, Series, TrendsQuery, trends, trends_actors

FROM, TO = "2024-01-08", "2024-01-22"
IN = "created_at >= TIMESTAMP '2024-01-08' AND created_at < TIMESTAMP '2024-01-22'"
LABEL = "strftime({}, '%Y-%m-%dT%H:%M:%S')"


def days(start: str = FROM, end: str = TO) -> str:
    return (
        f"SELECT {ts('g')} AS bucket FROM generate_series(TIMESTAMP '{start}', "
        f"TIMESTAMP '{end}' - INTERVAL 1 MICROSECOND, INTERVAL 1 DAY) t(g)"
    )


def day(column: str = "created_at") -> str:
    return ts(f"date_trunc('day', {column})")


def q(*series: Series, **kw) -> TrendsQuery:
    return TrendsQuery(series, kw.pop("date_from", FROM), kw.pop("date_to", TO), **kw)


def _math_sql(value: str, where: str = "true", source: str = EV) -> str:
    return f"""WITH {source}, days AS ({days()}),
    v AS (SELECT {day()} AS bucket, {value} AS value FROM {'evs' if 'evs AS' in source else 'ev'} WHERE {IN} AND {where} GROUP BY 1)
    SELECT bucket, {r4('coalesce(value, 0)')} AS value FROM days LEFT JOIN v USING (bucket)"""


def _math(name: str, series: Series, value: str, where: str = "true", sessions: bool = False, source=None) -> None:
    def run(m):
        ev = m.grouped_ev if series.math == "unique_group" else m.stream(sessions=sessions)
        return trends(ev, q(series)).select("bucket", "value")

    query(name, _math_sql(value, where, source or (EVS if sessions else EV)))(run)


_math("AGG01_total", Series("purchase"), "count(*)", "event = 'purchase'")
_math("AGG02_dau", Series("$pageview", "dau"), "count(DISTINCT visitor_id)", "event = '$pageview'")
_math("AGG03_unique_sessions", Series(None, "unique_sessions"), "count(DISTINCT session_id)", sessions=True)
_math(
    "AGG04_unique_group", Series("click", "unique_group", math_group_type_index=0), "count(DISTINCT c_nationkey)",
    "event = 'click'", source=EV.replace("ev AS (", "ev0 AS (") + ", ev AS (SELECT * FROM ev0 LEFT JOIN customer ON uid = c_custkey)",
)
for _m in ("sum", "avg", "min", "max"):
    _math(f"AGG05_{_m}", Series("purchase", _m, "revenue"), f"{_m}(CAST(revenue_amount AS DOUBLE))", "event = 'purchase'")
for _m, _p in T.QUANTILES.items():
    _math(f"AGG06_{_m}", Series("purchase", _m, "revenue"), f"quantile_cont(CAST(revenue_amount AS DOUBLE), {_p})", "event = 'purchase'")
for _m, _e in {"avg": "avg(c)", "min": "min(c)", "max": "max(c)", "median": "quantile_cont(c, 0.5)", "p90": "quantile_cont(c, 0.9)", "p95": "quantile_cont(c, 0.95)", "p99": "quantile_cont(c, 0.99)"}.items():
    @query(f"AGG07_per_actor_{_m}", f"""WITH {EV}, days AS ({days()}), c AS (
      SELECT {day()} AS bucket, visitor_id, count(*) AS c FROM ev WHERE {IN} GROUP BY 1, 2),
      v AS (SELECT bucket, {_e} AS value FROM c GROUP BY 1)
      SELECT bucket, {r4('coalesce(value, 0)')} AS value FROM days LEFT JOIN v USING (bucket)""")
    def _(m, math=_m):
        return trends(m.stream(), q(Series(math=f"per_actor_{math}"))).select("bucket", "value")


TOP5 = f"""hits AS (SELECT *, coalesce(CASE WHEN event = '$pageview' THEN title END, '$$_none') AS raw FROM ev WHERE {IN}),
 tot AS (SELECT path AS bd, count(*) AS n FROM hits GROUP BY 1),
 ranked AS (SELECT bd, n, row_number() OVER (ORDER BY n DESC, bd) AS rank FROM tot)"""


@query("AGG08_breakdown_ranking", f"WITH {EV}, {TOP5} SELECT bd, rank FROM ranked WHERE rank <= 5 UNION ALL SELECT '$$_other', 6")
def _(m):
    found = T.hits(m.stream(), q(Series("$pageview"), Series("click"), Series("signup"), Series("error"), Series("purchase"), breakdown=Breakdown("path")))
    return T.top_breakdowns(found, 5)


@query("TOP02_top_breakdown_values", f"WITH {EV}, {TOP5} SELECT bd, rank FROM ranked WHERE rank <= 3 UNION ALL SELECT '$$_other', 4")
def _(m):
    return T.top_breakdowns(T.hits(m.stream(), q(Series(), breakdown=Breakdown("path"))), 3)


@query("AGG09_breakdown_none_and_other", f"""WITH {EV}, hits AS (SELECT {day()} AS bucket,
    coalesce(CASE WHEN event = '$pageview' THEN title END, '$$_none') AS raw FROM ev WHERE {IN}),
  ranked AS (SELECT raw, row_number() OVER (ORDER BY count(*) DESC, raw) AS rank FROM hits GROUP BY 1),
  groups AS (SELECT CASE WHEN rank <= 2 THEN raw ELSE '$$_other' END AS bd FROM ranked WHERE rank <= 3),
  v AS (SELECT bucket, CASE WHEN rank <= 2 THEN raw ELSE '$$_other' END AS bd, count(*) AS n FROM hits JOIN ranked USING (raw) GROUP BY 1, 2)
  SELECT nullif(g.bd, '$$_none') AS breakdown_value, d.bucket, {r4('coalesce(n, 0)')} AS value
  FROM groups g CROSS JOIN ({days()}) d LEFT JOIN v ON v.bd = g.bd AND v.bucket = d.bucket""")
def _(m):
    return trends(m.stream(), q(Series(), breakdown=Breakdown("title", limit=2))).select("breakdown_value", "bucket", "value")


@query("INS01_trends_dau_breakdown", f"""WITH {EV}, {TOP5}, groups AS (
    SELECT CASE WHEN rank <= 5 THEN bd ELSE '$$_other' END AS bd FROM ranked WHERE rank <= 6),
  labelled AS (SELECT {day()} AS bucket, visitor_id, CASE WHEN rank <= 5 THEN bd ELSE '$$_other' END AS bd
    FROM hits JOIN ranked ON path = bd),
  v AS (SELECT bucket, bd, count(DISTINCT visitor_id) AS value FROM labelled GROUP BY 1, 2),
  o AS (SELECT 'All events' AS label, 0 AS series_index, g.bd AS breakdown_value, d.bucket, {r4('coalesce(value, 0)')} AS value
    FROM groups g CROSS JOIN ({days()}) d LEFT JOIN v ON v.bd = g.bd AND v.bucket = d.bucket)
  SELECT *, sum(value) OVER (PARTITION BY breakdown_value) AS total FROM o""")
def _(m):
    return trends(m.stream(), q(Series(math="dau"), breakdown=Breakdown("path", limit=5))).drop("compare_label")


@query("INS01_trends_many_series", f"""WITH {EV}, {PROFILES}, e AS (SELECT ev.*, plan, {day()} AS bucket FROM ev LEFT JOIN profiles USING (visitor_id)
    WHERE {IN} AND k < 90), days AS ({days()}), v AS (
  SELECT 0 AS i, bucket, count(*) AS value FROM e WHERE event = '$pageview' GROUP BY ALL
  UNION ALL SELECT 1, bucket, count(DISTINCT visitor_id) FROM e WHERE event = 'click' AND plan = 'BUILDING' GROUP BY ALL
  UNION ALL SELECT 2, bucket, sum(CAST(revenue_amount AS DOUBLE)) FROM e WHERE event = 'purchase' GROUP BY ALL
  UNION ALL SELECT 3, bucket, quantile_cont(CAST(k AS DOUBLE), 0.9) FROM e GROUP BY ALL
  UNION ALL SELECT 4, bucket, avg(c) FROM (SELECT bucket, visitor_id, count(*) AS c FROM e GROUP BY ALL) GROUP BY ALL)
  SELECT s.i AS series_index, CASE s.i WHEN 0 THEN '$pageview' WHEN 1 THEN 'buyers' WHEN 2 THEN 'purchase' ELSE 'All events' END AS label,
    days.bucket, {r4('coalesce(value, 0)')} AS value
  FROM range(5) s(i) CROSS JOIN days LEFT JOIN v ON v.i = s.i AND v.bucket = days.bucket""")
def _(m):
    from clickloom.sources.event_stream import join_profiles

    spec = q(
        Series("$pageview"), Series("click", "dau", properties=(P("plan", "exact", "BUILDING", "person"),), custom_name="buyers"),
        Series("purchase", "sum", "revenue"), Series(math="p90", math_property="k"), Series(math="per_actor_avg"),
        properties=(P("k", "lt", 90),),
    )
    return trends(join_profiles(m.stream(), m.profiles), spec).select("series_index", "label", "bucket", "value")


_COMPARE = f"""WITH {EV}, v AS (SELECT {day()} AS bucket, count(*) FILTER (WHERE event = 'purchase') AS a,
    count(*) FILTER (WHERE event = '$pageview') AS b FROM ev GROUP BY 1),
  d AS (SELECT 'current' AS compare_label, bucket FROM ({days()}) UNION ALL
        SELECT 'previous', bucket FROM ({days('2023-12-25', '2024-01-08')})),
  f AS (SELECT compare_label, bucket, CASE WHEN coalesce(b, 0) = 0 THEN 0 ELSE a / b * 100 END AS x FROM d LEFT JOIN v USING (bucket)),
  s AS (SELECT compare_label, bucket, avg(x) OVER (PARTITION BY compare_label ORDER BY bucket ROWS 2 PRECEDING) AS x FROM f)"""


@query("INS01_trends_formula_compare", f"""{_COMPARE},
  c AS (SELECT compare_label, bucket, sum(x) OVER (PARTITION BY compare_label ORDER BY bucket) AS x FROM s)
  SELECT 'Formula (A / B * 100)' AS label, compare_label, bucket, {r4('x')} AS value, {r4('sum(x) OVER (PARTITION BY compare_label)')} AS total FROM c""")
def _(m):
    spec = q(Series("purchase"), Series("$pageview"), formula="A / B * 100", compare=True, smoothing_intervals=3, cumulative=True)
    return trends(m.stream(), spec).select("label", "compare_label", "bucket", "value", "total")


@query("SCL03_formula", f"""WITH {EV}, v AS (SELECT {day()} AS bucket, count(*) FILTER (WHERE event = 'purchase') AS a,
    count(*) FILTER (WHERE event = 'click') AS b FROM ev GROUP BY 1)
  SELECT bucket, {r4('(coalesce(a, 0) + coalesce(b, 0)) * -2 - coalesce(a, 0) / 4')} AS value FROM ({days()}) LEFT JOIN v USING (bucket)""")
def _(m):
    return trends(m.stream(), q(Series("purchase"), Series("click"), formula="(a + b) * -2 - a / 4")).select("bucket", "value")


@query("WIN05_trailing_mean", f"""{_COMPARE} SELECT bucket, {r4('x')} AS value FROM s WHERE compare_label = 'current'""")
def _(m):
    return trends(m.stream(), q(Series("purchase"), Series("$pageview"), formula="A / B * 100", smoothing_intervals=3)).select("bucket", "value")


@query("WIN06_cumulative", f"""WITH {EV}, v AS (SELECT {day()} AS bucket, count(*) AS n FROM ev WHERE event = 'click' GROUP BY 1)
  SELECT bucket, {r4('sum(coalesce(n, 0)) OVER (ORDER BY bucket)')} AS value FROM ({days()}) LEFT JOIN v USING (bucket)""")
def _(m):
    return trends(m.stream(), q(Series("click"), cumulative=True)).select("bucket", "value")


@query("INS03_trends_actors", f"""WITH {EV}, {PROFILES} SELECT e.visitor_id AS actor_id, count(*) AS event_count, {ts('min(created_at)')} AS first_at,
    {ts('max(created_at)')} AS last_at, min(p.user_id) AS user_id, min(p.plan) AS plan FROM ev e LEFT JOIN profiles p USING (visitor_id)
  WHERE {day()} = '2024-01-10T00:00:00' AND event = '$pageview' AND path = '/p3' GROUP BY 1""")
def _(m):
    spec = q(Series("$pageview"), breakdown=Breakdown("path", limit=20))
    actors = trends_actors(m.stream(), spec, 0, "2024-01-10T00:00:00", "/p3", limit=None)
    return T.hydrate_people(actors, m.profiles).withColumn("plan", F.col("traits")["plan"]).drop("traits")


@query("JON25_actor_hydration", f"""WITH {EV} SELECT n_name AS actor_id, count(*) AS event_count, n_name AS name, CAST(n_nationkey AS VARCHAR) AS size
  FROM ev JOIN customer ON uid = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE {IN} GROUP BY n_name, n_nationkey""")
def _(m):
    actors = trends_actors(m.grouped_ev, q(Series(), aggregation_group_type_index=0), 0, limit=None)
    out = T.hydrate_groups(actors, m.groups, 0)
    return out.select("actor_id", "event_count", F.col("actor_id").alias("name"), F.col("group_properties")["size"].alias("size"))


for _unit in calendar.UNITS:
    @query(f"SCL01_bucket_{_unit}", f"""WITH {EV} SELECT {ts(f"date_trunc('{_unit}', created_at + INTERVAL 330 MINUTE)")} AS bucket,
      count(*) AS n FROM ev GROUP BY 1""")
    def _(m, unit=_unit):
        return m.ev.groupBy(calendar.bucket(F.col("created_at"), unit, "Asia/Kolkata").alias("bucket")).agg(F.count("*").alias("n"))


@query("SCL02_dense_labels", f"""WITH {EV}, v AS (SELECT path, {ts("date_trunc('hour', created_at)")} AS bucket, count(*) AS n FROM ev GROUP BY 1, 2)
  SELECT p.path, d.bucket, coalesce(n, 0) AS n FROM (SELECT DISTINCT path FROM ev) p CROSS JOIN (SELECT {ts('g')} AS bucket FROM generate_series(
    TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-11 23:00:00', INTERVAL 1 HOUR) t(g)) d LEFT JOIN v ON v.path = p.path AND v.bucket = d.bucket""")
def _(m):
    counts = m.ev.groupBy("path", calendar.bucket(F.col("created_at"), "hour").alias("bucket")).agg(F.count("*").alias("n"))
    dense = calendar.with_dense_buckets(m.ev.select("path").distinct(), "2024-01-10", "2024-01-12", "hour")
    return dense.join(counts, ["path", "bucket"], "left").fillna(0, ["n"])


@query("SCL04_epoch_seconds", f"WITH {EV} SELECT event_id, epoch_us(created_at) AS epoch_micros FROM ev")
def _(m):
    seconds = calendar.epoch_seconds(F.col("created_at"))
    return m.ev.select("event_id", F.round(seconds * 1e6).cast("long").alias("epoch_micros"))
