"""Retention (INS11-INS14), stickiness, lifecycle, paths and flows (INS15-INS21)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from clickloom.catalog.oracle import EV, EVS, SESS, r4, ts
from clickloom.catalog.registry import query
from clickloom.functions import calendar
from clickloom.operators import engagement as E, paths as X, retention as R
from clickloom.operators.paths import PathsQuery
from clickloom.operators.retention import RetentionQuery
from clickloom.operators.trends import Breakdown, Series, TrendsQuery
from clickloom.plans.ordered import Following, Previous, Running, Timeline

RQ = RetentionQuery(Series("signup"), "2024-01-05", "2024-01-12", Series("purchase"), total_intervals=5)


def _cells(first_time: bool, cumulative: bool, bd: str = "''") -> str:
    pick = "WHERE c = firstc AND NOT EXISTS (SELECT 1 FROM ev x WHERE x.visitor_id = s.visitor_id AND event = 'signup' AND created_at < TIMESTAMP '2024-01-05')" if first_time else ""
    back = "r.p >= s.c + i AND r.p <= s.c + least(5, 12 - s.c) - 1" if cumulative else "r.p = s.c + i"
    return f"""{EV}, st0 AS (SELECT visitor_id, date_diff('day', TIMESTAMP '2024-01-05', date_trunc('day', created_at)) AS c, min({bd}) AS bd FROM ev
    WHERE event = 'signup' AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-12' GROUP BY 1, 2),
  st AS (SELECT visitor_id, c, bd FROM (SELECT *, min(c) OVER (PARTITION BY visitor_id) AS firstc FROM st0) s {pick}),
  rt AS (SELECT DISTINCT visitor_id, date_diff('day', TIMESTAMP '2024-01-05', date_trunc('day', created_at)) AS p FROM ev
    WHERE event = 'purchase' AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-17'),
  cells AS (SELECT s.visitor_id, s.bd, s.c, i FROM st s CROSS JOIN range(5) g(i) WHERE i < least(5, 12 - s.c)
    AND (i = 0 OR EXISTS (SELECT 1 FROM rt r WHERE r.visitor_id = s.visitor_id AND {back})))"""


_GRID = """counts AS (SELECT bd, c, i, count(*) AS n FROM cells GROUP BY ALL),
  dense AS (SELECT g.bd, c, i FROM groups g CROSS JOIN range(7) a(c) CROSS JOIN range(5) b(i) WHERE i < least(5, 12 - c))
  SELECT nullif(d.bd, '') AS breakdown_value, strftime(TIMESTAMP '2024-01-05' + INTERVAL 1 DAY * CAST(d.c AS INTEGER), '%Y-%m-%dT%H:%M:%S') AS date,
    d.c AS cohort, d.i AS interval, coalesce(x.n, 0) AS count,
    ROUND(CASE WHEN coalesce(z.n, 0) > 0 THEN coalesce(x.n, 0) / z.n * 100 ELSE 0 END, 4) AS percentage
  FROM dense d LEFT JOIN counts x ON x.bd = d.bd AND x.c = d.c AND x.i = d.i LEFT JOIN counts z ON z.bd = d.bd AND z.c = d.c AND z.i = 0"""
_ONE = "groups AS (SELECT '' AS bd)"

for _name, _first, _cum in (("first_time", True, False), ("recurring", False, False), ("cumulative", False, True)):
    @query(f"INS11_retention_{_name}", f"WITH {_cells(_first, _cum)}, {_ONE}, {_GRID}")
    def _(m, first=_first, cum=_cum):
        return R.retention(m.stream(), replace(RQ, retention_type="first_time" if first else "recurring", cumulative=cum))


@query("WIN08_retained_or_later", f"WITH {_cells(False, True)} SELECT c AS cohort, i AS interval, count(*) AS count FROM cells GROUP BY 1, 2")
def _(m):
    found = R.cells(m.stream(), replace(RQ, retention_type="recurring", cumulative=True))
    return found.select("cohort", F.explode("retained").alias("interval")).groupBy("cohort", "interval").agg(F.count("*").alias("count"))


_TOPS = """tot AS (SELECT path AS bd, row_number() OVER (ORDER BY count(*) DESC, path) AS rank FROM ev WHERE event IN ('signup', 'purchase')
    AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-12' GROUP BY 1),
  groups AS (SELECT CASE WHEN rank <= 3 THEN bd ELSE '$$_other' END AS bd FROM tot WHERE rank <= 4)"""


@query("INS11_retention_breakdown", f"WITH {_cells(False, False, 'path').replace('cells AS (SELECT s.visitor_id, s.bd', 'cells0 AS (SELECT s.visitor_id, s.bd')}, {_TOPS}, cells AS (SELECT visitor_id, CASE WHEN rank <= 3 THEN bd ELSE '$$_other' END AS bd, c, i FROM cells0 LEFT JOIN tot USING (bd)), {_GRID}")
def _(m):
    return R.retention(m.stream(), replace(RQ, retention_type="recurring", breakdown=Breakdown("path", limit=3)))


@query("INS12_retention_actors", f"WITH {_cells(False, False)} SELECT visitor_id AS actor FROM cells WHERE c = 1 AND i = 2")
def _(m):
    return R.retention_actors(m.stream(), replace(RQ, retention_type="recurring"), 1, 2, limit=None)


for _period, _unit, _n in (("daily", "day", 30), ("weekly", "week", 5), ("monthly", "month", 1)):
    _classic = f"""WITH {SESS}, fv AS (SELECT visitor_id, date_trunc('{_unit}', min(first_at)) AS c FROM sessions GROUP BY 1),
      days AS (SELECT DISTINCT visitor_id, date_trunc('day', first_at) AS d FROM sessions),
      hits AS (SELECT c, date_diff('day', c, d) AS off, count(*) AS n FROM days JOIN fv USING (visitor_id) GROUP BY 1, 2),
      sizes AS (SELECT c, count(*) AS size FROM fv GROUP BY 1)
      SELECT strftime(g, '%Y-%m-%d') AS date, coalesce(size, 0) AS total_visitors, off AS period, coalesce(n, 0) AS visitors,
        ROUND(CASE WHEN size > 0 THEN coalesce(n, 0) / size * 100 ELSE 0 END, 4) AS percentage
      FROM generate_series(date_trunc('{_unit}', TIMESTAMP '2024-01-01'), TIMESTAMP '2024-01-30', INTERVAL 1 {_unit.upper()}) t(g)
        CROSS JOIN (VALUES (1), (7), (14), (30), (60), (90)) o(off) LEFT JOIN sizes s ON s.c = g LEFT JOIN hits h ON h.c = g AND h.off = o.off"""

    @query(f"INS13_classic_{_period}", _classic.replace("h.off = o.off", "h.off = o.off").replace("off AS period", "o.off AS period"))
    def _(m, period=_period):
        return R.classic_retention(m.sessions, "2024-01-01", "2024-01-30", period)


_MEASURE = {
    "pageviews": "SELECT visitor_id, created_at AS t, 1 AS v FROM pv", "events": "SELECT visitor_id, created_at, 1 FROM ce",
    "sessions": "SELECT visitor_id, first_at AS t, 1 AS v FROM sessions", "revenue": "SELECT visitor_id, created_at, CAST(revenue_amount AS DOUBLE) FROM ce",
}
for _metric, _source in _MEASURE.items():
    for _unit in ("week", "month") if _metric == "events" else ("week",):
        @query(f"INS14_cohort_{_metric}_{_unit}", f"""WITH {SESS}, fv AS (SELECT visitor_id, date_trunc('{_unit}', min(first_at)) AS c FROM sessions GROUP BY 1),
          sizes AS (SELECT c, count(*) AS size FROM fv GROUP BY 1), src(visitor_id, t, v) AS ({_source}),
          vals AS (SELECT c, date_trunc('{_unit}', t) AS p, sum(v) AS value FROM src JOIN fv USING (visitor_id) GROUP BY 1, 2),
          dense AS (SELECT c, size, unnest(generate_series(c, TIMESTAMP '2024-01-29', INTERVAL 1 {_unit.upper()})) AS p FROM sizes
            WHERE c BETWEEN date_trunc('{_unit}', TIMESTAMP '2024-01-01') AND TIMESTAMP '2024-01-30')
          SELECT strftime(d.c, '%Y-%m-%d') AS cohort, size, row_number() OVER (PARTITION BY d.c ORDER BY d.p) - 1 AS period_offset,
            {r4('coalesce(value, 0)')} AS value FROM dense d LEFT JOIN vals v ON v.c = d.c AND v.p = d.p""")
        def _(m, metric=_metric, unit=_unit):
            return R.cohort_table(m.sessions, {"pageviews": m.pageviews, "events": m.events}, "2024-01-01", "2024-01-30", unit, metric)


@query("JON19_cohort_members", f"""WITH {SESS}, fv AS (SELECT visitor_id, date_trunc('week', min(first_at)) AS c FROM sessions GROUP BY 1)
  SELECT strftime(c, '%Y-%m-%d') AS cohort, count(*) AS sessions FROM sessions JOIN fv USING (visitor_id) GROUP BY 1""")
def _(m):
    table = R.cohort_table(m.sessions, {}, "2024-01-01", "2024-02-20", "week", "sessions")
    return table.groupBy("cohort").agg(F.sum("value").cast("long").alias("sessions"))


@query("SCL27_period_starts", f"""WITH {EV}, b AS (SELECT path, min(created_at) AS lo, max(created_at) AS hi FROM ev GROUP BY 1)
  SELECT path, 'week' AS unit, strftime(unnest(generate_series(date_trunc('week', lo), date_trunc('day', hi), INTERVAL 7 DAY)), '%Y-%m-%d') AS start FROM b
  UNION ALL SELECT path, 'month', strftime(unnest(generate_series(date_trunc('month', lo), date_trunc('day', hi), INTERVAL 1 MONTH)), '%Y-%m-%d') FROM b""")
def _(m):
    b = m.ev.groupBy("path").agg(F.min("created_at").alias("lo"), F.max("created_at").alias("hi"))
    parts = [
        b.select("path", F.lit(u).alias("unit"), F.explode(calendar.period_starts(F.col("lo"), F.col("hi"), u)).alias("start"))
        for u in ("week", "month")
    ]
    return parts[0].unionByName(parts[1])


@query("SCL36_cohort_dates", f"""WITH {SESS} SELECT strftime(date_trunc('week', first_at), '%Y-%m-%d') AS cohort,
    strftime(date_trunc('week', first_at) + INTERVAL 7 DAY, '%Y-%m-%d') AS ends, count(*) AS n FROM sessions GROUP BY ALL""")
def _(m):
    start = F.to_date(F.date_trunc("week", "first_at"))
    dates = calendar.period_starts("2024-01-01", "2024-01-31", "week")
    return m.sessions.withColumn("cohort", F.element_at(F.filter(dates, lambda d: d <= F.to_date("first_at")), -1)).filter(
        F.col("cohort") == start
    ).groupBy("cohort", F.date_add("cohort", 7).alias("ends")).agg(F.count("*").alias("n"))


# Stickiness and lifecycle.

TQ = TrendsQuery((Series("click"), Series(None)), "2024-01-08", "2024-01-22")
IN = "created_at >= TIMESTAMP '2024-01-08' AND created_at < TIMESTAMP '2024-01-22'"
_STICK = f"""{EV}, a AS (SELECT 0 AS s, visitor_id, count(DISTINCT date_trunc('day', created_at)) AS n FROM ev WHERE {IN} AND event = 'click' GROUP BY ALL
    UNION ALL SELECT 1, visitor_id, count(DISTINCT date_trunc('day', created_at)) FROM ev WHERE {IN} GROUP BY ALL),
  h AS (SELECT s, n, count(*) AS actors FROM a GROUP BY 1, 2),
  d AS (SELECT s.s, i.n, coalesce(actors, 0) AS actors FROM range(2) s(s) CROSS JOIN range(1, 15) i(n) LEFT JOIN h ON h.s = s.s AND h.n = i.n)"""


@query("INS15_stickiness", f"WITH {_STICK} SELECT s AS series_index, n AS intervals, actors FROM d")
def _(m):
    return E.stickiness(m.stream(), TQ).drop("compare_label")


for _name in ("INS15_stickiness_cumulative", "WIN07_reverse_cumulative"):
    @query(_name, f"WITH {_STICK} SELECT s AS series_index, n AS intervals, CAST(sum(actors) OVER (PARTITION BY s ORDER BY n DESC) AS BIGINT) AS actors FROM d")
    def _(m):
        return E.stickiness(m.stream(), replace(TQ, cumulative=True)).drop("compare_label")


@query("INS16_stickiness_actors", f"WITH {_STICK} SELECT visitor_id AS actor FROM a WHERE s = 1 AND n = 14")
def _(m):
    return E.stickiness_actors(m.stream(), TQ, 1, 14, limit=None)


LQ = TrendsQuery((Series("purchase"),), "2024-01-08 06:00:00", "2024-01-22")
_LIFE = f"""{EV}, h AS (SELECT visitor_id, created_at, date_diff('day', TIMESTAMP '2024-01-08', date_trunc('day', created_at)) AS i FROM ev
    WHERE event = 'purchase' AND created_at < TIMESTAMP '2024-01-22'),
  first AS (SELECT visitor_id, min(i) AS f FROM h GROUP BY 1),
  act AS (SELECT DISTINCT visitor_id, i FROM h WHERE i = -1 OR created_at >= TIMESTAMP '2024-01-08 06:00:00'),
  st AS (SELECT a.visitor_id, a.i, CASE WHEN f = a.i THEN 'new' WHEN p.i IS NOT NULL THEN 'returning' ELSE 'resurrecting' END AS status
      FROM act a JOIN first USING (visitor_id) LEFT JOIN act p ON p.visitor_id = a.visitor_id AND p.i = a.i - 1 WHERE a.i >= 0
    UNION ALL SELECT a.visitor_id, a.i + 1, 'dormant' FROM act a LEFT JOIN act n ON n.visitor_id = a.visitor_id AND n.i = a.i + 1
      WHERE n.i IS NULL AND a.i + 1 < 14)"""


@query("INS17_lifecycle", f"""WITH {_LIFE}, c AS (SELECT i, status, count(*) AS n FROM st GROUP BY 1, 2)
  SELECT s.status, strftime(TIMESTAMP '2024-01-08' + INTERVAL 1 DAY * CAST(d.i AS INTEGER), '%Y-%m-%dT%H:%M:%S') AS bucket,
    coalesce(n, 0) * CASE s.status WHEN 'dormant' THEN -1 ELSE 1 END AS value
  FROM (VALUES ('new'), ('returning'), ('resurrecting'), ('dormant')) s(status) CROSS JOIN range(14) d(i) LEFT JOIN c ON c.i = d.i AND c.status = s.status""")
def _(m):
    return E.lifecycle(m.stream(), LQ)


@query("INS18_lifecycle_actors", f"WITH {_LIFE} SELECT visitor_id AS actor FROM st WHERE i = 4 AND status = 'dormant'")
def _(m):
    return E.lifecycle_actors(m.stream(), LQ, "2024-01-12T00:00:00", "dormant", limit=None)


# Paths and flows.

PQ = PathsQuery("2024-01-05", "2024-01-25", edge_limit=None)


def _paths(rows: str, limit: int, where: str = "true", start: str | None = None) -> str:
    started = f"sum(CASE WHEN item = '{start}' THEN 1 ELSE 0 END) OVER w" if start else "1"
    return f"""{EVS}, raw AS ({rows}),
  col AS (SELECT * FROM (SELECT *, lag(item) OVER (PARTITION BY session_id ORDER BY created_at, event_id) AS before FROM raw) WHERE item IS DISTINCT FROM before),
  beg AS (SELECT * FROM (SELECT *, {started} AS started FROM col WINDOW w AS (PARTITION BY session_id ORDER BY created_at, event_id ROWS UNBOUNDED PRECEDING)) WHERE started > 0),
  num AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, event_id) AS step FROM beg),
  shaped AS (SELECT session_id, visitor_id, item, created_at, step FROM num WHERE step <= {limit} AND {where}),
  moves AS (SELECT a.session_id, a.visitor_id, a.step || '_' || a.item AS source, b.step || '_' || b.item AS target,
      (epoch_us(b.created_at) - epoch_us(a.created_at)) / 1000000 AS secs
    FROM shaped a JOIN shaped b ON b.session_id = a.session_id AND b.step = a.step + 1)"""


_RANGE = "created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-25'"
_VIEWS = f"SELECT session_id, visitor_id, created_at, event_id, path AS item FROM evs WHERE {_RANGE} AND event = '$pageview'"
_EDGES = f"SELECT source, target, count(*) AS value, {r4('avg(secs)')} AS average_secs FROM moves GROUP BY 1, 2"


@query("INS19_paths", f"WITH {_paths(_VIEWS, 5)} {_EDGES}")
def _(m):
    return X.paths(m.stream(sessions=True), PQ)


_CLEANED = f"""SELECT session_id, visitor_id, created_at, event_id, CASE WHEN event = '$pageview' THEN
    CASE WHEN regexp_matches(path, '^/p[0-3]$') THEN '/low/' || right(path, 1) ELSE CASE WHEN path IN ('/p7', '/p8') THEN '/p*' ELSE path END END
    ELSE event END AS item FROM evs WHERE {_RANGE} AND event <> 'error' AND path <> '/p9'"""


@query("INS19_paths_start_point", f"WITH {_paths(_CLEANED, 4, start='/low/1')} {_EDGES} HAVING count(*) >= 2")
def _(m):
    spec = replace(
        PQ, custom_events=True, start_point="/low/1", step_limit=4, min_edge_weight=2, exclude=("error",),
        cleaning=(("^/p([0-3])$", "/low/$1"), ("^/p([78])$", "/px$1")), groupings=("/px*",),
    )
    items = X.path_items(m.stream(sessions=True).filter(F.col("properties")["path"] != "/p9"), spec)
    items = items.withColumn("item", F.when(F.col("item") == "/px*", "/p*").otherwise(F.col("item")))
    return X.weigh(X.edges(X.shape(items, spec)), spec)


@query("INS19_paths_end_point", f"""WITH {_paths(_VIEWS, 100000)}, ends AS (SELECT session_id, min(step) AS e FROM shaped WHERE item = '/p5' GROUP BY 1),
  cut AS (SELECT s.session_id, item, created_at, step - greatest(e - 3, 0) AS step FROM shaped s JOIN ends USING (session_id) WHERE step <= e AND step > e - 3)
  SELECT a.step || '_' || a.item AS source, b.step || '_' || b.item AS target, count(*) AS value,
    {r4('avg((epoch_us(b.created_at) - epoch_us(a.created_at)) / 1000000)')} AS average_secs
  FROM cut a JOIN cut b ON b.session_id = a.session_id AND b.step = a.step + 1 GROUP BY 1, 2""")
def _(m):
    return X.paths(m.stream(sessions=True), replace(PQ, end_point="/p5", step_limit=3))


@query("UDA06_path_shaping", f"WITH {_paths(_VIEWS, 3)} SELECT session_id, string_agg(item, '>' ORDER BY step) AS path FROM shaped GROUP BY 1")
def _(m):
    found = X.session_paths(m.stream(sessions=True), replace(PQ, step_limit=3))
    return found.select("session_id", F.array_join(F.transform("items", lambda e: e["item"]), ">").alias("path"))


@query("WIN14_collapse_repeats", f"WITH {_paths(_VIEWS, 100000)} SELECT session_id, count(*) AS steps FROM shaped GROUP BY 1")
def _(m):
    items = X.path_items(m.stream(sessions=True), PQ)
    line = Timeline(items, ["session_id"], "created_at", ["event_id"]).with_columns({"before": Previous(F.col("item"))})
    return line.result().filter(~F.col("item").eqNullSafe(F.col("before"))).groupBy("session_id").agg(F.count("*").alias("steps"))


@query("UDA07_edge_emission", f"WITH {_paths(_VIEWS, 5)} SELECT session_id, source, target, {r4('secs')} AS secs FROM moves")
def _(m):
    return X.edges(X.session_paths(m.stream(sessions=True), PQ)).drop("visitor_id")


@query("TOP03_heaviest_edges", f"""WITH {_paths(_VIEWS, 5)}, e AS (SELECT source, target, count(*) AS value FROM moves GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 40)
  SELECT source, target, value FROM e ORDER BY value DESC, source, target LIMIT 15""")
def _(m):
    spec = replace(PQ, edge_limit=15, min_edge_weight=2, max_edge_weight=40)
    return X.paths(m.stream(sessions=True), spec).select("source", "target", "value")


for _name, _kw, _where in (
    ("through_node", {"node": "2_/p3"}, "session_id IN (SELECT session_id FROM shaped WHERE step = 2 AND item = '/p3')"),
    ("on_edge", {"edge": ("1_/p1", "2_/p3")}, "session_id IN (SELECT session_id FROM moves WHERE source = '1_/p1' AND target = '2_/p3')"),
    ("dropped_at", {"dropped_at": "2_/p3"}, "session_id IN (SELECT session_id FROM shaped GROUP BY 1 HAVING max(step) = 2 AND arg_max(item, step) = '/p3')"),
):
    @query(f"INS20_path_actors_{_name}", f"WITH {_paths(_VIEWS, 5)} SELECT visitor_id AS actor, count(DISTINCT session_id) AS sessions FROM shaped WHERE {_where} GROUP BY 1")
    def _(m, kw=_kw):
        return X.path_actors(X.session_paths(m.stream(sessions=True), PQ), **kw, limit=None)


for _name, _direction, _fn, _cols in (
    ("INS21_page_flows_forward", "forward", "lead", "path AS from_path, near AS to_path"),
    ("INS21_page_flows_backward", "backward", "lag", "near AS from_path, path AS to_path"),
    ("WIN01_lead_path", "forward", "lead", "path AS from_path, near AS to_path"),
    ("WIN02_lag_path", "backward", "lag", "near AS from_path, path AS to_path"),
):
    @query(_name, f"""WITH {EVS}, o AS (SELECT *, {_fn}(path) OVER (PARTITION BY session_id ORDER BY created_at, event_id) AS near FROM pv),
      f AS (SELECT {_cols}, count(*) AS transitions FROM o WHERE path = '/p2' AND near IS NOT NULL GROUP BY ALL ORDER BY transitions DESC, from_path, to_path LIMIT 7)
      SELECT *, {r4('transitions / (SELECT sum(transitions) FROM f) * 100')} AS percentage FROM f""")
    def _(m, direction=_direction):
        return X.page_flows(m.pageviews, "/p2", direction, 7)


@query("SCL17_path_cleaning", f"""WITH {EV} SELECT event_id, CASE WHEN path = '/p1' THEN '/one/' ELSE CASE WHEN k >= 50 THEN '/user/*' ELSE '/user/:id' || path END END AS item FROM ev""")
def _(m):
    raw = F.when(F.col("path") == "/p1", F.lit("/p1")).when(F.col("k") >= 50, F.concat(F.lit("/user/x"), F.col("path"))).otherwise(
        F.concat(F.lit("/user/"), F.col("k").cast("string"), F.col("path")))
    return m.ev.select("event_id", X.clean_item(raw, (("/user/[0-9]+", "/user/:id"), ("^/p1$", "/one/"), ("^/user/x/", "/group/")), ("/group/*",)).alias("c")).select(
        "event_id", F.when(F.col("c") == "/group/*", "/user/*").otherwise(F.col("c")).alias("item"))
