"""Funnels: attempts (UDA01-UDA05), reports (INS04-INS10) and saved funnels."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from clickloom.catalog.oracle import EV, r4, ts
from clickloom.catalog.registry import query
from clickloom.functions.props import PropertyFilter as P
from clickloom.operators import funnels as N
from clickloom.operators.funnels import Exclusion, FunnelQuery, SavedStep, Step
from clickloom.operators.trends import Breakdown
from clickloom.session import cut_lineage

STEPS = (Step("$pageview"), Step("click"), Step("purchase"))
Q = FunnelQuery(STEPS, "2024-01-05", "2024-01-20", window=2)
W = "INTERVAL 2 DAY"
BY_PATH = replace(Q, breakdown=Breakdown("path", limit=4))


def _next(step: str, after: str, name: str, strict: bool = False) -> str:
    test = "true" if strict else f"x.event = '{step}'"
    pick = (
        f"SELECT x.created_at AS t, x.event_id AS id, x.path AS bd, x.event AS event FROM f x WHERE x.visitor_id = e.visitor_id "
        f"AND {test} AND (x.created_at, x.event_id) > ({after}.t, {after}.id) ORDER BY x.created_at, x.event_id LIMIT 1"
    )
    return f"LEFT JOIN LATERAL ({pick}) {name} ON true"


def attempts(where: str = "true", steps=("$pageview", "click", "purchase"), strict: bool = False, names: bool = True) -> str:
    """Every ordered three-step attempt and the best one per visitor, as SQL."""
    listed = ", ".join(f"'{s}'" for s in (*steps, "error"))
    only = "" if strict else f" AND event IN ({listed})"
    hit1 = f"(n1.t - e.t <= {W}" + (f" AND n1.event = '{steps[1]}'" if strict else "") + ")"
    hit2 = f"(n2.t - e.t <= {W}" + (f" AND n2.event = '{steps[2]}'" if strict else "") + ")"
    return f"""{EV}, f AS (SELECT * FROM ev WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-22'{only}),
    e0 AS (SELECT visitor_id, created_at AS t, event_id AS id, path AS bd FROM f
      WHERE event = '{steps[0]}' AND created_at < TIMESTAMP '2024-01-20'),
    a AS (SELECT e.visitor_id, e.t AS t0, e.id AS id0, e.bd AS bd0, n1.t AS n1t, n2.t AS n2t, n1.bd AS bd1, n2.bd AS bd2,
        CASE WHEN coalesce({hit1}, false) THEN CASE WHEN coalesce({hit2}, false) THEN 3 ELSE 2 END ELSE 1 END AS reached
      FROM e0 e {_next(steps[1], 'e', 'n1', strict)} {_next(steps[2], 'n1', 'n2', strict)}),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY visitor_id ORDER BY reached DESC, t0, id0) AS rn
      FROM a WHERE {where}) WHERE rn = 1),
    best AS (SELECT visitor_id AS actor, reached, t0, CASE WHEN reached > 1 THEN n1t END AS t1, CASE WHEN reached > 2 THEN n2t END AS t2,
      bd0, CASE reached WHEN 3 THEN bd2 WHEN 2 THEN bd1 ELSE bd0 END AS bd_last, CASE WHEN reached > 1 THEN bd1 ELSE bd0 END AS bd_step1 FROM b)"""


BEST = attempts()
PLAIN = f"SELECT actor, reached, {ts('t0')} AS t0, epoch_us(t0) AS us0, epoch_us(t1) AS us1, epoch_us(t2) AS us2"


def _flat(found):
    def at(i):
        return F.round(F.get("times", F.lit(i)) * 1e6).cast("long")

    return found.select(
        "actor", "reached", F.timestamp_micros(at(0)).alias("t0"), at(0).alias("us0"), at(1).alias("us1"), at(2).alias("us2"), "bd"
    )


@query("UDA01_ordered", f"WITH {BEST} {PLAIN} FROM best")
def _(m):
    return _flat(N.outcomes(m.stream(), Q)).drop("bd")


@query("UDA01_strict", f"WITH {attempts(strict=True)} {PLAIN} FROM best")
def _(m):
    return _flat(N.outcomes(m.stream(), replace(Q, order="strict"))).drop("bd")


@query("UDA01_one_actor", f"""WITH {EV}, f AS (SELECT * FROM ev WHERE event IN ('$pageview', 'click') AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-22'),
    e AS (SELECT event, created_at AS t, event_id AS id, first_value(CASE WHEN event = 'click' THEN created_at END IGNORE NULLS) OVER (
      ORDER BY created_at, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM f)
    SELECT 'all' AS actor, CAST(CASE WHEN coalesce(n - t <= {W}, false) THEN 2 ELSE 1 END AS INTEGER) AS reached, epoch_us(t) AS us0, CASE WHEN n - t <= {W} THEN epoch_us(n) END AS us1
    FROM e WHERE event = '$pageview' AND t < TIMESTAMP '2024-01-20' ORDER BY reached DESC, t, id LIMIT 1""")
def _(m):
    """All events as those of one actor."""
    one = m.stream().withColumn("visitor_id", F.lit("all"))
    found = N.outcomes(one, replace(Q, steps=STEPS[:2]))
    return _flat(found).select("actor", "reached", "us0", "us1")


@query("UDA02_next_match", f"""WITH {EV} SELECT event_id, (SELECT x.event_id FROM ev x WHERE x.visitor_id = e.visitor_id AND x.event = 'purchase'
    AND (x.created_at, x.event_id) > (e.created_at, e.event_id) ORDER BY x.created_at, x.event_id LIMIT 1) AS next_purchase FROM ev e""")
def _(m):
    from clickloom.plans.ordered import Following, Timeline

    line = Timeline(m.ev, ["visitor_id"], "created_at", ["event_id"])
    found = line.with_columns({"next_purchase": Following(F.col("event_id"), F.col("event") == "purchase")})
    return found.result().select("event_id", "next_purchase")


_UNORDERED = f"""{EV}, f AS (SELECT * FROM ev WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-22'
      AND event IN ('$pageview', 'click', 'purchase')),
    a AS (SELECT e.visitor_id, e.created_at AS t0, e.event_id AS id0, count(DISTINCT x.event) AS reached
      FROM f e JOIN f x ON x.visitor_id = e.visitor_id AND (x.created_at, x.event_id) >= (e.created_at, e.event_id)
        AND x.created_at - e.created_at <= {W}
      WHERE e.created_at < TIMESTAMP '2024-01-20' GROUP BY ALL),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY visitor_id ORDER BY reached DESC, t0, id0) AS rn FROM a) WHERE rn = 1)"""


@query("UDA03_unordered", f"WITH {_UNORDERED} SELECT visitor_id AS actor, reached, epoch_us(t0) AS us0 FROM b")
def _(m):
    return _flat(N.outcomes(m.stream(), replace(Q, order="unordered"))).select("actor", "reached", "us0")


# Overlapping steps: any page view, and a view of /p1 to /p4. Two steps are matched
# when the window holds one such page and one further view.
@query("UDA03_unordered_overlap", f"""WITH {EV}, f AS (SELECT *, path IN ('/p1', '/p2', '/p3', '/p4') AS narrow FROM ev
      WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-22' AND event = '$pageview'),
    a AS (SELECT e.visitor_id, e.created_at AS t0, e.event_id AS id0, CASE WHEN bool_or(x.narrow) AND count(*) > 1 THEN 2 ELSE 1 END AS reached
      FROM f e JOIN f x ON x.visitor_id = e.visitor_id AND (x.created_at, x.event_id) >= (e.created_at, e.event_id)
        AND x.created_at - e.created_at <= {W} WHERE e.created_at < TIMESTAMP '2024-01-20' GROUP BY ALL),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY visitor_id ORDER BY reached DESC, t0, id0) AS rn FROM a) WHERE rn = 1)
    SELECT visitor_id AS actor, reached, epoch_us(t0) AS us0 FROM b""")
def _(m):
    steps = (Step("$pageview"), Step("$pageview", (P("path", "exact", ["/p1", "/p2", "/p3", "/p4"]),)))
    return _flat(N.outcomes(m.stream(), replace(Q, steps=steps, order="unordered"))).select("actor", "reached", "us0")


_CLEAN = f"""NOT EXISTS (SELECT 1 FROM f x WHERE x.visitor_id = a.visitor_id AND x.event = 'error' AND (x.created_at, x.event_id) > (a.t0, a.id0)
    AND x.created_at <= CASE WHEN a.reached > 1 THEN a.n1t ELSE a.t0 + {W} END)"""


@query("UDA04_exclusion", f"WITH {attempts(_CLEAN)} {PLAIN} FROM best")
def _(m):
    return _flat(N.outcomes(m.stream(), replace(Q, exclusions=(Exclusion("error", from_step=0, to_step=1),)))).drop("bd")


for _kind, _column in (("first_touch", "bd0"), ("last_touch", "bd_last"), ("step", "bd_step1")):
    @query(f"UDA05_{_kind}", f"WITH {BEST} SELECT actor, {_column} AS bd FROM best")
    def _(m, kind=_kind):
        return N.outcomes(m.stream(), replace(BY_PATH, attribution=kind, attribution_step=1)).select("actor", "bd")


@query("INS04_funnel_rows", f"""WITH {EV} SELECT visitor_id AS actor, event_id, event = '$pageview' AS s0, event = 'click' AND k > 50 AS s1,
    event = 'error' AS x0, path AS bd FROM ev WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-22'
    AND (event IN ('$pageview', 'error') OR (event = 'click' AND k > 50))""")
def _(m):
    steps = (Step("$pageview"), Step("click", (P("k", "gt", 50),)))
    spec = replace(Q, steps=steps, exclusions=(Exclusion("error"),), breakdown=Breakdown("path"))
    return N.candidates(m.stream(), spec).drop("created_at")


_STEP_ROWS = """r AS (SELECT g, step, CASE step WHEN 1 THEN epoch_us(t1) - epoch_us(t0) WHEN 2 THEN epoch_us(t2) - epoch_us(t1) END / 1000000 AS secs
    FROM grp CROSS JOIN range(3) s(step) WHERE reached > step),
  c AS (SELECT g, step, count(*) AS n, avg(secs) AS avg_secs, median(secs) AS median_secs FROM r GROUP BY 1, 2),
  d AS (SELECT g.g, s.step, coalesce(n, 0) AS n, avg_secs, median_secs FROM (SELECT DISTINCT g FROM grp) g CROSS JOIN range(3) s(step)
    LEFT JOIN c ON c.g = g.g AND c.step = s.step),
  o AS (SELECT *, first_value(n) OVER w AS entered, coalesce(lag(n) OVER w, n) AS before FROM d WINDOW w AS (PARTITION BY g ORDER BY step))
  SELECT nullif(g, '') AS breakdown_value, step, CASE step WHEN 0 THEN '$pageview' WHEN 1 THEN 'click' ELSE 'purchase' END AS name, n AS count,
    ROUND(CASE WHEN entered > 0 THEN n / entered * 100 ELSE 0 END, 4) AS conversion_rate,
    ROUND(CASE WHEN before > 0 THEN n / before * 100 ELSE 0 END, 4) AS conversion_rate_from_previous,
    before - n AS dropoff_count, ROUND(avg_secs, 4) AS avg_secs, ROUND(median_secs, 4) AS median_secs FROM o"""
_GROUPS = """ranked AS (SELECT bd0, row_number() OVER (ORDER BY count(*) DESC, bd0) AS rank FROM best GROUP BY 1),
  grp AS (SELECT best.*, CASE WHEN rank <= 4 THEN bd0 ELSE '$$_other' END AS g FROM best JOIN ranked USING (bd0))"""
_ALL = "grp AS (SELECT *, '' AS g FROM best)"


@query("INS05_funnel_steps", f"WITH {BEST}, {_ALL}, {_STEP_ROWS}")
def _(m):
    return N.funnel_steps(cut_lineage(N.outcomes(m.stream(), Q)), Q)


@query("WIN13_step_over_previous", f"WITH {BEST}, {_ALL}, {_STEP_ROWS}".replace("SELECT nullif(g, '') AS breakdown_value, step, CASE", "SELECT step, CASE").replace(", ROUND(avg_secs, 4) AS avg_secs, ROUND(median_secs, 4) AS median_secs", ""))
def _(m):
    return N.funnel_steps(cut_lineage(N.outcomes(m.stream(), Q)), Q).drop("breakdown_value", "avg_secs", "median_secs")


@query("INS08_funnel_breakdown", f"WITH {BEST}, {_GROUPS}, {_STEP_ROWS}")
def _(m):
    return N.funnel_steps(cut_lineage(N.outcomes(m.stream(), BY_PATH)), BY_PATH)


@query("TOP04_funnel_groups", f"WITH {BEST}, {_GROUPS} SELECT g AS bd, count(*) AS entered FROM grp GROUP BY 1")
def _(m):
    return N.grouped(cut_lineage(N.outcomes(m.stream(), BY_PATH)), BY_PATH).groupBy("bd").agg(F.count("*").alias("entered"))


_SECS = "secs AS (SELECT (epoch_us(t2) - epoch_us(t0)) / 1000000 AS secs FROM best WHERE reached = 3)"


@query("INS06_time_to_convert", f"WITH {BEST}, {_SECS} SELECT count(*) AS converted, {r4('avg(secs)')} AS average_secs, {r4('median(secs)')} AS median_secs FROM secs")
def _(m):
    return N.time_to_convert(cut_lineage(N.outcomes(m.stream(), Q)), Q).drop("breakdown_value")


@query("SCL25_median", f"WITH {BEST}, {_SECS} SELECT {r4('median(secs)')} AS median_secs FROM secs")
def _(m):
    return N.time_to_convert(cut_lineage(N.outcomes(m.stream(), Q)), Q).select("median_secs")


for _name in ("INS06_convert_histogram", "SCL26_histogram"):
    @query(_name, f"""WITH {BEST}, {_SECS}, w AS (SELECT greatest(1, ceil(max(secs) / 20)) AS width FROM secs),
      c AS (SELECT least(CAST(floor(secs / width) AS BIGINT), 19) AS bin, count(*) AS n FROM secs, w GROUP BY 1)
      SELECT b.bin, {r4('b.bin * width')} AS from_secs, {r4('(b.bin + 1) * width')} AS to_secs, coalesce(n, 0) AS count
      FROM range(20) b(bin) CROSS JOIN w LEFT JOIN c ON c.bin = b.bin""")
    def _(m):
        return N.convert_histogram(cut_lineage(N.outcomes(m.stream(), Q)), Q).drop("breakdown_value")


@query("INS07_conversion_trend", f"""WITH {BEST}, c AS (SELECT date_trunc('day', t0) AS d, count(*) AS entered, count(*) FILTER (WHERE reached = 3) AS converted
    FROM best GROUP BY 1) SELECT {ts('g')} AS bucket, coalesce(entered, 0) AS entered, coalesce(converted, 0) AS converted,
    ROUND(CASE WHEN entered > 0 THEN converted / entered * 100 ELSE 0 END, 4) AS conversion_rate
  FROM generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-19', INTERVAL 1 DAY) t(g) LEFT JOIN c ON c.d = g""")
def _(m):
    return N.conversion_trend(cut_lineage(N.outcomes(m.stream(), Q)), Q).drop("breakdown_value")


for _name, _dropped, _test in (("reached", False, "reached > 1"), ("dropped", True, "reached = 2")):
    @query(f"INS09_funnel_actors_{_name}", f"WITH {BEST} SELECT actor, reached FROM best WHERE {_test}")
    def _(m, dropped=_dropped):
        return N.funnel_actors(N.outcomes(m.stream(), Q), Q, 2 if dropped else 1, dropped, limit=None).select("actor", "reached")


_SAVED = [SavedStep("Pricing", "url", "/p1%"), SavedStep("Click", "event", "click"), SavedStep("Buy", "event", "purchase")]
_SRC = f"""{EV}, r AS (SELECT * FROM ev WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-25'),
  src AS (SELECT visitor_id, created_at, CASE WHEN event = '$pageview' AND path LIKE '/p1%' THEN 0 WHEN event = 'click' THEN 1
    WHEN event = 'purchase' THEN 2 END AS step FROM r)"""
_ORDERED = f"""{_SRC}, a0 AS (SELECT visitor_id, min(created_at) AS t0, min(created_at) AS t FROM src WHERE step = 0 GROUP BY 1),
  a1 AS (SELECT p.visitor_id, t0, min(created_at) AS t FROM a0 p JOIN src s ON s.visitor_id = p.visitor_id AND step = 1 AND created_at >= t AND created_at <= t0 + INTERVAL 48 HOUR GROUP BY ALL),
  a2 AS (SELECT p.visitor_id, t0, min(created_at) AS t FROM a1 p JOIN src s ON s.visitor_id = p.visitor_id AND step = 2 AND created_at >= t AND created_at <= t0 + INTERVAL 48 HOUR GROUP BY ALL),
  n AS (SELECT 0 AS step, 'Pricing' AS label, count(*) AS visitors FROM a0 UNION ALL SELECT 1, 'Click', count(*) FROM a1 UNION ALL SELECT 2, 'Buy', count(*) FROM a2)"""
_DROP = """SELECT step, label, visitors, ROUND(CASE WHEN coalesce(lag(visitors) OVER (ORDER BY step), 0) > 0
    THEN (lag(visitors) OVER (ORDER BY step) - visitors) / lag(visitors) OVER (ORDER BY step) * 100 ELSE 0 END, 4) AS drop_off FROM n"""
_ANY = f"""{_SRC}, w AS (SELECT i, s.visitor_id, step FROM range(3) p(i) JOIN src s ON s.step <= i
    JOIN (SELECT i AS j, visitor_id AS v, min(created_at) AS t0 FROM range(3) p(i) JOIN src ON step <= i GROUP BY ALL) ON j = i AND v = s.visitor_id
    WHERE created_at <= t0 + INTERVAL 48 HOUR),
  d AS (SELECT i, visitor_id FROM w GROUP BY ALL HAVING count(DISTINCT step) = i + 1),
  n AS (SELECT i AS step, CASE i WHEN 0 THEN 'Pricing' WHEN 1 THEN 'Click' ELSE 'Buy' END AS label, count(*) AS visitors FROM d GROUP BY 1)"""


def _saved_rows(m):
    at = F.col("created_at")
    return m.ev.filter((at >= "2024-01-05") & (at <= "2024-01-25"))


for _name in ("INS10_saved_funnel_ordered", "JON05_funnel_chain"):
    @query(_name, f"WITH {_ORDERED} {_DROP}")
    def _(m):
        return N.saved_funnel(_saved_rows(m), _SAVED, 48)


@query("INS10_saved_funnel_unordered", f"WITH {_ANY} {_DROP}")
def _(m):
    return N.saved_funnel(_saved_rows(m), _SAVED, 48, ordered=False)


@query("AGG38_prefix_funnel", f"""WITH {EV}, pv AS (SELECT * FROM ev WHERE event = '$pageview')
  SELECT 0 AS step, '/p' AS path, count(DISTINCT visitor_id) AS visitors FROM pv WHERE starts_with(path, '/p')
  UNION ALL SELECT 1, '/p1', count(DISTINCT visitor_id) FROM pv WHERE starts_with(path, '/p1')
  UNION ALL SELECT 2, '/q', count(DISTINCT visitor_id) FROM pv WHERE starts_with(path, '/q')""")
def _(m):
    return N.prefix_funnel(m.flat_pageviews, ["/p", "/p1", "/q"])
