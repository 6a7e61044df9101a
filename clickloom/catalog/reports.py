"""Traffic reports (AGG10-AGG37), rollups (AGG20-AGG26) and marketing (MKT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.catalog.oracle import EV, EVS, SESS, r4, ts
from clickloom.catalog.registry import query
from clickloom.functions import channels as C
from clickloom.operators import marketing as M, reports as R, rollups as U
from clickloom.operators.reports import Span
from clickloom.session import new_folder
from clickloom.sources.tables import month_of

SPAN = Span("2024-01-10 00:00:00", "2024-01-30 18:00:00", "2024-01-30")
PREV = Span("2023-12-20 06:00:00", "2024-01-09 23:59:59", "2024-01-30")
IN = "created_at >= TIMESTAMP '2024-01-10' AND created_at <= TIMESTAMP '2024-01-30 18:00:00'"
INS = IN.replace("created_at", "first_at")
DAY = "CAST(created_at AS DATE)"
FAMILY = ["%/p1%", "/p_"[:2] + "7"]
FAM_SQL = "(path LIKE '%/p1%' OR path LIKE '/p7')"

# Rollups, one row per project and day over all history.

_DAILY = f"""{SESS}, daily AS (SELECT project_id, {DAY} AS date, count(*) AS pageviews, count(DISTINCT visitor_id) AS visitors,
    count(DISTINCT session_id) AS sessions FROM pv GROUP BY 1, 2),
  visits AS (SELECT project_id, CAST(first_at AS DATE) AS date, count(*) FILTER (WHERE is_bounce) AS bounces,
    CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms FROM sessions GROUP BY 1, 2)"""


@query("AGG20_daily_stats", f"WITH {_DAILY} SELECT project_id, strftime(date, '%Y-%m-%d') AS date, pageviews, visitors, sessions, coalesce(bounces, 0) AS bounces, coalesce(total_duration_ms, 0) AS total_duration_ms FROM daily LEFT JOIN visits USING (project_id, date)")
def _(m):
    return U.daily_stats(m.pageviews, m.sessions)


@query("AGG21_daily_pages", f"WITH {EV} SELECT project_id, strftime({DAY}, '%Y-%m-%d') AS date, path, count(*) AS views, count(DISTINCT visitor_id) AS unique_views, CAST(round_even(avg(duration_ms), 0) AS BIGINT) AS avg_duration_ms FROM ev WHERE event = '$pageview' GROUP BY ALL")
def _(m):
    return U.daily_pages(m.flat_pageviews)


@query("AGG22_daily_referrers", f"WITH {EVS} SELECT project_id, strftime({DAY}, '%Y-%m-%d') AS date, coalesce(referrer_domain, 'Direct') AS referrer_domain, count(DISTINCT session_id) AS visits FROM pv GROUP BY ALL")
def _(m):
    return U.daily_referrers(m.pageviews)


@query("AGG23_daily_events", f"WITH {EV} SELECT project_id, strftime({DAY}, '%Y-%m-%d') AS date, event AS event_name, count(*) AS count FROM ev WHERE event <> '$pageview' GROUP BY ALL")
def _(m):
    return U.daily_events(m.flat_events)


@query("AGG24_daily_geo", f"WITH {SESS} SELECT project_id, strftime(first_at, '%Y-%m-%d') AS date, coalesce(country, 'XX') AS country, count(DISTINCT visitor_id) AS visitors FROM sessions GROUP BY ALL")
def _(m):
    return U.daily_geo(m.sessions)


@query("AGG25_daily_devices", f"WITH {SESS} SELECT project_id, strftime(first_at, '%Y-%m-%d') AS date, browser, os, device_type AS device, count(DISTINCT visitor_id) AS visitors FROM sessions GROUP BY ALL")
def _(m):
    return U.daily_devices(m.sessions)


_CAMPAIGNS = f"""{SESS}, tagged AS (SELECT * FROM pv WHERE utm_source IS NOT NULL),
  groups AS (SELECT project_id, {DAY} AS date, utm_source, utm_medium, utm_campaign, count(DISTINCT visitor_id) AS visitors,
    count(DISTINCT session_id) AS sessions, count(*) AS pageviews FROM tagged GROUP BY ALL),
  hit AS (SELECT DISTINCT t.project_id, {DAY} AS date, utm_source, utm_medium, utm_campaign, session_id FROM tagged t
    JOIN sessions s USING (session_id) WHERE is_bounce AND CAST(first_at AS DATE) = {DAY}),
  campaigns AS (SELECT g.*, (SELECT count(DISTINCT session_id) FROM hit h WHERE h.project_id = g.project_id AND h.date = g.date AND h.utm_source = g.utm_source) AS bounces,
    (SELECT count(*) FROM hit h WHERE h.project_id = g.project_id AND h.date = g.date AND h.utm_source = g.utm_source AND h.utm_medium = g.utm_medium AND h.utm_campaign = g.utm_campaign) AS bounces_exact FROM groups g)"""


@query("AGG26_daily_campaigns", f"WITH {_CAMPAIGNS} SELECT * REPLACE (strftime(date, '%Y-%m-%d') AS date) FROM campaigns")
def _(m):
    return U.daily_campaigns(m.pageviews, m.sessions)


# Hybrid reports: rollups of past days and raw rows of today.

_STATS = f"""{SESS}, d AS (SELECT {DAY} AS date, project_id, count(*) AS pageviews, count(DISTINCT visitor_id) AS visitors, count(DISTINCT session_id) AS sessions FROM pv GROUP BY 1, 2),
  v AS (SELECT CAST(first_at AS DATE) AS date, project_id, count(*) FILTER (WHERE is_bounce) AS bounces, sum(duration_ms) AS dur FROM sessions GROUP BY 1, 2),
  past AS (SELECT sum(pageviews) AS pageviews, sum(sessions) AS sessions, sum(coalesce(bounces, 0)) AS bounces, sum(coalesce(dur, 0)) AS dur FROM d LEFT JOIN v USING (date, project_id)
    WHERE date >= DATE '2024-01-10' AND date < DATE '2024-01-30'),
  today AS (SELECT count(*) AS pageviews, count(DISTINCT session_id) AS sessions FROM pv WHERE {IN} AND created_at >= TIMESTAMP '2024-01-30'),
  tv AS (SELECT count(*) FILTER (WHERE is_bounce) AS bounces, coalesce(sum(duration_ms), 0) AS dur FROM sessions WHERE {INS} AND first_at >= TIMESTAMP '2024-01-30'),
  stats AS (SELECT CAST(p.pageviews + t.pageviews AS BIGINT) AS pageviews, CAST(p.sessions + t.sessions AS BIGINT) AS sessions,
    CAST(p.bounces + tv.bounces AS BIGINT) AS bounces, CAST(p.dur + tv.dur AS BIGINT) AS total_duration_ms,
    (SELECT count(DISTINCT visitor_id) FROM pv WHERE {IN}) AS visitors FROM past p, today t, tv),
  pstats AS (SELECT CAST(sum(pageviews) AS BIGINT) AS pageviews, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(coalesce(bounces, 0)) AS BIGINT) AS bounces, CAST(sum(coalesce(dur, 0)) AS BIGINT) AS total_duration_ms,
    (SELECT count(DISTINCT visitor_id) FROM pv WHERE created_at >= TIMESTAMP '2023-12-20 06:00:00' AND created_at <= TIMESTAMP '2024-01-09 23:59:59') AS visitors
    FROM d LEFT JOIN v USING (date, project_id) WHERE date >= DATE '2023-12-20' AND date <= DATE '2024-01-09')"""


@query("AGG10_period_stats", f"WITH {_STATS} SELECT * FROM stats")
def _(m):
    return R.period_stats(m.pageviews, m.sessions, U.daily_stats(m.pageviews, m.sessions), SPAN)


def _stored(m):
    """Facts in month folders and rollups of the days before today in date folders, written once and read again."""
    folder = new_folder(m.spark, "warehouse")
    m.pageviews.withColumn("month", month_of()).write.partitionBy("month").parquet(f"{folder}/pageviews")
    m.sessions.withColumn("month", month_of("first_at")).write.partitionBy("month").parquet(f"{folder}/sessions")
    past = F.col("date") < SPAN.today
    U.write_days(U.daily_stats(m.pageviews, m.sessions).filter(past), f"{folder}/daily_stats")
    U.write_days(U.daily_sketches(m.pageviews), f"{folder}/daily_sketches")
    return [m.spark.read.parquet(f"{folder}/{t}") for t in ("pageviews", "sessions", "daily_stats", "daily_sketches")]


@query("AGG10_stored_rollups", f"WITH {_STATS} SELECT * FROM stats")
def _(m):
    pageviews, sessions, daily, _ = _stored(m)
    return R.period_stats(pageviews, sessions, daily, SPAN)


@query("TOP06_floor_of_month_folders", f"WITH {EV} SELECT {ts('min(created_at)')} AS floor FROM ev WHERE event = '$pageview'")
def _(m):
    return R.raw_floor(_stored(m)[0])


@query("AGG02_sketched_visitors", f"WITH {EV} SELECT project_id, count(DISTINCT visitor_id) AS exact, true AS within_bounds FROM ev WHERE event = '$pageview' AND {DAY} >= DATE '2024-01-10' AND {DAY} <= DATE '2024-01-30' GROUP BY 1")
def _(m):
    """Distinct visitors of 21 days from stored daily sketches: the exact number lies within the stated bounds."""
    found = R.sketched_visitors(_stored(m)[3], SPAN, "project_id")
    days = m.flat_pageviews.filter(F.to_date("created_at").between("2024-01-10", "2024-01-30"))
    exact = days.groupBy("project_id").agg(F.count_distinct("visitor_id").alias("exact"))
    return found.join(exact, "project_id").select("project_id", "exact", F.col("exact").between(F.col("low"), F.col("high")).alias("within_bounds"))


@query("AGG11_unique_visitors_floor", f"""WITH {EVS}, f AS (SELECT * FROM pv WHERE created_at >= TIMESTAMP '2024-01-15 03:00:00')
  SELECT CAST((SELECT count(DISTINCT visitor_id) FROM f WHERE {IN}) + (SELECT sum(n) FROM (SELECT count(DISTINCT visitor_id) AS n FROM pv
    WHERE {DAY} >= DATE '2024-01-10' AND {DAY} < (SELECT CAST(min(created_at) AS DATE) FROM f) GROUP BY {DAY}, project_id)) AS BIGINT) AS visitors""")
def _(m):
    kept = m.pageviews.filter(F.col("created_at") >= "2024-01-15 03:00:00")
    return R.unique_visitors(kept, U.daily_stats(m.pageviews, m.sessions), SPAN)


_PAGES = f"""{EVS}, d AS (SELECT path, count(*) AS views, count(DISTINCT visitor_id) AS uv, round_even(avg(duration_ms), 0) AS dur FROM pv
    WHERE {DAY} >= DATE '2024-01-10' AND {DAY} < DATE '2024-01-30' GROUP BY path, {DAY}, project_id
  UNION ALL SELECT path, count(*), count(DISTINCT visitor_id), round_even(avg(duration_ms), 0) FROM pv WHERE {IN} AND created_at >= TIMESTAMP '2024-01-30' GROUP BY path),
  pages AS (SELECT path, CAST(sum(views) AS BIGINT) AS views, CAST(sum(uv) AS BIGINT) AS unique_views, CAST(round_even(avg(dur), 0) AS BIGINT) AS avg_duration FROM d GROUP BY 1)"""


@query("AGG12_top_pages", f"WITH {_PAGES} SELECT * FROM pages ORDER BY views DESC, path LIMIT 5 OFFSET 1")
def _(m):
    return R.top_pages(m.pageviews, U.daily_pages(m.flat_pageviews), SPAN, 5, 1)


@query("AGG12_exact_page_uniques", f"WITH {EV} SELECT path, count(DISTINCT visitor_id) AS unique_visitors FROM ev WHERE event = '$pageview' AND {IN} GROUP BY 1")
def _(m):
    return R.exact_page_uniques(m.flat_pageviews, SPAN)


_REFS = f"""{EVS}, d AS (SELECT coalesce(referrer_domain, 'Direct') AS referrer_domain, count(DISTINCT session_id) AS n FROM pv
    WHERE {DAY} >= DATE '2024-01-10' AND {DAY} < DATE '2024-01-30' GROUP BY 1, {DAY}, project_id
  UNION ALL SELECT coalesce(referrer_domain, 'Direct'), count(DISTINCT session_id) FROM pv WHERE {IN} AND created_at >= TIMESTAMP '2024-01-30' GROUP BY 1),
  refs AS (SELECT referrer_domain, CAST(sum(n) AS BIGINT) AS visits FROM d GROUP BY 1)"""


@query("AGG13_top_referrers", f"WITH {_REFS} SELECT * FROM refs ORDER BY visits DESC, referrer_domain LIMIT 4")
def _(m):
    return R.top_referrers(m.pageviews, U.daily_referrers(m.pageviews), SPAN, 4)


@query("AGG14_top_events", f"WITH {EV} SELECT event AS event_name, count(*) AS count FROM ev WHERE event <> '$pageview' AND {IN} GROUP BY 1")
def _(m):
    return R.top_events(m.flat_events, U.daily_events(m.flat_events), SPAN)


@query("AGG15_devices", f"WITH {SESS} SELECT browser, os, device_type AS device, count(DISTINCT visitor_id) AS visitors FROM sessions WHERE {INS} GROUP BY ALL")
def _(m):
    return R.devices(m.sessions, SPAN)


@query("AGG16_geo", f"WITH {SESS} SELECT coalesce(country, 'XX') AS country, count(DISTINCT visitor_id) AS visitors FROM sessions WHERE {INS} GROUP BY ALL")
def _(m):
    return R.geo(m.sessions, SPAN)


@query("AGG17_events_count", f"WITH {EV} SELECT count(*) AS events FROM ev WHERE event <> '$pageview' AND {IN}")
def _(m):
    return R.events_count(m.flat_events, U.daily_events(m.flat_events), SPAN)


@query("AGG18_timeseries", f"""WITH {EVS}, d AS (SELECT {DAY} AS day, count(*) AS pageviews, count(DISTINCT visitor_id) AS visitors, count(DISTINCT session_id) AS sessions
    FROM pv WHERE {IN} GROUP BY 1, project_id)
  SELECT strftime(day, '%Y-%m-%d') AS date, CAST(sum(pageviews) AS BIGINT) AS pageviews, CAST(sum(visitors) AS BIGINT) AS visitors, CAST(sum(sessions) AS BIGINT) AS sessions FROM d GROUP BY 1""")
def _(m):
    return R.timeseries(m.pageviews, U.daily_stats(m.pageviews, m.sessions), SPAN)


@query("AGG19_stats_with_previous", f"""WITH {_STATS}, e AS (SELECT count(*) FILTER (WHERE {IN}) AS now, count(*) FILTER (WHERE created_at < TIMESTAMP '2024-01-10') AS prev FROM ce),
  a AS (SELECT 'current' AS period, pageviews, visitors, sessions, bounces, total_duration_ms, now AS events FROM stats, e
    UNION ALL SELECT 'previous', pageviews, visitors, sessions, bounces, total_duration_ms, prev FROM pstats, e)
  SELECT period, pageviews, visitors, sessions, events, {r4('CASE WHEN sessions > 0 THEN bounces / sessions * 100 ELSE 0 END')} AS bounce_rate,
    {r4('CASE WHEN sessions > 0 THEN total_duration_ms / sessions / 1000 ELSE 0 END')} AS avg_duration FROM a""")
def _(m):
    daily = U.daily_stats(m.pageviews, m.sessions)
    return R.stats_with_previous(m.pageviews, m.sessions, m.events, daily, U.daily_events(m.flat_events), {"current": SPAN, "previous": PREV})


_VIS = """count(*) AS session_count, CAST(sum(pageview_count) AS BIGINT) AS pageviews, CAST(sum(event_count) AS BIGINT) AS events,
  strftime(max(last_at), '%Y-%m-%dT%H:%M:%S') AS last_seen, strftime(min(first_at), '%Y-%m-%dT%H:%M:%S') AS first_seen,
  arg_max(country, (last_at, session_id)) AS country, arg_max(browser, (last_at, session_id)) AS browser, arg_max(device_type, (last_at, session_id)) AS device_type"""


@query("AGG27_visitors_list", f"WITH {SESS} SELECT visitor_id, {_VIS} FROM sessions WHERE {INS} AND starts_with(visitor_id, '1') GROUP BY 1")
def _(m):
    return R.visitors_list(m.sessions, SPAN, "1", limit=None)


@query("WIN10_latest_per_visitor", f"WITH {SESS} SELECT visitor_id, {_VIS} FROM sessions WHERE {INS} GROUP BY 1 ORDER BY max(last_at) DESC, visitor_id LIMIT 20")
def _(m):
    return R.visitors_list(m.sessions, SPAN, limit=20)


@query("AGG28_visitor_summary", f"""WITH {SESS}, s AS (SELECT visitor_id, {_VIS}, CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms, arg_max(os, (last_at, session_id)) AS os
    FROM sessions WHERE {INS} GROUP BY 1), f AS (SELECT visitor_id, count(*) AS n FROM pv WHERE {IN} AND {FAM_SQL} GROUP BY 1)
  SELECT s.*, coalesce(n, 0) AS family_views FROM s LEFT JOIN f USING (visitor_id)""")
def _(m):
    return R.visitor_summary(m.sessions, m.pageviews, SPAN, FAMILY)


_SROW = f"session_id, {ts('first_at')} AS first_at, {ts('last_at')} AS last_at, entry_page, exit_page, pageview_count, event_count, duration_ms, is_bounce, browser, country"


@query("AGG29_visitor_sessions", f"WITH {SESS} SELECT {_SROW} FROM sessions WHERE {INS} AND visitor_id = '7' ORDER BY first_at DESC LIMIT 100")
def _(m):
    return R.visitor_sessions(m.sessions, "7", SPAN).select(
        "session_id", "first_at", "last_at", "entry_page", "exit_page", "pageview_count", "event_count", "duration_ms", "is_bounce", "browser", "country")


@query("AGG30_session_detail", f"WITH {EVS} SELECT event_id, {ts('created_at')} AS created_at, CASE WHEN event = '$pageview' THEN 'pageview' ELSE 'event' END AS kind, path, CASE WHEN event <> '$pageview' THEN event END AS event_name FROM evs WHERE session_id = '7-2'")
def _(m):
    return R.session_timeline(m.pageviews, m.events, "7-2")


@query("AGG31_daily_activity", f"WITH {EV} SELECT visitor_id, strftime({DAY}, '%Y-%m-%d') AS date, count(*) FILTER (WHERE event = '$pageview') AS pageviews, count(*) FILTER (WHERE event <> '$pageview') AS events FROM ev WHERE {IN} GROUP BY ALL")
def _(m):
    return R.daily_activity(m.flat_pageviews, m.flat_events, SPAN)


@query("AGG32_visitor_events", f"WITH {EV} SELECT event AS event_name, count(*) AS count FROM ev WHERE {IN} AND visitor_id = '7' AND event <> '$pageview' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(m):
    return R.visitor_events(m.flat_events, "7", SPAN)


@query("AGG33_family_stats", f"""WITH {SESS}, d AS (SELECT count(*) AS v, count(DISTINCT visitor_id) AS u, round_even(avg(duration_ms), 0) AS dur FROM pv
    WHERE {DAY} >= DATE '2024-01-10' AND {DAY} < DATE '2024-01-30' AND {FAM_SQL} GROUP BY path, {DAY}, project_id),
  a AS (SELECT sum(v) AS v, sum(u) AS u, avg(dur) AS dur FROM d),
  b AS (SELECT count(*) AS v, count(DISTINCT visitor_id) AS u, coalesce(avg(duration_ms), 0) AS dur FROM pv WHERE {IN} AND created_at >= TIMESTAMP '2024-01-30' AND {FAM_SQL}),
  c AS (SELECT count(*) FILTER (WHERE is_bounce) AS x, count(*) AS n FROM sessions WHERE {INS} AND {FAM_SQL.replace('path', 'entry_page')})
  SELECT CAST(a.v + b.v AS BIGINT) AS views, CAST(a.u + b.u AS BIGINT) AS visitors, {r4('(a.dur * a.v + b.dur * b.v) / (a.v + b.v)')} AS avg_duration_ms, {r4('x / n * 100')} AS bounce_rate FROM a, b, c""")
def _(m):
    return R.family_stats(m.pageviews, m.sessions, U.daily_pages(m.flat_pageviews), SPAN, FAMILY)


@query("FLT31_path_family", f"WITH {EV} SELECT path, count(*) AS n FROM ev WHERE event = '$pageview' AND {FAM_SQL} GROUP BY 1")
def _(m):
    return m.flat_pageviews.filter(R.in_family(FAMILY)).groupBy("path").agg(F.count("*").alias("n"))


@query("AGG34_family_timeseries", f"""WITH {EV}, d AS (SELECT {DAY} AS day, path, project_id, count(*) AS v, count(DISTINCT visitor_id) AS u FROM ev WHERE event = '$pageview'
    AND {DAY} >= DATE '2024-01-10' AND {DAY} < DATE '2024-01-30' AND {FAM_SQL} GROUP BY ALL)
  SELECT strftime(day, '%Y-%m-%d') AS date, CAST(sum(v) AS BIGINT) AS views, CAST(sum(u) AS BIGINT) AS unique_views FROM d GROUP BY 1
  UNION ALL SELECT '2024-01-30', count(*), count(DISTINCT visitor_id) FROM ev WHERE event = '$pageview' AND {IN} AND created_at >= TIMESTAMP '2024-01-30' AND {FAM_SQL}""")
def _(m):
    return R.family_timeseries(m.flat_pageviews, U.daily_pages(m.flat_pageviews), SPAN, FAMILY)


@query("AGG35_visit_frequency", f"""WITH {EV}, n AS (SELECT visitor_id, least(count(*), 5) AS n FROM ev WHERE event = '$pageview' AND {IN} AND {FAM_SQL} GROUP BY 1),
  c AS (SELECT n, count(*) AS c FROM n GROUP BY 1) SELECT CASE i WHEN 5 THEN '5+' ELSE CAST(i AS VARCHAR) END AS visits, coalesce(c, 0) AS visitor_count FROM range(1, 6) t(i) LEFT JOIN c ON n = i""")
def _(m):
    return R.family_frequency(m.flat_pageviews, SPAN, FAMILY)


@query("AGG36_family_referrers", f"WITH {EVS} SELECT coalesce(referrer_domain, 'Direct') AS referrer_domain, count(DISTINCT session_id) AS visits FROM pv WHERE {IN} AND {FAM_SQL} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def _(m):
    return R.family_referrers(m.pageviews, SPAN, FAMILY, 3)


@query("AGG37_hour_heatmap", f"WITH {EV} SELECT dayofweek(created_at) AS day_of_week, hour(created_at) AS hour, count(*) AS count FROM ev WHERE event = '$pageview' AND {IN} AND {FAM_SQL} GROUP BY ALL")
def _(m):
    return R.hour_heatmap(m.flat_pageviews, SPAN, FAMILY)


@query("TOP05_recent_activity", f"WITH {EV} SELECT event_id, CASE WHEN event = '$pageview' THEN 'pageview' ELSE 'event' END AS activity_type, visitor_id, path AS detail, CASE WHEN event <> '$pageview' THEN event END AS event_name, {ts('created_at')} AS created_at FROM ev WHERE created_at >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 HOUR ORDER BY ev.created_at DESC, event_id DESC LIMIT 15")
def _(m):
    return R.recent_activity(m.flat_pageviews, m.flat_events, "2024-01-30 12:00:00", 15)


@query("TOP06_raw_floor", f"WITH {EV} SELECT {ts('min(created_at)')} AS floor FROM ev WHERE event = '$pageview'")
def _(m):
    return R.raw_floor(m.flat_pageviews)


@query("STR02_realtime_exact", f"WITH {EV} SELECT count(DISTINCT visitor_id) AS visitors FROM ev WHERE event = '$pageview' AND created_at > TIMESTAMP '2024-01-15 10:00:00' AND created_at <= TIMESTAMP '2024-01-15 16:00:00'")
def _(m):
    return R.realtime_visitors(m.flat_pageviews, "2024-01-15 16:00:00", 360)


@query("AGG74_overview", f"""WITH {_STATS}, top AS (SELECT max(views) AS t, sum(views) AS a FROM (SELECT path, count(*) AS views FROM pv WHERE {IN} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)),
  x AS (SELECT s.pageviews, s.sessions, p.pageviews AS before, (s.pageviews - p.pageviews) / p.pageviews * 100 AS change, s.bounces / s.sessions * 100 AS bounce, t / a * 100 AS share FROM stats s, pstats p, top)
  SELECT 'pageviews' AS metric, CASE WHEN change > 0 THEN 'Traffic increased' ELSE 'Traffic declined' END AS title, CASE WHEN change > 0 THEN 'info' ELSE 'warning' END AS severity,
    printf('Pageviews changed by %.1f%% versus the previous comparable period.', change) AS summary FROM x WHERE abs(change) >= 20
  UNION ALL SELECT 'bounce_rate', 'Bounce rate is elevated', 'warning', printf('Bounce rate is %.1f%% across %d sessions.', bounce, sessions) FROM x WHERE bounce >= 60 AND sessions >= 20
  UNION ALL SELECT 'pages', 'Traffic is concentrated', 'info', printf('The top page accounts for %.1f%% of views among the returned top pages.', share) FROM x WHERE share >= 50""")
def _(m):
    daily = U.daily_stats(m.pageviews, m.sessions)
    current, previous = (R.period_stats(m.pageviews, m.sessions, daily, s) for s in (SPAN, PREV))
    return R.overview(current, previous, R.top_pages(m.pageviews, U.daily_pages(m.flat_pageviews), SPAN, 1))


@query("SCL33_merge_sources", f"WITH {EV} SELECT path, count(*) + count(*) FILTER (WHERE k > 50) AS views FROM ev WHERE event = '$pageview' GROUP BY 1")
def _(m):
    counts = m.flat_pageviews.groupBy("path").agg(F.count("*").alias("views"))
    other = m.flat_pageviews.filter("k > 50").groupBy("path").agg(F.count("*").alias("views"))
    return R.merge_sources(counts, other, "path", "views")


_ACT = f"""WITH {EV}, c AS (SELECT DISTINCT visitor_id FROM ev WHERE {IN}),
  e AS (SELECT visitor_id, count(DISTINCT event) AS n FROM ev WHERE {IN} AND event IN ('purchase', 'signup') GROUP BY 1),
  p AS (SELECT visitor_id, count(DISTINCT path) AS n FROM ev WHERE {IN} AND event = '$pageview' AND path IN ('/p1', '/p2', '/p3') GROUP BY 1)
  SELECT count(*) AS cohort_visitors, count(*) FILTER (WHERE coalesce(e.n, 0) >= 2 AND coalesce(p.n, 0) >= 3) AS activated_visitors,
    {r4('count(*) FILTER (WHERE coalesce(e.n, 0) >= 2 AND coalesce(p.n, 0) >= 3) / count(*) * 100')} AS activation_rate FROM c LEFT JOIN e USING (visitor_id) LEFT JOIN p USING (visitor_id)"""
for _name in ("AGG60_activation", "JON09_activation_joins"):
    @query(_name, _ACT)
    def _(m):
        return R.activation(m.ev, m.flat_events, m.flat_pageviews, SPAN, ["purchase", "signup"], ["/p1", "/p2", "/p3"])


_LIFE = f"""WITH {EV}, a AS (SELECT visitor_id, bool_or(created_at >= TIMESTAMP '2024-01-03') AS now, bool_or(created_at >= TIMESTAMP '2024-01-02 12:00:00' AND created_at < TIMESTAMP '2024-01-03') AS prev,
    min(created_at) AS first FROM ev WHERE created_at <= TIMESTAMP '2024-01-03 12:00:00' GROUP BY 1)
  SELECT count(*) FILTER (WHERE now) AS active_visitors, count(*) FILTER (WHERE now AND first >= TIMESTAMP '2024-01-03') AS new_visitors, count(*) FILTER (WHERE now AND prev) AS returning_visitors,
    count(*) FILTER (WHERE now AND NOT prev AND first < TIMESTAMP '2024-01-03') AS resurrected_visitors, count(*) FILTER (WHERE prev AND NOT now) AS dormant_visitors FROM a"""
for _name in ("AGG59_lifecycle_report", "JON10_lifecycle_joins"):
    @query(_name, _LIFE)
    def _(m):
        return R.lifecycle_report(m.ev, "2024-01-03", "2024-01-03 12:00:00")


for _metric, _where, _count in (("events", "event = 'purchase'", "count(*)"), ("visitors", "true", "count(DISTINCT visitor_id)")):
    @query(f"AGG61_impact_{_metric}", f"""WITH {EV}, x AS (SELECT {_count} FILTER (WHERE created_at < TIMESTAMP '2024-01-16') AS b, {_count} FILTER (WHERE created_at >= TIMESTAMP '2024-01-16') AS a FROM ev
        WHERE {_where} AND created_at >= TIMESTAMP '2024-01-09' AND created_at < TIMESTAMP '2024-01-23')
      SELECT b AS before_value, a AS after_value, a - b AS absolute_change, {r4('CASE WHEN b > 0 THEN (a - b) / b * 100 WHEN a > 0 THEN 100 ELSE 0 END')} AS percent_change,
        CASE WHEN a > b THEN 'up' WHEN a < b THEN 'down' ELSE 'flat' END AS direction FROM x""")
    def _(m, metric=_metric):
        rows = m.ev.filter("event = 'purchase'") if metric == "events" else m.ev
        return R.impact(rows, "2024-01-16", 7, distinct="visitor_id" if metric == "visitors" else None)


@query("AGG58_activity_ratios", f"""WITH {EV}, n AS (SELECT u, date_trunc(u, created_at) AS p, count(DISTINCT visitor_id) AS n FROM ev CROSS JOIN (VALUES ('day'), ('week'), ('month')) t(u) WHERE {IN} GROUP BY 1, 2),
  a AS (SELECT avg(n) FILTER (WHERE u = 'day') AS d, avg(n) FILTER (WHERE u = 'week') AS w, avg(n) FILTER (WHERE u = 'month') AS m FROM n)
  SELECT {r4('d')} AS avg_dau, {r4('w')} AS avg_wau, {r4('m')} AS avg_mau, {r4('d / w * 100')} AS dau_wau, {r4('w / m * 100')} AS wau_mau, {r4('d / m * 100')} AS dau_mau FROM a""")
def _(m):
    from clickloom.operators.engagement import activity_report

    return activity_report(m.ev, SPAN.start, SPAN.end)


@query("AGG58_daily_active", f"WITH {EV} SELECT strftime({DAY}, '%Y-%m-%d') AS day, count(DISTINCT visitor_id) AS active FROM ev WHERE {IN} GROUP BY 1")
def _(m):
    from clickloom.operators.engagement import daily_active

    return daily_active(m.ev, SPAN.start, SPAN.end)


# Marketing.

_CHANNEL = """CASE WHEN trim(c) = '' OR s = 'direct' OR r = 'direct' THEN 'Direct' WHEN regexp_matches(c, 'chatgpt|openai|perplexity|claude|anthropic|gemini|bard\\.google|copilot|bing\\.com/chat') THEN 'AI Referrals'
  WHEN med = 'email' OR contains(s, 'mail') THEN 'Email' WHEN contains(med, 'affiliate') THEN 'Affiliate' WHEN contains(med, 'display') OR contains(med, 'banner') THEN 'Display'
  WHEN soc AND paid THEN 'Paid Social' WHEN soc THEN 'Organic Social' WHEN sea AND paid THEN 'Paid Search' WHEN sea THEN 'Organic Search' WHEN paid THEN 'Paid Other' WHEN r <> '' THEN 'Referral' ELSE 'Other' END"""


def channel_sql(rows: str, keep: str) -> str:
    """Columns of ``rows`` plus the channel of source, medium and referrer domain."""
    return f"""(SELECT {keep}, {_CHANNEL} AS channel FROM (SELECT *, regexp_matches(c, 'facebook|instagram|linkedin|twitter|x\\.com|t\\.co|reddit|youtube|tiktok|threads') AS soc,
      regexp_matches(c, 'google|bing|yahoo|duckduckgo|baidu|yandex') AS sea, med IN ('cpc', 'ppc', 'paid', 'paid_search', 'paid-social', 'paid_social', 'ads') AS paid
    FROM (SELECT *, s || ' ' || med || ' ' || r AS c FROM (SELECT *, lower(coalesce(utm_source, '')) AS s, lower(coalesce(utm_medium, '')) AS med, lower(coalesce(referrer_domain, '')) AS r FROM {rows}))))"""


@query("SCL06_channel", f"WITH {EV} SELECT * FROM {channel_sql('ev', 'event_id')}")
def _(m):
    return m.ev.select("event_id", *m.touch_columns()).select(
        "event_id", C.channel(F.col("utm_source"), F.col("utm_medium"), F.col("referrer_domain")).alias("channel"))


@query("SCL05_referrer_host", f"WITH {EV} SELECT event_id, referrer_domain AS host FROM ev")
def _(m):
    return m.ev.select("event_id", *m.touch_columns()).select("event_id", C.referrer_host(F.upper("referrer")).alias("host"))


@query("SCL05_page_hosts", "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages")
def _(m):
    return m.table("pages").select("page_id", C.referrer_host(F.col("url")).alias("host"))


@query("SCL07_ai_provider", f"WITH {EV} SELECT event_id, CASE WHEN referrer_domain = 'chatgpt.com' THEN 'OpenAI' END AS provider FROM ev")
def _(m):
    return m.ev.select("event_id", *m.touch_columns()).select("event_id", C.ai_provider(F.col("referrer_domain")).alias("provider"))


@query("SCL08_paid_search_social", f"WITH {EV} SELECT event_id, utm_medium = 'cpc' AS paid, regexp_matches(coalesce(referrer_domain, ''), 'google') AS search, regexp_matches(referrer_domain, 't[.]co') OR utm_source = 'facebook' AS social, coalesce(referrer_domain, '') = 't.co' AS host_social FROM ev")
def _(m):
    d = F.coalesce("referrer_domain", F.lit(""))
    return m.ev.select("event_id", *m.touch_columns()).select(
        "event_id", C.is_paid(F.col("utm_medium")).alias("paid"), C.is_search(d).alias("search"),
        (C.is_social(F.col("referrer_domain")) | C.is_social(F.col("utm_source"))).alias("social"),
        C.is_social(F.concat(d, F.lit("")), exact_hosts=True).alias("host_social"))


def _campaign_sql(keys: str, where: str, final: str = "true") -> str:
    return f"""WITH {_CAMPAIGNS}, raw AS (SELECT *, coalesce(utm_source, '') AS a, coalesce(utm_medium, '') AS b, coalesce(utm_campaign, '') AS c FROM pv WHERE {where}),
      k AS (SELECT visitor_id, session_id, created_at, a AS utm_source, b AS utm_medium, c AS utm_campaign FROM raw),
      td AS (SELECT * FROM k WHERE {IN} AND created_at >= TIMESTAMP '2024-01-30'),
      bounced AS (SELECT session_id FROM sessions WHERE is_bounce AND {INS} AND first_at >= TIMESTAMP '2024-01-30'),
      today AS (SELECT {keys}, count(DISTINCT session_id) AS sessions, count(*) AS pageviews, count(DISTINCT session_id) FILTER (WHERE session_id IN (SELECT session_id FROM bounced)) AS bounces FROM td GROUP BY {keys}),
      allrows AS (SELECT {keys}, sessions, pageviews, bounces FROM campaigns WHERE date >= DATE '2024-01-10' AND date < DATE '2024-01-30' UNION ALL SELECT * FROM today),
      sums AS (SELECT {keys}, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(pageviews) AS BIGINT) AS pageviews, sum(bounces) AS bounces FROM allrows WHERE {final} GROUP BY {keys}),
      u AS (SELECT {keys}, count(DISTINCT visitor_id) AS visitors FROM k WHERE {IN} GROUP BY {keys})
      SELECT {keys}, coalesce(visitors, 0) AS visitors, sessions, pageviews, CAST(bounces AS BIGINT) AS bounces, {r4('CASE WHEN sessions > 0 THEN bounces / sessions * 100 ELSE 0 END')} AS bounce_rate FROM sums LEFT JOIN u USING ({keys})"""


for _name, _keys, _where, _final in (
    ("MKT01_campaigns", U.UTM, "utm_source IS NOT NULL OR utm_medium IS NOT NULL OR utm_campaign IS NOT NULL", "true"),
    ("SCL28_campaign_key", U.UTM, "utm_source IS NOT NULL OR utm_medium IS NOT NULL OR utm_campaign IS NOT NULL", "true"),
    ("MKT03_sources", ["utm_source"], "utm_source IS NOT NULL", "utm_source <> ''"),
    ("MKT04_mediums", ["utm_medium"], "utm_medium IS NOT NULL", "utm_medium <> ''"),
):
    @query(_name, _campaign_sql(", ".join(_keys), _where, _final))
    def _(m, keys=_keys):
        return M.campaign_stats(m.pageviews, m.sessions, U.daily_campaigns(m.pageviews, m.sessions), SPAN, keys)


@query("MKT02_campaign_timeseries", f"""WITH {EVS}, d AS (SELECT {DAY} AS day, utm_medium, utm_campaign, project_id, count(*) AS n, count(DISTINCT visitor_id) AS v, count(DISTINCT session_id) AS s
    FROM pv WHERE utm_source = 'google' AND {DAY} >= DATE '2024-01-10' AND {DAY} < DATE '2024-01-30' GROUP BY ALL)
  SELECT strftime(day, '%Y-%m-%d') AS date, CAST(sum(n) AS BIGINT) AS pageviews, CAST(sum(v) AS BIGINT) AS visitors, CAST(sum(s) AS BIGINT) AS sessions FROM d GROUP BY 1
  UNION ALL SELECT '2024-01-30', count(*), count(DISTINCT visitor_id), count(DISTINCT session_id) FROM pv WHERE utm_source = 'google' AND {IN} AND created_at >= TIMESTAMP '2024-01-30'""")
def _(m):
    return M.campaign_timeseries(m.pageviews, U.daily_campaigns(m.pageviews, m.sessions), SPAN, "google")


@query("MKT05_channel_groups", f"""WITH {EVS}, c AS (SELECT * FROM {channel_sql('pv', 'visitor_id, session_id, created_at, utm_source, utm_medium, referrer_domain')}),
  f AS (SELECT channel, count(DISTINCT visitor_id) AS v, count(DISTINCT session_id) AS s, count(*) AS n FROM c WHERE {IN} GROUP BY channel, utm_source, utm_medium, referrer_domain),
  a AS (SELECT channel, CAST(sum(v) AS BIGINT) AS visitors_summed, CAST(sum(s) AS BIGINT) AS sessions_summed, CAST(sum(n) AS BIGINT) AS pageviews FROM f GROUP BY 1),
  e AS (SELECT channel, count(DISTINCT visitor_id) AS visitors, count(DISTINCT session_id) AS sessions FROM c WHERE {IN} GROUP BY 1)
  SELECT a.*, visitors, sessions, {r4('pageviews / sum(pageviews) OVER () * 100')} AS percentage FROM a JOIN e USING (channel)""")
def _(m):
    return M.channel_groups(m.pageviews, SPAN)


_RENAMED = "SELECT channel, utm_source AS source, utm_campaign AS campaign"
_PAID = f"paid AS (SELECT event_id, session_id, created_at, CAST(revenue_amount AS DOUBLE) AS revenue FROM ce WHERE {IN} AND revenue_amount IS NOT NULL)"


def _touch_sql(order: str) -> str:
    return f"""{EVS}, {_PAID}, t AS (SELECT e.event_id, e.revenue, p.utm_source, p.utm_medium, p.utm_campaign, p.referrer_domain FROM paid e LEFT JOIN LATERAL (
      SELECT * FROM pv p WHERE p.session_id = e.session_id AND p.created_at <= e.created_at ORDER BY p.created_at {order}, p.event_id {order} LIMIT 1) p ON true)"""


_LINEAR = f"""{EVS}, {_PAID}, t0 AS (SELECT DISTINCT e.event_id, e.revenue, p.utm_source, p.utm_medium, p.utm_campaign, p.referrer_domain, p.event_id IS NOT NULL AS found
    FROM paid e LEFT JOIN pv p ON p.session_id = e.session_id AND p.created_at <= e.created_at),
  t AS (SELECT *, count(*) OVER (PARTITION BY event_id) AS n FROM t0)"""
for _model, _sql in (("first_touch", _touch_sql("ASC")), ("last_touch", _touch_sql("DESC")), ("linear", _LINEAR)):
    _w = "1.0 / n" if _model == "linear" else "1.0"
    _m = "revenue / n" if _model == "linear" else "revenue"

    @query(f"MKT06_attribution_{_model}", f"""WITH {_sql}, c AS (SELECT * FROM {channel_sql('t', f'utm_source, utm_campaign, CAST({_w} AS DOUBLE) AS w, {_m} AS money')})
      {_RENAMED}, {r4('sum(w)')} AS conversions, {r4('sum(money)')} AS revenue, '{_model}' AS model FROM c GROUP BY ALL""")
    def _(m, model=_model):
        return M.attribution(m.events, m.pageviews, SPAN, model)


for _name, _order, _model in (("JON06_first_touch", "ASC", "first_touch"), ("JON06_last_touch", "DESC", "last_touch")):
    @query(_name, f"WITH {_touch_sql(_order)} SELECT event_id, {r4('revenue')} AS revenue, utm_source, utm_campaign, referrer_domain FROM t")
    def _(m, model=_model):
        found = M.touch_per_event(m.events, m.pageviews, SPAN, model)
        return found.select("event_id", "revenue", "touch.utm_source", "touch.utm_campaign", "touch.referrer_domain")


for _name in ("JON07_linear_credit", "WIN03_count_over_event"):
    @query(_name, f"WITH {_LINEAR} SELECT utm_source, utm_medium, utm_campaign, referrer_domain, {r4('sum(1.0 / n)')} AS conversions, {r4('sum(revenue / n)')} AS revenue FROM t GROUP BY found, 1, 2, 3, 4")
    def _(m):
        return M.linear_credit(m.events, m.pageviews, SPAN).filter("conversions > 1e-9").select("touch.*", "conversions", "revenue")


@query("MKT07_ai_referrers", f"WITH {EVS} SELECT referrer_domain, 'OpenAI' AS provider, count(DISTINCT visitor_id) AS visitors, count(DISTINCT session_id) AS sessions, count(*) AS pageviews FROM pv WHERE {IN} AND referrer_domain = 'chatgpt.com' GROUP BY 1")
def _(m):
    return M.ai_referrers(m.pageviews, SPAN)


@query("AGG70_revenue_totals", f"WITH {EVS}, {_PAID} SELECT count(*) AS orders, {r4('sum(revenue)')} AS revenue, {r4('sum(revenue) / count(*)')} AS average_order_value FROM paid")
def _(m):
    return M.revenue_totals(m.flat_events, SPAN)


@query("AGG70_revenue_by_currency", f"WITH {EV} SELECT revenue_currency AS currency, count(*) AS orders, {r4('sum(revenue_amount)')} AS revenue FROM ev WHERE {IN} AND revenue_amount IS NOT NULL GROUP BY 1")
def _(m):
    return M.revenue_by_currency(m.flat_events, SPAN)


@query("AGG70_top_products", f"WITH {EV} SELECT CASE WHEN k % 7 = 0 THEN 'unknown' ELSE CAST(k % 40 AS VARCHAR) END AS product_id, 'purchase' AS product_name, count(*) AS orders, {r4('sum(revenue_amount)')} AS revenue FROM ev WHERE {IN} AND revenue_amount IS NOT NULL GROUP BY 1 ORDER BY sum(revenue_amount) DESC, 1 LIMIT 25")
def _(m):
    data = F.when(F.col("k") % 7 != 0, F.to_json(F.struct((F.col("k") % 40).cast("string").alias("product_id"))))
    return M.top_products(m.flat_events.withColumn("event_data", data), SPAN)


# Imported rows: one per supplier and part group of the line items.

_IMPORTS = """imports AS (SELECT DISTINCT 'imp' || (l_suppkey % 4) AS import_id, CASE l_suppkey % 4 WHEN 0 THEN 'google_analytics' WHEN 1 THEN 'google_ads' WHEN 2 THEN 'search_console' END AS provider FROM lineitem),
  irows AS (SELECT l_orderkey || '-' || l_linenumber AS row_id, 'imp' || (l_suppkey % 4) AS import_id, CAST(l_shipdate AS DATE) AS row_date, l_quantity AS clicks, l_extendedprice AS cost FROM lineitem)"""


def _imports(m):
    li = m.table("lineitem")
    group = F.concat(F.lit("imp"), (F.col("l_suppkey") % 4).cast("string"))
    rows = li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("row_id"),
        group.alias("import_id"), F.to_date("l_shipdate").alias("row_date"),
        F.to_json(F.struct(F.col("l_quantity").alias("clicks"), F.col("l_extendedprice").alias("cost"))).alias("metrics"),
    )
    names = F.element_at(F.array(F.lit("GA4 "), F.lit("google_ads"), F.lit("google_search_console"), F.lit("bing")), (F.col("l_suppkey") % 4 + 1).cast("int"))
    imports = li.select(group.alias("import_id"), M.provider_name(names).alias("provider")).distinct()
    return rows, imports


for _name in ("AGG69_import_summary", "JON16_import_rows_by_provider"):
    @query(_name, f"""WITH {_IMPORTS} SELECT count(*) AS rows, 0.0::DOUBLE AS impressions, {r4('sum(clicks)')} AS clicks, {r4('sum(cost)')} AS cost, 0.0::DOUBLE AS conversions, 0.0::DOUBLE AS revenue, 0.0::DOUBLE AS sessions, 0.0::DOUBLE AS users
      FROM irows JOIN imports USING (import_id) WHERE provider = 'google_ads' AND row_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""")
    def _(m):
        rows, imports = _imports(m)
        return M.import_summary(rows, imports, "1996-01-01", "1997-12-31", "google_ads")


@query("MKT08_import_rows", f"WITH {_IMPORTS} SELECT row_id, strftime(row_date, '%Y-%m-%d') AS row_date FROM irows WHERE import_id = 'imp2' ORDER BY irows.row_date DESC, row_id LIMIT 30 OFFSET 10")
def _(m):
    return M.import_rows(_imports(m)[0], "imp2", 30, 10).select("row_id", "row_date")


@query("SRC26_marketing_import", """SELECT CASE l_suppkey % 4 WHEN 0 THEN 'google_analytics' WHEN 1 THEN 'google_ads' WHEN 2 THEN 'search_console' END AS provider,
    CASE WHEN l_suppkey % 4 = 3 THEN 'provider' WHEN l_linenumber = 1 THEN 'dimensions' WHEN l_linenumber = 2 THEN 'metric_value' WHEN l_linenumber = 3 THEN 'raw_row' END AS rejected, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def _(m):
    li, line = m.table("lineitem"), F.col("l_linenumber")
    rows = li.select(
        F.element_at(F.array(F.lit(" GA4"), F.lit("Google_Ads"), F.lit("search_console"), F.lit("other")), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("provider"),
        F.when(line == 1, F.lit("[1]")).otherwise(F.to_json(F.struct(F.col("l_returnflag").alias("flag")))).alias("dimensions"),
        F.when(line == 2, F.lit('{"clicks": "many"}')).otherwise(F.to_json(F.struct(F.col("l_quantity").alias("clicks")))).alias("metrics"),
        F.when(line == 3, F.lit("7")).otherwise(F.lit("{}")).alias("raw_row"),
    )
    return M.checked_import(rows).groupBy("provider", "rejected").agg(F.count("*").alias("n"))
