"""Streaming jobs run over the event file to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.catalog.oracle import EV, SESS, r4, ts
from clickloom.catalog.operations import _BASE, _GOALS, _HIT, _VIOLATIONS, _payloads, _schemas
from clickloom.catalog.people import _UPD, _data, _traits
from clickloom.catalog.platform import _BROKEN, _envelopes
from clickloom.catalog.registry import query
from clickloom.operators import alerts as A, governance as G, identity as I, rollups as U
from clickloom.operators.alerts import Rule
from clickloom.session import new_folder
from clickloom.sources.demo import GAP, Demo
from clickloom.streaming import jobs as J
from clickloom.streaming.stateful import presence, spaced


class StreamedDemo(Demo):
    """The model with the event file read as a stream."""

    def table(self, name: str):
        if name != "events":
            return super().table(name)
        schema = super().table(name).schema
        return J.read_files(self.spark, self.folder, schema, glob="events.parquet")


def _live(m: Demo) -> StreamedDemo:
    return StreamedDemo(m.spark, m.folder)


@query("STR01_stream_sessions", f"WITH {SESS} SELECT visitor_id, {ts('first_at')} AS first_at, {ts('last_at')} AS last_at, pageview_count, event_count, entry_page, exit_page, is_bounce, duration_ms FROM sessions WHERE last_at + INTERVAL 24 HOUR < (SELECT max(created_at) FROM ev)")
def _(m):
    return J.run_to_table(J.sessions(_live(m).ev, GAP), "sessions")


@query("STR02_realtime_stream", f"""WITH {EV}, w AS (SELECT project_id, visitor_id, time_bucket(INTERVAL 2 HOUR, created_at) - to_hours(2 * i) AS s FROM ev CROSS JOIN range(3) t(i))
  SELECT project_id, {ts('s')} AS window_start, count(DISTINCT visitor_id) AS visitors FROM w WHERE s + INTERVAL 6 HOUR <= (SELECT max(created_at) FROM ev) GROUP BY project_id, s""")
def _(m):
    return J.run_to_table(J.realtime_visitors(_live(m).ev, "6 hours", "2 hours", "0 seconds"), "realtime")


@query("STR03_presence_expiry", f"WITH {EV}, w AS (SELECT DISTINCT project_id, time_bucket(INTERVAL 10 MINUTE, created_at) AS s FROM ev), n AS (SELECT w.project_id, s, count(*) AS n FROM w JOIN ev e ON e.project_id = w.project_id AND time_bucket(INTERVAL 10 MINUTE, e.created_at) = s GROUP BY 1, 2) SELECT project_id, {ts('s')} AS window_start, n FROM n WHERE s + INTERVAL 10 MINUTE <= (SELECT max(created_at) FROM ev)")
def _(m):
    return J.run_to_table(J.window_counts(_live(m).ev, 10, keys=["project_id"]), "presence").drop("window_end")


_DAYS = "visitor_id || strftime(created_at, '%m%d')"


@query("STR04_stream_goals", f"WITH {EV} SELECT DISTINCT g AS goal_id, {_DAYS} AS session_id FROM ev CROSS JOIN (VALUES ('exact'), ('prefix'), ('suffix'), ('both'), ('parts'), ('buy'), ('k7')) t(g) WHERE {_HIT}")
def _(m):
    rows = _live(m).ev.withColumn("event_data", F.col("props")).withColumn("session_id", F.concat("visitor_id", F.date_format("created_at", "MMdd")))
    return J.run_to_table(J.goal_conversions(rows, _GOALS).select("goal_id", "session_id", "created_at"), "goals").select("goal_id", "session_id")


@query("STR05_stream_exposures", f"WITH {EV} SELECT DISTINCT 'e' || (k % 3) AS experiment_id, visitor_id FROM ev WHERE event = 'click'")
def _(m):
    rows = _live(m).ev.filter("event = 'click'").select(F.concat(F.lit("e"), (F.col("k") % 3).cast("string")).alias("experiment_id"), "visitor_id", "created_at")
    return J.run_to_table(J.first_exposures(rows), "exposures").select("experiment_id", "visitor_id")


_ALERTS = f"""WITH RECURSIVE {EV}, w AS (SELECT time_bucket(INTERVAL 60 MINUTE, created_at) + INTERVAL 60 MINUTE AS e FROM ev WHERE event = 'error' GROUP BY 1 HAVING count(*) >= 3 AND time_bucket(INTERVAL 60 MINUTE, max(created_at)) + INTERVAL 60 MINUTE <= (SELECT max(created_at) FROM ev WHERE event = 'error')),
  f(t) AS (SELECT min(e) FROM w UNION ALL SELECT (SELECT min(e) FROM w WHERE e >= f.t + INTERVAL 300 MINUTE) FROM f WHERE f.t IS NOT NULL) SELECT 'errors' AS rule_id, {ts('t')} AS triggered_at FROM f WHERE t IS NOT NULL"""


@query("STR06_stream_alerts", _ALERTS)
def _(m):
    place = new_folder(m.spark, "alerts")
    counts = J.window_counts(_live(m).ev.filter("event = 'error'"), 60)
    J.run_batches(counts, J.alert_writer(Rule("errors", "error_count", "gte", 3, 60, 300), f"{place}/alerts"), f"{place}/checkpoint")
    return m.spark.read.parquet(f"{place}/alerts").select("rule_id", "triggered_at").distinct()


@query("STR06_stateful_alerts", _ALERTS)
def _(m):
    """The cooldown as state with a timer instead of the written alerts."""
    counts = J.window_counts(_live(m).ev.filter("event = 'error'"), 60)
    hot = J.run_to_table(counts, "windows").filter("n >= 3").select(F.lit("errors").alias("rule_id"), F.col("window_end").alias("triggered_at"))
    place = new_folder(m.spark, "hot")
    hot.write.parquet(place)
    return J.run_to_table(spaced(J.read_files(m.spark, place, hot.schema), ["rule_id"], 300 * 60, "triggered_at"), "alerts", stateful=True)


@query("STR05_expiring_exposures", f"""WITH RECURSIVE {EV}, x AS (SELECT 'e' || (k % 3) AS experiment_id, visitor_id, created_at AS t FROM ev WHERE event = 'click'),
  f(experiment_id, visitor_id, t) AS (SELECT experiment_id, visitor_id, min(t) FROM x GROUP BY 1, 2
    UNION ALL SELECT f.experiment_id, f.visitor_id, min(x.t) FROM f JOIN x ON x.experiment_id = f.experiment_id AND x.visitor_id = f.visitor_id AND x.t >= f.t + INTERVAL 5 DAY GROUP BY 1, 2)
  SELECT experiment_id, visitor_id, {ts('t')} AS created_at FROM f""")
def _(m):
    rows = _live(m).ev.filter("event = 'click'").select(F.concat(F.lit("e"), (F.col("k") % 3).cast("string")).alias("experiment_id"), "visitor_id", "created_at")
    return J.run_to_table(spaced(rows, ["experiment_id", "visitor_id"], 5 * 86_400), "exposures", stateful=True)


@query("STR03_presence", f"""WITH {EV}, g AS (SELECT project_id, visitor_id, created_at AS t, coalesce(created_at > lag(created_at) OVER w + INTERVAL 10 MINUTE, true) AS fresh FROM ev WINDOW w AS (PARTITION BY project_id, visitor_id ORDER BY created_at)),
  n AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY project_id, visitor_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS visit FROM g),
  v AS (SELECT project_id, visitor_id, min(t) AS first, max(t) + INTERVAL 10 MINUTE AS gone FROM n GROUP BY project_id, visitor_id, visit)
  SELECT project_id, visitor_id, 'online' AS state, {ts('first')} AS created_at FROM v
  UNION ALL SELECT project_id, visitor_id, 'offline', {ts('gone')} FROM v WHERE gone <= (SELECT max(created_at) FROM ev)""")
def _(m):
    return J.run_to_table(presence(_live(m).ev, ["project_id", "visitor_id"]), "presence_states", stateful=True)


@query("STR07_stream_spikes", f"""WITH {_BASE}, w AS (SELECT project_id, time_bucket(INTERVAL 10 MINUTE, created_at) AS s, count(*) * 6.0 AS rate FROM ev WHERE event = '$pageview' GROUP BY 1, 2)
  SELECT w.project_id, {ts('s')} AS window_start, {r4('rate')} AS rate, {r4('avg_pageviews * 20')} AS avg_pageviews FROM w JOIN base b ON b.project_id = w.project_id AND b.hour = hour(s) AND b.weekday = isodow(s) - 1
  WHERE avg_pageviews * 20 >= 1 AND rate / (avg_pageviews * 20) >= 0.5 AND s + INTERVAL 10 MINUTE <= (SELECT max(created_at) FROM ev WHERE event = '$pageview')""")
def _(m):
    base = A.baselines(m.flat_pageviews, "2024-01-30").withColumn("avg_pageviews", F.col("avg_pageviews") * 20)
    return J.run_to_table(J.spikes(_live(m).flat_pageviews, base, 0.5), "spikes")


@query("STR09_stream_validation", f"WITH {_VIOLATIONS} SELECT event_name, violation_type, property, count(*) AS n FROM violations GROUP BY 1, 2, 3")
def _(m):
    place = new_folder(m.spark, "validation")
    J.run_batches(_payloads(_live(m)), J.validation_writer(G.pick_schemas(_schemas(m), "plan"), "reject", place), f"{place}/checkpoint")
    return m.spark.read.parquet(f"{place}/violations").groupBy("event_name", "violation_type", "property").agg(F.count("*").alias("n"))


@query("STR10_stream_profiles", f"WITH {_UPD} SELECT visitor_id, max(value) FILTER (WHERE name = 'k') AS k, max(value) FILTER (WHERE name = 'path') AS path, max(value) FILTER (WHERE name = 'first') AS first FROM res WHERE value IS NOT NULL GROUP BY 1")
def _(m):
    place = new_folder(m.spark, "updates")
    rows = _data(_live(m)).filter(F.col("event_data").isNotNull()).select("visitor_id", "created_at", "event_id", "event_data")
    J.run_batches(rows, J.updates_writer(f"{place}/log"), f"{place}/checkpoint")
    return _traits(I.fold_properties(m.spark.read.parquet(f"{place}/log"), ["visitor_id"]))


@query("STR16_stream_reroll", f"WITH {EV} SELECT project_id, strftime(created_at, '%Y-%m-%d') AS date, event AS event_name, count(*) AS count FROM ev WHERE event <> '$pageview' GROUP BY ALL")
def _(m):
    place = new_folder(m.spark, "reroll")
    J.run_batches(_live(m).flat_events, J.reroll_writer(lambda: m.flat_events, U.daily_events, f"{place}/daily"), f"{place}/checkpoint")
    return m.spark.read.parquet(f"{place}/daily")


@query("SRC04_stream_flush", f"WITH {_BROKEN} SELECT 'click_events' AS \"table\", count(*) AS n FROM outc WHERE outcome = 'tracked' AND type = 'click_event' UNION ALL SELECT 'pageviews', count(*) FROM outc WHERE outcome = 'tracked' AND type = 'pageview' UNION ALL SELECT 'quarantine', count(*) FROM outc WHERE outcome = 'failed'")
def _(m):
    place = new_folder(m.spark, "flush")
    J.run_batches(_envelopes(_live(m), broken=True), J.flush_writer(place), f"{place}/checkpoint")
    parts = [m.spark.read.parquet(f"{place}/{t}").agg(F.count("*").alias("n")).withColumn("table", F.lit(t)) for t in ("click_events", "pageviews", "quarantine")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
