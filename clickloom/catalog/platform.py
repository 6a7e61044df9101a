"""Ingest, tables, routing, exports and BI (SRC, FLT23-FLT26, AGG71-AGG72)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.catalog.oracle import EV, EVS, SESS, r4, ts
from clickloom.catalog.registry import query
from clickloom.catalog.reports import IN as SPAN_IN, SPAN, _campaign_sql
from clickloom.operators import bi as I, reports as R, rollups as U, routing as O
from clickloom.operators.bi import Metric, Policy
from clickloom.plans.small import with_row
from clickloom.session import new_folder
from clickloom.sources import exports as E, ingest as G, tables as T
from clickloom.sources.demo import Demo, pick
from clickloom.sources.sessions import assign_sessions, summarise_sessions

# The event stream and sessions.


@query("SRC01_event_stream", f"WITH {EV} SELECT event_id, event, CAST(k AS VARCHAR) AS k, path, CASE WHEN event = '$pageview' THEN title END AS title, CASE WHEN event = '$pageview' THEN utm_source END AS utm_source, CAST(revenue_amount AS VARCHAR) AS revenue, revenue_currency FROM ev WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-20'")
def _(m):
    names = ["k", "path", "title", "utm_source", "revenue", "revenue_currency"]
    return m.stream("2024-01-05", "2024-01-20").select("event_id", "event", *[F.col("properties")[n].alias(n) for n in names])


@query("SRC01_one_side", f"WITH {EV} SELECT event, count(*) AS n FROM ev WHERE event IN ('click', 'signup') GROUP BY 1")
def _(m):
    return m.stream(names=["click", "signup"]).groupBy("event").agg(F.count("*").alias("n"))


@query("WIN15_session_numbers", f"WITH {EVS} SELECT event_id, session_id FROM evs")
def _(m):
    return m.evs.select("event_id", "session_id")


for _name in ("STR01_sessions_batch", "STR14_session_counters"):
    @query(_name, f"WITH {SESS} SELECT session_id, {ts('first_at')} AS first_at, {ts('last_at')} AS last_at, pageview_count, event_count, entry_page, exit_page, is_bounce, duration_ms FROM sessions")
    def _(m):
        return summarise_sessions(m.evs).drop("visitor_id")


@query("WIN15_half_hour_sessions", f"""WITH {EV}, g AS (SELECT visitor_id, CASE WHEN created_at - lag(created_at) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM ev WINDOW w AS (PARTITION BY visitor_id ORDER BY created_at, event_id))
  SELECT visitor_id, CAST(sum(brk) AS BIGINT) AS sessions FROM g GROUP BY 1""")
def _(m):
    return assign_sessions(m.ev, 1800).groupBy("visitor_id").agg(F.max("session_no").alias("sessions"))


# Envelopes made from the events.

_KINDS = list(G.TARGETS)


def _envelopes(m: Demo, broken: bool = False):
    """One envelope per event; its type follows the event id."""
    k, i = F.col("k"), F.col("event_id")
    kind = pick(_KINDS, i)
    if broken:
        kind = F.when(i % 17 == 0, F.lit("mystery")).otherwise(kind)
    visitor = F.when(i % 23 == 0, F.lit(None)).otherwise(F.col("visitor_id")) if broken else F.col("visitor_id")
    fields = F.struct(
        kind.alias("type"), F.unix_millis("created_at").alias("timestamp"), "project_id", visitor.alias("visitor_id"), "path",
        pick(["Mozilla/5.0 Chrome/120.0", "Googlebot/2.1"], F.floor(k / 10)).alias("user_agent"),
        *[c.alias(n) for n, c in zip(("utm_source", "utm_medium", "utm_campaign", "referrer", "_d"), m.touch_columns()) if n != "_d"],
        F.concat(F.lit("ev"), (k % 3).cast("string")).alias("name"), F.struct(k.alias("k")).alias("data"),
        F.col("value").alias("revenue"), F.lit("USD").alias("currency"),
        pick(["LCP", "CLS"], k).alias("metric_name"), F.col("value").alias("metric_value"), (k % 100).alias("max_depth_percent"),
        F.concat(F.lit("find "), k.cast("string")).alias("query"), k.alias("results_count"), F.lit("https://o.example.org").alias("url"),
        pick(["outlink", "download"], k).alias("link_type"), F.concat(F.lit("boom "), (k % 5).cast("string")).alias("message"),
        F.lit("a.js").alias("filename"), (k % 9).alias("lineno"), F.lit("r1").alias("release"), F.lit("prod").alias("environment"),
        pick(["warning", "INFO", "odd"] if broken else ["warning", "INFO"], k).alias("level"), F.col("value").alias("x"),
        k.cast("double").alias("y"), F.lit("#a").alias("selector"),
    )
    return m.ev.select("event_id", F.to_json(fields).alias("value"), F.lit("2024-02-01").cast("timestamp").alias("received_at"))


_TYPE = "[" + ", ".join(f"'{t}'" for t in _KINDS) + "]"
_ENV = f"{EV}, env AS (SELECT *, {_TYPE}[event_id % 12 + 1] AS type, (k // 10) % 2 = 1 AS bot FROM ev)"
_BROKEN = f"""{EV}, env0 AS (SELECT *, CASE WHEN event_id % 17 = 0 THEN 'mystery' ELSE {_TYPE}[event_id % 12 + 1] END AS type, (k // 10) % 2 = 1 AS bot FROM ev),
  env AS (SELECT *, CASE WHEN type = 'mystery' THEN 'unknown type' WHEN event_id % 23 = 0 THEN 'missing visitor' WHEN type = 'log' AND k % 3 = 2 THEN 'unsupported level' WHEN bot THEN 'bot' END AS reason FROM env0),
  outc AS (SELECT *, CASE WHEN reason IS NULL THEN 'tracked' WHEN reason = 'bot' THEN 'skipped' ELSE 'failed' END AS outcome FROM env)"""


def _tracked(m):
    return G.with_outcome(G.parse(_envelopes(m))).filter("outcome = 'tracked'")


@query("SRC02_envelope_routing", f"WITH {_BROKEN} SELECT type, outcome, reason, count(*) AS n, {ts('min(created_at)')} AS first_at FROM outc GROUP BY 1, 2, 3")
def _(m):
    out = G.with_outcome(G.parse(_envelopes(m, broken=True)))
    return out.groupBy("type", "outcome", "reason").agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"))


@query("SRC03_batch_outcomes", f"WITH {_BROKEN} SELECT event_id // 20 AS batch_id, count(*) AS total, count(*) FILTER (WHERE outcome = 'tracked') AS tracked, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'failed') AS failed FROM outc GROUP BY 1")
def _(m):
    return _batch_totals(_envelopes(m, broken=True).withColumn("batch_id", F.floor(F.col("event_id") / 20)))


def _batch_totals(lines):
    batches = lines.groupBy("batch_id", "received_at").agg(
        F.concat(F.lit('{"events": ['), F.array_join(F.collect_list("value"), ","), F.lit("]}")).alias("value"))
    items = G.batch_items(batches).withColumn("value", F.coalesce("value", F.lit("")))
    return G.batch_totals(G.with_outcome(G.parse(items)))


@query("SRC03_large_batches", f"WITH {_BROKEN}, twice AS (SELECT event_id // 500 AS batch_id, outcome FROM outc UNION ALL SELECT 1000000 + event_id // 500, outcome FROM outc) SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE outcome = 'tracked') AS tracked, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'failed') AS failed FROM twice GROUP BY 1")
def _(m):
    lines = _envelopes(m, broken=True).withColumn("batch_id", F.floor(F.col("event_id") / 500))
    return _batch_totals(lines.union(lines.withColumn("batch_id", F.col("batch_id") + 1_000_000)))


@query("SRC04_flush_quarantine", f"WITH {_BROKEN} SELECT reason, count(*) AS n FROM outc WHERE outcome = 'failed' GROUP BY 1")
def _(m):
    return G.quarantine(G.with_outcome(G.parse(_envelopes(m, broken=True)))).groupBy("reason").agg(F.count("*").alias("n"))


_APPENDS = {
    "SRC05_append_pageviews": ("pageview", "utm_source, referrer_domain, path", "utm_source, referrer_domain, path"),
    "SRC06_append_events": ("event", "'ev' || (k % 3) AS event_name, '{\"k\":' || k || '}' AS event_data, CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS revenue_amount", "event_name, event_data, revenue_amount"),
    "SRC07_append_web_vitals": ("web_vital", "CASE k % 2 WHEN 0 THEN 'LCP' ELSE 'CLS' END AS metric_name, CASE WHEN k % 2 = 0 THEN 'good' WHEN value <= 0.1 THEN 'good' WHEN value <= 0.25 THEN 'needs-improvement' ELSE 'poor' END AS rating", "metric_name, rating"),
    "SRC08_append_scroll_depths": ("scroll_depth", "path, k % 100 AS max_depth_percent", "path, max_depth_percent"),
    "SRC09_append_search_queries": ("search_query", "'find ' || k AS query, k AS results_count", "query, results_count"),
    "SRC10_append_outlinks": ("outlink", "'https://o.example.org' AS url, CASE k % 2 WHEN 0 THEN 'outlink' ELSE 'download' END AS link_type", "url, link_type"),
    "SRC11_append_js_errors": ("js_error", "substring(sha256('boom ' || (k % 5) || '|a.js|' || (k % 9) || '|'), 1, 32) AS fingerprint, 'r1' AS release", "fingerprint, release"),
    "SRC12_append_log_entries": ("log", "CASE k % 2 WHEN 0 THEN 'warn' ELSE 'info' END AS level, 'boom ' || (k % 5) AS message", "level, message"),
    "SRC13_append_click_events": ("click_event", "ROUND(value, 4) AS x, CAST(k AS DOUBLE) AS y, '#a' AS selector", "x, y, selector"),
}
for _name, (_kind, _columns, _shown) in _APPENDS.items():
    @query(_name, f"WITH {_ENV} SELECT visitor_id, {ts('created_at')} AS created_at, strftime(created_at, '%Y-%m') AS month, {_columns} FROM env WHERE type = '{_kind}' AND NOT bot")
    def _(m, kind=_kind, shown=_shown):
        return T.conform(G.route(_tracked(m), kind), G.TARGETS[kind]).select("visitor_id", "created_at", "month", *shown.split(", "))


def _chunks(m):
    k = F.col("k")
    events = F.transform(F.sequence(F.lit(0), k % 3), lambda i: F.concat(F.col("event"), i.cast("string")))
    return m.evs.select(
        "session_id", "visitor_id", F.col("created_at").alias("chunk_at"), F.col("event_id").alias("chunk_no"), events.alias("events"),
        F.when(k % 5 != 0, F.col("k") * 10).alias("duration_ms"), (k > 95).alias("is_complete"), F.when(k % 4 != 0, F.col("path")).alias("entry_page"))


_REC = f"""{EVS}, rec AS (SELECT session_id, min(visitor_id) AS visitor_id, CAST(sum(k % 3 + 1) AS BIGINT) AS events_count, min(created_at) AS started_at, coalesce(max(CASE WHEN k % 5 <> 0 THEN k * 10 END), 0) AS duration_ms,
    arg_min(path, (created_at, event_id)) FILTER (WHERE k % 4 <> 0) AS entry_page, bool_or(k > 95) AS is_complete FROM evs GROUP BY 1)"""


@query("SRC14_replay_merge", f"WITH {_REC} SELECT session_id, visitor_id, events_count, {ts('started_at')} AS started_at, duration_ms, entry_page, is_complete FROM rec")
def _(m):
    return G.recordings(_chunks(m))


@query("SRC14_replay_events", f"WITH {EVS} SELECT session_id, event_id AS chunk_no, i AS position, event || i AS event FROM evs CROSS JOIN range(3) t(i) WHERE i <= k % 3")
def _(m):
    return G.recording_events(_chunks(m)).drop("chunk_at")


@query("SRC15_recordings_list", f"WITH {_REC} SELECT session_id, events_count FROM rec WHERE started_at >= TIMESTAMP '2024-01-05' AND started_at <= TIMESTAMP '2024-01-20' ORDER BY started_at DESC, session_id DESC LIMIT 20 OFFSET 5")
def _(m):
    return G.list_recordings(G.recordings(_chunks(m)), "2024-01-05", "2024-01-20", 20, 5).select("session_id", "events_count")


# Webhook sources and routing.

_RAW = ["Stripe/Checkout Session.Completed", " !!! ", "Lead Created", "__a  b//c__", "UPPER:x-1"]
_TYPED = ["stripe_checkout_session.completed", "webhook_event", "lead_created", "a_b_c", "upper:x-1"]


def _payloads(m):
    k = F.col("k")
    field = pick(["event_type", "type", "event", "name", "other"], F.floor(k / 5))
    body = F.concat(F.lit('{"'), field, F.lit('": "'), pick(_RAW, k), F.lit('", "n": '), k.cast("string"), F.lit("}"))
    number = F.concat(F.lit('{"event_type": 5, "name": "x", "n": '), k.cast("string"), F.lit("}"))
    return m.ev.select("event_id", "project_id", "created_at", F.when(k == 99, number).otherwise(body).alias("payload"))


def _case(values) -> str:
    return f"CASE k % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_PAY = f"{EV}, pay AS (SELECT event_id, project_id, created_at, k, CASE WHEN k = 99 OR (k // 5) % 5 = 4 THEN 'webhook_event' ELSE {_case(_TYPED)} END AS event_type FROM ev)"
_DEST = """dest AS (SELECT * FROM (VALUES ('d1', 'p0', true, ['lead_created', 'a_b_c']), ('d2', 'p0', true, []), ('d3', 'p1', false, []), ('d4', 'p1', true, ['webhook_event']), ('d5', 'p0', true, ['a_b_c'])) t(destination_id, project_id, is_active, types)),
  outbox AS (SELECT p.event_id, p.event_type, destination_id FROM pay p JOIN dest d ON d.project_id = p.project_id AND is_active AND (length(types) = 0 OR list_contains(types, p.event_type)))"""


def _typed(m):
    return _payloads(m).withColumn("event_type", O.event_type(F.col("payload")))


def _destinations(m):
    rows = [("d1", "p0", True, ["lead_created", "a_b_c"]), ("d2", "p0", True, []), ("d3", "p1", False, []), ("d4", "p1", True, ["webhook_event"]), ("d5", "p0", True, ["a_b_c"])]
    return m.spark.createDataFrame(rows, "destination_id string, project_id string, is_active boolean, event_types array<string>")


@query("SRC18_event_type", f"WITH {_PAY} SELECT event_id, event_type FROM pay")
def _(m):
    return _typed(m).select("event_id", "event_type")


@query("SRC19_destination_routing", f"WITH {_PAY}, {_DEST} SELECT * FROM outbox")
def _(m):
    return O.route(_typed(m), _destinations(m)).select("event_id", "event_type", "destination_id")


@query("SRC17_source_capture", f"WITH {_PAY}, {_DEST} SELECT p.event_id, p.event_type, count(destination_id) AS deliveries, CAST(k AS VARCHAR) AS n FROM pay p LEFT JOIN outbox o USING (event_id) GROUP BY p.event_id, p.event_type, k")
def _(m):
    events = _typed(m)
    log = O.ingestion_log(events, O.route(events, _destinations(m)))
    wrapped = O.wrap_payload(F.lit("src"), F.lit("Shop"), F.col("event_type"), F.col("payload"), F.col("created_at"))
    return log.withColumn("w", wrapped).select("event_id", F.get_json_object("w", "$.event_type").alias("event_type"), "deliveries", F.get_json_object("w", "$.payload.n").alias("n"))


@query("SRC20_payload_transform", f"""WITH {EV} SELECT event_id, CASE k % 3 WHEN 0 THEN '{{"data":{{"customer":{{"id":' || k || '}},"event_type":"' || event || '","payload":{{"amount":' || (k % 7) || '}},"platform":"web"}}}}'
  WHEN 1 THEN '{{"event_type":"' || event || '","payload":{{"amount":' || (k % 7) || '}}}}' ELSE '{{"event_type":"' || event || '","payload":{{"amount":' || (k % 7) || ',"customer_id":' || k || '}}}}' END AS payload FROM ev""")
def _(m):
    k = F.col("k")
    body = F.to_json(F.struct(F.col("event").alias("event_type"), F.struct(k.alias("customer_id"), (k % 7).alias("amount")).alias("payload")))
    rules = pick([
        '{"include": ["event_type", "payload.customer_id", "payload.amount", "none"], "rename": {"payload.customer_id": "customer.id"}, "set": {"platform": "web"}, "wrap": "data"}',
        '{"exclude": ["payload.customer_id", "a.b"]}', "{}"], k)
    return m.ev.select("event_id", O.transform_payload(body, rules).alias("payload"))


def _attempts(m):
    """Up to three tries per routed delivery; a success ends them."""
    routed = O.route(_typed(m), _destinations(m))
    tries = F.explode(F.sequence(F.lit(1), F.least(F.col("event_id") % 4 + 1, F.lit(3)))).alias("attempt")
    rows = routed.select(F.concat_ws("-", F.col("event_id").cast("string"), "destination_id").alias("delivery_id"), "event_id", "destination_id", "created_at", tries)
    return rows.withColumn("ok", F.col("attempt") == F.col("event_id") % 4 + 1).withColumn("at", F.timestamp_seconds(F.unix_seconds("created_at") + F.col("attempt") * 100))


_STATE = f"""{_PAY}, {_DEST}, state AS (SELECT event_id || '-' || destination_id AS delivery_id, o.event_id, destination_id, created_at, least(o.event_id % 4 + 1, 3) AS attempts, CASE WHEN o.event_id % 4 = 3 THEN 'dead_letter' ELSE 'delivered' END AS status FROM outbox o JOIN pay USING (event_id)),
  half AS (SELECT delivery_id, event_id, destination_id, created_at, 1 AS attempts, CASE WHEN event_id % 4 = 0 THEN 'delivered' ELSE 'retry' END AS status,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE to_timestamp(floor(epoch(created_at)) + 100 + 60) END AS due FROM state)"""


@query("SRC22_retry_state", f"WITH {_STATE} SELECT delivery_id, attempts, status, CASE WHEN status = 'dead_letter' THEN strftime(to_timestamp(floor(epoch(created_at)) + 300)::TIMESTAMP, '%Y-%m-%dT%H:%M:%S') END AS next_retry_at FROM state")
def _(m):
    return O.retry_state(_attempts(m))


@query("SRC22_retry_after_first", f"WITH {_STATE} SELECT delivery_id, attempts, status, strftime(due::TIMESTAMP, '%Y-%m-%dT%H:%M:%S') AS next_retry_at FROM half")
def _(m):
    return O.retry_state(_attempts(m).filter("attempt = 1"))


def _outbox(m):
    first = _attempts(m).filter("attempt = 1")
    return first.select("delivery_id", "event_id", "destination_id", "created_at").join(O.retry_state(first), "delivery_id")


@query("SRC21_due_deliveries", f"WITH {_STATE} SELECT delivery_id FROM half WHERE status = 'retry' AND due::TIMESTAMP <= TIMESTAMP '2024-01-20' ORDER BY created_at, delivery_id LIMIT 50")
def _(m):
    return O.due_deliveries(_outbox(m), _destinations(m), "2024-01-20", 50).select("delivery_id")


for _name in ("SRC23_destination_health", "JON24_destination_deliveries"):
    @query(_name, f"""WITH {_STATE}, n AS (SELECT destination_id, count(*) AS total, count(*) FILTER (WHERE status = 'delivered') AS ok, count(*) FILTER (WHERE status = 'retry') AS again, max(created_at) FILTER (WHERE status = 'delivered') AS s, max(created_at) FILTER (WHERE status = 'retry') AS f FROM half GROUP BY 1)
      SELECT d.destination_id, coalesce(total, 0) AS total_deliveries, coalesce(ok, 0) AS delivered_deliveries, coalesce(again, 0) AS retry_deliveries, (SELECT count(*) FROM half h WHERE h.destination_id = d.destination_id AND status = 'retry' AND (s IS NULL OR created_at > s)) AS failure_count,
        CASE WHEN NOT is_active THEN 'disabled' WHEN f IS NOT NULL AND (s IS NULL OR f > s) THEN 'failing' ELSE 'healthy' END AS status FROM dest d LEFT JOIN n USING (destination_id)""")
    def _(m):
        first = _attempts(m).filter("attempt = 1").withColumn("at", F.col("created_at"))
        dest = _destinations(m).join(O.destination_counters(first), "destination_id", "left").fillna(0, ["failure_count"])
        return O.destination_health(dest, _outbox(m)).select("destination_id", "total_deliveries", "delivered_deliveries", "retry_deliveries", "failure_count", "status")


# Uploads, adapters and partitions.


@query("SRC24_csv_upload", "SELECT 'up1' AS upload_id, row_number() OVER () AS row_number, CAST(c_custkey AS VARCHAR) AS key, c_name AS name FROM customer")
def _(m):
    rows = T.upload_rows(m.table("customer"), "up1")
    return rows.select("upload_id", "row_number", F.get_json_object("row_data", "$.c_custkey").alias("key"), F.get_json_object("row_data", "$.c_name").alias("name"))


@query("SRC24_csv_with_line_breaks", "SELECT row_number() OVER (ORDER BY doc_id) AS row_number, CAST(doc_id AS VARCHAR) AS doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents")
def _(m):
    """Whole documents as a CSV file with quotes and line breaks inside fields, uploaded in splits."""
    path = new_folder(m.spark, "upload")
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in ("doc_id", "source", "text")]
    m.table("documents").repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").select(F.concat_ws(",", *quoted).alias("value")).write.text(path)
    good, _ = T.upload_csv(m.spark, path, "up2", ["doc_id", "source", "text"], header=False)
    return good.select("row_number", *[F.coalesce(F.get_json_object("row_data", f"$.{c}"), F.lit("")).alias(c) for c in ("doc_id", "source", "text")])


@query("SRC25_upload_page", "SELECT row_number, name FROM (SELECT row_number() OVER () AS row_number, c_name AS name FROM customer) ORDER BY 1 LIMIT 15 OFFSET 30")
def _(m):
    rows = T.upload_rows(m.table("customer"), "up1").select("row_number", F.get_json_object("row_data", "$.c_name").alias("name"))
    return rows.orderBy("row_number").offset(30).limit(15)


@query("SRC29_adapter_rows", f"WITH {EV} SELECT event_id, '{{\"k\":' || k || '}}' AS \"row\" FROM ev WHERE k % 4 < 3 UNION ALL SELECT event_id, '{{\"z\":1}}' FROM ev WHERE k % 4 < 3")
def _(m):
    items = F.concat(F.lit("["), F.col("props"), F.lit(', {"z": 1}]'))
    body = F.concat(pick(["", '{"rows": ', '{"data": ', '{"none": '], F.col("k")), items, pick(["", "}", "}", "}"], F.col("k")))
    return T.adapter_rows(m.ev.select("event_id", body.alias("body"))).select("event_id", "row")


@query("SRC37_month_partitions", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS rows, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS first_at, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS last_at FROM orders GROUP BY 1")
def _(m):
    return T.partitions(m.table("orders").withColumn("created_at", F.col("o_orderdate").cast("timestamp")))


@query("SRC38_expired_months", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE date_trunc('month', o_orderdate) + INTERVAL 1 MONTH <= DATE '1997-03-15'")
def _(m):
    return T.expired_months(m.table("orders").withColumn("created_at", F.col("o_orderdate").cast("timestamp")), "1997-03-15")


@query("SRC38_retained_rows", "SELECT count(*) FILTER (WHERE date_trunc('month', o_orderdate) + INTERVAL 1 MONTH > DATE '1997-03-15') AS by_month, count(*) FILTER (WHERE o_orderdate >= DATE '1997-03-15') AS by_row FROM orders")
def _(m):
    orders = m.table("orders").withColumn("created_at", F.col("o_orderdate").cast("timestamp"))
    a = T.retained(orders, "1997-03-15").agg(F.count("*").alias("by_month"))
    return with_row(a, T.retained(orders, "1997-03-15", by_month=False).agg(F.count("*").alias("by_row")))


# Exports and summaries.


@query("SRC30_export_stats", f"""WITH {SESS}, d AS (SELECT CAST(created_at AS DATE) AS day, project_id, count(*) AS pageviews, count(DISTINCT visitor_id) AS visitors, count(DISTINCT session_id) AS sessions FROM pv WHERE CAST(created_at AS DATE) >= DATE '2024-01-10' AND CAST(created_at AS DATE) < DATE '2024-01-30' GROUP BY 1, 2),
  v AS (SELECT CAST(first_at AS DATE) AS day, project_id, count(*) FILTER (WHERE is_bounce) AS bounces, sum(duration_ms) AS dur FROM sessions GROUP BY 1, 2)
  SELECT strftime(day, '%Y-%m-%d') AS date, CAST(sum(pageviews) AS BIGINT) AS pageviews, CAST(sum(visitors) AS BIGINT) AS visitors, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(coalesce(bounces, 0)) AS BIGINT) AS bounces, CAST(sum(coalesce(dur, 0)) AS BIGINT) AS total_duration_ms FROM d LEFT JOIN v USING (day, project_id) GROUP BY 1
  UNION ALL SELECT '2024-01-30', count(*), count(DISTINCT visitor_id), count(DISTINCT session_id), (SELECT count(*) FILTER (WHERE is_bounce) FROM sessions WHERE first_at >= TIMESTAMP '2024-01-30' AND first_at <= TIMESTAMP '2024-01-30 18:00:00'),
    (SELECT CAST(coalesce(sum(duration_ms), 0) AS BIGINT) FROM sessions WHERE first_at >= TIMESTAMP '2024-01-30' AND first_at <= TIMESTAMP '2024-01-30 18:00:00') FROM pv WHERE created_at >= TIMESTAMP '2024-01-30' AND created_at <= TIMESTAMP '2024-01-30 18:00:00'""")
def _(m):
    return E.stats_rows(m.pageviews, m.sessions, U.daily_stats(m.pageviews, m.sessions), SPAN)


@query("SRC31_export_pages", f"WITH {EV} SELECT path, count(*) AS views FROM ev WHERE event = '$pageview' AND {SPAN_IN} GROUP BY 1")
def _(m):
    return R.top_pages(m.flat_pageviews, U.daily_pages(m.flat_pageviews), SPAN, None).select("path", "views")


@query("SRC32_export_referrers", f"""WITH {EVS}, d AS (SELECT coalesce(referrer_domain, 'Direct') AS referrer_domain, count(DISTINCT session_id) AS n FROM pv WHERE {SPAN_IN} AND created_at < TIMESTAMP '2024-01-30' GROUP BY 1, CAST(created_at AS DATE), project_id
  UNION ALL SELECT coalesce(referrer_domain, 'Direct'), count(DISTINCT session_id) FROM pv WHERE {SPAN_IN} AND created_at >= TIMESTAMP '2024-01-30' GROUP BY 1) SELECT referrer_domain, CAST(sum(n) AS BIGINT) AS visits FROM d GROUP BY 1""")
def _(m):
    return R.top_referrers(m.pageviews, U.daily_referrers(m.pageviews), SPAN, None)


@query("SRC33_export_events", f"WITH {EV} SELECT event AS event_name, count(*) AS count FROM ev WHERE event <> '$pageview' AND {SPAN_IN} GROUP BY 1")
def _(m):
    return R.top_events(m.flat_events, U.daily_events(m.flat_events), SPAN, None)


@query("SRC34_export_devices", f"WITH {SESS} SELECT browser, os, device_type AS device, count(DISTINCT visitor_id) AS visitors FROM sessions WHERE {SPAN_IN.replace('created_at', 'first_at')} GROUP BY ALL")
def _(m):
    return R.devices(m.sessions, SPAN, None)


@query("SRC35_export_geo", f"WITH {SESS} SELECT coalesce(country, 'XX') AS country, count(DISTINCT visitor_id) AS visitors FROM sessions WHERE {SPAN_IN.replace('created_at', 'first_at')} GROUP BY ALL")
def _(m):
    return R.geo(m.sessions, SPAN, None)


@query("SRC36_export_campaigns", f"SELECT * EXCLUDE (bounce_rate) FROM ({_campaign_sql('utm_source, utm_medium, utm_campaign', 'utm_source IS NOT NULL')})")
def _(m):
    return E.campaign_rows(m.pageviews, m.sessions, U.daily_campaigns(m.pageviews, m.sessions), SPAN)


@query("SRC41_daily_summaries", f"""WITH {SESS}, d AS (SELECT project_id, count(*) AS pageviews, count(DISTINCT visitor_id) AS visitors, count(DISTINCT session_id) AS sessions FROM pv WHERE CAST(created_at AS DATE) = DATE '2024-01-12' GROUP BY 1),
  v AS (SELECT project_id, count(*) FILTER (WHERE is_bounce) AS bounces, sum(duration_ms) AS dur FROM sessions WHERE CAST(first_at AS DATE) = DATE '2024-01-12' GROUP BY 1)
  SELECT project_id, '2024-01-12' AS date, pageviews, visitors, sessions, ROUND(CAST(coalesce(bounces, 0) / sessions * 100 AS DOUBLE), 0) AS bounce_rate, CAST(coalesce(dur, 0) // sessions AS BIGINT) AS avg_duration_ms FROM d LEFT JOIN v USING (project_id)""")
def _(m):
    return E.daily_summaries(U.daily_stats(m.pageviews, m.sessions), "2024-01-12")


@query("SRC42_report_payload", f"""WITH {EV}, p AS (SELECT 'pages' AS section, path AS name, count(*) AS value FROM ev WHERE event = '$pageview' AND {SPAN_IN} GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)
  SELECT * FROM p UNION ALL SELECT 'totals', 'events', count(*) FROM ev WHERE event <> '$pageview' AND {SPAN_IN} UNION ALL SELECT 'totals', 'visitors', count(DISTINCT visitor_id) FROM ev WHERE event = '$pageview' AND {SPAN_IN} UNION ALL SELECT 'totals', 'pageviews', count(*) FROM ev WHERE event = '$pageview' AND {SPAN_IN}""")
def _(m):
    daily = U.daily_stats(m.pageviews, m.sessions)
    out = E.report_payload(m.pageviews, m.sessions, m.events, daily, U.daily_events(m.flat_events), U.daily_pages(m.flat_pageviews), U.daily_referrers(m.pageviews), SPAN)
    return out.filter((F.col("section") == "pages") | F.col("name").isin("events", "visitors", "pageviews"))


# BI.


@query("AGG71_visual_query", f"""WITH {EVS} SELECT coalesce(utm_source, '') AS utm_source, strftime(created_at, '%Y-%m-%d') AS date, count(*) AS count, count(DISTINCT visitor_id) AS unique_visitors, count(DISTINCT session_id) AS sessions
  FROM pv WHERE {SPAN_IN} AND path NOT IN ('/p1', '/p2') AND utm_source IN ('google', 'facebook') GROUP BY ALL""")
def _(m):
    policies = [Policy("pageviews", "path", "not_in", ("/p1", "/p2")), Policy("pageviews", "utm_source", "in", ("google", "facebook")), Policy("events", "path", "eq", ("/zzz",))]
    return I.visual_query(m.pageviews, "pageviews", ["utm_source", "date"], ["count", "unique_visitors", "sessions"], SPAN.start, SPAN.end, policies)


@query("AGG71_visual_rollup", f"WITH {EV} SELECT event AS event_name, path, count(*) AS count, {r4('coalesce(sum(revenue_amount), 0)')} AS revenue FROM ev WHERE event <> '$pageview' AND {SPAN_IN} GROUP BY ROLLUP (event, path)")
def _(m):
    return I.visual_query(m.flat_events, "events", ["event_name", "path"], ["count", "revenue"], SPAN.start, SPAN.end, totals="rollup")


@query("AGG71_visual_sessions", f"WITH {SESS} SELECT browser, device_type AS device, {r4('avg(duration_ms)')} AS avg_duration, count(DISTINCT visitor_id) AS visitors FROM sessions WHERE {SPAN_IN.replace('created_at', 'first_at')} GROUP BY ALL ORDER BY avg(duration_ms) DESC LIMIT 4")
def _(m):
    return I.visual_query(m.sessions, "sessions", ["browser", "device"], ["avg_duration", "visitors"], SPAN.start, SPAN.end, limit=4)


@query("AGG72_semantic_metric", f"WITH {EV} SELECT path, {r4('sum(revenue_amount) FILTER (WHERE k > 50)')} AS late_revenue, count(*) AS count FROM ev WHERE event <> '$pageview' AND {SPAN_IN} GROUP BY 1")
def _(m):
    metric = Metric("events", "late_revenue", "sum(revenue_amount)", "k > 50")
    return I.visual_query(m.flat_events, "events", ["path"], [metric, "count"], SPAN.start, SPAN.end)


@query("FLT23_drill_through", f"WITH {SESS} SELECT event_id, path, pv.utm_source, browser, country FROM pv JOIN sessions USING (session_id) WHERE {SPAN_IN} AND path IN ('/p1', '/p3') AND browser = 'Chrome' ORDER BY pv.created_at DESC, event_id DESC LIMIT 60")
def _(m):
    rows = I.drill_through(m.pageviews, "pageviews", {"path": ["/p1", "/p3"], "browser": "Chrome"}, SPAN.start, SPAN.end, limit=60, sessions=m.sessions)
    return rows.select("event_id", "path", "utm_source", "browser", "country")


@query("FLT24_drill_filters", f"WITH {SESS} SELECT session_id, entry_page FROM sessions WHERE {SPAN_IN.replace('created_at', 'first_at')} AND entry_page = '/p4' AND device_type = 'mobile'")
def _(m):
    return I.drill_through(m.sessions, "sessions", {"entry_page": "/p4", "device": "mobile"}, SPAN.start, SPAN.end, limit=None).select("session_id", "entry_page")


@query("FLT25_row_policies", f"WITH {EV} SELECT coalesce(revenue_currency, 'none') AS currency, event, count(*) AS n FROM ev WHERE event <> '$pageview' AND event <> 'error' AND revenue_currency <> 'EUR' GROUP BY 1, 2")
def _(m):
    policies = [Policy("events", "event_name", "neq", ("error",)), Policy("events", "revenue_currency", "not_in", ("EUR",))]
    kept = I.apply_policies(m.flat_events, "events", policies)
    return kept.groupBy(F.coalesce("revenue_currency", F.lit("none")).alias("currency"), F.col("event_name").alias("event")).agg(F.count("*").alias("n"))


@query("FLT26_tenant_scope", f"WITH {EVS} SELECT e.event_name, count(*) AS n, count(DISTINCT p.visitor_id) AS viewers FROM ce e LEFT JOIN (SELECT DISTINCT visitor_id FROM pv WHERE project_id = 'p1') p USING (visitor_id) WHERE project_id = 'p1' GROUP BY 1")
def _(m):
    loaders = {"pageviews": lambda s: Demo(s, m.folder).flat_pageviews, "events": lambda s: Demo(s, m.folder).flat_events}
    return I.tenant_sql(
        m.spark, "p1", loaders,
        "SELECT e.event_name, count(*) AS n, count(DISTINCT p.visitor_id) AS viewers FROM events e LEFT JOIN (SELECT DISTINCT visitor_id FROM pageviews) p USING (visitor_id) GROUP BY 1",
    )


# Re-rolled days.


@query("STR16_rerolled_days", f"WITH {EV} SELECT project_id, strftime(created_at, '%Y-%m-%d') AS date, event AS event_name, count(*) AS count FROM ev WHERE event <> '$pageview' AND CAST(created_at AS DATE) IN (SELECT DISTINCT CAST(created_at AS DATE) FROM ev WHERE k = 42 AND event = 'signup') GROUP BY ALL")
def _(m):
    late = m.flat_events.filter("k = 42 and event_name = 'signup'")
    return U.reroll(m.flat_events, U.touched_days(late), U.daily_events)
