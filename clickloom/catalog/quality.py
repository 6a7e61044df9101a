"""Vitals, errors, logs, clicks, surveys, guides and model usage (AGG39-AGG55)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.catalog.oracle import CLICKS, ERRORS, EV, GENERATIONS, LOGS, RESPONSES, VITALS, r4, ts
from clickloom.catalog.registry import query
from clickloom.operators import feedback as B, quality as Q
from clickloom.operators.reports import Span
from clickloom.sources.demo import pick

SPAN = Span("2024-01-05", "2024-01-25", "2024-01-30")
IN = "created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-25'"


@query("AGG39_vitals_summary", f"""WITH {VITALS}, n AS (SELECT unnest(['LCP', 'FID', 'INP', 'CLS', 'FCP', 'TTFB']) AS metric_name), v AS (SELECT metric_name, quantile_cont(metric_value, 0.5) AS p50,
    quantile_cont(metric_value, 0.75) AS p75, quantile_cont(metric_value, 0.99) AS p99, count(*) FILTER (WHERE rating = 'good') AS good, count(*) FILTER (WHERE rating = 'needs-improvement') AS needs_improvement,
    count(*) FILTER (WHERE rating = 'poor') AS poor FROM vitals WHERE {IN} AND k <> 0 GROUP BY 1)
  SELECT metric_name, {r4('coalesce(p50, 0)')} AS p50, {r4('coalesce(p75, 0)')} AS p75, {r4('coalesce(p99, 0)')} AS p99, coalesce(good, 0) AS good, coalesce(needs_improvement, 0) AS needs_improvement, coalesce(poor, 0) AS poor,
    coalesce(good + needs_improvement + poor, 0) AS total FROM n LEFT JOIN v USING (metric_name)""".replace("AND k <> 0", "AND metric_name <> 'FID'"))
def _(m):
    return Q.vitals_summary(m.vitals.filter("metric_name <> 'FID'"), SPAN)


_PAGE = ", ".join(f"{r4(f'''quantile_cont(metric_value, 0.75) FILTER (WHERE metric_name = '{n}')''')} AS {n.lower()}_p75" for n in Q.VITALS)


@query("AGG40_vitals_by_page", f"WITH {VITALS} SELECT path, count(*) AS samples, {_PAGE} FROM vitals WHERE {IN} GROUP BY 1")
def _(m):
    return Q.vitals_by_page(m.vitals, SPAN)


@query("AGG41_vitals_timeseries", f"WITH {VITALS} SELECT strftime(created_at, '%Y-%m-%d') AS date, {r4('quantile_cont(metric_value, 0.75)')} AS p75 FROM vitals WHERE {IN} AND metric_name = 'LCP' GROUP BY 1")
def _(m):
    return Q.vitals_timeseries(m.vitals, SPAN, "LCP")


_RATE = "CASE metric_name WHEN 'LCP' THEN CASE WHEN v <= 2500 THEN 'good' WHEN v <= 4000 THEN 'needs-improvement' ELSE 'poor' END WHEN 'CLS' THEN CASE WHEN v <= 0.1 THEN 'good' WHEN v <= 0.25 THEN 'needs-improvement' ELSE 'poor' END WHEN 'INP' THEN CASE WHEN v <= 200 THEN 'good' WHEN v <= 500 THEN 'needs-improvement' ELSE 'poor' END WHEN 'TTFB' THEN CASE WHEN v <= 800 THEN 'good' WHEN v <= 1800 THEN 'needs-improvement' ELSE 'poor' END END"


@query("SCL34_vital_rating", f"WITH {VITALS}, x AS (SELECT metric_name, metric_value * 30 AS v FROM vitals) SELECT metric_name, {_RATE} AS rating, count(*) AS n FROM x GROUP BY 1, 2")
def _(m):
    rated = Q.vital_rating(F.col("metric_name"), F.col("metric_value") * 30)
    return m.vitals.groupBy("metric_name", rated.alias("rating")).agg(F.count("*").alias("n"))


# Errors.

_PRINT = "substring(sha256(message || '|' || filename || '|' || lineno || '|' || coalesce(trim(split_part(stack, chr(10), 2)), '')), 1, 32)"
_PRINTED = f"{ERRORS}, printed AS (SELECT *, {_PRINT} AS fingerprint FROM js_errors), maps AS (SELECT 'r' || (i % 2) AS release, CASE WHEN i < 2 THEN 'prod' ELSE 'stage' END AS environment, 'js/f' || i || '.js' AS minified_url, i AS map_id, i AS made FROM range(4) t(i) UNION ALL SELECT 'r0', 'prod', 'f2.js', 10, 20 UNION ALL SELECT 'r0', 'prod', 'js/f2.js', 11, 30)"


def _maps(m):
    rows = [(f"r{i % 2}", "prod" if i < 2 else "stage", f"js/f{i}.js", i, i) for i in range(4)]
    rows += [("r0", "prod", "f2.js", 10, 20), ("r0", "prod", "js/f2.js", 11, 30)]
    return m.spark.createDataFrame(rows, "release string, environment string, minified_url string, map_id int, created_at int")


@query("SCL09_error_fingerprint", f"WITH {_PRINTED} SELECT event_id, fingerprint FROM printed")
def _(m):
    return Q.with_fingerprint(m.js_errors).select("event_id", "fingerprint")


for _name in ("AGG42_error_groups", "JON13_mapped_error_groups"):
    @query(_name, f"""WITH {_PRINTED} SELECT fingerprint, e.release, e.environment, count(*) AS count, count(DISTINCT visitor_id) AS affected_visitors, {ts('min(created_at)')} AS first_seen, {ts('max(created_at)')} AS last_seen,
        arg_max(message, (created_at, event_id)) AS last_message, arg_max(path, (created_at, event_id)) AS last_path, arg_max(browser, (created_at, event_id)) AS last_browser,
        EXISTS (SELECT 1 FROM maps m WHERE m.release = e.release AND m.environment = e.environment) AS source_map_configured FROM printed e WHERE {IN} GROUP BY 1, 2, 3""")
    def _(m):
        return Q.error_groups(Q.with_fingerprint(m.js_errors), _maps(m), SPAN, limit=None)


@query("JON12_error_source_map", f"WITH {_PRINTED} SELECT event_id, (SELECT map_id FROM maps m WHERE m.release = e.release AND m.environment = e.environment AND ends_with(e.filename, m.minified_url) ORDER BY made DESC LIMIT 1) AS source_map_id FROM printed e".replace("(SELECT map_id", "CAST((SELECT map_id").replace("LIMIT 1)", "LIMIT 1) AS BIGINT)"))
def _(m):
    return Q.match_source_maps(m.js_errors, _maps(m)).select("event_id", "source_map_id")


@query("AGG43_error_timeseries", f"WITH {ERRORS} SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS count FROM js_errors WHERE {IN} GROUP BY 1")
def _(m):
    return Q.error_timeseries(m.js_errors, SPAN)


@query("AGG44_error_stats", f"WITH {_PRINTED} SELECT count(*) AS total_errors, count(DISTINCT fingerprint) AS unique_errors, count(DISTINCT visitor_id) AS affected_visitors FROM printed WHERE {IN}")
def _(m):
    return Q.error_stats(Q.with_fingerprint(m.js_errors), SPAN)


@query("AGG44_errors_by_release", f"WITH {ERRORS} SELECT release, count(*) AS count FROM js_errors WHERE {IN} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(m):
    return Q.errors_by_release(m.js_errors, SPAN)


# Logs.

_LEVEL = "CASE WHEN lower(trim(raw_level)) = 'warning' THEN 'warn' WHEN lower(trim(raw_level)) IN ('trace', 'debug', 'info', 'warn', 'error', 'fatal', 'critical') THEN lower(trim(raw_level)) END"
_LEVELED = f"{LOGS}, leveled AS (SELECT *, {_LEVEL} AS level FROM logs), good AS (SELECT * FROM leveled WHERE level IS NOT NULL)"


def _logs(m):
    return m.logs.withColumn("level", Q.log_level(F.col("raw_level")))


@query("FLT30_log_level", f"WITH {_LEVELED} SELECT event_id, level FROM leveled")
def _(m):
    return _logs(m).select("event_id", "level")


@query("FLT29_log_search", f"WITH {_LEVELED} SELECT event_id, message FROM good WHERE {IN} AND level = 'warn' AND environment = 'prod' AND message ILIKE '%MSG_% d_ne%' ORDER BY created_at DESC, event_id DESC LIMIT 40")
def _(m):
    return Q.search_logs(_logs(m).filter("level is not null"), SPAN, "warn", environment="prod", search="MSG_% d_ne", limit=40).select("event_id", "message")


@query("AGG45_log_stats", f"WITH {_LEVELED} SELECT 'total' AS kind, NULL AS name, count(*) AS count FROM good WHERE {IN} UNION ALL SELECT 'level', level, count(*) FROM good WHERE {IN} GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'release', release, count(*) FROM good WHERE {IN} GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 2)")
def _(m):
    return Q.log_stats(_logs(m).filter("level is not null"), SPAN, 2)


# Clicks.


@query("AGG46_click_heatmap", f"WITH {CLICKS} SELECT round_even(x, 0) AS x, round_even(y, 0) AS y, count(*) AS count, min(selector) AS selector FROM clicks WHERE {IN} AND path = '/p3' GROUP BY 1, 2")
def _(m):
    return Q.click_heatmap(m.clicks, SPAN, "/p3")


@query("AGG47_click_stats", f"WITH {CLICKS} SELECT path, count(*) AS total_clicks, count(DISTINCT visitor_id) AS unique_visitors FROM clicks WHERE {IN} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def _(m):
    return Q.click_stats(m.clicks, SPAN, 6)


@query("AGG48_rage_clicks", f"WITH {CLICKS} SELECT path, selector, visitor_id, session_id, count(*) AS occurrences, {ts('min(created_at)')} AS first_seen, {ts('max(created_at)')} AS last_seen, CASE WHEN count(*) >= 4 THEN 'high' ELSE 'medium' END AS severity FROM clicks WHERE {IN} GROUP BY 1, 2, 3, 4, epoch_us(created_at) // 864000000000 HAVING count(*) >= 2")
def _(m):
    return Q.rage_clicks(m.clicks, SPAN, 10 * 86400, 2)


@query("AGG48_sliding_rage_clicks", f"""WITH {CLICKS}, c AS (SELECT *, lead(created_at) OVER (PARTITION BY path, selector, visitor_id, session_id ORDER BY created_at, event_id) AS later FROM clicks WHERE {IN})
  SELECT event_id FROM c WHERE later - created_at <= INTERVAL 5 DAY""")
def _(m):
    return Q.sliding_rage_clicks(m.clicks, SPAN, 5 * 86400, 2).select("event_id")


_LABELS = """labels AS (SELECT * FROM (VALUES ('l1', 'Any buy', '#buy', '*', 'active'), ('l2', 'Help', '#help', '/p*', 'active'), ('l3', 'Off', '#help', '*', 'paused'), ('l4', 'Go on three', 'button.go', '/p3', 'active'), ('l5', 'None', '#none', '*', 'active')) t(label_id, name, selector, path_pattern, status))"""
_LABEL_HIT = "c.selector = l.selector AND (l.path_pattern = '*' OR c.path = l.path_pattern OR c.path LIKE replace(l.path_pattern, '*', '%'))"


def _labels(m):
    rows = [("l1", "Any buy", "#buy", "*", "active"), ("l2", "Help", "#help", "/p*", "active"), ("l3", "Off", "#help", "*", "paused"),
            ("l4", "Go on three", "button.go", "/p3", "active"), ("l5", "None", "#none", "*", "active")]
    return m.spark.createDataFrame(rows, "label_id string, name string, selector string, path_pattern string, status string")


@query("JON11_label_match", f"WITH {CLICKS}, {_LABELS.replace('labels AS', 'marks AS')} SELECT event_id, label_id FROM clicks c JOIN marks l ON {_LABEL_HIT} WHERE status = 'active'")
def _(m):
    return Q.label_hits(m.clicks, _labels(m)).select("event_id", "label_id")


@query("AGG49_label_stats", f"WITH {CLICKS}, {_LABELS.replace('labels AS', 'marks AS')} SELECT l.label_id, l.name, count(c.event_id) AS count, count(DISTINCT visitor_id) AS unique_visitors, {ts('min(created_at)')} AS first_seen, {ts('max(created_at)')} AS last_seen FROM marks l LEFT JOIN clicks c ON {_LABEL_HIT} AND {IN} WHERE status = 'active' GROUP BY 1, 2")
def _(m):
    return Q.label_stats(m.clicks, _labels(m), SPAN)


# Surveys and guides.


@query("AGG51_survey_stats", f"WITH {RESPONSES} SELECT survey_id, count(*) AS total_responses, count(*) FILTER (WHERE completed) AS completed_responses, {r4('count(*) FILTER (WHERE completed) / count(*) * 100')} AS completion_rate FROM responses GROUP BY 1")
def _(m):
    return B.survey_stats(m.responses)


@query("AGG51_answer_distribution", f"WITH {RESPONSES} SELECT survey_id, 'nps' AS question, CAST(score AS VARCHAR) AS answer, count(*) AS count FROM responses GROUP BY ALL UNION ALL SELECT survey_id, 'comment', comment, count(*) FROM responses GROUP BY ALL")
def _(m):
    return B.answer_distribution(m.responses)


@query("AGG52_nps", f"WITH {RESPONSES} SELECT count(*) AS responses, count(*) FILTER (WHERE score >= 9) AS promoters, count(*) FILTER (WHERE score BETWEEN 7 AND 8) AS passives, count(*) FILTER (WHERE score <= 6) AS detractors, {r4('(count(*) FILTER (WHERE score >= 9) - count(*) FILTER (WHERE score <= 6)) / count(*) * 100')} AS nps FROM responses WHERE completed")
def _(m):
    return B.nps_report(m.responses, "nps")


@query("SCL23_answer_extraction", f"WITH {RESPONSES} SELECT response_id, score FROM responses WHERE survey_id = 's1'")
def _(m):
    return B.nps_scores(m.responses.filter("survey_id = 's1'")).select("response_id", "score")


_WORDS = "string_split_regex(lower(trim(comment)), '[^\\p{L}\\p{N}]+')"
_SCORED = f"""{RESPONSES}, scored AS (SELECT response_id, created_at, trim(comment) AS text, length(list_filter({B.POSITIVE!r}, lambda w: list_contains({_WORDS}, w))) - length(list_filter({B.NEGATIVE!r}, lambda w: list_contains({_WORDS}, w))) AS score
  FROM responses WHERE length(list_filter(string_split_regex(trim(comment), '\\s+'), lambda w: w <> '')) >= 2)"""


@query("AGG53_sentiment", f"WITH {_SCORED} SELECT count(*) AS answers, count(*) FILTER (WHERE score > 0) AS positive, count(*) FILTER (WHERE score = 0) AS neutral, count(*) FILTER (WHERE score < 0) AS negative, {r4('avg(score)')} AS average_score FROM scored")
def _(m):
    return B.sentiment_report(m.responses, "comment")


@query("AGG53_sentiment_examples", f"WITH {_SCORED} SELECT response_id, score FROM scored ORDER BY created_at DESC, response_id DESC LIMIT 10")
def _(m):
    return B.sentiment_examples(m.responses, "comment").select("response_id", "score")


@query("SRC16_survey_append", f"WITH {RESPONSES} SELECT survey_id, count(*) AS n FROM responses WHERE survey_id = 's1' GROUP BY 1")
def _(m):
    surveys = m.responses.select("survey_id").distinct().withColumn("status", F.when(F.col("survey_id") == "s1", "active").otherwise("draft"))
    return B.accepted_responses(m.responses, surveys).groupBy("survey_id").agg(F.count("*").alias("n"))


def _guide_events(m):
    return m.ev.select("event_id", F.concat(F.lit("g"), (F.col("k") % 4).cast("string")).alias("guide_id"), pick(B.GUIDE_EVENTS, F.floor(F.col("k") / 4)).alias("event_type"))


_GUIDE = f"{EV}, ge AS (SELECT event_id, 'g' || (k % 4) AS guide_id, CASE (k // 4) % 5 WHEN 0 THEN 'shown' WHEN 1 THEN 'started' WHEN 2 THEN 'completed' WHEN 3 THEN 'dismissed' ELSE 'converted' END AS event_type FROM ev)"


@query("AGG54_guide_stats", f"""WITH {_GUIDE}, n AS (SELECT guide_id, count(*) FILTER (WHERE event_type = 'shown') AS shown, count(*) FILTER (WHERE event_type = 'started') AS started, count(*) FILTER (WHERE event_type = 'completed') AS completed,
    count(*) FILTER (WHERE event_type = 'dismissed') AS dismissed, count(*) FILTER (WHERE event_type = 'converted') AS converted FROM ge GROUP BY 1)
  SELECT *, {r4('completed / greatest(started, shown, 1) * 100')} AS completion_rate, {r4('dismissed / greatest(started, shown, 1) * 100')} AS dismissal_rate FROM n""")
def _(m):
    return B.guide_stats(_guide_events(m))


@query("SRC44_guide_append", f"WITH {_GUIDE} SELECT guide_id, count(*) AS n FROM ge WHERE guide_id IN ('g0', 'g2') GROUP BY 1")
def _(m):
    guides = _guide_events(m).select("guide_id").distinct().filter(F.col("guide_id").isin("g0", "g2"))
    return B.accepted_guide_events(_guide_events(m), guides).groupBy("guide_id").agg(F.count("*").alias("n"))


# Model usage.


def _evaluations(m):
    return m.generations.filter("turn % 2 = 1").select(
        "generation_id", F.lit(None).cast("string").alias("trace_id"), F.lit(None).cast("string").alias("trace_key"),
        F.when(F.col("conv_id") % 5 != 0, F.col("conv_id") % 3 != 0).alias("passed"),
    )


@query("AGG55_model_usage", f"""WITH {GENERATIONS}, e AS (SELECT CASE WHEN conv_id % 5 <> 0 THEN conv_id % 3 <> 0 END AS passed FROM generations WHERE turn % 2 = 1)
  SELECT count(*) AS total_generations, count(*) FILTER (WHERE status = 'error') AS error_generations, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens, {r4('avg(latency_ms)')} AS avg_latency_ms, {r4('sum(cost)')} AS total_cost,
    (SELECT count(*) FROM e) AS evaluation_count, (SELECT {r4('count(*) FILTER (WHERE passed) / count(passed) * 100')} FROM e) AS evaluation_pass_rate FROM generations""")
def _(m):
    return B.usage_stats(B.with_total_tokens(m.generations), _evaluations(m))


def _traces(m):
    return m.generations.filter("conv_id % 4 <> 0").select(
        "trace_key", F.concat(F.lit("id"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("trace_id"),
        F.col("turn").alias("received_at"), "model",
    )


@query("SRC43_usage_load", f"WITH {GENERATIONS} SELECT trace_key, 'id' || conv_id || '-' || max(turn) AS trace_id, arg_max(model, turn) AS model FROM generations WHERE conv_id % 4 <> 0 GROUP BY trace_key, conv_id")
def _(m):
    return B.latest_traces(_traces(m)).select("trace_key", "trace_id", "model")


@query("JON26_link_resolution", f"""WITH {GENERATIONS}, t AS (SELECT trace_key, 'id' || conv_id || '-' || max(turn) AS trace_id FROM generations WHERE conv_id % 4 <> 0 GROUP BY trace_key, conv_id)
  SELECT g.generation_id, t.trace_id, g.trace_key FROM generations g LEFT JOIN t USING (trace_key) WHERE turn % 2 = 1""")
def _(m):
    generations = B.link_generations(m.generations.withColumn("trace_id", F.lit(None).cast("string")), B.latest_traces(_traces(m)))
    return B.link_evaluations(_evaluations(m), generations).select("generation_id", "trace_id", "trace_key")


@query("INS45_feeds", f"WITH {RESPONSES} SELECT response_id, completed FROM responses WHERE survey_id = 's0' ORDER BY created_at DESC, response_id DESC LIMIT 25 OFFSET 5")
def _(m):
    from clickloom.operators.trends import page

    rows = m.responses.filter("survey_id = 's0'")
    return page(rows, [F.desc("created_at"), F.desc("response_id")], 25, 5).select("response_id", "completed")
