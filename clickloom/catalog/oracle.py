"""Shared common table expressions of the SQL counterparts."""

EV = """ev AS (
  SELECT event_id, CASE WHEN event_type = 'view' THEN '$pageview' ELSE event_type END AS event,
    CAST(user_id AS VARCHAR) AS visitor_id, user_id AS uid, 'p' || (user_id % 2) AS project_id,
    ts AS created_at, kk AS k, '/p' || (kk % 10) AS path, value,
    CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(12,2)) END AS revenue_amount,
    CASE kk % 4 WHEN 0 THEN 'google' WHEN 1 THEN 'newsletter' WHEN 2 THEN 'facebook' END AS utm_source,
    CASE kk % 4 WHEN 0 THEN 'cpc' WHEN 1 THEN 'email' WHEN 2 THEN 'social' END AS utm_medium,
    CASE WHEN kk % 4 < 3 THEN 'c' || (kk % 3) END AS utm_campaign,
    CASE kk % 5 WHEN 0 THEN 'https://www.google.com/search' WHEN 1 THEN 'https://chatgpt.com/'
      WHEN 2 THEN 'https://t.co/ab' WHEN 3 THEN 'https://news.example.org/x' END AS referrer,
    CASE kk % 5 WHEN 0 THEN 'www.google.com' WHEN 1 THEN 'chatgpt.com'
      WHEN 2 THEN 't.co' WHEN 3 THEN 'news.example.org' END AS referrer_domain,
    CASE WHEN event_type = 'purchase' THEN CASE kk % 2 WHEN 0 THEN 'USD' ELSE 'EUR' END END AS revenue_currency,
    CASE kk % 3 WHEN 1 THEN 'Home' WHEN 2 THEN 'Docs' END AS title, kk * 137 AS duration_ms
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS kk FROM events))"""

EVS = EV + """, evg AS (
  SELECT *, CASE WHEN lag(created_at) OVER w IS NULL OR created_at - lag(created_at) OVER w > INTERVAL 24 HOUR
    THEN 1 ELSE 0 END AS brk
  FROM ev WINDOW w AS (PARTITION BY visitor_id ORDER BY created_at, event_id)
), evs AS (
  SELECT * EXCLUDE (brk), visitor_id || '-' || CAST(sum(brk) OVER (PARTITION BY visitor_id
    ORDER BY created_at, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id FROM evg
), pv AS (SELECT * FROM evs WHERE event = '$pageview'),
ce AS (SELECT *, event AS event_name FROM evs WHERE event <> '$pageview')"""

SESS = EVS + """, sess0 AS (
  SELECT session_id, min(visitor_id) AS visitor_id, min(uid) AS uid, min(project_id) AS project_id,
    min(created_at) AS first_at, max(created_at) AS last_at,
    count(*) FILTER (WHERE event = '$pageview') AS pageview_count,
    count(*) FILTER (WHERE event <> '$pageview') AS event_count,
    arg_min(path, (created_at, event_id)) FILTER (WHERE event = '$pageview') AS entry_page,
    arg_max(path, (created_at, event_id)) FILTER (WHERE event = '$pageview') AS exit_page,
    count(*) FILTER (WHERE event = '$pageview') <= 1 AS is_bounce,
    CAST(floor((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1000) AS BIGINT) AS duration_ms
  FROM evs GROUP BY session_id
), sessions AS (
  SELECT s.*, CASE uid % 3 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Firefox' ELSE 'Safari' END AS browser,
    CASE uid % 4 WHEN 0 THEN 'Windows' WHEN 1 THEN 'macOS' WHEN 2 THEN 'Linux' ELSE 'iOS' END AS os,
    CASE uid % 2 WHEN 0 THEN 'desktop' ELSE 'mobile' END AS device_type, n_name AS country
  FROM sess0 s LEFT JOIN customer ON uid = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""

PROFILES = """profiles AS (
  SELECT CAST(c_custkey AS VARCHAR) AS visitor_id, c_custkey AS uid, c_name AS user_id, c_mktsegment AS plan,
    CAST(floor(c_acctbal) AS BIGINT) AS balance, c_nationkey,
    CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE strftime(DATE '2023-01-01' + CAST(c_custkey % 300 AS INTEGER), '%Y-%m-%d') END AS since,
    TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * CAST(c_custkey % 28 AS INTEGER) AS first_seen_at
  FROM customer)"""

ERRORS = EVS + """, js_errors AS (
  SELECT event_id, visitor_id, session_id, created_at, path, 'err ' || (k % 7) AS message,
    'https://cdn.example.org/js/f' || (k % 4) || '.js' AS filename, k % 11 AS lineno,
    CASE WHEN k % 5 <> 0 THEN chr(10) || '  at f' || (k % 6) || '()' || chr(10) || ' at main' END AS stack,
    'r' || (k % 3) AS release, CASE (k // 3) % 2 WHEN 0 THEN 'prod' ELSE 'stage' END AS environment,
    CASE uid % 3 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Firefox' ELSE 'Safari' END AS browser
  FROM evs WHERE event = 'error')"""

CLICKS = EVS + """, clicks AS (
  SELECT event_id, visitor_id, session_id, created_at, path, k, value AS x, CAST(k AS DOUBLE) AS y,
    CASE k % 5 WHEN 0 THEN '#buy' WHEN 1 THEN '.nav a' WHEN 3 THEN 'button.go' WHEN 4 THEN '#help' END AS selector
  FROM evs WHERE event = 'click')"""

VITALS = EVS + """, vitals AS (
  SELECT visitor_id, created_at, path, value AS metric_value,
    CASE k % 6 WHEN 0 THEN 'LCP' WHEN 1 THEN 'CLS' WHEN 2 THEN 'INP' WHEN 3 THEN 'TTFB' WHEN 4 THEN 'FCP' ELSE 'FID' END AS metric_name,
    CASE WHEN value < 20 THEN 'good' WHEN value < 60 THEN 'needs-improvement' ELSE 'poor' END AS rating
  FROM pv)"""

LOGS = EV + """, logs AS (
  SELECT event_id, visitor_id, created_at,
    CASE k % 5 WHEN 0 THEN 'Warning' WHEN 1 THEN 'error' WHEN 2 THEN 'INFO ' WHEN 3 THEN 'debug' ELSE 'notice' END AS raw_level,
    'msg_' || (k % 9) || ' done' AS message, 'r' || (k % 3) AS release,
    CASE k % 2 WHEN 0 THEN 'prod' ELSE 'stage' END AS environment
  FROM ev WHERE event IN ('error', 'signup'))"""

GENERATIONS = """generations AS (
  SELECT conv_id || ':' || turn AS generation_id, 't' || conv_id AS trace_key, conv_id, turn,
    CASE conv_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END AS model,
    length(text) AS input_tokens, length(text) // 4 AS output_tokens, length(text) % 1000 AS latency_ms,
    length(text) / 1000 AS cost, CASE (turn + conv_id) % 4 WHEN 3 THEN 'error' ELSE 'ok' END AS status,
    TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * CAST(conv_id % 700 AS INTEGER) AS created_at
  FROM conversations WHERE role = 'assistant')"""

RESPONSES = """responses AS (
  SELECT conv_id || ':' || turn AS response_id, 's' || (conv_id % 2) AS survey_id, CAST(conv_id % 1000 AS VARCHAR) AS visitor_id,
    TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * CAST(conv_id % 700 AS INTEGER) + INTERVAL 1 MINUTE * CAST(turn AS INTEGER) AS created_at,
    conv_id % 4 <> 0 AS completed, (conv_id + turn) % 11 AS score,
    (CASE conv_id % 4 WHEN 0 THEN 'love the ' WHEN 1 THEN 'slow and confusing ' WHEN 2 THEN '' ELSE 'great ' END)
      || coalesce(text, 'none given') AS comment
  FROM conversations WHERE role = 'user')"""

CONVERSIONS = """conversions AS (
  SELECT session_id, arg_min(visitor_id, (created_at, event_id)) AS visitor_id, min(created_at) AS created_at,
    arg_min(revenue_amount, (created_at, event_id)) AS revenue_amount FROM ce WHERE event = 'purchase' GROUP BY 1)"""

EXPOSURES = """exposures AS (
  SELECT visitor_id, min(created_at) AS first_exposed_at, CASE min(uid) % 2 WHEN 0 THEN 'control' ELSE 'b' END AS variant
  FROM ev WHERE event = 'click' GROUP BY visitor_id)"""


def ts(column: str) -> str:
    """A timestamp as the text that the Spark side prints."""
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S')"


def r4(expression: str) -> str:
    return f"ROUND(CAST({expression} AS DOUBLE), 4)"
