"""Known small cases of single operators."""

import json

import pytest
from pyspark.sql import functions as F

from clickloom.functions import channels, stats
from clickloom.functions.formula import formula
from clickloom.operators import cohorts, experiments, feedback, governance, marketing, paths, privacy, quality, routing
from clickloom.operators.experiments import Goal
from clickloom.operators.paths import PathsQuery
from clickloom.operators.reports import Span
from clickloom.operators.trends import Breakdown, Series, TrendsQuery, trends
from clickloom.sources import sessions


def one(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


@pytest.mark.parametrize("text,a,b,want", [("A / B * 100", 1, 4, 25), ("(a + b) * -2", 1, 2, -6), ("A - B - 1", 10, 3, 6), ("A/B", 5, 0, 0)])
def test_formula(spark, text, a, b, want):
    assert one(spark, formula(text, [F.lit(float(a)), F.lit(float(b))])) == want


@pytest.mark.parametrize("text", ["C", "A ** 2", "A +", "__import__('os')", "A" * 600, "A.real"])
def test_formula_rejects(spark, text):
    with pytest.raises(ValueError):
        formula(text, [F.lit(1.0), F.lit(2.0)])


def test_proportions(spark):
    def run(*n):
        c = stats.compare_proportions(*[F.lit(x) for x in n])
        return spark.range(1).select(c.lift.alias("lift"), c.p_value.alias("p")).collect()[0]

    better = run(140, 1000, 100, 1000)
    assert better.lift > 39 and better.p < 0.05
    assert run(0, 100, 0, 100).p == 1.0
    assert run(1, 0, 1, 10).p is None


def test_channels(spark):
    def channel(s, m, r):
        lit = [F.lit(x).cast("string") for x in (s, m, r)]
        return one(spark, channels.channel(*lit))

    assert channel("google", "cpc", None) == "Paid Search"
    assert channel(None, None, "chatgpt.com") == "AI Referrals"
    assert channel(None, None, None) == "Direct"
    assert channel("x", "banner", None) == "Display"
    assert channel(None, None, "microsoft.com") == "Organic Social"
    exact = channels.channel(F.lit(None), F.lit(None), F.lit("microsoft.com"), exact_hosts=True)
    assert one(spark, exact) == "Referral"
    assert one(spark, channels.ai_provider(F.lit("perplexity.ai"))) == "Perplexity"
    assert one(spark, channels.ai_provider(F.lit("example.com"))) is None


def test_event_types(spark):
    for text, want in (("Stripe/Checkout Session.Completed", "stripe_checkout_session.completed"), (" !!! ", "webhook_event"), ("x" * 200, "x" * 200)):
        assert one(spark, routing.normalize_event_type(F.lit(text))) == want
    assert one(spark, routing.event_type(F.lit('{"name": "Lead Created"}'))) == "lead_created"
    assert one(spark, routing.event_type(F.lit('{"type": 5, "name": "x"}'))) == "webhook_event"
    assert one(spark, routing.event_type(F.lit("not json"))) == "webhook_event"


def test_payload_transform():
    payload = {"event_type": "a", "payload": {"customer_id": 7, "amount": 3, "secret": 1}, "platform": 2}
    rules = {"include": ["event_type", "payload.customer_id", "payload.amount"], "rename": {"payload.customer_id": "customer.id"}, "set": {"platform": "web"}, "wrap": "data"}
    want = {"data": {"event_type": "a", "payload": {"amount": 3}, "customer": {"id": 7}, "platform": "web"}}
    assert routing.reshape(payload, rules) == want
    assert routing.reshape(payload, {"exclude": ["payload.secret", "none.x"]})["payload"] == {"customer_id": 7, "amount": 3}
    assert payload["payload"]["secret"] == 1


def test_anonymized_addresses(spark):
    cases = {
        "203.0.113.42": "203.0.113.0", "2001:db8:abcd:1234:5678::1": "2001:db8:abcd::", "::1": "::", "0:0:5::1": "0:0:5::", "1::": "1::",
        "256.1.1.1": "256.1.1.1", "1:2:3": "1:2:3", "g::1": "g::1", "::ffff:1.2.3.4": "::", "1:0:0:4::": "1::",
    }
    for ip, want in cases.items():
        assert one(spark, privacy.anonymize_ip(F.lit(ip))) == want, ip


def test_bots_and_consent(spark):
    assert one(spark, privacy.is_bot(F.lit("Googlebot/2.1")))
    assert not one(spark, privacy.is_bot(F.lit("Mozilla/5.0 Safari/605")))
    assert not one(spark, privacy.is_bot(F.lit(" ")))
    strict = privacy.PrivacySettings(consent_required=True, allowed_consent_modes=("analytics",))

    def reason(settings, dnt=False, mode=None, granted=None):
        return one(spark, privacy.skip_reason(settings, F.lit("Safari"), F.lit(dnt), F.lit(mode).cast("string"), F.lit(granted).cast("boolean")))

    assert reason(privacy.PrivacySettings(respect_dnt=True), dnt=True) == "dnt"
    assert reason(strict) == "consent_required"
    assert reason(strict, mode="ads", granted=True) == "consent_mode_not_allowed"
    assert reason(strict, mode="Analytics", granted=True) is None


def test_validation(spark):
    rules = "array<struct<field:string,type:string,required:boolean>>"
    schemas = spark.createDataFrame(
        [("buy", "approved", [("amount", "number", True), ("currency", None, True), ("metadata.coupon", "string", False)])], f"event_name string, status string, rules {rules}"
    )
    docs = ['{"amount": 42.5, "currency": "USD", "metadata": {"coupon": 123}}', '{"amount": 42.5}', None]
    rows = spark.createDataFrame([(i, "buy", d) for i, d in enumerate(docs)], "event_id int, event_name string, event_data string")
    out = {r.event_id: [(v.violation_type, v.property) for v in r.violations] for r in governance.validate_events(rows, schemas).collect()}
    assert out[0] == [("property_type_mismatch", "metadata.coupon")]
    assert out[1] == [("missing_required_property", "currency")]
    assert out[2] == [("missing_required_property", "amount"), ("missing_required_property", "currency")]


def test_survey_answers(spark):
    answers = '[{"question_id": "nps", "value": 9}, {"question_id": "comment", "value": "Great product"}, {"id": "half", "score": 6.5}]'
    rows = spark.createDataFrame([(1, True, answers)], "response_id int, completed boolean, answers string").withColumn("created_at", F.current_timestamp())
    assert [r.score for r in feedback.nps_scores(rows, "nps").collect()] == [9]
    assert feedback.nps_scores(rows, "missing").count() == 0
    assert [r.score for r in feedback.nps_scores(rows, "half").collect()] == [7]
    assert [r.text for r in feedback.scored_texts(rows, "comment").collect()] == ["Great product"]
    for text, sign in (("Love the fast dashboard", 1), ("The flow is confusing and slow", -1), ("It is okay", 0)):
        score = one(spark, feedback.sentiment_score(F.lit(text)))
        assert (score > 0) - (score < 0) == sign


def _paths(spark, rows, q, max_rows=1_000_000):
    df = spark.createDataFrame([("s", "v", i, i, p) for i, p in enumerate(rows)], "session_id string, visitor_id string, sec long, event_id long, item string")
    items = df.withColumn("created_at", F.timestamp_seconds("sec"))
    if q.exclude:
        items = items.filter(~F.col("item").isin(list(q.exclude)))
    found = paths.shape(items, q, max_rows).collect()
    return [e["item"] for e in found[0]["items"]] if found else []


@pytest.mark.parametrize("max_rows", [1_000_000, 2])
def test_path_shaping(spark, max_rows):
    base = PathsQuery("1970-01-01", "1971-01-01")
    assert _paths(spark, ["/", "/", "/x", "/a", "/a", "/b"], PathsQuery("1970-01-01", "1971-01-01", exclude=("/x",)), max_rows) == ["/", "/a", "/b"]
    end = PathsQuery("1970-01-01", "1971-01-01", end_point="/end", step_limit=2)
    assert _paths(spark, ["/1", "/2", "/3", "/4", "/end", "/5"], end, max_rows) == ["/4", "/end"]
    assert _paths(spark, ["/1", "/2"], PathsQuery("1970-01-01", "1971-01-01", start_point="/9"), max_rows) == []
    assert _paths(spark, ["/1", "/2", "/1", "/3"], PathsQuery("1970-01-01", "1971-01-01", start_point="/2", end_point="/3"), max_rows) == ["/2", "/1", "/3"]
    assert _paths(spark, ["/1"], base, max_rows) == ["/1"]


def test_path_cleaning(spark):
    def clean(text, *args):
        return one(spark, paths.clean_item(F.lit(text), *args))

    rules = (("/user/[0-9]+", "/user/:id"),)
    assert clean("/user/42/settings", rules, ()) == "/user/:id/settings"
    assert clean("/product/shoes/1", rules, ("/product/*",)) == "/product/*"
    assert clean("/a.b?/x", (), ("/a.b?/*",)) == "/a.b?/*"
    assert clean("/aXb?/x", (), ("/a.b?/*",)) == "/aXb?/x"
    long = clean("é" * 3000, (("é$", "ée"),), ())
    assert long == "é" * 3000 + "e"


def test_smoothing_and_cumulative(spark):
    rows = spark.createDataFrame([(i, d) for i, d in enumerate([0] * 2 + [1] * 4 + [2] * 6)], "event_id long, day int")
    ev = rows.select(
        "event_id", F.lit("e").alias("event"), F.lit("v").alias("visitor_id"), F.lit("s").alias("session_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).cast("timestamp").alias("created_at"), F.create_map().cast("map<string,string>").alias("properties"),
    )
    q = TrendsQuery((Series("e"),), "2024-01-01", "2024-01-04", smoothing_intervals=2)
    assert [r.value for r in trends(ev, q).orderBy("bucket").collect()] == [2, 3, 5]
    q = TrendsQuery((Series("e"),), "2024-01-01", "2024-01-04", cumulative=True)
    assert [r.value for r in trends(ev, q).orderBy("bucket").collect()] == [2, 6, 12]


@pytest.mark.parametrize("bad", [
    {"series": ()}, {"date_to": "2024-01-01"}, {"series": (Series("e", "sum"),)}, {"series": (Series("e", "unique_group"),)},
    {"interval": "minute", "date_to": "2024-06-01"}, {"breakdown": Breakdown("path", limit=501)}, {"formula": "B"}, {"smoothing_intervals": 0},
])
def test_trends_validation(spark, bad):
    spec = {"series": (Series("e"),), "date_from": "2024-01-01", "date_to": "2024-02-01", **bad}
    with pytest.raises(ValueError):
        TrendsQuery(**spec).validate()


def test_goal_patterns(spark):
    for pattern, path, want in (("/a", "/a", True), ("/a%", "/ab", True), ("%b", "/ab", True), ("/a%z", "/abz", True), ("%x%y%", "/y/x", True), ("", "/a", False), ("%", "/q", True)):
        assert one(spark, experiments.matches_pattern(F.lit(path), pattern)) is want, pattern


def test_csv_ids(spark, tmp_path):
    (tmp_path / "ids.csv").write_text('visitor_id\n v1 \n"v2",x\n\nid\n v3 ')
    got = cohorts.ids_from_csv(cohorts.read_id_lines(spark, str(tmp_path))).collect()
    assert sorted(r.visitor_id for r in got) == ["id", "v1", "v2", "v3"]


def test_cohort_order():
    def ref(name):
        return cohorts.Group("AND", (cohorts.InCohort(name),))

    assert cohorts.evaluation_order({"a": ref("b"), "b": ref("c"), "c": cohorts.Group()}) == ["c", "b", "a"]
    with pytest.raises(ValueError):
        cohorts.evaluation_order({"a": ref("b"), "b": ref("a")})


def test_session_gap_borders(spark):
    rows = spark.createDataFrame([("v", s, i) for i, s in enumerate([0, 1800, 3601, 3602])], "visitor_id string, sec long, event_id long")
    got = sessions.assign_sessions(rows.withColumn("created_at", F.timestamp_seconds("sec")), 1800).orderBy("sec").collect()
    assert [r.session_no for r in got] == [1, 1, 2, 2]


def test_rage_clicks(spark):
    rows = [(i, "/p", "#a", "v", "s", t) for i, t in enumerate([0.0, 1.0, 2.0, 4.9, 5.1, 5.2])]
    clicks = spark.createDataFrame(rows, "event_id long, path string, selector string, visitor_id string, session_id string, t double")
    clicks = clicks.withColumn("created_at", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    span = Span("1970-01-01", "1970-01-02", "1970-01-02")
    assert [(r.occurrences, r.severity) for r in quality.rage_clicks(clicks, span).collect()] == [(4, "medium")]
    for max_rows in (100, 2):
        assert sorted(r.event_id for r in quality.sliding_rage_clicks(clicks, span, max_rows=max_rows).collect()) == [0, 1, 2, 3]


def test_linear_credit_split_equals_whole(spark, demo):
    span = Span("2024-01-01", "2024-01-31", "2024-02-01")

    def run(max_rows):
        rows = marketing.linear_credit(demo.events, demo.pageviews, span, max_rows).filter("conversions > 1e-9").collect()
        return sorted((str(r.touch), round(r.conversions, 6), round(r.revenue, 4)) for r in rows)

    whole = run(1_000_000)
    assert whole and run(5) == whole
    last = [sorted((r.event_id, str(r.touch)) for r in marketing.touch_per_event(demo.events, demo.pageviews, span, "last_touch", n).collect()) for n in (1_000_000, 5)]
    assert last[0] == last[1]


def test_event_goal_compares_json_values(spark):
    rows = spark.createDataFrame([(1, '{"k": 7}'), (2, '{"k": "7"}'), (3, None)], "id int, event_data string").withColumn("event", F.lit("e"))
    goal = Goal("g", "event", "e", {"k": 7})
    assert [r.id for r in rows.filter(experiments.goal_test(goal)).collect()] == [1]
    assert json.dumps(goal.data) == '{"k": 7}'


def test_group_types_and_keys_have_no_limit_by_default(spark):
    from clickloom.operators import identity

    none = spark.createDataFrame([], "group_type string, type_index int")
    seen = spark.createDataFrame([(f"t{i}", i) for i in range(8)], "group_type string, first_seen int")
    mapping = identity.assign_group_types(none, seen)
    assert sorted(map(tuple, mapping.collect())) == [(f"t{i}", i) for i in range(8)]
    rows = spark.createDataFrame([(1, {"t7": "k" * 500, "t1": "a", "t2": ""}, {})], "id int, groups map<string,string>, properties map<string,string>")
    assert identity.stamp_groups(rows, mapping).first()["properties"] == {"$group_7": "k" * 500, "$group_1": "a"}
    five = identity.assign_group_types(none, seen, max_types=5)
    assert sorted(r.group_type for r in identity.refused_group_types(five, seen).collect()) == ["t5", "t6", "t7"]
    refused = identity.refused_groups(rows, mapping, ["id"], max_types=5, max_key=400)
    assert [(r.id, r.group_type, len(r.group_key), r.reason) for r in refused.collect()] == [(1, "t7", 500, "type")]
    refused = identity.refused_groups(rows, mapping, ["id"], max_key=400)
    assert [(r.group_type, r.reason) for r in refused.collect()] == [("t7", "key")]


def test_stored_paths_keep_all_edges():
    from datetime import datetime

    from clickloom.operators.saved import parse

    spec = {"date_from": "2024-01-05", "date_to": "2024-01-25"}
    assert parse("paths", spec, datetime(2024, 2, 1)).edge_limit is None
    assert parse("paths", {**spec, "edge_limit": 7}, datetime(2024, 2, 1)).edge_limit == 7
