"""Surveys, guides and model-usage records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions.stats import percent, ratio
from clickloom.plans.small import broadcast_if_small, with_row

# Words that decide the sentiment of an answer.
POSITIVE = ["love", "great", "excellent", "easy", "fast", "helpful", "useful", "clear", "happy", "awesome", "better", "best"]
NEGATIVE = [
    "hate", "bad", "poor", "slow", "confusing", "broken", "hard", "difficult", "bug", "issue", "frustrating", "worse", "worst",
]


def _field(item: Column, names: list[str]) -> Column:
    """The first of the named fields that the answer has."""
    return F.coalesce(*[F.try_variant_get(item, f"$.{n}", "variant") for n in names])


def _text(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def answer_items(answers: Column) -> Column:
    """The JSON array of answers as variants; anything else is empty."""
    return F.coalesce(F.from_json(answers, "array<variant>"), F.array().cast("array<variant>"))


def about(item: Column, question: str | None) -> Column:
    if question is None:
        return F.lit(True)
    named = [_text(F.try_variant_get(item, f"$.{n}", "variant")) == question for n in ("question_id", "question", "id")]
    return F.coalesce(named[0], F.lit(False)) | F.coalesce(named[1], F.lit(False)) | F.coalesce(named[2], F.lit(False))


def numeric_answer(item: Column) -> Column:
    value = _field(item, ["value", "answer", "score"])
    text = _text(value)
    whole = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))
    number = F.round(F.try_variant_get(value, "$", "double")).cast("long")
    return F.when(text.isNotNull(), whole).when(F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE)"), number)


def text_answer(item: Column) -> Column:
    text = F.trim(_text(_field(item, ["value", "answer", "text"])))
    return F.when(text != "", text)


def _exploded(responses: DataFrame, question: str | None) -> DataFrame:
    items = responses.select("response_id", "created_at", "completed", F.posexplode(answer_items(F.col("answers"))).alias("pos", "item"))
    return items.filter(about(F.col("item"), question))


def nps_scores(responses: DataFrame, question: str | None = None) -> DataFrame:
    """The first numeric answer of each response when it is 0 to 10."""
    numbered = _exploded(responses, question).select("response_id", "completed", "pos", numeric_answer(F.col("item")).alias("score"))
    first = numbered.filter(F.col("score").isNotNull()).groupBy("response_id", "completed").agg(F.min_by("score", "pos").alias("score"))
    return first.filter(F.col("score").between(0, 10))


def nps_report(responses: DataFrame, question: str | None = None) -> DataFrame:
    scores = nps_scores(responses.filter("completed"), question)
    out = scores.agg(
        F.count("*").alias("responses"), F.count_if(F.col("score") >= 9).alias("promoters"),
        F.count_if(F.col("score").between(7, 8)).alias("passives"), F.count_if(F.col("score") <= 6).alias("detractors"),
    )
    return out.withColumn("nps", percent(F.col("promoters") - F.col("detractors"), F.col("responses")))


def sentiment_score(text: Column) -> Column:
    """Distinct positive words minus distinct negative words."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    up = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in POSITIVE])))
    down = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in NEGATIVE])))
    return up - down


def scored_texts(responses: DataFrame, question: str | None = None) -> DataFrame:
    """Text answers of two words and more with their score."""
    texts = _exploded(responses, question).select("response_id", "created_at", "pos", text_answer(F.col("item")).alias("text"))
    long_enough = F.size(F.split(F.trim("text"), r"\s+")) >= 2
    return texts.filter(F.col("text").isNotNull() & long_enough).withColumn("score", sentiment_score(F.col("text")))


def sentiment_report(responses: DataFrame, question: str | None = None) -> DataFrame:
    out = scored_texts(responses, question).agg(
        F.count("*").alias("answers"), F.count_if(F.col("score") > 0).alias("positive"),
        F.count_if(F.col("score") == 0).alias("neutral"), F.count_if(F.col("score") < 0).alias("negative"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_score"),
    )
    return out


def sentiment_examples(responses: DataFrame, question: str | None = None, limit: int = 10) -> DataFrame:
    return scored_texts(responses, question).orderBy(F.desc("created_at"), F.desc("response_id"), "pos").limit(limit)


def survey_stats(responses: DataFrame) -> DataFrame:
    out = responses.groupBy("survey_id").agg(F.count("*").alias("total_responses"), F.count_if("completed").alias("completed_responses"))
    return out.withColumn("completion_rate", percent(F.col("completed_responses"), F.col("total_responses")))


def answer_distribution(responses: DataFrame) -> DataFrame:
    """``question, answer, count`` over all answers."""
    items = responses.select("survey_id", F.explode(answer_items(F.col("answers"))).alias("item"))
    question = F.coalesce(_text(F.try_variant_get("item", "$.question", "variant")), F.lit("unknown"))
    raw = F.try_variant_get("item", "$.answer", "variant")
    answer = F.coalesce(_text(raw), F.when(raw.isNotNull(), F.to_json(raw)), F.lit("no_answer"))
    return items.groupBy("survey_id", question.alias("question"), answer.alias("answer")).agg(F.count("*").alias("count"))


def accepted_responses(responses: DataFrame, surveys: DataFrame) -> DataFrame:
    """Responses whose survey is active."""
    active = surveys.filter(F.col("status") == "active").select("survey_id")
    return responses.join(broadcast_if_small(active), "survey_id", "left_semi")


# Guides.

GUIDE_EVENTS = ["shown", "started", "completed", "dismissed", "converted"]


def accepted_guide_events(events: DataFrame, guides: DataFrame) -> DataFrame:
    return events.join(broadcast_if_small(guides.select("guide_id")), "guide_id", "left_semi")


def guide_stats(events: DataFrame) -> DataFrame:
    out = events.groupBy("guide_id").agg(*[F.count_if(F.col("event_type") == e).alias(e) for e in GUIDE_EVENTS])
    base = F.greatest("started", "shown", F.lit(1))
    return out.withColumn("completion_rate", percent(F.col("completed"), base)).withColumn(
        "dismissal_rate", percent(F.col("dismissed"), base)
    )


# Model usage: traces, generations and evaluations.


def latest_traces(traces: DataFrame) -> DataFrame:
    """One row per trace key; the row received last wins."""
    rest = [c for c in traces.columns if c != "trace_key"]
    picked = traces.groupBy("trace_key").agg(F.max_by(F.struct(*rest), F.struct("received_at", "trace_id")).alias("t"))
    return picked.select("trace_key", "t.*")


def with_total_tokens(generations: DataFrame) -> DataFrame:
    total = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    given = F.col("total_tokens") if "total_tokens" in generations.columns else F.lit(None)
    return generations.withColumn("total_tokens", F.coalesce(given, total).cast("long"))


def link_generations(generations: DataFrame, traces: DataFrame) -> DataFrame:
    """Fill the trace id of each generation by id, else by key; ``linked`` tells the outcome."""
    by_key = traces.select(F.col("trace_key"), F.col("trace_id").alias("_by_key"))
    by_id = traces.select(F.col("trace_id").alias("_by_id"))
    out = generations.join(by_key, "trace_key", "left").join(by_id, F.col("trace_id") == F.col("_by_id"), "left")
    out = out.withColumn("trace_id", F.coalesce("_by_id", "_by_key")).drop("_by_key", "_by_id")
    return out.withColumn("linked", F.col("trace_id").isNotNull())


def link_evaluations(evaluations: DataFrame, generations: DataFrame) -> DataFrame:
    """Evaluations take trace id and key from their generation when they have none."""
    side = generations.select("generation_id", F.col("trace_id").alias("_id"), F.col("trace_key").alias("_key"))
    out = evaluations.join(side, "generation_id", "left")
    return out.withColumn("trace_id", F.coalesce("trace_id", "_id")).withColumn("trace_key", F.coalesce("trace_key", "_key")).drop("_id", "_key")


def usage_stats(generations: DataFrame, evaluations: DataFrame) -> DataFrame:
    use = generations.agg(
        F.count("*").alias("total_generations"), F.count_if(F.col("status") == "error").alias("error_generations"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
    )
    # Evaluations without a verdict do not count into the rate.
    checks = evaluations.agg(
        F.count("*").alias("evaluation_count"),
        (ratio(F.count_if("passed"), F.count("passed")) * 100).alias("evaluation_pass_rate"),
    )
    return with_row(use, checks)
