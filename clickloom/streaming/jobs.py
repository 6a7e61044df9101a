"""Structured Streaming jobs over event files.

Every job takes and returns streaming frames, or writes its tables from
``foreachBatch``. Batch counterparts live in the operator modules; on in-order
data both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clickloom.operators import experiments, governance, identity, rollups
from clickloom.operators.alerts import OPERATORS, Rule
from clickloom.operators.privacy import PrivacySettings
from clickloom.plans.small import with_row
from clickloom.session import new_folder
from clickloom.sources import ingest, tables
from clickloom.streaming.stateful import ROCKSDB


def read_files(spark: SparkSession, folder: str, schema: T.StructType | str, file_format: str = "parquet", glob: str | None = None, per_batch: int | None = None) -> DataFrame:
    """A stream of the files in a folder; zone-less times become instants."""
    reader = spark.readStream.format(file_format).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    df = reader.load(folder)
    zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def run_to_table(df: DataFrame, name: str, mode: str = "append", stateful: bool = False) -> DataFrame:
    """Drive a stream over all present files into a table and read that table.

    ``stateful`` starts it with the state store that operators with timers need.
    """
    spark = df.sparkSession
    place = new_folder(spark, name)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    if stateful:
        spark.conf.set(provider, ROCKSDB)
    try:
        query = (
            df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{place}/checkpoint")
            .trigger(availableNow=True).start(f"{place}/table")
        )
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(df.schema).parquet(f"{place}/table")


def run_batches(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Drive a stream over all present files through a batch function."""
    query = df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


# Sessions and presence.


def sessions(ev: DataFrame, gap_seconds: int = 1800, late: str = "0 seconds") -> DataFrame:
    """Closed visits with counts, first and last page, bounce flag and duration."""
    is_view = F.col("event") == "$pageview"
    at = F.struct("created_at", "event_id")
    # The window's end is exclusive; a silence of exactly the gap still continues a visit.
    gap = F.session_window("created_at", f"{gap_seconds} seconds 1 microsecond")
    views = F.count_if(is_view)
    return ev.withWatermark("created_at", late).groupBy(gap.alias("w"), "visitor_id").agg(
        F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
        views.alias("pageview_count"), F.count_if(~is_view).alias("event_count"),
        F.min_by("path", F.when(is_view, at)).alias("entry_page"), F.max_by("path", F.when(is_view, at)).alias("exit_page"),
        (views <= 1).alias("is_bounce"),
        ((F.unix_micros(F.max("created_at")) - F.unix_micros(F.min("created_at"))) / 1000).cast("long").alias("duration_ms"),
    ).drop("w")


def realtime_visitors(ev: DataFrame, span: str = "5 minutes", step: str = "1 minute", late: str = "10 minutes", error: float | None = None) -> DataFrame:
    """Distinct visitors per closed sliding window; state of passed windows expires with the watermark.

    Counts are exact. With ``error`` they come from a sketch of that relative
    error, whose state does not grow with the visitors of a window.
    """
    rows = ev.withWatermark("created_at", late).select("project_id", "visitor_id", F.window("created_at", span, step).alias("w"))
    if error is None:
        counted = rows.filter("visitor_id is not null").dropDuplicates(["project_id", "w", "visitor_id"])
        visitors = F.count("*")
    else:
        counted, visitors = rows, F.approx_count_distinct("visitor_id", error)
    return counted.groupBy("project_id", "w").agg(visitors.alias("visitors")).select("project_id", F.col("w.start").alias("window_start"), "visitors")


# Conversions and exposures.


def goal_conversions(rows: DataFrame, goals: Sequence[experiments.Goal], late: str = "1 day") -> DataFrame:
    """At most one conversion per goal and session while the session may still grow."""
    hits = experiments.goal_hits(rows, goals).withWatermark("created_at", late)
    return hits.dropDuplicatesWithinWatermark(["goal_id", "session_id"])


def first_exposures(rows: DataFrame) -> DataFrame:
    """The first exposure per experiment and visitor, kept for as long as the job runs."""
    return rows.dropDuplicates(["experiment_id", "visitor_id"])


# Alerts.


def window_counts(rows: DataFrame, minutes: int, late: str = "0 seconds", keys: Sequence[str] = ()) -> DataFrame:
    window = F.window("created_at", f"{minutes} minutes")
    return rows.withWatermark("created_at", late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n")).select(
        *keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n"
    )


def fire_rule(windows: DataFrame, rule: Rule, last: DataFrame) -> DataFrame:
    """Fire times of one batch of window ends, given the last fire time (one row, may be NULL)."""
    hot = windows.filter(OPERATORS[rule.operator](F.col("n").cast("double"), F.lit(float(rule.threshold))))
    listed = hot.agg(F.array_sort(F.collect_list(F.unix_seconds("window_end"))).alias("ts"))
    wait, empty = rule.cooldown_minutes * 60, F.array().cast("array<bigint>")
    start = F.when(F.col("last").isNotNull(), F.array(F.unix_seconds("last"))).otherwise(empty)

    def walk(acc, t):
        free = (F.size(acc) == 0) | (t - F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) >= wait)
        return F.when(free, F.concat(acc, F.array(t))).otherwise(acc)

    fired = with_row(listed, last).select(F.slice(F.aggregate("ts", start, walk), F.size(start) + 1, F.size("ts")).alias("f"))
    return fired.select(F.explode("f").alias("t")).select(F.lit(rule.rule_id).alias("rule_id"), F.timestamp_seconds("t").alias("triggered_at"))


def alert_writer(rule: Rule, path: str) -> Callable[[DataFrame, int], None]:
    """Append fire times; the written alerts themselves hold the cooldown state."""
    schema = "rule_id string, triggered_at timestamp, batch bigint"

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], schema).write.mode("append").parquet(path)
        before = spark.read.schema(schema).parquet(path).filter(F.col("batch") < number)
        last = before.agg(F.max("triggered_at").alias("last"))
        fired = fire_rule(batch, rule, last).withColumn("batch", F.lit(number).cast("bigint"))
        # A repeated batch writes the same rows once more; readers take distinct rows.
        fired.write.mode("append").parquet(path)

    return handle


def spikes(pageviews: DataFrame, baselines: DataFrame, ratio: float = 2.0, minutes: int = 10, late: str = "0 seconds") -> DataFrame:
    """Closed windows whose hourly rate is a multiple of the usual rate."""
    counts = window_counts(pageviews, minutes, late, ["project_id"])
    rated = counts.withColumns({"hour": F.hour("window_start"), "weekday": F.weekday("window_start"), "rate": F.col("n") * (60.0 / minutes)})
    joined = rated.join(baselines.filter("avg_pageviews >= 1"), ["project_id", "hour", "weekday"])
    return joined.filter(F.col("rate") / F.col("avg_pageviews") >= ratio).select("project_id", "window_start", "rate", "avg_pageviews")


SILENCE_OUT = "project_id string, alert_at timestamp, hours_without_traffic double"
SILENCE_STATE = "last_seen double, last_alert double"


def latest_per_project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per project and data batch, so that a busy project stays small."""
    for pdf in batches:
        yield pdf.groupby("project_id", as_index=False)["created_at"].max()


def silence_step(hours: float, repeat_hours: float):
    """State function: alert when a project has been silent, again while it stays so."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs() / 1000
        seen, alerted = state.get if state.exists else (0.0, 0.0)
        if not state.hasTimedOut:
            newest = max((pdf["created_at"].max().timestamp() for pdf in rows if len(pdf)), default=seen)
            seen = max(seen, newest)
        silent = now - seen
        fires = silent >= hours * 3600 and now - alerted >= repeat_hours * 3600
        if fires:
            alerted = now
        state.update((seen, alerted))
        wait = repeat_hours * 3600 if silent >= hours * 3600 else hours * 3600 - silent
        state.setTimeoutDuration(max(1000, int(wait * 1000)))
        if fires:
            yield pd.DataFrame({"project_id": [key[0]], "alert_at": [pd.Timestamp(int(now * 1000), unit="ms")], "hours_without_traffic": [silent / 3600]})

    return step


def silences(pageviews: DataFrame, hours: float = 3, repeat_hours: float = 6) -> DataFrame:
    """Projects without a view for some hours, by processing-time timers."""
    newest = pageviews.select("project_id", "created_at").mapInPandas(latest_per_project, "project_id string, created_at timestamp")
    return newest.groupBy("project_id").applyInPandasWithState(
        silence_step(hours, repeat_hours), SILENCE_OUT, SILENCE_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )


# Table writers.


def flush_writer(path: str, settings: PrivacySettings = PrivacySettings()) -> Callable[[DataFrame, int], None]:
    """Route a batch of raw envelopes to the fact tables and keep failures aside.

    The batch number is a folder of its own, so a repeated batch replaces what
    it wrote before.
    """

    def handle(batch: DataFrame, number: int) -> None:
        # Cached for the writes below; a lost block is computed again.
        parsed = ingest.with_outcome(ingest.parse(batch), settings).persist()
        tracked = parsed.filter("outcome = 'tracked'")
        for kind, table in ingest.TARGETS.items():
            if table in tables.TABLES_ON_FILE:
                rows = tables.conform(ingest.route(tracked, kind), table).withColumn("batch", F.lit(number))
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "month").parquet(f"{path}/{table}")
        failed = ingest.quarantine(parsed).withColumn("batch", F.lit(number))
        failed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/quarantine")
        parsed.unpersist()

    return handle


def validation_writer(schemas: DataFrame, mode: str, path: str) -> Callable[[DataFrame, int], None]:
    """Split a batch of events into accepted ones and rows per violation."""

    def handle(batch: DataFrame, number: int) -> None:
        checked = governance.validate_events(batch, schemas, mode).persist()
        for name, rows in (("accepted", checked.filter("accepted").drop("violations", "accepted")), ("violations", governance.violation_rows(checked))):
            rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")
        checked.unpersist()

    return handle


def updates_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Append property updates of people, accounts or groups; the folds read the log."""

    def handle(batch: DataFrame, number: int) -> None:
        parts = identity.property_update(F.col("event_data"))
        rows = batch.filter(F.col("event_data").contains('"$')).withColumns(parts)
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return handle


def reroll_writer(facts: Callable[[], DataFrame], build: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """Rebuild the rollup of every date a batch touches, late rows included."""

    def handle(batch: DataFrame, number: int) -> None:
        rollups.write_days(rollups.reroll(facts(), rollups.touched_days(batch), build), path)

    return handle
