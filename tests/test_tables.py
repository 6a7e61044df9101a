"""Writers and readers on files, and the silence timer."""

import pandas as pd
from pyspark.sql import functions as F

from clickloom.operators import rollups
from clickloom.sources import exports, tables
from clickloom.streaming import jobs


def test_append_and_pruned_read(spark, demo, tmp_path):
    rows = demo.flat_pageviews
    shifted = rows.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 40 DAYS"))
    tables.append(rows, "pageviews", str(tmp_path))
    tables.append(shifted, "pageviews", str(tmp_path))
    assert sorted(p.name for p in (tmp_path / "pageviews").glob("month=*")) == ["month=2024-01", "month=2024-02", "month=2024-03"]
    got = tables.read_table(spark, "pageviews", str(tmp_path), "2024-01-01", "2024-02-01")
    assert got.count() == rows.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_filters_and_columns_reach_the_scan(spark, demo, tmp_path):
    from clickloom.operators.trends import Series, TrendsQuery, run_period
    from clickloom.sources.event_stream import PAGEVIEW, event_stream

    demo.flat_pageviews.write.parquet(str(tmp_path / "pv"))
    pv = spark.read.parquet(str(tmp_path / "pv"))
    stream = event_stream(pv, demo.flat_events, names=[PAGEVIEW])
    daily = run_period(stream, TrendsQuery((Series(PAGEVIEW, "dau"),), "2024-01-05", "2024-01-08"))
    plan = daily._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(created_at" in plan and "LessThan(created_at" in plan
    assert "ReadSchema: struct<visitor_id:string,created_at:timestamp>" in plan
    assert "events.parquet" not in plan


def test_rollup_overwrite_keeps_other_days(spark, demo, tmp_path):
    path = str(tmp_path / "daily")
    first = rollups.daily_events(demo.flat_events)
    rollups.write_days(first, path)
    late = demo.flat_events.filter(F.to_date("created_at") == "2024-01-05")
    doubled = demo.flat_events.unionByName(late)
    rollups.write_days(rollups.reroll(doubled, rollups.touched_days(late), rollups.daily_events), path)
    sums = {str(r.date): r.n for r in spark.read.parquet(path).groupBy("date").agg(F.sum("count").alias("n")).collect()}
    want = {str(r.date): r.n for r in first.groupBy("date").agg(F.sum("count").alias("n")).collect()}
    want["2024-01-05"] *= 2
    assert sums == want


def test_csv_round_trip_and_numbers(spark, tmp_path):
    rows = spark.createDataFrame([(i, f'say "{i}", twice') for i in range(500)], "id int, text string").repartition(1).sortWithinPartitions("id")
    exports.write_csv(rows, str(tmp_path / "out"))
    back = tables.read_csv(spark, str(tmp_path / "out"), "id int, text string")
    back = spark.read.option("escape", '"').csv(str(tmp_path / "out"), header=True, schema="id int, text string")
    assert sorted((r.id, r.text) for r in back.collect()) == sorted((r.id, r.text) for r in rows.collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        split = spark.read.text(str(tmp_path / "out"))
        assert split.rdd.getNumPartitions() > 1
        numbers = tables.numbered(split).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.row_number for r in numbers) == list(range(1, 502))
    by_number = {r.row_number: r.value for r in numbers}
    assert by_number[1] == "id,text" and all(by_number[i + 2].startswith(f"{i},") for i in range(500))


def test_retained_rows(spark):
    rows = spark.createDataFrame([("2024-01-31",), ("2024-02-01",), ("2024-02-20",)], "d string").withColumn("created_at", F.col("d").cast("timestamp"))
    assert tables.retained(rows, "2024-02-15").count() == 2
    assert tables.retained(rows, "2024-02-15", by_month=False).count() == 1
    assert [r.month for r in tables.expired_months(rows, "2024-02-15").collect()] == ["2024-01"]


class _State:
    """Stands in for the state handle of one project."""

    def __init__(self, now, value=None, timed_out=False):
        self.now, self.value, self.hasTimedOut, self.timeout = now, value, timed_out, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentProcessingTimeMs(self):
        return self.now * 1000

    def update(self, value):
        self.value = value

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_silence_timer():
    step = jobs.silence_step(3, 6)
    hour = 3600

    def rows(at):
        return iter([pd.DataFrame({"project_id": ["p"], "created_at": [pd.Timestamp(at, unit="s")]})])

    state = _State(100 * hour)
    assert list(step(("p",), rows(99 * hour), state)) == [] and state.timeout == 2 * hour * 1000
    state = _State(102 * hour, state.value, True)
    out = list(step(("p",), iter([]), state))
    assert out[0].hours_without_traffic[0] == 3 and state.timeout == 6 * hour * 1000
    state = _State(104 * hour, state.value, True)
    assert list(step(("p",), iter([]), state)) == []
    state = _State(108 * hour, state.value, True)
    assert len(list(step(("p",), iter([]), state))) == 1


def test_silence_stream_runs(spark, demo, tmp_path):
    rows = demo.flat_pageviews.select("project_id", "created_at")
    rows.write.parquet(str(tmp_path / "in"))
    stream = jobs.read_files(spark, str(tmp_path / "in"), rows.schema)
    place = str(tmp_path / "out")
    query = jobs.silences(stream).writeStream.format("parquet").option("checkpointLocation", f"{place}/checkpoint").start(f"{place}/table")
    # Timers keep this job running for good; it is stopped once alerts are there.
    for _ in range(30):
        query.awaitTermination(1)
        if query.lastProgress and query.lastProgress["sink"]["numOutputRows"] != 0 and list((tmp_path / "out" / "table").glob("*.parquet")):
            break
    query.stop()
    out = spark.read.parquet(f"{place}/table").collect()
    # The events are long past, so every project is silent at once.
    assert sorted(r.project_id for r in out) == ["p0", "p1"]


def test_alert_batches_keep_the_cooldown(spark, tmp_path):
    from clickloom.operators.alerts import Rule

    path = str(tmp_path / "alerts")
    handle = jobs.alert_writer(Rule("r", "x", "gte", 2, 60, 120), path)

    def batch(*hours):
        df = spark.createDataFrame([(h, 5) for h in hours], "h int, n long")
        return df.withColumn("window_end", F.timestamp_seconds(F.col("h") * 3600))

    handle(batch(1, 2, 3), 0)
    handle(batch(4, 5), 1)
    handle(batch(4, 5), 1)
    got = sorted({r.triggered_at.timestamp() for r in spark.read.parquet(path).collect()})
    assert [(t / 3600) % 24 for t in got] == [1, 3, 5]
