"""Tables in folders: what a lookup, a deletion, the raw floor and sketches read and write."""

import os
import re
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from clickloom.operators import reports as R, rollups as U
from clickloom.operators.reports import Span
from clickloom.sources.people_files import BUCKET, delete_visitors, visitor_rows, write_by_visitor
from clickloom.sources import tables
from clickloom.sources.tables import month_of


def _events(spark):
    return spark.range(4_000).select(F.concat(F.lit("v"), (F.col("id") % 400).cast("string")).alias("visitor_id"), "id").union(spark.sql("select cast(null as string), 9000L"))


def _files(path):
    return {str(f): (os.stat(f).st_mtime_ns, f.stat().st_size) for f in Path(path).rglob("*.parquet")}


def test_a_lookup_reads_one_bucket(spark, tmp_path):
    path = str(tmp_path / "events")
    write_by_visitor(_events(spark), path, 16)
    write_by_visitor(_events(spark).filter("id < 100"), path, 16)
    found = visitor_rows(spark, path, ["v7"], 16)
    assert sorted(r.id for r in found.collect()) == sorted([*range(7, 4_000, 400), 7])
    assert len(found.inputFiles()) == len(_files(path))  # all that are there, before pruning
    found.collect()
    read = [m for m in re.findall(r"PartitionFilters: \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\]", found._jdf.queryExecution().executedPlan().toString(), re.S)]
    assert read and BUCKET in read[0][0] and "visitor_id" in read[0][1]
    one = next(f for f in _files(path) if f"{BUCKET}=" in f)
    column = pq.ParquetFile(one).metadata.row_group(0)
    assert column.num_rows < 400
    assert b"v" in Path(one).read_bytes()
    assert visitor_rows(spark, path, ["nobody"], 16).count() == 0


def test_a_deletion_writes_the_buckets_of_listed_visitors_only(spark, tmp_path):
    path = str(tmp_path / "events")
    write_by_visitor(_events(spark), path, 16)
    before = _files(path)
    held = delete_visitors(spark, path, ["v7", "v8", "nobody"], 16)
    after = _files(path)
    touched = {f for f in before if after.get(f) != before[f]}
    assert 1 <= len(held) <= 2 and touched == {f for f in before if any(f"{BUCKET}={b}/" in f for b in held)}
    left = spark.read.parquet(path)
    assert left.filter("visitor_id in ('v7', 'v8')").count() == 0 and left.count() == 4_001 - 20
    assert delete_visitors(spark, path, ["nobody"], 16) == [] and _files(path) == after
    only = str(tmp_path / "one")
    write_by_visitor(_events(spark).filter("visitor_id = 'v1' or visitor_id is null"), only, 16)
    delete_visitors(spark, only, ["v1"], 16)
    assert [r.visitor_id for r in spark.read.parquet(only).collect()] == [None]


def _views(spark):
    return spark.range(20_000).select(
        F.lit("p").alias("project_id"), (F.col("id") % 7_000).cast("string").alias("visitor_id"),
        (F.lit("2024-01-05 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(F.col("id") * 6).cast("int"))).alias("created_at"),
    )


def test_the_floor_reads_the_oldest_month_only(spark, tmp_path):
    path = str(tmp_path / "views")
    views = _views(spark)
    views.withColumn("month", month_of()).write.partitionBy("month").parquet(path)
    floor = R.raw_floor(spark.read.parquet(path))
    assert floor.first().floor == views.agg(F.min("created_at")).first()[0]
    plan = floor._jdf.queryExecution().executedPlan().toString()
    schemas = sorted(re.findall(r"ReadSchema: (struct<[^\n]*>)", plan))
    assert schemas[0] == "struct<>" and set(schemas) <= {"struct<>", "struct<created_at:timestamp>"}
    assert re.search(r"PartitionFilters: \[[^\]]*month[^\]]*= *(Subquery|ReusedSubquery)", plan)
    span = Span("2024-02-10 00:00:00", "2024-02-20 00:00:00", "2024-03-01")
    raw = span.raw(spark.read.parquet(path))
    assert raw.count() == span.raw(views).count() > 0
    assert "month" in re.findall(r"PartitionFilters: \[([^\]]*)\]", raw._jdf.queryExecution().executedPlan().toString())[0]


def test_sketches_of_days_merge_within_their_bounds(spark):
    views = _views(spark)
    sketches = U.daily_sketches(views)
    for start, end in (("2024-01-05", "2024-03-29"), ("2024-01-10", "2024-01-12"), ("2024-01-05", "2024-01-05")):
        span = Span(f"{start} 00:00:00", f"{end} 00:00:00", "2024-04-01")
        exact = views.filter(F.to_date("created_at").between(start, end)).agg(F.count_distinct("visitor_id")).first()[0]
        found = R.sketched_visitors(sketches, span).first()
        assert found.low <= exact <= found.high and found.high - found.low <= 0.05 * exact + 3
    assert R.sketched_visitors(sketches, Span("2025-01-01", "2025-01-02", "2025-01-03"), "project_id").collect() == []


def test_csv_records_over_splits(spark, tmp_path):
    """Line breaks and doubled quotes inside fields, in files of many splits; bad records are set aside with their number."""
    rows = [(i, f'note {i} "quoted", with\nbreaks\n\nand ""more""' if i % 3 else f"plain {i}") for i in range(400)]
    field = lambda v: '"' + str(v).replace('"', '""') + '"'
    lines = ["id,note"] + [f"{i},{field(t)}" for i, t in rows]
    lines[100] = "99,one,too many"
    lines[200] = "199"
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.csv").write_text("\n".join(lines[:250]) + "\n")
    (tmp_path / "up" / "b.csv").write_text("\n".join(lines[250:]) + '\n400,"never closed\n' + "\n".join(f"x{i}" for i in range(50)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size, limit in (("128m", 10_000), ("700b", 10_000), ("700b", 20)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            good, bad = tables.upload_csv(spark, f"{tmp_path}/up", "u", ["id", "note"], max_lines=limit)
            want = [(n, str(i), t) for n, (i, t) in enumerate(rows, 1) if n not in (100, 200)]
            got = good.select("row_number", F.get_json_object("row_data", "$.id").alias("id"), F.get_json_object("row_data", "$.note").alias("note"))
            assert sorted(map(tuple, got.collect())) == want
            refused = bad.select("row_number", "reason").collect()
            assert {(r.row_number, r.reason) for r in refused} == {(100, "wrong number of fields"), (200, "wrong number of fields"), (401, "open quote" if limit > 50 else "too long")}
            assert len(refused) == (3 if limit > 50 else 53)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.csv").write_text("")
    good, bad = tables.upload_csv(spark, f"{tmp_path}/none", "u", ["id"])
    assert good.collect() == bad.collect() == []
