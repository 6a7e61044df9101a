"""Hot keys are cut into slots; results must equal those of one whole timeline."""

import random

from pyspark.sql import functions as F

from clickloom.plans.ordered import Following, Previous, Running, Timeline


def _rows(n=400, seed=3):
    rng = random.Random(seed)
    # Key a holds most rows, some of them at the same instant.
    return [(i, "a" if rng.random() < 0.7 else rng.choice("bcd"), rng.randrange(0, 5000) // 7 * 7, rng.choice("xyz")) for i in range(n)]


def _brute(rows):
    out = {}
    for key in {r[1] for r in rows}:
        line = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        for i, r in enumerate(line):
            later_x = [s[0] for s in line[i + 1:] if s[3] == "x"]
            earlier_y = [s[0] for s in line[:i] if s[3] == "y"]
            out[r[0]] = (
                line[i - 1][0] if i else None,
                line[i + 1][0] if i + 1 < len(line) else None,
                earlier_y[-1] if earlier_y else None,
                later_x[:3],
                sum(s[0] for s in line[: i + 1]),
                sum(s[0] for s in line[: i + 1] if s[3] == "z") if any(s[3] == "z" for s in line[: i + 1]) else None,
            )
    return out


def _spark(spark, rows, max_rows):
    df = spark.createDataFrame(rows, "id long, key string, sec long, kind string").withColumn("ts", F.timestamp_seconds("sec"))
    kind = F.col("kind")
    line = Timeline(df, ["key"], "ts", ["id"], max_rows)
    steps = {
        "before": Previous(F.col("id")), "after": Following(F.col("id")), "y": Previous(F.col("id"), kind == "y"),
        "x": Following(F.col("id"), kind == "x", 3), "total": Running(F.col("id")), "z": Running(F.when(kind == "z", F.col("id"))),
    }
    out = line.with_columns(steps).result()
    assert "_slot" not in out.columns and "_hot" not in out.columns
    return line.split, {r.id: (r.before, r.after, r.y, list(r.x), r.total, r.z) for r in out.collect()}


def test_plain_and_split_equal_brute_force(spark):
    rows = _rows()
    want = _brute(rows)
    for max_rows, split in ((1_000_000, False), (40, True), (7, True)):
        was_split, got = _spark(spark, rows, max_rows)
        assert was_split is split
        assert got == want


def test_null_values_count_as_values(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 2, "b"), (3, 3, None)], "id long, sec long, v string").withColumn("ts", F.timestamp_seconds("sec"))
    for max_rows in (100, 1):
        line = Timeline(df.withColumn("k", F.lit("a")), ["k"], "ts", ["id"], max_rows)
        out = line.with_columns({"p": Previous(F.col("v")), "n": Following(F.col("v"))}).result()
        assert [(r.p, r.n) for r in out.orderBy("id").collect()] == [(None, "b"), (None, None), ("b", None)]


def test_a_burst_and_one_instant_are_cut_by_rank(spark):
    """Nearly all rows of one key lie in one second, many at one instant; no slot is above the limit."""
    rng = random.Random(8)
    seconds = [0, 86_400 * 300] + [86_400 * 100 + rng.randrange(0, 2) for _ in range(600)]
    rows = [(i, "a" if i % 50 else "b", t, rng.choice("xyz")) for i, t in enumerate(seconds)]
    want = _brute(rows)
    split, got = _spark(spark, rows, 40)
    assert split and got == want
    df = spark.createDataFrame(rows, "id long, key string, sec long, kind string").withColumn("ts", F.timestamp_seconds("sec"))
    line = Timeline(df, ["key"], "ts", ["id"], 40)
    sizes = line.df.groupBy("key", "_slot").count().collect()
    assert max(r["count"] for r in sizes) <= 40 and sum(r["count"] for r in sizes) == len(rows)
    same = spark.createDataFrame([(1, "a", 5)] * 30, "id long, key string, sec long").withColumn("ts", F.timestamp_seconds("sec"))
    assert Timeline(same, ["key"], "ts", ["id"], 4).df.count() == 30
    none = spark.createDataFrame([(i, None, i, "x") for i in range(30)], "id long, key string, sec long, kind string").withColumn("ts", F.timestamp_seconds("sec"))
    assert Timeline(none, ["key"], "ts", ["id"], 4).df.count() == 30
