"""Timers and state over several micro-batches, against plain folds."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from clickloom.streaming import jobs as J
from clickloom.streaming.stateful import presence, spaced


def _stream(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "name string, t long").select("name", F.timestamp_seconds("t").alias("created_at"), F.lit(1).alias("at"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{i:03}")
    return J.read_files(spark, f"{tmp_path}/in/*", "name string, created_at timestamp, at int", per_batch=1)


def _batches(seed):
    """Ordered times of a few keys in five batches; one key is silent for long, one comes once."""
    rng = random.Random(seed)
    rows = sorted(((rng.choice("abc"), rng.randrange(0, 5_000)) for _ in range(80)), key=lambda r: r[1])
    rows += [("late", 6_000), ("a", 9_000), ("b", 9_100), ("z", 20_000)]
    return [rows[i : i + 17] for i in range(0, len(rows), 17)]


def _by_key(batches):
    out = defaultdict(list)
    for rows in batches:
        for k, t in rows:
            out[k].append(t)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("wait", [0, 700])
def test_spaced_rows(spark, tmp_path, wait):
    batches = _batches(1)
    want = set()
    for k, times in _by_key(batches).items():
        last = None
        for t in times:
            if last is None or t >= last + wait:
                want.add((k, t))
                last = t
    got = J.run_to_table(spaced(_stream(spark, tmp_path, batches), ["name"], wait), "spaced", stateful=True)
    assert {(r.name, int(r.t)) for r in got.select("name", F.unix_seconds("created_at").alias("t")).collect()} == want


def test_presence_ends_by_timer(spark, tmp_path):
    batches = _batches(2)
    end, want = max(t for rows in batches for _, t in rows), []
    for k, times in _by_key(batches).items():
        last = None
        for t in times:
            if last is None or t > last + 600:
                want += ([] if last is None else [(k, "offline", last + 600)]) + [(k, "online", t)]
            last = t
        if last + 600 <= end:
            want.append((k, "offline", last + 600))
    got = J.run_to_table(presence(_stream(spark, tmp_path, batches), ["name"]), "presence", stateful=True)
    assert sorted((r.name, r.state, int(r.t)) for r in got.select("name", "state", F.unix_seconds("created_at").alias("t")).collect()) == sorted(want)
    assert "HDFSBacked" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
