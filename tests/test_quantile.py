import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.plans import quantile
from clickloom.plans.quantile import percentiles

P = {"p0": 0.0, "p50": 0.5, "p75": 0.75, "p99": 0.99, "p100": 1.0}


@pytest.mark.parametrize("ranges", [1, 3, 1_024])
def test_bracketed_percentiles_are_exact(spark, monkeypatch, ranges):
    monkeypatch.setattr(quantile, "RANGES", ranges)
    rng = random.Random(5)
    groups = {
        "wide": [rng.gauss(0, 1e6) for _ in range(3001)], "ties": [float(rng.randrange(4)) for _ in range(500)],
        "heap": [rng.gauss(5, 1e-3) for _ in range(900)] + [-1e300, 1e300], "one": [7.5], "two": [1.0, 2.0], None: [float(i * i) for i in range(100)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("wide", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for limit, accuracy in ((10_000_000, 10_000), (10, 10_000), (10, 100)):
        got = {r.g: r for r in percentiles(df, ["g"], "v", P, limit, accuracy).collect()}
        assert set(got) == set(groups)
        for g, vs in groups.items():
            for name, p in P.items():
                assert abs(got[g][name] - np.percentile(vs, p * 100)) < 1e-6 * max(1.0, abs(got[g][name])), (g, name, limit, accuracy)


def test_without_keys(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    for limit in (10_000, 10):
        assert percentiles(df, [], "v", {"m": 0.5}, limit).collect()[0].m == 500.0
