import math
import random

import numpy as np
import pytest
from cases import order

from pyspark.sql import functions as F

from clickloom.llm.heaps import Heaps, best
from clickloom.llm.negatives import mine, strassen
from clickloom.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("leaf", [1, 2, 5, 64])
def test_strassen_is_exact(leaf):
    rng = np.random.default_rng(4)
    for m, k, n in [(1, 1, 1), (7, 5, 3), (16, 16, 16), (33, 18, 41), (2, 64, 9), (0, 4, 3)]:
        a, b = (rng.integers(-(2**62), 2**62, s) for s in ((m, k), (k, n)))
        assert (strassen(a, b, leaf) == a @ b).all()


def test_heaps_merge_in_any_order():
    rng = random.Random(1)
    scores, ids = [rng.randint(0, 9) for _ in range(200)], rng.sample(range(1000), 200)
    want = sorted(zip(scores, ids), key=lambda x: (-x[0], x[1]))[:5]
    for size in (1, 3, 50, 200):
        heaps = Heaps(5)
        for lo in range(0, 200, size):
            heaps.add((1, None), np.array(scores[lo : lo + size]), np.array(ids[lo : lo + size]))
        assert [(int(s), int(i)) for s, i in zip(*heaps.held[1, None])] == want
    assert len(best(np.zeros(0, np.int64), np.zeros(0, np.int64), 5)) == 0


def brute(rows, anchor, k=5, low=80, high=100, scale=256):
    """Results by anchor row, over Python integers."""
    usable = [(i, tuple(math.floor(scale * x) for x in v), label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, v, label in (r for r in usable if anchor(r[0])):
        scored = sorted(((sum(x * y for x, y in zip(v, w)), i, other) for i, w, other in usable), key=lambda r: (-r[0], r[1]))
        positives = [(s, i) for s, i, other in scored if other == label and i != a][:k]
        for p, (ps, i) in enumerate(positives, 1):
            fits = [(s, j) for s, j, other in scored if other != label and low * ps <= 100 * s <= high * ps][:k]
            out += [(a, i, p, r, j, ps, s) for r, (s, j) in enumerate(fits, 1)]
    return out


@pytest.mark.parametrize("block, tile", [(7, 3), (10_000, 512)])
def test_negatives_against_brute_force(spark, block, tile):
    """Ties, repeated rows, a hot label, labels of one row, short and empty vectors, nulls, and columns with clashing names."""
    rng = random.Random(9)
    vector = lambda: [rng.choice([-0.5, -0.1, 0.0, 0.1, 0.3, 0.31]) for _ in range(5)]
    rows = [(i, vector(), rng.choice([1, 1, 1, 2, 3, i])) for i in range(120)]
    rows += [(200, rows[0][1], 1), (201, rows[0][1], 2), (40, rows[40][1], rows[40][2]), (41, vector(), 1), (41, vector(), 2)]
    rows += [(300, None, 1), (301, vector(), None), (None, vector(), 1), (302, [0.1, None], 1), (303, [0.1, math.nan], 1), (304, [math.inf], 1), (305, [], 1), (310, [0.3], 2), (320, [], 7)]
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, True) for r in rows], VECTORS + ", block int, parts string, place int, anchor int, a_block boolean").repartition(4)
    got = mine(df, F.col("vec_id") % 10 == 0, block=block, tile=tile)
    assert got.columns == ["anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 100 and order([tuple(r) for r in got.collect()]) == order(want)


def test_nothing_to_mine(spark):
    none = spark.createDataFrame([], VECTORS)
    assert mine(none, F.lit(True)).collect() == []
    one = spark.createDataFrame([(1, [0.5], 3), (2, [0.4], 3)], VECTORS)
    assert mine(one, F.col("vec_id") == 1).collect() == []
    assert mine(one, F.col("vec_id") == 5).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = []
    for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect():
        rows.append((r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label))
    got = [tuple(r) for r in QUERIES["op12_hard_negatives"](spark, folder).collect()]
    assert order(got) == order(brute(rows, lambda i: i % 100 == 0)) and got
