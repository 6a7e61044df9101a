"""Known funnel cases, and a naive matcher on random histories with and without splitting."""

import itertools
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from clickloom.functions.props import PropertyFilter as P
from clickloom.operators import funnels as N
from clickloom.operators.funnels import Exclusion, FunnelQuery, Step
from clickloom.sources.event_stream import event_stream

DAY = 86400
START = "2024-01-01"


def _stream(spark, histories, props="map()"):
    rows = [(h * 1000 + i, str(h), int(sec), e, path) for h, events in enumerate(histories) for i, (sec, e, path) in enumerate(events)]
    df = spark.createDataFrame(rows, "event_id long, visitor_id string, sec long, event string, path string")
    at = F.timestamp_seconds(F.unix_seconds(F.lit(START).cast("timestamp")) + F.col("sec"))
    return df.select(
        "event_id", "visitor_id", "event", at.alias("created_at"), F.lit("s").alias("session_id"), F.create_map(F.lit("path"), F.col("path")).alias("properties")
    )


def _spec(n, **kw):
    kw.setdefault("window", 14)
    return FunnelQuery(tuple(Step(f"s{i}") for i in range(n)), START, kw.pop("date_to", "2024-03-01"), **kw)


def _reached(spark, spec, *histories, max_rows=1_000_000):
    events = [[(d * DAY, e, "/") for d, e in h] for h in histories]
    found = {r.actor: r.reached for r in N.outcomes(_stream(spark, events), spec, max_rows).collect()}
    return [found.get(str(i), 0) for i in range(len(histories))]


def test_known_cases(spark):
    three, two = _spec(3), _spec(2)
    assert _reached(
        spark, three,
        [(0, "s0"), (1, "other"), (2, "s1"), (3, "s2")], [(0, "s1"), (1, "s0")], [(0, "s0"), (1, "s1"), (20, "s2")],
        [(0, "s0"), (15, "s0"), (16, "s1"), (17, "s2")],
    ) == [3, 1, 2, 3]
    limited = replace(two, date_to="2024-01-06")
    assert _reached(spark, limited, [(0, "s0"), (10, "s0"), (11, "s1"), (30, "s1")], [(10, "s0"), (11, "s1"), (30, "s1")]) == [2, 0]
    strict = replace(two, order="strict")
    assert _reached(spark, strict, [(0, "s0"), (1, "other"), (2, "s1")], [(0, "s0"), (2, "s1")]) == [1, 2]
    free = replace(three, order="unordered")
    assert _reached(spark, free, [(0, "s2"), (1, "s0")], [(0, "s2"), (20, "s0")]) == [2, 1]
    barred = replace(two, exclusions=(Exclusion("x", from_step=0, to_step=1),))
    assert _reached(spark, barred, [(0, "s0"), (1, "x"), (2, "s1")], [(0, "s0"), (1, "s1"), (2, "x")]) == [0, 2]


def test_overlapping_unordered_steps_use_distinct_events(spark):
    steps = (Step("a"), Step("a", (P("path", "exact", "/n"),)))
    spec = FunnelQuery(steps, START, "2024-03-01", "unordered")
    histories = [[(0, "a", "/n"), (10, "a", "/w")], [(0, "a", "/n")], [(0, "a", "/w"), (5, "a", "/w")]]
    for max_rows in (1_000_000, 1):
        found = {r.actor: r.reached for r in N.outcomes(_stream(spark, histories), spec, max_rows).collect()}
        assert found == {"0": 2, "1": 1, "2": 1}


def _naive(events, spec):
    """Every entry is tried on its own; the longest attempt wins, the first on ties."""
    n, window = len(spec.steps), spec.window_seconds
    evs = [e for e in events if spec.order == "strict" or e[1].startswith(("s", "x"))]
    best = []
    for start, (t0, _, _) in enumerate(evs):
        if spec.order == "unordered":
            inside = [(i, e) for i, e in enumerate(evs) if i >= start and e[0] - t0 <= window and e[1].startswith("s")]
            if not evs[start][1].startswith("s"):
                continue
            firsts = {}
            for i, e in inside:
                firsts.setdefault(e[1], i)
            got = sorted(firsts.values())
        else:
            if evs[start][1] != "s0":
                continue
            got = [start]
            while len(got) < n:
                tail = range(got[-1] + 1, len(evs))
                j = next(iter(tail), None) if spec.order == "strict" else next((i for i in tail if evs[i][1] == f"s{len(got)}"), None)
                if j is None or evs[j][1] != f"s{len(got)}" or evs[j][0] - t0 > window:
                    break
                got.append(j)
            barred = False
            for x in spec.exclusions:
                if len(got) > x.from_step:
                    until = evs[got[x.to_step]][0] if len(got) > x.to_step else t0 + window
                    barred |= any(e[1] == x.event and e[0] <= until for e in evs[got[x.from_step] + 1:])
            if barred:
                continue
        if len(got) > len(best):
            best = got
    return [evs[i][0] for i in best]


@pytest.mark.parametrize("order", ["ordered", "strict", "unordered"])
def test_random_histories_match_the_naive_search(spark, order):
    rng = random.Random(11)
    names = ["s0", "s1", "s2", "x", "other"]
    histories = []
    for h in range(25):
        size = 150 if h == 0 else rng.randrange(1, 25)
        times = sorted(rng.randrange(0, 30 * DAY) for _ in range(size))
        histories.append([(t, rng.choice(names), "/") for t in times])
    base = _spec(3, order=order, window=3)
    specs = [base] if order == "unordered" else [base, replace(base, exclusions=(Exclusion("x", from_step=1, to_step=2),))]
    ev = _stream(spark, histories)
    offset = 1704067200
    for spec, max_rows in itertools.product(specs, (1_000_000, 20)):
        got = {r.actor: [round(t) - offset for t in r.times] for r in N.outcomes(ev, spec, max_rows).collect()}
        want = {str(i): _naive(h, spec) for i, h in enumerate(histories)}
        assert got == {k: v for k, v in want.items() if v}
