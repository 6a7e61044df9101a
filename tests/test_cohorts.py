import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clickloom.operators.cohorts import Behavior, Group, InCohort, People, Person, evaluation_order, members_of, recalculate

NOW = datetime(2024, 1, 31)


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    """Random events, sessions, profiles and stored members as Parquet; some visitors are in one table only."""
    rng = random.Random(12)
    events = [(f"v{rng.randrange(40)}", rng.choice("abc"), NOW - timedelta(hours=rng.randrange(-5, 900)), rng.randrange(10)) for _ in range(900)]
    sessions = [(f"v{i}",) for i in range(0, 35) for _ in range(i % 3 + 1)]
    profiles = [(f"v{i}", rng.choice(["x", "y", None])) for i in range(20, 50)]
    members = [(c, f"v{rng.randrange(60)}") for c in ("vip", "old", "mix") for _ in range(12)]
    folder = tmp_path_factory.mktemp("facts")
    tables = {
        "events": (events, "visitor_id string, event string, created_at timestamp, k int"),
        "sessions": (sessions, "visitor_id string"),
        "profiles": (profiles, "visitor_id string, plan string"),
        "members": (members, "cohort_id string, visitor_id string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}")
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    people = read("profiles").withColumn("traits", F.create_map(F.lit("plan"), "plan"))
    return People(read("events"), read("sessions"), people, read("members")), (events, sessions, profiles, members)


def wanted(c, rows, cohorts):
    """The visitors of a criterion or tree, as a set."""
    events, sessions, profiles, members = rows
    everyone = {v for v, *_ in sessions} | {v for v, _ in profiles}
    if isinstance(c, Group):
        parts = [wanted(v, rows, cohorts) for v in c.values]
        return set() if not parts else set.union(*parts) if c.join == "OR" else set.intersection(*parts)
    if isinstance(c, Person):
        out = {v for v, plan in profiles if plan == c.value}
    elif isinstance(c, InCohort):
        out = wanted(cohorts[c.key], rows, cohorts) if c.key in cohorts else {v for name, v in members if name == c.key}
    else:
        back = lambda n: NOW - timedelta(days=n * {"day": 1, "week": 7}[c.time_interval])
        mine = [(v, t) for v, e, t, _ in events if e == c.key and t < NOW]
        start, recent = back(c.time_value), back(c.seq_time_value or 0)
        late = [(v, t) for v, t in mine if t >= start]
        if c.value == "performed_event":
            out = {v for v, _ in late}
        elif c.value == "performed_event_multiple":
            n = {v: sum(w == v for w, _ in late) for v in everyone | {v for v, _ in late}}
            test = {"gte": int.__ge__, "lte": int.__le__, "exact": int.__eq__}[c.count_operator]
            out = {v for v, k in n.items() if test(k, c.count) and (k or c.count_operator == "lte" or c.count == 0)}
        elif c.value == "performed_event_first_time":
            out = {v for v, _ in mine if min(t for w, t in mine if w == v) >= start}
        elif c.value == "performed_event_regularly":
            near = {(v, t.date()) for v, t in mine if t >= back(c.total_periods)}
            out = {v for v, _ in near if sum(w == v for w, _ in near) >= c.min_periods}
        else:
            now = {v for v, t in mine if t >= recent}
            then = {v for v, t in mine if start <= t < recent}
            out = then - now if c.value == "stopped_performing_event" else (now - then) & {v for v, t in mine if t < start}
    return everyone - out if c.negation else out


CRITERIA = [
    Behavior("performed_event", "a", 3),
    Behavior("performed_event", "b", 1, negation=True),
    Behavior("performed_event_multiple", "a", 1, "week", count=3, count_operator="gte"),
    Behavior("performed_event_multiple", "b", 2, "week", count=2, count_operator="lte"),
    Behavior("performed_event_multiple", "c", 2, count=0, count_operator="exact"),
    Behavior("performed_event_first_time", "c", 25),
    Behavior("performed_event_regularly", "a", 1, min_periods=3, total_periods=9),
    Behavior("stopped_performing_event", "b", 12, seq_time_value=3),
    Behavior("restarted_performing_event", "a", 6, seq_time_value=2),
    Person("plan", "exact", "x"),
    Person("plan", "exact", "y", negation=True),
    InCohort("vip"),
    InCohort("old", negation=True),
]


@pytest.mark.parametrize("join", ["AND", "OR"])
def test_trees_against_sets(facts, join):
    people, rows = facts
    rng = random.Random(3)
    for _ in range(4):
        inner = Group("OR" if join == "AND" else "AND", tuple(rng.sample(CRITERIA, 3)))
        tree = Group(join, (*rng.sample(CRITERIA, 2), inner))
        assert {r.visitor_id for r in members_of(people, tree, str(NOW)).collect()} == wanted(tree, rows, {})


def test_every_criterion_and_nested_cohorts_in_one_pass(facts):
    people, rows = facts
    cohorts = {f"c{i}": Group("AND", (c,)) for i, c in enumerate(CRITERIA)}
    cohorts |= {"top": Group("OR", (InCohort("mid"), InCohort("c2", negation=True))), "mid": Group("AND", (InCohort("c0"), InCohort("old"), InCohort("c3", negation=True))), "none": Group(), "vip": Group("OR", (InCohort("top"), Person("plan", "exact", "x")))}
    cohorts["c11"] = Group("AND", (InCohort("vip"),))
    found = recalculate(people, cohorts, str(NOW))
    got = {}
    for r in found.collect():
        assert r.visitor_id not in got.setdefault(r.cohort_id, set()) or r.cohort_id in ("old", "mix")
        got[r.cohort_id].add(r.visitor_id)
    for name, tree in cohorts.items():
        assert got.get(name, set()) == wanted(tree, rows, cohorts), name
    assert got["mix"] == {v for c, v in rows[3] if c == "mix"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    reads = {name: sum(f"{name}" in line for line in plan.splitlines() if "Relation" in line) for name in ("created_at", "plan")}
    assert reads == {"created_at": 1, "plan": 1} and plan.count("Relation [") == 5  # members once more, for the cohorts that stay
    with pytest.raises(ValueError):
        evaluation_order({"a": Group("AND", (InCohort("b"),)), "b": Group("AND", (InCohort("a"),))})
    with pytest.raises(ValueError):
        members_of(People(people.events, people.sessions, people.profiles), Group("AND", (InCohort("vip"),)), str(NOW))
