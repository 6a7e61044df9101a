import random

import pytest

from clickloom.plans.graph import connected_components


def reached(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for node in sorted(near):
        todo = [node]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = node
                todo += near[x]
    return sorted(out.items())


@pytest.mark.parametrize("few", [0, 40, 15_000])
def test_components_of_chains_stars_and_random_graphs(spark, few):
    """By contraction to the end, with a rest for one task, and all in one task."""
    rng = random.Random(6)
    chain = [(f"c{i:04}", f"c{i + 1:04}") for i in range(300)]
    star = [("m-hub", f"s{i:03}") for i in range(200)]
    grid = [(f"g{rng.randrange(90)}", f"g{rng.randrange(90)}") for _ in range(70)]
    edges = chain + star + grid + [("alone", "alone"), ("b", "a"), ("a", "b"), ("a", "b")]
    got = connected_components(spark.createDataFrame(edges, "source string, target string").repartition(3), few=few)
    assert sorted(map(tuple, got.collect())) == reached(edges)
    numbers = [(i, i + 1 if i % 7 else i) for i in range(100)]
    got = connected_components(spark.createDataFrame(numbers, "x int, y int"), "x", "y", few)
    assert sorted(map(tuple, got.collect())) == reached(numbers)
    assert connected_components(spark.createDataFrame([], "source string, target string"), few=few).collect() == []
