"""Closures over identifier graphs by iterative joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from clickloom.session import cut_lineage

FEW = 15_000  # edges that one task takes at the end of a component search


def resolve_chains(links: DataFrame, source: str = "from_id", target: str = "to_id") -> DataFrame:
    """The final target of every source; each round doubles the followed length.

    No chain is longer than the number of links, so one that still moves after
    as many rounds as that number has bits runs in a cycle.
    """
    now = cut_lineage(links.select(source, target))
    for _ in range(now.count().bit_length() + 1):
        step = now.select(F.col(source).alias("_mid"), F.col(target).alias("_far"))
        moved = now.join(step, now[target] == step["_mid"], "left")
        after = cut_lineage(
            moved.select(source, F.coalesce("_far", target).alias(target), F.col("_far").isNotNull().alias("_moved"))
        )
        now = after.select(source, target)
        if after.filter("_moved").limit(1).count() == 0:
            return now
    raise ValueError("the links contain a cycle")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``u, to`` of every node that is not the lowest of its component, over all the edges of one task."""
    group: dict = {}

    def root(x):
        group.setdefault(x, x)
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
            a, b = (root((x["h"], x["id"])) for x in (u, v))
            group[max(a, b)] = min(a, b)
    pairs = [(x, root(x)) for x in group if root(x) != x]
    if pairs:
        arrays = [pa.array([{"h": h, "id": i} for h, i in side], kind) for side in zip(*pairs)]
        yield pa.RecordBatch.from_arrays(arrays, names=["u", "to"])


def connected_components(edges: DataFrame, a: str = "source", b: str = "target", few: int = FEW) -> DataFrame:
    """``node, component`` with the smallest node id of each component.

    Edges are contracted. Nodes are ranked by a hash, so that the ids' own order
    makes no long chains; a node below all its neighbours is a root, and a node
    whose lowest neighbour is a root merges into it. Edges are then drawn
    between what is left and made distinct, so they shrink with every round;
    rounds grow with the logarithm of the nodes. Once at most ``few`` edges are
    left, one task finds the components of that rest. The merges of all rounds
    give a node its root.
    """
    ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    given = edges.select(ranked(a).alias("u"), ranked(b).alias("v"))
    given = cut_lineage(given.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = given.select("u").union(given.select("v")).distinct().select(F.col("u").alias("node"), F.col("u").alias("root"))
    rest = given.filter("u < v")
    while rest.limit(few + 1).count() > few:
        both = rest.select("u", "v").union(rest.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("low"))
        above = lowest.select(F.col("u").alias("low"), F.col("low").alias("next"))
        merges = cut_lineage(lowest.join(above, "low").filter("low < u and low < next").select("u", F.col("low").alias("to")))
        ends = rest.join(merges, "u", "left").select(F.coalesce("to", "u").alias("p"), F.col("v").alias("u"))
        ends = ends.join(merges, "u", "left").select("p", F.coalesce("to", "u").alias("q"))
        labels = labels.join(merges.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        rest = cut_lineage(ends.filter("p != q").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct())
    kind = rest.schema["u"].dataType
    merges = cut_lineage(rest.coalesce(1).mapInArrow(_forest, StructType([StructField("u", kind), StructField("to", kind)])))
    labels = labels.join(merges.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    least = labels.groupBy("root").agg(F.min("node.id").alias("component"))
    return labels.join(least, "root").select(F.col("node.id").alias("node"), "component")
