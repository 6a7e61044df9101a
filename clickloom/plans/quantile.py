"""Exact interpolated percentiles per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.plans.small import broadcast_if_small

MAX_GROUP_ROWS = 1_000_000
ACCURACY = 10_000
RANGES = 1_024  # of a bracket


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    max_group_rows: int = MAX_GROUP_ROWS,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per group with a column for every probability.

    Groups of at most ``max_group_rows`` values use the built-in percentile.
    When a larger group exists, an approximate sketch brackets each wanted
    rank, the values inside the bracket are counted by equal ranges, and only
    those ranges that hold the rank or its neighbour are ranked exactly, each by
    itself. Equal values are one entry with a count.
    """
    keys = list(keys)
    if not keys:
        whole = percentiles(df.withColumn("_all", F.lit(1)), ["_all"], value, probabilities, max_group_rows, accuracy)
        return whole.drop("_all")
    values = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    largest = values.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= max_group_rows:
        return values.groupBy(*keys).agg(
            *[F.percentile("_v", F.lit(p)).alias(name) for name, p in probabilities.items()]
        )
    return _bracketed(values, keys, probabilities, accuracy)


def _bracketed(values: DataFrame, keys: list[str], probabilities: dict[str, float], accuracy: int) -> DataFrame:
    # The sketch ranks a value within n / accuracy, so two such steps on either
    # side enclose the wanted rank and its neighbour. Groups too small for that
    # to span a few ranks are ranked whole.
    margin = 2.0 / accuracy
    small = F.col("_n") <= 4 * accuracy
    names = list(probabilities)
    low = [max(0.0, probabilities[n] - margin) for n in names]
    high = [min(1.0, probabilities[n] + margin) for n in names]

    def points(ps: list[float]) -> Column:
        return F.percentile_approx("_v", ps, accuracy)

    stats = values.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        points(low).alias("_lo"), points(high).alias("_hi"),
    )
    brackets = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.when(small | F.lit(low[i] <= 0), F.col("_min")).otherwise(F.col("_lo")[i]).alias("lo"),
                F.when(small | F.lit(high[i] >= 1), F.col("_max")).otherwise(F.col("_hi")[i]).alias("hi"),
                (F.lit(probabilities[n]) * (F.col("_n") - 1)).alias("rank"),
            )
            for i, n in enumerate(names)
        ]
    )
    stats = stats.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], brackets.alias("_b"))
    match = F.lit(True)
    for j, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{j}"))
    joined = values.join(broadcast_if_small(stats), match)
    # Rows above every bracket add nothing; rows below one only add a count.
    spread = joined.select(*keys, "_v", F.explode("_b").alias("b")).filter(F.col("_v") <= F.col("b.hi"))
    counted = spread.select(
        *keys,
        F.col("b.i").alias("_i"),
        F.col("b.rank").alias("_rank"),
        F.when(F.col("_v") >= F.col("b.lo"), F.col("_v")).alias("_v"),
        # The range of the bracket that a value lies in; -1 for all values below the bracket.
        F.when(F.col("_v") < F.col("b.lo"), -1).when(F.col("b.hi") <= F.col("b.lo"), 0).otherwise(
            F.least(F.lit(RANGES - 1), F.floor((F.col("_v") / 2 - F.col("b.lo") / 2) / (F.col("b.hi") / 2 - F.col("b.lo") / 2) * RANGES))
        ).cast("int").alias("_r"),
    ).groupBy(*keys, "_i", "_rank", "_v", "_r").agg(F.count("*").alias("_c"))
    ranges = counted.groupBy(*keys, "_i", "_rank", "_r").agg(F.sum("_c").alias("_c"))
    along = Window.partitionBy(*keys, "_i").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)  # at most RANGES + 1 rows
    ranges = ranges.withColumn("_before", F.sum("_c").over(along) - F.col("_c"))
    holds = lambda rank: (F.col("_before") <= rank) & (F.col("_before") + F.col("_c") > rank)
    wanted = ranges.filter((F.col("_r") >= 0) & (holds(F.floor("_rank")) | holds(F.ceil("_rank"))))
    side = wanted.select(*[F.col(k).alias(f"_w{j}") for j, k in enumerate(keys)], F.col("_i").alias("_wi"), F.col("_r").alias("_wr"), "_before")
    here = (F.col("_i") == F.col("_wi")) & (F.col("_r") == F.col("_wr"))
    for j, k in enumerate(keys):
        here = here & F.col(k).eqNullSafe(F.col(f"_w{j}"))
    ordered = Window.partitionBy(*keys, "_i", "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.join(side, here).withColumn("_upto", F.col("_before") + F.sum("_c").over(ordered))
    picked = ranked.groupBy(*keys, "_i").agg(
        F.max("_rank").alias("_rank"),
        F.min(F.when(F.col("_upto") > F.floor("_rank"), F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_upto") > F.ceil("_rank"), F.col("_v"))).alias("_z"),
    )
    share = F.col("_rank") - F.floor("_rank")
    exact = F.col("_a") * (1 - share) + F.col("_z") * share
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_i") == i, exact)).alias(n) for i, n in enumerate(names)]
    )
