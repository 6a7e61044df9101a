"""Neighbour and running-total operations along keyed timelines.

A key may hold a large part of all rows, so no operation here needs a whole
key in one task. The rows of keys above ``max_rows`` are dealt by ranges of (key,
time, tie), whose bounds are quantiles, and ranges above the limit are dealt
again, so that a burst, or many rows of one instant, is cut like any other
stretch. The part of a key in one range is a slot. Every slot is processed on
its own, one summary row per slot is carried along the key, and the carried
value completes the slot's edge rows. Keys below the limit stay in one slot.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.session import cut_lineage

MAX_ROWS = 1_000_000


@dataclass(frozen=True)
class Previous:
    """Value of the closest earlier row for which ``where`` holds."""

    value: Column
    where: Column | None = None


@dataclass(frozen=True)
class Following:
    """Values of the closest ``n`` later rows for which ``where`` holds.

    One value when ``n`` is 1, otherwise an array of up to ``n``.
    """

    value: Column
    where: Column | None = None
    n: int = 1


@dataclass(frozen=True)
class Running:
    """Sum of ``value`` up to and including the row."""

    value: Column


Step = Previous | Following | Running


class Timeline:
    """A frame whose rows are ordered by ``(ts, tie)`` inside ``keys``."""

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        ts: str,
        tie: Sequence[str],
        max_rows: int = MAX_ROWS,
    ):
        self.keys, self.ts, self.tie, self.max_rows = list(keys), ts, list(tie), max_rows
        counts = df.groupBy(*self.keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > max_rows)
        n_hot = counts.agg(F.sum("_n")).first()[0] or 0
        self.split = n_hot > 0
        self.df = self._with_slots(df, counts.select(*self.keys), n_hot) if self.split else df

    def _with_slots(self, df: DataFrame, hot: DataFrame, n: int) -> DataFrame:
        order = [*self.keys, self.ts, *self.tie]
        rows = df.join(hot, self.keys, "left_semi")
        parts = -(-2 * n // self.max_rows)
        while True:
            dealt = cut_lineage(rows.repartitionByRange(parts, *order).withColumn("_slot", F.spark_partition_id().cast("long")))
            place = F.struct(*order)
            slots = dealt.groupBy(*self.keys, "_slot").agg(F.count("*").alias("_k"), F.min(place).alias("_lo"), F.max(place).alias("_hi"))
            # Rows that are equal in key, time and tie have no order and stay together.
            if slots.filter((F.col("_k") > self.max_rows) & ~F.col("_lo").eqNullSafe(F.col("_hi"))).isEmpty():
                break
            parts *= 2
        cold = df.join(hot, self.keys, "left_anti").withColumn("_slot", F.lit(0).cast("long")).withColumn("_hot", F.lit(False))
        return cold.unionByName(dealt.withColumn("_hot", F.lit(True)))

    def with_columns(self, steps: dict[str, Step]) -> "Timeline":
        """Add one column per step; all steps share one shuffle and one sort."""
        keys = [*self.keys, "_slot"] if self.split else self.keys
        df = self.df
        for name, step in steps.items():
            held = step.value if isinstance(step, Running) else F.struct(step.value.alias("v"))
            where = getattr(step, "where", None)
            df = df.withColumn(f"_in_{name}", held if where is None else F.when(where, held))
        order = [F.col(self.ts), *[F.col(c) for c in self.tie]]
        rows = Window.partitionBy(*keys).orderBy(*order)
        over = (
            "OVER (PARTITION BY "
            + ", ".join(f"`{k}`" for k in keys)
            + " ORDER BY "
            + ", ".join(f"`{c}`" for c in [self.ts, *self.tie])
            + ")"
        )
        local: dict[str, Column] = {}
        for name, step in steps.items():
            source = f"`_in_{name}`"
            if isinstance(step, Running):
                local[name] = F.sum(f"_in_{name}").over(rows.rowsBetween(Window.unboundedPreceding, 0))
            elif isinstance(step, Previous):
                local[name] = F.expr(f"lag({source}, 1) IGNORE NULLS {over}")
            else:
                local[name] = F.array_compact(
                    F.array(*[F.expr(f"lead({source}, {i}) IGNORE NULLS {over}") for i in range(1, step.n + 1)])
                )
            if self.split and isinstance(step, Following) and step.n > 1:
                local[f"_rank_{name}"] = F.count(f"_in_{name}").over(
                    rows.rowsBetween(Window.unboundedPreceding, 0)
                )
        df = df.withColumns(local)
        if self.split:
            df = self._carry(df, steps, order)
        for name, step in steps.items():
            if isinstance(step, Previous):
                df = df.withColumn(name, F.col(name)["v"])
            elif isinstance(step, Following):
                values = F.transform(F.slice(F.col(name), 1, step.n), lambda x: x["v"])
                df = df.withColumn(name, F.get(values, F.lit(0)) if step.n == 1 else values)
        out = Timeline.__new__(Timeline)
        out.__dict__.update(self.__dict__)
        drop = [c for c in df.columns if c.startswith(("_in_", "_rank_", "_carry_"))]
        out.df = df.drop(*drop)
        if self.split:
            out.df = cut_lineage(out.df)
        return out

    def _carry(self, df: DataFrame, steps: dict[str, Step], order: list[Column]) -> DataFrame:
        position = F.struct(*order)
        summaries, carried = [], []
        slots = Window.partitionBy(*self.keys).orderBy("_slot")
        over = "OVER (PARTITION BY " + ", ".join(f"`{k}`" for k in self.keys) + " ORDER BY `_slot`)"
        for name, step in steps.items():
            held = F.col(f"_in_{name}")
            where_position = F.when(held.isNotNull(), position)
            if isinstance(step, Running):
                summaries.append(F.sum(held).alias(f"_sum_{name}"))
                before = slots.rowsBetween(Window.unboundedPreceding, -1)
                carried.append(F.sum(f"_sum_{name}").over(before).alias(f"_carry_{name}"))
            elif isinstance(step, Previous):
                summaries.append(F.max_by(held, where_position).alias(f"_sum_{name}"))
                carried.append(F.expr(f"lag(`_sum_{name}`, 1) IGNORE NULLS {over}").alias(f"_carry_{name}"))
            else:
                if step.n == 1:
                    first = F.min_by(held, where_position)
                    summaries.append(F.when(first.isNotNull(), F.array(first)).alias(f"_sum_{name}"))
                else:
                    # At most n entries per slot are collected.
                    kept = F.when(F.col(f"_rank_{name}") <= step.n, F.struct(position.alias("p"), held.alias("h")))
                    listed = F.transform(F.array_sort(F.collect_list(F.when(held.isNotNull(), kept))), lambda x: x["h"])
                    summaries.append(F.when(F.size(listed) > 0, listed).alias(f"_sum_{name}"))
                later = [F.expr(f"lead(`_sum_{name}`, {i}) IGNORE NULLS {over}") for i in range(1, step.n + 1)]
                carried.append(F.flatten(F.array_compact(F.array(*later))).alias(f"_carry_{name}"))
        summary = df.filter("_hot").groupBy(*self.keys, "_slot").agg(*summaries)
        df = df.join(summary.select(*self.keys, "_slot", *carried), [*self.keys, "_slot"], "left")
        for name, step in steps.items():
            carry = F.col(f"_carry_{name}")
            if isinstance(step, Running):
                full = F.when(
                    F.col(name).isNull() & carry.isNull(), F.lit(None)
                ).otherwise(F.coalesce(F.col(name), F.lit(0)) + F.coalesce(carry, F.lit(0)))
            elif isinstance(step, Previous):
                full = F.coalesce(F.col(name), carry)
            else:
                full = F.when(carry.isNull(), F.col(name)).otherwise(F.concat(F.col(name), carry))
            df = df.withColumn(name, full)
        return df

    def result(self) -> DataFrame:
        return self.df.drop("_slot", "_hot")
