"""Running totals over a corpus in a global order, without one task that sees every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.session import cut_lineage


def running_total(rows: DataFrame, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over this and all earlier rows.

    Rows are dealt by range of ``order``, summed within each part, and shifted by
    the totals of the parts before, of which there is one row each. ``order``
    should tell rows apart; equal rows may swap their totals. The dealt rows are
    written out first, so that a task that runs again sees the same parts.
    """
    dealt = rows.withColumn("__value", value).repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    parts = dealt.groupBy("__part").agg(F.sum("__value").alias("__sum"))
    before = parts.select(F.col("__part").alias("__at"), (F.sum("__sum").over(Window.orderBy("__part")) - F.col("__sum")).alias("__before"))
    within = F.sum("__value").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    summed = dealt.withColumn("__within", within).join(before, F.col("__part") == F.col("__at"))
    return summed.select(*rows.columns, (F.col("__before") + F.col("__within")).alias(name))
