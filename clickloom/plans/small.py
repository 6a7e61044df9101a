"""Size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64_000_000


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row holds."""
    size = F.lit(0)
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(df[name]), F.lit(0))
        elif "<" in kind:
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(df[name]))), F.lit(0))
        size = size + 16
    return size


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the side has at most ``limit`` rows of ``most`` bytes together.

    The check reads at most ``limit + 1`` rows. A larger side is returned
    without a hint, so the join shuffles and adaptive execution splits skew.
    """
    n, size = df.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(_bytes(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= limit and size <= most else df


def with_row(df: DataFrame, *rows: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """Add the columns of one-row aggregates to every row, as scalar subqueries."""
    for row in rows:
        names = [c for c in row.columns if only is None or c in only]
        value = row.select(F.struct(*names).alias("_row")).scalar()
        df = df.withColumn("_row", value).select(*df.columns, *[F.col("_row")[n].alias(n) for n in names])
    return df
