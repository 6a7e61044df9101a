"""Time buckets, dense labels and period sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UNITS = ("minute", "hour", "day", "week", "month")
LABEL = "yyyy-MM-dd'T'HH:mm:ss"


def instant(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def local_start(ts: Column, unit: str, tz: str = "UTC") -> Column:
    """Start of the bucket as wall-clock time of the zone; weeks start on Monday."""
    if unit not in UNITS:
        raise ValueError(f"unknown interval {unit!r}")
    return F.date_trunc(unit, F.from_utc_timestamp(ts, tz))


def bucket(ts: Column, unit: str, tz: str = "UTC") -> Column:
    return F.date_format(local_start(ts, unit, tz), LABEL)


def step(unit: str) -> Column:
    return F.expr(f"INTERVAL 1 {unit.upper()}")


def bucket_starts(start, end, unit: str, tz: str = "UTC") -> Column:
    """All bucket starts that touch the half-open range, as an array."""
    last = instant(end) - F.expr("INTERVAL 1 MICROSECOND")
    return F.sequence(local_start(instant(start), unit, tz), local_start(last, unit, tz), step(unit))


def bucket_labels(start, end, unit: str, tz: str = "UTC") -> Column:
    return F.transform(bucket_starts(start, end, unit, tz), lambda t: F.date_format(t, LABEL))


def bucket_index(ts: Column, origin, unit: str, tz: str = "UTC") -> Column:
    """Number of whole buckets between the origin's bucket and the row's."""
    here, zero = local_start(ts, unit, tz), local_start(instant(origin), unit, tz)
    if unit == "month":
        return F.round(F.months_between(here, zero)).cast("int")
    seconds = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit]
    return ((F.unix_seconds(here) - F.unix_seconds(zero)) / seconds).cast("int")


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def with_dense_buckets(df: DataFrame, start, end, unit: str, tz: str = "UTC", name: str = "bucket") -> DataFrame:
    """Repeat every row for each bucket of the range."""
    return df.withColumn(name, F.explode(bucket_labels(start, end, unit, tz)))


def period_starts(start, end, unit: str) -> Column:
    """Dates of week (Monday), month or day periods from the one holding ``start``."""
    first = F.to_date(F.date_trunc(unit, instant(start)))
    return F.sequence(first, F.to_date(instant(end)), step(unit))
