"""Shares, changes, the two-proportion test and histogram bins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

EPSILON = 2.220446049250313e-16

# Coefficients of the published error-function polynomial 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 when b is 0 or missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def percent(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double") * 100).otherwise(F.lit(0.0))


def percent_change(now: Column, before: Column) -> Column:
    return (
        F.when(before > 0, (now - before).cast("double") / before.cast("double") * 100)
        .when(now > 0, F.lit(100.0))
        .otherwise(F.lit(0.0))
    )


def erf(x: Column) -> Column:
    size = F.abs(x)
    t = F.lit(1.0) / (1 + ERF_P * size)
    series = F.lit(0.0)
    for a in reversed(ERF_A):
        series = (series + a) * t
    return F.when(x < 0, -1.0).otherwise(1.0) * (1 - series * F.exp(-size * size))


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / F.sqrt(F.lit(2.0))))


@dataclass(frozen=True)
class Comparison:
    lift: Column
    p_value: Column
    confidence: Column
    significant: Column


def compare_proportions(hits: Column, size: Column, base_hits: Column, base_size: Column) -> Comparison:
    """Two-sided z-test with pooled error; every part is NULL for an empty side."""
    usable = (size > 0) & (base_size > 0)
    rate, base = F.try_divide(hits.cast("double"), size), F.try_divide(base_hits.cast("double"), base_size)
    pooled = F.try_divide((hits + base_hits).cast("double"), size + base_size)
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), size) + F.try_divide(F.lit(1.0), base_size)))
    z = F.when(error > EPSILON, (rate - base) / error).otherwise(0.0)
    p = F.when(error > EPSILON, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * (1 - normal_cdf(F.abs(z)))))).otherwise(1.0)
    lift = F.when(base > 0, (rate - base) / base * 100).otherwise(F.when(rate > 0, 100.0).otherwise(0.0))
    return Comparison(
        F.when(usable, lift), F.when(usable, p), F.when(usable, (1 - p) * 100), F.when(usable, p < 0.05)
    )


def bin_width(largest: Column, bins: int) -> Column:
    return F.when(largest > 0, F.greatest(F.lit(1.0), F.ceil(largest / bins).cast("double"))).otherwise(1.0)


def bin_index(value: Column, width: Column, bins: int) -> Column:
    return F.least(F.floor(value / width), F.lit(bins - 1)).cast("int")
