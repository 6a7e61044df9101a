"""Text columns shared by the operators, built from SQL functions only.

Words are exploded with the outer generators and filtered afterwards: for the
plain ones the optimizer adds a filter that computes the array a second time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pieces(text: Column, separators: str) -> Column:
    """The text between runs of separators; only the first and last may be empty. Null text is empty text."""
    return F.split(F.coalesce(text, F.lit("")), separators)


def without_blank_ends(parts: Column) -> Column:
    """Drop an empty first and last piece."""
    head = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
    tail = F.when((F.size(parts) > 1) & (F.get(parts, F.size(parts) - 1) == ""), 1).otherwise(0)
    return F.slice(parts, head + F.lit(1), F.size(parts) - head - tail)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
