"""Stable rolls, weighted variants and error fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

U64_MAX = 18446744073709551615.0


def uuid_bytes(uuid: str) -> Column:
    return F.unhex(F.lit(uuid.replace("-", "")))


def _share(digest_hex: Column) -> Column:
    """The first eight bytes of a digest as a share of the 64-bit range."""
    high = F.conv(F.substring(digest_hex, 1, 8), 16, 10).cast("double")
    low = F.conv(F.substring(digest_hex, 9, 8), 16, 10).cast("double")
    return (high * F.lit(4294967296.0) + low) / F.lit(U64_MAX)


def stable_roll(project: str, key: str, visitor: Column, salt: str) -> Column:
    """0 to 100, the same for a visitor on every evaluation."""
    data = F.concat(uuid_bytes(project), F.encode(F.lit(key), "UTF-8"), F.encode(visitor, "UTF-8"), F.encode(F.lit(salt), "UTF-8"))
    return _share(F.sha2(data, 256)) * 100


def in_rollout(project: str, key: str, visitor: Column, percentage: float) -> Column:
    if percentage >= 100:
        return F.lit(True)
    if percentage <= 0:
        return F.lit(False)
    return stable_roll(project, key, visitor, "rollout") < percentage


def by_weight(share: Column, weights: Sequence[tuple[str, float]]) -> Column:
    """The variant whose cumulative weight first exceeds the share of the total."""
    kept = [(name, weight) for name, weight in weights if weight > 0]
    if not kept:
        return F.lit(None).cast("string")
    roll = share * sum(weight for _, weight in kept)
    upto, out = 0.0, F
    for name, weight in kept:
        upto += weight
        out = out.when(roll < upto, F.lit(name))
    return out


def weighted_variant(project: str, key: str, visitor: Column, weights: Sequence[tuple[str, float]]) -> Column:
    return by_weight(stable_roll(project, key, visitor, "variant") / 100, weights)


def assigned_variant(project: str, experiment: str, visitor: Column, weights: Sequence[tuple[str, float]]) -> Column:
    """Experiment arm of a visitor; ``control`` when nothing else fits."""
    data = F.concat(uuid_bytes(project), uuid_bytes(experiment), F.encode(visitor, "UTF-8"))
    return F.coalesce(by_weight(_share(F.sha2(data, 256)), weights), F.lit("control"))


def error_fingerprint(message: Column, filename: Column, line: Column, stack: Column) -> Column:
    """32 hex digits over message, file, line and first filled stack line."""
    empty = F.lit("")
    top = F.trim(F.regexp_extract(F.coalesce(stack, empty), r"(?m)^[^\S\n]*(\S[^\n]*)$", 1))
    parts = [
        F.trim(F.coalesce(message, empty)),
        F.trim(F.coalesce(filename, empty)),
        F.coalesce(line.cast("string"), empty),
        top,
    ]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)
