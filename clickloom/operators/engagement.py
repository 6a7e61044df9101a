"""Stickiness and lifecycle of actors over time buckets."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window, functions as F

from clickloom.functions import calendar
from clickloom.functions.stats import ratio
from clickloom.operators import trends as T
from clickloom.operators.trends import TrendsQuery

STATUSES = ("new", "returning", "resurrecting", "dormant")


def active_intervals(ev: DataFrame, q: TrendsQuery) -> DataFrame:
    """``series_index, actor, intervals``: distinct active buckets per actor."""
    by_actor = replace(q, series=tuple(replace(s, math="dau") for s in q.series), breakdown=None)
    found = T.hits(ev, by_actor)
    return found.groupBy("series_index", F.col("counted").alias("actor")).agg(
        F.count_distinct("bucket").alias("intervals")
    )


def stickiness(ev: DataFrame, q: TrendsQuery) -> DataFrame:
    """Actors by number of active intervals; cumulative means at least that many."""
    q.validate()
    windows = [("current" if q.compare else None, q)]
    if q.compare:
        windows.append(("previous", q.previous()))
    out = None
    for label, w in windows:
        counts = active_intervals(ev, w).groupBy("series_index", "intervals").agg(F.count("*").alias("actors"))
        n = F.size(calendar.bucket_starts(w.date_from, w.date_to, w.interval, w.timezone))
        indexes = F.explode(F.array(*[F.lit(i) for i in range(len(w.series))]))
        dense = ev.sparkSession.range(1).select(indexes.alias("series_index")).withColumn(
            "intervals", F.explode(F.sequence(F.lit(1).cast("long"), n.cast("long")))
        )
        full = dense.join(counts, ["series_index", "intervals"], "left").fillna(0, ["actors"])
        if q.cumulative:
            upward = Window.partitionBy("series_index").orderBy(F.desc("intervals"))
            full = full.withColumn("actors", F.sum("actors").over(upward))
        full = full.withColumn("compare_label", F.lit(label).cast("string"))
        out = full if out is None else out.unionByName(full)
    return out


def stickiness_actors(ev: DataFrame, q: TrendsQuery, series: int, intervals: int, limit: int | None = 100) -> DataFrame:
    found = active_intervals(ev, q).filter((F.col("series_index") == series) & (F.col("intervals") == intervals))
    return T.page(found.select("actor"), [F.col("actor")], limit)


def lifecycle_status(ev: DataFrame, q: TrendsQuery) -> DataFrame:
    """``actor, index, status`` for every bucket where the actor counts.

    One pass over all history up to the end; older buckets collapse to one
    row per actor, so an actor has at most one row per bucket of the range.
    """
    q.validate()
    if len(q.series) != 1:
        raise ValueError("lifecycle takes exactly one series")
    rows = T.scoped(ev, replace(q, date_from="1970-01-01")).filter(T.series_predicate(q.series[0]))
    at = F.col("created_at")
    index = calendar.bucket_index(at, q.date_from, q.interval, q.timezone)
    # The part of the first bucket before the range decides "new" only.
    counts_as_active = (at >= calendar.instant(q.date_from)) | (index == -1)
    per = rows.select(
        T.actor(q.aggregation_group_type_index).alias("actor"),
        F.greatest(index, F.lit(-2)).alias("index"),
        (counts_as_active & (index >= -1)).alias("active"),
    ).groupBy("actor", "index").agg(F.bool_or("active").alias("active"))
    whole = Window.partitionBy("actor")
    per = per.withColumn("first", F.min("index").over(whole)).filter("active")
    line = whole.orderBy("index")
    n = F.size(calendar.bucket_starts(q.date_from, q.date_to, q.interval, q.timezone))
    per = per.withColumn("before", F.lag("index").over(line)).withColumn("after", F.lead("index").over(line))
    here = F.when(F.col("first") == F.col("index"), "new").when(F.col("before") == F.col("index") - 1, "returning").otherwise("resurrecting")
    gone = F.coalesce(F.col("after") != F.col("index") + 1, F.lit(True)) & (F.col("index") + 1 < n)
    states = F.array_compact(
        F.array(
            F.when(F.col("index") >= 0, F.struct(F.col("index").alias("index"), here.alias("status"))),
            F.when(gone, F.struct((F.col("index") + 1).alias("index"), F.lit("dormant").alias("status"))),
        )
    )
    return per.select("actor", F.explode(states).alias("s")).select("actor", "s.index", "s.status")


def lifecycle(ev: DataFrame, q: TrendsQuery) -> DataFrame:
    """``status, bucket, value`` without gaps; dormant counts are negative."""
    counts = lifecycle_status(ev, q).groupBy("index", "status").agg(F.count("*").alias("n"))
    labels = calendar.bucket_labels(q.date_from, q.date_to, q.interval, q.timezone)
    statuses = F.explode(F.array(*[F.lit(s) for s in STATUSES]))
    dense = ev.sparkSession.range(1).select(statuses.alias("status")).select("status", F.posexplode(labels).alias("index", "bucket"))
    sign = F.when(F.col("status") == "dormant", -1).otherwise(1)
    return dense.join(counts, ["index", "status"], "left").select(
        "status", "bucket", (F.coalesce("n", F.lit(0)) * sign).alias("value")
    )


def lifecycle_actors(ev: DataFrame, q: TrendsQuery, bucket: str, status: str, limit: int | None = 100) -> DataFrame:
    labels = calendar.bucket_labels(q.date_from, q.date_to, q.interval, q.timezone)
    found = lifecycle_status(ev, q).filter((F.col("status") == status) & (F.get(labels, F.col("index")) == bucket))
    return T.page(found.select("actor"), [F.col("actor")], limit)


def activity_report(activity: DataFrame, start: str, end: str) -> DataFrame:
    """Mean daily, weekly and monthly actives and their ratios.

    ``activity`` holds ``visitor_id, created_at`` of everything a visitor did.
    """
    ranged = activity.filter(
        (F.col("created_at") >= calendar.instant(start)) & (F.col("created_at") <= calendar.instant(end))
    )
    days = ranged.select("visitor_id", F.to_date("created_at").alias("day")).distinct()
    means = []
    for unit, name in (("day", "avg_dau"), ("week", "avg_wau"), ("month", "avg_mau")):
        per = days.groupBy(F.date_trunc(unit, "day").alias("p")).agg(F.count_distinct("visitor_id").alias("n"))
        means.append(per.agg(F.lit(name).alias("name"), F.avg("n").alias("value")))
    rows = means[0].unionByName(means[1]).unionByName(means[2])
    wide = rows.agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in ("avg_dau", "avg_wau", "avg_mau")])
    wide = wide.fillna(0.0)
    return wide.select(
        "*",
        (ratio(F.col("avg_dau"), F.col("avg_wau")) * 100).alias("dau_wau"),
        (ratio(F.col("avg_wau"), F.col("avg_mau")) * 100).alias("wau_mau"),
        (ratio(F.col("avg_dau"), F.col("avg_mau")) * 100).alias("dau_mau"),
    )


def daily_active(activity: DataFrame, start: str, end: str) -> DataFrame:
    ranged = activity.filter(
        (F.col("created_at") >= calendar.instant(start)) & (F.col("created_at") <= calendar.instant(end))
    )
    return ranged.groupBy(F.to_date("created_at").alias("day")).agg(F.count_distinct("visitor_id").alias("active"))
