"""Visitor-keyed tables in files that one visitor is found in without reading the others.

Rows are dealt into bucket folders by a hash of the visitor and sorted by
visitor inside a file, which has a bloom filter of its visitors. A lookup lists
the buckets of the wanted visitors only and skips row groups by their bounds and
filters; a deletion writes those buckets again that hold a wanted visitor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clickloom.session import cut_lineage

BUCKET = "visitor_bucket"


def bucket_of(visitor: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(visitor), F.lit(buckets)).cast("int")


def write_by_visitor(df: DataFrame, path: str, buckets: int, visitor: str = "visitor_id", mode: str = "append", visitors_per_file: int = 1_000_000) -> None:
    """Write rows under their bucket's folder, one file per bucket and call; a null visitor has a bucket like any other."""
    dealt = df.withColumn(BUCKET, bucket_of(F.col(visitor), buckets)).repartition(buckets, BUCKET).sortWithinPartitions(BUCKET, visitor)
    writer = dealt.write.mode(mode).partitionBy(BUCKET).option("partitionOverwriteMode", "dynamic")
    writer.option(f"parquet.bloom.filter.enabled#{visitor}", "true").option(f"parquet.bloom.filter.expected.ndv#{visitor}", str(visitors_per_file)).parquet(path)


def _buckets(spark: SparkSession, visitors: Sequence[str], buckets: int) -> list[int]:
    rows = spark.createDataFrame([(v,) for v in visitors], "v string").select(bucket_of(F.col("v"), buckets).alias("b")).distinct()
    return sorted(r.b for r in rows.collect())


def visitor_rows(spark: SparkSession, path: str, visitors: Sequence[str], buckets: int, visitor: str = "visitor_id") -> DataFrame:
    """All rows of a short list of visitors, from their buckets only."""
    rows = spark.read.parquet(path)
    return rows.filter(F.col(BUCKET).isin(_buckets(spark, visitors, buckets)) & F.col(visitor).isin(list(visitors))).drop(BUCKET)


def delete_visitors(spark: SparkSession, path: str, visitors: Sequence[str], buckets: int, visitor: str = "visitor_id") -> list[int]:
    """Write the buckets again that hold a row of a listed visitor, and return them.

    What stays is written out in full before a bucket is replaced, so a job that
    fails half-way leaves the old files.
    """
    held = sorted(r[0] for r in spark.read.parquet(path).filter(F.col(BUCKET).isin(_buckets(spark, visitors, buckets)) & F.col(visitor).isin(list(visitors))).select(BUCKET).distinct().collect())
    if not held:
        return []
    rows = spark.read.parquet(path).filter(F.col(BUCKET).isin(held))
    kept = cut_lineage(rows.filter(~F.coalesce(F.col(visitor).isin(list(visitors)), F.lit(False))))
    emptied = set(held) - {r[0] for r in kept.select(BUCKET).distinct().collect()}
    write_by_visitor(kept.drop(BUCKET), path, buckets, visitor, "overwrite")
    for bucket in emptied:  # no row is left to overwrite these with
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{BUCKET}={bucket}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return held
