"""Fact tables on files: appends, monthly partitions, retention, numbered uploads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clickloom.functions.calendar import instant
from clickloom.plans.small import broadcast_if_small
from clickloom.schema import TABLES, table_schema

TABLES_ON_FILE = frozenset(TABLES)


def month_of(ts: str = "created_at") -> Column:
    return F.date_format(ts, "yyyy-MM")


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns and types with its month; columns not given are NULL."""
    columns = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table_schema(table).fields
    ]
    return df.select(*columns).withColumn("month", month_of())


def append(df: DataFrame, table: str, path: str) -> None:
    """Append rows under the table's month folders."""
    conform(df, table).write.mode("append").partitionBy("month").parquet(f"{path}/{table}")


def read_table(spark: SparkSession, table: str, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """A table's rows in a range; whole months outside it are not listed."""
    df = spark.read.schema(table_schema(table).add("month", "string")).parquet(f"{path}/{table}")
    if start is not None:
        df = df.filter((F.col("month") >= F.date_format(instant(start), "yyyy-MM")) & (F.col("created_at") >= instant(start)))
    if end is not None:
        df = df.filter((F.col("month") <= F.date_format(instant(end), "yyyy-MM")) & (F.col("created_at") < instant(end)))
    return df


def partitions(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """Rows and bounds per month partition."""
    return df.groupBy(month_of(ts).alias("month")).agg(
        F.count("*").alias("rows"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at")
    )


def expired_months(df: DataFrame, cutoff: str, ts: str = "created_at") -> DataFrame:
    """Month partitions that end at or before the cutoff, which may be dropped whole."""
    ends = F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 1)
    return df.select(month_of(ts).alias("month")).distinct().filter(ends <= F.lit(cutoff).cast("date"))


def retained(df: DataFrame, cutoff: str, ts: str = "created_at", by_month: bool = True) -> DataFrame:
    """What a cleanup keeps: whole months for partitioned tables, else single rows."""
    if by_month:
        return df.filter(F.add_months(F.trunc(F.to_date(ts), "month"), 1) > F.lit(cutoff).cast("date"))
    return df.filter(F.col(ts) >= F.lit(cutoff).cast("timestamp"))


def numbered(reader: DataFrame) -> DataFrame:
    """Rows of a file read with ``row_number`` 1..n in file order.

    Rows are numbered inside their file split; only one row per split is
    ordered globally.
    """
    rows = reader.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = rows.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("_file", "_start", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    joined = rows.join(broadcast_if_small(offsets), ["_file", "_start"])
    number = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return joined.withColumn("row_number", number).drop("_file", "_start", "_id", "_first", "_before")


def upload_rows(reader: DataFrame, upload_id: str) -> DataFrame:
    """An uploaded file as numbered JSON objects."""
    fields = [F.col(c) for c in reader.columns]
    return numbered(reader).select(F.lit(upload_id).alias("upload_id"), "row_number", F.to_json(F.struct(*fields)).alias("row_data"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")


def csv_records(spark: SparkSession, path: str, quote: str = '"', max_lines: int = 10_000) -> DataFrame:
    """``row_number, record, reason`` of uploaded CSV files, a record being all lines of one row.

    Files are read as lines, in as many splits as they have. A line begins a
    record if the quotes before it in its file are even in number; the counts
    of the splits before are added up over one row per split, and so are the
    numbers of records, 1 to n in file order. A record of more than
    ``max_lines`` lines, as after a quote that is never closed, is not put
    together: its lines come one by one with ``reason`` ``too long``, under the
    record's number. One that ends inside quotes has the reason ``open quote``,
    others have none. Line breaks inside quotes become ``\\n``.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"),
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    here = Window.partitionBy("_file", "_start").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    local = lines.withColumn("_q", quotes % 2).withColumn("_before", F.coalesce(F.sum("_q").over(here), F.lit(0)))
    ahead = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = local.groupBy("_file", "_start").agg(F.sum("_q").alias("_n")).select(F.col("_file").alias("_f"), F.col("_start").alias("_s"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_off"))
    same = (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_s"))
    marked = local.join(splits, same).withColumn("_first", ((F.col("_before") + F.col("_off")) % 2 == 0).cast("int")).drop("_f", "_s")
    so_far = Window.partitionBy("_file", "_start").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = marked.withColumn("_in", F.sum("_first").over(so_far))
    every = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    begun = marked.groupBy("_file", "_start").agg(F.sum("_first").alias("_k")).select(F.col("_file").alias("_f"), F.col("_start").alias("_s"), F.coalesce(F.sum("_k").over(every), F.lit(0)).alias("_rows"))
    rows = counted.join(begun, same).select("_id", "value", "_q", (F.col("_in") + F.col("_rows")).alias("row_number"))
    sizes = rows.groupBy("row_number").agg(F.count("*").alias("_n"))
    long = sizes.filter(F.col("_n") > max_lines).select("row_number")
    listed = F.array_sort(F.collect_list(F.struct("_id", "value")))
    short = rows.join(long, "row_number", "left_anti").groupBy("row_number").agg(
        F.array_join(F.transform(listed, lambda x: x["value"]), "\n").alias("record"), F.when(F.sum("_q") % 2 == 1, "open quote").alias("reason"),
    )
    return short.unionByName(rows.join(long, "row_number", "left_semi").select("row_number", F.col("value").alias("record"), F.lit("too long").alias("reason")))


def upload_csv(spark: SparkSession, path: str, upload_id: str, columns: Sequence[str], header: bool = True, max_lines: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """An uploaded CSV as numbered JSON objects, and the rows that are none with the reason.

    With ``header`` the first record of the upload is left out of both. Fields
    are text; a record with more or fewer fields than ``columns`` is refused.
    Row numbers count all records, so those of refused rows are missing.
    """
    bad = "_refused"
    schema = ", ".join(f"`{c}` string" for c in [*columns, bad])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad, "escape": '"', "multiLine": "true"}
    records = csv_records(spark, path, max_lines=max_lines).withColumn("row_number", F.col("row_number") - F.lit(int(header))).filter("row_number > 0")
    parsed = records.withColumn("_row", F.from_csv("record", schema, options))
    why = F.coalesce("reason", F.when(F.col("_row").isNull() | F.col(f"_row.{bad}").isNotNull(), "wrong number of fields"))
    judged = parsed.withColumn("reason", why)
    fields = F.struct(*[F.col("_row")[c].alias(c) for c in columns])
    good = judged.filter("reason is null").select(F.lit(upload_id).alias("upload_id"), "row_number", F.to_json(fields).alias("row_data"))
    return good, judged.filter("reason is not null").select(F.lit(upload_id).alias("upload_id"), "row_number", "record", "reason")


def adapter_rows(responses: DataFrame, column: str = "body") -> DataFrame:
    """Rows of adapter responses: an array, or the ``rows`` or ``data`` array of an object."""
    root = F.try_parse_json(column)
    kind = "array<variant>"
    listed = F.coalesce(F.try_variant_get(root, "$", kind), F.try_variant_get(root, "$.rows", kind), F.try_variant_get(root, "$.data", kind))
    return responses.withColumn("row", F.explode(listed)).withColumn("row", F.to_json("row"))


def read_external(spark: SparkSession, url: str, query: str, limit: int, schema: str | None = None, **options: str) -> DataFrame:
    """A read-only query of another database over JDBC, with a row limit."""
    reader = spark.read.format("jdbc").option("url", url).option("query", query).options(**options)
    if schema:
        reader = reader.option("sessionInitStatement", f"SET search_path TO {schema}")
    return reader.load().limit(limit)
