"""Documents to a tokenised training mix: rules, near copies, benchmark passages, mixing, records."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from clickloom.llm.decontaminate import decontaminate
from clickloom.llm.jaccard_join import jaccard_components
from clickloom.llm.mixing import mix
from clickloom.llm.quality import FOLDS, PRIOR, quality_rules, target_weights, trusted_ids
from clickloom.llm.queries import tokenizer_path
from clickloom.llm.records import read_records, write_records
from clickloom.session import configure, cut_lineage, new_folder

#: No SQL: the mixing stage iterates and the last stage runs a tokenizer.
ORACLE_SQL = None


def free(docs: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column has it."""
    while name.lower() in map(str.lower, docs.columns):
        name = f"_{name}"
    return name


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number that tells its rows apart and stays when the files are read again.

    Of a table read from files it is a 64-bit hash of the file and the place in
    it; another frame is written out first. Two rows of n get one number with
    chance n * n / 2**65 and are then treated alike.
    """
    try:
        place = docs.metadataColumn("_metadata")
        return docs.select("*", F.xxhash64(place["file_path"], place["row_index"]).alias(name))
    except AnalysisException:
        return cut_lineage(docs.withColumn(name, F.monotonically_increasing_id()))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the rules and the likelihood threshold.

    Each row is judged by itself, repeated ones alike; null and empty texts fail
    the rules, an empty table stays empty, and other columns pass through.
    """
    trusted = trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    weights = target_weights(docs, trusted, prior=PRIOR, folds=FOLDS)
    return quality_rules(docs, weights, trusted=trusted).filter("kept").select(docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, one with the smallest id.

    Rows that share an id are told apart, so of repeated rows one stays. A null
    id comes last. Rows without words have no copies and all stay.
    """
    row = free(docs, "row")
    rows = numbered(docs, row)
    groups = jaccard_components(rows, links=False, id_col=row).select(F.col("doc_id").alias("at"), "component_id").distinct()
    named = rows.select(F.col(row).alias("here"), F.col("doc_id").alias("name")).join(groups, F.col("here") == F.col("at"))
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("name").isNull(), "name", "here"))["here"].alias("first")).select("first")
    return rows.join(first, rows[row] == first["first"], "left_semi").select(docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark passage, told apart where ids repeat; null and empty texts stay."""
    row = free(docs, "row")
    rows = numbered(docs, row)
    hit = decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=row)
    clean = hit.filter("not contaminated").select(F.col("doc_id").alias("clean"))
    return rows.join(clean, rows[row] == clean["clean"], "left_semi").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it.

    The mix goes by the content of rows, so that reruns agree. Of equal rows
    one is written as often as all of them are taken, at most twice for each.
    Columns of map type do not tell rows apart.
    """
    row, own = free(docs, "row"), free(docs, "own")
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = numbered(docs, row).withColumn(own, F.struct(F.col("doc_id"), F.xxhash64(*plain)))
    copies = mix(rows, id_col=own).groupBy(F.col("doc_id").alias("taken")).agg(F.sum("copies").alias("copies")).filter("copies > 0")
    first = rows.select(F.col(own).alias("content"), F.col(row).alias("here")).groupBy("content").agg(F.min("here").alias("first"))
    times = first.join(copies, F.col("content").eqNullSafe(F.col("taken"))).select("first", F.col("copies").alias("times"))
    number, times = free(docs, "times"), times.withColumnRenamed("times", free(docs, "times"))
    return rows.join(times, rows[row] == times["first"]).withColumn(own, F.explode(F.sequence(F.lit(1), F.col(number).cast("int")))).select([rows[c] for c in docs.columns])


def records_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of the mix, one per row, as read back from the files; null texts are empty."""
    return read_records(write_records(docs, tokenizer_path(), encode_special_tokens=False))


def configured(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` with the session's settings applied, as it may also be called by itself, without ``run``."""

    @wraps(stage)
    def settled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(configure(spark), docs, sf_dir)

    return settled


STAGES = [
    ("quality_rules", configured(quality_stage)),
    ("jaccard_join", configured(near_copy_stage)),
    ("decontamination", configured(benchmark_stage)),
    ("source_mixing", configured(mixing_stage)),
    ("binary_records", configured(records_stage)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
