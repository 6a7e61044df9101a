"""Rule filters with a hashed n-gram likelihood ratio against a trusted target."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.llm.text import SPACE_RUN, let, pieces, without_blank_ends
from clickloom.session import cut_lineage

BUCKETS = 16_384
TRUSTED_ROWS = 20_000  # bound of the labelled sample that the target distribution is fitted on
PRIOR = 16 * BUCKETS  # words and pairs of the corpus that the target is mixed with, so that little evidence gives ratios near 0
FOLDS = 5  # parts of the trusted documents; each is scored by the counts of the other parts
THRESHOLD = -0.06  # mean log-likelihood ratio per n-gram below which a document is rejected
MIN_WORDS = 20
REPEAT_PERCENT = 30
UNIT = 1_000_000  # weights are whole millionths, so that sums do not depend on their order
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
HELD = ("__table", "__at", "__parts", "__one", "__two", "__four", "__weight")


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """``doc_id`` of at most ``rows`` trusted labelled documents, chosen by hash.

    Labels without an id or with a null verdict are not trusted.
    """
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def without(text: Column, characters: str) -> Column:
    return reduce(lambda rest, c: F.replace(rest, F.lit(c), F.lit("")), characters, text)


def bucket_of(hash_: Column, buckets: int) -> Column:
    return F.pmod(hash_, F.lit(buckets)).cast("int")


def fold_of(id_: Column, folds: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(folds)).cast("int")


def target_weights(
    documents: DataFrame,
    trusted: DataFrame,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    prior: float | None = None,
    folds: int = 0,
) -> DataFrame:
    """One row: ``weights``, the log ratio of target to corpus probability of every bucket.

    Words and word pairs of all documents are counted; those of trusted
    documents count for the target as well. The corpus is smoothed by one. So
    is the target without a ``prior``, which pulls a small one towards uniform;
    with it, the target gets so many words and pairs spread like the corpus.
    ``folds`` more tables follow the first, each without the trusted documents
    of one fold. ``trusted`` is bounded by its parameter and therefore broadcast.
    """
    marks = F.broadcast(trusted.select(F.col("doc_id").alias("__id"), fold_of(F.col("doc_id"), max(folds, 1)).alias("__fold")))
    split = documents.select(F.col(id_col).alias("__doc"), pieces(F.col(text_col), SPACE_RUN).alias("__parts"))
    flagged = split.join(marks, F.col("__doc") == F.col("__id"), "left").select("__parts", F.coalesce("__fold", F.lit(-1)).alias("__fold"))
    words = flagged.select("__fold", "__parts", F.posexplode_outer("__parts").alias("__at", "__word")).filter("__word != ''")
    follow = F.nullif(F.get("__parts", F.col("__at") + 1), F.lit(""))
    hashed = words.select("__fold", F.xxhash64("__word").alias("__hash"), F.when(follow.isNotNull(), F.xxhash64(follow)).alias("__next"))
    double = F.when(F.col("__next").isNotNull(), bucket_of(F.xxhash64("__hash", "__next"), buckets))
    grams = hashed.select("__fold", F.explode_outer(F.array(bucket_of(F.col("__hash"), buckets), double)).alias("bucket")).filter("bucket is not null")
    parts = grams.groupBy("bucket", "__fold").agg(F.count(F.lit(1)).alias("n"))
    held = [f"held{k}" for k in range(folds)]
    sums = [F.sum(F.when(F.col("__fold") == k, F.col("n"))).alias(name) for k, name in enumerate(held)]
    counts = parts.groupBy("bucket").agg(F.sum("n").alias("raw"), F.sum(F.when(F.col("__fold") >= 0, F.col("n"))).alias("target"), *sums)
    every = documents.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").na.fill(0, ["raw", "target", *held])
    rows = F.sort_array(F.collect_list(F.struct("bucket", "raw", "target", *held)))
    totals = [F.sum(c).alias(f"all_{c}") for c in ("raw", "target", *held)]
    gathered = filled.agg(rows.alias("rows"), *totals)

    def weights(without: str | None) -> Column:
        total = F.col("all_target") - F.col(f"all_{without}") if without else F.col("all_target")
        known = F.when(total > 0, F.lit(1)).otherwise(F.lit(0))  # no trusted text: no verdict against anything

        def weight(r: Column) -> Column:
            share = (r["raw"] + 1) / (F.col("all_raw") + buckets)
            n = r["target"] - r[without] if without else r["target"]
            own = (n + 1) / (total + buckets) if prior is None else (n + prior * share) / (total + prior)
            return F.round((F.log(own) - F.log(share)) * UNIT).cast("long") * known

        return F.transform("rows", weight)

    return gathered.select(F.concat(*[weights(name) for name in (None, *held)]).alias("weights"))


def repeated_words(windows: Column, width: int) -> Column:
    """How many words lie in windows whose hash is found twice or more."""

    def neighbours(rows: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(rows, k)["hash"] == x["hash"], F.lit(False))
        return F.filter(rows, lambda x, k: F.when(k > 0, same(x, k - 1)).otherwise(False) | same(x, k + 1))

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
    starts = F.sort_array(F.transform(let(pairs, neighbours), lambda x: x["at"]))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("words"))
    grow = lambda s, at: F.struct((at + width).alias("end"), (s["words"] + width - F.greatest(F.lit(0), s["end"] - at)).alias("words"))
    return F.aggregate(starts, none, grow, lambda s: s["words"])


def quality_rules(
    documents: DataFrame,
    weights: DataFrame,
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
    text_col: str = "text",
    trusted: DataFrame | None = None,
    id_col: str = "doc_id",
) -> DataFrame:
    """All columns of ``documents`` plus the rule figures, ``llr`` and the verdict ``kept``.

    Every row is judged by itself, so repeated rows get equal verdicts and hot
    sources cost nothing; a null or empty text has no words and fails the base
    rules. Columns of the input that are named like a result are replaced.
    ``llr`` is the mean weight of a document's words and word pairs; a text
    without words has 0. ``weights`` has one row of a fixed number of buckets.
    With ``trusted``, its documents are scored by the table of ``weights`` that
    is made without their fold, and so without their own counts.
    """
    outputs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
    kept = [F.col(f"`{c}`") for c in documents.columns if c not in outputs and c not in HELD]
    text = F.coalesce(F.col(text_col), F.lit(""))
    # One row, written out: plans name it as a subquery, where a literal would stand with all its numbers in every text of a plan.
    weights = cut_lineage(weights.select("weights"))
    offset = F.lit(0)
    if trusted is not None:
        folds = weights.select(F.size("weights")).first()[0] // buckets - 1
        if folds < 2:
            raise ValueError("trusted documents need weights of two folds or more")
        marks = F.broadcast(trusted.select(F.col("doc_id").alias("__id"), ((fold_of(F.col("doc_id"), folds) + 1) * buckets).alias("__offset")))
        documents = documents.join(marks, F.col(id_col) == F.col("__id"), "left")
        offset = F.coalesce("__offset", F.lit(0))

    pair = lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))
    ahead = lambda grams, n: F.slice(grams, n + 1, F.greatest(F.size(grams) - n, F.lit(0)))
    joined = lambda grams, n: F.zip_with(F.slice(grams, 1, F.greatest(F.size(grams) - n, F.lit(0))), ahead(grams, n), pair)
    split = documents.select(*kept, offset.alias("__at"), pieces(F.col(text_col), SPACE_RUN).alias("__parts"))
    single = split.select("*", F.transform(without_blank_ends(F.col("__parts")), lambda w: F.xxhash64(w)).alias("__one"))
    double = single.select("*", joined(F.col("__one"), 1).alias("__two"))
    fours = double.select("*", joined(F.col("__two"), 2).alias("__four"))

    zero = F.lit(0).cast("long")

    def weigh(table: Column) -> Column:
        add = lambda total, h: total + F.get(table, F.col("__at") + bucket_of(h, buckets))
        return F.aggregate("__one", zero, add) + F.aggregate("__two", zero, add)

    # Used once, the table is not copied into rows: the two projections become one.
    tabled = fours.select("*", weights.scalar().alias("__table"))
    weighed = tabled.select(*kept, "__one", "__four", let(F.col("__table"), weigh).alias("__weight"))
    size = F.size("__one")
    grams = F.greatest(2 * size - 1, F.lit(1))
    # A window that is found twice has its first four words twice.
    again = F.size(F.array_distinct("__four")) < F.size("__four")
    repeated = F.when(again, let(joined(F.col("__four"), 4), lambda x: repeated_words(x, 8))).otherwise(zero)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    figures = F.struct(
        size.cast("long").alias("n_words"),
        F.char_length(without(text, SPACES)).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        (F.col("__weight") / grams / UNIT).alias("llr"),
    )
    # A filter on the verdict is not pushed through a generator; through plain columns it would compute all hashes again for every use.
    judged = weighed.select(*kept, F.inline_outer(F.array(figures)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    ruled = judged.withColumn("base_failed", failed)
    return ruled.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
