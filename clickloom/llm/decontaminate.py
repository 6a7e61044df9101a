"""Benchmark passages in documents, by a prefix-filtered containment join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.llm.text import ascii_lower, let, pieces, without_blank_ends
from clickloom.session import cut_lineage

WORD_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before ASCII letters are lower-cased
WIDTH = 10
SHINGLE = 3
BROADCAST_KEYS = 1_000_000  # shingles of one pass over the documents; more take more passes


def word_keys(parts: Column) -> Column:
    """A hash per word that is equal for words that differ in case; equality is verified later."""
    return F.transform(parts, lambda w: F.when(w != "", F.xxhash64(F.lower(w))))


def item_windows(benchmark: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, window`` (lower-cased words): every run of ``width`` words, or all words of a shorter item."""
    words = let(pieces(F.col(text_col), WORD_BREAK), without_blank_ends)
    lowered = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.transform(words, ascii_lower).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    runs = F.transform(starts, lambda i: F.slice("words", i, width))
    return lowered.filter(F.size("words") > 0).select("item", F.explode(runs).alias("window")).distinct()


def shingles(windows: DataFrame) -> DataFrame:
    """``window, size, offset, key`` of every shingle of the distinct windows."""
    size = F.least(F.size("window"), F.lit(SHINGLE))
    hashed = windows.select("window").distinct().select("window", size.alias("size"), word_keys(F.col("window")).alias("keys"))
    offsets = F.sequence(F.lit(0), F.size("keys") - F.col("size"))
    placed = hashed.select("window", "size", "keys", F.explode(offsets).alias("offset"))
    return placed.select("window", "size", "offset", shingle_key("keys", "offset", F.col("size")).alias("key"))


def shingle_key(keys: str, at: str, size: Column) -> Column:
    word = lambda i: F.when(size > i, F.get(keys, F.col(at) + i))
    return F.xxhash64(F.get(keys, F.col(at)), *[word(i) for i in range(1, SHINGLE)])


def shingle_matches(documents: DataFrame, keys: DataFrame, sizes: list[int], id_col: str, text_col: str) -> DataFrame:
    """``doc, hash, at, first, key, near``: where a shingle of the benchmark begins, with the words around it.

    ``near`` has the words from ``first`` on, enough for every window that
    holds the shingle. ``keys`` is bounded and broadcast; the documents are not
    shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = documents.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("hash"), pieces(text, WORD_BREAK).alias("parts"))
    hashed = split.select("*", word_keys(F.col("parts")).alias("keys"))
    found = []
    for size in sizes:
        at = hashed.select("doc", "hash", "parts", "keys", F.posexplode_outer("keys").alias("at", "own")).filter("own is not null")
        keyed = at.select("doc", "hash", "parts", "at", shingle_key("keys", "at", F.lit(size)).alias("key"))
        met = keyed.join(F.broadcast(keys.filter(F.col("size") == size).select("key")), "key")
        first = F.greatest(F.col("at") - (WIDTH - 1), F.lit(0))
        found.append(met.select("doc", "hash", "at", first.alias("first"), "key", F.slice("parts", first + 1, 2 * WIDTH - 1).alias("near")))
    return reduce(DataFrame.union, found)


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, contaminated`` for every row of ``documents``.

    A window of an item occurs in a document if all its words do, in order and
    side by side. Shingles of three words are ordered by how often they occur
    in the documents; a window can only occur where its rarest shingle does, so
    that shingle alone is joined. The window must lie within the document at
    the shingle's offset and is compared word by word.

    Null texts have no words; items without words have no windows; an item
    without id is listed as an empty string. Rows of one id and text are one
    document and get equal results; ties between shingles go to the first.
    """
    windows = cut_lineage(item_windows(benchmark, id_col=item_col, text_col=item_text_col))
    parts = cut_lineage(shingles(windows))
    keys = parts.select("key", "size").distinct()
    sizes = sorted(r["size"] for r in parts.select("size").distinct().collect())  # at most three
    passes = max(1, -(-keys.count() // BROADCAST_KEYS))
    block = lambda i: keys.filter(F.pmod("key", F.lit(passes)) == i)
    text = F.coalesce(F.col(text_col), F.lit(""))
    blank = lambda i: F.when(F.get("parts", i) == "", 1).otherwise(0)
    n_words = F.size("parts") - blank(F.lit(0)) - F.when(F.size("parts") > 1, blank(F.size("parts") - 1)).otherwise(0)
    split = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("hash"), pieces(text, WORD_BREAK).alias("parts"))
    base = split.select("doc_id", "hash", n_words.cast("long").alias("n_words"))
    none = {"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>")}
    if not sizes:
        hits = base.select(F.col("doc_id").alias("doc"), F.col("hash").alias("text"), *[v.alias(k) for k, v in none.items()]).limit(0)
    else:
        matches = cut_lineage(reduce(DataFrame.union, [shingle_matches(documents, block(i), sizes, id_col, text_col) for i in range(passes)]))
        counts = matches.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        rated = parts.join(counts, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        rarest = rated.groupBy("window").agg(F.min(F.struct("n", "offset", "key")).alias("r")).filter("r.n > 0")
        prefix = rarest.select("window", F.col("r.offset").alias("offset"), F.col("r.key").alias("key"))
        start = F.col("at") - F.col("offset")
        met = matches.join(prefix, "key").withColumn("start", start).filter((start >= F.col("first")) & (start - F.col("first") + F.size("window") <= F.size("near")))
        words = F.transform(F.slice("near", F.col("start") - F.col("first") + 1, F.size("window")), ascii_lower)
        occurring = met.filter(words == F.col("window")).select("doc", "hash", "start", "window").join(windows, "window")
        spans = occurring.groupBy("doc", "hash").agg(
            F.sort_array(F.collect_set(F.struct(F.col("start").alias("lo"), (F.col("start") + F.size("window")).alias("hi")))).alias("spans"),
            F.sort_array(F.collect_set("item")).alias("items"),
        )
        grow = lambda s, x: F.struct(F.greatest(s["end"], x["hi"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["hi"] - F.greatest(x["lo"], s["end"]))).alias("n"))
        n_hit = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), grow, lambda s: s["n"].cast("long"))
        hits = spans.select("doc", F.col("hash").alias("text"), n_hit.alias("n_hit"), "items")
    joined = base.join(hits, base["doc_id"].eqNullSafe(hits["doc"]) & (base["hash"] == hits["text"]), "left")
    filled = joined.select("doc_id", "n_words", *[F.coalesce(F.col(k), v).alias(k) for k, v in none.items()])
    return filled.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))
