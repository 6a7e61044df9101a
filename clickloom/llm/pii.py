"""Personal data by weak supervision, in SQL functions only.

Wide patterns propose spans. Labelers vote on each: the strict rule of its
kind, a gazetteer, context words before and after it, and its shape.
Expectation-maximisation over the vote patterns estimates how far each labeler
can be trusted; the resulting soft labels train the final span classifier.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.session import cut_lineage

BASE = ("email", "ip", "card", "phone")
# Patterns of the base kinds. Runs are taken whole and from their first character (or the end of the match before), which
# finds the same leftmost matches without trying every suffix of a long run, and without recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Kinds that the method adds.
    "masked_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]++\x20?(?:[\[(](?i:dot)[\])]|\.)\x20?[A-Za-z]{2,12}+",
    "local_phone": r"(?<![0-9+().-])(?<![0-9+][\x20])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "masked_email": r"[\[(](?i:at)[\])]", "local_phone": r"[0-9]{3}[\x20.-][0-9]{4}", "national_id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}"}
# Gazetteers and context words.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "it", "uk", "us", "eu", "ch", "at", "nl", "pl", "ru", "cn", "jp", "br", "in", "au", "ca")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65")
FOR = r"(?i)\b(?:e-?mail|mail|contact|write|phone|tel|telephone|call|mobile|fax|card|visa|account|ip|host|address|login|ssn|social)\b"
AGAINST = r"(?i)\b(?:version|ver|release|build|isbn|order|invoice|ticket|example|sample|test|doi|page)\b"
LABELERS = ("rule", "gazetteer", "context", "counter", "shape")
CONTEXT = 30
STEPS = 25
SLOTS = 512  # hashed context words of the classifier


def matches(rows: DataFrame, kind: str) -> DataFrame:
    """``row, kind, start, end, value, before, after`` of every match, positions in code points.

    The text between two matches and the matches themselves add up to the
    positions; the matches of one text are summed in order.
    """
    own = rows.filter(F.col("text").rlike(NEEDED[kind]))
    # Equal rows add equal positions, so each row is told apart until its positions are known.
    cut = own.select("row", F.monotonically_increasing_id().alias("copy"), F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0)).alias("found"), F.split("text", PATTERNS[kind]).alias("gaps"))
    each = cut.select("row", "copy", "gaps", F.posexplode_outer("found").alias("i", "value")).filter("value is not null")
    near = each.select("row", "copy", "i", "value", F.get("gaps", F.col("i")).alias("gap"), F.get("gaps", F.col("i") + 1).alias("next"))
    sized = near.select("row", "copy", "i", "value", F.char_length("gap").alias("skip"), F.char_length("value").alias("size"), F.right("gap", F.lit(CONTEXT)).alias("before"), F.left("next", F.lit(CONTEXT)).alias("after"))
    order = Window.partitionBy("row", "copy").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("skip") + F.col("size")).over(order)
    return sized.select("row", "copy", F.lit(kind).alias("kind"), (end - F.col("size")).alias("start"), end.alias("end"), "value", "before", "after")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the last digit checks the ones before; every second digit from the right is doubled."""
    right = F.reverse(number)
    digit = lambda i: F.substring(right, i, F.lit(1)).cast("int")
    twice = lambda i: F.when(digit(i) > 4, 2 * digit(i) - 9).otherwise(2 * digit(i))
    total = F.aggregate(F.sequence(F.lit(1), F.char_length(number)), F.lit(0), lambda t, i: t + F.when(i % 2 == 0, twice(i)).otherwise(digit(i)))
    return total % 10 == 0


def small_parts(value: Column) -> Column:
    """Whether all dotted numbers are 255 at most."""
    plain = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.forall(F.split(value, r"\."), lambda p: (F.char_length(plain(p)) <= 3) & (F.right(plain(p), F.lit(3)).cast("int") <= 255))


def by_kind(cases: dict[str, Column], other: Column) -> Column:
    pairs = list(cases.items())
    first = F.when(F.col("kind") == pairs[0][0], pairs[0][1])
    return reduce(lambda c, x: c.when(F.col("kind") == x[0], x[1]), pairs[1:], first).otherwise(other)


def vote(yes: Column, no: Column | None = None) -> Column:
    """1 for, -1 against, 0 abstains."""
    return F.when(yes, 1).when(F.lit(False) if no is None else no, -1).otherwise(0)


def voted(found: DataFrame) -> DataFrame:
    """Candidates with one column per labeler and ``base``, which the strict rule of a base kind decides."""
    value, number = F.col("value"), digits(F.col("value"))
    n = F.char_length(number)
    strict = by_kind(
        {"email": F.lit(True), "ip": small_parts(value), "card": F.when(n.between(12, 19), luhn(number)).otherwise(False), "phone": n.between(9, 15), "national_id": ~value.rlike("^(?:000|666|9..)|-00-|-0000$")},
        F.lit(True),
    )
    listed = by_kind(
        {
            "email": F.lower(F.substring_index(value, ".", -1)).isin(*TOP_DOMAINS),
            "masked_email": F.lower(F.regexp_extract(value, "([A-Za-z]+)$", 1)).isin(*TOP_DOMAINS),
            "phone": reduce(lambda a, b: a | b, [F.left(number, F.lit(k)).isin(*[c for c in CALLING_CODES if len(c) == k]) for k in (1, 2)]),
            "card": reduce(lambda a, b: a | b, [number.startswith(s) for s in CARD_STARTS]),
            "ip": ~value.rlike(r"^(?:0|127|255)\.|^(?:192\.0\.2|198\.51\.100|203\.0\.113)\."),
        },
        F.lit(None).cast("boolean"),
    )
    around = F.concat_ws(" ", "before", "after")
    dull = F.char_length(F.regexp_replace(number, "^(.)\\1*", "")) == 0
    marked = found.withColumn("strict", strict)
    return marked.select(
        "*",
        (F.col("strict") & F.col("kind").isin(*BASE)).alias("base"),
        vote(F.col("strict"), ~F.col("strict")).alias("rule"),
        vote(F.coalesce(listed, F.lit(False)), F.coalesce(~listed, F.lit(False))).alias("gazetteer"),
        vote(F.col("before").rlike(FOR)).alias("context"),
        vote(F.lit(False), around.rlike(AGAINST)).alias("counter"),
        vote(F.lit(False), F.when(n > 3, dull).otherwise(False)).alias("shape"),
    )


def reliabilities(patterns: list[tuple[tuple[str, ...], tuple[int, ...], int]], steps: int = STEPS) -> dict:
    """Probability that a span of each ``(kind, votes)`` is real, by expectation-maximisation.

    ``patterns`` counts spans by kind and votes; there are at most as many as
    kinds times vote combinations. Labelers are independent given the truth;
    an abstention carries no weight. The start trusts the majority of votes.
    """
    chance = {(k, v): 0.5 + 0.4 * max(-1, min(1, sum(v))) for k, v, _ in patterns}
    for _ in range(steps):
        model = {}
        for kind in {k for k, _, _ in patterns}:
            own = [(v, n, chance[k, v]) for k, v, n in patterns if k == kind]
            real, false = sum(n * p for _, n, p in own), sum(n * (1 - p) for _, n, p in own)
            rates = []
            for j in range(len(own[0][0])):
                rates.append({x: ((sum(n * p for v, n, p in own if v[j] == x) + 1) / (real + 3), (sum(n * (1 - p) for v, n, p in own if v[j] == x) + 1) / (false + 3)) for x in (-1, 0, 1)})
            model[kind] = (math.log((real + 1) / (false + 1)), rates)
        for kind, votes, _ in patterns:
            prior, rates = model[kind]
            score = prior + sum(math.log(r[x][0] / r[x][1]) for r, x in zip(rates, votes) if x)
            chance[kind, votes] = 1 / (1 + math.exp(-max(-30, min(30, score))))
    return chance


def features(found: DataFrame) -> DataFrame:
    """One row per span and feature: kind with each vote, length and the hashed word before."""
    word = F.lower(F.regexp_extract("before", r"([^\s]+)\s*$", 1))
    own = [F.concat_ws("=", "kind", F.lit(c), F.col(c).cast("string")) for c in LABELERS]
    size = F.concat_ws("=", "kind", F.lit("size"), F.least(F.char_length("value"), F.lit(40)).cast("string"))
    slot = F.concat_ws("=", F.lit("word"), F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("string"))
    return found.select("row", "kind", "start", "chance", F.explode(F.array(*own, size, slot)).alias("feature"))


def classified(found: DataFrame) -> DataFrame:
    """``row, kind, start, accepted``: a log-linear classifier trained on the soft labels of all spans.

    Feature weights are smoothed log ratios of soft counts, in whole millionths
    so that sums do not depend on their order. The number of features is fixed
    by kinds, votes, lengths and slots.
    """
    rows = features(found)
    units = F.round(F.col("chance") * 1_000_000).cast("long")
    counts = rows.groupBy("feature").agg(F.sum(units).alias("p"), F.count(F.lit(1)).alias("n"))
    weight = F.round(1_000_000 * F.log((F.col("p") / 1_000_000 + 1) / (F.col("n") - F.col("p") / 1_000_000 + 1))).cast("long")
    weights = counts.select("feature", weight.alias("weight"))
    scores = rows.join(weights, "feature").groupBy("row", "kind", "start").agg(F.sum("weight").alias("score"))
    return scores.select("row", "kind", "start", (F.col("score") >= 0).alias("accepted"))


def find_personal_data(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` (kind, start, end, base) for every row of ``documents``, by start and kind.

    Spans of the base kinds that pass their rule are always kept. All other
    candidates are kept if the trained classifier accepts them and they do not
    overlap a base span. Null and empty texts have none. Rows of one id and
    text are one document: each gets the spans of that text. Matches, not
    texts, are shuffled; the matches of one text are its only group.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), F.md5(text).alias("sum")).alias("row"), text.alias("text"))
    kinds = list(PATTERNS)
    found = reduce(DataFrame.union, [matches(rows, kind) for kind in kinds])
    candidates = cut_lineage(voted(found))
    counted = candidates.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()
    chance = reliabilities([(r["kind"], tuple(r[c] for c in LABELERS), r["n"]) for r in counted])
    spark = documents.sparkSession
    if chance:
        listed = ", ".join(f"('{k}', {', '.join(map(str, v))}, {p:.9f}D)" for (k, v), p in sorted(chance.items()))
        table = spark.sql(f"select * from values {listed} as t(kind, {', '.join(LABELERS)}, chance)")
        soft = candidates.join(table, ["kind", *LABELERS])
        verdicts = classified(soft)
        joined = candidates.join(verdicts, ["row", "kind", "start"], "left")
    else:
        joined = candidates.withColumn("accepted", F.lit(False))
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")).cast("int")
    kept = joined.filter(F.col("base") | F.col("accepted")).select("row", F.struct("start", place.alias("place"), "kind", "end", "base").alias("s"))
    grouped = kept.groupBy("row").agg(F.sort_array(F.collect_set("s")).alias("all"))
    base = F.filter("all", lambda s: s["base"])
    free = grouped.select("row", "all", base.alias("held"))
    clear = lambda s: ~F.exists("held", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    shown = free.select("row", F.transform(F.filter("all", lambda s: s["base"] | clear(s)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))).alias("spans"))
    every = documents.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), F.md5(text).alias("sum")).alias("row"))
    whole = every.join(shown.withColumnRenamed("row", "r"), F.col("row").eqNullSafe(F.col("r")), "left")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
    return whole.select(F.col("row.id").alias("doc_id"), F.coalesce("spans", none).alias("spans"))
