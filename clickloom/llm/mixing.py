"""Mix sources to target token weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.llm.order import running_total
from clickloom.llm.text import SPACE_RUN, pieces
from clickloom.session import cut_lineage

MOST = 2.0  # copies of a document, and with that of a source
SHARE = 1.5  # tokens of the mix per token of the corpus
CYCLE = (5, 2, 1)  # weights of the sources in the order of their names
ROUNDS = 40  # Newton steps at most; five or six are usual
CLOSE = 2e-6  # relative gap of a solved source, just above what rounded rates leave
UNIT = 1_000_000  # rates are whole millionths of a copy, so that running sums are exact
REPAIRS = 4


def word_count(text: Column) -> Column:
    return F.size(F.filter(pieces(text, SPACE_RUN), lambda w: w != ""))


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """``source, total, weight``: weights repeat over the sources in code point order, null last."""
    ranked = running_total(sources.withColumn("__null", F.col("source").isNull()), ["__null", "source"], F.lit(1), "__rank")
    turn = F.pmod(F.col("__rank") - 1, F.lit(len(cycle))).cast("int")
    return ranked.select("source", "total", F.get(F.array(*[F.lit(float(c)) for c in cycle]), turn).alias("weight"))


def source_targets(weighted: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, total, target``: the share of all tokens split by weight, at most ``most`` times a source.

    What a full source leaves is split again by weight, until none is above.
    """
    state = cut_lineage(weighted.withColumn("full", F.col("total") <= 0))
    whole = share * (state.agg(F.sum("total").alias("t")).first()["t"] or 0)
    while True:
        now = state.agg(
            F.coalesce(F.sum(F.when(F.col("full"), most * F.col("total"))), F.lit(0.0)).alias("used"),
            F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0.0)).alias("weights"),
        ).first()
        unit = max(whole - now["used"], 0.0) / now["weights"] if now["weights"] else 0.0
        target = F.when(F.col("full"), most * F.col("total")).otherwise(F.col("weight") * unit)
        over = ~F.col("full") & (F.col("weight") * unit > most * F.col("total"))
        if state.filter(over).isEmpty():
            return cut_lineage(state.select("source", "total", target.cast("double").alias("target")))
        state = cut_lineage(state.withColumn("full", F.col("full") | over))


def balanced_rates(cells: DataFrame, targets: DataFrame, most: float = MOST, rounds: int = ROUNDS) -> DataFrame:
    """``source, total, target, scale, multiplier``, from which ``rate`` follows.

    Entropy balancing keeps the rates as close to one copy as the token
    constraint allows: a document of size x gets min(most, exp(multiplier * x /
    scale)). The convex dual is solved for all sources at once by Newton steps
    on sums over ``cells`` (source, size, n); a step that leaves the bracket
    known so far is replaced by its middle.
    """
    scale = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean")).withColumnRenamed("source", "s")
    state = targets.join(scale, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "total", "target", F.greatest("mean", F.lit(1.0)).alias("scale"), F.lit(0.0).alias("multiplier"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"),
    )
    units = F.round(rate(F.col("size"), most) * UNIT)
    tokens = (F.col("n") * F.col("size") * units.cast("long")).cast("decimal(38,0)")  # sums are exact in any order
    inner = F.when(units < most * UNIT, tokens * F.col("size").cast("decimal(18,0)")).otherwise(F.lit(0))
    state = cut_lineage(state.withColumn("done", (F.col("target") <= 0) | (F.col("target") >= most * F.col("total"))))
    for _ in range(rounds):
        sides = cells.withColumnRenamed("source", "s").join(state.filter("not done"), F.col("s").eqNullSafe(F.col("source")))
        sums = sides.groupBy("s").agg((F.sum(tokens) / UNIT).cast("double").alias("value"), (F.sum(inner.cast("decimal(38,0)")) / UNIT).cast("double").alias("bend"))
        step = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
        gap = F.col("value") - F.col("target")
        lo = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("hi"))
        newton = F.col("multiplier") - gap * F.col("scale") / F.when(F.col("bend") > 0, F.col("bend"))
        middle = F.when(lo < -1e5, F.col("multiplier") * 2 - 1).when(hi > 1e5, F.col("multiplier") * 2 + 1).otherwise((lo + hi) / 2)
        moved = F.when((newton > lo) & (newton < hi), newton).otherwise(middle)
        finished = F.col("done") | (F.abs(gap) <= F.greatest(CLOSE * F.col("target"), F.lit(1e-3)))
        state = cut_lineage(
            step.select("source", "total", "target", "scale", F.when(finished, F.col("multiplier")).otherwise(moved).alias("multiplier"), F.coalesce(lo, F.col("lo")).alias("lo"), F.coalesce(hi, F.col("hi")).alias("hi"), finished.alias("done"))
        )
        if state.filter("not done").isEmpty():
            break
    return state.select("source", "total", "target", "scale", "multiplier")


def rate(size: Column, most: float) -> Column:
    """Copies of a document; all of a full source, none of an empty target."""
    tilt = F.least(F.lit(most), F.exp(F.least(F.col("multiplier") * size / F.col("scale"), F.lit(50.0))))
    return F.when(F.col("target") >= most * F.col("total"), F.lit(most)).when(F.col("target") <= 0, F.lit(0.0)).otherwise(tilt)


def mix(documents: DataFrame, share: float = SHARE, most: float = MOST, cycle: tuple[int, ...] = CYCLE, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``doc_id, source, size, source_size, target, rate, copies, taken`` for every row of ``documents``.

    ``size`` is the number of words; a null text has none. The rates are rounded
    into copies along one order of each source by size: a document gets as many
    copies as the running sum of rates passes half-way marks, so the tokens of
    any stretch are off by half a document at most. What is left of a source's
    gap is then mended by single documents. Nothing depends on a random state:
    reruns agree. A null source is a source. Equal rows share their places, and
    a document without words gets copies but takes nothing. Null ids are kept.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).cast("long").alias("size"))
    rows = cut_lineage(rows)
    cells = cut_lineage(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total"))
    targets = source_targets(cyclic_weights(sources, cycle), share, most)
    rates = balanced_rates(cells, targets, most).withColumnRenamed("source", "s")
    rated = rows.join(rates, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", F.col("total").alias("source_size"), "target", (F.round(rate(F.col("size"), most) * UNIT) / UNIT).alias("rate")
    )
    units = F.round(F.col("rate") * UNIT).cast("long")
    ordered = rated.select("*", units.alias("units"), F.col("source").isNull().alias("last"), (-F.col("size")).alias("down"), F.xxhash64("doc_id").alias("place"))
    summed = running_total(ordered, ["last", "source", "down", "place", "doc_id"], F.col("units"), "end")
    starts = summed.groupBy("source").agg(F.min(F.col("end") - F.col("units")).alias("start")).withColumnRenamed("source", "s")
    placed = summed.join(starts, F.col("source").eqNullSafe(F.col("s")))
    mark = lambda at: F.floor((at + UNIT // 2) / UNIT)
    end = F.col("end") - F.col("start")
    copies = placed.withColumn("copies", (mark(end) - mark(end - F.col("units"))).cast("long"))
    copies = cut_lineage(copies.select("doc_id", "source", "size", "source_size", "target", "rate", "copies"))
    changes = repairs(copies, most)
    same = F.col("source").eqNullSafe(F.col("c_source")) & F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("size") == F.col("c_size"))
    mended = copies.join(changes, same, "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))
    final = mended.select("doc_id", "source", "size", "source_size", "target", "rate", "copies")
    return final.withColumn("taken", F.col("copies") * F.col("size"))


def repairs(copies: DataFrame, most: float) -> DataFrame:
    """``c_source, c_id, c_size, change``: single documents that close a source's gap.

    Each round takes, in every source, the largest document that still fits the
    gap, one copy more or less; a document is changed once at most. Documents
    whose id is repeated are left alone, as a change could not tell them apart.
    """
    single = copies.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("k"), F.min("size").alias("size"), F.min("copies").alias("copies"), F.first("target").alias("target")).filter("k = 1 and size > 0")
    gaps = copies.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap")).withColumnRenamed("source", "s")
    changes = None
    for _ in range(REPAIRS):
        fits = single.join(gaps, F.col("source").eqNullSafe(F.col("s")))
        more = (F.col("gap") >= F.col("size")) & (F.col("copies") + 1 <= most)
        less = (F.col("gap") <= -F.col("size")) & (F.col("copies") >= 1)
        best = fits.filter(more | less).groupBy("source").agg(F.max(F.struct("size", "doc_id")).alias("b"), F.first("gap").alias("gap"))
        chosen = cut_lineage(best.select(F.col("source").alias("c_source"), F.col("b.doc_id").alias("c_id"), F.col("b.size").alias("c_size"), F.signum("gap").cast("long").alias("change")))
        changes = chosen if changes is None else changes.union(chosen)
        done = chosen.select(F.col("c_source").alias("d"), (F.col("change") * F.col("c_size")).alias("by"))
        gaps = cut_lineage(gaps.join(done, F.col("s").eqNullSafe(F.col("d")), "left").select("s", (F.col("gap") - F.coalesce("by", F.lit(0))).alias("gap")))
        used = chosen.select("c_source", "c_id")
        single = single.join(used, F.col("source").eqNullSafe(F.col("c_source")) & F.col("doc_id").eqNullSafe(F.col("c_id")), "left_anti")
    return changes
