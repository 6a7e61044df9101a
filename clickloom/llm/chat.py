"""Conversations from reply trees: path enumeration, branch ranking and formatting, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.llm.text import let
from clickloom.session import cut_lineage

START, STOP = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """Text without the opening of a control string; backslashes are doubled, so that it can be undone."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escaped_role(role: Column) -> Column:
    """A role in one line."""
    marks = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"))
    for plain, code in marks:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescaped_role(role: Column) -> Column:
    for plain, code in (("\n", "%0A"), ("<", "%3C"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def ancestors(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Doubling self-joins over ``id, parent, score``.

    Returns the hops of 1, 2, 4, ... steps and one row per node with its root,
    depth and the score of the path from the root. Every round joins the hop
    table with itself; long chains take as many rounds as their length has bits.
    """
    hop = cut_lineage(nodes.select("id", F.col("parent").alias("up")))
    state = cut_lineage(nodes.select("id", F.col("parent").alias("up"), F.col("id").alias("root"), F.lit(0).alias("depth"), F.col("score").cast("double").alias("total")))
    hops = [hop]
    step = 1
    while not state.filter("up is not null").isEmpty():
        above = state.select(F.col("id").alias("a"), F.col("up").alias("a_up"), F.col("root").alias("a_root"), F.col("depth").alias("a_depth"), F.col("total").alias("a_total"))
        # Rows that are done have no key; joined, they would all meet in one task.
        joined = state.filter("up is not null").join(above, F.col("up") == F.col("a"), "left")
        state = cut_lineage(
            state.filter("up is null").unionByName(joined.select(
                "id", F.col("a_up").alias("up"), F.coalesce("a_root", "root").alias("root"), (F.col("depth") + F.when(F.col("a").isNotNull(), F.col("a_depth") + 1).otherwise(0)).alias("depth"), (F.col("total") + F.coalesce("a_total", F.lit(0.0))).alias("total")
            ))
        )
        step *= 2
        last = hops[-1]
        again = last.select(F.col("id").alias("b"), F.col("up").alias("b_up"))
        hops.append(cut_lineage(last.join(again, F.col("up") == F.col("b")).select("id", F.col("b_up").alias("up")).filter("up is not null")))
    return hops, state.select("id", "root", "depth", "total")


def best_paths(nodes: DataFrame, per_root: int = 1) -> DataFrame:
    """``leaf, rank, id, depth``: the nodes of the best root-to-leaf paths of every tree.

    Branches are ranked by the sum of their scores, then by length, then by leaf
    id. From the chosen leaves all ancestors are reached by taking every hop
    length once, longest first.
    """
    hops, placed = ancestors(nodes)
    inner = nodes.select(F.col("parent").alias("id")).filter("id is not null").distinct()
    leaves = placed.join(inner, "id", "left_anti")
    if per_root == 1:
        best = leaves.groupBy("root").agg(F.min(F.struct((-F.col("total")).alias("t"), (-F.col("depth")).alias("d"), "id")).alias("b"))
        chosen = best.select(F.col("b.id").alias("leaf"), F.lit(1).alias("rank"))
    else:
        order = Window.partitionBy("root").orderBy(F.desc("total"), F.desc("depth"), "id")
        chosen = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_root).select(F.col("id").alias("leaf"), "rank")
    reached = cut_lineage(chosen.withColumn("id", F.col("leaf")))
    for hop in reversed(hops):
        more = reached.join(hop, "id").filter("up is not null").select("leaf", "rank", F.col("up").alias("id"))
        reached = cut_lineage(reached.union(more).distinct())
    return reached.join(placed.select("id", "root", "depth"), "id")


def format_conversations(messages: DataFrame, per_root: int = 1, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, rank, formatted, loss`` of the best branches of every reply tree.

    ``messages`` has ``conv_id, id, parent, score, role, text``; ids are unique,
    a parent is null at a root. ``loss`` lists the spans (start, end exclusive,
    code points of ``formatted``) of the escaped texts of ``loss_roles``. Null
    roles and texts are empty, null scores count nothing, and a parent that
    does not exist makes a root. Trees of one ``conv_id`` are conversations of
    their own. Only ids take part in the joins; each chosen path is then put
    together as one conversation, which is the unit of the output.
    """
    # A key of strings and a missing parent are settled first, so that every chain ends at a root.
    ids = messages.select(F.col("id").alias("known")).distinct()
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    answers = messages.filter("parent is not null").join(ids, F.col("parent") == F.col("known"), "left").select("id", F.col("known").alias("parent"), score)
    roots = messages.filter("parent is null").select("id", F.lit(None).cast(messages.schema["id"].dataType).alias("parent"), score)
    linked = answers.unionByName(roots)
    paths = best_paths(linked, per_root)
    said = messages.select("id", "conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(said, "id").select("conv_id", "leaf", "rank", "depth", escaped_role(F.col("role")).alias("head"), escaped(F.col("text")).alias("body"), F.col("role").isin(*loss_roles).alias("learn"))
    groups = turns.groupBy("conv_id", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "head", "body", "learn"))).alias("turns"))
    piece = lambda t: F.concat(F.lit(START), t["head"], F.lit("\n"), t["body"], F.lit(f"{STOP}\n"))
    pieces = F.transform("turns", piece)
    marked = groups.select("conv_id", "leaf", "rank", "turns", pieces.alias("pieces")).select("conv_id", "leaf", "rank", "turns", F.array_join("pieces", "").alias("formatted"), F.transform("pieces", lambda p: F.char_length(p)).alias("sizes"))
    spans = F.aggregate(
        F.zip_with("turns", "sizes", lambda t, n: F.struct(t["head"].alias("head"), t["body"].alias("body"), t["learn"].alias("learn"), n.alias("n"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda s, x: F.struct(
            (s["at"] + x["n"]).alias("at"),
            F.when(
                x["learn"],
                F.concat(s["spans"], F.array(F.struct((s["at"] + len(START) + 1 + F.char_length(x["head"])).alias("start"), (s["at"] + x["n"] - len(STOP) - 1).alias("end")))),
            ).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return marked.select("conv_id", "leaf", "rank", "formatted", spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` rows with ``turns`` (role, text) parsed from the text and ``learned``, the text under the mask."""
    parts = let(F.split("formatted", r"\Q" + START + r"\E"), lambda p: F.slice(p, 2, F.size(p) - 1))
    role = lambda p: F.substring_index(p, "\n", 1)
    body = lambda p: F.substring(p, F.char_length(role(p)) + 2, F.char_length(p) - F.char_length(role(p)) - 2 - len(STOP))
    turn = lambda p: F.struct(unescaped_role(role(p)).alias("role"), unescaped(body(p)).alias("text"))
    learned = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("*", F.transform(parts, turn).alias("turns"), F.array_join(learned, "").alias("learned"))


def chains(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Rows of plain conversations as reply trees: each turn answers the one before.

    Rows of a conversation are numbered by turn, ties by role and text, null
    turns first; repeated rows are turns of their own. Conversations hold few
    rows each, but a null ``conv_id`` is one conversation as well.
    """
    order = Window.partitionBy(conv_col).orderBy(turn_col, "role", "text")
    numbered = conversations.withColumn("__n", F.row_number().over(order))
    name = lambda n: F.concat_ws(":", F.coalesce(F.col(conv_col).cast("string"), F.lit("")), n)
    parent = F.when(F.col("__n") > 1, name(F.col("__n") - 1))
    return numbered.select(F.col(conv_col).alias("conv_id"), name(F.col("__n")).alias("id"), parent.alias("parent"), F.lit(1.0).alias("score"), "role", "text")
