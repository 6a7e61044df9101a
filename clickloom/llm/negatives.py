"""Hard negatives by exact integer inner products, block against block.

Rows lie in the order (label, id) in blocks of bounded size; anchors, the query
set, are dealt into tiles in the same way. The scores of a tile of anchors and a
block of candidates are one matrix product, by Strassen's recursion on 64-bit
integers. A first pass keeps for every anchor a heap of its best rows of its own
label and visits only blocks that hold such labels. A second pass has the scores
of these positives and keeps a heap for each score window of an anchor, over
rows of other labels. Heaps of the same anchor merge, inside a task as blocks
come by and between tasks by rank, so no task needs more than a tile, a block
and the heaps of the tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.llm.heaps import Heaps
from clickloom.llm.order import running_total
from clickloom.session import cut_lineage

BLOCK = 8_192  # candidates of a block
TILE = 512  # anchors of a tile
RUN = 16  # blocks that a task takes one after the other for one tile
LEAF = 32  # below this width of any side, Strassen's recursion ends
PACKED = "lo bigint, hi bigint, ids binary, labels binary, width int, parts binary"
FOUND = "anchor bigint, window_score bigint, score bigint, vec_id bigint"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` modulo 2 ** 64, in seven products of half the size instead of eight; odd sides get a row or column of zeros."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, h = a.shape[0] // 2, b.shape[1] // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :h], a[:i, h:], a[i:, :h], a[i:, h:]
    b11, b12, b21, b22 = b[:h, :j], b[:h, j:], b[h:, :j], b[h:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * j), np.int64)
    out[:i, :j], out[:i, j:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :j], out[i:, j:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def _rows(heaps: Heaps) -> Iterator[pa.RecordBatch]:
    if rows := [(anchor, window, score, i) for (anchor, window), score, i in heaps.rows()]:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[c.split()[0] for c in FOUND.split(", ")])


def prepared(embeddings: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, parts`` of the rows that take part; components as integers."""
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    floored = F.transform("vector", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(2.0**62)), F.lit(-(2.0**62)))))
    return rows.filter(usable & F.coalesce(finite, F.lit(False))).select("vec_id", "label", floored.alias("parts"))


def _pack(table: pa.Table) -> pa.Table:
    """One row for a block: ids, labels and components, shorter vectors filled up with zeros."""
    table = table.sort_by([("place", "ascending")])
    ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
    lists = table.column("parts").combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    width = max(1, int(n.max()))
    values = np.zeros((len(ids), width), np.int64)
    values[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy()
    row = {"block": table.column("block")[0].as_py(), "lo": int(labels.min()), "hi": int(labels.max()), "ids": ids.tobytes(), "labels": labels.tobytes(), "width": width, "parts": values.tobytes()}
    if "windows" in table.column_names:
        row["places"] = table.column("place").to_numpy().tobytes()
        row["windows"] = [w or [] for w in table.column("windows").to_pylist()]
    kinds = {"block": pa.int64(), "lo": pa.int64(), "hi": pa.int64(), "width": pa.int32(), "windows": pa.list_(pa.list_(pa.int64()))}
    return pa.table({k: pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()})


def placed(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` numbered from 0 in the order (label, id), and the block of each."""
    numbered = running_total(rows, ["label", "vec_id"], F.lit(1), "place").withColumn("place", F.col("place") - 1)
    return numbered.withColumn("block", F.floor(F.col("place") / size))


def _matrix(row: dict, name: str, width: int) -> np.ndarray:
    have = np.frombuffer(row[f"{name}_parts"], np.int64).reshape(-1, row[f"{name}_width"])
    return np.pad(have, ((0, 0), (0, width - have.shape[1])))


def _search(k: int, visit: Callable):
    """Heaps of every tile over the blocks that come by; rows of one tile follow each other."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, heaps = None, Heaps(k)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["a_block"] != tile:
                    yield from _rows(heaps)
                    tile, heaps = row["a_block"], Heaps(k)
                width = max(row["a_width"], row["c_width"])
                scores = strassen(_matrix(row, "a", width), _matrix(row, "c", width).T)
                sides = [[np.frombuffer(row[f"{s}_{c}"], np.int64) for c in ("ids", "labels")] for s in "ac"]
                visit(heaps, row, scores, *sides)
        yield from _rows(heaps)

    return search


def _positives(heaps: Heaps, row: dict, scores: np.ndarray, anchors: list, candidates: list) -> None:
    """Rows of the anchor's label and of another id; of each label the candidates are one run."""
    places, (ids, labels) = np.frombuffer(row["a_places"], np.int64), candidates
    first, last = np.searchsorted(labels, anchors[1], "left"), np.searchsorted(labels, anchors[1], "right")
    for i, (place, own) in enumerate(zip(places.tolist(), anchors[0])):
        some, near = scores[i, first[i] : last[i]], ids[first[i] : last[i]]
        if (near == own).any():
            some, near = some[near != own], near[near != own]
        if len(near):
            heaps.add((place, None), some, near)


def _negatives(low: int, high: int):
    def visit(heaps: Heaps, row: dict, scores: np.ndarray, anchors: list, candidates: list) -> None:
        """Rows of other labels whose score lies in a window below a positive's score."""
        places, (ids, labels) = np.frombuffer(row["a_places"], np.int64), candidates
        first, last = np.searchsorted(labels, anchors[1], "left"), np.searchsorted(labels, anchors[1], "right")
        for i, (place, windows) in enumerate(zip(places.tolist(), row["a_windows"])):
            if not windows or last[i] - first[i] == len(ids):
                continue
            some, near = (np.concatenate([x[: first[i]], x[last[i] :]]) for x in (scores[i], ids))
            for score in windows:
                fits = np.flatnonzero((some >= -(-low * score // 100)) & (some <= high * score // 100))
                if len(fits):
                    heaps.add((place, score), some[fits], near[fits])

    return visit


def _paired(tiles: DataFrame, blocks: DataFrame, meet: Column) -> DataFrame:
    """Packed tiles next to the packed blocks that they meet, dealt by tile and run of ``RUN`` blocks, tile after tile."""
    side = lambda df, s: df.select([F.col(c).alias(f"{s}_{c}") for c in df.columns])
    a, c = side(tiles, "a"), side(blocks, "c")
    ranges = lambda df, s: df.select(f"{s}_block", f"{s}_lo", f"{s}_hi")
    n_blocks = c.count()  # one row each; they are numbered from 0
    every = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks).cast("long")), lambda i: i < n_blocks)
    pairs = ranges(a, "a").withColumn("c_block", F.explode(every)).join(ranges(c, "c"), "c_block").filter(meet).select("a_block", "c_block")
    both = pairs.join(a, "a_block").join(c, "c_block")
    return both.repartition("a_block", F.floor(F.col("c_block") / RUN)).sortWithinPartitions("a_block")


def _merged(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The best ``k`` rows under each key over all tasks, with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(
    embeddings: DataFrame,
    anchors: Column,
    k_positives: int = 5,
    k_negatives: int = 5,
    window: tuple[int, int] = (80, 100),
    scale: int = 256,
    block: int = BLOCK,
    tile: int = TILE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on ``vec_id`` and ``label`` that picks the
    anchors. A row's score is the inner product with the anchor of the
    components ``floor(scale * x)``; higher scores come first, ties by smaller
    id. The positives of an anchor are its first ``k_positives`` rows of the
    same label and another id; for each, the first ``k_negatives`` rows of other
    labels follow whose scores are at least ``window[0]`` and at most
    ``window[1]`` hundredths of the positive's.

    Rows with a null id, label, vector or component or a component that is not
    finite take no part. A vector shorter than others ends in zeros, an empty one
    scores 0. Components beyond 2 ** 62 in size are cut to that, and scores are
    integers modulo 2 ** 64. Rows that share an id all count; each anchor row
    has its own result. Positives without a row in the window have none, and
    other columns are not read. Every anchor meets every row, in blocks, so the
    work is anchors times rows and each pair is multiplied once or, where a
    block holds the anchor's label and others, twice.
    """
    rows = cut_lineage(placed(prepared(embeddings, scale, id_col, vector_col, label_col), block))
    blocks = cut_lineage(rows.groupBy("block").applyInArrow(_pack, f"block bigint, {PACKED}"))
    chosen = rows.filter(anchors).select("vec_id", "label", "parts", F.col("place").alias("at"))
    queries = cut_lineage(placed(chosen, tile).withColumn("windows", F.array().cast("array<bigint>")))
    packed = f"block bigint, {PACKED}, places binary, windows array<array<bigint>>"

    tiles = queries.groupBy("block").applyInArrow(_pack, packed)
    same = (F.col("a_lo") <= F.col("c_hi")) & (F.col("c_lo") <= F.col("a_hi"))
    first = _paired(tiles, blocks, same).mapInArrow(_search(k_positives, _positives), FOUND)
    positives = cut_lineage(_merged(first, k_positives, "anchor"))

    windows = positives.groupBy(F.col("anchor").alias("place")).agg(F.collect_set("score").alias("windows"))
    tiles = queries.drop("windows").join(windows, "place").groupBy("block").applyInArrow(_pack, packed)
    other = ~((F.col("a_lo") == F.col("c_hi")) & (F.col("c_lo") == F.col("a_hi")) & (F.col("a_lo") == F.col("a_hi")))
    second = _paired(tiles, blocks, other).mapInArrow(_search(k_negatives, _negatives(*window)), FOUND)
    negatives = _merged(second, k_negatives, "anchor", "window_score").select("anchor", "window_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))

    named = queries.select(F.col("place").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    chosen = positives.select("anchor", F.col("rank").alias("positive_rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    met = chosen.join(negatives, (chosen["anchor"] == negatives["anchor"]) & (F.col("positive_score") == F.col("window_score"))).drop(negatives["anchor"])
    return met.join(named, "anchor").select("anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score")
