"""The best documents for every item by weighted terms, with a search over two hierarchies.

Documents become shards of packed postings, as many as there are chunks of
text: the hash of a term, the document and how often it occurs there. Only terms
in a bitmap of the items' terms are kept; the bitmap has a fixed size, and a
term that is in it by chance meets no item later. Items become blocks of packed
coordinates, a weight for each of their terms.

Both sides of a shard and a block are hierarchies whose nodes hold the maximum
of every coordinate over their members. The product of two nodes bounds the
score of every item of the one with every document of the other, so a pair of
nodes below the weakest k-th score among its items goes as a whole, and no
result with it. Two passes: the first scores each item's most promising batch
of every shard, which gives k-th scores that hold for the whole corpus; the
second searches with these, and they rise as a task goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from clickloom.llm.heaps import Heaps
from clickloom.llm.order import running_total
from clickloom.llm.packed import CHUNK_BYTES, chunks, word_hashes
from clickloom.session import cut_lineage

NO_ID = 2**63 - 1  # stands for a null document id, behind all others
BITS = 23  # of the bitmap: 1 MB, whatever the number of items
BLOCK_BYTES = 2_000_000  # of items in a block, with ITEM_BYTES for each
ITEM_BYTES = 2_000
FAN_DOCUMENTS, FAN_ITEMS = 16, 8
SHARDS_PER_COPY = 8  # shards that meet the same copy of a block of items
SHARD = "n_docs bigint, n_terms bigint, ids binary, sizes binary, terms binary, counts binary, docs binary, tfs binary"
ITEM_TERMS = "block bigint, place bigint, term bigint, times bigint"
BLOCK = "block bigint, items binary, least binary, owners binary, terms binary, values binary"
FOUND = "place bigint, score bigint, doc_id bigint"
#: Word bytes, with capitals made small, and a space for all others.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counted(texts: list[bytes], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, the text and the number of times of each, by term and text; and the number of terms of each text."""
    hashes, sizes = word_hashes([t.translate(FOLD) for t in texts], lower=False)
    owners = np.repeat(np.arange(len(texts)), sizes)
    if keep is not None:
        some = keep[hashes >> np.uint64(64 - BITS)]
        hashes, owners = hashes[some], owners[some]
    order = np.lexsort((owners, hashes))
    hashes, owners = hashes[order], owners[order]
    first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])])[: len(hashes)])
    return hashes[first], owners[first], np.diff(first, append=len(hashes)), sizes


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.encode() for t in batch.column(2).to_pylist()]
        terms, owners, times, _ = _counted(texts)
        block, place = (batch.column(i).to_numpy()[owners] for i in (0, 1))
        yield _batch(ITEM_TERMS, [block, place, terms.view(np.int64), times])


def _shard(bitmap: bytes, chunk: int):
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").astype(bool)
        for ids, texts in chunks(batches, chunk):
            terms, docs, tfs, sizes = _counted(texts, keep)
            first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])[: len(terms)])
            arrays = [np.array([NO_ID if i is None else i for i in ids], np.int64), sizes.astype(np.int64), terms[first], np.diff(first, append=len(terms)).astype(np.int32), docs.astype(np.int32), tfs.astype(np.int32)]
            yield _batch(SHARD, [[int((sizes > 0).sum())], [int(sizes.sum())], *([a.tobytes()] for a in arrays)])

    return shard


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for terms, counts in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
            yield _batch("term bigint, df bigint", [np.frombuffer(terms, np.int64), np.frombuffer(counts, np.int32).astype(np.int64)])


def _item_block(table: pa.Table) -> pa.Table:
    """The coordinates of the items of one block in one row."""
    table = table.sort_by([("place", "ascending"), ("term", "ascending")])
    places, owners = np.unique(table.column("place").to_numpy(), return_inverse=True)
    least = np.zeros(len(places), np.int64)
    least[owners] = table.column("least").to_numpy()
    arrays = [places, least, owners.astype(np.int32), table.column("term").to_numpy(), table.column("value").to_numpy()]
    return pa.Table.from_batches([_batch(BLOCK, [[table.column("block")[0].as_py()], *([a.tobytes()] for a in arrays)])])


class Hierarchy:
    """Levels of sparse coordinates: level 0 has the members, each next one joins ``fan`` neighbours and takes maxima.

    Members stand in the order of the coordinate that weighs most, so that
    neighbours share it.
    """

    def __init__(self, members: np.ndarray, terms: np.ndarray, values: np.ndarray, weights: np.ndarray, n: int, n_terms: int, fan: int):
        strongest = np.zeros(n, np.int64)
        by = np.lexsort((values * weights[terms], members))
        strongest[members[by]] = terms[by]  # the last assignment of a member stays
        self.order = np.argsort(strongest, kind="stable")
        rank = np.empty(n, np.int64)
        rank[self.order] = np.arange(n)
        self.fan, self.n_terms, self.sizes, self.levels = fan, n_terms, [n], []
        nodes = rank[members]
        while True:
            by = np.lexsort((nodes, terms))
            terms, nodes, values = terms[by], nodes[by], values[by]
            first = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (nodes[1:] != nodes[:-1])])[: len(terms)])
            terms, nodes, values = terms[first], nodes[first], np.maximum.reduceat(values, first) if len(first) else values
            self.levels.append((terms, nodes, values, np.searchsorted(terms, np.arange(n_terms + 1))))
            if self.sizes[-1] <= 1:
                break
            nodes = nodes // fan
            self.sizes.append(-(-self.sizes[-1] // fan))

    def coordinates(self, level: int, node: int) -> tuple[np.ndarray, np.ndarray]:
        terms, nodes, values, _ = self.levels[level]
        own = np.flatnonzero(nodes == node)
        return terms[own], values[own]

    def products(self, level: int, terms: np.ndarray, values: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """The inner product of the given coordinates with every living node of a level."""
        _, nodes, own, starts = self.levels[level]
        n = starts[terms + 1] - starts[terms]
        at = np.arange(int(n.sum())) + np.repeat(starts[terms] - np.cumsum(n) + n, n)
        some = alive[nodes[at]]
        at, times = at[some], np.repeat(values, n)[some]
        out = np.zeros(self.sizes[level], np.int64)
        np.add.at(out, nodes[at], times * own[at])
        return out

    def below(self, level: int, alive: np.ndarray) -> np.ndarray:
        """The living nodes of the next lower level."""
        return np.repeat(alive, self.fan)[: self.sizes[level - 1]]


class Search:
    """One shard against one block of items."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        vocabulary, item_terms = np.unique(read("b_terms", np.int64), return_inverse=True)
        items = read("b_items", np.int64)
        values = read("b_values", np.int64)
        heaviest = np.zeros(len(vocabulary), np.int64)
        np.maximum.at(heaviest, item_terms, values)
        self.items = Hierarchy(read("b_owners", np.int32), item_terms, values, np.ones(len(vocabulary), np.int64), len(items), len(vocabulary), FAN_ITEMS)
        terms, counts = read("terms", np.int64), read("counts", np.int32)
        at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
        known = np.repeat(vocabulary[at] == terms, counts)
        terms, docs, tfs = np.repeat(at, counts)[known], read("docs", np.int32)[known].astype(np.int64), read("tfs", np.int32)[known].astype(np.int64)
        sizes = read("sizes", np.int64)
        gains = 1_000_000_000 * tfs // (1_000 * tfs + 12 * (75 + 25 * sizes * n_docs // max(n_terms, 1))[docs])
        self.docs = Hierarchy(docs, terms, gains, heaviest, len(sizes), len(vocabulary), FAN_DOCUMENTS)
        self.ids, self.places = read("ids", np.int64)[self.docs.order], items[self.items.order]
        self.least = read("b_least", np.int64)[self.items.order]

    def keep(self, heaps: Heaps, item: int, scores: np.ndarray) -> None:
        """Take what can be among the best of an item, and raise its k-th score."""
        place = int(self.places[item])
        some = np.flatnonzero(scores >= max(1, self.least[item]))
        if len(some):
            heaps.add(place, scores[some], self.ids[some])
            self.least[item] = max(self.least[item], heaps.weakest(place) or 0)

    def probe(self, heaps: Heaps) -> None:
        """For every item, the scores of the batch of documents with the highest bound."""
        level = min(1, len(self.docs.sizes) - 1)
        for item in range(len(self.places)):
            own = self.items.coordinates(0, item)
            bounds = self.docs.products(level, *own, np.ones(self.docs.sizes[level], bool))
            if bounds.max(initial=0) > 0:
                alive = np.arange(len(bounds)) == bounds.argmax()
                self.keep(heaps, item, self.docs.products(0, *own, self.docs.below(1, alive) if level else alive))

    def run(self, heaps: Heaps) -> None:
        """All documents that can be among the best of an item."""
        top = len(self.docs.sizes) - 1
        for item, place in enumerate(self.places.tolist()):
            self.least[item] = max(self.least[item], heaps.weakest(place) or 0)
        if self.docs.sizes[0]:
            self.visit(heaps, len(self.items.sizes) - 1, 0, top, np.ones(self.docs.sizes[top], bool))

    def visit(self, heaps: Heaps, level: int, node: int, depth: int, alive: np.ndarray) -> None:
        bounds = self.docs.products(depth, *self.items.coordinates(level, node), alive)
        if level == depth == 0:
            return self.keep(heaps, node, bounds)
        width = FAN_ITEMS**level
        alive = alive & (bounds >= max(1, self.least[node * width : (node + 1) * width].min()))
        if not alive.any():
            return None
        if depth:
            alive, depth = self.docs.below(depth, alive), depth - 1
        for child in range(node * FAN_ITEMS, min((node + 1) * FAN_ITEMS, self.items.sizes[level - 1])) if level else [node]:
            self.visit(heaps, max(level - 1, 0), child, depth, alive)
        return None


def _search(k: int, n_docs: int, n_terms: int, probe: bool):
    """Heaps of the items over the shards that come by, block after block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, heaps = None, Heaps(k)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["b_block"] != block:
                    if rows := heaps.rows():
                        yield _batch(FOUND, list(zip(*rows)))
                    block, heaps = row["b_block"], Heaps(k)
                one = Search(row, n_docs, n_terms)
                one.probe(heaps) if probe else one.run(heaps)
        if rows := heaps.rows():
            yield _batch(FOUND, list(zip(*rows)))

    return search


def _met(shards: DataFrame, blocks: DataFrame, n_shards: int) -> DataFrame:
    """Every shard next to every block of items, block after block in a task.

    A block goes out in a copy for every few shards, so that no key has them all.
    """
    copies = -(-n_shards // SHARDS_PER_COPY)
    named = blocks.select([F.col(c).alias(f"b_{c}") for c in blocks.columns])
    dealt = named.withColumn("b_copy", F.explode(F.sequence(F.lit(0), F.lit(max(copies - 1, 0)))))
    numbers = F.array_sort(F.collect_list("block"))
    every = blocks.agg(numbers.alias("every")).scalar()
    sides = shards.withColumn("a_block", F.explode(every)).withColumn("a_copy", F.pmod(F.xxhash64("ids", "sizes"), F.lit(max(copies, 1))).cast("int"))
    met = sides.join(dealt, (F.col("a_block") == F.col("b_block")) & (F.col("a_copy") == F.col("b_copy")))
    return met.drop("a_block", "a_copy", "b_copy").sortWithinPartitions("b_block")


def search(documents: DataFrame, items: DataFrame, k: int = 20, chunk: int = CHUNK_BYTES, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item, those of score 0 left out.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, with
    A to Z made small. With N documents that have a term, L terms in all, n
    terms in a document and df documents with a term, a term weighs
    ``floor(1000 * ln((2N + 2) / (2 df + 1)))``, and a document scores
    ``weight * (10**9 tf div (1000 tf + 12 m))``, ``m = 75 + 25 n N div L``, summed
    over the item's terms with repeats. Equal scores are ranked by smaller id.

    Null and empty texts have no terms: such documents count nowhere and such
    items have no rows. Each row is a document or an item of its own, also
    where ids repeat. Null document ids come last among equal scores; other
    columns are not read. Terms are compared by 64-bit hashes: with V terms of
    items and T of documents, about V * T / 2**64 are taken for another.
    A task holds a chunk of text, or a shard and a block; a text is whole in
    its shard.
    """
    texts = items.select(F.col(item_col).alias("item_id"), F.coalesce(item_text_col, F.lit("")).alias("text"))
    used = F.octet_length("text") + ITEM_BYTES
    numbered = running_total(running_total(texts, ["item_id", "text"], F.lit(1), "place"), ["place"], used, "used")
    numbered = cut_lineage(numbered.withColumn("block", F.floor((F.col("used") - used) / block_bytes)))
    wanted = cut_lineage(numbered.select("block", "place", "text").mapInArrow(_item_terms, ITEM_TERMS))

    position = F.shiftrightunsigned("term", 64 - BITS) + 1
    pages = wanted.select(F.bitmap_bucket_number(position).alias("page"), F.bitmap_bit_position(position).alias("bit"))
    bitmap = bytearray(2 ** (BITS - 3))
    for r in pages.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():  # at most 2 ** BITS bits
        bitmap[(r.page - 1) * len(r.bits) : r.page * len(r.bits)] = r.bits

    rows = documents.select(F.col(id_col).cast("long"), F.col(text_col))
    shards = cut_lineage(rows.mapInArrow(_shard(bytes(bitmap), chunk), SHARD))
    n_shards, n_docs, n_terms = shards.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = shards.select("terms", "counts").mapInArrow(_frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weighed = cut_lineage(wanted.join(df, "term").select("block", "place", "term", (F.col("times") * weight).alias("value")).filter("value > 0"))

    pack = lambda least: weighed.join(least, "place", "left").withColumn("least", F.coalesce("least", F.lit(0).cast("long"))).groupBy("block").applyInArrow(_item_block, BLOCK)
    none = weighed.select("place", F.lit(0).cast("long").alias("least")).limit(0)
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "doc_id"))
    best = lambda found: found.withColumn("rank", rank).filter(F.col("rank") <= k)
    probed = best(_met(shards, cut_lineage(pack(none)), n_shards).mapInArrow(_search(k, n_docs, n_terms, True), FOUND))
    least = probed.filter(F.col("rank") == k).select("place", F.col("score").alias("least"))
    found = best(_met(shards, cut_lineage(pack(least)), n_shards).mapInArrow(_search(k, n_docs, n_terms, False), FOUND))
    named = found.join(numbered.select("place", "item_id"), "place")
    return named.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
