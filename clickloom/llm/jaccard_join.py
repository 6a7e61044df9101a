"""Self-join of documents on the Jaccard similarity of their word shingles.

Token-combination prefixes. Shingles are counted over all distinct sets, and the
global order of a set's shingles is: those found nowhere else, then rare ones,
then common ones, by hash within each class. Two sets that reach 3/4 share a
shingle in their first n - ceil(3n/4) + 1 shingles. If that prefix of a set ends
among its rare shingles, they are indexed one by one. If it reaches into the
common ones, the prefix is extended until similar sets share so many shingles in
it that two shared common ones must stand next to each other, and neighbouring
pairs of common shingles are indexed as one key.

Why a pair suffices: sets of n and m shingles that reach 3/4 differ in at most
d = (n + m) / 7 <= n / 3 shingles and share at least 3d. A prefix extended by
n / 3 + 2 holds d + 2 shared ones, or the set ends first. If no rare one is
among them, d + 2 shared common shingles lie in one order with at most d others
between them, so at least two of them are neighbours in both sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from clickloom.llm.packed import PACKED, chunks, listed, packed, unpacked, windows
from clickloom.plans.graph import connected_components
from clickloom.session import cut_lineage

WIDTH = 5
COMMON = 16  # a shingle of more distinct sets than this is indexed in pairs
SMALL = 16  # tokens of at most so many sets are compared as pairs, larger ones in blocks
BLOCK = 256  # sets of a block
COUNTED = 1_024  # sets of a block in which links are counted
RANGE_BYTES = 8_000_000  # text per range of hashes
LOT = 1_000  # sets of small components that one call counts
KEY = np.dtype("S16")
SETS = f"{PACKED}, ids array<bigint>"
FOUND = "doc_id bigint, key binary, n bigint, block int, packed binary"
GATHERED = "key binary, n bigint, rare array<bigint>, common array<bigint>"
#: What one range of hashes has of a set: its key and size and how many of its rare and common shingles others have too.
PIECE = np.dtype([("key", KEY), ("n", "<i8"), ("rare", "<i4"), ("common", "<i4")])


def _pack(buckets: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            hashes, n, _ = windows(texts, WIDTH, lower=True, short=True)
            ends = np.cumsum(n)
            sets = [np.unique(hashes[e - k : e]) for e, k in zip(ends, n)]
            keys = np.array([blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b"" for s in sets], KEY)
            sizes = np.array([len(s) for s in sets], np.int64)
            once = np.unique(keys, return_index=True)[1]
            once = once[sizes[once] > 0]
            if len(once):
                rows = packed(keys[once], sizes[once], np.concatenate([sets[i] for i in once]), sizes[once], buckets)
                yield rows.append_column("ids", pa.nulls(rows.num_rows, pa.list_(pa.int64())))
            lot = -1 - int(sizes.sum() + len(ids)) % buckets
            row = [[lot], [keys.tobytes()], [sizes.tobytes()], [b""], [b""], [ids]]
            kinds = [pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in SETS.split(", ")])

    return pack


def _binaries(keys: np.ndarray) -> pa.Array:
    return pa.array([k.ljust(16, b"\0") if k else None for k in keys.tolist()], pa.binary())


def _count(common: int, blocks: int):
    """Of one range of hashes: the shingles of each set that other sets have too, by class, packed by block of sets."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("block", pa.int32()), ("packed", pa.binary())])

    def count(table: pa.Table) -> pa.Table:
        keys, sizes, counts, hashes = unpacked(table, KEY)
        if table.column("bucket")[0].as_py() < 0:
            ids = table.column("ids").combine_chunks().flatten()
            return pa.Table.from_arrays([ids, _binaries(keys), pa.array(sizes), pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), pa.binary())], schema=schema)
        first = np.zeros(len(keys), bool)
        first[np.unique(keys, return_index=True)[1]] = True  # equal sets of other chunks have equal hashes here
        hashes, keys, sizes, counts = hashes[np.repeat(first, counts)], keys[first], sizes[first], counts[first]
        order = np.argsort(hashes, kind="stable")
        edges = np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order[:1]], append=~hashes[order[-1:]]))
        df = np.empty(len(hashes), np.int32)
        df[order] = np.repeat(np.diff(edges), np.diff(edges))
        del order
        block = np.array([int.from_bytes(k.ljust(8, b"\0")[:8], "little") % blocks for k in keys.tolist()], np.int64)
        by = np.argsort(block, kind="stable")
        keys, sizes, block = keys[by], sizes[by], block[by]
        place = np.empty(len(by), np.int32)
        place[by] = np.arange(len(by))
        some = np.flatnonzero(df > 1)
        often = df[some] > common
        owner = np.repeat(place, counts)[some]
        order = np.argsort(owner * 2 + often, kind="stable")  # by block and set, rare ones first
        hashes, owner, often = hashes[some[order]], owner[order], often[order]
        del some, order, df
        ends = np.flatnonzero(np.diff(owner, append=-1)) + 1
        pieces = np.zeros(len(ends), PIECE)
        of = owner[ends - 1]
        pieces["key"], pieces["n"] = keys[of], sizes[of]
        pieces["common"] = np.diff(np.cumsum(often)[ends - 1], prepend=0)
        pieces["rare"] = np.diff(ends, prepend=0) - pieces["common"]
        cuts = np.flatnonzero(np.diff(block[of], prepend=-1, append=-1))
        starts = np.concatenate([[0], ends])
        rows = [(int(block[of[i]]), len(pieces[i:j]).to_bytes(8, "little") + pieces[i:j].tobytes() + hashes[starts[i] : starts[j]].tobytes()) for i, j in zip(cuts, cuts[1:])]
        none = [pa.nulls(len(rows), f.type) for f in list(schema)[:3]]
        return pa.Table.from_arrays([*none, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)

    return count


def _gather(table: pa.Table) -> pa.Table:
    """The shared shingles of the sets of one block, in order, where they are at least 3/4 of a set."""
    pieces, hashes = [], []
    for data in table.column("packed").to_pylist():
        end = 8 + int.from_bytes(data[:8], "little") * PIECE.itemsize
        pieces.append(np.frombuffer(data[8:end], PIECE))
        hashes.append(np.frombuffer(data[end:], np.int64))
    pieces, hashes = np.concatenate(pieces), np.concatenate(hashes)
    keys, first, at = np.unique(pieces["key"], return_index=True, return_inverse=True)
    counts = np.stack([pieces["rare"], pieces["common"]], axis=1).ravel()
    often = np.repeat(np.tile([0, 1], len(pieces)), counts)
    owner = np.repeat(np.repeat(at, 2), counts)
    sizes = pieces["n"][first]
    enough = 4 * np.bincount(owner, minlength=len(keys)) >= 3 * sizes
    lists = []
    for kind in (0, 1):
        mine = (often == kind) & enough[owner]
        order = np.lexsort((hashes[mine], owner[mine]))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[mine], minlength=len(keys))[enough])])
        lists.append(listed(hashes[mine][order], offsets))
    return pa.table([_binaries(keys[enough]), pa.array(sizes[enough]), *lists], names=["key", "n", "rare", "common"])


def shared_shingles(documents: DataFrame, buckets: int, common: int = COMMON, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document (its set's key and size) and packed rows of shared shingles per block of sets and hash range."""
    rows = documents.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_pack(buckets), SETS)
    return rows.groupBy("bucket").applyInArrow(_count(common, buckets), FOUND)


def index_keys(sets: DataFrame) -> DataFrame:
    """``token, key, n``: single rare shingles of the prefix and neighbouring pairs of common ones."""
    n, least = F.col("n"), F.ceil(3 * F.col("n") / 4)
    alone = n - F.size("rare") - F.size("common")
    short = (n - least + 1 - alone).cast("int")  # of the prefix, what other sets have too
    longer = F.least(F.size("common"), (n - least + F.floor(n / 3) + 2 - alone - F.size("rare")).cast("int"))
    frequent = F.slice("common", 1, F.greatest(longer, F.lit(0)))
    pairs = F.zip_with(frequent, F.slice(frequent, 2, F.greatest(longer - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    reached = F.when(short > F.size("rare"), F.filter(pairs, lambda x: x.isNotNull())).otherwise(F.array().cast("array<bigint>"))
    singles = F.slice("rare", 1, F.greatest(short, F.lit(0)))
    return sets.select(F.explode(F.array_distinct(F.concat(singles, reached))).alias("token"), "key", "n")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of set keys that reach 3/4, by their shared shingles."""
    side = lambda name: sets.select(F.col("key").alias(name), F.col("n").alias(f"n_{name}"), F.concat("rare", "common").alias(f"s_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return both.filter(100 * shared >= 75 * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")


def close(n: str, m: str) -> Column:
    return (4 * F.col(n) >= 3 * F.col(m)) & (4 * F.col(m) >= 3 * F.col(n))


def star_pairs(index: DataFrame) -> DataFrame:
    """Every member of a token against one pivot of the token: linear in the index, whatever the group."""
    picked = index.groupBy("token").agg(F.min(F.struct(F.xxhash64("key").alias("by"), "key", "n")).alias("p"))
    pivots = picked.select(F.col("token").alias("at"), F.col("p.key").alias("pivot"), F.col("p.n").alias("m"))
    met = index.join(pivots, F.col("token") == F.col("at")).filter((F.col("key") != F.col("pivot")) & close("n", "m"))
    return met.select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct()


def labelled(index: DataFrame, components: DataFrame) -> DataFrame:
    """The index rows of tokens whose members are not all in one component yet."""
    known = components.select(F.col("node").alias("key"), "component")
    rows = index.join(known, "key", "left").withColumn("component", F.coalesce("component", "key"))
    spread = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi")
    return rows.join(spread.select("token"), "token", "left_semi")


def small_pairs(index: DataFrame) -> DataFrame:
    """All pairs of one token of at most ``SMALL`` sets whose components differ."""
    left = index.select("token", F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("c_a"))
    right = index.select("token", F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("c_b"))
    met = left.join(right, "token").filter((F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & close("n_a", "n_b"))
    return met.select("a", "b").distinct()


def blocks(members: DataFrame) -> DataFrame:
    """``members`` (cluster, key, n, component) with a size class and a block of about ``BLOCK`` sets.

    The largest component of a cluster has blocks of its own, as its sets need
    no comparison among themselves. Sets of similar sets lie in one size class
    or in neighbouring ones.
    """
    sized = members.withColumn("level", F.floor(F.log("n") / F.log(F.lit(4 / 3)) + 1e-9).cast("int"))
    each = members.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("k"))
    largest = each.groupBy("cluster").agg(F.max_by("component", F.struct("k", "component")).alias("top"))
    marked = sized.join(largest, "cluster").withColumn("main", F.col("component") == F.col("top"))
    counts = marked.groupBy("cluster", "level", "main").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    return marked.join(counts, ["cluster", "level", "main"]).select("cluster", "key", "component", F.struct("level", "main", part.alias("part")).alias("block"))


def block_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between all sets of one cluster that may reach 3/4, found block by block.

    A task holds two blocks, so its memory is bounded however large the cluster
    is, and returns a spanning forest of the links it finds.
    """
    placed = cut_lineage(blocks(members))
    there = placed.select("cluster", "block").distinct()
    other = there.withColumnRenamed("block", "right")
    near = F.abs(F.col("block.level") - F.col("right.level")) <= 1
    pairs = there.join(other, "cluster").filter((F.col("block") <= F.col("right")) & near & ~(F.col("block.main") & F.col("right.main")))
    left = placed.join(pairs, ["cluster", "block"]).select("cluster", F.col("block").alias("left"), "right", "key", "component", F.lit(False).alias("second"))
    right = placed.join(pairs.filter("block != right").withColumnsRenamed({"block": "left", "right": "block"}), ["cluster", "block"])
    sides = left.union(right.select("cluster", "left", F.col("block").alias("right"), "key", "component", F.lit(True).alias("second")))
    full = sides.join(sets.select("key", "n", F.concat("rare", "common").alias("tokens")), "key")
    return full.groupBy("cluster", "left", "right").applyInArrow(_compare, "a binary, b binary")


def _alike(n: np.ndarray, lists: pa.ListArray, second: np.ndarray) -> np.ndarray:
    """Which sets reach 3/4 with which others, as a matrix; with two sides, only sets of different sides do."""
    tokens = lists.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
    values, at, df = np.unique(tokens, return_inverse=True, return_counts=True)
    owner, at = owner[df[at] > 1], at[df[at] > 1]
    shared = np.zeros((len(n), len(n)), np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    width = min(4096, len(values))
    for lo in range(0, len(values), 4096):
        i, j = np.searchsorted(at, (lo, lo + 4096))
        part = np.zeros((len(n), width), np.float32)
        part[owner[i:j], at[i:j] - lo] = 1
        shared += part @ part.T
    alike = 100 * shared >= 75 * (n[:, None] + n[None, :] - shared)
    if second.any():
        alike &= second[:, None] != second[None, :]
    return alike


def _compare(table: pa.Table) -> pa.Table:
    keys, components, second = (table.column(c).to_pylist() for c in ("key", "component", "second"))
    alike = _alike(table.column("n").to_numpy(), table.column("tokens").combine_chunks(), np.array(second))
    group = {c: c for c in components}

    def root(c: bytes) -> bytes:
        while group[c] != c:
            group[c] = group[group[c]]
            c = group[c]
        return c

    found = []
    for i, j in zip(*np.nonzero(np.triu(alike, 1))):
        x, y = root(components[i]), root(components[j])
        if x != y:
            group[x] = y
            found.append((keys[i], keys[j]))
    return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})


def set_components(sets: DataFrame) -> DataFrame:
    """``node, component`` over the sets that have a link.

    Members of a token are first compared with a pivot, so that a large group of
    near copies becomes one component at linear cost. Tokens that still span
    components are compared in full: small ones as pairs, large ones in blocks
    of the clusters that they connect. No link between components can be
    missed, and links inside one add nothing.
    """
    index = cut_lineage(index_keys(sets))
    links = cut_lineage(linked(star_pairs(index), sets))
    rest = cut_lineage(labelled(index, connected_components(links, "a", "b")))
    held = rest.groupBy("token").agg(F.count(F.lit(1)).alias("k"))
    few = rest.join(held.filter(F.col("k") <= SMALL).select("token"), "token", "left_semi")
    many = rest.join(held.filter(F.col("k") > SMALL).select("token"), "token", "left_semi")
    links = links.union(linked(small_pairs(few), sets))
    members = many.select("key", "n", "component").distinct()
    if not members.isEmpty():
        hubs = many.groupBy("token").agg(F.min("key").alias("hub"))
        clusters = connected_components(many.join(hubs, "token").select("key", "hub").distinct(), "key", "hub")
        clustered = members.join(clusters.select(F.col("node").alias("key"), F.col("component").alias("cluster")), "key")
        links = links.union(block_links(clustered, sets))
    return connected_components(links, "a", "b")


def _linked_rows(table: pa.Table) -> pa.Table:
    """``key, links`` of every set: how many rows the sets of its component hold that reach 3/4 with it, of the two blocks given."""
    table = table.sort_by("component")
    names = table.column("component").to_pylist()
    n, weights = table.column("n").to_numpy(), table.column("class_size").to_numpy()
    lists, second = table.column("tokens").combine_chunks(), table.column("second").to_numpy()
    edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
    links = np.zeros(len(names), np.int64)
    for i, j in zip(edges, edges[1:]):
        alike = _alike(n[i:j], lists.slice(i, j - i), second[i:j])
        np.fill_diagonal(alike, False)
        links[i:j] = alike.astype(np.int64) @ weights[i:j]
    return pa.table({"key": table.column("key"), "links": pa.array(links)})


def link_counts(components: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """``key, links``: rows of other sets that reach 3/4 with the set of that key.

    Both sets of a link lie in one component, so all pairs of a component are
    verified and no others. Components of at most ``COUNTED`` sets are counted
    many at a time; a task of a larger one holds two blocks and returns one
    count per set, so neither memory nor rows grow with the number of links.
    """
    held = components.groupBy("component").agg(F.count(F.lit(1)).alias("k"))
    members = cut_lineage(components.join(held, "component").join(classes.select("key", "class_size"), "key"))
    few, large = members.filter(F.col("k") <= COUNTED), members.filter(F.col("k") > COUNTED)
    lots = max(1, few.count() // LOT)
    shingles = sets.select("key", "n", F.concat("rare", "common").alias("tokens"))
    lot = few.select("key", "component", "class_size", F.lit(False).alias("second"), F.pmod(F.xxhash64("component"), F.lit(lots)).alias("lot"))
    out = shingles.join(lot, "key").groupBy("lot").applyInArrow(_linked_rows, "key binary, links bigint")
    if not large.isEmpty():
        level = large.join(sets.select("key", "n"), "key").withColumn("level", F.floor(F.log("n") / F.log(F.lit(4 / 3)) + 1e-9).cast("int"))
        parts = level.groupBy("component", "level").agg(F.ceil(F.count(F.lit(1)) / COUNTED).cast("int").alias("parts"))
        block = F.struct("level", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"))
        placed = cut_lineage(level.join(parts, ["component", "level"]).select("key", "component", "class_size", block.alias("block")))
        there = placed.select("component", "block").distinct()
        near = F.abs(F.col("block.level") - F.col("right.level")) <= 1
        pairs = there.join(there.withColumnRenamed("block", "right"), "component").filter((F.col("block") <= F.col("right")) & near)
        others = pairs.filter("block != right").withColumnsRenamed({"block": "left", "right": "block"})
        sides = pairs.select("component", "block", F.col("block").alias("left"), "right", F.lit(False).alias("second")).union(
            others.select("component", "block", "left", F.col("block").alias("right"), F.lit(True).alias("second"))
        )
        full = placed.join(sides, ["component", "block"]).drop("block").join(shingles, "key")
        out = out.union(full.groupBy("component", "left", "right").applyInArrow(_linked_rows, "key binary, links bigint"))
    return out.groupBy("key").agg(F.sum("links").alias("links"))


def jaccard_components(documents: DataFrame, buckets: int | None = None, common: int = COMMON, id_col: str = "doc_id", text_col: str = "text", links: bool = True) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_size, n_links`` for every row of ``documents``.

    ``component_id`` is the smallest id among the documents reachable by links
    of similarity 3/4 or more; ``class_size`` counts rows with the same set, and
    ``n_links`` all other rows of similarity 3/4 or more, those of the same set
    among them; without ``links`` it is not counted and left out.
    Null and empty texts have no shingles, their own id, class size 1 and no links. Rows
    may repeat; each gets a row. A null id stands for no document: it is never
    the smallest, and a component of null ids only has a null id. Ids are cast
    to long. ``buckets`` hash ranges are counted, each by one task; by default
    their number follows the bytes of text.
    """
    buckets = buckets or 1 + (documents.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // RANGE_BYTES
    found = cut_lineage(shared_shingles(documents, buckets, common, id_col, text_col))
    docs = found.filter("block is null").select("doc_id", F.col("n").alias("n_shingles"), "key")
    sets = cut_lineage(found.filter("block is not null").groupBy("block").applyInArrow(_gather, GATHERED))
    components = cut_lineage(set_components(sets).select(F.col("node").alias("key"), "component"))

    classes = cut_lineage(docs.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("class_size")))
    joined = classes.join(components, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "component").select("key", "component_id", "class_size")
    size = F.coalesce("class_size", F.lit(1)).cast("long")
    counted = []
    if links:
        named = named.join(cut_lineage(link_counts(components, sets, classes)), "key", "left")
        counted = [(size - 1 + F.coalesce("links", F.lit(0))).alias("n_links")]
    known = docs.join(named, "key", "left")
    mine = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return known.select("doc_id", "n_shingles", mine.alias("component_id"), size.alias("class_size"), *counted)
