"""Removal of token windows that occur earlier in the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from clickloom.llm.packed import CHUNK_BYTES, chunks, mix, rolling, word_hashes

WIDTH = 20
RANGE_BYTES = 16_000_000  # text per range of windows and per block of documents
NO_ID = -(2**63)
#: Neighbouring windows of one text: the text's id and tag, the first window and the number of windows.
RUN = np.dtype([("id", "<i8"), ("tag", "<u4"), ("start", "<i4"), ("n", "<i4")])
PLACED = "bucket int, runs binary, hashes binary"
FOUND = "block int, runs binary"
SMALL = "block int, id bigint, tag bigint, packed binary"
KEPT = "doc_id bigint, n_words bigint, n_removed bigint, intervals array<struct<start:bigint,end:bigint>>, kept string"


def tagged(texts: list[bytes]) -> np.ndarray:
    """Tells rows of one id with different texts apart; equal rows have equal results."""
    return np.array([xxhash.xxh3_64_intdigest(t) & 0xFFFFFFFF for t in texts], np.uint32)


def blocks(ids: np.ndarray, tags: np.ndarray, n: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) ^ (tags.astype(np.uint64) << np.uint64(32))) % np.uint64(n)).astype(np.int32)


def windows(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window: its hash, a minimiser, its text and its place there.

    The minimiser is the smallest hash of a few words inside the window. Equal
    windows have equal ones, and neighbours mostly do, as they share most words.
    """
    words, n_words = word_hashes(texts, lower=False)
    part = max(1, width // 5)
    inner, hashes = rolling(words, part), rolling(words, width)
    low = inner[: len(hashes)].copy()
    for i in range(1, width - part + 1):
        np.minimum(low, inner[i : i + len(hashes)], out=low)
    n = np.maximum(n_words - width + 1, 0)
    owner = np.repeat(np.arange(len(texts)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = start + np.repeat(np.cumsum(n_words) - n_words, n)
    return hashes[at], low[at], owner, start


def runs_of(ids: np.ndarray, tags: np.ndarray, owner: np.ndarray, start: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of neighbouring windows that lie in one part, in the order given, and the part of each."""
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1) | (part[1:] != part[:-1])])[: len(owner)]
    first = np.flatnonzero(new)
    runs = np.empty(len(first), RUN)
    runs["id"], runs["tag"], runs["start"], runs["n"] = ids[owner[first]], tags[owner[first]], start[first], np.diff(first, append=len(owner))
    return runs, part[first]


def _by_block(runs: np.ndarray, n: int) -> Iterator[tuple[int, bytes]]:
    block = blocks(runs["id"], runs["tag"], n)
    order = np.argsort(block, kind="stable")
    runs, block = runs[order], block[order]
    edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
    for lo, hi in zip(edges, edges[1:]):
        yield int(block[lo]), runs[lo:hi].tobytes()


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    types = [{"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[k] for k in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], names=list(names))


def _pack(buckets: int, width: int, chunk: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, chunk):
            hashes, low, owner, start = windows(texts, width)
            ids, tags = np.array(ids, np.int64), tagged(texts)
            rank = np.empty(len(ids), np.int64)
            rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
            # Of equal windows of the chunk only those of the smallest id are compared with other chunks, once per text.
            order = np.lexsort((start, rank[owner], hashes))
            own, text = hashes[order], owner[order]
            new = np.concatenate([[True], own[1:] != own[:-1]])[: len(own)]
            again = np.concatenate([[False], ~new[1:] & (text[1:] == text[:-1])])[: len(own)]
            least = ids[text[np.flatnonzero(new)]][np.cumsum(new) - 1]
            hit = np.zeros(len(own), bool)
            hit[order] = (ids[text] > least) | again
            done, _ = runs_of(ids, tags, owner[hit], start[hit], np.zeros(hit.sum(), np.int8))
            rows = [(-1 - block, data, b"") for block, data in _by_block(done, buckets)]
            bucket = (mix(low[~hit]) % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            runs, part = runs_of(ids, tags, owner[~hit][by], start[~hit][by], bucket[by])
            hashes = hashes[~hit][by]
            ends = np.concatenate([[0], np.cumsum(runs["n"])])
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            rows += [(int(part[lo]), runs[lo:hi].tobytes(), hashes[ends[lo] : ends[hi]].tobytes()) for lo, hi in zip(edges, edges[1:])]
            yield _rows(PLACED, rows)

    return pack


def _repeated(n_blocks: int):
    def repeated(table: pa.Table) -> pa.Table:
        """Of one range of windows: runs of those that a smaller document has, by block of documents."""
        bucket = table.column("bucket")[0].as_py()
        data = b"".join(table.column("runs").to_pylist())
        if bucket < 0:
            return pa.Table.from_batches([_rows(FOUND, [(-1 - bucket, data)])])
        runs = np.frombuffer(data, RUN)
        hashes = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint64)
        n = runs["n"].astype(np.int64)
        ids, own = np.repeat(runs["id"], n), np.repeat(np.arange(len(runs)), n)
        start = np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(runs["start"], n)
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(ranked)])
        hit = np.empty(len(ids), bool)
        hit[order] = ids[order] > np.repeat(np.minimum.reduceat(ids[order], first), np.diff(first, append=len(ids)))
        found, _ = runs_of(runs["id"], runs["tag"], own[hit], start[hit], np.zeros(hit.sum(), np.int8))
        return pa.Table.from_batches([_rows(FOUND, list(_by_block(found, n_blocks)))])

    return repeated


def _shrink(n_blocks: int):
    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=1)
        for ids, texts in chunks(batches):
            tags = tagged(texts)
            block = blocks(np.array(ids, np.int64), tags, n_blocks)
            yield _rows(SMALL, list(zip(block.tolist(), ids, tags.tolist(), map(small.compress, texts))))

    return shrink


def _remove(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("intervals", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])

    def remove(texts: pa.Table, found: pa.Table) -> pa.Table:
        """The texts of one block of documents without the words that their runs cover."""
        runs = np.frombuffer(b"".join(found.column("runs").to_pylist()), RUN)
        runs = runs[np.lexsort((runs["tag"], runs["id"]))]
        names = list(zip(runs["id"].tolist(), runs["tag"].tolist()))
        edges = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
        known = {names[lo]: (lo, hi) for lo, hi in zip(edges, [*edges[1:], len(names)])}
        grow = zstandard.ZstdDecompressor()
        rows = []
        for i, tag, packed in zip(*(texts.column(c).to_pylist() for c in ("id", "tag", "packed"))):
            words, spans, removed = grow.decompress(packed).split(), [], 0
            if (i, tag) in known:
                own = runs[slice(*known[i, tag])]
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, own["start"], 1)
                np.add.at(depth, own["start"] + own["n"] + width - 1, -1)
                gone = np.cumsum(depth[:-1]) > 0
                cuts = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans = [{"start": int(a), "end": int(b)} for a, b in cuts.reshape(-1, 2)]
                removed, kept = int(gone.sum()), [w for w, out in zip(words, gone) if not out]
            else:
                kept = words
            rows.append((None if i == NO_ID else i, len(words), removed, spans, b" ".join(kept).decode()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 5, schema)], schema=schema)

    return remove


def remove_repeats(documents: DataFrame, width: int = WIDTH, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, intervals, kept`` for every row of ``documents``.

    Every window of ``width`` words has a Rabin-Karp hash of 64 bits. Windows
    are dealt to ranges by a minimiser, so that a text's neighbouring windows
    meet in one range and are sent, and sent back, as runs. A range is counted
    by one task. A window is removed if its hash also starts in a smaller
    document or earlier in its own; overlapping removed windows merge into
    ``intervals`` of word positions, ends exclusive. Windows that occur more
    than once in a chunk of documents are settled there, but for the first, so
    a window that every document has reaches its range once per chunk.

    Null and empty texts have no words. Rows that share an id are read as one
    place in the order: they do not remove windows from each other, only from
    themselves and larger ids. Null ids come first and are one such place. Ids
    are cast to long. The number of ``buckets`` follows the bytes of text, so
    that a range and what it reports do not depend on the session's settings.
    """
    buckets = buckets or 1 + (documents.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // RANGE_BYTES
    rows = documents.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_pack(buckets, width, CHUNK_BYTES), PLACED).groupBy("bucket").applyInArrow(_repeated(buckets), FOUND)
    small = rows.mapInArrow(_shrink(buckets), SMALL)
    return small.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_remove(width), KEPT)
