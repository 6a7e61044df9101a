"""Hashes of word windows in numpy, packed into one binary row per hash range.

A row per window would cost a hundred bytes of shuffle and a sort for eight
bytes of content. Instead every chunk of documents sends each range of the hash
space one row: its documents, how many windows each has there, and the window
hashes in document order. The ranges are even because the hashes are, whatever
the keys of the documents, and a chunk is bounded in bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 6_000_000
PART_BYTES = 500_000  # text whose words are hashed at a time; the arrays for it take some 50 times as much
PACKED = "bucket int, keys binary, sizes binary, counts binary, hashes binary"
_random = np.random.default_rng(20_240_229)
BYTE_CODES = _random.integers(0, 2**64, 256, dtype=np.uint64)
BASE, WORD_BASE = np.uint64(0x9E3779B97F4A7C15 | 5), np.uint64(0xD1342543DE82EF95)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), base, np.uint64))])[:n]


def word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the number of words of each text."""
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    starts = np.flatnonzero(np.diff(ends // PART_BYTES, prepend=-1)).tolist()
    found = [_word_hashes(texts[i:j], lower) for i, j in zip(starts, [*starts[1:], len(texts)])]
    return np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in found)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in found)])


def _word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = np.flatnonzero(~space)
    if not len(inside):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.flatnonzero(np.diff(inside, prepend=-2) > 1)
    lengths = np.diff(first, append=len(inside))
    at = np.arange(len(inside)) - np.repeat(first, lengths)
    terms = BYTE_CODES[data[inside]] * powers(BASE, int(lengths.max()))[at]
    hashes = mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    ends = np.searchsorted(inside[first], bounds)
    return hashes, np.diff(ends, prepend=0)


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``width`` words, by doubling: H(2k) = H(k) + base^k * H(k) shifted."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    done, have, tables = 0, None, {1: words}
    size = 1
    while size * 2 <= width:
        t, n = tables[size], len(words) - 2 * size + 1
        tables[size * 2] = t[:n] + powers(WORD_BASE, size + 1)[size] * t[size : size + n]
        size *= 2
    total = len(words) - width + 1
    have = np.zeros(total, np.uint64)
    for part in sorted(tables, reverse=True):
        if done + part <= width:
            have += powers(WORD_BASE, done + 1)[done] * tables[part][done : done + total]
            done += part
    return mix(have)


def windows(texts: list[bytes], width: int, lower: bool, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every window of ``width`` words in order, windows and words per text.

    With ``short`` a text of fewer words, but not none, is one window.
    """
    words, n_words = word_hashes(texts, lower)
    starts = np.cumsum(n_words) - n_words
    n = np.maximum(n_words - width + 1, 0)
    rolled = rolling(words, width)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
    hashes = rolled[at]
    if short and (few := np.flatnonzero((n_words > 0) & (n_words < width))).size:
        own = np.concatenate([np.sum(words[starts[i] : starts[i] + n_words[i]] * powers(WORD_BASE, int(n_words[i])), keepdims=True) + n_words[i : i + 1].astype(np.uint64) * BASE for i in few])
        hashes = np.insert(hashes, (np.cumsum(n) - n)[few], mix(mix(own)))
        n[few] = 1
    return hashes, n, n_words


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Keys (first column) and texts (second) in pieces of bounded bytes; a null text is empty."""
    keys, texts, held = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            keys.append(key)
            texts.append(data)
            held += len(data)
            if held >= limit:
                yield keys, texts
                keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


def packed(keys: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per hash range. ``counts`` hashes belong to each document, in order."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(bucket.astype(np.uint16 if buckets <= 65_536 else np.int64), kind="stable")
    owner = np.repeat(np.arange(len(keys)), counts)[order]
    hashes, bucket = hashes[order], bucket[order]
    edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    rows = []
    for b in np.flatnonzero(np.diff(edges)):
        lo, hi = edges[b], edges[b + 1]
        own = owner[lo:hi]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        docs = own[first]
        n = np.diff(first, append=hi - lo).astype(np.int32)
        rows.append((int(b), keys[docs].tobytes(), sizes[docs].astype(np.int64).tobytes(), n.tobytes(), hashes[lo:hi].tobytes()))
    names = [c.split()[0] for c in PACKED.split(", ")]
    kinds = [pa.int32()] + [pa.binary()] * 4
    columns = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def unpacked(table: pa.Table, key_type: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, sizes and counts of all document pieces of one hash range, and their hashes."""
    join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    return join("keys", key_type), join("sizes", np.int64), join("counts", np.int32), join("hashes", np.uint64)


def listed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), pa.array(values))
