"""Byte-level BPE: exact encoding by backtracking over longest matches, and decoding.

The bytes of a piece are read as Latin-1 characters, so that an Aho-Corasick
automaton over characters finds every token in it. From the left the longest
token is tried first and shorter ones after it; a token is taken if it is
compatible with the one before, that is, if merging the bytes of the two gives
just these two. A sequence whose neighbours are all compatible is the result of
the merges, and no other is: until a merge crosses a border for the first time,
merges on both sides run as they would for the two tokens alone. So every
prefix has one such sequence, a place that once failed fails for ever, and each
place is left at most once: the time is linear in the piece.

Whether two tokens are compatible is found by undoing their merges at the
border, the later one first: a merge across the border runs if its rank is
below that of the next merge that would use one of its sides up.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

PIECES = 400_000  # encoded pieces that a worker remembers at most
PAIRS = 300_000  # pairs of tokens whose compatibility a worker remembers at most
LONG_PIECE = 2_000  # bytes; the matches of longer ones are not held at once
SHORT_PIECE = 64  # bytes; in shorter ones the longest tokens are looked up where they are needed
PIECE_CHARS = 100  # longer pieces are not remembered
TEXT_BYTES = 2_000_000  # of the texts encoded together
IDS = 500_000  # of the lists decoded together


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank in every line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


def merge(data: bytes, ranks: dict[bytes, int], until: int = 1) -> list[bytes]:
    """Merges as defined: again and again the leftmost pair of lowest rank. For short data."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > until:
        rank, at = min((ranks.get(a + b, len(ranks) + 1_000_000_000), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if parts[at] + parts[at + 1] not in ranks:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Encoder:
    """The automaton and tables of one vocabulary, and what has been encoded so far."""

    def __init__(self, lines: bytes, pattern: str):
        import ahocorasick
        import regex

        self.ranks = read_ranks(lines)
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.split = regex.compile(pattern).findall
        self.tokens = {i: t for t, i in self.ranks.items()}
        reached = {t: i for t, i in self.ranks.items() if len(merge(t, self.ranks)) == 1}
        self.sizes = {i: len(t) for t, i in reached.items()}
        self.parts = {i: tuple(self.ranks[p] for p in merge(t, self.ranks, until=2)) for t, i in reached.items() if len(t) > 1}
        #: Whether every token ranks above its parts, as in a trained vocabulary; then ranks tell the order of the merges.
        self.ordered = all(i > max(parts) for i, parts in self.parts.items())
        #: The longest token that is a proper prefix of a token, or -1.
        self.shorter = {i: next((reached[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in reached), -1) for t, i in reached.items()}
        self.reached = reached
        #: The length of the longest token that begins with these four bytes.
        self.reach: dict[bytes, int] = {}
        for t in reached:
            if len(t) >= 4:
                self.reach[t[:4]] = max(len(t), self.reach.get(t[:4], 0))
        self.automaton = ahocorasick.Automaton()
        for t, i in reached.items():  # backwards, so that a match ends where a token starts
            self.automaton.add_word(t.decode("latin-1")[::-1], i)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends, self.n = np.empty(0, np.int32), np.zeros(1, np.int64), 0

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        if not self.ordered:
            both = [self.tokens[a], self.tokens[b]]
            self.pairs[a, b] = found = merge(b"".join(both), self.ranks) == both
            return found
        tokens, ranks, parts = self.tokens, self.ranks, self.parts
        u, v, below, found = a, b, len(tokens) + max(a, b), True
        while (found := ranks.get(tokens[u] + tokens[v], below) >= below) and (u in parts or v in parts):
            if v not in parts or u in parts and u > v:
                below, u = u, parts[u][1]
            else:  # of one and the same merge on both sides the left one ran first
                below, v = v + 1, parts[v][0]
        self.pairs[a, b] = found
        return found

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece. A piece that is a token is that token, even one that no merges reach."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        sizes, shorter, fits = self.sizes, self.shorter, self.pairs.get
        longest, left = self.longest(data), len(data)
        out: list[int] = []
        dead: set[int] = set()
        token = longest[left]
        while left:
            while token >= 0:
                if not dead or left - sizes[token] not in dead:
                    if not out or (known := fits((out[-1], token))) or known is None and self.compatible(out[-1], token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                left -= sizes[token]
                token = longest[left] if left else -1
            else:
                dead.add(left)
                last = out.pop()
                left += sizes[last]
                token = shorter[last]
        return out

    def longest(self, data: bytes) -> Mapping[int, int] | Sequence[int]:
        """The longest token at every place, by the number of bytes from there to the end.

        In a short piece it is looked up when a place is asked for.
        A character that no token has stands in front, so that places count from
        one. Of the matches that end at one place the automaton gives the longest
        first, and read backwards they are those that start there.
        """
        if len(data) <= SHORT_PIECE:
            return Places(data, self.reach, self.reached)
        matches = self.automaton.iter("\u0100" + data.decode("latin-1")[::-1])
        if len(data) <= LONG_PIECE:
            return dict(reversed(list(matches)))
        found = array("i", [-1]) * (len(data) + 1)
        for left, token in matches:
            if found[left] < 0:
                found[left] = token
        return found

    def rows(self, pieces: Sequence[str]) -> np.ndarray:
        """The places of the pieces in ``ids``, after encoding those that are new."""
        rows = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(rows < 0)
        new = list(dict.fromkeys(pieces[i] for i in missing))
        if new:
            found = [self.piece(p.encode()) for p in new]
            used = int(self.ends[self.n])
            ends = used + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            self.ids = _appended(self.ids, used, np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1]) - used))
            self.ends = _appended(self.ends, self.n + 1, ends)
            own = dict(zip(new, range(self.n, self.n + len(new))))
            rows[missing] = [own[pieces[i]] for i in missing]
            self.known.update((p, i) for p, i in own.items() if len(p) <= PIECE_CHARS)
            self.n += len(new)
        return rows

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text ends."""
        if self.n > PIECES:
            self.forget()
        pieces = [self.split(t) for t in texts]
        rows = self.rows(list(chain.from_iterable(pieces)))
        starts, n = self.ends[rows], np.diff(self.ends[: self.n + 1])[rows]
        places = np.arange(int(n.sum())) + np.repeat(starts - np.cumsum(n) + n, n)
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum([len(p) for p in pieces])]
        return self.ids[places], ends


def _appended(values: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """``values`` with ``more`` from place ``n`` on, in twice the room if it is full."""
    if n + len(more) > len(values):
        values = np.concatenate([values[:n], np.empty(n + 2 * len(more), values.dtype)])
    values[n : n + len(more)] = more
    return values


class Places(dict):
    """The longest token at the places of a short piece, found from the longest that the first four bytes allow."""

    __slots__ = ("data", "reach", "reached")

    def __init__(self, data: bytes, reach: dict[bytes, int], reached: dict[bytes, int]):
        self.data, self.reach, self.reached = data, reach, reached

    def __missing__(self, left: int) -> int:
        data, find = self.data, self.reached.get
        at = len(data) - left
        size = min(left, self.reach.get(data[at : at + 4], 3))
        while (token := find(data[at : at + size])) is None:
            size -= 1
        self[left] = token
        return token


@lru_cache(maxsize=1)
def encoder(lines: bytes, pattern: str) -> Encoder:
    return Encoder(lines, pattern)


@lru_cache(maxsize=1)
def _bytes_by_id(lines: bytes) -> pa.Array:
    ranks = read_ranks(lines)
    tokens = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return pa.array(tokens, pa.large_binary())


def _lots(lengths: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Where runs of rows begin and their numbers of rows; a run has one row or at most ``limit`` of length."""
    sizes = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + limit, "right")))
        yield lo, hi - lo
        lo = hi


def encode_documents(documents: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` for every row of ``documents``: each match of ``pattern`` encoded by itself.

    ``ranks_path`` is a file of base64 tokens and ranks that the driver can
    open; it goes to the tasks with the function, a few hundred thousand
    tokens at most. Special tokens are not known, so their strings are
    ordinary text. Null and empty texts have no ids. Rows may repeat, null
    document ids stay null, other columns are not read. A text is whole in its
    row; a worker encodes ``TEXT_BYTES`` of text or one row at a time, and has bounded
    memories of pieces and pairs, which do not change any result.
    """
    with open(ranks_path, "rb") as f:
        lines = f.read()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(lines, pattern)
        for batch in batches:
            for lot in _lots(pc.binary_length(batch.column(1)), TEXT_BYTES):
                names, texts = batch.slice(*lot).columns
                ids, ends = own.encode([t or "" for t in texts.to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([names, lists], schema=schema)

    rows = documents.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(encode, "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for; a null list has none, an empty list has no bytes.

    Ids that the vocabulary lacks, and null ids inside a list, raise an error.
    """
    with open(ranks_path, "rb") as f:
        lines = f.read()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _bytes_by_id(lines)
        for whole in batches:
            for lot in _lots(pc.list_value_length(whole.column(ids_col)), IDS):
                batch = whole.slice(*lot)
                ids = batch.column(ids_col)
                parts = tokens.take(ids.flatten())
                if parts.null_count:
                    raise ValueError("an id is not in the vocabulary")
                offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
                ends = np.concatenate([[0], np.cumsum(pc.binary_length(parts).to_numpy(zero_copy_only=False))])
                data = parts.buffers()[2] or pa.py_buffer(b"")
                values = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends[offsets].astype(np.int64)), data])
                values = pc.if_else(ids.is_valid(), values, pa.scalar(None, pa.large_binary())).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, out_col])

    return encoded.mapInArrow(decode, StructType([*encoded.schema, StructField(out_col, BinaryType())]))
