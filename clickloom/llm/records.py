"""Token ids in length-delimited binary files with an offset index, and the way back.

A record is ``length (u64) | masked checksum of it (u32) | payload | masked
checksum of the payload (u32)``, little endian. The payload is the document id
(i64), the width of an id in bytes (u8) and the ids. Next to every records file
lies an index of ``byte offset (u64) | document id (i64) | tokens before it in
the file (u64)`` rows, so that a reader can fetch records in any order.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from clickloom.session import cut_lineage, new_folder

END_ID = 2
NO_ID = -(2**63)  # stands for a null document id
CACHED = 500_000  # once a worker remembers more encoded pieces, of some 150 bytes each, it starts anew with the next texts
TEXTS = 2_000  # texts encoded together at most
JOINED = 500  # new pieces encoded as one text at most
READ_BYTES = 8_000_000
INDEX = np.dtype([("offset", "<u8"), ("doc_id", "<i8"), ("start", "<u8")])
MANIFEST = "part int, path string, n_docs long, n_tokens long, n_bytes long"
MASK = 0xA282EAD8

_unsafe = r"(?:^|[\s\pZ\x0B\x1C-\x1F\x{85}]) "
_breaks = re.compile(r"(?<=\S)(?= )")


def masked(data: bytes) -> int:
    """A checksum of data that may itself hold checksums."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframed(data: memoryview, at: int) -> tuple[bytes, int]:
    """The payload of the record at ``at`` and the place behind it."""
    head = bytes(data[at : at + 8])
    length = struct.unpack("<Q", head)[0]
    payload = bytes(data[at + 12 : at + 12 + length])
    sums = struct.unpack("<I", data[at + 8 : at + 12]) + struct.unpack("<I", data[at + 12 + length : at + 16 + length])
    if sums != (masked(head), masked(payload)):
        raise ValueError(f"record at byte {at} is damaged")
    return payload, at + 16 + length


def _appended(values: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """``values`` with ``more`` from place ``n`` on, in twice the room if it is full."""
    if n + len(more) > len(values):
        values = np.concatenate([values[:n], np.empty(n + 2 * len(more), values.dtype)])
    values[n : n + len(more)] = more
    return values


class Pieces:
    """Ids of all pieces met so far in one flat array; ``plain`` and ``spaced`` (behind one space) give their rows."""

    def __init__(self, source: str, special_as_text: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.encode_special_tokens = special_as_text
        added = self.tokenizer.get_added_tokens_decoder()
        self.cuts = not any(t.lstrip or t.rstrip or any(c.isspace() for c in t.content) for t in added.values())  # none reaches over a space
        vocabulary = self.tokenizer.get_vocab()
        self.spacing = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)  # tokens that begin with a space
        self.spacing[[i for t, i in vocabulary.items() if t.startswith("\u0120") and i not in added]] = True
        self.forget()

    def forget(self) -> None:
        self.plain: dict[str, int] = {}
        self.spaced: dict[str, int] = {}
        self.ids, self.ends, self.n = np.empty(0, "<u4"), np.zeros(1, np.int64), 0  # ends[0] is where row 0 begins

    def encoded(self, head: str, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and how many each has.

        Pieces behind a space that end visibly are joined into longer texts, and
        each starts at a token that begins with a space, as it holds no other.
        A text in which the starts do not tell the pieces apart is done again
        piece by piece.
        """
        if head != " " or not self.cuts or not all(p and not p[-1].isspace() for p in pieces):
            joined = [[p] for p in pieces]
        else:
            joined = [pieces[i : i + JOINED] for i in range(0, len(pieces), JOINED)]
        found, lengths = [], []
        for some, e in zip(joined, self.tokenizer.encode_batch_fast([head + " ".join(x) for x in joined], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            starts = np.flatnonzero(self.spacing[ids]) if len(some) > 1 else np.zeros(1, np.int64)
            if len(starts) == len(some) and starts[0] == 0:
                found.append(ids)
                lengths.append(np.diff(starts, append=len(ids)))
            else:
                alone = [e.ids for e in self.tokenizer.encode_batch_fast([head + p for p in some], add_special_tokens=False)]
                found += [np.array(x, "<u4") for x in alone]
                lengths.append(np.array([len(x) for x in alone], np.int64))
        return np.concatenate(found), np.concatenate(lengths)

    def rows(self, known: dict[str, int], head: str, pieces: Sequence[str]) -> np.ndarray:
        rows = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(rows < 0)
        new = list(dict.fromkeys(pieces[i] for i in missing))
        new.sort(key=lambda p: p[-1:].isspace() or not p)  # those that cannot be joined come last
        plain = sum(1 for p in new if p and not p[-1].isspace())
        cuts = sorted({*range(0, len(new), 20_000), plain})
        for lo, hi in zip(cuts, [*cuts[1:], len(new)]):
            some = new[lo:hi]
            if not some:
                continue
            ids, lengths = self.encoded(head, some)
            used = int(self.ends[self.n])
            self.ids = _appended(self.ids, used, ids)
            self.ends = _appended(self.ends, self.n + 1, used + np.cumsum(lengths))
            known.update(zip(some, range(self.n, self.n + len(some))))
            self.n += len(some)
        rows[missing] = [known[pieces[i]] for i in missing]
        return rows


@lru_cache(maxsize=1)
def _pieces(source: str, special_as_text: bool) -> Pieces:
    return Pieces(source, special_as_text)


def encode(source: str, texts: pa.Array, special_as_text: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, as 32-bit integers, and where each text ends.

    A byte-level vocabulary never joins across a space that follows a visible
    character, so texts are cut there, every distinct piece is encoded once,
    and the ids are gathered by piece. A null text is empty.
    """
    pieces = _pieces(source, special_as_text)
    if pieces.n > CACHED:
        pieces.forget()
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, _unsafe).to_numpy(zero_copy_only=False) | (not pieces.cuts)
    cut = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    words, starts = cut.flatten(), cut.offsets.to_numpy()[:-1] - (cut.offsets[0].as_py() if len(cut) else 0)
    coded = words.dictionary_encode()
    rows = pieces.rows(pieces.spaced, " ", coded.dictionary.to_numpy(zero_copy_only=False))[coded.indices.to_numpy()]
    rows[starts] = pieces.rows(pieces.plain, "", words.take(pa.array(starts)).to_pylist())
    n_rows = np.zeros(len(texts), np.int64)
    n_rows[~odd] = np.diff(starts, append=len(words))
    if odd.any():
        # Runs of spaces are no place to cut; their texts are cut one by one and put in between.
        lists = [_breaks.split(t) if pieces.cuts else [t] for t in texts.filter(pa.array(odd)).to_pylist()]
        n_rows[odd] = [len(x) for x in lists]
        all_rows, from_odd = np.empty(n_rows.sum(), np.int64), np.repeat(odd, n_rows)
        all_rows[from_odd] = pieces.rows(pieces.plain, "", [p for x in lists for p in x])
        all_rows[~from_odd] = rows
        rows = all_rows
    first = pieces.ends[rows]
    lengths = pieces.ends[rows + 1] - first
    total = np.cumsum(lengths)
    ids = pieces.ids[np.repeat(first - total + lengths, lengths) + np.arange(total[-1] if len(total) else 0)]
    return ids, np.concatenate([[0], total])[np.cumsum(n_rows)]


def _write(folder: str, source: str, end_id: int, special_as_text: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        place, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        wide = _pieces(source, special_as_text).tokenizer.get_vocab_size() > 65_536 or end_id > 65_535
        part = TaskContext.get().partitionId()
        path = f"{base}/part-{part:06d}-{uuid.uuid4().hex}"  # an attempt that dies leaves a file that no manifest names
        index, offset, start = [], 0, 0
        kind, width = ("<u4", 4) if wide else ("<u2", 2)
        end = np.array([end_id], kind).tobytes()
        stream = None
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                some = batch.slice(lo, TEXTS)
                coded, ends = encode(source, some.column(1), special_as_text)
                data = coded.astype(kind).tobytes()
                stream = stream or place.open_output_stream(f"{path}.records")
                at = 0
                for doc, to in zip(some.column(0).to_pylist(), ends.tolist()):
                    doc = NO_ID if doc is None else doc
                    record = framed(b"".join((struct.pack("<qB", doc, width), data[at * width : to * width], end)))
                    index.append((offset, doc, start))
                    stream.write(record)
                    offset += len(record)
                    start += to - at + 1
                    at = to
        if stream is None:
            return
        stream.close()
        with place.open_output_stream(f"{path}.index") as out:
            out.write(np.array(index, INDEX).tobytes())
        row = [[part], [path], [len(index)], [start], [offset]]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    return write


def write_records(documents: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", encode_special_tokens: bool = True) -> DataFrame:
    """Encode and write all documents in ascending id order; returns the manifest, one row per file.

    ``tokenizer`` is the path of a byte-level vocabulary on the driver; its
    content travels with the tasks. ``folder`` must be one that all executors
    share (default: under ``spark.checkpoint.dir``). Documents are dealt by
    ranges of ids, null ids first, rows of one id by their text. A null text is
    empty and has only the end id. Control strings inside a text are text with
    ``encode_special_tokens`` and their own ids without, as is the tokenizer's
    default. Files of failed attempts are not in the
    manifest, which is written out before anything reads it.
    """
    spark = documents.sparkSession
    folder = folder or new_folder(spark, "records")
    with open(tokenizer, encoding="utf-8") as source:
        content = source.read()
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if folder.startswith("/") or folder.startswith("file:"):
        import os

        os.makedirs(re.sub(r"^file:/*", "/", folder), exist_ok=True)
    dealt = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    return cut_lineage(dealt.mapInArrow(_write(folder, content, end_id, encode_special_tokens), MANIFEST)).withColumn("folder", F.lit(folder))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            folder = row["folder"]
            place = fs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else fs.LocalFileSystem()
            with place.open_input_stream(f"{row['path']}.index") as stream:
                index = np.frombuffer(stream.read(), INDEX)
            ends = np.append(index["offset"][1:], row["n_bytes"]).astype(np.int64)
            with place.open_input_file(f"{row['path']}.records") as file:
                lo = 0
                while lo < len(index):
                    begin = int(index["offset"][lo])
                    hi = max(lo + 1, int(np.searchsorted(ends, begin + READ_BYTES, "right")))
                    data = memoryview(file.read_at(int(ends[hi - 1]) - begin, begin))
                    found = []
                    for i in range(lo, hi):
                        payload, _ = unframed(data, int(index["offset"][i]) - begin)
                        doc, width = struct.unpack("<qB", payload[:9])
                        tokens = np.frombuffer(payload[9:], f"<u{width}")
                        found.append((None if doc == NO_ID else doc, row["start"] + int(index["start"][i]), len(tokens), zlib.crc32(tokens.astype("<u4").tobytes())))
                    columns = [pa.array(c, pa.int64()) for c in zip(*found)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    lo = hi


def read_records(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every record, read back through the indexes.

    ``start`` counts the ids of all records before, over all files. Checksums
    are verified. The manifest has one row per file, so its running sum is small.
    """
    before = F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")
    files = manifest.withColumn("start", before)
    n = max(1, min(manifest.count(), 100_000))
    return files.repartition(n, "part").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
