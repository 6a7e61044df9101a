"""Secrets in documents, told from widely copied examples by who owns them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clickloom.session import cut_lineage

KINDS = ("assign", "access", "hex")
# Token formats of public services that the base kinds do not name.
MORE = (
    ("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("host_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("pay_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
HINTS = ("-----BEGIN", "gh", "xox", "k_live_", "eyJ")
WORDS = ("password", "passwd", "secret", "token", "api_?key")
EXAMPLE_OWNERS = 3  # a value of so many owners is an example
SPAN = "struct<kind:string,start:int,end:int,value:binary,base:boolean>"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(rf"(?:{'|'.join(map(either_case, WORDS))})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
EXTRA = [(kind, hint, re.compile(pattern)) for (kind, pattern), hint in zip(MORE, HINTS)]


def candidates(text: str) -> list[tuple[str, int, int, str, bool]]:
    """``kind, start, end, value, base`` of all candidates of a text, by start and kind."""
    found = []
    small = text.lower()
    if ("=" in text or ":" in text) and any(w in small for w in ("passw", "secret", "token", "api")):
        found += [("assign", m.start(), m.end(), m[1], True) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0], True) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end(), m[0], True) for m in HEX.finditer(text)]
    for kind, hint, pattern in EXTRA:
        if hint in text:
            found += [(kind, m.start(), m.end(), m[0], False) for m in pattern.finditer(text)]
    order = [*KINDS, *[kind for kind, _ in MORE]]
    return sorted(found, key=lambda c: (c[1], order.index(c[0])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.binary()), ("base", pa.bool_())])
    for batch in batches:
        spans = []
        for text in batch.column(3):
            found = candidates(text.as_py() or "")
            spans.append([(k, s, e, blake2b(v.encode(), digest_size=16).digest(), b) for k, s, e, v, b in found])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, pa.list_(span))], names=["doc_id", "repo", "owner", "spans"])


def scan_secrets(documents: DataFrame, repo_col: str = "source", owner_col: str = "source", id_col: str = "doc_id", text_col: str = "text", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``doc_id, spans, n_live, n_example`` for every row of ``documents``.

    Values are hashed and counted over the corpus by distinct repositories and
    owners. A value of ``example_owners`` or more owners, or of as many
    repositories, is a copied example; any other looks live. Base spans
    are always kept; spans of further formats are added where they look live.
    ``spans`` are in order of start and kind, positions in code points.

    Null and empty texts have no spans; a null repository or owner is one of
    its own. Every row is judged by itself, repeated rows included. Only
    hashes, never texts, are shuffled, and hot values are reduced to distinct
    owners before they meet.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.col(text_col).alias("text"))
    kind = documents.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(_scan, f"doc_id {kind}, repo string, owner string, spans array<{SPAN}>")
    found = cut_lineage(found.withColumn("row", F.monotonically_increasing_id()))
    single = found.select("row", "repo", "owner", F.explode("spans").alias("span"))
    count = lambda c: single.select("span.value", c).distinct().groupBy("value").agg(F.count(F.lit(1)).alias(f"n_{c}"))
    spread = count("repo").join(count("owner"), "value")
    example = (F.col("n_repo") >= example_owners) | (F.col("n_owner") >= example_owners)
    judged = single.join(spread, single["span.value"] == spread["value"]).select("row", "span", example.alias("example"))
    live = judged.groupBy("row").agg(
        F.sum((~F.col("example")).cast("long")).alias("n_live"),
        F.sum(F.col("example").cast("long")).alias("n_example"),
        F.collect_set(F.when(~F.col("example"), F.col("span.value"))).alias("values"),
    )
    joined = found.join(live, "row", "left")
    shown = F.filter("spans", lambda s: s["base"] | F.array_contains("values", s["value"]))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return joined.select("doc_id", shown.alias("spans"), zero("n_live"), zero("n_example"))
