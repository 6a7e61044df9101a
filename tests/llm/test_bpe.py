import base64
import random

import public_tokenizers
import pytest
import tiktoken
from cases import awkward, digest, order

from clickloom.llm import bpe
from clickloom.llm.bpe import Encoder, decode_ids, encode_documents, merge
from clickloom.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return Encoder(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def encoded(own, texts):
    ids, ends = own.encode(texts)
    return [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]


def test_every_character_in_four_places(own, reference):
    for lo in range(0, 0x110000, 0x8000):
        texts = [f"a{c}1{c}!{c} {c}" for c in map(chr, range(lo, lo + 0x8000, 1 if lo < 0x8000 else 7)) if not 0xD800 <= ord(c) < 0xE000]
        assert encoded(own, texts) == reference.encode_ordinary_batch(texts)


def test_random_and_long_pieces(own, reference, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aAeintsor  \n\t'éñü漢字1234.,!?😀-_\0") for _ in range(rng.randint(0, 300))) for _ in range(500)]
    texts += ["a" * 20_000, " " * 5_000 + "x", "ab" * 9_999, "é" * 3_000, "the" * 5_000, "x\0\0", "<|endoftext|>"]
    want = reference.encode_ordinary_batch(texts)
    assert encoded(own, texts) == want
    monkeypatch.setattr(bpe, "PIECES", 10)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    assert encoded(own, texts) == want and encoded(own, texts[::-1]) == want[::-1]


def test_a_vocabulary_whose_ranks_are_no_order_of_merges():
    """Tokens above their parts in rank, and tokens that no merges reach: compatibility falls back to merging."""
    rng = random.Random(5)
    tokens = [bytes([b]) for b in range(256)]
    more = ["abc", "ab", "bc", "cab", "ca", "abab", "bca", "aa", "aaa", "cc", "abcabc"]
    for turn in range(20):
        rng.shuffle(more)
        lines = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate([*tokens, *(m.encode() for m in more)]))
        own = Encoder(lines, r"[a-c]+")
        reference = tiktoken.Encoding("small", pat_str=r"[a-c]+", mergeable_ranks=own.ranks, special_tokens={})
        texts = ["".join(rng.choice("aabc") for _ in range(rng.randint(1, 14))) for _ in range(60)]
        assert encoded(own, texts) == reference.encode_ordinary_batch(texts), turn
        if not own.ordered:
            continue
        for a in own.sizes:
            for b in own.sizes:
                both = [own.tokens[a], own.tokens[b]]
                assert own.compatible(a, b) == (merge(b"".join(both), own.ranks) == both)
    with pytest.raises(ValueError):
        Encoder(b"YQ== 0", ".")


def test_short_pieces_need_no_automaton(own, reference, monkeypatch):
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choice("abcdeinorst\u00e9\u6f22") for _ in range(rng.randint(1, 16))) for _ in range(40)) for _ in range(30)]
    own.forget()
    monkeypatch.setattr(own, "automaton", None)
    assert encoded(own, texts) == reference.encode_ordinary_batch(texts)


def test_documents_round_trip(spark, reference):
    df, rows = awkward(spark)
    df = df.withColumnsRenamed({"size": "ids", "key": "decoded"})
    got = decode_ids(encode_documents(df, PATH, public_tokenizers.PATTERN), PATH)
    assert got.columns == ["doc_id", "ids", "decoded"]
    found = [(r.doc_id, ",".join(map(str, r.ids)), bytes(r.decoded).decode()) for r in got.collect()]
    assert order(found) == order((d, ",".join(map(str, reference.encode_ordinary(t or ""))), t or "") for d, t, _ in rows)
    none = encode_documents(df.limit(0), PATH, public_tokenizers.PATTERN)
    assert decode_ids(none, PATH).collect() == []
    some = spark.createDataFrame([(1, None), (2, []), (3, [50, 51])], "x int, ids array<int>")
    assert [(r.x, r.decoded and bytes(r.decoded)) for r in decode_ids(some, PATH).orderBy("x").collect()][:2] == [(1, None), (2, b"")]
    for wrong in ([10_000_000], [None]):
        with pytest.raises(Exception):
            decode_ids(spark.createDataFrame([(wrong,)], "ids array<int>"), PATH).collect()


def test_query(spark, reference):
    folder = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = reference.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(r.text or "")))
    assert order([tuple(r) for r in QUERIES["op11_byte_bpe"](spark, folder).collect()]) == order(want)
