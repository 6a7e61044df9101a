import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import ASCII_LOWER, awkward, order

from clickloom.llm import lexical
from clickloom.llm.lexical import Hierarchy, search
from clickloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute(docs, items, k=20):
    """Ranked rows of every item, over Python integers."""
    terms = [(d, Counter(TERMS.findall((t or "").translate(ASCII_LOWER)))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in terms]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        scored = []
        for (d, c), size in zip(terms, sizes):
            score = 0
            for t, times in Counter(TERMS.findall((text or "").translate(ASCII_LOWER))).items():
                if tf := c[t]:
                    m = 75 + 25 * size * n // total
                    score += times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("chunk, block_bytes, copies", [(6_000_000, 2_000_000, 8), (4_000, 5_000, 1)])
def test_search_against_brute_force(spark, monkeypatch, chunk, block_bytes, copies):
    """One shard and one block, and many of each; ties, repeated rows, nulls, empty and long texts, clashing columns."""
    monkeypatch.setattr(lexical, "SHARDS_PER_COPY", copies)
    df, rows = awkward(spark)
    rows = [(r[0], r[1]) for r in rows]
    more = [(20_000 + i, "alpha beta gamma"[: 5 + 6 * (i % 3)]) for i in range(60)] + [(None, "alpha beta")]
    docs = df.select("doc_id", "text", "size", "key", "bucket").withColumnsRenamed({"size": "block", "key": "terms", "bucket": "place"})
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    items += [(900, "ALPHA, beta"), (900, "ALPHA, beta"), (901, "İstanbul K w3 w3"), (902, None), (903, "..."), (None, "w3 w4 w5 one"), (904, "nowherefound"), (905, " ".join(f"v{i % 900}" for i in range(3_000)))]
    given = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id long, text string, block int, term string").repartition(3)
    got = search(docs, given, chunk=chunk, block_bytes=block_bytes)
    assert order([tuple(r) for r in got.collect()]) == order(brute([*rows, *more], items))


def test_no_documents_or_items(spark):
    none = spark.createDataFrame([], "doc_id long, text string, item_id long")
    some = spark.createDataFrame([(1, "one two", 1)], "doc_id long, text string, item_id long")
    assert search(none, some).collect() == search(some, none).collect() == search(none, none).collect() == []
    assert [tuple(r) for r in search(some, some).collect()] == brute([(1, "one two")], [(1, "one two")])


def test_nodes_bound_their_members():
    rng = random.Random(2)
    rows = sorted({(rng.randrange(150), rng.randrange(40)): rng.randrange(1, 1000) for _ in range(900)}.items())
    members, terms = (np.array([r[0][i] for r in rows]) for i in (0, 1))
    values = np.array([r[1] for r in rows])
    tree = Hierarchy(members, terms, values, np.ones(40, np.int64), 150, 40, 4)
    assert tree.sizes == [150, 38, 10, 3, 1]
    query, weights = np.array([3, 7, 21]), np.array([5, 1, 9])
    exact = tree.products(0, query, weights, np.ones(150, bool))
    dense = np.zeros((150, 40), np.int64)
    dense[members, terms] = values
    assert (exact == dense[tree.order][:, query] @ weights).all()
    for level, size in enumerate(tree.sizes):
        bounds = tree.products(level, query, weights, np.ones(size, bool))
        assert (bounds[np.arange(150) // 4**level] >= exact).all()


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert order([tuple(r) for r in QUERIES["op13_lexical_search"](spark, FOLDER).collect()]) == order(brute(docs, items))
