"""Small inputs with awkward rows, and plain reference versions of the operators."""

from __future__ import annotations

import re
from collections import defaultdict
from hashlib import sha256

FOLDER = "/root/testdata/sf0.001"
SPACE_WORDS = re.compile("[^\x20\x09-\x0d]+")
ALNUM_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def awkward(spark, with_null_id: bool = True):
    """Documents of the smallest table plus nulls, empties, repeats, long texts and columns with clashing names."""
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "source").collect()
    rows = [(r.doc_id, r.text, r.source) for r in given]
    passage = " ".join(f"w{i}" for i in range(40))
    rows += [
        (10_001, None, "src1"),
        (10_002, "", None),
        (10_003, " \t\n ", None),
        (10_004, "one", "lonely"),
        (10_005, "one", "lonely"),
        (10_006, " ONE\x0bTwo  three\nfour ", "src1"),
        (10_007, f"{passage} between {passage} {passage}", "src2"),
        (10_008, f"İstanbul ΑΣ {passage} ſecret K 😀 end", "src2"),
        (10_009, " ".join(f"v{i % 900}" for i in range(9_000)), "src3"),
        (10_010, "a\n\na\nb \n b\n#$%|<>&*", "src3"),
        (rows[3][0], rows[3][1], rows[3][2]),
    ]
    if with_null_id:
        rows.append((None, f"nobody {passage}", "src4"))
    clash = [(*r, 1, "x", True, 2, 3) for r in rows]
    names = "doc_id long, text string, source string, size int, key string, kept boolean, __parts int, bucket int"
    return spark.createDataFrame(clash, names).repartition(3), rows


def components(rows):
    sets = []
    for doc, text, *_ in rows:
        words = SPACE_WORDS.findall((text or "").translate(ASCII_LOWER))
        sets.append((doc, frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()))
    group = list(range(len(sets)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                group[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(sets):
        least[root(i)].append(doc)
    return [(doc, len(s), min((d for d in least[root(i)] if d is not None), default=None)) for i, (doc, s) in enumerate(sets)]


def without_repeats(rows, width=20):
    first = {}
    key = lambda doc: (doc is not None, doc)
    texts = [(doc, SPACE_WORDS.findall(text or "")) for doc, text, *_ in rows]
    for doc, words in texts:
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            first[w] = min(first.get(w, key(doc)), key(doc)) if w in first else key(doc)
    out = []
    for doc, words in texts:
        gone, seen = set(), set()
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            if first[w] != key(doc) or w in seen:
                gone.update(range(i, i + width))
            seen.add(w)
        out.append((doc, len(words), len(gone), " ".join(x for i, x in enumerate(words) if i not in gone)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: [(x is not None, str(type(x)), x) for x in r])
