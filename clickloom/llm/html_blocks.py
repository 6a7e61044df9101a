"""Main text of web pages: a recurrent labeller over all blocks of a page.

A page becomes the sequence of its leaf blocks. Each block has a vector of
hashed tag-path parts and hashed words; a bidirectional LSTM in numpy reads the
sequence both ways, so that every verdict sees the whole page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PATHS, WORDS, SHAPE = 64, 32, 6
INPUT = PATHS + WORDS + SHAPE
HIDDEN = 16
SAMPLE_PAGES = 300  # bound of the sample that the labeller is trained on
EPOCHS = 60
CELLS = 20_000  # blocks, padding included, that are labelled at once

# Element names and the words that name a part of a page.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("head title script style noscript template svg select button option textarea".split())
HEAD_TAGS = frozenset("head html base basefont bgsound link meta title noscript noframes style script template".split())
CLOSED_BY_SAME = frozenset("p li dd dt td th tr option".split())
CHROME_TAGS = ("nav", "header", "footer", "aside", "form", "menu", "dialog")
CHROME_NAMES = ("ad", "ads", "advert", "banner", "sidebar", "cookie", "notice", "popup", "promo", "related", "share", "social", "comment", "comments", "replies", "breadcrumb", "menu", "newsletter", "signup", "footer", "header", "sponsor", "widget")
MAIN_TAGS = ("article", "main")
PLAIN_TAGS = ("div", "section")
PLAIN_NAMES = ("content", "post", "entry", "body", "text", "story", "page")  # in training only; half the containers have no name

_token = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S | re.I)
_names = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_space = re.compile(r"\s+")


def page_blocks(page: str) -> list[tuple[str, tuple[str, ...], float]]:
    """``text, path, link share`` of every leaf block with text, in page order.

    Character references are decoded and white space runs become one space.
    """
    blocks, path, parts, linked, total, in_link, last = [], [], [], 0, 0, 0, 0

    def close() -> None:
        nonlocal parts, linked, total
        if parts:
            text = _space.sub(" ", html.unescape("".join(parts))).strip()
            if text and path and path[-1][0] == "head":
                path.pop()
            if text and not any(name in HIDDEN_TAGS for name, _ in path):
                blocks.append((text, tuple(part for _, own in path for part in own), linked / max(total, 1)))
        parts, linked, total = [], 0, 0

    def say(text: str) -> None:
        nonlocal linked, total
        if text:
            parts.append(text)
            total += len(text)
            linked += len(text) * (in_link > 0)

    for m in _token.finditer(page):
        say(page[last : m.start()])
        last = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name == "a":
            in_link = 0 if m[2] else 1
        if name == "br":
            say(" ")
        if not m[2] and name not in HEAD_TAGS and path and path[-1][0] == "head":
            close()
            if path and path[-1][0] == "head":
                path.pop()  # its end tag may be left out
        if name not in BLOCK_TAGS:
            continue
        close()
        if m[2]:
            if any(n == name for n, _ in path):
                while path.pop()[0] != name:
                    pass
            continue
        if path and (path[-1][0] == "p" or path[-1][0] == name and name in CLOSED_BY_SAME):
            path.pop()
        if name not in VOID_TAGS:
            named = [part.lower() for found in _names.findall(m[4]) for part in re.split(r"[\s_-]+", "".join(found)) if part]
            path.append((name, (name, *[f".{part}" for part in named])))
    say(page[last:])
    close()
    return blocks


@lru_cache(maxsize=65_536)
def _slot(text: str, n: int) -> int:
    return crc32(text.encode()) % n


def block_vectors(blocks: list[tuple[str, tuple[str, ...], float]]) -> np.ndarray:
    out = np.zeros((len(blocks), INPUT), np.float32)
    for i, (text, path, link) in enumerate(blocks):
        row = out[i]
        for part in path:
            row[_slot(part, PATHS)] += 1
        row[_slot("leaf " + (path[-1] if path else ""), PATHS)] += 1
        words = text.split(" ")
        for word in words:
            row[PATHS + _slot(word.lower(), WORDS)] += 1
        row[PATHS : PATHS + WORDS] /= len(words)
        row[PATHS + WORDS :] = (np.log1p(len(text)) / 8, link, np.log1p(len(words)) / 6, text[-1] in ".!?", i / len(blocks), 1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _pass(x: np.ndarray, mask: np.ndarray, w: np.ndarray, keep: list | None = None) -> np.ndarray:
    """One LSTM over ``x`` (pages, steps, inputs); padded steps carry the state on."""
    n, steps, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out = np.zeros((n, steps, HIDDEN), np.float32)
    gates_x = x @ w[:INPUT] + w[-1]
    for t in range(steps):
        z = gates_x[:, t] + h @ w[INPUT:-1]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[:, t, None]
        before = (h, c)
        fresh = f * c + i * g
        c = m * fresh + (1 - m) * c
        tanh = np.tanh(fresh)
        h = m * o * tanh + (1 - m) * h
        out[:, t] = h
        if keep is not None:
            keep.append((i, f, o, g, tanh, m, *before))
    return out


def _back(x: np.ndarray, w: np.ndarray, kept: list, d_out: np.ndarray) -> np.ndarray:
    grad = np.zeros_like(w)
    d_h, d_c = np.zeros_like(kept[0][6]), np.zeros_like(kept[0][7])
    for t in reversed(range(x.shape[1])):
        i, f, o, g, tanh, m, h0, c0 = kept[t]
        d_h = d_h + d_out[:, t]
        live = d_h * m
        d_fresh = d_c * m + live * o * (1 - tanh**2)
        z = np.concatenate([d_fresh * g * i * (1 - i), d_fresh * c0 * f * (1 - f), live * tanh * o * (1 - o), d_fresh * i * (1 - g**2)], axis=1)
        grad[:INPUT] += x[:, t].T @ z
        grad[INPUT:-1] += h0.T @ z
        grad[-1] += z.sum(0)
        d_c = d_c * (1 - m) + d_fresh * f
        d_h = d_h * (1 - m) + z @ w[INPUT:-1].T
    return grad


def _padded(vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, vectors))
    x, mask = np.zeros((len(vectors), steps, INPUT), np.float32), np.zeros((len(vectors), steps), np.float32)
    for k, v in enumerate(vectors):
        x[k, : len(v)], mask[k, : len(v)] = v, 1
    return x, mask


Weights = dict[str, np.ndarray]


def label(vectors: list[np.ndarray], weights: Weights) -> list[np.ndarray]:
    """Probability of main text for every block of every page, in bounded batches."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(vectors)
    order = sorted((k for k, v in enumerate(vectors) if len(v)), key=lambda k: len(vectors[k]))
    while order:
        take = [order.pop()]
        longest = len(vectors[take[0]])
        while order and (len(take) + 1) * longest <= CELLS:
            take.append(order.pop())
        x, mask = _padded([vectors[k] for k in take])
        both = np.concatenate([_pass(x, mask, weights["ahead"]), _pass(x[:, ::-1], mask[:, ::-1], weights["back"])[:, ::-1]], axis=2)
        p = _sigmoid(both @ weights["out"][:-1] + weights["out"][-1])[:, :, 0]
        for row, k in enumerate(take):
            out[k] = p[row, : len(vectors[k])]
    return out


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 7) -> Weights:
    """Fit by back-propagation through time with Adam on ``vectors, labels`` of each page."""
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) * 0.15).astype(np.float32)
    weights = {"ahead": draw(INPUT + HIDDEN + 1, 4 * HIDDEN), "back": draw(INPUT + HIDDEN + 1, 4 * HIDDEN), "out": draw(2 * HIDDEN + 1, 1)}
    moment = {k: [np.zeros_like(w), np.zeros_like(w)] for k, w in weights.items()}
    pages = sorted((p for p in pages if len(p[1])), key=lambda p: len(p[1]))
    lots = [pages[i : i + 32] for i in range(0, len(pages), 32)]
    turn = 0
    for _ in range(epochs):
        for lot in rng.permutation(len(lots)):
            x, mask = _padded([v for v, _ in lots[lot]])
            y, _ = np.zeros(mask.shape, np.float32), None
            for k, (_, labels) in enumerate(lots[lot]):
                y[k, : len(labels)] = labels
            kept: tuple[list, list] = [], []
            h = np.concatenate([_pass(x, mask, weights["ahead"], kept[0]), _pass(x[:, ::-1], mask[:, ::-1], weights["back"], kept[1])[:, ::-1]], axis=2)
            p = _sigmoid(h @ weights["out"][:-1] + weights["out"][-1])[:, :, 0]
            d = ((p - y) * mask / mask.sum())[:, :, None]
            grads = {"out": np.concatenate([np.tensordot(h, d, ([0, 1], [0, 1])), d.sum((0, 1))[None]])}
            d_h = d @ weights["out"][:-1].T
            grads["ahead"] = _back(x, weights["ahead"], kept[0], d_h[:, :, :HIDDEN])
            grads["back"] = _back(x[:, ::-1], weights["back"], kept[1], d_h[:, ::-1, HIDDEN:])
            turn += 1
            for k, g in grads.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g**2 - v)
                weights[k] -= 0.01 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return weights


def taught(path: tuple[str, ...]) -> bool:
    """The teacher's verdict from the path alone: inside the article and in no part around it."""
    chrome = any(part in CHROME_TAGS or part[:1] == "." and part[1:] in CHROME_NAMES for part in path)
    return not chrome and any(part in MAIN_TAGS for part in path)


def training_pages(pages: list[str], seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each page as it is, with parts of other layouts put in, and with these but without article and main.

    The last has divisions or sections in their place, named or not, and the
    labels of the page before.
    The added blocks use text of the sample itself; menus, notices, side bars,
    forms and comments come before, inside and after the article.
    """
    rng = np.random.default_rng(seed)
    found = [page_blocks(p) for p in pages]
    texts = [t for blocks in found for t, _, _ in blocks] or [""]
    some = lambda: texts[rng.integers(len(texts))]
    out = []
    for blocks in found:
        wrap = rng.random() < 0.5
        mixed = []
        for text, path, link in blocks:
            if wrap and "article" in path:
                path = tuple({"article": "main"}.get(part, part) for part in path)
            mixed.append((text, path, link))
            if rng.random() < 0.15:
                inside = path if taught(path) and rng.random() < 0.5 else path[:2]
                if rng.random() < 0.5:
                    extra = (*inside, CHROME_TAGS[rng.integers(len(CHROME_TAGS))], "p")
                else:
                    extra = (*inside, ("div", "section", "ul")[rng.integers(3)], "." + CHROME_NAMES[rng.integers(len(CHROME_NAMES))], ("p", "li", "div")[rng.integers(3)])
                mixed.append((some(), extra, float(rng.random() < 0.3)))
        tag = PLAIN_TAGS[rng.integers(len(PLAIN_TAGS))]
        box = (tag, "." + PLAIN_NAMES[rng.integers(len(PLAIN_NAMES))]) if rng.random() < 0.5 else (tag,)
        plain = [(text, tuple(p for part in path for p in (box if part in MAIN_TAGS else (part,))), link) for text, path, link in mixed]
        for page, teacher in ((blocks, blocks), (mixed, mixed), (plain, mixed)):
            out.append((block_vectors(page), np.array([taught(path) for _, path, _ in teacher], np.float32)))
    return out


def fit_labeller(pages: DataFrame, sample: int = SAMPLE_PAGES, id_col: str = "page_id", html_col: str = "html", longest: int = 200_000) -> Weights:
    """Weights fitted on at most ``sample`` pages, chosen by hash, of at most ``longest`` characters each.

    Both bounds hold only here: every page is labelled, whatever its length. The
    ids are chosen first, and then one page is fetched for each, so that a task
    sends ``sample`` ids and no pages that are not used. Pages without an id are
    not chosen. Without pages, as in an empty table, the weights are fitted on
    nothing and stay as they start.
    """
    short = pages.select(F.col(id_col).alias("i"), F.col(html_col).alias("h")).filter(F.col("i").isNotNull() & F.col("h").isNotNull() & (F.length("h") <= longest))
    chosen = [r["i"] for r in short.select(F.xxhash64("i").alias("o"), "i").distinct().orderBy("o", "i").limit(sample).collect()]
    rows = short.filter(F.col("i").isin(chosen)).groupBy(F.xxhash64("i").alias("o"), "i").agg(F.min("h").alias("h")).orderBy("o", "i").collect()
    return train(training_pages([r["h"] for r in rows]))


def _extract(weights: Weights):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                pages = [page_blocks(h or "") for h in part.column(2).to_pylist()]
                chances = label([block_vectors(p) for p in pages], weights)
                texts = ["\n".join(text for (text, _, _), p in zip(blocks, chance) if p >= 0.5) for blocks, chance in zip(pages, chances)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return extract


def extract_text(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` for every row of ``pages``.

    Blocks labelled as main text are joined by line breaks in page order. A
    null, empty or text-free page gives an empty text; rows are independent, so
    repeated rows give equal texts, and null ids and urls are passed through.
    """
    kind = lambda c: pages.schema[c].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract(weights), f"page_id {kind(id_col)}, url {kind(url_col)}, text string")
