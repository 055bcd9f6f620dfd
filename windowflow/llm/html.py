"""Main text of web pages by a recurrent block labeller.

A page is read into its sequence of leaf blocks. Each is a vector of its hashed tag path (tags, class and id
words of its ancestors), its hashed words, all of them, and a few ratios. A bidirectional LSTM in numpy reads the
sequence both ways, so every block is classified with the whole page in view. The weights are in
``html_model.npz``; ``train_html.py`` makes them from generated pages.

Time and memory grow with a page's length, however deep its elements are nested: a block's path is a set of hash
slots in one number, and the network reads a long page stretch by stretch, keeping one score per block.
"""

from __future__ import annotations

import functools
import html
import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from importlib.resources import files
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

PATH_DIMS, WORD_DIMS, EXTRA = 96, 64, 6
INPUT, HIDDEN = PATH_DIMS + WORD_DIMS + EXTRA, 24

#: Blocks, of all pages read together, for which inputs and gates are held at a time.
STRETCH = 8192

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[a-zA-Z/!?][^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>|<[a-zA-Z/!?][^>]*>""", re.S)
_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORD = re.compile(r"[a-z]+")
#: Elements whose content is no text of the page.
HIDDEN_TAGS = frozenset("script style noscript template textarea select svg math iframe object title".split())
#: Elements that leave the flow of a line as it is.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Block(NamedTuple):
    """path has a bit for every hash slot of the ancestors' tags and words."""

    path: int
    text: str
    link_chars: int


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order: runs of text between the starts and ends of block elements."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # open elements and the paths around them
    held: Counter[str] = Counter()
    path = 0
    parts: list[str] = []
    links = [0, 0]  # depth, characters

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(path, text, links[1]))
            parts.clear()
            links[1] = 0

    def close(name: str) -> None:
        nonlocal path
        if not held[name]:
            return
        while True:
            last, path = stack.pop()
            held[last] -= 1
            if last == name:
                return

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else size
        if stop > at:
            chunk = page[at:stop]
            parts.append(chunk)
            if links[0]:
                links[1] += len(chunk)
        if not m:
            break
        at = m.end()
        tag = m[0]
        named = _TAG.match(tag)
        if not named:
            continue
        name = named[1].lower()
        if tag[1] == "/":
            if name == "a":
                links[0] = 0
            if name not in INLINE:
                flush()
                close(name)
            continue
        if name in HIDDEN_TAGS:
            if not tag.endswith("/>"):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            links[0] = 1
        elif name not in INLINE:
            flush()
            if name in VOID:
                continue
            if stack and stack[-1][0] in ("p", name) and (stack[-1][0] == "p" or name in ("li", "tr", "td", "th", "option", "dt", "dd")):
                close(stack[-1][0])
            words = [name] + [f".{w}" for a in _NAMES.findall(tag) for w in _WORD.findall("".join(a).lower())]
            stack.append((name, path))
            held[name] += 1
            for word in words:
                path |= 1 << _slot(word)
    flush()
    return out


def encode(found: list[Block], first: int = 0, last: int | None = None) -> np.ndarray:
    """One vector of INPUT numbers for each block from ``first`` to before ``last`` of a page."""
    own = found[first:last]
    x = np.zeros((len(own), INPUT), np.float32)
    raw = b"".join(b.path.to_bytes(PATH_DIMS // 8, "little") for b in own)
    x[:, :PATH_DIMS] = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(own), -1), axis=1, bitorder="little")
    words = [b.text.lower().split() for b in own]
    sizes = np.array([max(1, len(w)) for w in words])
    slots = np.fromiter(map(_WORDS.__getitem__, itertools.chain.from_iterable(words)), np.int64)
    at = np.repeat(np.arange(len(own)) * WORD_DIMS, [len(w) for w in words]) + slots
    x[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.bincount(at, minlength=len(own) * WORD_DIMS).reshape(len(own), WORD_DIMS) / sizes[:, None]
    for i, b in enumerate(own):
        n = len(b.text)
        x[i, PATH_DIMS + WORD_DIMS :] = (
            math.log1p(n) / 5, min(1.0, b.link_chars / n), sum(map(b.text.count, ".,;!?")) * 10 / n, (first + i) / len(found), 1 / len(found), n < 30,
        )
    return x


class _Words(dict):
    """Word to hash slot; forgets all when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        slot = self[word] = zlib.crc32(word.strip(".,;:!?()\"'").encode("utf-8", "surrogatepass")) % WORD_DIMS
        return slot


_WORDS = _Words()


@functools.lru_cache(65536)
def _slot(word: str) -> int:
    return zlib.crc32(word.encode()) % PATH_DIMS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def run_lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, state: tuple[np.ndarray, np.ndarray] | None = None):
    """Hidden states of x (pages, steps, inputs), and the state after the last step; gates in the order input, forget, output, candidate."""
    pages, steps, _ = x.shape
    z = x @ w + b
    h, c = state or (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
    out = np.empty((pages, steps, HIDDEN), np.float32)
    for t in range(steps):
        g = z[:, t] + h @ u
        gates = _sigmoid(g[:, : 3 * HIDDEN])
        c = gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * np.tanh(g[:, 3 * HIDDEN :])
        h = gates[:, 2 * HIDDEN :] * np.tanh(c)
        out[:, t] = h
    return out, (h, c)


def _scores(pages: list[list[Block]], whole: list[np.ndarray] | None, w: dict[str, np.ndarray], ahead: bool) -> np.ndarray:
    """What one direction says about every block (pages, blocks), read stretch by stretch; whole: the pages' vectors, if few enough to be held."""
    steps = max(map(len, pages))
    names, v = (("wf", "uf", "bf"), w["v"][:HIDDEN]) if ahead else (("wb", "ub", "bb"), w["v"][HIDDEN:])
    out, state = np.zeros((len(pages), steps), np.float32), None
    wide = max(1, STRETCH // len(pages))
    for s in range(0, steps, wide):
        e = min(steps, s + wide)
        x = np.zeros((len(pages), e - s, INPUT), np.float32)
        for k, page in enumerate(pages):
            n = len(page)
            if s < n:
                first, last = (s, min(e, n)) if ahead else (max(0, n - e), n - s)
                own = (whole[k][first:last] if whole else encode(page, first, last))[:: 1 if ahead else -1]
                x[k, : len(own)] = own
        h, state = run_lstm(x, *(w[name] for name in names), state)
        out[:, s:e] = h @ v
    return out


@functools.cache
def model() -> dict[str, np.ndarray]:
    with files(__package__).joinpath("html_model.npz").open("rb") as raw, np.load(raw) as f:  # also from an archive
        return {k: f[k].astype(np.float32) for k in f.files}


def label(pages: list[list[Block]], weights: dict[str, np.ndarray] | None = None) -> list[np.ndarray]:
    """For each page, whether each block is main text. Pages of like length are read together."""
    w = model() if weights is None else weights
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        longest = 1.25 * len(pages[order[at]]) + 4
        group = []
        while at < len(order) and len(group) < 64 and len(pages[order[at]]) <= longest:
            group.append(order[at])
            at += 1
        own = [pages[i] for i in group]
        whole = [encode(p) for p in own] if sum(map(len, own)) <= STRETCH else None
        one, other = _scores(own, whole, w, True), _scores(own, whole, w, False)
        for k, i in enumerate(group):
            n = len(pages[i])
            out[i] = one[k, :n] + other[k, :n][::-1] + w["c"] > 0
    return out


def extract(pages: list[str | None]) -> list[str]:
    found = [blocks(p or "") for p in pages]
    return ["\n\n".join(b.text for b, good in zip(p, keep, strict=True) if good) for p, keep in zip(found, label(found), strict=True)]


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row: the blocks of main text joined by blank lines.

    A null or empty page, or one without main text, gives an empty text; null and repeated ids are
    returned as they are; no rows give no rows; other columns are dropped. Markup that isn't closed, or nested
    however deep, is read as far as it goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(extract(part.column(2).to_pylist()), pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.transform(in_arrow, run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
