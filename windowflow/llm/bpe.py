"""Byte-level BPE with vectorised pre-tokenisation.

Texts become arrays of code points and of their classes. Where a pre-token begins depends on a small state
that every code point transforms: a transition function over four states fits in one byte and the
composition of two functions is one lookup, so an associative scan over whole arrays gives the state before
every code point. The slices between boundaries are merged once each and found in a cache afterwards.

The pre-tokens are those of the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Code points scanned at a time; a longer text is scanned in parts.
SCAN = 1 << 19
#: Pre-tokens of a cache's generation; two are held.
CACHE = 200_000


@functools.cache
def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LN":
            out[cp] = LETTER if kind == "L" else NUMBER
    # fixed values: the code points with the property White_Space
    for lo, hi in ((9, 13), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[lo : hi + 1] = SPACE
    return out


# The state before a code point: nothing open, a run open, a space that joins what follows, a contraction open.
CLOSED, RUN, JOIN, SHORT = range(4)


def _function(*to: int) -> int:
    return sum(t << 2 * s for s, t in enumerate(to))


IDENTITY = _function(0, 1, 2, 3)
_ALL_CLOSED, _ALL_RUN, _ALL_JOIN = (_function(*[x] * 4) for x in (CLOSED, RUN, JOIN))
_APOSTROPHE = _function(SHORT, SHORT, RUN, RUN)
_SHORT_END = _function(RUN, RUN, RUN, CLOSED)
_SHORT_MID = _function(RUN, RUN, RUN, SHORT)


@functools.cache
def _compose() -> np.ndarray:
    """[first << 8 | second]: the function that applies first, then second."""
    code = np.arange(256)
    first, second = code[:, None], code[None, :]
    out = np.zeros((256, 256), np.uint16)
    for s in range(4):
        out |= (((second >> 2 * ((first >> 2 * s) & 3)) & 3) << 2 * s).astype(np.uint16)
    return out.astype(np.uint8).ravel()


def scan(functions: np.ndarray) -> np.ndarray:
    """The state after each position, from CLOSED: an associative scan in rows of 64."""
    n = len(functions)
    if n <= 64:
        states, s = np.empty(n, np.uint8), CLOSED
        for i, f in enumerate(functions.tolist()):
            s = f >> 2 * s & 3
            states[i] = s
        return states
    rows = -(-n // 64)
    table = np.full(rows * 64, IDENTITY, np.uint8)
    table[:n] = functions
    table = np.ascontiguousarray(table.reshape(rows, 64).T)
    compose = _compose()
    for j in range(1, 64):
        table[j] = compose.take(table[j - 1].astype(np.uint16) << 8 | table[j])
    before = np.concatenate(([CLOSED], scan(table[63])[:-1])).astype(np.uint8)
    table >>= 2 * before
    table &= 3
    return table.T.ravel()[:n]


def starts(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each of the code points of texts laid end to end."""
    n = len(points)
    cls = _classes().take(points)
    lengths = lengths[lengths > 0]
    first = np.zeros(n, bool)
    first[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = True
    last = np.roll(first, -1)
    space = cls == SPACE
    next_word = np.concatenate((~space[1:], [False])) & ~last  # followed by something in its own text
    join = (points == 32) & next_word
    functions = np.full(n, _ALL_RUN, np.uint8)
    functions[space] = _ALL_CLOSED
    functions[join] = _ALL_JOIN
    for i in np.flatnonzero((points == 39) & ~last).tolist():
        after = chr(points[i + 1])
        k = 1 if after in "stmd" else 0
        if not k and i + 2 < n and not last[i + 1] and after + chr(points[i + 2]) in ("re", "ve", "ll"):
            k = 2
        if k and (first[i] or cls[i - 1] != OTHER):
            functions[i] = _APOSTROPHE
            functions[i + 1 : i + k] = _SHORT_MID
            functions[i + k] = _SHORT_END
    opening = functions[first]
    functions[first] = np.array([_function(*[x] * 4) for x in range(4)], np.uint8)[opening & 3]
    state = np.concatenate(([CLOSED], scan(functions)[:-1])).astype(np.uint8)
    changed = np.concatenate(([True], cls[1:] != cls[:-1]))
    before_space = np.concatenate(([False], space[:-1]))
    word = ~space & ((state == CLOSED) | (state == RUN) & changed)
    return first | word | join | space & ~join & (~before_space | next_word)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def cuts(text: str) -> np.ndarray:
    """Where a text can be cut so that its parts, one by one, have the pre-tokens of the whole.

    A pre-token begins there and the character before is no white space, for what white space becomes depends on
    what follows it; everything else is decided by what stands before.
    """
    points = _points(text)
    if not len(points):
        return np.empty(0, np.int64)
    space = _classes().take(points) == SPACE
    return np.flatnonzero(starts(points, np.array([len(points)]))[1:] & ~space[:-1]) + 1


def is_cut(left: str, right: str) -> bool:
    """Whether two texts can be laid end to end without changing their pre-tokens; ``left`` begins at a cut."""
    cls = _classes()
    if not left or not right or cls[ord(left[-1])] == SPACE:
        return False
    if cls[ord(right[0])] == SPACE:
        return True
    points = _points(left + right[:4])
    return bool(starts(points, np.array([len(points)]))[len(left)])


# fixed values: the code points with the property White_Space
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space behind something else: always a place of ``cuts``.
EDGE = re.compile(f"(?<=[^{_WHITE}])[{_WHITE}]")


def next_cut(text: str, at: int, least: int) -> int | None:
    """The first cut at least ``least`` characters behind the cut ``at``; none if the rest of the text has none."""
    reach = 2 * least
    while True:
        found = cuts(text[at : at + reach + 4])  # a cut looks at most three characters ahead
        found = found[(found >= least) & (found <= reach)]
        if len(found):
            return at + int(found[0])
        if at + reach >= len(text):
            return None
        reach *= 2


def chunks(text: str, size: int) -> Iterator[str]:
    """The text in parts of about ``size`` characters that can be encoded one by one; longer only where it has no cut."""
    at = 0
    while len(text) - at > size:
        reach = size
        while True:
            found = cuts(text[at : at + reach + 4])  # a cut looks at most three characters ahead
            found = found[found <= reach]
            if len(found) or at + reach >= len(text):
                break
            reach *= 2
        if not len(found):
            break
        yield text[at : at + int(found[-1])]
        at += int(found[-1])
    yield text[at:]


def pieces(texts: list[str]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """For each text its pre-tokens as bytes and the byte offsets at which they begin."""
    group: list[str] = []
    size = 0
    for text in texts:
        if group and size + len(text) > SCAN:
            yield from _pieces(group)
            group, size = [], 0
        if len(text) > SCAN:
            found, where, done = [], [], 0
            for own, at in (x for part in chunks(text, SCAN) for x in _pieces([part])):
                found += own
                where.append(at + np.uint32(done))
                done += sum(map(len, own))
            yield found, np.concatenate(where)
            continue
        group.append(text)
        size += len(text)
    if group:
        yield from _pieces(group)


def _pieces(texts: list[str]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    whole = "".join(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    if not whole:
        yield from (([], np.empty(0, "<u4")) for _ in texts)
        return
    raw = whole.encode("utf-8", "surrogatepass")
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.flatnonzero(starts(points, lengths))
    if len(raw) == len(points):
        where = at
    else:
        width = np.ones(len(points), np.int64)
        for least in (0x80, 0x800, 0x10000):
            width += points >= least
        where = (np.cumsum(width) - width)[at]
    edges = np.append(where, len(raw)).tolist()
    found = [raw[s:e] for s, e in zip(edges[:-1], edges[1:], strict=True)]
    cuts = np.searchsorted(at, np.concatenate(([0], np.cumsum(lengths))))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = where[i:j]
        yield found[i:j], (own - own[0] if j > i else own).astype("<u4")


@functools.lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def load_vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a byte-level ``tokenizers`` file; tokens like <|this|> are left out."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    # byte-level files show each byte as a printable character: printable Latin-1 as itself, the rest from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if not (token.startswith("<|") and token.endswith("|>"))}


#: Fixed value: the pattern of the module's pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space that is too long for the pattern: matching it goes back step by step, on a stack.
LONG_SPACE = 20_000
_LONG_SPACE = re.compile(rf"(?<!\s)\s{{{LONG_SPACE},}}")


class Encoder:
    """A compiled library's encoder for a vocabulary, which no text can bring down: long white space goes through this module's own scan."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) < LONG_SPACE or not _LONG_SPACE.search(text):
            return self.library.encode_ordinary(text)
        out: list[int] = []
        for part in chunks(text, 1 << 16):
            if not _LONG_SPACE.search(part):
                out += self.library.encode_ordinary(part)
                continue
            ((found, _),) = _pieces([part])
            for piece in found:
                out += self.library._encode_single_piece(piece)
        return out

    def tokens(self, text: str) -> list[bytes]:
        return self.library.decode_tokens_bytes(self.encode(text))


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder of a file of ranks or, if its name ends in .json, of a byte-level ``tokenizers`` file without its added tokens."""
    return Encoder(load_vocabulary(path) if path.endswith(".json") else load_ranks(path))


class Merges(dict):
    """Pre-token to its ids as little-endian 32-bit bytes.

    When it is full it starts anew and keeps its last contents to look in first, so its memory is bounded and what comes often stays.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.last = ranks, {}

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.last.get(piece)
        if ids is None:
            ids = np.array(self.merge(piece), "<u4").tobytes()
            if len(piece) > 64:
                return ids
        if len(self) >= CACHE:
            self.last = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def merge(self, piece: bytes) -> list[int]:
        """Joins the adjacent pair of lowest rank, leftmost first, until no pair is known."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        end, back, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                back[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := ranks.get(piece[back[i] : stop])) is not None:
                heapq.heappush(heap, (r, back[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out


@functools.lru_cache(1)
def merges(path: str) -> Merges:
    """One cache for all tasks of a worker."""
    return Merges(load_ranks(path))


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian 32-bit), offsets (byte offset of each pre-token, 32-bit) per row of ``docs``.

    A null text counts as empty and has no ids; a null or repeated id is returned as it is; no rows give no
    rows; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = merges(ranks_path)
        for batch in batches:
            for part in slices(batch):
                ids, offsets = [], []
                for found, where in pieces([t or "" for t in part.column(1).to_pylist()]):
                    ids.append(b"".join(map(merged.__getitem__, found)))
                    offsets.append(where.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(offsets, pa.binary())], ["doc_id", "ids", "offsets"]
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(
        in_arrow, run, "doc_id long, ids binary, offsets binary"
    )


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The rows of ``encode_documents`` with decoded (binary) instead of offsets: the tokens' bytes, joined.

    Each row's last pre-token offset must lie in the decoded bytes, which guards against cut or mixed-up ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(ranks_path)
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        for batch in batches:
            for part in slices(batch):
                out = []
                for ids, offsets in zip(part.column(1), part.column(2), strict=True):
                    raw = b"".join([tokens[i] for i in np.frombuffer(ids.as_buffer(), "<u4").tolist()])
                    where = np.frombuffer(offsets.as_buffer(), "<u4")
                    if len(where) and where[-1] >= len(raw):
                        raise ValueError("ids end before their last pre-token")
                    out.append(raw)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(out, pa.binary()), pa.array([len(x) // 4 for x in part.column(2).to_pylist()], pa.int64())],
                    ["doc_id", "ids", "decoded", "n_pieces"],
                )

    return encoded.select("doc_id", "ids", "offsets").transform(in_arrow, run, "doc_id long, ids binary, decoded binary, n_pieces long")

