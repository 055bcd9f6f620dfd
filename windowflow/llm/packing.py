"""Hierarchical multi-length packing of documents into training sequences.

A document's ids fill whole windows of the longest context first. What remains is routed to the smallest
context tier that holds it (128, 256, 512 or 1024 tokens). Each tier packs its remainders: a remainder
opens a window of its tier, the gap behind it is filled with the largest remainder of a shorter tier that
fits, and when none fits the next one is cut to close the gap. Windows shorter than the longest context
are full, so only the last window of a block of documents can need padding. Windows of equal length are
dealt to step groups of equal token counts, balanced by attention cost (the sum of squared piece lengths).

Every task packs what it reads, block by block, so nothing is shuffled and memory is bounded by a block.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import in_arrow

TIERS = (128, 256, 512, 1024)
LONGEST = TIERS[-1]
#: Remainders packed together, and tokens of a step group.
BLOCK, STEP_TOKENS = 4096, 16 * LONGEST
#: Pieces of an Arrow batch that goes out.
OUT = 512

SCHEMA = (
    "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, tier int, padding long, step_group long"
)


@functools.lru_cache(2)
def load_encoder(path: str):
    """text -> ids as the library gives them by default: strings of added tokens are matched before all else."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: added tokens that look at words or white space around them are not supported")
    plain = encoder(path).encode
    ids = {t["content"]: t["id"] for t in added}
    if not ids:
        return plain
    strings = re.compile("(" + "|".join(re.escape(x) for x in sorted(ids, key=len, reverse=True)) + ")")

    def encode(text: str) -> list[int]:
        parts = strings.split(text)
        if len(parts) == 1:
            return plain(text)
        return [i for k, part in enumerate(parts) for i in ([ids[part]] if k % 2 else plain(part))]

    return encode


class Piece:
    """Ids of one document from a start on, in one sequence."""

    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, n: int) -> tuple[Piece, Piece | None]:
        if n >= len(self.ids):
            return self, None
        return Piece(self.doc, self.start, self.ids[:n], self.total), Piece(self.doc, self.start + n, self.ids[n:], self.total)


def tier_of(length: int) -> int:
    return next(t for t in TIERS if length <= t)


class _Shelf:
    """Remainders by length; takes the longest up to a bound."""

    def __init__(self) -> None:
        self.by: dict[int, list[Piece]] = defaultdict(list)
        self.lengths: list[int] = []

    def put(self, piece: Piece) -> None:
        n = len(piece.ids)
        if not self.by[n]:
            heapq.heappush(self.lengths, -n)
        self.by[n].append(piece)

    def __bool__(self) -> bool:
        return bool(self.lengths)

    def longest(self) -> Piece:
        n = -self.lengths[0]
        piece = self.by[n].pop()
        if not self.by[n]:
            heapq.heappop(self.lengths)
        return piece

    def fitting(self, bound: int) -> Piece | None:
        n = max((m for m in self.by if m <= bound and self.by[m]), default=0)
        if not n:
            return None
        piece = self.by[n].pop()
        if not self.by[n]:
            self.lengths.remove(-n)
            heapq.heapify(self.lengths)
        return piece


def pack_block(remainders: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """Windows (tier, pieces). All but the last are full."""
    shelf = {t: _Shelf() for t in TIERS}
    for piece in remainders:
        shelf[tier_of(len(piece.ids))].put(piece)
    windows = []
    for tier in reversed(TIERS):
        own = shelf[tier]
        while own:
            row = [own.longest()]
            gap = tier - len(row[0].ids)
            while gap:
                shorter = next((s for t in reversed(TIERS) if t <= tier and (s := shelf[t])), None)
                if shorter is None:
                    break
                piece = next((p for t in reversed(TIERS) if t <= tier and t // 2 < gap and shelf[t] and (p := shelf[t].fitting(gap))), None)
                if piece is None:
                    piece, rest = shorter.longest().cut(gap)
                    if rest is not None:
                        shelf[tier_of(len(rest.ids))].put(rest)
                row.append(piece)
                gap -= len(piece.ids)
            windows.append((tier, row))
    return windows


class _Writer:
    def __init__(self, task: int):
        self.sequence = self.step = task << 40

    def rows(self, windows: list[tuple[int, list[Piece]]]) -> Iterator[tuple]:
        by_tier: dict[int, list[tuple[int, list[Piece]]]] = defaultdict(list)
        for tier, row in windows:
            by_tier[tier].append((sum(len(p.ids) ** 2 for p in row), row))
        for tier, found in sorted(by_tier.items()):
            found.sort(key=lambda x: -x[0])
            groups = -(-len(found) * tier // STEP_TOKENS)
            for i, (_, row) in enumerate(found):
                turn, at = divmod(i, groups)
                at = groups - 1 - at if turn % 2 else at  # there and back, so costs even out
                used = sum(len(p.ids) for p in row)
                padding = 0 if used & (used - 1) == 0 else LONGEST - used
                offset = 0
                for p in row:
                    raw = p.ids.tobytes()
                    yield (p.doc, p.start, len(p.ids), raw, zlib.crc32(raw), p.total, self.sequence, offset, tier, padding, self.step + at)
                    offset += len(p.ids)
                self.sequence += 1
            self.step += groups


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """One row per piece: where a run of a document's ids lies in which sequence, and the ids themselves.

    Every document ends with ``end_id``, so a null or empty text is one id. Each id lies in exactly one
    piece; a sequence's offsets have no gaps from 0; sequences are padded to 1024 unless their length is
    a power of two. Null and repeated ids are returned as they are; no rows give no rows; other
    columns are not looked at. Sequence and step numbers carry the task's number above bit 40.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = load_encoder(vocabulary), _Writer(TaskContext.get().partitionId())
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in SCHEMA.split(", ")]
        pending: list[Piece] = []
        full: list[tuple[int, list[Piece]]] = []

        def batches_of(windows: list[tuple[int, list[Piece]]]) -> Iterator[pa.RecordBatch]:
            for rows in itertools.batched(writer.rows(windows), OUT):
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                whole = len(ids) // LONGEST * LONGEST
                for s in range(0, whole, LONGEST):
                    full.append((LONGEST, [Piece(doc, s, ids[s : s + LONGEST], len(ids))]))
                if whole < len(ids):
                    pending.append(Piece(doc, whole, ids[whole:].copy(), len(ids)))
                if len(full) >= BLOCK:
                    yield from batches_of(full)
                    full = []
                if len(pending) >= BLOCK:
                    yield from batches_of(full + pack_block(pending))
                    pending, full = [], []
        if pending or full:
            yield from batches_of(full + pack_block(pending))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(in_arrow, run, SCHEMA)
