"""Secret scans: fixed patterns, and random strings exposed by how badly a tokenizer compresses them.

A vocabulary made from natural text needs few tokens for words and identifiers but about one for every two
characters of a random string. Candidates are unbroken runs of key-like characters with letters and
digits, or of letters alone; those with few characters per token are secrets, unless they are known digests
(hexadecimal of a digest's length), UUIDs, dates and times, or identifiers made of words. What a word is the vocabulary says,
not its look: random small letters stand in rows too. A run that isn't random as a whole, as a path, is
judged by its pieces between / + _ - again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, slices
from .common import in_arrow

# fixed values: kinds in the order in which equal starts are listed, and their patterns
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are disjoint, so shorter ones can be left out at once
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Dates and times as file names and logs write them: a known kind of identifier.
MOMENT = re.compile(r"(?:19|20)\d\d[-_/]?[01]\d[-_/]?[0-3]\d(?:[Tt_-]?[0-2]\d(?:[-_]?[0-5]\d){1,2}(?:[-_]?\d{1,9})?)?(?:[Zz]|[+-][01]\d[0-5]\d|[A-Z]{3,4})?")
HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Hexadecimal digits of the usual digests (MD5, SHA-1, SHA-2).
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
WORDLIKE = re.compile(r"[A-Za-z]?[a-z]{3,}")
PIECE = re.compile(r"[A-Za-z0-9]+=*")
#: Letters alone compress worse by chance than letters and digits do: a smaller bound, as a factor, and a least alphabet.
LETTERS_FACTOR, LETTERS_DISTINCT = 0.9, 8


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and then kind."""
    found = []
    folded = text if text.isascii() else text.encode("ascii", "replace").decode()
    lower = folded.lower()
    if any(k in lower for k in ("passw", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _identifier(run: str, tokens_of) -> bool:
    """Made of words: most letters lie in runs of at least three small ones, and in tokens of at least three letters.

    Where separators part the words, the look is enough: pieces that the vocabulary doesn't know are judged later.
    """
    letters = sum(c.isalpha() for c in run)
    if sum(m.end() - m.start() for m in WORDLIKE.finditer(run)) < 0.7 * letters:
        return False
    return PIECE.fullmatch(run) is None or sum(len(t) for t in tokens_of(run) if len(t) >= 3 and t.isalpha()) >= 0.6 * letters


def _random(run: str, tokens_of, least_ratio: float) -> bool:
    if len(run) < 16 or not any(c.isalpha() for c in run):
        return False
    if not any(c.isdigit() for c in run):
        if not run.rstrip("=").isalpha() or len(set(run)) < LETTERS_DISTINCT:
            return False
        least_ratio *= LETTERS_FACTOR
    if UUID.fullmatch(run) or MOMENT.fullmatch(run) or HEXADECIMAL.fullmatch(run) and len(run) in DIGESTS:
        return False
    return len(run) < least_ratio * len(tokens_of(run)) and not _identifier(run, tokens_of)


def _stretches(run: str, tokens_of, least_ratio: float) -> Iterator[tuple[int, int]]:
    """Pieces of a run; neighbours that are no words are taken together, as keys may hold the separators themselves."""
    pieces = [(m.start(), m.end()) for m in PIECE.finditer(run)]
    if len(pieces) < 2:
        return
    group: list[tuple[int, int]] = []
    for at in [*pieces, None]:
        piece = run[at[0] : at[1]] if at else ""
        if at and len(piece) < least_ratio * len(tokens_of(piece)) and not _identifier(piece, tokens_of):
            group.append(at)
            continue
        if group:
            start, end = group[0][0], group[-1][1]
            # dates and versions are digits between separators; a key has letters
            if len(group) > 1 and 3 * sum(c.isalpha() for c in run[start:end]) >= end - start and _random(run[start:end], tokens_of, least_ratio):
                yield start, end
            else:
                yield from (g for g in group if _random(run[g[0] : g[1]], tokens_of, least_ratio))
        group = []


def random_spans(text: str, tokens_of, least_ratio: float) -> list[tuple[int, int, int]]:
    """Runs, or pieces of them, with fewer than ``least_ratio`` characters per token; ``tokens_of`` gives a run's tokens."""
    found = []
    for m in CANDIDATE.finditer(text):
        run = m[0].strip("-_/+")
        start = m.start() + m[0].index(run)
        if UUID.fullmatch(run):
            continue
        if _random(run, tokens_of, least_ratio):
            found.append((start, 3, start + len(run)))
        else:
            found += [(start + s, 3, start + e) for s, e in _stretches(run, tokens_of, least_ratio)]
    return found


def scan_secrets(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", least_ratio: float = 2.2) -> DataFrame:
    """doc_id and spans, array of (kind, start, end) by start and kind, for every row of ``docs``.

    Positions are code points, ends exclusive. Spans of different kinds may overlap. A null or empty
    text has none; null and repeated ids are returned as they are; no rows give no rows; other
    columns are not looked at. Whole texts are scanned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = encoder(ranks_path).tokens
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            for part in slices(batch):
                spans = [
                    [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in all_spans(t or "", tokens_of, least_ratio)]
                    for t in part.column(1).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(
        in_arrow, run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>"
    )


def all_spans(text: str, tokens_of, least_ratio: float) -> list[tuple[int, int, int]]:
    return sorted(base_spans(text) + random_spans(text, tokens_of, least_ratio))


def redact_secrets(docs: DataFrame, ranks_path: str, text_col: str = "text", least_ratio: float = 2.2, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of its texts replaced by ``mark``; spans that overlap or touch become one.

    Rows, order and all other columns stay as they are; a null text stays null.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = encoder(ranks_path).tokens
        for batch in batches:
            for part in slices(batch):
                texts = [None if t is None else _redacted(t, all_spans(t, tokens_of, least_ratio), mark) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at).name, pa.array(texts, part.schema.field(at).type))

    return docs.transform(in_arrow, run, docs.schema)


def _redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, done = [], 0
    for start, _, end in spans:
        if start > done or not out and start == done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join([*out, text[done:]]) if out else text
