"""Token counts that follow edits.

A document's pre-tokens are gathered into leaves of some hundred characters, cut where the scan of ``bpe`` says that
a pre-token begins and no white space stands before: texts on both sides then have the pre-tokens of
the whole, in any script. A segment tree holds characters and tokens of every subtree. An edit re-encodes the
leaves that it touches, with neighbours while their common edge is no such place any more, and
updates the sums above them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import EDGE, encoder, is_cut, next_cut, slices
from .common import in_arrow

LEAF = 512

def cut(text: str, leaf: int = LEAF) -> list[str]:
    """Leaves of about ``leaf`` characters or more that can be encoded one by one.

    White space behind other characters always begins a pre-token; only where there is none for a while must the text be scanned.
    """
    out, at = [], 0
    while len(text) - at > leaf:
        m = EDGE.search(text, at + leaf, at + 5 * leaf)
        place = m.start() if m else next_cut(text, at, leaf)
        if place is None:
            break
        out.append(text[at:place])
        at = place
    out.append(text[at:])
    return out


class EditableCount:
    """A text under edits, with its token count at hand."""

    def __init__(self, text: str, count, leaf: int = LEAF):
        self.count, self.leaf, self.encoded = count, leaf, 0
        self._build(cut(text, leaf))

    def _build(self, leaves: list[str], tokens: list[int] | None = None) -> None:
        self.leaves = leaves
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.chars, self.tokens = [0] * 2 * self.size, [0] * 2 * self.size
        for i, x in enumerate(leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = len(x), self._encode(x) if tokens is None else tokens[i]
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _encode(self, text: str) -> int:
        self.encoded += len(text)
        return self.count(text)

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds position ``at`` (the last one for the end) and the position in it."""
        i = 1
        while i < self.size:
            i *= 2
            if at >= self.chars[i] and self.chars[i + 1]:
                at -= self.chars[i]
                i += 1
        return i - self.size, at

    def edit(self, at: int, deleted: int, inserted: str) -> int:
        """Replaces ``deleted`` characters from ``at`` on (both cut to the text) and returns the new count."""
        at = min(max(at, 0), self.length)
        end = min(at + max(deleted, 0), self.length)
        first, a = self._find(at)
        last, b = self._find(end) if end > at else (first, a)
        middle = self.leaves[first][:a] + inserted + self.leaves[last][b:]
        while True:  # boundary context
            before, after = self._near(first, -1), self._near(last, 1)
            if before is not None and (not middle or not is_cut(self.leaves[before], middle)):
                first, middle = before, self.leaves[before] + middle
            elif after is not None and (not middle or not is_cut(middle, self.leaves[after])):
                last, middle = after, middle + self.leaves[after]
            else:
                break
        if len(middle) > 8 * self.leaf and len(parts := cut(middle, self.leaf)) > 1:
            tokens = self.tokens[self.size : self.size + len(self.leaves)]
            self._build(self.leaves[:first] + parts + self.leaves[last + 1 :], tokens[:first] + [self._encode(x) for x in parts] + tokens[last + 1 :])
            return self.total
        for i in range(first, last + 1):
            x = middle if i == first else ""
            self.leaves[i] = x
            k = self.size + i
            self.chars[k], self.tokens[k] = len(x), self._encode(x) if x else 0
            while k > 1:
                k //= 2
                self._sum(k)
        return self.total

    def _near(self, i: int, step: int) -> int | None:
        i += step
        while 0 <= i < len(self.leaves) and not self.leaves[i]:
            i += step
        return i if 0 <= i < len(self.leaves) else None


def edited_counts(docs: DataFrame, ranks_path: str, edits_col: str = "edits", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, edited_tokens, n_chars, edited_chars, encoded_chars, n_edits per row of ``docs``.

    ``edits_col`` is an array of (at, deleted, inserted) in code points, applied one after the other to
    the text as it then is; positions outside are cut to the text, null fields count as 0 and empty,
    a null array as none, a null text as empty. encoded_chars counts what the edits re-encoded. Null
    and repeated ids are returned as they are; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path).encode
        count = lambda text: len(encode(text))
        names = ["doc_id", "n_tokens", "edited_tokens", "n_chars", "edited_chars", "encoded_chars", "n_edits"]
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, text, edits in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    tree = EditableCount(text or "", count)
                    n, chars, tree.encoded = tree.total, tree.length, 0
                    for e in edits or []:
                        if e is not None:
                            tree.edit(e["at"] or 0, e["deleted"] or 0, e["inserted"] or "")
                    rows.append((doc, n, tree.total, chars, tree.length, tree.encoded, len(edits or [])))
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(edits_col).alias("edits")).transform(
        in_arrow, run, "doc_id long, n_tokens long, edited_tokens long, n_chars long, edited_chars long, encoded_chars long, n_edits long"
    )


def sample_edits(text_col: str = "text"):
    """A fixed edit script for any text: an insertion, a deletion and a replacement at its quarters."""
    n = F.coalesce(F.length(text_col), F.lit(0))
    at = lambda k: F.floor(n * k / 4).cast("int")
    one = lambda k, gone, new: F.struct(at(k).alias("at"), F.lit(gone).alias("deleted"), F.lit(new).alias("inserted"))
    return F.array(one(1, 0, " (see the note)"), one(2, 24, ""), one(3, 7, "isn't 2,048"))
