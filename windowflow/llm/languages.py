"""Language identification by hyperdimensional profiles.

Every letter of any script has a random vector of +1 and -1, made from its code point when it is first seen. A trigram's
vector is the product of its letters' vectors, each permuted (rolled) by its place; a text's vector is the sum over its
trigrams, and a language's prototype the sum over its training documents. A document gets the language whose
prototype has the largest cosine with its own vector.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .bpe import slices
from .common import in_arrow

DIMENSIONS, SEED = 1024, 11
#: Letters whose vectors a worker holds, trigrams bound at a time, and trigrams counted before they are bundled.
HELD, SLICE, GATHERED = 16_384, 1024, 200_000
_BITS = 21  # of a code point


@functools.cache
def _lower() -> np.ndarray:
    """Code point to its lower-case letter's; 0 for all but letters."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = ord(c.lower()[0])
    return out


def item(letter: int) -> np.ndarray:
    """The random vector of a letter, or of the gap between words (0)."""
    bits = np.frombuffer(hashlib.shake_128(f"{SEED}:{letter}".encode()).digest(DIMENSIONS // 8), np.uint8)
    return np.unpackbits(bits).astype(np.int8) * 2 - 1


class _Items:
    """Vectors of letters, rolled for each of the three places; forgets all when too many are held."""

    def __init__(self) -> None:
        self.row = np.full(0x110000, -1, np.int32)
        self.clear()

    def clear(self) -> None:
        self.row.fill(-1)
        self.n, self.rolled = 0, [np.empty((64, DIMENSIONS), np.int8) for _ in range(3)]

    def bound(self, numbers: np.ndarray) -> np.ndarray:
        """The bound vectors of trigrams by their numbers."""
        letters = numbers >> 2 * _BITS, numbers >> _BITS & (1 << _BITS) - 1, numbers & (1 << _BITS) - 1
        if self.n + 3 * len(numbers) > HELD:
            new = np.unique(np.concatenate(letters))
            if self.n + int((self.row[new] < 0).sum()) > HELD:
                self.clear()
        for x in letters:
            for letter in np.unique(x[self.row[x] < 0]).tolist():
                self._put(letter)
        first, second, third = (self.rolled[k][self.row[x]] for k, x in enumerate(letters))
        return first * second * third

    def _put(self, letter: int) -> None:
        if self.n == len(self.rolled[0]):
            self.rolled = [np.concatenate((v, np.empty_like(v))) for v in self.rolled]
        v = item(letter)
        for k, place in enumerate(self.rolled):
            place[self.n] = np.roll(v, 2 - k)
        self.row[letter] = self.n
        self.n += 1


@functools.cache
def _items() -> _Items:
    return _Items()


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a text's trigrams and how often each occurs; none without letters."""
    letters = _lower().take(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))
    keep = letters > 0
    if not keep.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keep[1:] |= letters[:-1] > 0  # of a gap between words, its first place
    letters = np.concatenate(([0], letters[keep], [0])).astype(np.int64)
    return np.unique((letters[:-2] << _BITS | letters[1:-1]) << _BITS | letters[2:], return_counts=True)


def bundle(at: np.ndarray, n: np.ndarray, kind=np.float64) -> np.ndarray:
    """The sum of trigrams' vectors, in slices, so that a long text needs no more memory than a short one."""
    out = np.zeros(DIMENSIONS, kind)
    for i in range(0, len(at), SLICE):
        out += n[i : i + SLICE].astype(kind) @ _items().bound(at[i : i + SLICE]).astype(kind)
    return out


def vector(text: str) -> np.ndarray | None:
    at, n = counts(text)
    return bundle(at, n, np.float32) if len(at) else None


class _Profile:
    """Trigrams of one language's documents; bundled whenever many are gathered, so its memory is bounded."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.sum = 0, np.zeros(DIMENSIONS, np.int64)

    def add(self, at: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((at, n))
        self.size += len(at)
        if self.size >= GATHERED:
            self.flush()

    def flush(self) -> np.ndarray:
        if self.parts:
            at, where = np.unique(np.concatenate([a for a, _ in self.parts]), return_inverse=True)
            n = np.bincount(where, np.concatenate([n for _, n in self.parts]))
            self.sum += np.rint(bundle(at, n)).astype(np.int64)
            self.parts, self.size = [], 0
        return self.sum


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes from all rows with a text and a language.

    Every task bundles its documents per language; the bundles, a vector each, are summed by Spark.
    What reaches the driver is the model: one vector per language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, _Profile] = {}
        for batch in batches:
            for part in slices(batch):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    at, n = counts(text)
                    if len(at):
                        total.setdefault(lang, _Profile()).add(at, n)
        langs = sorted(total)
        vectors = [total[x].flush() for x in langs]
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(vectors, pa.list_(pa.int64()))], ["lang", "v"])

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    sums = rows.transform(in_arrow, run, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
    sums = sums.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    model = {}
    for row in sums.select("lang", F.col("v.x").alias("v")).collect():
        v = np.array(row["v"], np.float64)
        model[row["lang"]] = v / np.linalg.norm(v) if v.any() else v
    return dict(sorted(model.items()))


def identify(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added (columns of these names are replaced).

    lang_pred is the language of the nearest prototype, the first in alphabetical order on a tie; ``und``
    with score 0 for a text that is null or has no letter, and if the model is empty. The score is
    the cosine, cut to 0 to 1. No rows give no rows; other columns are kept.
    """
    langs = list(model)
    matrix = np.array([model[x] for x in langs], np.float32).reshape(len(langs), DIMENSIONS)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).cast("string").alias("lang_text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                said, scores = [], []
                for text in part.column(part.num_columns - 1).to_pylist():
                    v = vector(text) if text and langs else None
                    if v is None:
                        said.append("und")
                        scores.append(0.0)
                        continue
                    cosines = matrix @ v / max(float(np.linalg.norm(v)), 1e-12)
                    best = int(cosines.argmax())
                    said.append(langs[best])
                    scores.append(min(1.0, max(0.0, float(cosines[best]))))
                columns = [*part.columns[:-1], pa.array(said, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "lang_pred", "score"])

    schema = StructType([*rows.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.transform(in_arrow, run, schema)
