"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct shingles of five words. Its sketch is a HyperMinHash: each of 128
buckets holds, for the smallest hash that fell there, the count of leading zeros and ten mantissa bits,
so a register is 16 bits whatever the size of the set. Empty buckets borrow from others in a fixed
random order, so a short text has a whole sketch too. Four compressed registers make a band and two
documents that agree on any of 32 bands are candidates: a pair at a similarity of 0.75 is missed with a
chance of about (1 - 0.75^4)^32 = 5e-6. A collision-corrected estimate from the registers drops candidates
far below the threshold; the rest are compared on their full shingle sets.

Work in a bucket of candidates never makes all its pairs. Documents with the same set are one class from
the start. Every class is first compared with the smallest one of each of its buckets; found links
join classes into components. Only buckets that still hold more than one component are looked at again, and
there only the strays ask: the members outside the bucket's largest component. Askers and members are cut
into blocks of bounded size, and a block of askers meets a block of members in one row group, so the members
of a large component are shuffled once for every block of its strays. What comes out, for an asker and a part of the
other documents, is the list of those in other components that pass the estimate; the asker then visits that part's
full sets. No bucket is capped, and no pair that passes the estimate stays unchecked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, in_arrow, release
from .graph import components

WORDS, BUCKETS, BAND = 5, 128, 4
BANDS = BUCKETS // BAND
ZEROS, MANTISSA = 6, 10
#: Members of a bucket in a block.
BLOCK = 1024
#: Hashes of full sets that are held together when askers are compared with them.
PART = 1 << 21
#: Bytes of a text that are cut into words at a time.
CHUNK = 1 << 20


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: One odd factor for each word of a shingle.
FACTORS = _splitmix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class _Hashes(dict):
    """Word to 64-bit hash; forgets all when it has grown large, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_SPACE = re.compile(rb"[\x20\t-\r]")


def _word_hashes(text: str, cache: dict) -> np.ndarray:
    raw = text.encode("utf-8", "surrogatepass").lower()  # lower and split touch ASCII alone
    parts, at = [], 0
    while at < len(raw):
        m = _SPACE.search(raw, at + CHUNK)
        end = m.start() if m else len(raw)
        words = (raw if end - at == len(raw) else raw[at:end]).split()
        parts.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingles(text: str | None, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; empty without words."""
    h = _word_hashes(text or "", cache)
    if not len(h):
        return h
    k = min(WORDS, len(h))
    n = len(h) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total += h[i : i + n] * FACTORS[i]
    total = np.sort(_splitmix(total))
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


_EDGES = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(57)
_ORDER = np.argsort(_splitmix(np.arange(1, BUCKETS * BUCKETS + 1, dtype=np.uint64)).reshape(BUCKETS, BUCKETS), axis=1)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """128 registers of 16 bits from sorted distinct hashes (at least one)."""
    starts = np.searchsorted(hashes, _EDGES)
    full = np.append(starts[1:], len(hashes)) > starts
    if not full.all():
        gaps = np.flatnonzero(~full)
        order = _ORDER[gaps]
        starts[gaps] = starts[order[np.arange(len(gaps)), full[order].argmax(axis=1)]]
    rest = hashes[starts] << np.uint64(7)
    zeros = (53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]).astype(np.uint64)
    mantissa = (rest << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype("<u2")


def estimate(equal: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less what chance collisions add.

    The expected share of collisions of unrelated sets of a and b elements is the closed form of the
    HyperMinHash paper: 0.1699 * 2^-mantissa * 4ab / (a + b)^2.
    """
    chance = 0.169919487159739 * 2.0**-MANTISSA * 4.0 * a * b / (a + b) ** 2
    return (equal - chance) / (1 - chance)


def _hopeful(equal: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs whose sizes allow the similarity and whose estimate is at most four deviations short of it."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    least = similarity - 4 * np.sqrt(similarity * (1 - similarity) / np.minimum(BUCKETS, np.maximum(a, b)))
    return (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9) & (estimate(equal, a, b) >= least)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _Hashes()
    for batch in batches:
        n, sig, bands = [], [], []
        for text in batch.column(1):
            h = shingles(text.as_py(), cache)
            n.append(len(h))
            sig.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
            bands.append(sketch(h).view("<i8") if len(h) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "sig", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _Hashes()
    for batch in batches:
        found = [shingles(t.as_py(), cache).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["rep", "hashes"])


def _registers(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("<i8", copy=False)
    return np.ascontiguousarray(flat).view("<u2").reshape(-1, BUCKETS)


def _screen(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                equal = (_registers(batch.column("bands_a")) == _registers(batch.column("bands_b"))).mean(axis=1)
                good = _hopeful(equal, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), similarity)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)))
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _meetings(similarity: float):
    """Rows come sorted by bucket and blocks, members before askers. Out go, for an asker and a part of the others, those that may be linked to it.

    Only pairs of different components count, each in the first band on which it agrees. Two askers meet
    twice, once as member each; of these, the one in which the asker has the larger id counts.
    """
    names = ("band", "key", "i", "j", "asks", "part", "rep", "component", "n")

    def candidates(members: dict[str, np.ndarray], x: dict, k: int) -> np.ndarray:
        j = np.flatnonzero((members["component"] != x["component"][k]) & ((members["stray"] == 0) | (members["rep"] < x["rep"][k])))
        n = members["n"][j]
        j = j[np.minimum(n, x["n"][k]) >= similarity * np.maximum(n, x["n"][k]) - 1e-9]
        if not len(j):
            return j
        same = members["bands"][j] == x["bands"][k]
        earliest = same.reshape(len(j), BANDS, BAND).all(axis=2).argmax(axis=1) == x["band"][k]
        return j[earliest & _hopeful(same.mean(axis=1), np.full(len(j), x["n"][k]), members["n"][j], similarity)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, members = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in (*names, "stray")}
            rows["bands"] = _registers(batch.column("bands"))
            group = np.stack([rows[k] for k in names[:5]], axis=1)
            cuts = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            part, xs, ys = [], [], []
            for s, e in zip([0, *cuts], [*cuts, len(group)], strict=True):
                if now != (at := tuple(group[s, :4].tolist())):
                    now, kept, members = at, [], None
                piece = {k: v[s:e] for k, v in rows.items()}
                if not piece["asks"][0]:
                    kept.append({k: v.copy() for k, v in piece.items()})
                    continue
                if not kept:
                    continue
                if members is None:
                    members = {k: np.concatenate([x[k] for x in kept]) for k in kept[0]}
                for k in range(e - s):
                    j = candidates(members, piece, k)
                    for p in np.unique(members["part"][j]).tolist():
                        part.append(p)
                        xs.append(int(piece["rep"][k]))
                        ys.append(members["rep"][j[members["part"][j] == p]])
            lists = pa.array(ys, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(xs, pa.int64()), lists], ["part", "x", "ys"])

    return run


def _compare(percent: int):
    """Rows come sorted by part; in each part the sets to compare with (ys null), then entries with their ys.

    Of an entry's links to one component the first is enough.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sets = None, {}
        for batch in batches:
            a, b = [], []
            for i in range(batch.num_rows):
                if (now := batch.column("part")[i].as_py()) != part:
                    part, sets = now, {}
                x = np.frombuffer(batch.column("hashes")[i].as_buffer(), np.uint64)
                ident = batch.column("x")[i].as_py()
                ys = batch.column("ys")[i].as_py()
                if ys is None:
                    sets.setdefault(ident, []).append((batch.column("component")[i].as_py(), x.copy()))
                    continue
                done = set()
                for y in ys:
                    for component, other in sets[y]:
                        if component in done:
                            continue
                        both = np.sort(np.concatenate((x, other)))
                        common = int((both[1:] == both[:-1]).sum())
                        if 100 * common >= percent * (len(x) + len(other) - common):
                            done.add(component)
                            a.append(ident)
                            b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets;
    component_id is the smallest id that a document reaches, kept says that it is that document itself.
    A text that is null, empty or without words has no shingles and links with nothing. A row without
    an id links with nothing either: its component_id is null and it is kept. Rows that repeat an id
    are each returned; such a document is linked through any of its texts. No rows give no rows; other columns
    of ``docs``, whatever their names, are not looked at.
    """
    similarity = percent / 100
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = durable(docs.transform(in_arrow, _describe, "doc_id long, n_shingles long, sig binary, bands array<long>"))
    classes = durable(
        described.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("sig")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    )
    # wherever an aggregate meets rows again it is written first: then both sides are plain shuffles, and Spark splits a hot key's rows
    entries = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = durable(entries.groupBy("band", "key").agg(F.min("rep").alias("top"), F.count("*").alias("members")).filter("members > 1"))
    crowded = durable(entries.join(buckets, ["band", "key"]).select("band", "key", "rep", "members", "top"))
    stars = crowded.filter("rep <> top").select(F.col("top").alias("a"), F.col("rep").alias("b")).distinct()
    links = _confirmed(_screened(stars, classes, similarity), docs, percent)
    found = durable(components(links, "a", "b"))

    grouped = durable(
        crowded.select("band", "key", "rep", "members").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    open_buckets = durable(
        grouped.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("band", "key")
    )
    strays = durable(grouped.join(open_buckets, ["band", "key"]))
    sizes = strays.groupBy("band", "key", "component").agg(F.count("*").alias("size"))
    most = durable(sizes.groupBy("band", "key").agg(F.max_by("component", "size").alias("most"), (F.sum("size") - F.max("size")).alias("askers")))
    ids = durable(classes.select("rep", "n").join(strays.select("rep", "component").distinct(), "rep"))
    parts = max(1, -(-(ids.agg(F.sum("n")).first()[0] or 0) // PART))
    placed = (
        strays.join(most, ["band", "key"])
        .withColumn("stray", (F.col("component") != F.col("most")).cast("int"))
        .withColumn("member_blocks", F.ceil(F.col("members") / F.lit(BLOCK)).cast("int"))
        .withColumn("asker_blocks", F.ceil(F.col("askers") / F.lit(BLOCK)).cast("int"))
        .withColumn("part", _part(F.col("rep"), parts))
    )
    block = lambda of: F.pmod(F.xxhash64("rep"), F.col(of)).cast("int")
    every = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    visits = F.transform(every("asker_blocks"), lambda i: F.struct(i.alias("i"), block("member_blocks").alias("j"), F.lit(0).alias("asks")))
    asked = F.transform(every("member_blocks"), lambda j: F.struct(block("asker_blocks").alias("i"), j.alias("j"), F.lit(1).alias("asks")))
    visits = F.when(F.col("stray") == 1, F.concat(visits, asked)).otherwise(visits)
    met = (
        placed.withColumn("v", F.explode(visits)).join(classes.select("rep", "n", "bands"), "rep")
        .select("band", "key", "v.i", "v.j", "v.asks", "stray", "part", "rep", "component", "n", "bands")
        .repartition("band", "key", "i", "j")
        .sortWithinPartitions("band", "key", "i", "j", "asks")
    )
    hopeful = durable(met.transform(in_arrow, _meetings(similarity), "part int, x long, ys array<long>"))
    release(buckets, crowded, grouped, open_buckets, strays, most)
    if not hopeful.isEmpty():
        sets = _hashed(docs, ids.select(F.col("rep").alias("doc_id")))
        none = F.lit(None)
        told = ids.join(sets, "rep").select(
            _part(F.col("rep"), parts).alias("part"), F.col("rep").alias("x"), none.cast("array<long>").alias("ys"), "component", "hashes"
        )
        asking = hopeful.join(sets.withColumnRenamed("rep", "x"), "x").select("part", "x", "ys", none.cast("long").alias("component"), "hashes")
        compared = told.union(asking).repartition("part").sortWithinPartitions("part", F.col("ys").isNotNull())
        more = durable(compared.transform(in_arrow, _compare(percent), "a long, b long"))
        first = found
        found = durable(components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), "a", "b"))
        release(first, more, sets)
    release(hopeful, ids, links)

    member = classes.select("sig", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    member = durable(member.select("sig", F.coalesce("component", "rep").alias("component")))
    release(classes, found)
    return (
        described.join(member, "sig", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def _screened(stars: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the similarity."""
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("bands").alias(f"bands_{c}"))
    pairs = stars.join(side("a"), "a").join(side("b"), "b").filter(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9)
    return durable(pairs.transform(in_arrow, _screen(similarity), "a long, b long"))


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs of representatives that meet the similarity on their full sets."""
    sets = _hashed(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    out = durable(
        pairs.join(sets.select(F.col("rep").alias("b"), F.col("hashes").alias("y")), "b").join(sets.select(F.col("rep").alias("a"), F.col("hashes").alias("x")), "a")
        .transform(in_arrow, _confirm(percent), "a long, b long")
    )
    release(sets, pairs)
    return out


def _hashed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, hashes) for the documents of ``ids``; texts are shuffled at every size, as the number of ids has no bound."""
    return durable(docs.join(ids.hint("merge"), "doc_id").select("doc_id", "text").transform(in_arrow, _sets, "rep long, hashes binary"))


def _part(rep: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(rep, F.lit(1)), F.lit(parts)).cast("int")
