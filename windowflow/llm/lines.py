"""Line-level deduplication across documents, in DataFrame functions alone.

Lines are exploded with their positions and hashed (128 bits), each hash's smallest and largest document
are found by an aggregate that is combined before the shuffle, and the hashes that more than one document
holds are joined back to the lines. Only hashes and positions are shuffled for that; a document's text
moves once, to the positions that it loses.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, durable, fresh

_LAST = (1 << 63) - 1


def _key(line: Column) -> Column:
    trimmed = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    ascii_only = F.octet_length(trimmed) == F.length(trimmed)
    return F.when(ascii_only, F.lower(trimmed)).otherwise(F.translate(trimmed, string.ascii_uppercase, string.ascii_lowercase))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with kept_text, n_lines and n_dropped added (helpers before clashing names get underscores).

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of at least
    ``min_chars`` code points that at least ``min_docs`` documents hold stay in the smallest of these
    alone. A null or empty text is one empty line. Rows with the same id are one document; all
    documents without an id count as one that comes after all others. No rows give no rows.
    """
    bounded(docs.sparkSession)
    taken = docs.columns
    ident, digest, lost = fresh(taken, "line_doc", "line_text_hash", "line_lost")
    added = ["kept_text", "n_lines", "n_dropped"]
    rest = docs.drop(*[c for c in taken if c.lower() in added])
    keyed = rest.withColumn(text_col, F.coalesce(F.col(text_col), F.lit(""))).withColumn(ident, F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)))
    keyed = keyed.withColumn(digest, F.xxhash64(text_col))

    lines = keyed.select(F.col(ident).alias("d"), F.col(digest).alias("t"), F.posexplode(F.split(text_col, "\n", -1)).alias("p", "line"))
    lines = lines.filter(F.length("line") >= min_chars).select("d", "t", "p", _key(F.col("line")).alias("key"))
    lines = lines.filter(F.length("key") >= min_chars)
    lines = lines.select("d", "t", "p", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(77), "key").alias("h2"))
    if min_docs == 2:  # two documents or more: the smallest isn't the largest
        held = lines.groupBy("h1", "h2").agg(F.min("d").alias("first"), F.max("d").alias("last")).filter("first <> last")
    else:
        held = lines.groupBy("h1", "h2").agg(F.min("d").alias("first"), F.countDistinct("d").alias("n")).filter(F.col("n") >= min_docs)
    # cut here, so that both sides of the join are plain shuffles and one hash's many lines can be split
    gone = (
        lines.join(durable(held.select("h1", "h2", "first")), ["h1", "h2"])
        .filter("d <> first")
        .groupBy(F.col("d").alias(ident), F.col("t").alias(digest))
        .agg(F.collect_set("p").alias(lost))
    )
    out = keyed.join(gone, [ident, digest], "left")

    def kept(parts: Column) -> Column:
        n = F.size(parts)
        left = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce(F.col(lost), F.array().cast("array<int>")))
        text = F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
        return F.struct(text.alias("kept_text"), n.cast("long").alias("n_lines"))

    whole = F.transform(F.array(F.split(text_col, "\n", -1)), kept)[0]
    out = out.withColumn("kept_text", whole).withColumn("n_dropped", F.when(F.col(lost).isNull(), 0).otherwise(F.size(lost)).cast("long"))
    return out.select(
        *[c for c in rest.columns if c != text_col],
        F.col(text_col),
        F.col("kept_text.kept_text").alias("kept_text"),
        F.col("kept_text.n_lines").alias("n_lines"),
        "n_dropped",
    )
