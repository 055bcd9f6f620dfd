"""Column statistics and the encodings that they suggest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.batch import numbered
from ..plans.durable import durable


def _bits(x: Column) -> Column:
    """Bits of the whole part of a span of values."""
    return F.greatest(F.lit(1), F.ceil(F.log2(F.floor(x) + 1))).cast("int")


def column_stats(df: DataFrame, order: list[str], columns: list[str] | None = None, least_run: float = 5.0) -> DataFrame:
    """One row per column: n, n_distinct, low, high, runs, average run, rle, precision in bits, encoding.

    A run is a stretch of equal values in the stream's order; runs within blocks of consecutive rows are
    counted by block, and a block's first value is compared with the last one of the block before.
    """
    columns = columns or df.columns
    rows, _ = numbered(df.select(*dict.fromkeys([*order, *columns])), order)
    block = 1 << 16
    rows = rows.withColumn("_k", F.floor(F.col("_rn") / F.lit(block)))
    from pyspark.sql import Window

    inside = Window.partitionBy("_k").orderBy("_rn")
    marked = rows.select("_k", "_rn", *[F.struct(F.col(c).cast("double").alias("v"), F.coalesce((~F.col(c).eqNullSafe(F.lag(c).over(inside))) | (F.row_number().over(inside) == 1), F.lit(True)).cast("int").alias("new")).alias(c) for c in columns])
    edges = marked.groupBy("_k").agg(*[F.struct(F.min_by(f"{c}.v", "_rn").alias("first"), F.max_by(f"{c}.v", "_rn").alias("last")).alias(c) for c in columns])
    edges = durable(edges)
    before = edges.select((F.col("_k") + 1).alias("_k"), *[F.col(f"{c}.last").alias(f"_p_{c}") for c in columns])
    joined = edges.join(before, "_k").select(*[F.col(f"{c}.first").eqNullSafe(F.col(f"_p_{c}")).cast("int").alias(c) for c in columns]).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])
    sums = marked.agg(
        F.count("*").alias("n"),
        *[F.struct(F.countDistinct(f"{c}.v").alias("n_distinct"), F.min(f"{c}.v").alias("low"), F.max(f"{c}.v").alias("high"), F.sum(f"{c}.new").alias("runs")).alias(c) for c in columns],
    )
    wide = sums.join(F.broadcast(joined.select(*[F.col(c).alias(f"_j_{c}") for c in columns])))
    one = lambda c: wide.select(F.lit(c).alias("name"), "n", f"{c}.n_distinct", f"{c}.low", f"{c}.high", (F.col(f"{c}.runs") - F.col(f"_j_{c}")).alias("runs"))
    out = reduce(DataFrame.union, map(one, columns))
    kind = F.create_map(*[x for c, t in df.dtypes if c in columns for x in (F.lit(c), F.lit(t))])[F.col("name")]
    out = out.withColumn("average_run", F.col("n") / F.col("runs")).withColumn("rle", F.col("n") >= least_run * F.col("runs"))
    out = out.withColumn("precision", _bits(F.greatest(F.abs("low"), F.abs("high")))).withColumn("diff_precision", _bits(F.col("high") - F.col("low")))
    encoding = (
        F.when(F.col("name") == order[0], "base-delta")
        .when(kind.isin("float", "double"), "plain")
        .when(kind.startswith("decimal(38") | (F.col("precision") > 16), "dictionary")
        .otherwise("narrow")
    )
    return out.withColumn("encoding", encoding)
