"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.durable import durable, new_folder, release, remove, scratch

__all__ = ["ARROW_BOUNDS", "WS", "bounded", "durable", "fresh", "in_arrow", "new_folder", "release", "remove", "scratch", "table"]

#: ASCII white space as the contracts define it, for Java regular expressions.
WS = r"[ \t\n\u000B\f\r]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; read by Spark alone, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Settings of the batches in which texts are read and sent to Python: Spark's default, and the bound in its place.
ARROW_BOUNDS = {
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"),
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "500"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "2097152b"),
}


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with smaller batches than Spark's, so that rows with long texts or sets need little memory."""
    bounded(df.sparkSession)
    return df.mapInArrow(run, schema)


def bounded(spark: SparkSession) -> None:
    """Lowers the session's batches. Spark looks at them when a plan runs, so they stay lowered for what the session runs later.

    A session that has set its own keeps them; no result depends on them.
    """
    for key, (default, bound) in ARROW_BOUNDS.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, bound)


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """Names for helper columns that no input column has, whatever its case."""
    have = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out
