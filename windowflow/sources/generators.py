"""Deterministic streams with the schemas of the usual stream benchmarks.

A value is a hash of the row's number and the column's, so rows don't depend on partitioning. The hash is plain
integer arithmetic that any SQL engine can repeat, and fractions are binary, so that their sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_P = 2**31 - 1
#: Rows that a task makes at most.
A_TASK = 2_000_000


def pick(salt: int, n: int, first: int = 0) -> Column:
    """A uniform integer from ``first``, ``n`` values wide."""
    h = (F.col("id") % _P * 48271 + salt * 69621 + 1) % _P
    return (h * h % _P * 16807 + h) % _P % n + first


def pick_sql(salt: int, n: int, first: int = 0) -> str:
    """``pick`` in SQL."""
    h = f"((id % {_P} * 48271 + {salt * 69621 + 1}) % {_P})"
    return f"(({h} * {h} % {_P} * 16807 + {h}) % {_P} % {n} + {first})"


def share(salt: int, below: int = 1, parts: int = 1024) -> Column:
    """A uniform fraction from 0 to ``below`` in steps of 1 / ``parts``, a power of two."""
    return pick(salt, below * parts) / float(parts)


def ids(spark: SparkSession, first: int, last: int, parts: int | None = None) -> DataFrame:
    """The numbers of rows from ``first`` up to ``last``, in ``parts`` partitions, or as many as give a task at most A_TASK rows."""
    return spark.range(first, last, 1, parts or max(spark.sparkContext.defaultParallelism, -(-(last - first) // A_TASK)))


def _rows(spark: SparkSession, n: int | DataFrame, **columns: Column) -> DataFrame:
    """``n`` rows, or one for each of some ``ids``."""
    rows = ids(spark, 0, n) if isinstance(n, int) else n
    return rows.select(*[c.alias(k) for k, c in columns.items()])


def random_rows(spark: SparkSession, n: int | DataFrame) -> DataFrame:
    return _rows(spark, n, timestamp=F.col("id"), attr1=pick(1, 1000, 1).cast("int"), attr2=pick(2, 1000, 1).cast("int"))


def cluster_monitoring(spark: SparkSession, n: int | DataFrame, per_second: int = 100) -> DataFrame:
    return _rows(
        spark, n, timestamp=F.floor(F.col("id") / per_second).cast("long"), jobId=pick(1, 500), taskId=pick(2, 5000), machineId=pick(3, 1000),
        eventType=pick(4, 9).cast("int"), userId=pick(5, 100).cast("int"), category=pick(6, 4).cast("int"), priority=pick(7, 12).cast("int"),
        cpu=share(8).cast("float"), ram=share(9).cast("float"), disk=share(10).cast("float"), constraints=pick(11, 2).cast("int"),
    )


def smart_grid(spark: SparkSession, n: int | DataFrame, per_second: int = 100) -> DataFrame:
    return _rows(
        spark, n, timestamp=F.floor(F.col("id") / per_second).cast("long"), value=share(1, 100, 64).cast("float"), property=pick(2, 2).cast("int"),
        plug=pick(3, 10).cast("int"), household=pick(4, 8).cast("int"), house=pick(5, 40).cast("int"), padding=F.lit(0),
    )


def linear_road(spark: SparkSession, n: int | DataFrame, per_second: int = 100) -> DataFrame:
    return _rows(
        spark, n, timestamp=F.floor(F.col("id") / per_second).cast("long"), vehicle=pick(1, 1000).cast("int"), speed=share(2, 80, 64).cast("float"),
        highway=pick(3, 4).cast("int"), lane=pick(4, 5).cast("int"), direction=pick(5, 2).cast("int"), position=pick(6, 528_000).cast("int"),
    )


def manufacturing(spark: SparkSession, n: int | DataFrame, per_second: int = 100) -> DataFrame:
    small = {f"mf0{i}": pick(i, 20_000).cast("int") for i in (1, 2, 3)} | {c: pick(10 + i, 2).cast("int") for i, c in enumerate(("pc13", "pc14", "pc15", "pc25", "pc26", "pc27", "res", "bm05", "bm06"))}
    return _rows(spark, n, timestamp=F.floor(F.col("id") / per_second).cast("long"), messageIndex=F.col("id"), **small)


def yahoo(spark: SparkSession, n: int | DataFrame, ads: int = 1000) -> DataFrame:
    """Advertising events: types and ads in turn, a thousand rows per time unit."""
    at = F.col("id") % 100_000
    return _rows(
        spark, n, timestamp=F.floor(F.col("id") / 1000).cast("long"), user_id=pick(1, 10_000), page_id=pick(2, 10_000), ad_id=at % ads,
        ad_type=at % 5, event_type=at % 3, ip_address=F.lit(-1).cast("long"),
    )


def campaigns(spark: SparkSession, n: int = 100, ads: int = 10) -> DataFrame:
    return spark.range(n * ads).select(F.col("id").alias("ad_id"), F.floor(F.col("id") / ads).cast("long").alias("campaign_id"))


def auctions(spark: SparkSession, n: int | DataFrame) -> DataFrame:
    """Auctions of a schedule of one person, three auctions and 46 bids in fifty events, a thousand per unit."""
    event = F.floor(F.col("id") / 3) * 50 + F.col("id") % 3 + 1
    ident = F.floor(event / 50) * 3 + F.col("id") % 3 + 1000
    hot = pick(1, 100) < 90
    return _rows(
        spark, n, timestamp=F.floor(event / 1000).cast("long"), id=F.when(hot, F.floor(ident / 20) * 20).otherwise(ident).cast("long"),
        itemName=pick(2, 10_000), description=pick(3, 10_000), initialBid=pick(4, 1000, 1), reserve=pick(5, 10_000, 1),
        expires=F.floor(event / 1000).cast("long") + pick(6, 100, 1), seller=pick(7, 1000), category=pick(8, 5, 10),
    )
